"""WARC archives: written in segments, read back by reassembly.

Writing. Each row becomes a record. Among rows with equal payloads of at least `smallest` bytes the one with the
largest id is a response, the others are revisits of it without a payload (those that share the largest id are
all responses; a null id is below any other). A response is an HTTP message in chunked transfer framing. One
longer than `segment` bytes is split: its first part keeps the type response, the rest are continuation records
with WARC-Segment-Number and the first part's id in WARC-Segment-Origin-ID; the last has
WARC-Segment-Total-Length. Continuations are dealt over other files than their first part, as an archive's size
limit would do. Spark's own text writer makes the gzip files, with CR LF CR LF after each record, so they go to
whatever file system the shared folder is on. A row's record id is made in the pass that writes it and in no other; a
revisit names its response by payload digest and target, so nothing depends on the order of rows in another pass.

Reading. Files are read whole, each of a bounded size, and parsed by Content-Length. Records that are whole
pass on; segments are grouped by origin and ordered by number, a group being one record. Numbers that are not
1..n, or a length other than the total, raise an error. The chunk framing is then decoded and the digest taken
of the payload that comes out; a revisit gets length and digest from the response with its digest, and they
must agree with its own header. A payload that a large part of all revisits refers to is not shuffled to one task.

Defined cases: a null payload counts as empty, a null target as blank; a null id is written as blank and read as null. A
repeated row is a record of its own. An empty table makes an empty archive and no rows. A very long payload is one
value, as in its table, and as many segments as it needs. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idiolect.llm.common import as_bytes, cut, removed, scratch
from idiolect.llm.graph import joined

#: DuckDB SQL for the columns of op5 over pages.
ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as raw, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, octet_length(raw) as n, max(page_id) over (partition by hex, octet_length(raw)) as last,
         array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, 5 * (i // 4)::integer + 1, 5))::bigint >> (15 - 5 * (i % 4)::integer)) & 31)::integer + 1]), '') as digest
  from p)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id is not distinct from last then 'response' else 'revisit' end as record_type,
       case when page_id is not distinct from last then null else last end as refers_to
from d
"""
#: Bytes of a segment, of a chunk in the transfer framing, and about how many of a file.
SEGMENT, CHUNK, FILE = 32_768, 8_192, 8 << 20
SMALLEST = 0
_RECORD = re.compile(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)+)\r\n")
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_END = b"\r\n\r\n"
ROW = "uid string, id_text string, type string, target string, digest string, total long, number int, origin string, body binary"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        n = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        out.append(framed[at : at + n])
        if len(out[-1]) != n or framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk framing is broken")
        at += n + 2


def record(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body


def records(uid: str, page: str, url: str, digest: str, total: int, refers: str | None, refers_id: str | None, payload: bytes, segment: int = SEGMENT) -> list[tuple[int, bytes]]:
    """Segment number (0: whole) and bytes of a row's records, without the closing blank lines. refers: the target of
    the response that a revisit refers to."""
    common = [("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Row-ID", page)]
    if refers is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:row:{uid}>"), ("WARC-Refers-To-Target-URI", refers), ("X-Refers-To-Row", str(refers_id)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(total))]
        return [(0, record(more + common, b""))]
    message = _STATUS + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(message) <= segment:
        return [(0, record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:row:{uid}>"), *common, kind], message))]
    parts = [message[i : i + segment] for i in range(0, len(message), segment)]
    out = [(1, record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:row:{uid}>"), *common, kind, ("WARC-Segment-Number", "1")], parts[0]))]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:row:{uid}-{k}>"), ("WARC-Segment-Number", str(k)), ("WARC-Segment-Origin-ID", f"<urn:row:{uid}>")]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(message))))
        out.append((k, record(more, part)))
    return out


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(content):
        m = _RECORD.match(content, at)
        if not m:
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in m[1].decode().split("\r\n") if line)
        end = m.end() + int(headers["Content-Length"])
        if content[end : end + 4] != _END:
            raise ValueError(f"the record at byte {at} has not its length")
        yield headers, content[m.end() : end]
        at = end + 4


def _urn(x: str) -> str:
    return x.removeprefix("<urn:row:").removesuffix(">")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = SMALLEST, segment: int = SEGMENT) -> None:
    """The archive of pages as files under path."""
    seen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), F.monotonically_increasing_id().cast("string").alias("uid"))

    def digested(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw = as_bytes(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array([sha1(x) for x in raw], pa.string()), batch.column(3)], names=["id", "url", "payload", "digest", "uid"])

    rows = seen.mapInArrow(digested, "id long, url string, payload binary, digest string, uid string")
    size = F.length("payload").cast("long")
    heads = rows.select("digest", size.alias("total"), "id", F.coalesce("url", F.lit("")).alias("url")).where(F.col("total") >= smallest)
    first = heads.groupBy("digest", "total").agg(F.max(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    chosen = cut(first.select("digest", "total", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")), "copies")  # its size is known then: payloads are shuffled only if it is large
    dealt = rows.withColumn("total", size).join(chosen, ["digest", "total"], "left").select("uid", "id", "url", "digest", "total", "payload", "first_id", "first_url", (F.col("first_url").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))).alias("again"))

    def written(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            numbers, out, size = [], [], 0
            for uid, i, url, digest, total, payload, first_id, first_url, again in zip(*cols):
                url, first_url = (re.sub(r"[\r\n]", " ", x or "") for x in (url, first_url))
                for k, one in records(uid, "" if i is None else str(i), url, digest, total, first_url if again else None, "" if first_id is None else str(first_id), payload, segment):
                    numbers.append(f"{uid}-{k}" if k > 1 else uid)
                    out.append(one)
                    size += len(one)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.string()), pa.array(out, pa.binary())], names=["key", "bytes"])
                    numbers, out, size = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.string()), pa.array(out, pa.binary())], names=["key", "bytes"])

    total = pages.agg(F.sum(F.coalesce(F.octet_length(html_col), F.lit(0)) + 600)).first()[0] or 0
    files = max(1, -(-total // FILE))
    made = dealt.mapInArrow(written, "key string, bytes binary")
    made.repartition(files, "key").select(F.col("bytes").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url) of every record under path, after reassembly."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def opened(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        names = ["uid", "id_text", "type", "target", "digest", "total", "number", "origin", "body"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, body in parsed(gzip.decompress(content.as_buffer())):
                    revisit = h["WARC-Type"] == "revisit"
                    total = h.get("WARC-Segment-Total-Length") or h.get("X-Payload-Length")
                    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    number = int(h.get("WARC-Segment-Number", 0))
                    if number == 0 and not revisit:  # whole: nothing more is needed than what its payload tells
                        payload = unchunked(body[body.index(_END) + 4 :])
                        got, total, body = sha1(payload), len(payload), None
                        if got != digest:
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
                    rows.append((_urn(h["WARC-Record-ID"]), h.get("X-Row-ID"), h["WARC-Type"], h.get("X-Refers-To-Row") if revisit else None, digest, int(total) if total is not None else None, number, _urn(h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])), body))
                    size += len(body or b"")
                    if size > 4 << 20 or len(rows) > 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    found = cut(files.mapInArrow(opened, ROW), "records")
    parts = found.where("number > 0").groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "uid", "id_text", "digest", "total", "body"))).alias("parts"))

    def assembled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for parts in batch.column(1):
                parts = parts.as_py()
                message = b"".join(p["body"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(message):
                    raise ValueError(f"segments of {parts[0]['uid']} are missing or repeated")
                payload = unchunked(message[message.index(_END) + 4 :])
                if sha1(payload) != parts[0]["digest"]:
                    raise ValueError(f"payload digest of {parts[0]['uid']} differs")
                rows.append((parts[0]["uid"], parts[0]["id_text"], len(payload), parts[0]["digest"]))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["uid", "id_text", "total", "digest"])

    whole = found.where("number = 0 and type = 'response'").select("uid", "id_text", "total", "digest")
    responses = cut(whole.union(parts.mapInArrow(assembled, "uid string, id_text string, total long, digest string")), "responses")
    number = F.when(F.col("id_text") == "", None).otherwise(F.col("id_text").cast("long"))
    target = F.when(F.col("target") == "", None).otherwise(F.col("target").cast("long"))
    out = responses.select(number.alias("id"), F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = found.where("type = 'revisit'").select("id_text", "target", "digest", F.col("total").alias("own_total"))
    copies = again.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    referred = copies.join(responses.groupBy("digest").agg(F.max("total").alias("total")), "digest")
    resolved = joined(again, referred, "digest", "n", again.count(), "left")
    same = F.col("own_total") == F.col("total")
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a revisit differs from or lacks what it refers to: "), F.col("digest"))))
    return out.union(resolved.select(number, "total", checked, F.lit("revisit"), target))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = SMALLEST, segment: int = SEGMENT) -> DataFrame:
    """pages written as an archive in the shared folder and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, id_col, url_col, html_col, smallest, segment)
    found = read(spark, path)  # its records are written down
    removed(spark, path)
    return found.withColumnRenamed("id", id_col)
