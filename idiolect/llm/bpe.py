"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than CHUNK + OVERLAP characters becomes rows, one a chunk, each with the first OVERLAP characters of
the next. The rows go to tasks of their own:

1. Each chunk is pre-tokenised alone. It tells which pre-token boundaries it finds in its own first OVERLAP characters
   and in those that it shares with the next chunk.
2. Chunk by chunk, the first boundary that both neighbours find is where they have resynchronised, and the text is cut
   there. Where there is none, a boundary between a letter or digit and a blank serves; where there is none of these
   either, the chunks stay together, and the next cut needs such a boundary, too.
3. The pieces are encoded one by one, in parallel; the digests read a text's ids in order, one piece at a time, and
   decoding concatenates the raw bytes of the ids.

Why this is exact: the pre-token pattern never looks back, so from a boundary of the whole text a chunk finds the
boundaries of the whole text, but for the last ones before its end, which do not count (MARGIN: the pattern's longest
literal and its look-ahead are shorter). The first chunk starts at such a boundary, and by induction so does each that
was cut where its neighbour on the left agreed. No alternative has a blank after a letter or digit, so a boundary
between these is one of the whole text whatever comes before.

Shorter texts are chunks of their own, encoded in one pass. Defined cases: null text counts as empty, with 0 tokens and
the digests of no bytes; repeated rows, ids and null ids are rows of their own; an empty table gives no rows; very long
texts without any boundary (a run of one kind of character) are encoded in one piece. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.llm.common import as_bytes, cut_at, removed, scratch

#: Characters of a chunk, and of the overlap in which two chunks resynchronise.
CHUNK, OVERLAP = 32_768, 512
#: Characters before the end of a chunk in which its boundaries are not relied on.
MARGIN = 8
#: A vocabulary file goes to every executor, so its size is checked.
MOST_VOCABULARY_BYTES = 64 << 20
_made: dict[str, object] = {}


class Coder:
    """Encodes and decodes with ranks of a tiktoken file, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pretoken = regex.compile(pattern)
        self.settled = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")

    def encode(self, text: str) -> list[int]:
        return self.core.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.core.decode_bytes(ids)

    def bounds(self, part: str, last: bool, chunk: int, overlap: int) -> tuple[list[int], list[int], int]:
        """Boundaries in a chunk's first `overlap` characters, those in the next chunk's first ones (from its start),
        and the first settled one in its own, -1 if none."""
        ends = [m.end() for m in self.pretoken.finditer(part)]
        if not last:
            ends = [e for e in ends if e <= len(part) - MARGIN]
        found = self.settled.search(part, 0, overlap)
        return [0, *(e for e in ends if e < overlap)], [e - chunk for e in ends if e >= chunk and not last], found.start() if found else -1


def parts_of(text: str, chunk: int, overlap: int) -> list[str]:
    """The chunks with their overlaps; one for a text of up to chunk + overlap characters."""
    n = max(1, -(-(len(text) - overlap) // chunk))
    return [text[k * chunk : (k + 1) * chunk + overlap] if k < n - 1 else text[k * chunk :] for k in range(n)]


def stitched(chunks: Iterable[tuple[int, list[int], list[int], int]], chunk: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """From (number, bounds) of a text's chunks in order: (number, piece, begin, end, alone) of what each gives to the
    piece that starts in chunk `piece`, and whether it is all of it; end -1 is the chunk's end."""
    kept, piece, agreed, tail = None, 0, True, []
    for k, own, shared, settled in chunks:
        at = 0
        if k:
            both = set(own).intersection(tail) if agreed else ()
            at = min(both) if both else settled
            yield kept[0], piece, kept[1], chunk + max(at, 0), piece == kept[0] and at >= 0
        agreed = at >= 0
        piece = k if agreed else piece
        kept, tail = (k, max(at, 0)), shared
    if kept:
        yield kept[0], piece, kept[1], -1, piece == kept[0]


def coder(ranks: bytes, pattern: str) -> Coder:
    key = f"{hashlib.sha256(ranks).hexdigest()} {pattern}"
    if key not in _made:
        _made[key] = Coder(ranks, pattern)
    return _made[key]  # type: ignore[return-value]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(ranks) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MOST_VOCABULARY_BYTES} bytes")
    return ranks


def rows_to(batches: Iterator, kinds: list, names: list[str], f, most: int = 4 << 20) -> Iterator:
    """Record batches of the rows that f gives for batches, each with its size in bytes."""
    import pyarrow as pa

    rows, size = [], 0
    for row, n in f(batches):
        rows.append(row)
        size += n + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs: its id, n_tokens, the digest of its ids, the digest of their decoding, and the ids if asked for."""
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()
    result = f"id {id_kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def kinds(batch) -> list:
        return [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def short(batches: Iterator) -> Iterator:
        import numpy as np

        own = coder(shared.value, pattern)
        for batch in batches:
            out = []
            for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids = own.encode(raw.decode("utf-8", "replace"))
                packed = np.array(ids, "<u4")
                out.append((i, len(ids), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), packed.astype("i4") if with_ids else None))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds(batch))][: len(names)], names=names)

    def chunks(batches: Iterator) -> Iterator:
        for batch in batches:
            kind = batch.schema.field("id").type

            def cut(batch=batch) -> Iterator:
                for uid, i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                    parts = parts_of(raw.decode("utf-8", "replace"), chunk, overlap)
                    for k, part in enumerate(parts):
                        yield (uid, i, k, k == len(parts) - 1, part), len(part)

            yield from rows_to(None, [pa.int64(), kind, pa.int32(), pa.bool_(), pa.string()], ["uid", "id", "k", "last", "text"], lambda _: cut())

    def bounds(batches: Iterator) -> Iterator:
        own = coder(shared.value, pattern)

        def found(batches: Iterator) -> Iterator:
            for batch in batches:
                for uid, k, last, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), as_bytes(batch.column(3))):
                    head, tail, settled = own.bounds(raw.decode("utf-8", "replace"), last, chunk, overlap)
                    yield (uid, k, head, tail, settled), 8 * (len(head) + len(tail))

        numbers = pa.list_(pa.int32())
        yield from rows_to(batches, [pa.int64(), pa.int32(), numbers, numbers, pa.int32()], ["uid", "k", "head", "tail", "settled"], found)

    def stitch(batches: Iterator) -> Iterator:
        from itertools import groupby

        def found(batches: Iterator) -> Iterator:
            every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            for uid, own in groupby(every, key=lambda r: r[0]):
                for row in stitched((r[1:] for r in own), chunk):
                    yield (uid, *row), 32

        yield from rows_to(batches, [pa.int64()] + [pa.int32()] * 4 + [pa.bool_()], ["uid", "k", "piece", "begin", "end", "alone"], found)

    def pieces(batches: Iterator) -> Iterator:
        from itertools import groupby

        import numpy as np

        own = coder(shared.value, pattern)

        def found(batches: Iterator) -> Iterator:
            every = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(4)), as_bytes(batch.column(4))))
            for (uid, piece), parts in groupby(every, key=lambda r: r[:2]):
                texts = [raw.decode("utf-8", "replace")[a : None if b < 0 else b] for _, _, a, b, raw in parts]
                ids = np.array(own.encode("".join(texts)), "<u4").tobytes()
                yield (uid, piece, ids), len(ids)

        yield from rows_to(batches, [pa.int64(), pa.int32(), pa.binary()], ["uid", "piece", "ids"], found)

    def digests(batches: Iterator) -> Iterator:
        from itertools import groupby

        import numpy as np

        own = coder(shared.value, pattern)

        def found(batches: Iterator) -> Iterator:
            every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            for uid, parts in groupby(every, key=lambda r: r[0]):
                n, of_ids, plain, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for _, _, packed in parts:
                    ids = np.frombuffer(packed, "<u4")
                    n += len(ids)
                    of_ids.update(packed)
                    plain.update(own.decode(ids.tolist()))
                    if with_ids:
                        kept.append(ids.astype("i4"))
                yield (uid, n, of_ids.hexdigest(), plain.hexdigest(), np.concatenate(kept) if kept else None), 4 * n * with_ids

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        yield from rows_to(batches, kinds[: 4 + with_ids], ["uid", *names[1:]], lambda b: ((r[: 4 + with_ids], size) for r, size in found(b)))

    long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    base = scratch(spark, "chunks")
    numbered = rows.where(long).select(F.monotonically_increasing_id().alias("uid"), "id", "text")
    cuts = cut_at(numbered.mapInArrow(chunks, f"uid long, id {id_kind}, k int, last boolean, text string"), base + "/texts")
    in_order = lambda df, *keys: df.repartition(*keys[:-1]).sortWithinPartitions(*keys)
    marks = cuts.select("uid", "k", "last", "text").mapInArrow(bounds, "uid long, k int, head array<int>, tail array<int>, settled int")
    places = in_order(marks, "uid", "k").mapInArrow(stitch, "uid long, k int, piece int, begin int, end int, alone boolean")
    places = cut_at(places, base + "/places")
    sent = lambda alone: cuts.join(places.where(F.col("alone") == alone), ["uid", "k"]).select("uid", "piece", "begin", "end", "text", "k")
    kind = "uid long, piece int, ids binary"
    coded = sent(True).mapInArrow(pieces, kind).unionByName(in_order(sent(False), "uid", "piece", "k").mapInArrow(pieces, kind))  # most pieces are one chunk
    of_long = in_order(coded, "uid", "piece").mapInArrow(digests, result.replace(f"id {id_kind}", "uid long", 1))
    ids = cuts.where("k = 0").select("uid", "id")
    done = cut_at(of_long.join(ids, "uid").select(names), base + "-done")
    removed(spark, base)
    return rows.where(~long).mapInArrow(short, result).unionByName(done).withColumnRenamed("id", id_col)
