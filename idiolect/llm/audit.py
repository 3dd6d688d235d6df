"""Interaction audit of five filters: what each removes in every order of them.

A document's failing filters are a mask of five bits. Four bits come from its text alone; the fifth, an exact copy of a text
with a smaller id, from a fingerprint-routed RDD. A map task keeps a chain of (text, least id) for each fingerprint
(xxhash64 of the UTF-8): of a text it has seen, the row with the larger id is a copy for certain and is told so at once; only
the least one goes on, so a text that fills the table is sent once by each task. When a task's chains hold HELD bytes they
are sent and begun anew. Rows are routed by fingerprint and sorted by (fingerprint, id); a reducer meets the least id of each
text first, keeps a collision chain of the full texts of one fingerprint, and marks all rows but the first of each text.

Masks, routed by id, meet the labels; then combineByKey makes a vector of counts (mask x all, good, toxic) for each part, map
side first, and the 120 orders are sums over its 96 numbers. No task holds more than HELD bytes, one fingerprint's distinct
texts or one part's vector.

Defined cases: null text counts as empty. A null id is no smaller than any and has none smaller, so such rows are never
copies; they have no labels. Of rows with the same id and text none is a copy of another. Repeated label rows count once. A
null part and an empty one are the same. An empty table gives no rows. Texts are read whole, however long. Further columns
are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
#: Bytes of text that a map task's chains may hold.
HELD = 32 << 20
#: Bytes of all texts for each route that fingerprints are dealt to, if the session has no more partitions anyway.
ROUTE = 64 << 20
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
SCHEMA = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_mask(raw: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = raw.split()  # bytes.split() knows exactly the six ASCII blanks
    points = len(raw) - len(raw.translate(None, _CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    failed = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * (len(raw) - points), len(raw) != len(raw.translate(None, _MARKS)))
    return sum(1 << i for i, f in enumerate(failed) if f)


def told(doc_id, part: str, mask: int, n: int) -> tuple:
    """A row whose mask is complete, routed by its id, or by a number where it has none."""
    return ((n if doc_id is None else hash(doc_id)) & 0x7FFFFFFF, 0), (doc_id, part, mask, None)


def routed(rows: Iterator) -> Iterator:
    """((route, order), (id, part, mask, text)): texts that may be copies by fingerprint, the rest with no text."""
    import xxhash

    chains: dict[int, list] = {}
    held = n = 0
    for doc_id, part, text in rows:
        raw, part, n = bytes(text or b""), part or "", n + 1
        if doc_id is None:
            yield told(None, part, own_mask(raw), n)
            continue
        fingerprint = xxhash.xxh64_intdigest(raw)
        for entry in chains.setdefault(fingerprint, []):
            if entry[0] == raw:
                _, least, its_part, mask, same = entry
                if doc_id < least:
                    entry[1], entry[2], entry[4] = doc_id, part, []
                    for p in (its_part, *same):
                        yield told(least, p, mask | COPY, n)
                elif doc_id == least:
                    same.append(part)
                else:
                    yield told(doc_id, part, mask | COPY, n)
                break
        else:
            chains[fingerprint].append([raw, doc_id, part, own_mask(raw), []])
            held += len(raw) + 200
        if held >= HELD:
            yield from sent(chains)
            chains, held = {}, 0
    yield from sent(chains)


def sent(chains: dict[int, list]) -> Iterator:
    for fingerprint, chain in chains.items():
        for raw, doc_id, part, mask, same in chain:
            for p in (part, *same):
                yield (fingerprint, doc_id), (doc_id, p, mask, raw)


def marked(rows: Iterator) -> Iterator:
    """(id, part, mask): rows sorted by (fingerprint, id), copies marked."""
    now, chain = None, {}
    for (fingerprint, _), (doc_id, part, mask, raw) in rows:
        if raw is None:
            yield doc_id, part, mask
            continue
        if fingerprint != now:
            now, chain = fingerprint, {}
        least = chain.setdefault(raw, doc_id)
        yield doc_id, part, mask | COPY if least < doc_id else mask


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> RDD:
    """(id, part, mask) of every row."""
    rows = docs.select(id_col, part_col, F.col(text_col).cast("binary")).rdd
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(-(-size // ROUTE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapPartitions(routed).repartitionAndSortWithinPartitions(n, lambda key: key[0], keyfunc=lambda key: key).mapPartitions(marked)


def flagged(rows: Iterator) -> Iterator:
    """(part, (mask, good, toxic)): rows sorted by id, an id's labels before its documents."""
    now, good, toxic = None, 0, 0
    for (doc_id, kind, _), value in rows:
        if kind == 0:
            if doc_id != now:
                now, good, toxic = doc_id, 0, 0
            good, toxic = good | value[0], toxic | value[1]
        elif kind == 1 and doc_id == now:
            yield value[0], (value[1], good, toxic)
        else:
            yield value[0], (value[1], 0, 0)


def labelled(found: RDD, labels: DataFrame, id_col: str = "doc_id") -> RDD:
    """(part, (mask, good, toxic)) of every row of masks()."""
    known = labels.where(F.col(id_col).isNotNull()).select(id_col, F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int"), F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int"))
    told_of = known.rdd.map(lambda r: ((r[0], 0, 0), (r[1], r[2])))
    n = max(found.getNumPartitions(), told_of.getNumPartitions())

    def keyed(rows: Iterator) -> Iterator:
        for k, (doc_id, part, mask) in enumerate(rows):  # a row without an id goes anywhere
            yield ((0, 2, k) if doc_id is None else (doc_id, 1, 0)), (part, mask)

    both = told_of.union(found.mapPartitions(keyed))
    return both.repartitionAndSortWithinPartitions(n, lambda key: hash(key[0]) & 0x7FFFFFFF if key[1] < 2 else key[2], keyfunc=lambda key: key).mapPartitions(flagged)


def added(vector: list[int], seen: tuple[int, int, int]) -> list[int]:
    mask, good, toxic = seen
    vector[mask] += 1
    vector[MASKS + mask] += good
    vector[2 * MASKS + mask] += toxic
    return vector


def interactions(part: str, vector: list[int]) -> Iterator[tuple]:
    """The 600 rows of a part: every order of the filters, every step."""
    everyone, good, toxic = vector[:MASKS], vector[MASKS : 2 * MASKS], vector[2 * MASKS :]
    bits = [1 << i for i in range(len(FILTERS))]
    total = lambda counts, keep: sum(n for m, n in enumerate(counts) if n and keep(m))
    orders = list(itertools.permutations(range(len(FILTERS))))
    # a document that fails s filters is removed by each of them in one of s orders
    shapley = [sum(n * len(orders) // m.bit_count() for m, n in enumerate(everyone) if m & b) for b in bits]
    for order in orders:
        before = 0
        for step, i in enumerate(order, 1):
            b = bits[i]
            here = lambda m: m & b and not m & before
            yield (
                part, "".join(FILTERS[k] for k in order), step, FILTERS[i], total(everyone, lambda m: not m & (before | b)), total(everyone, here),
                total(everyone, lambda m: m & b and m & before), everyone[b], total(good, here), total(toxic, here), shapley[i],
            )
            before |= b


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """SCHEMA's rows for every part of docs."""
    spark: SparkSession = docs.sparkSession
    seen = labelled(masks(docs, id_col, text_col, part_col), labels, id_col)
    vectors = seen.combineByKey(lambda x: added([0] * (3 * MASKS), x), added, lambda a, b: [x + y for x, y in zip(a, b)])
    return spark.createDataFrame(vectors.flatMap(lambda x: interactions(*x)), SCHEMA, verifySchema=False)


#: DuckDB SQL for audit() over documents and labels.
ORACLE = r"""
with t as (select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as x from documents),
least as (select x, min(doc_id) as first from t group by x),
w as (select t.*, regexp_extract_all(t.x, '[^\x20\x09-\x0D]+') as words, coalesce(first < doc_id, false) as e from t join least on t.x = least.x),
l as (select doc_id, max(coalesce((quality = 1)::integer, 0)) as good, max(coalesce((toxic = 1)::integer, 0)) as toxic from labels where doc_id is not null group by 1),
m as (select part, (len(words) < 50)::integer as a, (100 * len(list_distinct(words)) < 65 * len(words))::integer as b, (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::integer as c,
  regexp_matches(x, '[#$%&*|]')::integer as d, e::integer as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l on w.doc_id = l.doc_id),
v as (select part, [a, b, c, d, e] as f, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
i as (select unnest(range(1, 6)) as i),
o as (select p.i as p1, q.i as p2, s.i as p3, u.i as p4, z.i as p5 from i p, i q, i s, i u, i z where len(list_distinct([p.i, q.i, s.i, u.i, z.i])) = 5),
s as (select [p1, p2, p3, p4, p5] as o, i as step from o, i),
x as (select part, o, step, f, n, good, toxic, f[o[step]] = 1 as fails, list_sum(list_transform(o[1:step - 1], lambda k: f[k])) as before from v, s),
g as (select part, o, step, sum(n) filter (where not fails and coalesce(before, 0) = 0) as kept, sum(n) filter (where fails and coalesce(before, 0) = 0) as removed, sum(n) filter (where fails and before > 0) as redundant,
  sum(n) filter (where fails and list_sum(f) = 1) as unique_fails, sum(good) filter (where fails and coalesce(before, 0) = 0) as good_lost, sum(toxic) filter (where fails and coalesce(before, 0) = 0) as toxic_lost from x group by all),
h as (select part, o[step] as k, sum(coalesce(removed, 0)) as shapley from g group by all)
select g.part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k::integer, 1)), '') as filter_order, step::integer as step, substr('ABCDE', o[step]::integer, 1) as filter,
  coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
  coalesce(toxic_lost, 0)::bigint as toxic_lost, shapley::bigint as shapley from g join h on g.part = h.part and g.o[g.step] = h.k
"""
