"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters occurs in a document if some substring of it is within e = floor(m * rate) edits.
Each edit spoils at most q of the passage's m - q + 1 q-grams, so an occurrence shares at least
T = m - q + 1 - q * e of them, all within e diagonals of each other. q is the largest of SIZES that leaves T at LEAST
or more, so short passages, which have few q-grams to spare, get a smaller q and the same budget; every m from 8 on
has one with T of 1 or more at a tenth.
Diagonals are counted in bands of width 2 * span that overlap by half, span >= 2 * e + 1, so one band holds
all the q-grams of an occurrence. Bands with T distinct q-grams of the passage or more are kept and verified
by banded alignment, which gives the least number of edits. Only whole passages are found: a document that quotes
a part of a passage, so that more than e edits are missing from the rest, has no hit.

Both sides are lower-cased, and runs of blanks count as one space. Passages with a budget of no edits are sought
as they are. The passages are shared with every task in blocks of a checked size, one pass over the documents
for each block; hits are written before the next block is shared, so one block is held at a time, whatever the size of
the benchmark.

Defined cases: null or blank documents have no hits; null or blank passages hit nothing; repeated passages hit
under each of their ids; the result has one row per document row; an empty benchmark hits nothing and empty documents
give no rows. Documents of any length are looked through in overlapping segments. Further columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.llm.common import as_bytes, cut, free

RATE, LEAST = 0.1, 8
#: Lengths of q-grams, the largest that serves first.
SIZES = (8, 6, 5, 4, 3)
#: Characters of passages that are shared with the tasks at once.
BLOCK_CHARS = 2 << 20
#: Characters of a document that are looked through at once, beside an overlap as long as an occurrence can be.
SEGMENT = 1 << 17
KIND = "array<struct<item:bigint,edits:int,end:bigint>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int, rate: float = RATE) -> int:
    """Edits within which a passage of m characters is found."""
    return int(m * rate)


def size_for(m: int, e: int, sizes: tuple[int, ...] = SIZES, least: int = LEAST) -> int:
    """The largest q that leaves `least` shared q-grams, else the one that leaves most; 0 where none leaves any."""
    left = {q: m - q + 1 - q * e for q in sizes}
    good = [q for q in sizes if left[q] >= least]
    best = max(good) if good else max(sizes, key=lambda q: (left[q], q))
    return best if left[best] >= 1 else 0


def codes(text: str, q: int):
    """The low bytes of each q characters, packed: equal q-grams have equal codes."""
    import numpy as np

    low = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint8)
    n = len(low) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out |= padded[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def banded(passage: str, region: str, low: int, high: int, most: int) -> tuple[int, int]:
    """The least edits that turn passage into a substring of region along diagonals low..high (place in region
    less place in passage), and where the substring ends; most + 1 if they are over most."""
    import numpy as np

    a = np.frombuffer(passage.encode("utf-32-le", "replace"), "<u4")
    b = np.frombuffer(region.encode("utf-32-le", "replace"), "<u4")
    far = most + 1
    d = np.arange(low, high + 1)
    width = len(d)
    cost = np.where((d >= 0) & (d <= len(b)), 0, far)  # row 0: free start in the region
    steps = np.arange(width)
    for i in range(1, len(a) + 1):
        j = d + i
        ok = (j >= 1) & (j <= len(b))
        same = np.zeros(width, bool)
        same[ok] = b[j[ok] - 1] == a[i - 1]
        new = np.where(ok, cost + ~same, far)  # replace
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)  # a character of the passage is missing
        new = np.minimum.accumulate(new - steps) + steps  # characters of the region are too many
        new[(j < 0) | (j > len(b))] = far
        cost = np.minimum(new, far)
        if cost.min() >= far:
            return far, 0
    k = int(cost.argmin())
    return int(cost[k]), len(a) + int(d[k])


class Grams:
    """An index of the q-grams, of one q, of passages (number, text, edits)."""

    def __init__(self, rows: list[tuple[int, str, int]], q: int):
        import numpy as np

        self.q, self.rows = q, rows
        grams, owner, place = [], [], []
        for k, (_, t, _) in enumerate(rows):
            own = codes(t, q)
            grams.append(own)
            owner.append(np.full(len(own), k))
            place.append(np.arange(len(own)))
        grams, owner, place = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
        by = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[by], place[by]
        self.distinct, self.first, self.many = np.unique(grams[by], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.slot(self.distinct)] = True
        self.span = np.array([2 * e + 1 for _, _, e in rows], np.int64)
        self.need = np.array([len(t) - q + 1 - q * e for _, t, e in rows], np.int64)
        self.longest = max(len(t) for _, t, _ in rows) + 1

    @staticmethod
    def slot(grams):
        import numpy as np

        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def regions(self, text: str) -> list[tuple[int, int, int]]:
        """(passage, lowest diagonal, highest) of the bands with enough shared q-grams."""
        import numpy as np

        own = codes(text, self.q)
        if not len(own):
            return []
        at = np.flatnonzero(self.sieve[self.slot(own)])
        where = np.minimum(np.searchsorted(self.distinct, own[at]), len(self.distinct) - 1)
        good = self.distinct[where] == own[at]
        at, where = at[good], where[good]
        if len(at) < self.need.min():
            return []
        many = self.many[where]
        rows = np.repeat(self.first[where] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        k, j, i = self.owner[rows], self.place[rows], np.repeat(at, many)
        enough = np.bincount(k, minlength=len(self.rows)) >= self.need
        pick = enough[k]
        k, j, i = k[pick], j[pick], i[pick]
        if not len(k):
            return []
        diagonal = i - j
        band = diagonal // self.span[k]
        base = int(band.min()) - 1
        wide = int(band.max()) - base + 2
        keys = np.concatenate([k * wide + band - base, k * wide + band - base - 1])  # bands b and b - 1: [b * span, (b + 2) * span)
        longest = self.longest
        pairs = np.unique(keys * longest + np.concatenate([j, j]))  # distinct q-gram places of the passage
        bands, n = np.unique(pairs // longest, return_counts=True)
        owner = bands // wide
        found = n >= self.need[owner]
        return [(int(p), int(x) * int(self.span[p]), (int(x) + 2) * int(self.span[p]) - 1) for p, x in zip(owner[found], (bands % wide + base)[found])]


class Passages:
    """The passages of a block: q-gram indexes for those with edits to spare, the others as they are."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE, sizes: tuple[int, ...] = SIZES, least: int = LEAST):
        self.rows = [(i, normal(t)) for i, t in rows if t and t.split()]
        self.edits = [budget(len(t), rate) for _, t in self.rows]
        by_size: dict[int, list[tuple[int, str, int]]] = {}
        for k, ((_, t), e) in enumerate(zip(self.rows, self.edits)):
            by_size.setdefault(size_for(len(t), e, sizes, least) if e or len(t) >= max(sizes) else 0, []).append((k, t, e))
        self.plain = by_size.pop(0, [])
        if any(e for _, _, e in self.plain):
            raise ValueError(f"no q-gram length serves edits at a rate of {rate}")
        self.grams = [Grams(own, q) for q, own in sorted(by_size.items())]

    def hits(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(item id, edits, end in the normalised text), the best of each passage, ties to the first."""
        text = normal(raw.decode("utf-8", "replace"))
        best: dict[int, tuple[int, int]] = {}
        for k, t, _ in self.plain:
            at = text.find(t)
            if at >= 0:
                best[k] = (0, at + len(t))
        for index in self.grams:
            reach = index.longest + int(index.span.max())
            for at in range(0, max(1, len(text) - reach), SEGMENT):
                part = text[at : at + SEGMENT + reach]
                for place, low, high in index.regions(part):
                    k, passage, e = index.rows[place]
                    start = max(0, low - e)
                    region = part[start : max(0, high + len(passage) + e)]
                    edits, end = banded(passage, region, low - e - start, high + e - start, e)
                    if edits <= e:
                        best[k] = min(best.get(k, (edits, at + start + end)), (edits, at + start + end))
        return sorted((self.rows[k][0], *found) for k, found in best.items())


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of at most `most` characters (or of one passage), read one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col), F.col(text_col)).orderBy(id_col, text_col).toLocalIterator():
        if block and size + len(r[1] or "") > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1] or "")
    yield block


def searched(docs: DataFrame, text_col: str, to: str, block: list[tuple[int, str]], rate: float) -> DataFrame:
    """docs with the hits of one block, added to those in column `to`."""
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Passages(shared.value, rate)
        hit = pa.struct([("item", pa.int64()), ("edits", pa.int32()), ("end", pa.int64())])
        for batch in batches:
            found = [[dict(zip(("item", "edits", "end"), h)) for h in index.hits(raw)] for raw in as_bytes(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(hit))], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, docs.withColumn(to, F.array().cast(KIND)).schema)


def matches(docs: DataFrame, benchmark: DataFrame, to: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs' columns and `to`, an array of (item, edits, end), empty where the document has none."""
    found = blocks(benchmark, item_col, item_text, block_chars)
    first, more = next(found), next(found, None)
    if more is None:
        return searched(docs, text_col, to, first, rate)
    # The rows get a number that is written down, and each block's hits are written before the next one is shared.
    row = free(docs, "row")
    placed = cut(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    narrow, hits, block = placed.select(F.col(row), F.col(text_col)), None, first
    while block is not None:
        part = searched(narrow, text_col, free(narrow, "hits"), block, rate)
        part = part.where(F.size(part.columns[-1]) > 0).select(F.col(row), F.col(part.columns[-1]).alias(to))
        part = cut(part, "hits")
        hits = part if hits is None else hits.unionByName(part)
        block, more = more, next(found, None)
    of_row = hits.select(F.col(row), F.inline(to)).groupBy(row).agg(F.collect_list(F.struct("item", "edits", "end")).alias(to))
    return placed.join(of_row, row, "left").withColumn(to, F.coalesce(F.col(to), F.array().cast(KIND))).select(*docs.columns, to)


def flags(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: id, contaminated, n_items, items (ids, ascending), edits (of each)."""
    found = matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, "hits", rate=rate, block_chars=block_chars)
    hits = F.array_sort("hits")
    return found.select(F.col("id").alias(id_col), (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.transform(hits, lambda h: h["item"]).alias("items"), F.transform(hits, lambda h: h["edits"]).alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that no passage hits, all columns as they are."""
    hits = free(docs, "hits")
    return matches(docs, benchmark, hits, text_col, rate=rate, block_chars=block_chars).where(F.size(hits) == 0).select(docs.columns)
