"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints: 64 bits, each set if over half of the shingles' XXH64 have it. Equal fingerprints become one
node. Two nodes link at `most` or fewer differing bits.

Candidates: the 64 bits are grouped into m parts, correlated bits together, and part p gets a threshold t_p of
-1 (unused) or more with sum(t_p) = most - m + 1. Two fingerprints that differ in at most `most` bits then
differ in at most t_p bits of some part p: otherwise they would differ in at least sum(t_p + 1) = most + 1.
m and the thresholds come from a dynamic program over the estimated cost: rows probed, n times the keys
within t_p of a key, and candidate pairs, n * (n - 1) / 2 times the chance that a part differs in at most t_p
bits. That chance comes from how often all fingerprints have each bit and each two neighbouring bits of the part: a
chain, so that correlated bits count as such.

Probing: each node sends its key of a part, and with t_p > 0 every key within t_p of it. Nodes with equal
keys meet in a task, sorted, and are compared with each other; buckets beyond TILE rows are first dealt into
tiles, every pair of tiles in a task of its own, so that no task holds a bucket of unbounded size. A task
returns links as a spanning forest, at most one row a node, never all pairs.

Defined cases: null or blank text has the zero fingerprint and links like any other; a null id keeps its row
and never is the smallest id (a component of null ids alone has a null component_id); repeated ids are rows;
an empty table gives no rows. A very long text costs 8 bytes a shingle while its fingerprint is made. Keys that a large
part of all rows share, a fingerprint or a component, are not shuffled (see graph.joined).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.llm.common import as_bytes, cut, free
from idiolect.llm.graph import Forest, components, joined, with_least

BITS, SHINGLE, SEED, MOST = 64, 3, 42, 3
#: Rows of a bucket that a task compares at once; larger buckets are dealt out in pairs of tiles.
TILE = 1_024


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import numpy as np
    import xxhash

    words = raw.lower().split()  # of bytes: lower() knows A-Z alone, split() the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1 :]) if len(words) >= shingle else [(0, len(joined))]
    h = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
    counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, also, fp) per row, fp as a signed long."""
    kept = [id_col, *also]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(raw) for raw in as_bytes(batch.column(len(kept)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fps)], names=[*kept, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, text_col).mapInArrow(run, f"{kinds}, fp long")


def bit_counts(nodes: DataFrame):
    """How many fingerprints there are, and how many have bits i and j both, for all i and j: 64 rows reach the driver."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()), *(pa.array(total[:, j].astype(np.int64)) for j in range(BITS))], names=["i", "n", *(f"b{j}" for j in range(BITS))])

    columns = [f"b{j}" for j in range(BITS)]
    rows = nodes.select("fp").mapInArrow(run, "i int, n long, " + ", ".join(f"{c} long" for c in columns)).groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"]] = [r[c] for c in columns]
    return (rows[0]["n"] if rows else 0), both


def grouped(n: int, both, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size; a group takes next the free bit most correlated with it."""
    import numpy as np

    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        group = [max(free, key=lambda b: (corr[b][free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: (corr[b][group].sum(), -b)))
            free.remove(group[-1])
        groups.append(group)
    return groups


def within(n: int, both, group: list[int], most: int) -> list[float]:
    """The chances that two fingerprints differ in at most 0, 1 .. most bits of a group, from how often they have each
    bit and each two neighbouring bits of it: whether they agree in a bit depends on whether they do in the one before."""
    chance: dict[tuple[bool, int], float] = {}
    for k, j in enumerate(group):
        q = both[j][j] / max(1, n)
        if k == 0:
            chance = {(True, 0): q * q + (1 - q) * (1 - q), (False, 1): 2 * q * (1 - q)}
            continue
        i = group[k - 1]
        p, p11 = both[i][i] / max(1, n), both[i][j] / max(1, n)
        p10, p01 = max(0.0, p - p11), max(0.0, q - p11)
        p00 = max(0.0, 1 - p11 - p10 - p01)
        same = {True: p11**2 + p10**2 + p01**2 + p00**2, False: 2 * (p11 * p01 + p10 * p00)}  # agree in j, and in i or not
        other = {True: 2 * (p11 * p10 + p01 * p00), False: 2 * (p11 * p00 + p10 * p01)}
        new: dict[tuple[bool, int], float] = {}
        for (agreed, d), c in chance.items():
            total = same[agreed] + other[agreed]
            for now, share in ((True, same[agreed]), (False, other[agreed])):
                at = (now, d + (not now))
                if at[1] <= most:
                    new[at] = new.get(at, 0.0) + c * (share / total if total else float(now))
        chance = new
    return [sum(c for (_, d), c in chance.items() if d <= t) for t in range(most + 1)]


def thresholds(n: int, both, groups: list[list[int]], most: int, probe: float = 8.0, pair: float = 0.05) -> tuple[float, list[int]]:
    """The cheapest thresholds of the groups that add up to most - len(groups) + 1, and their cost.
    probe, pair: relative costs of shuffling a key and of comparing a candidate pair."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        near, options = within(n, both, group, most), [(-1, 0.0)]
        for t in range(most + 1):
            keys = sum(math.comb(len(group), k) for k in range(t + 1))
            options.append((t, probe * n * keys + pair * n * max(0, n - 1) / 2 * near[t]))
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, more in options:
                if total + t not in new or cost + more < new[total + t][0]:
                    new[total + t] = (cost + more, [*chosen, t])
        best = new
    return best[most - len(groups) + 1]


def allocate(n: int, both, most: int = MOST) -> list[tuple[list[int], int]]:
    """The parts in use, each with its bits and threshold."""
    found = []
    for m in range(2, most + 4):
        groups = grouped(n, both, m)
        cost, chosen = thresholds(n, both, groups, most)
        found.append((cost, m, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def key_of(fp, bits: list[int]):
    return sum((F.shiftright(fp, b).bitwiseAND(F.lit(1)) * F.lit(1 << i) for i, b in enumerate(bits)), F.lit(0).cast("long"))


def probes(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, fp, exact): the keys of every node, and those within the part's threshold of it."""
    def keys(p: int, bits: list[int], t: int):
        flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(len(bits)), k)]
        own = key_of(F.col("fp"), bits)
        return F.transform(F.array(*map(F.lit, flips)).cast("array<long>"), lambda f: F.struct(F.lit(p).alias("part"), own.bitwiseXOR(f).alias("key"), (f == 0).alias("exact")))

    each = [keys(p, bits, t) for p, (bits, t) in enumerate(parts)]
    return nodes.select("fp", F.inline(F.concat(*each))).select("part", "key", "fp", "exact")


def tiled(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Buckets of over `tile` rows are dealt into g groups by a hash of fp, and each pair of groups gets a tile (a, b)."""
    big = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("part", "key", F.ceil(F.col("n") / tile).cast("int").alias("g"))
    found = rows.join(big, ["part", "key"], "left")
    h = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")).cast("int")
    dealt = F.when(F.col("g").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least(h, j).alias("a"), F.greatest(h, j).alias("b")))
    )
    return found.select("part", "key", "fp", "exact", F.inline(dealt)).toDF("part", "key", "fp", "exact", "a", "b")


def links(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (u, v) that span, bucket by bucket, what is linked within the bucket."""
    ordered = rows.repartition("part", "key", "a", "b").sortWithinPartitions("part", "key", "a", "b", "fp")

    def compared(bucket, fps, exact, forest: Forest) -> list[tuple[int, int]]:
        import numpy as np

        n, out = len(fps), []
        label, lag, at = fps.copy(), 0, np.arange(n)
        while True:
            lag += 1
            at = at[at + lag < n]
            at = at[bucket[at] == bucket[at + lag]]
            if not len(at):
                return out
            i = at[(label[at] != label[at + lag]) & (exact[at] | exact[at + lag])]
            i = i[np.bitwise_count(fps[i].view(np.uint64) ^ fps[i + lag].view(np.uint64)) <= most]
            new = [(a, b) for a, b in zip(fps[i].tolist(), fps[i + lag].tolist()) if forest.join(a, b)]
            if new:
                out += new
                distinct, back = np.unique(label, return_inverse=True)
                label = np.array([forest.root(x) for x in distinct.tolist()], np.int64)[back]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kept: list = []
        forest = Forest()

        def done(part: list) -> Iterator:
            nonlocal forest
            same = (np.diff(part[0]) == 0) & (np.diff(part[1]) == 0) & (np.diff(part[4]) == 0) & (np.diff(part[5]) == 0)
            bucket = np.concatenate([[0], np.cumsum(~same)])
            found = compared(bucket, part[2], part[3], forest)
            if len(forest.up) > 500_000:
                forest = Forest()  # it only saves repeated links
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = [np.concatenate([a, b]) for a, b in zip(kept, new)] if kept else new
            last = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1]) & (kept[4] == kept[4][-1]) & (kept[5] == kept[5][-1])
            k = int(np.argmax(last))
            if k:
                yield from done([c[:k] for c in kept])
                kept = [c[k:] for c in kept]
        if kept:
            yield from done(kept)

    return ordered.mapInArrow(run, "u long, v long")


def grouped_rows(docs: DataFrame, most: int, tile: int, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int, int]:
    """Of docs (id, also, text) the rows' fingerprints (id, also, fp), and of each fingerprint (fp, low, n, root): its
    smallest id, how many rows have it, and the component that links reach; and the numbers of both."""
    prints = cut(fingerprints(docs, "id", "text", also), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    n, both = bit_counts(nodes)
    parts = allocate(n, both, most)
    roots = components(links(tiled(probes(nodes, parts), tile), most))
    lows = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    return prints, cut(lows, "roots"), prints.count(), n


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, tile: int = TILE) -> DataFrame:
    """Per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    prints, lows, n_rows, n_nodes = grouped_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), most, tile)
    reps = with_least(lows, "root", "low", "component_id", n_nodes).select("fp", "n", "component_id")
    found = joined(prints, reps, "fp", "n", n_rows)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, tile: int = TILE) -> DataFrame:
    """One row of docs for each component, all columns as they are: that of the smallest id, of equal or null ids the
    first in the scan, so docs must give the same rows in the same order when read again."""
    row = free(docs, "row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    narrow = placed.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    prints, lows, _, _ = grouped_rows(narrow, most, tile, ("row",))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    of_print = prints.groupBy("fp").agg(first.alias("first"))
    chosen = of_print.join(lows.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return placed.join(chosen, row, "left_semi").select(docs.columns)
