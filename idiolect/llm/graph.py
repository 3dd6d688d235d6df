"""Connected components by alternating large and small stars over a shuffled edge table.

No edge list, label or component reaches the driver: it sees a count and a checksum of each round. Every
round's edges are written to the shared folder, so a lost executor costs at most one round.

Few edges. Once at most EDGES are left after each partition has contracted its own, one task contracts them all: a number that
does not grow with the input, and fewer jobs than the rounds, whose plans and tasks the driver keeps.

Hubs. What a key's rows share is joined back to them, and one key may have a large part of all rows. Keys of more
than a HEAVY-th of the rows, at most HEAVY of them, are broadcast with their value; the rows of the others are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.llm.common import cut_at, removed, scratch

MOST_ROUNDS = 60
#: Keys that are broadcast at most, and rows that a key may have at least before it is.
HEAVY, LIGHT = 10_000, 64
#: Edges that one task contracts to the end; more take rounds.
EDGES = 50_000


def joined(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of table, one row a key. n: table's column with the rows of each key; total: of all.
    how: inner, or left to keep rows of keys that table has not."""
    limit = max(LIGHT, total // HEAVY)
    heavy = F.broadcast(table.where(F.col(n) > limit).drop(n))
    light = table.where(F.col(n) <= limit).drop(n)
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how))


def with_least(rows: DataFrame, key: str, value: str, to: str, total: int) -> DataFrame:
    """rows and the least value of their key's rows."""
    return joined(rows, rows.groupBy(key).agg(F.min(value).alias(to), F.count(F.lit(1)).alias("__n")), key, "__n", total)


class Forest:
    """Union-find over arbitrary longs, the smallest of a set as its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def contracted(edges: DataFrame) -> DataFrame:
    """Per partition, the edges (u, v) become stars around the smallest node that they reach there."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        pairs = [(x, forest.root(x)) for x in forest.up]
        pairs = [(x, r) for x, r in pairs if x != r]
        for i in range(0, len(pairs), 50_000):
            u, v = zip(*pairs[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs, in any direction, repeated or not; loops are ignored. Gives (node, root) of every
    node that has an edge to another, root the smallest node of its component. No edges give no rows."""
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    path = scratch(spark, "stars")
    e = cut_at(contracted(e), path)
    before = mark(e)
    for _ in range(MOST_ROUNDS):
        if before[0] <= EDGES:
            old, path = path, scratch(spark, "stars")
            e = cut_at(contracted(e.coalesce(1)), path)
            removed(spark, old)
            break
        n = 2 * before[0]
        both = with_least(e.union(e.select("v", "u").toDF("u", "v")), "u", "v", "m", n)
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large, "u", "v", "m", n)
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v")))
        old, path = path, scratch(spark, "stars")
        e = cut_at(linked.where("u <> v").distinct(), path)
        removed(spark, old)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
