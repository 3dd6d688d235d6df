"""Exact rolling medians and median absolute deviations over a time window of each series.

A window's values are kept in shards by value range. Counts by shard pick the shard that holds a rank, and the rank is answered
in that shard alone; the deviation is found by counting and bisecting: with K values nearest to the median, the run of K
values a[i..i+K-1] in order is the one where a[i] + a[i+K] first reaches the doubled median, so i is bisected, and only the
shards at the run's two ends are looked into.

A window of an hour lies in its own hour of the series and the one before. Of a (series, hour) with up to HOT clicks in
both, the shards are lists of one task. A hot one is spread over tasks:

* `bounds`: value bounds (shards of about SHARD clicks) and time bounds (blocks of about BLOCK) from quantile sketches; a
  value that fills several quantiles gets a shard of its own, of which only the count is needed.
* First round (`located`), a task a block: the shards report their counts at its start and their changes within it, by
  time; these give every window's count in every shard, hence the shards of the median's ranks, and, by bisection on the
  shards' least and greatest values, the places where the deviation's run can start.
* Second round (`answered`), a task a block: the values of those shards alone are fetched, and count-and-bisect goes on in them.

Everything is exact whatever HOT, SHARD and BLOCK are. A task holds a group of at most HOT clicks, or a block's times and
the values of the few shards that it asks for. Sizes are picked from one number, the largest group; the sketches have at most
GRID bounds, so above GRID x SHARD clicks of one series in two hours shards grow with it. No group's rows are routed by its
key alone before it is known to be small: the mark of hot groups is joined on a salted key.

Defined cases: a click with a null time counts for nothing; of rows with one id the earliest (then least series, then least
cents) is taken; rows with a null id count as one click. A null or NaN value has no cents. Null kinds are a series. Values
are below 10^15. An empty table gives no rows. Clicks at one time share a window. Further columns are not read, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from idiolect.llm.common import cut

WINDOW = 3_600_000_000
HOT, SHARD, BLOCK, GRID = 4_096, 512, 4_096, 1_024
#: Rows that a join on a salted key may bring together for one group and salt.
SALTED = 65_536
#: Cells of the table of windows and shards that are made at a time.
CELLS = 1 << 22
RESULT = "click_id {id}, kind string, n long, median2 long, mad4 long, far boolean"


# --- clicks, series and groups -----------------------------------------------------------------------------------


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970: of a time without a zone, as if it were UTC, whatever the session's zone."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        since = F.expr(f"cast({name} - timestamp_ntz'1970-01-01 00:00:00' as interval second)")
        return (since.cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(name)


def unique(clicks: DataFrame) -> DataFrame:
    """(click_id, series, us, hour, o, cents), a row a click; series is '' for a null kind; o: time within the hour."""
    series = F.coalesce(F.concat(F.lit("="), F.col("kind")), F.lit(""))
    cents = F.when(~F.isnan("value"), F.floor(F.col("value") * 100 + 0.5))
    rows = clicks.where("ts is not null").select("click_id", micros(clicks, "ts").alias("us"), series.alias("series"), cents.alias("cents"))
    from pyspark.sql import Window

    first = rows.withColumn("__place", F.row_number().over(Window.partitionBy("click_id").orderBy("us", "series", "cents"))).where("__place = 1")
    hour = F.floor(F.col("us") / F.lit(WINDOW).cast("decimal(20,0)")).cast("long")
    return first.select("click_id", "series", "us", "cents", hour.alias("hour")).select("click_id", "series", "hour", (F.col("us") - F.col("hour") * WINDOW).alias("o"), "cents")


def crowded(rows: DataFrame, hot: int) -> DataFrame:
    """(series, hour, m) of the hours that, with the one before, have more than `hot` clicks."""
    counted = rows.groupBy("series", "hour").agg(F.count(F.lit(1)).alias("m"))
    both = counted.select("series", F.explode(F.array(F.col("hour"), F.col("hour") + 1)).alias("hour"), "m")
    return both.groupBy("series", "hour").agg(F.sum("m").alias("m")).where(F.col("m") > hot)


def salted(rows: DataFrame, few: DataFrame, salts: int, how: str, *by: str) -> DataFrame:
    """rows joined with a row a group of `few`, on (series, hour): a group's rows go to `salts` places."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["series", "hour", "salt"], how).drop("salt")


def marked(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """rows with own_hot and next_hot: whether their hour, and the next one, are hot."""
    flags = hot.select("series", "hour", F.lit(1).alias("own"), F.lit(0).alias("next")).unionByName(hot.select("series", F.col("hour") - 1, F.lit(0), F.lit(1)).toDF("series", "hour", "own", "next"))
    flags = flags.groupBy("series", "hour").agg(F.max("own").alias("own"), F.max("next").alias("next"))
    both = salted(rows, flags, salts, "left", "click_id")
    return both.withColumns({"own_hot": F.coalesce(F.col("own") == 1, F.lit(False)), "next_hot": F.coalesce(F.col("next") == 1, F.lit(False))}).drop("own", "next")


def members(rows: DataFrame, hot: bool) -> DataFrame:
    """rows as what they are to a group: of their own hour (before = 0) and, if they have cents, of the next (before = 1)."""
    own = F.when(F.col("own_hot") == hot, F.struct(F.col("hour").alias("of"), F.lit(0).alias("before")))
    after = F.when((F.col("next_hot") == hot) & F.col("cents").isNotNull(), F.struct((F.col("hour") + 1).alias("of"), F.lit(1).alias("before")))
    return rows.select("series", F.inline(F.array_compact(F.array(own, after))), "o", "cents", "click_id").withColumnRenamed("of", "hour")


# --- windows in memory -------------------------------------------------------------------------------------------


def run_start(at: Callable[[int], int], m: int, k: int, low: int, high: int) -> int:
    """The least i in low..high with at(i) + at(i + k) >= m, or high if there is none below it."""
    while low < high:
        mid = (low + high) // 2
        if at(mid) + at(mid + k) >= m:
            high = mid
        else:
            low = mid + 1
    return low


def nearby(at: Callable[[int], int], m: int, k: int, most: int, guess: int) -> int:
    """run_start() over 0..most, sought from a guess outwards."""
    low, high, step = 0, most, 1
    i = min(guess, most)
    if i < most and at(i) + at(i + k) < m:
        low = i + 1
        while low + step < most and at(low + step) + at(low + step + k) < m:
            low, step = low + step + 1, step * 2
        high = min(most, low + step)
    else:
        high = i
        while high - step > 0 and at(high - step) + at(high - step + k) >= m:
            high, step = high - step, step * 2
        low = max(0, high - step)
    return run_start(at, m, k, low, high)


def deviation(at: Callable[[int], int], m: int, n: int, i: int) -> int:
    """The doubled median of |2c - m| over n values in order, where the run of the (n - 1) // 2 + 1 nearest starts at i."""
    k = (n - 1) // 2 + 1
    d = max(m - 2 * at(i), 2 * at(i + k - 1) - m)
    if n % 2:
        return 2 * d
    left = m - 2 * at(i - 1) if i else None
    right = 2 * at(i + k) - m if i + k < n else None
    return d + (right if left is None else left if right is None else min(left, right))


class Shards:
    """Sorted lists of values by value range; at(j) is the j-th in order: the counts pick the shard."""

    def __init__(self, values: list[int], size: int):
        self.highs = sorted(set(sorted(values)[size - 1 :: size]))
        self.lists: list[list[int]] = [[] for _ in range(len(self.highs) + 1)]
        self.starts = [0]

    def add(self, c: int) -> None:
        insort(self.lists[bisect_left(self.highs, c)], c)

    def drop(self, c: int) -> None:
        own = self.lists[bisect_left(self.highs, c)]
        del own[bisect_left(own, c)]

    def counted(self) -> int:
        """Takes the shards' counts; the number of values."""
        ends = list(accumulate(map(len, self.lists)))
        self.starts = [0, *ends[:-1]]
        return ends[-1]

    def at(self, j: int) -> int:
        k = bisect_right(self.starts, j) - 1
        return self.lists[k][j - self.starts[k]]


def far(c: int | None, m: int | None, d: int | None) -> bool | None:
    return None if c is None or m is None else 2 * abs(2 * c - m) > 3 * d


def swept(before: list[tuple[int, int]], own: list[tuple], size: int) -> Iterator[tuple]:
    """(click, n, median2, mad4, far) of a group's clicks. before: (o, cents) of the hour before; own: (o, cents or
    None, click), both in order."""
    window = Shards([c for _, c in before] + [c for _, c, _ in own if c is not None], size)
    for _, c in before:
        window.add(c)
    gone = guess = start = 0
    while start < len(own):
        o, end = own[start][0], start
        while gone < len(before) and before[gone][0] <= o:
            window.drop(before[gone][1])
            gone += 1
        while end < len(own) and own[end][0] == o:
            if own[end][1] is not None:
                window.add(own[end][1])
            end += 1
        n, m, d = window.counted(), None, None
        if n >= 2:
            k = (n - 1) // 2
            m = window.at(k) + window.at(n // 2)
            guess = nearby(window.at, m, k + 1, n - k - 1, guess)
            d = deviation(window.at, m, n, guess)
        for _, c, click in own[start:end]:
            yield click, n, m, d, far(c, m, d)
        start = end


def groups(batches: Iterator, n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of each run of rows with equal first n_keys columns, in rows that are sorted by them."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:n_keys]))
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start] != key:
                if held:
                    yield key, held
                key, held = keys[start], [[] for _ in columns[n_keys:]]
            for own, c in zip(held, columns[n_keys:]):
                own += c[start:end]
            start = end
    if held:
        yield key, held


def flushed(rows: Iterator[tuple], names: list[str], kinds: list, at: int = 20_000) -> Iterator:
    import pyarrow as pa

    done: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    for row in rows:
        done.append(row)
        if len(done) >= at:
            yield batch()
            done.clear()
    if done:
        yield batch()


def small_groups(rows: DataFrame, size: int) -> DataFrame:
    """RESULT of groups that are not hot. rows: members()."""
    kind = rows.schema["click_id"].dataType.simpleString()
    dealt = rows.select("series", "hour", "before", "o", "cents", "click_id").repartition("series", "hour").sortWithinPartitions("series", "hour", "before", "o")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids = None

        def peeked() -> Iterator:
            nonlocal ids
            for batch in batches:
                ids = batch.schema.field(5).type
                yield batch

        def results() -> Iterator[tuple]:
            for (series, _), (before, o, cents, clicks) in groups(peeked(), 2):
                n = before.index(1) if 1 in before else len(before)
                name = series[1:] if series else None
                for click, *found in swept(list(zip(o[n:], cents[n:])), list(zip(o[:n], cents[:n], clicks[:n])), size):
                    yield click, name, *found

        names = ["click_id", "kind", "n", "median2", "mad4", "far"]
        yield from flushed(results(), names, _Later(lambda: [ids, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]))

    return dealt.mapInArrow(run, RESULT.format(id=kind))


class _Later:
    """Types that are known once the first batch has come."""

    def __init__(self, make: Callable[[], list]):
        self.make = make

    def __iter__(self) -> Iterator:
        return iter(self.make())


# --- hot groups --------------------------------------------------------------------------------------------------


def position(bounds: Column, x: Column) -> Column:
    """How many of the sorted bounds are below x, by bisection."""
    zero = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        below = F.get(bounds, mid) < x
        moved = F.struct(F.when(below, mid + 1).otherwise(a["low"]).alias("low"), F.when(below, a["high"]).otherwise(mid).alias("high"))
        return F.when(a["low"] < a["high"], moved).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(GRID.bit_length() + 2)), zero, step, lambda a: a["low"])


def bounds(rows: DataFrame, shards: int, blocks: int) -> DataFrame:
    """(series, hour, highs, times): upper bounds of all shards and all blocks but the last."""
    accuracy = F.lit(20 * max(shards, blocks))
    grid = lambda n: F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(1.0))
    q = rows.groupBy("series", "hour").agg(F.percentile_approx("cents", grid(shards), accuracy).alias("q"), F.percentile_approx("o", grid(blocks), accuracy).alias("times"))
    twice = F.filter("q", lambda x, i: (i > 0) & (F.get("q", i - 1) == x))
    highs = F.array_sort(F.array_distinct(F.concat("q", F.transform(twice, lambda x: x - 1))))
    return q.select("series", "hour", F.coalesce(highs, F.array().cast("array<bigint>")).alias("highs"), F.array_sort(F.array_distinct("times")).alias("times"))


def located(batches: Iterator) -> Iterator:
    """First round. Rows of a block: (kind 0: shard, its count at the start, least and greatest value), (1: time, shard,
    change), (2: time of a window). Gives a row with the shards to fetch (o = -1), then for each window its number of
    values, the values below each of these shards, and the places between which the deviation's run starts."""
    import pyarrow as pa

    names = ["series", "hour", "block", "o", "n", "low", "high", "shards", "least", "most", "below"]
    ints = pa.list_(pa.int64())
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), ints, ints, ints, ints]

    def results() -> Iterator[tuple]:
        for key, (kind, o, shard, change, least, most) in groups(batches, 3):
            kind, o = np.array(kind), np.array([x or 0 for x in o], np.int64)
            shard, change = np.array([x or 0 for x in shard], np.int64), np.array([x or 0 for x in change], np.int64)
            is_shard = kind == 0
            numbers = shard[is_shard]
            lows, highs = (np.array([x or 0 for x in v], np.int64)[is_shard] for v in (least, most))
            start, place = change[is_shard], {s: i for i, s in enumerate(numbers.tolist())}
            times = o[kind == 2]
            e = kind == 1
            event_at, event_of, event_by = np.searchsorted(times, o[e], "left"), np.array([place[s] for s in shard[e].tolist()], np.int64), change[e]
            by_time = np.argsort(event_at, kind="stable")
            event_at, event_of, event_by = event_at[by_time], event_of[by_time], event_by[by_time]
            wanted = np.zeros(len(numbers) + 1, np.int64)
            size, parts = max(1, CELLS // max(1, len(numbers))), []
            for first in range(0, len(times), size):
                count = min(size, len(times) - first)
                a, b = np.searchsorted(event_at, [first, first + count])
                table = np.zeros((count, len(numbers)), np.int64)
                table[0] = start
                np.add.at(table, (event_at[a:b] - first, event_of[a:b]), event_by[a:b])
                np.cumsum(table, 0, out=table)
                start = table[-1].copy()
                parts.append(_searched(table, lows, highs, wanted))
            keep = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            yield *key, -1, None, None, None, numbers[keep].tolist(), lows[keep].tolist(), highs[keep].tolist(), None
            done = 0
            for n, low, high, ends in parts:
                below = np.concatenate([np.zeros((len(n), 1), np.int64), ends], 1)[:, keep]
                for i in range(len(n)):
                    yield *key, int(times[done + i]), int(n[i]), int(low[i]), int(high[i]), None, None, None, below[i].tolist()
                done += len(n)

    yield from flushed(results(), names, kinds, 2_000)


def _searched(table: np.ndarray, lows: np.ndarray, highs: np.ndarray, wanted: np.ndarray) -> tuple:
    """(n, low, high, running counts) of windows with `table` values in each shard; marks in `wanted`, by differences, the
    shards that answering them needs."""
    ends = np.cumsum(table, 1)
    rows, shards = ends.shape
    n = ends[:, -1]
    flat = (ends + (np.arange(rows) * (int(n.max(initial=0)) + 1))[:, None]).ravel()

    def of(j: np.ndarray) -> np.ndarray:
        """The shard of the j-th value of each window."""
        found = np.searchsorted(flat, j + np.arange(rows) * (int(n.max(initial=0)) + 1), "right")
        return np.minimum(found - np.arange(rows) * shards, shards - 1)

    enough = n >= 2
    k = np.where(enough, (n - 1) // 2, 0)
    last = np.maximum(n - 1, 0)
    s, t = of(k), of(np.minimum(n // 2, last))
    m_low, m_high, run = lows[s] + lows[t], highs[s] + highs[t], k + 1

    def least(holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(rows, np.int64), np.maximum(n - run, 0)
        while (low < high).any():
            mid = (low + high) // 2
            yes = holds(of(np.minimum(mid, last)), of(np.minimum(mid + run, last)))
            open_ = low < high
            high, low = np.where(open_ & yes, mid, high), np.where(open_ & ~yes, mid + 1, low)
        return low

    high = least(lambda a, b: lows[a] + lows[b] >= m_high)
    low = np.minimum(least(lambda a, b: highs[a] + highs[b] >= m_low), high)
    for first, end in ((k, n // 2), (low - 1, high), (low + run - 1, high + run)):
        a, b = of(np.clip(first, 0, last))[enough], of(np.clip(end, 0, last))[enough]
        np.add.at(wanted, a, 1)
        np.add.at(wanted, b + 1, -1)
    return n, low, high, ends


class Fetched:
    """The j-th value of a window, of which only some shards are at hand: (starts, lists); a shard of one value has a
    number in place of its list."""

    def __init__(self, least: list[int], most: list[int]):
        self.lists: list = [x if x == y else [] for x, y in zip(least, most)]
        self.below: list[int] = []

    def at(self, j: int) -> int:
        k = bisect_right(self.below, j) - 1
        own = self.lists[k]
        return own if isinstance(own, int) else own[j - self.below[k]]


def answered(batches: Iterator) -> Iterator:
    """Second round. Rows of a block: the first round's (kind 0 and 2), and the values of the shards that it asked for:
    (1: time, shard, value, times it counts, 0 active at the start to the end, 1 comes at o, 2 leaves at o)."""
    import pyarrow as pa

    names, kinds = ["series", "hour", "o", "n", "median2", "mad4"], [pa.string(), *[pa.int64()] * 5]

    def results() -> Iterator[tuple]:
        for (series, hour, _), columns in groups(batches, 3):
            rows = list(zip(*columns))
            head = rows[0]
            place = {s: i for i, s in enumerate(head[5])}
            window = Fetched(head[6], head[7])
            values = [r for r in rows if r[0] == 1]
            for r in values:
                if r[12] != 1:
                    window.lists[place[r[9]]] += [r[10]] * r[11]
            for own in window.lists:
                if not isinstance(own, int):
                    own.sort()
            changes, k = sorted((r[1], r[12], place[r[9]], r[10], r[11]) for r in values if r[12]), 0
            for r in rows:
                if r[0] != 2:
                    continue
                o, n, low, high = r[1], r[2], r[3], r[4]
                while k < len(changes) and changes[k][0] <= o:
                    _, comes, s, c, w = changes[k]
                    own = window.lists[s]
                    for _ in range(w):
                        if comes == 1:
                            insort(own, c)
                        else:
                            del own[bisect_left(own, c)]
                    k += 1
                window.below, m, d = r[8], None, None
                if n >= 2:
                    half = (n - 1) // 2
                    m = window.at(half) + window.at(n // 2)
                    d = deviation(window.at, m, n, run_start(window.at, m, half + 1, low, high))
                yield series, hour, o, n, m, d

    yield from flushed(results(), names, kinds)


def hot_groups(rows: DataFrame, most: int, shard: int, block: int) -> DataFrame:
    """(series, hour, o, n, median2, mad4) for each time of a click in a hot hour. rows: members(); most: clicks of the
    largest group."""
    blocks, shards = (min(GRID, -(-most // x)) for x in (block, shard))
    salts = -(-most // SALTED)
    told = rows.groupBy("series", "hour", "before", "o", "cents").agg(F.count(F.lit(1)).alias("w"))
    told = salted(told, bounds(rows, shards, blocks), salts, "inner", "o", "cents")
    shard_of, block_of = F.when(F.col("cents").isNotNull(), position(F.col("highs"), F.col("cents"))), position(F.col("times"), F.col("o"))
    told = cut(told.select("series", "hour", "before", "o", "cents", "w", shard_of.alias("shard"), block_of.alias("block"), (F.size("times") + 1).alias("blocks")), "rolling-hot")
    keys, valued = ["series", "hour", "block"], told.where("cents is not null")
    cells = valued.groupBy("series", "hour", "blocks", "shard", "block").agg(F.sum(F.when(F.col("before") == 0, F.col("w")).otherwise(0)).alias("come"), F.sum(F.when(F.col("before") == 1, F.col("w")).otherwise(0)).alias("leave"), F.min("cents").alias("least"), F.max("cents").alias("most"))
    of_shard = cells.groupBy("series", "hour", "blocks", "shard").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list(F.struct("block", "come", "leave")).alias("changes"))
    dealt = of_shard.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at_start = F.aggregate("changes", F.lit(0).cast("long"), lambda a, x: a + F.when(x["block"] < F.col("block"), x["come"]).otherwise(x["leave"]))
    long = lambda x: F.lit(x).cast("long")
    first = dealt.select(*keys, F.lit(0).alias("kind"), long(None).alias("o"), "shard", at_start.alias("change"), "least", "most")
    change = F.when(F.col("before") == 0, F.col("w")).otherwise(-F.col("w"))
    first = first.unionByName(valued.groupBy(*keys, "o", "shard").agg(F.sum(change).alias("change")).select(*keys, F.lit(1).alias("kind"), "o", "shard", "change", long(None).alias("least"), long(None).alias("most")))
    times = told.where("before = 0").select(*keys, "o").distinct()
    first = first.unionByName(times.select(*keys, F.lit(2).alias("kind"), "o", F.lit(None).cast("int").alias("shard"), long(None).alias("change"), long(None).alias("least"), long(None).alias("most")))
    first = first.select(*keys, "kind", "o", "shard", "change", "least", "most").repartition(*keys).sortWithinPartitions(*keys, "kind", "o", "shard")
    lists = ", ".join(f"{c} array<long>" for c in ("shards", "least", "most", "below"))
    found = cut(first.mapInArrow(located, f"series string, hour long, block int, o long, n long, low long, high long, {lists}"), "rolling-located")
    asked = found.where("o = -1").select("series", "hour", F.col("block").alias("of"), F.explode(F.arrays_zip("shards", "least", "most")).alias("s"))
    asked = asked.where("s.least < s.most").select("series", "hour", "of", F.col("s.shards").cast("int").alias("shard"))
    # a shard that many blocks ask for is joined by the blocks of its values, too
    wide = asked.join(told.select("series", "hour", "blocks").distinct(), ["series", "hour"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    held = valued.join(wide, ["series", "hour", "shard", "block"])
    active = F.when(F.col("before") == 0, F.col("block") <= F.col("of")).otherwise(F.col("block") >= F.col("of"))
    moves = F.when(F.col("block") != F.col("of"), 0).when(F.col("before") == 0, 1).otherwise(2)
    values = held.where(active).select("series", "hour", F.col("of").alias("block"), F.lit(1).alias("kind"), "o", F.col("shard").cast("long").alias("shard"), "cents", "w", moves.alias("moves"))
    second = found.withColumn("kind", F.when(F.col("o") == -1, 0).otherwise(2)).unionByName(values, allowMissingColumns=True)
    second = second.select(*keys, "kind", "o", "n", "low", "high", "shards", "least", "most", "below", "shard", "cents", "w", "moves").repartition(*keys).sortWithinPartitions(*keys, "kind", "o")
    return second.mapInArrow(answered, "series string, hour long, o long, n long, median2 long, mad4 long")


def medians(clicks: DataFrame, hot: int = HOT, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(click_id, kind, n, median2, mad4, far) of every click with a time. clicks: click_id, ts, kind, value."""
    rows = cut(unique(clicks), "rolling-clicks")
    hours = cut(crowded(rows, hot), "rolling-hours")
    most = hours.agg(F.max("m")).first()[0]
    if most is None:
        return small_groups(members(rows.withColumns({"own_hot": F.lit(False), "next_hot": F.lit(False)}), False), shard)
    both = marked(rows, hours, -(-most // SALTED))
    found = hot_groups(members(both, True), most, shard, block)
    of_click = both.where("own_hot").join(found, ["series", "hour", "o"])
    c, m, d = F.col("cents"), F.col("median2"), F.col("mad4")
    name = F.when(F.col("series") != "", F.substr("series", F.lit(2)))
    large = of_click.select("click_id", name.alias("kind"), "n", "median2", "mad4", (2 * F.abs(2 * c - m) > 3 * d).alias("far"))
    return small_groups(members(both, False), shard).unionByName(large)


#: DuckDB SQL for medians() over clicks.
ORACLE = """
with r as (select click_id, epoch_us(ts) as us, kind, case when isnan(value) then null else floor(100 * value + 0.5)::bigint end as c from clicks where ts is not null),
d as (select * from r qualify row_number() over (partition by click_id order by us, kind nulls first, c nulls first) = 1),
q as (select distinct kind, us from d),
w as (select q.kind, q.us, list(d.c order by d.c) filter (where d.c is not null) as v from q join d on q.kind is not distinct from d.kind and d.us > q.us - 3600000000 and d.us <= q.us group by all),
m as (select kind, us, coalesce(len(v), 0) as n, v, case when len(v) >= 2 then v[(len(v) + 1) // 2] + v[len(v) // 2 + 1] end as m2 from w),
a as (select *, list_sort(list_transform(v, lambda c: abs(2 * c - m2))) as e from m),
x as (select kind, us, n, m2, case when n >= 2 then e[(n + 1) // 2] + e[n // 2 + 1] end as d4 from a)
select d.click_id, d.kind, n::bigint as n, m2::bigint as median2, d4::bigint as mad4, 2 * abs(2 * c - m2) > 3 * d4 as far from d join x on d.kind is not distinct from x.kind and d.us = x.us
"""
