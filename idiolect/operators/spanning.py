"""What a corpus has beyond the sum of its samples, without ever being one text or one task.

A corpus is a group's samples in order with a blank line between. Tokens, marks, sentences, paragraphs and lines never
cross a blank line, so their counts add up. What can cross is added here: neighbouring words and runs of words, phrases
and passives (edges of the samples, with counts of either sign), code between backticks (distinct in the corpus), and
lexical diversity.

Order comes from ranges. Samples are dealt out by range of (group, order), so a writer of any size is spread over many
ranges, and have a `chunk` (their range) and a `place`, which increases by one within it; neighbours meet within a range
first, and ranges meet through their summaries, a row a range and group. Samples that share their place in the order come by
their first characters, then by their digest: no text is a sort key. placed() deals texts out and writes them down, once
for all that needs their order; of rows that have no place yet `edges` deals only what is narrow.

Lexical diversity is a pass over all words that carries its state. It is run speculatively: every piece of words is scanned
from an empty state and keeps where the state is emptied again (a factor ends). A piece is then scanned again from the state
that its neighbour ends in, until both scans empty their state at the same word; from there on they agree. Pieces whose
neighbour turns out to end otherwise are scanned once more, until nothing changes (of a piece its first HEAD words are
written down and read; the others are sought in the texts again, where the scans do not meet there); by induction from the
first piece on, the result is that of one pass. Two rounds are usual: only words that hardly ever repeat, so that no factor ends within
PIECE words, take a round for each such piece, and their state is all of these words.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idiolect.functions import text as tx
from idiolect.functions.numbers import rounded
from idiolect.operators import metrics
from idiolect.operators.keys import joined
from idiolect.sources.scratch import cut, cut_at, removed, scratch

SEPARATOR = "\n\n"
#: Runs of non-blanks beside a boundary in which a crossing phrase or passive is looked for; the longest phrase has
#: six words. A passive is missed only where twelve runs in a row are all participles and auxiliaries, as "been".
RUNS = 12
#: Tokens beside a boundary: one less than those of the longest counted run of words.
GRAM = 3
#: Characters by which samples of one place in the order are sorted, before their digests.
LEAD = 64
#: Words of a piece of the diversity scan, and those at each of its ends in which two scans of it nearly always meet.
PIECE, HEAD = 131_072, 8_192
#: Texts, and words of pieces, that are lists at one time; words of pieces that a task has not ended.
TEXTS, WORDS, OPEN = 256, 200_000, 1_000_000


def first_runs(x: Column) -> Column:
    return F.regexp_extract(x, rf"(?U)^\s*(?:\S+\s+){{0,{RUNS - 1}}}\S+", 0)


def last_runs(x: Column) -> Column:
    return F.reverse(first_runs(F.reverse(x)))


def last_of(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), F.lit(n))


def digest() -> Column:
    return F.sha2("text", 256)


def before_blank_line() -> Column:
    """norm as it is before a blank line: a CR at its end makes one line end with it."""
    ends_in_cr = F.translate("text", "\ufeff", "").endswith("\r")
    return F.when(ends_in_cr, F.substr("norm", F.lit(1), F.length("norm") - 1)).otherwise(F.col("norm"))


def in_ranges(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows (keys, order, lead, digest and more), dealt out by range of them and sorted."""
    by = [*keys, order, "lead", "digest"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def numbered(dealt: DataFrame) -> DataFrame:
    return dealt.withColumns({"chunk": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).drop("lead")


def placed(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """rows (keys, order, text and more) in order, with digest, chunk and place; to be written down, as another run may deal
    them out in another way."""
    return numbered(in_ranges(rows.withColumns({"lead": F.substring("text", 1, LEAD), "digest": digest()}), keys, order))


# --- edges -------------------------------------------------------------------------------------------------------


def edges(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The samples' edges in order, written down: keys, order, digest, chunk (a range), place (increasing), first and last
    runs and tokens, and what backticks they have, with the text of those that have any. rows: keys, order, text, norm,
    tokens, and perhaps what placed() adds."""
    own = "place" in rows.columns
    runs = F.regexp_extract_all("norm", F.lit("`+"), F.lit(0))
    many = F.exists("ticks", lambda x: F.length(x) > 1)
    singles = F.aggregate("ticks", F.lit(0).cast("long"), lambda n, x: F.when(F.length(x) > 1, F.lit(0).cast("long")).otherwise(n + 1))
    narrow = rows.select(
        *keys, order, *(("digest", "chunk", "place") if own else (F.substring("text", 1, LEAD).alias("lead"), digest().alias("digest"))), first_runs(F.col("norm")).alias("head"), last_runs(F.col("norm")).alias("tail"),
        F.slice("tokens", 1, GRAM).alias("first"), last_of(F.col("tokens"), GRAM).alias("last"), runs.alias("ticks"), F.when(F.contains("norm", F.lit("`")), before_blank_line()).alias("ticked"),
    ).withColumns({"many": many, "singles": singles}).drop("ticks")
    return cut(narrow if own else numbered(in_ranges(narrow, keys, order)), "edges")


def carried(own: DataFrame, keys: list[str], value: str, reach: int) -> DataFrame:
    """own (keys, chunk, place, value) with `carry`: the values of the up to `reach` rows before each, from its own range
    and from summaries of those before it."""
    w = Window.partitionBy(*keys, "chunk").orderBy("place")
    near = own.withColumns({"near": F.collect_list(value).over(w.rowsBetween(-reach, -1)), "ends": F.lead(F.lit(1)).over(w).isNull()})
    summary = near.where("ends").select(*keys, "chunk", last_of(F.concat("near", F.array(value)), reach).alias("kept"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(-reach, -1)
    summary = summary.select(*keys, "chunk", last_of(F.flatten(F.collect_list("kept").over(before)), reach).alias("far"))
    both = joined(near.drop("ends"), summary, [*keys, "chunk"])
    return both.withColumn("carry", last_of(F.concat("far", "near"), reach)).drop("near", "far")


def signed(sign: int, x: Column, name: str) -> Column:
    return F.struct(F.lit(sign).cast("long").alias("sign"), x.alias(name))


def text_edges(of: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sign, norm): texts whose counts of phrases and passives, times sign, are those that cross samples. of: edges()."""
    own = carried(of.where("head <> ''").select(*keys, "chunk", "place", "head", "tail"), keys, "tail", RUNS)
    both = own.withColumn("carry", last_runs(F.array_join("carry", SEPARATOR))).where("carry <> ''")
    return both.select(*keys, F.inline(F.array(signed(1, F.concat("carry", F.lit(SEPARATOR), "head"), "norm"), signed(-1, F.col("carry"), "norm"), signed(-1, F.col("head"), "norm"))))


def token_edges(of: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sign, tokens): the same for runs of up to GRAM + 1 words. of: edges()."""
    own = carried(of.where(F.size("first") > 0).select(*keys, "chunk", "place", "first", "last"), keys, "last", GRAM)
    both = own.withColumn("carry", last_of(F.flatten("carry"), GRAM)).where(F.size("carry") > 0)
    return both.select(*keys, F.inline(F.array(signed(1, F.concat("carry", "first"), "tokens"), signed(-1, F.col("carry"), "tokens"), signed(-1, F.col("first"), "tokens"))))


# --- code between backticks --------------------------------------------------------------------------------------


def open_spans(of: DataFrame, keys: list[str], order: str) -> DataFrame:
    """edges() with where a code span is open: entered (at the sample's start), closes (open at its end and closed in a
    later one), at (the number of the span that its end is in).

    A backtick opens a span if another follows, but not at once: a single one opens or closes, and after several in a row
    a span is open. So a sample changes an unknown state or sets it, and so does a range of samples."""
    w = Window.partitionBy(*keys, "chunk").orderBy("place")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = of.select(*keys, order, "digest", "chunk", "place", "ticked", "many", "singles")
    r = r.withColumns({"at": F.sum(F.col("ticked").isNotNull().cast("long")).over(so_far), "turns": F.sum("singles").over(so_far), "ends": F.lead(F.lit(1)).over(w).isNull()})
    r = r.withColumn("base", F.last(F.when(F.col("many"), F.col("turns") - F.col("singles")), True).over(so_far))
    r = r.withColumns({"known": F.col("base").isNotNull(), "parity": (F.when(F.col("base").isNotNull(), 1 + F.col("turns") - F.col("base")).otherwise(F.col("turns"))) % 2})
    r = r.withColumns({"was_known": F.coalesce(F.lag("known").over(w), F.lit(False)), "was": F.coalesce(F.lag("parity").over(w), F.lit(0))})
    s = Window.partitionBy(*keys).orderBy("chunk")
    before = s.rowsBetween(Window.unboundedPreceding, -1)
    c = r.where("ends").select(*keys, "chunk", "at", "known", "parity").withColumn("turns", F.sum("parity").over(s.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    c = c.withColumn("base", F.when(F.col("known"), F.col("turns") - F.col("parity")))
    entering = (F.coalesce(F.sum("parity").over(before), F.lit(0)) - F.coalesce(F.last("base", True).over(before), F.lit(0))) % 2
    c = c.select(*keys, "chunk", entering.alias("entering"), F.coalesce(F.sum("at").over(before), F.lit(0)).alias("from"), F.sum("at").over(Window.partitionBy(*keys)).alias("ticked_samples"))
    r = joined(r, c, [*keys, "chunk"]).withColumn("at", F.col("at") + F.col("from"))
    state = lambda known, parity: F.when(F.col(known), F.col(parity)).otherwise((F.col("entering") + F.col(parity)) % 2) == 1
    closes = state("known", "parity") & (F.col("at") < F.col("ticked_samples"))
    return r.select(*keys, order, "digest", "place", "ticked", "at", state("was_known", "was").alias("entered"), closes.alias("closes"))


def code_terms(rows: DataFrame, of: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys, term): a corpus' distinct code shapes, lower-cased. rows: keys, order, text, norm; of: their edges().

    A span from one sample into another is put together from the pieces of those that it crosses. Texts without a backtick
    are looked at where they are; only those that lie wholly within a span, which are few, are looked up by their digest."""
    states = open_spans(of, keys, order)
    r = states.where("ticked is not null")
    first, tail = F.instr("ticked", "`"), F.substring_index("ticked", "`", -1)
    body = F.when(F.col("entered"), F.substr("ticked", first + 1)).otherwise(F.col("ticked"))
    main = F.when(F.col("closes"), F.substr(body, F.lit(1), F.greatest(F.length(body) - F.length(tail) - 1, F.lit(0)))).otherwise(body)
    piece = lambda keep, at, x: F.when(keep, F.struct(at.alias("at"), x.alias("piece")))
    pieces = F.array_compact(F.array(piece(F.col("entered"), F.col("at") - 1, F.substr("ticked", F.lit(1), first - 1)), piece(F.col("closes"), F.col("at"), tail)))
    inside = r.select(*keys, F.explode_outer(metrics.code_shapes(main)).alias("term"))
    pieces = r.select(*keys, "place", F.inline(pieces))
    texts = rows.where(~F.contains("norm", F.lit("`"))).select(*keys, order, F.col("digest") if "digest" in rows.columns else digest().alias("digest"), before_blank_line().alias("norm"))
    within = cut(states.where("ticked is null and entered and closes").select(*keys, order, "digest", "place", "at"), "within")
    if not within.isEmpty():
        ids = [*keys, order, "digest"]
        found = joined(within, joined(texts, within, ids, "left_semi").dropDuplicates(ids), ids)
        pieces = pieces.unionByName(found.select(*keys, "place", "at", F.col("norm").alias("piece")))
        texts = joined(texts, within, ids, "left_anti")
    plain = texts.select(*keys, F.explode_outer(metrics.code_shapes(F.col("norm"))).alias("term"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), SEPARATOR)
    spans = pieces.groupBy(*keys, "at").agg(F.lower(F.concat(F.lit("`"), whole, F.lit("`"))).alias("term"))
    return plain.unionByName(inside).where("term is not null").unionByName(spans.select(*keys, "term")).distinct()


# --- lexical diversity -------------------------------------------------------------------------------------------


def scanned(tokens: list[str], threshold: float, before: list[str], meets: frozenset[int] | set[int] = frozenset()) -> tuple[list[int], int]:
    """Where the state is emptied (after which token), from the state that `before` left, and up to the first of `meets`;
    and where that is, or -1."""
    seen, start, found = set(before), -len(before), []
    for i, token in enumerate(tokens):
        if token not in seen:
            seen.add(token)
            if threshold < 1:  # a new word lifts the ratio, so only a repeated one can end a factor
                continue
        if len(seen) / (i + 1 - start) <= threshold:
            found.append(i)
            if i in meets:
                return found, i
            seen, start = set(), i + 1
    return found, -1


def pieces(rows: DataFrame, keys: list[str], threshold: float, piece: int) -> DataFrame:
    """(keys, pos, at, last, end, words, and for each way resets, head, tail): the words of each group in order, in pieces: from
    which place and which of its words on, up to which place and how many of its words, and where a scan of the piece alone
    empties its state, forwards and backwards, the first HEAD words that way with blanks between (backwards null for a piece
    of no more), and those after the last such place. rows: place, groups (an array of keys), norm.

    Rows are read as they were written, in runs of a place after the other; where a run ends, all its pieces do. So
    a piece has all of a group from its first to its last place, whichever task reads which run."""
    from pyspark.sql import types as T

    n_keys, head_words, most_texts, most_words, most_open = len(keys), HEAD, TEXTS, WORDS, OPEN
    numbers = ("pos", "at", "last", "end", "words")
    kind = {k: T.ArrayType(t) for k, t in (("resets", T.IntegerType()), ("tail", T.StringType()), ("back", T.IntegerType()), ("back_tail", T.StringType()))}
    kind = {k: kind.get(k, T.StringType()) for k in ("resets", "head", "tail", "back", "back_head", "back_tail")}
    of_key = [rows.schema["groups"].dataType.elementType[k].dataType for k in keys]

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        word, kinds = re.compile(tx.WORD), []
        of_words = {"resets": pa.list_(pa.int32()), "back": pa.list_(pa.int32()), "tail": pa.list_(pa.string()), "back_tail": pa.list_(pa.string())}
        held, done, size, n_open, before = {}, [], 0, 0, None

        def close(key: tuple) -> None:
            nonlocal size, n_open
            words, *places = held.pop(key)
            row = [*key, *places, len(words)]
            for way in (words, words[::-1]):
                resets = scanned(way, threshold, [])[0]
                row += (resets, " ".join(way[:head_words]), way[resets[-1] + 1 :] if resets else way)
            if len(words) <= head_words:
                row[-2] = None
            done.append(row)
            size, n_open = size + 2 * min(len(words), head_words), n_open - len(words)

        def flushed():
            nonlocal size
            columns = list(zip(*done))
            done.clear()
            size = 0
            of_numbers = [pa.array(c, pa.int64()) for c in columns[n_keys : n_keys + len(numbers)]]
            of_lists = [pa.array(c, of_words.get(name, pa.string())) for name, c in zip(kind, columns[n_keys + len(numbers) :])]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns[:n_keys], kinds)), *of_numbers, *of_lists], names=[*keys, *numbers, *kind])

        for whole in batches:
            kinds = [whole.schema.field(1).type.value_type.field(i).type for i in range(n_keys)]
            for start in range(0, whole.num_rows, most_texts):
                batch = whole.slice(start, most_texts)
                for place, groups, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    if before is not None and place != before + 1 or n_open > most_open:
                        for key in list(held):
                            close(key)
                    before = place
                    text = t.as_py() or ""
                    tokens = word.findall(text.lower()) if text.isascii() else [x.lower() for x in word.findall(text)]
                    for group in groups:
                        key, at = tuple(group.values()), 0
                        while at < len(tokens):
                            own = held.setdefault(key, [[], place, at, place, at])
                            taken = tokens[at : at + piece - len(own[0])]
                            own[0] += taken
                            at, n_open = at + len(taken), n_open + len(taken)
                            own[3:] = place, at
                            if len(own[0]) == piece:
                                close(key)
                                if size > most_words:
                                    yield flushed()
                    if size > most_words or len(done) > 5_000:
                        yield flushed()
        for key in list(held):
            close(key)
        if done:
            yield flushed()

    fields = [*(T.StructField(k, t) for k, t in zip(keys, of_key)), *(T.StructField(k, T.LongType()) for k in numbers), *(T.StructField(k, v) for k, v in kind.items())]
    return rows.select("place", "groups", "norm").mapInArrow(run, T.StructType(fields))


def words_of(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """(number, tokens): all words of some pieces in order, from the texts. rows: place, groups, norm; some: number, and as in
    pieces() keys, pos, at, last and end. Between a piece's first and last place there are samples of other groups, too."""
    each = some.select("number", F.struct(*keys).alias("group"), "pos", "at", "last", "end", F.explode(F.sequence("pos", "last")).alias("place"))
    own = F.exists("groups", lambda g: g.eqNullSafe(F.col("group")))
    both = each.join(rows.select("place", "groups", "norm"), "place").where(own).withColumn("words", tx.tokens(F.col("norm")))
    start = F.when(F.col("place") == F.col("pos"), F.col("at")).otherwise(0).cast("int")
    stop = F.when(F.col("place") == F.col("last"), F.col("end")).otherwise(F.size("words")).cast("int")
    parts = both.select("number", "place", F.array_join(F.slice("words", start + 1, stop - start), " ").alias("part")).where("part <> ''")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"])
    return parts.groupBy("number").agg(F.split(F.array_join(in_order, " "), " ").alias("tokens"))


def resumed(runs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, way, pos, at, words, found, tail, whole): runs (.., words, tokens, resets, tail, enter) scanned from the state
    `enter`. tokens: the first words or all; not whole are those that would need more of them."""
    from pyspark.sql import types as T

    ids = [*keys, "way", "pos", "at"]
    place = len(ids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found, tails, whole = [], [], []
            for row in zip(*(batch.column(place + i) for i in range(5))):  # a row at a time as lists
                n, tokens, resets, alone, enter = (x.as_py() for x in row)
                hits, met = scanned(tokens, threshold, enter, set(resets))
                whole.append(met >= 0 or len(tokens) == n)
                found.append(len(hits) + (sum(1 for x in resets if x > met) if met >= 0 else 0))
                tails.append(alone if met >= 0 else [] if not whole[-1] else tokens[hits[-1] + 1 :] if hits else enter + tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns[: place + 1], pa.array(found, pa.int64()), pa.array(tails, pa.list_(pa.string())), pa.array(whole, pa.bool_())], names=[*ids, "words", "found", "tail", "whole"])

    fields = [*(runs.schema[c] for c in ids), T.StructField("words", T.LongType()), T.StructField("found", T.LongType()), T.StructField("tail", T.ArrayType(T.StringType())), T.StructField("whole", T.BooleanType())]
    return runs.select(*ids, "words", "tokens", "resets", "tail", "enter").mapInArrow(run, T.StructType(fields))


def diversity(rows: DataFrame, keys: list[str], order: str = "seq", threshold: float = metrics.MTLD_THRESHOLD, piece: int = PIECE, groups: Column | None = None) -> DataFrame:
    """(keys, vocabulary_diversity): metrics.mtld_of() of all words of a group. rows: keys, order, text, norm. groups: of rows
    that have a place already, the groups that each counts in, an array of keys; they are read once for all. No task has
    more of a group than pieces, or a range of its samples. A group without a word has no row."""
    folder = scratch(rows.sparkSession, "diversity")
    kept = lambda df, name: cut_at(df, f"{folder}/{name}")
    if groups is None:
        groups, rows = F.array(F.struct(*keys)), kept(placed(rows.select(*keys, order, "text", "norm"), keys, order), "texts")
    rows = rows.select("place", groups.alias("groups"), "norm")
    found = kept(pieces(rows, keys, threshold, piece), "pieces")
    ids = [*keys, "way", "pos", "at"]

    way = lambda k, sign, head, resets, tail: F.struct(F.lit(k).alias("way"), (sign * F.col("pos")).alias("pos"), (sign * F.col("at")).alias("at"), head.alias("start"), F.col(resets).alias("ends"), F.col(tail).alias("left"))
    ways = F.array(way(0, 1, F.col("head"), "resets", "tail"), way(1, -1, F.col("back_head"), "back", "back_tail"))
    runs = found.select(*keys, "last", "end", "words", F.inline(ways), F.col("head").alias("ahead")).withColumnsRenamed({"ends": "resets", "left": "tail"})
    started = F.split(F.coalesce("start", "ahead"), " ")
    started = F.when(F.col("start").isNull(), F.reverse(started)).otherwise(started)  # of a piece of no more words the other way
    state = kept(runs.select(*ids, "words", F.size("resets").cast("long").alias("found"), "tail", F.lit(True).alias("moved")), "states")
    w, turn = Window.partitionBy(*keys, "way").orderBy("pos", "at"), 0
    while True:
        turn += 1
        after = state.withColumns({"enter": F.lag("tail").over(w), "due": F.coalesce(F.lag("moved").over(w), F.lit(False))})
        due = kept(after.where("due").select(*ids, "enter"), f"due-{turn}")
        if due.isEmpty():
            break
        first = joined(runs.withColumn("ahead", F.when(F.col("start").isNull(), F.col("ahead"))), due, ids)
        again = kept(resumed(first.withColumn("tokens", started), keys, threshold), f"again-{turn}")
        late = again.where("not whole").select(*ids)
        if not late.isEmpty():
            some = joined(joined(runs.drop("start", "ahead"), due, ids), late, ids, "left_semi").withColumn("number", F.monotonically_increasing_id())
            some = kept(some, f"late-{turn}")
            tokens = words_of(rows, some.select("number", *keys, F.abs("pos").alias("pos"), F.abs("at").alias("at"), "last", "end"), keys)
            turned = F.when(F.col("way") == 1, F.reverse("tokens")).otherwise(F.col("tokens"))
            again = again.where("whole").unionByName(resumed(some.join(tokens, "number").withColumn("tokens", turned), keys, threshold))
        old = state.select(*ids, F.col("words").alias("w"), F.col("found").alias("f"), F.col("tail").alias("t"))
        new = again.drop("whole").withColumn("ran", F.lit(True))
        both_states = joined(old, new, ids, "left")
        ran = F.coalesce("ran", F.lit(False))
        state = kept(both_states.select(*ids, F.coalesce("words", "w").alias("words"), F.coalesce("found", "f").alias("found"), F.when(ran, F.col("tail")).otherwise(F.col("t")).alias("tail"), (ran & (F.col("tail") != F.col("t"))).alias("moved")), f"states-{turn}")
    n = F.size("tail")
    rest = F.when(n > 0, (1 - F.size(F.array_distinct("tail")) / n) / (1 - threshold)).otherwise(0.0)
    passes = state.groupBy(*keys, "way").agg(F.sum("words").alias("words"), F.sum("found").alias("found"), F.max_by("tail", F.struct("pos", "at")).alias("tail"))
    passes = passes.select(*keys, "words", (F.col("found") + rest).alias("factors"))
    passed = F.when(F.col("factors") > 0, F.col("words") / F.col("factors")).otherwise(F.col("words").cast("double"))
    each = passes.groupBy(*keys).agg(F.sum(passed).alias("sum"), F.max("words").alias("words"))
    told = cut(each.select(*keys, F.when(F.col("words") < 10, 0.0).otherwise(rounded(F.col("sum") / 2, 2)).alias("vocabulary_diversity")), "diverse")
    removed(rows.sparkSession, folder)
    return told
