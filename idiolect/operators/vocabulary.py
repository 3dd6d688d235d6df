"""Word and phrase lists of a group of texts (a text, a writer): one token shuffle with map-side counts, then ranks.

Groups are keyed by `keys`; each input row is one text of a group, and a group's rows are counted together. With
`order`, the rows are samples of a corpus in that order (they need `text`, too), and what spans them is counted as well;
without, they are texts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx
from idiolect.operators import counting, metrics, spanning
from idiolect.operators.keys import joined
from idiolect.sources.scratch import cut

LIMIT, AVOID_WORDS, AVOID_FROM, AVOID_SINGLE, PREFER_PHRASES = 12, 200, 2, 8, 6
PHRASE_LIMIT, PHRASE_MIN = 10, 2
FIRST_PHRASES = 1_000


def frequencies(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, n). Arrays are exploded with a null for an empty one, here and below: before a plain explode() Spark
    puts a filter on the array's size, which makes the array a second time."""
    return measured.select(*keys, F.explode_outer("tokens").alias("token")).where("token is not null").groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def content(token: Column, words: lex.Lexicons = lex.DEFAULT) -> Column:
    return ~tx.one_of(token, words.stopwords) & (F.length(token) > 2)


def distinctive(token: Column, words: lex.Lexicons = lex.DEFAULT) -> Column:
    return ~(tx.one_of(token, lex.NUMBER_WORDS + lex.VAGUE_WORDS + words.contractions) | token.contains("'") | token.rlike("[0-9]"))


def style_word(token: Column, words: lex.Lexicons = lex.DEFAULT) -> Column:
    return tx.one_of(token, words.hedge_words + words.fillers + words.colloquialisms + words.intensifiers + words.humour_markers) & distinctive(token, words)


def word_lists(token: Column, n: Column, words: lex.Lexicons = lex.DEFAULT) -> dict[str, Column]:
    """Which lists a word with its count belongs to."""
    return {
        "common_words": content(token, words),
        "unusual_words": content(token, words) & (F.length(token) >= 8) & (n <= 2) & ~tx.one_of(token, words.technical_terms),
        "repeated_words": content(token, words) & (n >= 3),
        "technical_terms": tx.one_of(token, words.technical_terms),
        "colloquialisms": tx.one_of(token, words.colloquialisms),
        "filler_words": tx.one_of(token, words.fillers),
        "hedging_terms": tx.one_of(token, words.hedge_words),
        "buzzwords": tx.one_of(token, words.buzzwords),
        "formal_words": tx.one_of(token, words.formal_vocab),
        "style_words": style_word(token, words),
    }


LISTS = ("common_words", "unusual_words", "repeated_words", "technical_terms", "colloquialisms", "filler_words", "hedging_terms", "buzzwords", "formal_words", "style_words", "style_phrases")


def phrase_rows(measured: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, order: str | None = None, edges: DataFrame | None = None, code: DataFrame | None = None) -> DataFrame:
    """(keys, list, term, n) of the phrases and shapes that count towards a list."""
    by_list = ((("hedging_terms", "style_phrases"), words.hedge_phrases), (("colloquialisms", "style_phrases"), words.colloquial_phrases), (("buzzwords",), words.buzz_phrases))
    row = lambda name, x: F.struct(F.lit(name).alias("list"), x["term"].alias("term"), x["n"].alias("n"))
    # what is found once counts towards each of its lists
    listed = lambda names, phrases: F.flatten(F.transform(tx.phrases_found(F.col("lower"), phrases), lambda x: F.array(*(row(name, x) for name in names))))
    phrases = [listed(names, p) for names, p in by_list]
    shapes = F.transform(metrics.shape_hits(F.col("norm"), words, order is None), lambda x: F.struct(F.lit("technical_terms").alias("list"), x.alias("term"), F.lit(1).cast("long").alias("n")))
    in_java = F.when(counting.odd(F.col("lower")), F.concat(*phrases)).otherwise(F.array().cast("array<struct<list: string, term: string, n: bigint>>"))
    plain = measured.select(*keys, "norm", "lower", counting.phrases_listed(F.col("lower"), by_list).alias("__phrases"))
    rows = plain.select(*keys, F.inline_outer(F.concat("__phrases", in_java, shapes))).where("list is not null")
    if order is not None:
        edges = spanning.edges(measured, keys, order) if edges is None else edges
        crossing = spanning.text_edges(edges, keys).withColumn("lower", F.lower("norm"))
        rows = rows.unionByName(crossing.select(*keys, "sign", F.inline_outer(F.concat(*phrases))).where("list is not null").withColumn("n", F.col("n") * F.col("sign")).drop("sign"))
        code = spanning.code_terms(measured, edges, keys, order) if code is None else code
        rows = rows.unionByName(code.select(*keys, F.lit("technical_terms").alias("list"), "term", F.lit(1).cast("long").alias("n")))
    return rows.groupBy(*keys, "list", "term").agg(F.sum("n").alias("n")).where("n > 0")


def terms(measured: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, order: str | None = None, edges: DataFrame | None = None, code: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(keys, list, term, n): every list's terms with their counts, words and phrases together. counted: frequencies(), if
    they are there already."""
    counted = frequencies(measured, keys) if counted is None else counted
    lists = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in word_lists(F.col("token"), F.col("n"), words).items())))
    single = counted.select(*keys, F.explode(lists).alias("list"), F.col("token").alias("term"), "n")
    return single.unionByName(phrase_rows(measured, keys, words, order, edges, code)).groupBy(*keys, "list", "term").agg(F.sum("n").alias("n"))


def ranked(counted: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """The first `limit` of each list: most frequent first, ties by term."""
    w = Window.partitionBy(*keys, "list").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top_lists(counted: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """(keys, and an array for each list)."""
    each = [F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == k, F.struct("rank", "term")))), lambda x: x["term"]).alias(k) for k in LISTS]
    return ranked(counted, keys, limit).groupBy(*keys).agg(*each)


def prefer(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prefer): up to six phrases, then words, that are used twice or more, twelve in all."""
    rows = counted.where(F.col("list").isin("style_words", "style_phrases"))
    w = Window.partitionBy(*keys, "list").orderBy(F.desc("n"), "term")
    first = rows.withColumn("rank", F.row_number().over(w)).withColumn("kind", (F.col("list") == "style_words").cast("int"))
    kept = first.where((F.col("n") >= 2) & (F.col("rank") <= F.when(F.col("kind") == 0, PREFER_PHRASES).otherwise(LIMIT)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("kind", "rank", "term"))), lambda x: x["term"])
    return kept.groupBy(*keys).agg(F.slice(F.array_distinct(listed), 1, LIMIT).alias("prefer"))


def avoid(measured: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, counted: DataFrame | None = None) -> DataFrame:
    """(keys, avoid): formal words that a group of 200 words or more never uses, though it uses their plain ones
    where they have any, at most eight; then unused phrases, twelve in all. Such a phrase has plain blanks, so none
    spans two samples. counted: frequencies(), if they are there already."""
    plain = {c: p.split()[0] for c, p in words.formal_to_plain.items() if p}
    looked_for = list(dict.fromkeys([*words.avoid_candidates, *plain.values()]))
    held = F.array_compact(F.array(*(F.when(F.contains("lower", F.lit(p)), F.lit(f" {p}")) for p in words.avoid_phrases)))  # no token has a blank
    if counted is None:
        used = F.array_distinct(F.filter("tokens", lambda x: tx.one_of(x, looked_for)))
        rows = measured.select(*keys, F.size("tokens").cast("long").alias("__n"), used.alias("__used"), held.alias("__held"))
        marked, heard = rows.groupBy(*keys).agg(F.sum("__n").alias("__n")), F.concat("__used", "__held")
        found = rows.select(*keys, F.explode_outer(heard).alias("__term"))
    else:
        found = measured.select(*keys, F.explode_outer(held).alias("__term"))
        marked = found.select(*keys, F.lit(0).cast("long").alias("n")).distinct().unionByName(counted.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("__n"))
        found = found.unionByName(counted.where(tx.one_of(F.col("token"), looked_for)).select(*keys, F.col("token").alias("__term")))
    marked = joined(marked, found.distinct().groupBy(*keys).agg(F.collect_list("__term").alias("__terms")), keys)
    single = []
    for c in words.avoid_candidates:
        good = ~F.array_contains("__terms", c)
        single.append(F.when(good & F.array_contains("__terms", plain[c]) if c in plain else good, F.lit(c)))
    first = F.slice(F.array_compact(F.array(*single)), 1, AVOID_SINGLE)
    more = F.array_compact(F.array(*(F.when(~F.array_contains("__terms", f" {p}"), F.lit(p)) for p in words.avoid_phrases)))
    both = F.slice(F.concat(first, more), 1, LIMIT)
    return marked.select(*keys, F.when(F.col("__n") >= AVOID_WORDS, both).otherwise(F.array().cast("array<string>")).alias("avoid"))


def phrase_counts(measured: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, order: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(keys, phrase, n) of the two to four word runs that start with a seed word."""
    t = F.col("tokens")

    def runs(of: DataFrame) -> DataFrame:
        """of, a row for each of its runs instead of its tokens."""
        starts = F.filter(F.transform(t, lambda x, i: F.when(x.isin(*words.phrase_seeds), i + 1)), lambda i: i.isNotNull())
        grams = lambda size: F.transform(F.filter("__starts", lambda i: i <= F.size(t) - size + 1), lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))
        found = F.explode_outer(F.concat(grams(4), grams(3), grams(2))).alias("phrase")
        return of.withColumn("__starts", starts).select(*(c for c in of.columns if c != "tokens"), found).where("phrase is not null")

    if order is None:
        return runs(measured.select(*keys, "tokens")).groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("n"))
    edges = spanning.edges(measured, keys, order) if edges is None else edges
    rows = runs(measured.select(*keys, F.lit(1).cast("long").alias("sign"), "tokens")).unionByName(runs(spanning.token_edges(edges, keys).select(*keys, "sign", "tokens")))
    return rows.groupBy(*keys, "phrase").agg(F.sum("sign").alias("n")).where("n > 0")


def recurring_phrases(measured: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, order: str | None = None, first: int = FIRST_PHRASES, edges: DataFrame | None = None) -> DataFrame:
    """(keys, phrases): those found twice or more, most frequent first, without what a kept one contains, at most ten.
    They are sought in pages of a group's `first` next frequent ones, until ten are kept or none is left; ranks are cut off
    before rows are shuffled, so no task has more than a page of each of its inputs."""
    rows = phrase_counts(measured, keys, words, order, edges).where(F.col("n") >= PHRASE_MIN).select(*keys, (-F.col("n")).alias("n"), "phrase")
    listed = F.array_sort(F.collect_list(F.struct("n", "phrase")))
    none = F.array().cast("array<string>")

    def step(kept: Column, p: Column) -> Column:
        return F.when((F.size(kept) >= PHRASE_LIMIT) | F.exists(kept, lambda k: F.contains(k, p["phrase"])), kept).otherwise(F.concat(kept, F.array(p["phrase"])))

    def page(of: DataFrame) -> DataFrame:
        """of: keys, n, phrase, and what is kept already."""
        w = Window.partitionBy(*keys).orderBy("n", "phrase")
        top = of.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= first)
        read = top.groupBy(*keys).agg(F.first("kept").alias("kept"), listed.alias("page"))
        return read.select(*keys, F.aggregate("page", F.coalesce("kept", none), step).alias("phrases"), F.element_at("page", -1).alias("last"), (F.size("page") == first).alias("full"))

    found = cut(page(rows.withColumn("kept", none)), "phrases")
    open_ = (F.size("phrases") < PHRASE_LIMIT) & F.col("full")
    left = found.where(open_)
    if left.isEmpty():
        return found.select(*keys, "phrases")
    rows = cut(rows, "runs")
    while not left.isEmpty():
        more = joined(rows, left.select(*keys, F.col("phrases").alias("kept"), "last"), keys).where(F.struct("n", "phrase") > F.col("last")).drop("last")
        ended = joined(left, more.select(*keys).distinct(), keys, "left_anti").withColumn("full", F.lit(False))
        found = cut(found.where(~open_).unionByName(ended).unionByName(page(more)), "phrases")
        left = found.where(open_)
    return found.select(*keys, "phrases")
