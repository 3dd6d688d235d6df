"""Voice profiles: one nested row a writer, from their samples and answered word choices.

samples: writer, seq, context (a label or null), text. A writer's corpus is their samples in order with a blank line
between; a context's is its samples'. A corpus is never one row: its samples' counts are summed with map-side combine,
and what spans two samples is added (see corpus_metrics()), which gives what the analysis of the whole would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx
from idiolect.functions.numbers import rounded, rate, ratio
from idiolect.operators import metrics, schema, scoring, spanning, vocabulary
from idiolect.operators.features import FEATURES, analyse
from idiolect.operators.keys import joined
from idiolect.sources.scratch import cut

VERSION, GENERATOR = "1.0", "idiolect"
CONTEXT_WORDS = 200
# Fixed values.
PROFILE_MARKS = ("semicolon", "em_dash", "en_dash", "colon", "parentheses", "exclamation", "ellipsis", "hyphen", "comma", "question")
PARAGRAPH_BANDS = ((45.0, "short"), (90.0, "medium"))
STRUCTURE_BANDS = ((0.08, "low"), (0.30, "medium"))
DESCRIBES = "writing behaviour only, not personality"


def usable(samples: DataFrame) -> DataFrame:
    """Samples with something in them; labels normalised."""
    return samples.where(tx.strip(F.coalesce("text", F.lit(""))) != "").withColumn("context", tx.context_label(F.col("context")))


COUNTS = tuple(f"{k}_count" for k in (*metrics.PER_WORD, *metrics.PER_SENTENCE, *metrics.VOCABULARY))
MARKS = tuple(f"n_{m}" for m in metrics.MARKS)
TOTALS = ("contraction_chances", "word_count", "sentence_count", "paragraph_count", "heading_count", "bullet_count", "n_sentences")
#: What spanning.placed() adds.
PLACE = ("digest", "chunk", "place")
#: Sums that only averages and the spread read: of words' characters, of long words, of the squares of sentences' words.
SUMS = ("n_chars", "n_long", "n_squares")


def prepared(samples: DataFrame, words: lex.Lexicons = lex.DEFAULT) -> DataFrame:
    """samples in order (see spanning.placed()) with all that lists, scores and profiles read, analysed once and written down;
    of texts only the normalised one, where the other is the same, and no words, which are found again where they are read."""
    kept = [c for c in samples.columns if c != "text"]
    analysed = analyse(spanning.placed(tx.composed(samples), [c for c in kept if c not in ("seq", "context")]), words=words)
    norm, text = F.col("norm"), F.col("text")
    written = analysed.select(*kept, *PLACE, F.when(~text.eqNullSafe(norm), text).alias("text"), "norm", F.size(metrics.code_shapes(norm)).alias("code_count"), *COUNTS, *MARKS, *TOTALS, *SUMS, *FEATURES)
    return cut(written, "analysed").withColumns({"text": F.coalesce("text", "norm"), "tokens": tx.tokens(norm)})


def levels(more: tuple[str, ...] = ()) -> Column:
    """A sample's groups: its writer's (level 0, no context) and, if it is labelled, its context's (level 1)."""
    group = lambda level, context: F.struct(*more, F.lit(level).alias("level"), context.alias("context"))
    labelled = F.when(F.col("context").isNotNull(), group(1, F.col("context")))
    return F.array_compact(F.array(group(0, F.lit(None).cast("string")), labelled))


def grouped(analysed: DataFrame) -> DataFrame:
    """Each sample in each of its levels()."""
    return analysed.select("writer", F.inline(levels()), *(c for c in analysed.columns if c not in ("writer", "context")))


def crossing(analysed: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, edges: DataFrame | None = None, code: DataFrame | None = None, diverse: DataFrame | None = None) -> list[DataFrame]:
    """Counts of what spans samples, a row a group and frame: to be added to the sums over the samples."""
    rows = analysed.select(*keys, "seq", "text", "norm", "tokens", *PLACE)
    edges = spanning.edges(rows, keys) if edges is None else edges
    code = spanning.code_terms(rows, edges, keys) if code is None else code
    lower = F.col("lower")
    phrases = {"hedge": words.hedge_phrases, "buzzword": words.buzz_phrases, "colloquial": words.colloquial_phrases}
    counts = {"passive": F.regexp_count("norm", F.lit(metrics.PASSIVE)).cast("long")} | {k: metrics.phrases_in(lower, p) for k, p in phrases.items()}
    texts = spanning.text_edges(edges, keys).withColumn("lower", F.lower("norm"))
    pairs = spanning.token_edges(edges, keys)
    return [
        texts.groupBy(*keys).agg(*(F.sum(F.col("sign") * c).alias(f"{k}_count") for k, c in counts.items())),
        pairs.groupBy(*keys).agg(F.sum(F.col("sign") * metrics.contraction_chances(F.col("tokens"))).alias("contraction_chances")),
        code.groupBy(*keys).agg(F.count(F.lit(1)).alias("technical_count")),
        spanning.diversity(rows, keys, groups=F.array(F.struct(*keys))) if diverse is None else diverse,
    ]


def corpus_metrics(analysed: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, edges: DataFrame | None = None, code: DataFrame | None = None, diverse: DataFrame | None = None) -> DataFrame:
    """(keys, CORPUS): sums of the samples' counts, and what spans samples. analysed: prepared samples with keys and seq."""
    sums = [F.sum(c).alias(c) for c in (*COUNTS, *MARKS, *TOTALS)]
    sums += [
        F.count(F.lit(1)).alias("sample_count"), F.sum("word_count").alias("__s"), F.sum("n_squares").alias("__q"), F.sum("n_chars").alias("__chars"), F.sum("n_long").alias("__long"),
    ]
    s = analysed.withColumn("technical_count", F.col("technical_count") - F.col("code_count")).groupBy(*keys).agg(*sums)
    summed = [c for c in s.columns if c not in keys]
    for more in crossing(analysed, keys, words, edges, code, diverse):
        s = s.unionByName(more, allowMissingColumns=True)
    s = s.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in summed), F.coalesce(F.max("vocabulary_diversity"), F.lit(0.0)).alias("vocabulary_diversity"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    v = F.when(F.col("sentence_count") >= 2, (whole("sentence_count") * whole("__q") - whole("__s") * whole("__s")).cast("double") / (whole("sentence_count") * whole("sentence_count")).cast("double")).otherwise(0.0)
    n_words = F.col("word_count")
    s = s.withColumns({f"rate_{m}": rate(f"n_{m}", "word_count", 1000) for m in metrics.MARKS})
    made = {f"band_{m}": metrics.band(m, f"rate_{m}", f"n_{m}") for m in metrics.MARKS}
    made |= {f"{k}_rate": rate(f"{k}_count", "word_count", 100) for k in (*metrics.PER_WORD, *metrics.VOCABULARY)}
    made |= {f"{k}_rate": rate(f"{k}_count", "greatest(n_sentences, 1)", 100) for k in metrics.PER_SENTENCE}
    made |= {
        "avg_sentence_length": ratio(F.col("__s"), F.col("sentence_count")), "sentence_length_variance": rounded(v, 2), "avg_paragraph_length": ratio(n_words, F.col("paragraph_count")),
        "avg_word_length": ratio(F.col("__chars"), n_words), "long_word_rate": rate(F.col("__long"), n_words, 100),
        "contraction_preference": ratio(F.col("contraction_count"), F.col("contraction_count") + F.col("contraction_chances"), 3),
        "exclamation_rate": rounded(F.col("n_exclamation") * 100.0 / F.greatest(F.col("sentence_count"), F.lit(1)), 4),
        "comma_rate": rounded(F.col("rate_comma") / 10.0, 4), "semicolon_rate": F.col("rate_semicolon"), "parenthesis_rate": F.col("rate_parentheses"), "em_dash_rate": F.col("rate_em_dash"),
    }
    return s.withColumns(made).select(*keys, *CORPUS)


CORPUS = ("sample_count", "word_count", "sentence_count", "paragraph_count", "heading_count", "bullet_count", "contraction_preference", *(f"band_{m}" for m in metrics.MARKS), *FEATURES)


def scored(analysed: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT, edges: DataFrame | None = None, code: DataFrame | None = None, diverse: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus metrics, scoring results) of the groups of prepared samples: the one function for writers and for contexts."""
    corpus = cut(corpus_metrics(analysed, keys, words, edges, code, diverse), "corpus")  # a row a group, read by all that follows
    spread = scoring.sample_spread(analysed.select(*keys, "word_count", *FEATURES), keys)
    return corpus, cut(scoring.results(corpus.select(*keys, "word_count", *FEATURES), spread, keys), "results")


def score_groups(samples: DataFrame, keys: list[str], words: lex.Lexicons = lex.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """scored() of samples (keys, seq, text), with each dimension's sample values."""
    analysed = prepared(samples.select(*keys, "seq", "text"), words)
    corpus, results = scored(analysed, keys, words)
    values = scoring.sample_values(analysed.select(*keys, "seq", "word_count", *FEATURES), keys, ["seq"])
    return corpus, scoring.with_values(results, values, keys, ["seq"])


def style(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, style): an array of (dimension, value, confidence) in the dimensions' order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "dimension", "value", "confidence"))), lambda x: F.struct(x["dimension"].alias("dimension"), x["value"].alias("value"), x["confidence"].alias("confidence")))
    return results.groupBy(*keys).agg(rows.alias("style"))


def contexts_of(corpus: DataFrame, results: DataFrame) -> DataFrame:
    """(writer, context, style, sample_count, word_count) of the contexts with 200 words or more among scored groups."""
    keys = ["writer", "context"]
    enough = corpus.where(F.col("word_count") >= CONTEXT_WORDS).select(*keys, "sample_count", "word_count")
    return joined(enough, style(results, keys), keys)


def context_profiles(samples: DataFrame, words: lex.Lexicons = lex.DEFAULT) -> DataFrame:
    """contexts_of() samples (writer, seq, context, text)."""
    labelled = usable(samples).where("context is not null").select("writer", "context", "seq", "text")
    return contexts_of(*scored(prepared(labelled, words), ["writer", "context"], words))


def band(x: Column, bands: tuple[tuple[float, str], ...], top: str) -> Column:
    out = F.lit(top)
    for limit, name in reversed(bands):
        out = F.when(x <= limit, name).otherwise(out)
    return out


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """(writer, formal, avoids, since): each word's last answer, and when it last changed sides. verdicts: writer, seq,
    formal, plain, chosen; whoever chose neither avoids the formal word too."""
    w = Window.partitionBy("writer", "formal").orderBy("seq")
    rows = verdicts.where("formal is not null").withColumn("avoids", ~F.coalesce(F.col("chosen") == F.col("formal"), F.lit(False)))
    moved = rows.withColumn("moved", F.coalesce(F.lag("avoids").over(w) != F.col("avoids"), F.lit(True)))
    return moved.groupBy("writer", "formal").agg(F.max_by("avoids", "seq").alias("avoids"), F.max(F.when(F.col("moved"), F.col("seq"))).alias("since"))


def chosen_words(verdicts: DataFrame) -> DataFrame:
    """(writer, against, for): formal words in the order of their last change of sides."""
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("since", "formal")))), lambda x: x["formal"])
    return latest_verdicts(verdicts).groupBy("writer").agg(ordered(F.col("avoids")).alias("against"), ordered(~F.col("avoids")).alias("chosen_for"))


def merged_avoid(inferred: Column, against: Column, chosen_for: Column, limit: int = vocabulary.LIMIT) -> Column:
    """Confirmed words first, all of them; guesses fill what is left of the limit."""
    left = F.filter(inferred, lambda w: ~F.array_contains(against, w) & ~F.array_contains(chosen_for, w))
    return F.concat(against, F.slice(left, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.size(against))))


def merged_prefer(prefer: Column, chosen_for: Column) -> Column:
    return F.concat(prefer, F.filter(chosen_for, lambda w: ~F.array_contains(prefer, w)))


def build(samples: DataFrame, verdicts: DataFrame | None = None, created_at: str = "1970-01-01T00:00:00+00:00", updated_at: str | None = None, words: lex.Lexicons = lex.DEFAULT) -> DataFrame:
    """One profile a writer. Times are parameters, so that equal input gives equal output; profile_id is a digest of
    the writer; a writer that is null is one of them, and has the digest of an empty name."""
    keys, group = ["writer"], ["writer", "level", "context"]
    analysed = prepared(usable(samples).select("writer", "seq", "context", "text"), words)
    every = grouped(analysed)
    own = spanning.edges(analysed.select("writer", "context", "seq", "text", "norm", "tokens", *PLACE), ["writer", "context"])
    edges, own = grouped(own), own.drop("context")
    code = cut(spanning.code_terms(every, edges, group), "code")
    diverse = spanning.diversity(analysed, group, groups=levels(("writer",)))
    corpora, scores = scored(every, group, words, edges, code, diverse)
    at = lambda df, level: df.where(F.col("level") == level).drop("level")
    corpus, results = at(corpora, 0).drop("context"), at(scores, 0).drop("context")
    own_code = at(code, 0).drop("context")
    lists_of = analysed.select("writer", "seq", "text", "norm", "tokens", F.lower("norm").alias("lower"))
    used = cut(vocabulary.frequencies(lists_of, keys), "words")
    counted = cut(vocabulary.terms(lists_of, keys, words, "seq", own, own_code, used), "terms")
    tops = vocabulary.top_lists(counted, keys).select("writer", "technical_terms", "colloquialisms")
    varied = scoring.contradictions(results, keys).groupBy("writer").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dimension", "low", "high", "scatter"))), lambda x: F.struct(x["dimension"].alias("dimension"), x["low"].alias("low"), x["high"].alias("high"), x["scatter"].alias("scatter"))).alias("varies"))
    contexts = contexts_of(at(corpora, 1), at(scores, 1)).groupBy("writer").agg(F.array_sort(F.collect_list(F.struct("context", "style", F.struct("sample_count", "word_count").alias("metadata")))).alias("contexts"))
    out = joined(corpus, style(results, keys), keys)
    for part in (tops, vocabulary.prefer(counted, keys), vocabulary.avoid(lists_of, keys, words, used), vocabulary.recurring_phrases(lists_of, keys, words, "seq", edges=own), varied, contexts):
        out = joined(out, part, keys, "left")
    if verdicts is not None:
        out = joined(out, chosen_words(verdicts), keys, "left")
    else:
        out = out.withColumns({"against": F.lit(None).cast("array<string>"), "chosen_for": F.lit(None).cast("array<string>")})
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("technical_terms", "colloquialisms", "prefer", "avoid", "phrases", "against", "chosen_for")})
    out = out.withColumns({"avoid": merged_avoid(F.col("avoid"), F.col("against"), F.col("chosen_for")), "prefer": merged_prefer(F.col("prefer"), F.col("chosen_for"))})
    per_paragraph = lambda c: F.col(c) / F.greatest(F.col("paragraph_count"), F.lit(1))
    share = lambda c: rounded(F.col(c) / 100.0, 3)
    confirmed = F.filter("avoid", lambda w: F.array_contains("against", w))
    empty_varied = F.array().cast("array<struct<dimension:string,low:int,high:int,scatter:double>>")
    empty_contexts = F.array().cast(out.schema["contexts"].dataType)
    return out.select(
        "writer",
        F.lit(VERSION).alias("version"),
        F.concat(F.lit("voice_"), F.substring(F.sha2(F.coalesce(F.col("writer").cast("string"), F.lit("")), 256), 1, 12)).alias("profile_id"),
        "style",
        F.struct(F.col("avg_sentence_length").alias("average_sentence_length"), "sentence_length_variance", F.col("avg_paragraph_length").alias("average_paragraph_length"), "contraction_preference", share("fragment_rate").alias("fragment_preference"), share("question_rate").alias("question_preference"), share("passive_rate").alias("passive_preference"), "vocabulary_diversity").alias("syntax"),
        F.create_map(*(x for m in PROFILE_MARKS for x in (F.lit(m), F.col(f"band_{m}")))).alias("punctuation"),
        F.struct("prefer", "avoid", "technical_terms", "colloquialisms").alias("vocabulary"),
        F.struct(F.col("phrases").alias("preferred"), none.alias("avoided")).alias("phrasing"),
        F.struct(band(F.col("avg_paragraph_length"), PARAGRAPH_BANDS, "long").alias("paragraph_length"), band(per_paragraph("heading_count"), STRUCTURE_BANDS, "high").alias("heading_preference"), band(per_paragraph("bullet_count"), STRUCTURE_BANDS, "high").alias("bullet_preference")).alias("structure"),
        F.coalesce("contexts", empty_contexts).alias("contexts"),
        F.struct("sample_count", "word_count", "sentence_count", F.lit(created_at).alias("created_at"), F.lit(updated_at or created_at).alias("updated_at"), F.lit(GENERATOR).alias("generator"), F.lit(VERSION).alias("scoring_version")).alias("metadata"),
        F.struct(F.array(*map(F.lit, metrics.APPROXIMATE)).alias("approximate_metrics"), (F.size("avoid") > F.size(confirmed)).alias("avoid_inferred_from_absence"), confirmed.alias("avoid_confirmed_by_choice"), F.coalesce("varies", empty_varied).alias("varies_by_context"), F.lit(DESCRIBES).alias("describes")).alias("notes"),
    )


def for_context(profiles: DataFrame, name: str) -> DataFrame:
    """profiles with the style of a context laid over the general one; unchanged where a writer has no such context."""
    label = tx.context_label(F.lit(name))
    own = F.try_element_at(F.filter("contexts", lambda c: c["context"] == label), F.lit(1))
    laid = F.transform("style", lambda s: F.coalesce(F.try_element_at(F.filter(own["style"], lambda o: o["dimension"] == s["dimension"]), F.lit(1)), s))
    return profiles.withColumn("style", laid)


def confident(style_column: Column, threshold: float) -> Column:
    return F.transform(F.filter(style_column, lambda s: s["confidence"] >= threshold), lambda s: s["dimension"])


def to_json(profiles: DataFrame) -> Column:
    """The document: style and contexts as objects by name."""
    def styles(s: Column) -> Column:
        return F.map_from_entries(F.transform(s, lambda x: F.struct(x["dimension"], F.struct(x["value"].alias("value"), x["confidence"].alias("confidence")))))

    contexts = F.map_from_entries(F.transform("contexts", lambda c: F.struct(c["context"], F.struct(styles(c["style"]).alias("style"), c["metadata"].alias("metadata")))))
    return F.to_json(F.struct("version", "profile_id", styles(F.col("style")).alias("style"), "syntax", "punctuation", "vocabulary", "phrasing", "structure", contexts.alias("contexts"), "metadata", "notes"), {"pretty": "true"})


def errors(profiles: DataFrame) -> Column:
    """Every way in which a profile's document breaks its schema, as an array of messages; empty if none."""
    return schema.errors(to_json(profiles))


#: A document's fields that are read back, and what a missing one counts as.
FIELDS = {
    "version": ("string", VERSION),
    "profile_id": ("string", ""),
    "style": ("map<string,struct<value:int,confidence:double>>", None),
    "syntax": ("struct<average_sentence_length:double,sentence_length_variance:double,average_paragraph_length:double,contraction_preference:double,fragment_preference:double,question_preference:double,passive_preference:double,vocabulary_diversity:double>", None),
    "punctuation": ("map<string,string>", None),
    "vocabulary": ("struct<prefer:array<string>,avoid:array<string>,technical_terms:array<string>,colloquialisms:array<string>>", None),
    "phrasing": ("struct<preferred:array<string>,avoided:array<string>>", None),
    "structure": ("struct<paragraph_length:string,heading_preference:string,bullet_preference:string>", None),
    "contexts": ("map<string,struct<style:map<string,struct<value:int,confidence:double>>,metadata:struct<sample_count:bigint,word_count:bigint>>>", None),
    "metadata": ("struct<sample_count:bigint,word_count:bigint,sentence_count:bigint,created_at:string,updated_at:string,generator:string,scoring_version:string>", None),
    "notes": ("struct<approximate_metrics:array<string>,avoid_inferred_from_absence:boolean,avoid_confirmed_by_choice:array<string>,varies_by_context:array<struct<dimension:string,low:int,high:int,scatter:double>>,describes:string>", None),
}


def parsed(documents: DataFrame, column: str = "json") -> DataFrame:
    """Profiles of JSON documents, as build() has them, beside documents' other columns. A missing key counts as the
    current version, an empty text, list or map, or a struct of nulls."""
    doc = F.from_json(F.col(column), ", ".join(f"{k} {t}" for k, (t, _) in FIELDS.items()))
    rows = documents.select(*(F.col(c) for c in documents.columns if c != column), doc.alias("doc"))

    def styles(m: Column) -> Column:
        entries = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("dimension"), e["value"]["value"].alias("value"), e["value"]["confidence"].alias("confidence")))
        return F.coalesce(entries, F.array().cast("array<struct<dimension:string,value:int,confidence:double>>"))

    def field(k: str) -> Column:
        kind, default = FIELDS[k]
        x = F.col(f"doc.{k}")
        if k == "style":
            return styles(x)
        if k == "contexts":
            kind = "array<struct<context:string,style:array<struct<dimension:string,value:int,confidence:double>>,metadata:struct<sample_count:bigint,word_count:bigint>>>"
            made = F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("context"), styles(e["value"]["style"]).alias("style"), e["value"]["metadata"].alias("metadata")))
            return F.coalesce(made, F.array().cast(kind))
        empty = F.lit(default) if default is not None else F.from_json(F.lit("{}"), kind)
        return F.coalesce(x, empty)

    return rows.select(*(F.col(c) for c in rows.columns if c != "doc"), *(field(k).alias(k) for k in FIELDS))


def save(profiles: DataFrame, path: str) -> None:
    """Validated first: a profile that breaks the schema fails the job and nothing is committed."""
    bad = errors(profiles)
    checked = profiles.withColumn("version", F.when(F.size(bad) == 0, F.col("version")).otherwise(F.raise_error(F.array_join(bad, "; "))))
    checked.write.mode("overwrite").parquet(path)


def movement(before: DataFrame, after: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """(keys, dimension, before, after, delta, direction) of confidences that moved by `least` or more."""
    flat = lambda df, name: df.select(*keys, F.inline("style")).select(*keys, "dimension", F.col("confidence").alias(name))
    both = flat(before, "before").join(flat(after, "after"), [*keys, "dimension"], "full")
    delta = rounded(F.abs(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))), 4)
    up = F.coalesce("after", F.lit(0.0)) > F.coalesce("before", F.lit(0.0))
    return both.withColumn("delta", delta).where(F.col("delta") >= least).withColumn("direction", F.when(up, "up").otherwise("down"))
