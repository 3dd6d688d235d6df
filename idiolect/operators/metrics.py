"""Metrics of a text as column expressions over its normalised form: no shuffle, any number of texts.

`measured` adds the arrays that the metrics share; the functions after it turn them into counts and rates.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx
from idiolect.functions.numbers import rounded, rate, ratio

#: Punctuation marks in the order of their counting, with their literals. Fixed values.
MARKS = {
    "comma": (",",),
    "period": (".",),
    "semicolon": (";",),
    "colon": (":",),
    "parentheses": ("(",),
    "em_dash": ("—", "--"),
    "en_dash": ("–",),
    "hyphen": ("-",),
    "exclamation": ("!",),
    "question": ("?",),
    "ellipsis": ("…", "..."),
    "quote": ('"',),
}
FIRST_MARKS = ("ellipsis", "em_dash", "en_dash")
#: Rates per 1000 words up to which a mark is rare, and occasional. Fixed values.
BANDS = {
    "comma": (20.0, 55.0),
    "period": (30.0, 70.0),
    "semicolon": (0.8, 3.0),
    "colon": (1.5, 6.0),
    "parentheses": (2.0, 8.0),
    "em_dash": (1.0, 5.0),
    "en_dash": (0.5, 2.0),
    "hyphen": (3.0, 12.0),
    "exclamation": (0.5, 3.0),
    "question": (2.0, 8.0),
    "ellipsis": (0.5, 2.0),
    "quote": (2.0, 10.0),
}
OTHER_BANDS = (1.0, 5.0)
APPROXIMATE = ("passive_voice", "fragments", "subordinate_clauses")
MTLD_THRESHOLD = 0.72
#: Regular expressions of the syntax and vocabulary metrics. Fixed values, but for the flags of Java's dialect; a file name
#: is group 1 of its match, as each run of its characters is tried from its first word character alone.
CONTRACTION = r"(?Ui)\b\w+'(?:t|s|re|ve|ll|d|m)\b"
PASSIVE = r"(?Ui)(?=[abgiw])\b(?:am|is|are|was|were|be|been|being|get|gets|got)\b(?:\s+\w+ly)?\s+(?:\w+(?:ed|en)\b|(?:" + "|".join(lex.IRREGULAR_PARTICIPLES) + r")\b)"
VERB_ENDING = r"(?Ui)\b\w{3,}(?:ed|ing|es|s)\b"
SHAPES = {
    "camel": r"(?U)\b[a-z]+[A-Z][A-Za-z]*\b",
    "snake": r"(?U)\b[a-z][a-z0-9]*_[a-z0-9_]+\b",
    "filename": r"(?U)(?<![\w.-])[.-]*+(\b[\w.-]+\.(?:" + "|".join(lex.FILE_ENDINGS) + r")\b)",
    "flag": r"(?U)(?<!\w)--[a-z][\w-]+",
    "acronym": r"(?U)\b[A-Z]{2,6}s?\b",
    "code": r"(?U)`[^`]+`|\b\w+\(\)",
}


def shape_possible(norm: Column, kind: str) -> Column:
    """Whether a text has what every occurrence of a shape has: most texts have not, and are not searched for it."""
    has = lambda x: F.contains(norm, F.lit(x))
    if kind == "code":
        return has("`") | has("()")
    if kind in ("snake", "flag"):
        return has("_" if kind == "snake" else "--")
    return norm.rlike({"camel": "[a-z][A-Z]", "acronym": "[A-Z][A-Z]", "filename": r"\.(?:" + "|".join(lex.FILE_ENDINGS) + ")"}[kind])


def shapes_found(norm: Column, kind: str) -> Column:
    """The occurrences of a technical shape, as they are written."""
    found = F.regexp_extract_all(norm, F.lit(SHAPES[kind]), F.lit(int(kind == "filename")))
    return F.when(shape_possible(norm, kind), found).otherwise(F.array().cast("array<string>"))


def measured(df: DataFrame, norm: str = "norm") -> DataFrame:
    """df with what the metrics of a normalised text share: tokens, sentences and their tokens, paragraphs, lines, the
    text in lower case and without dashes and ellipses. Columns of a projection of their own, so each is made once."""
    n = F.col(norm)
    arrays = df.withColumns({"tokens": tx.tokens(n), "sentences": tx.sentences(n), "paragraphs": tx.paragraphs(n), "lines": tx.lines(n), "lower": F.lower(n), "bare": bare(n)})
    return arrays.withColumn("sentence_tokens", F.transform("sentences", tx.tokens))


def hits(tokens: Column, terms: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: tx.one_of(t, terms))).cast("long")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def variance(values: Column) -> Column:
    """Population variance of an array of integers, exact but for one division; 0.0 below two values."""
    n = F.size(values).cast("long")
    s, q = total(values), total(F.transform(values, lambda x: x.cast("long") * x))
    return F.when(n >= 2, (n * q - s * s).cast("double") / (n * n).cast("double")).otherwise(F.lit(0.0))


def basic(tokens: str = "tokens", sentence_tokens: str = "sentence_tokens", paragraphs: str = "paragraphs", lines: str = "lines") -> dict[str, Column]:
    t = F.col(tokens)
    words = F.size(t).cast("long")
    lengths = F.filter(F.transform(sentence_tokens, F.size), lambda n: n > 0)
    n_paragraphs = F.size(paragraphs).cast("long")
    return {
        "word_count": words,
        "sentence_count": F.size(lengths).cast("long"),
        "paragraph_count": n_paragraphs,
        "average_sentence_length": ratio(total(lengths), F.size(lengths)),
        "sentence_length_variance": rounded(variance(lengths), 2),
        "average_paragraph_length": ratio(words, n_paragraphs),
        "average_word_length": ratio(total(F.transform(t, F.length)), words),
        "long_word_rate": rate(F.size(F.filter(t, lambda x: F.length(x) >= 7)), words, 100),
        "unique_word_count": F.size(F.array_distinct(t)).cast("long"),
        "heading_count": F.size(F.filter(lines, tx.is_heading)).cast("long"),
        "bullet_count": F.size(F.filter(lines, tx.is_bullet)).cast("long"),
        "sentence_lengths": lengths,
    }


def factors_of(sequence: Iterable, threshold: float = MTLD_THRESHOLD, factors: float = 0.0) -> float:
    """factors and those of a sequence that begins with one, with its share of the last."""
    seen, n = set(), 0
    add = seen.add
    for token in sequence:
        n += 1
        if token not in seen:
            add(token)
            if threshold < 1:  # a new word lifts the ratio, so only a repeated one can end a factor
                continue
        if len(seen) / n <= threshold:
            factors, n = factors + 1, 0
            seen.clear()
    if n:
        factors += (1 - len(seen) / n) / (1 - threshold)
    return factors


def mtld_of(tokens: list, threshold: float = MTLD_THRESHOLD) -> float:
    """Mean words a factor, forwards and backwards: a factor ends where distinct / seen falls to the threshold, and
    what is left counts by how far it has fallen."""
    if len(tokens) < 10:
        return 0.0

    def passed(sequence) -> float:
        factors = factors_of(sequence, threshold)
        return len(tokens) / factors if factors > 0 else float(len(tokens))

    return round((passed(tokens) + passed(reversed(tokens))) / 2, 2)


def with_mtld(df: DataFrame, norm: str = "norm", to: str = "vocabulary_diversity", threshold: float = MTLD_THRESHOLD) -> DataFrame:
    """df and the lexical diversity of its normalised text: a sequential measure, so one Arrow pass."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    from idiolect.operators import counting

    place = df.columns.index(norm)

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        word = re.compile(tx.WORD)
        for batch in batches:
            values = [mtld_of([w.lower() for w in word.findall(t.as_py() or "")], threshold) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, to])

    return counting.in_small_batches(df).mapInArrow(run, StructType([*df.schema.fields, StructField(to, DoubleType())]))


def mtld_expression(tokens: Column, threshold: float = MTLD_THRESHOLD) -> Column:
    """The same as a fold in SQL functions, for where Python is not wanted. A word is new to a factor if the same word before
    it, found by one sort, lies before the factor's start; so a factor is three numbers, however long it is."""

    def linked(s: Column) -> Column:
        near = lambda k, x, by, none: F.when(F.get(s, k + by)["t"] == x["t"], F.get(s, k + by)["i"]).otherwise(none)
        return F.sort_array(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), near(k, x, -1, F.lit(-1)).alias("before"), near(k, x, 1, F.size(s)).alias("after"))))

    def fold(words: Column, start: Column, new, turn: int) -> Column:
        """start: a factor's first word; new: whether a word is, in a factor of that start."""
        zero = F.struct(F.lit(0.0).alias("factors"), F.lit(0).alias("n"), F.lit(0).alias("seen"), start.alias("start"))

        def step(acc: Column, x: Column) -> Column:
            n, seen = acc["n"] + 1, acc["seen"] + F.when(new(x, acc["start"]), 1).otherwise(0)
            full = F.struct((acc["factors"] + 1).alias("factors"), F.lit(0).alias("n"), F.lit(0).alias("seen"), (x["i"] + turn).alias("start"))
            return F.when(seen / n <= threshold, full).otherwise(F.struct(acc["factors"].alias("factors"), n.alias("n"), seen.alias("seen"), acc["start"].alias("start")))

        def done(acc: Column) -> Column:
            factors = acc["factors"] + F.when(acc["n"] > 0, (1 - acc["seen"] / acc["n"]) / (1 - threshold)).otherwise(0.0)
            size = F.size(words).cast("double")
            return F.when(factors > 0, size / factors).otherwise(size)

        return F.aggregate(words, zero, step, done)

    def both(words: Column) -> Column:
        forwards = fold(words, F.lit(0), lambda x, start: x["before"] < start, 1)
        return (forwards + fold(F.reverse(words), F.size(words) - 1, lambda x, start: x["after"] > start, -1)) / 2

    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    return once(tokens, lambda t: F.when(F.size(t) < 10, 0.0).otherwise(rounded(once(once(F.sort_array(F.transform(t, lambda w, i: F.struct(w.alias("t"), i.alias("i")))), linked), both), 2)))


def bare(norm: Column) -> Column:
    """The text with dashes and ellipses replaced, so that what they are made of is not counted again."""
    for mark in FIRST_MARKS:
        for literal in MARKS[mark]:
            norm = F.replace(norm, F.lit(literal), F.lit("\x00"))
    return norm


def punctuation_counts(norm: Column, bare_text: Column | None = None) -> dict[str, Column]:
    counts, working = {}, norm
    for mark in FIRST_MARKS:
        parts = []
        for literal in MARKS[mark]:
            parts.append(tx.literal_count(working, literal))
            working = F.replace(working, F.lit(literal), F.lit("\x00"))
        counts[mark] = sum(parts[1:], parts[0])
    rest = bare(norm) if bare_text is None else bare_text
    return {mark: counts[mark] if mark in counts else tx.literal_count(rest, MARKS[mark][0]) for mark in MARKS}


def band(mark: str, mark_rate: Column | str, count: Column | str) -> Column:
    rare, occasional = BANDS.get(mark, OTHER_BANDS)
    if isinstance(mark_rate, str) and isinstance(count, str):
        return F.expr(f"case when {count} = 0 then 'never' when {mark_rate} <= {rare}D then 'rare' when {mark_rate} <= {occasional}D then 'occasional' else 'frequent' end")
    return F.when(count == 0, "never").when(mark_rate <= rare, "rare").when(mark_rate <= occasional, "occasional").otherwise("frequent")


def punctuation(df: DataFrame, norm: str = "norm", words: str = "word_count") -> DataFrame:
    """df and, for each mark, n_, rate_ (per 1000 words) and band_ columns."""
    out = df.withColumns({f"n_{m}": c for m, c in punctuation_counts(F.col(norm), F.col("bare") if "bare" in df.columns else None).items()})
    out = out.withColumns({f"rate_{m}": rate(f"n_{m}", words, 1000) for m in MARKS})
    return out.withColumns({f"band_{m}": band(m, f"rate_{m}", f"n_{m}") for m in MARKS})


def contraction_count(norm: Column, words: lex.Lexicons = lex.DEFAULT) -> Column:
    found = F.transform(F.regexp_extract_all(norm, F.lit(CONTRACTION), F.lit(0)), F.lower)
    return F.size(F.filter(found, lambda m: tx.one_of(m, words.contractions) | ~m.endswith("'s"))).cast("long")


def contraction_chances(tokens: Column) -> Column:
    """Neighbouring words that could have been contracted."""
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: (tx.one_of(a, lex.CONTRACTABLE_SUBJECTS) & tx.one_of(b, lex.CONTRACTABLE_FOLLOWERS)) | (tx.one_of(a, lex.NEGATABLE) & (b == "not")))
    return F.size(F.filter(pairs, lambda x: x)).cast("long")


def is_question(sentence: Column) -> Column:
    return F.rtrim(sentence).endswith("?")


def syntax_counts(norm: Column, words: lex.Lexicons = lex.DEFAULT, tokens: str = "tokens", sentences: str = "sentences", sentence_tokens: str = "sentence_tokens") -> dict[str, Column]:
    t = F.col(tokens)
    both = F.arrays_zip(F.col(sentences).alias("s"), F.col(sentence_tokens).alias("t"))
    first = lambda x: F.try_element_at(x["t"], F.lit(1))
    n = lambda keep: F.size(F.filter(both, keep)).cast("long")
    finite = lambda x: F.exists(x["t"], lambda w: tx.one_of(w, words.finite_verbs)) | x["s"].rlike(VERB_ENDING)
    return {
        "contraction_count": contraction_count(norm, words),
        "contraction_chances": contraction_chances(t),
        "first_person_count": hits(t, words.first_person),
        "second_person_count": hits(t, words.second_person),
        "passive_count": F.regexp_count(norm, F.lit(PASSIVE)).cast("long"),
        "question_count": F.size(F.filter(sentences, is_question)).cast("long"),
        "fragment_count": n(lambda x: (F.size(x["t"]) > 0) & ~finite(x)),
        "conjunction_count": hits(t, words.conjunctions),
        "subordinate_count": hits(t, words.subordinators),
        "initial_conjunction_count": n(lambda x: F.coalesce(tx.one_of(first(x), words.initial_conjunctions), F.lit(False))),
        "imperative_count": n(lambda x: F.coalesce(tx.one_of(first(x), words.imperative_openers), F.lit(False)) & ~is_question(x["s"])),
        "strong_modal_count": hits(t, words.strong_modals),
        "weak_modal_count": hits(t, words.weak_modals),
    }


PER_SENTENCE = ("passive", "question", "fragment", "subordinate", "initial_conjunction", "imperative")
PER_WORD = ("contraction", "first_person", "second_person", "conjunction", "strong_modal", "weak_modal")


def syntax(df: DataFrame, norm: str = "norm", words: lex.Lexicons = lex.DEFAULT) -> DataFrame:
    """measured() and the counts and rates of syntax. Sentences without a word count as sentences here."""
    out = df.withColumns(syntax_counts(F.col(norm), words))
    rates = {f"{k}_rate": rate(f"{k}_count", "size(tokens)", 100) for k in PER_WORD} | {f"{k}_rate": rate(f"{k}_count", "greatest(size(sentences), 1)", 100) for k in PER_SENTENCE}
    return out.withColumns(rates | {"contraction_preference": ratio("contraction_count", "(contraction_count + contraction_chances)", 3)})


def code_shapes(norm: Column) -> Column:
    return F.array_distinct(F.transform(shapes_found(norm, "code"), F.lower))


def shape_hits(norm: Column, words: lex.Lexicons = lex.DEFAULT, code: bool = True) -> Column:
    """Lower-cased technical shapes, one for each occurrence; of code only distinct ones, or none."""
    found = {k: shapes_found(norm, k) for k in SHAPES if k != "code"}
    lowered = {k: F.transform(x, F.lower) for k, x in found.items()}
    acronyms = F.filter(lowered["acronym"], lambda x: ~tx.one_of(x, words.stopwords))
    return F.concat(lowered["camel"], lowered["snake"], lowered["filename"], lowered["flag"], acronyms, *([code_shapes(norm)] if code else []))


def phrases_in(lower: Column, phrases: tuple[str, ...]) -> Column:
    return F.aggregate(tx.phrases_found(lower, phrases), F.lit(0).cast("long"), lambda acc, p: acc + p["n"]) if phrases else F.lit(0).cast("long")


def vocabulary_counts(norm: Column, words: lex.Lexicons = lex.DEFAULT, tokens: str = "tokens", lower: Column | None = None) -> dict[str, Column]:
    lower = F.col("lower") if lower is None else lower
    marked = F.filter(tokens, lambda t: tx.one_of(t, words.counted()))  # one pass over all tokens; the rest look at few
    smiles = sum((tx.literal_count(lower, p) for p in words.humour_punctuation), F.lit(0).cast("long"))
    return {
        "hedge_count": hits(marked, words.hedge_words) + phrases_in(lower, words.hedge_phrases),
        "filler_count": hits(marked, words.fillers),
        "buzzword_count": hits(marked, words.buzzwords) + phrases_in(lower, words.buzz_phrases),
        "formal_vocab_count": hits(marked, words.formal_vocab),
        "colloquial_count": hits(marked, words.colloquialisms) + phrases_in(lower, words.colloquial_phrases),
        "intensifier_count": hits(marked, words.intensifiers),
        "humour_marker_count": hits(marked, words.humour_markers) + smiles,
        "technical_count": hits(marked, words.technical_terms) + F.size(shape_hits(norm, words)),
        "formal_transition_count": hits(marked, words.formal_transitions),
    }


VOCABULARY = ("hedge", "filler", "buzzword", "formal_vocab", "colloquial", "intensifier", "humour_marker", "technical", "formal_transition")


def vocabulary(df: DataFrame, norm: str = "norm", words: lex.Lexicons = lex.DEFAULT) -> DataFrame:
    """measured() and the counts and rates per 100 words of vocabulary."""
    out = df.withColumns(vocabulary_counts(F.col(norm), words))
    return out.withColumns({f"{k}_rate": rate(f"{k}_count", "size(tokens)", 100) for k in VOCABULARY})


# --- of texts that counting.counts() has counted ------------------------------------------------------------------


def counted_patterns(words: lex.Lexicons = lex.DEFAULT) -> dict[str, Column]:
    """The counts that Java's patterns define, sought where they can be, beside columns of counting.counts()."""
    from idiolect.operators.counting import MAYBE

    norm = F.col("norm")
    maybe = lambda k: F.col("maybe").bitwiseAND(1 << MAYBE.index(k)) != 0
    seen = lambda k, n: F.when(maybe(k), n).otherwise(F.lit(0).cast("long"))
    found = {k: shapes_found(norm, k) for k in SHAPES if k != "code"}
    sizes = [seen(k, F.size(x).cast("long")) for k, x in found.items() if k != "acronym"]
    sizes.append(seen("acronym", F.size(F.filter(found["acronym"], lambda x: ~tx.one_of(F.lower(x), words.stopwords))).cast("long")))
    sizes.append(seen("code", F.size(code_shapes(norm)).cast("long")))
    starts = (0, len(words.hedge_phrases), len(words.hedge_phrases) + len(words.buzz_phrases), len(words.hedge_phrases) + len(words.buzz_phrases) + len(words.colloquial_phrases))
    patterns = F.from_json(F.lit(json.dumps([tx.phrase_pattern(p) for p in (*words.hedge_phrases, *words.buzz_phrases, *words.colloquial_phrases)])), "array<string>")

    def phrases(i: int) -> Column:
        near = F.filter("phrases", lambda p: (p >= starts[i]) & (p < starts[i + 1]))
        return F.aggregate(near, F.lit(0).cast("long"), lambda acc, p: acc + F.regexp_count(F.lower(norm), F.get(patterns, p)).cast("long"))

    odd = F.col("odd") != 0
    more = {"hedge": phrases(0) + F.col("n_hedge_phrase"), "buzzword": phrases(1) + F.col("n_buzz_phrase"), "colloquial": phrases(2) + F.col("n_colloquial_phrase"), "humour_marker": F.col("smiles"), "technical": sum(sizes[1:], sizes[0])}
    made = {f"{k}_count": F.col(f"{k}_count") + x for k, x in more.items()}
    passive = F.regexp_count(norm, F.lit(PASSIVE)).cast("long")
    return made | {"contraction_count": F.when(odd, seen("contraction", contraction_count(norm, words))).otherwise(F.col("n_contraction")), "passive_count": F.when(odd, passive).otherwise(F.col("n_passive"))}


def counted_rates() -> dict[str, Column]:
    n, s, q = F.col("sentence_count"), F.col("word_count"), F.col("n_squares")
    spread = F.when(n >= 2, (n * q - s * s).cast("double") / (n * n).cast("double")).otherwise(F.lit(0.0))
    made = {
        "average_sentence_length": ratio("word_count", "sentence_count"), "sentence_length_variance": rounded(spread, 2), "average_paragraph_length": ratio("word_count", "paragraph_count"),
        "average_word_length": ratio("n_chars", "word_count"), "long_word_rate": rate("n_long", "word_count", 100), "contraction_preference": ratio("contraction_count", "(contraction_count + contraction_chances)", 3),
    }
    made |= {f"{k}_rate": rate(f"{k}_count", "word_count", 100) for k in (*PER_WORD, *VOCABULARY)}
    made |= {f"{k}_rate": rate(f"{k}_count", "greatest(n_sentences, 1)", 100) for k in PER_SENTENCE}
    return made | {f"rate_{m}": rate(f"n_{m}", "word_count", 1000) for m in MARKS}
