"""Hand-counted texts, and random ones against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from idiolect.functions import lexicons as lex
from idiolect.functions import text as tx
from idiolect.operators import features, metrics


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


@pytest.fixture(scope="module")
def analysed(spark):
    texts = [
        "I don't. But he left. Dr. Smith (the e.g. man) stayed, etc. \"Why?\" Yes!",
        "Wait -- no --- yes... well.... a-b—c–d; e: f",
        "# Head\n\n- one two\n- three\n\n1. four\n2) five six\nstill five\n\nLast para.",
        "You're fine. Sam's dog can't. It is not. Do not go. Y'know it's gonna work.",
        "The plan was quickly approved. It got done. They are running. Running late. Is it done?",
        "Maybe it is sort\nof fine; kind of. At least perhaps :) lol.",
        "useCamel snake_case main.py --flag API APIs THE `x` `x` foo() foo()",
        None,
        "",
        "été “q” it’s ok\r\nnext\rlast﻿",
    ]
    rows = features.analyse(frame(spark, texts)).collect()
    return {r.id: r for r in rows}


def test_sentences(analysed):
    assert analysed[0].sentences == ["I don't. But he left.", "Dr. Smith (the e.g. man) stayed, etc. \"Why?", "Yes!"]
    assert analysed[2].sentences == ["# Head", "- one two", "- three", "1.", "four", "2) five six\nstill five", "Last para."]
    assert analysed[2].paragraph_count == 4 and analysed[2].heading_count == 1 and analysed[2].bullet_count == 4
    assert analysed[7].sentences == [] and analysed[8].word_count == 0


def test_punctuation(analysed):
    r = analysed[1]
    assert (r.n_em_dash, r.n_en_dash, r.n_hyphen, r.n_ellipsis, r.n_period, r.n_semicolon, r.n_colon) == (3, 1, 2, 2, 1, 1, 1)
    assert r.band_comma == "never" and r.band_em_dash == "frequent"


def test_syntax(analysed):
    assert analysed[3].contraction_count == 3  # you're, can't and it's; sam's is a possessive
    assert analysed[3].contraction_chances == 3  # it is, is not, do not
    r = analysed[4]
    assert (r.passive_count, r.question_count, r.fragment_count) == (2, 1, 0)


def test_vocabulary(analysed):
    assert analysed[5].hedge_count == 2 + 3 and analysed[5].humour_marker_count == 2
    assert analysed[6].technical_count == 1 + 1 + 1 + 1 + 2 + 2 + 2  # four shapes, two acronyms, two bits of code, two lexicon words


def test_normalising(analysed):
    assert analysed[9].norm == 'été "q" it\'s ok\nnext\nlast'


def test_empty_text_scores_but_counts_nothing(analysed):
    assert all(getattr(analysed[8], f) == 0.0 for f in features.FEATURES)


def plain_sentences(text):
    """A restatement with a loop over boundaries."""
    out = []
    for paragraph in re.split(r"\n[ \t]*\n", text.strip()):
        segment = re.split(r"\n(?=[ \t]*(?:[-*•‣◦]|\d+[.)])[ \t]+)", paragraph.strip())
        for s in segment:
            s, start = s.strip(), 0
            for m in re.finditer(r"(?<=[.!?])[\"')\]]*\s+", s):
                tail = re.search(r"([A-Za-z][A-Za-z.]*)\.[\"')\]]*\s*$", s[start : m.start()])
                last = tail and tail[1].lower().rstrip(".")
                if tail and (last in lex.ABBREVIATIONS or len(last) == 1):
                    continue
                out.append(s[start : m.start()].strip())
                start = m.end()
            out.append(s[start:].strip())
    return [x for x in out if x]


def test_sentences_of_random_texts(spark):
    draw = random.Random(1)
    atoms = ["Dr", "no", "etc", "word", "A", "b", "e.g", ".", ".", "!", "?", '"', ")", " ", " ", " ", "\n", "\n\n", "\n- ", "\n1. ", ",", "end"]
    texts = ["".join(draw.choice(atoms) for _ in range(draw.randint(1, 40))) for _ in range(500)]
    got = {r.id: r.s for r in frame(spark, texts).select("id", tx.sentences(tx.plain_marks(F.col("text"))).alias("s")).collect()}
    squeeze = lambda xs: [re.sub(r"[\s\"')]+", "", x) for x in xs]  # noqa: E731  inside a sentence quotes and blanks may differ
    wrong = [t for i, t in enumerate(texts) if squeeze(got[i]) != squeeze(plain_sentences(t))]
    assert len(wrong) <= 5, wrong[:3]


def test_mtld_both_ways(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefghijklmnop") + str(draw.randint(0, n)) for _ in range(n * 7)) for n in range(1, 30)] + ["a b c", ""]
    df = tx.normalised(frame(spark, texts))
    one = metrics.with_mtld(df).withColumn("sql", metrics.mtld_expression(tx.tokens(F.col("norm"))))
    for r in one.collect():
        assert abs(r.vocabulary_diversity - r.sql) <= 0.011
    assert metrics.mtld_of(["x"] * 9) == 0.0 and metrics.mtld_of(list("abcdefghij")) == 10.0


def test_lexicons_can_be_replaced(spark):
    from dataclasses import replace

    words = replace(lex.DEFAULT, fillers=("zap",))
    df = metrics.vocabulary(metrics.measured(tx.normalised(frame(spark, ["zap zap just"]))), words=words)
    assert df.first().filler_count == 2


def test_rounding_is_that_of_python(spark):
    from idiolect.functions.numbers import ratio, rounded, rounded_sql

    draw = random.Random(6)
    values = [a / b for b in range(1, 151) for a in range(0, 2 * b)] + [draw.uniform(0, 10 ** draw.randint(-6, 9)) for _ in range(5_000)]
    values += [k / 8 for k in range(-40, 400)] + [k + 0.5 for k in range(50)] + [9.125, 2.675, 1.005, 0.5, -2.675, 0.0, 1e-12, 12345.00005]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (1, 2, 3, 4, 6):
        for c in (rounded(F.col("x"), digits), F.expr(rounded_sql("x", digits))):
            assert [r.y for r in df.select(c.alias("y")).collect()] == [round(x, digits) for x in values], digits
    whole = spark.createDataFrame([(a, b) for b in range(0, 60) for a in range(0, 90)], "a long, b long")
    for c in (ratio(F.col("a"), F.col("b")), ratio("a", "b")):
        assert all(r.y == (round(r.a / r.b, 2) if r.b else 0.0) for r in whole.select("a", "b", c.alias("y")).collect())


def test_very_long_words_and_blanks(spark):
    n = 1_000_000
    texts = ["a-" * n + "b", "a.b-" * (n // 4), " " * n + "x" + "\n " * (n // 2), "x. " * (n // 10), "y\n\n" * (n // 10), "!)" * (n // 2), "`" * n, "." * n, "ab_" * (n // 3), "-" * n + "x.py"]
    rows = features.features(frame(spark, texts), ["id"]).orderBy("id").collect()
    assert [r.word_count for r in rows[:4]] == [1, 250_001, 1, 100_000] and rows[4].word_count == 100_000 and rows[9].technical_rate == 50.0


def test_file_names_start_at_the_first_word_character_of_their_run(spark):
    import re as plain

    pattern = plain.compile(metrics.SHAPES["filename"].replace("(?U)(?<![\\w.-])[.-]*+(", "").removesuffix(")"))
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a", "b", ".", "-", ".py", ".md", " ", "_", "py", "é", "yaml", ".yml", "5"]) for _ in range(draw.randint(1, 14))) for _ in range(2_000)]
    got = frame(spark, texts).select(metrics.shapes_found(F.col("text"), "filename").alias("f")).collect()
    assert [r.f for r in got] == [pattern.findall(t) for t in texts]


def test_results_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    one = features.features(df.repartition(1), ["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)
    many = features.features(df.repartition(9), ["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)
    assert one.equals(many)
