"""The counting function against the metrics' own expressions, and what runs beside Spark."""

import pytest
from pyspark.sql import functions as F

from idiolect.functions import text as tx
from idiolect.operators import counting, features, metrics

ODD = [
    None, "", " \n ", 'He said "why?"\n\nNo. "Yes?" ) He went.', "a\x01b \x02 c. D\x01\n\n\x01\n\nlast_ing of ringed_ things", "\u212aic\u212a off, \u212aick off; \u0130n theory a b\u0130t. Kick OFF!",
    "e\u0301te\u0301 na\u00efve \u00fcbering. Stra\u00dfe\u0301s gro\u00dfed. \u0131ng x\u0131ng abc\u0131ng \u24b6\u24b6bs", "wait.... no-- -- \u2014\u2013\u2026 :-) ;) :D /s", "# H\n\n- a\n\u2003* b\n1) c\r\n\u0665. d\n #x\n## y\u2028z", "Dr. No. e.g. this. etc.\" and on. \ufeffa\u00a0b\u2019s",
    "I am not done, we will go and it is. Don't! Let's see low-hanging fruit going forward; re-use getName load_x a.py --dry API `x` f()." * 3, "word " * 3000 + "\n\n" + "x y z. " * 500,
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(ODD * 60)), "id int, text string")  # more than one slice of rows


def test_counts_equal_the_expressions(rows):
    plain = metrics.measured(metrics.with_mtld(tx.normalised(rows)))
    want = plain.withColumns(metrics.basic())
    want = metrics.punctuation(metrics.vocabulary(metrics.syntax(want)))
    names = [c for c in want.columns if c not in ("text", "bare", "lower")]
    got = {r.id: r for r in features.analyse(rows).select(*names).collect()}
    for r in want.select(*names).collect():
        assert got[r.id].asDict() == r.asDict()


def test_plain_texts_are_counted_in_python(spark):
    """Before: every text was cut into sentences, and searched for passives and phrases, by Java's patterns."""
    import random

    from idiolect.operators import counting

    rnd, bits = random.Random(3), ["Dr", "e.g", "approx", "B", "..", ". ", "? ", "!", "\n", "\n\n", "\n \n", "\t", "- ", "\u2022 ", "1) ", '"', ")", "it's", "x's", "don't", "'s", "been", "was", "quickly", "taken", "\u00e9t\u00e9ed", "get", "kick off", "a bit", "\u2014", "\u2026", "API", "\x0b"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(("", " ", " ", ".")) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    norm = tx.normalised(rows)
    assert norm.where(counting.odd(tx.F.col("norm"))).count() == 0
    assert norm.select(counting.odd(tx.F.concat("norm", tx.F.lit("\u0131"))).alias("x")).where("x").count() == len(texts)
    want = metrics.vocabulary(metrics.syntax(metrics.measured(norm).withColumns(metrics.basic())))
    names = ["id", "sentence_lengths", *(f"{k}_count" for k in (*metrics.PER_WORD, *metrics.PER_SENTENCE, *metrics.VOCABULARY))]
    got = {r.id: r for r in features.analyse(rows).select(*names).collect()}
    assert all(got[r.id] == r for r in want.select(*names).collect())


def test_listed_phrases_equal_the_expressions(spark):
    """Before: each list's phrases were sought by Java's patterns in all texts, and those of two lists twice."""
    from pyspark.sql import functions as F

    from idiolect.functions import lexicons as lex
    from idiolect.operators import vocabulary

    w = lex.DEFAULT
    every = (*w.hedge_phrases, *w.buzz_phrases, *w.colloquial_phrases)
    texts = [t for p in every for t in (f"{p}, x{p} {p}x {p.upper()}\n{p.replace(' ', '  ')}", f"\u0131 {p} {p}. \u00e9{p}", f"{p} {p}-{p}_{p}")] + [None, "", *ODD]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    measured = metrics.measured(tx.normalised(rows))
    found = vocabulary.phrase_rows(measured, ["id"])
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.list, r.term): r.n for r in found.where("list <> 'technical_terms'").collect()}
    want = {}
    for names, of in ((("hedging_terms", "style_phrases"), w.hedge_phrases), (("colloquialisms", "style_phrases"), w.colloquial_phrases), (("buzzwords",), w.buzz_phrases)):
        for r in measured.select("id", F.inline(tx.phrases_found(F.col("lower"), of))).collect():
            want |= {(r.id, name, r.term): r.n for name in names}
    assert got == want


def test_features_pass_python_once(rows):
    """Before: two passes, each with every column, so that an executor's tasks had two Python processes each."""
    plan = features.features(rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan


def test_explained_scores_analyse_once(spark):
    """Before: texts were analysed twice, for the scores and for their spread."""
    from idiolect.plans import queries

    plan = queries.explained_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # the features are read from where they were written


def test_diversity_in_sql_takes_linear_steps(spark):
    """Words that never repeat make one factor of all of them; with a list to look them up in, 60,000 take minutes."""
    import time

    words = " ".join(f"w{i}" for i in range(60_000))
    df = tx.normalised(spark.createDataFrame([(1, words), (2, words + " " + words)], "id int, text string"))
    began = time.time()
    got = metrics.with_mtld(df).select("vocabulary_diversity", metrics.mtld_expression(tx.tokens(tx.F.col("norm"))).alias("sql")).collect()
    assert all(r.sql == r.vocabulary_diversity for r in got) and time.time() - began < 60


def test_a_batch_of_long_texts_is_bounded_in_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    df = spark.range(1_500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2_000).alias("text")).coalesce(1)
    for of in (lambda: features.analyse(df), lambda: metrics.with_mtld(tx.normalised(df))):
        spark.conf.unset(counting.BATCH_SETTING)
        of()
        assert df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5_000_000
    assert {r[0] for r in metrics.with_mtld(tx.normalised(df)).select("vocabulary_diversity").distinct().collect()} == {metrics.mtld_of(["word"] * 2_000)}


def test_texts_are_told_odd_in_one_pass(spark):
    """Before: up to fifteen searches of each text, which took more than twice the time."""
    kept = {*range(0x03, 0x1C), *range(0x20, 0x80), *range(0xC0, 0x250), *range(0x2010, 0x2015), *range(0x2018, 0x2020), 0x2022, 0x2023, 0x2026, 0x20AC, 0x25E6} - {0xD7, 0xF7, 0x130, 0x131, 0x17F}
    rows = spark.createDataFrame([(i, f"ab{chr(i)}c") for i in range(0x11000) if not 0xD800 <= i < 0xE000], "id int, t string")
    assert {r.id for r in rows.where(~counting.odd(F.col("t"))).collect()} == kept
    long = spark.range(1).select(F.repeat(F.lit("\u00e9 x\n"), 1_000_000).alias("t"))
    assert long.select(counting.odd(F.col("t")), counting.odd(F.concat("t", F.lit("\u0131"))), counting.odd(F.lit(None).cast("string"))).first()[:] == (False, True, None)
    assert str(counting.odd(F.col("t"))).upper().count("RLIKE") == 1 and "contains" not in str(counting.odd(F.col("t")))
