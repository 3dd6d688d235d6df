"""Null groups, diversity in pieces, phrases in pages and exact sums: what no task may hold as a whole."""

import random
import statistics

from pyspark.sql import functions as F

from idiolect.operators import metrics, profile, scoring, spanning, vocabulary
from idiolect.plans import fixtures as fx
from idiolect.sources import files

SAMPLES = "writer string, seq long, context string, text string"


def test_diversity_in_pieces_is_that_of_all_words(spark):
    draw, rows, want = random.Random(3), [], {}
    for writer, n in (("a", 40), (None, 40), ("c", 2)):
        words = []
        for seq in range(n):
            own = [f"w{draw.randint(0, 60)}" for _ in range(draw.choice((0, 1, 5, 30, 200)))]
            words += own
            rows.append((writer, seq, " ".join(own), " ".join(own)))
        want[writer] = metrics.mtld_of(words)
    df = spark.createDataFrame(rows, "writer string, seq long, text string, norm string")
    for piece in (200, spanning.PIECE):
        assert {r.writer: r.vocabulary_diversity for r in spanning.diversity(df, ["writer"], piece=piece).collect()} == want


def test_a_null_writer_has_a_profile_contexts_and_lists(spark):
    named = spark.createDataFrame([r for r in fx.SAMPLES if r[0] == "ada"], SAMPLES)
    verdicts = fx.frame(spark, [(w if w == "ben" else None, *r) for w, *r in fx.VERDICTS], "writer string, seq long, formal string, plain string, chosen string")
    both = profile.build(named.unionByName(named.withColumn("writer", F.lit(None).cast("string"))), verdicts.where("writer is null").unionByName(verdicts.where("writer is null").withColumn("writer", F.lit("ada"))))
    rows = {r.writer: r.asDict(True) for r in both.collect()}
    assert set(rows) == {"ada", None}
    same = [c for c in both.columns if c not in ("writer", "profile_id")]
    assert {c: rows[None][c] for c in same} == {c: rows["ada"][c] for c in same} and rows[None]["contexts"] and rows[None]["vocabulary"]["avoid"]


def test_spread_is_exact_without_the_samples_together(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["x", None]), i, draw.choice([20, 41, 300]), *(round(draw.random() * 9, 4) for _ in scoring.FEATURES)) for i in range(200)]
    df = spark.createDataFrame(rows, "writer string, seq long, word_count long, " + ", ".join(f"{f} double" for f in scoring.FEATURES))
    usable = scoring.usable_scores(df).collect()
    for r in scoring.sample_spread(df, ["writer"]).collect():
        for d in scoring.NAMES:
            own = [s[f"score_{d}"] for s in usable if s.writer == r.writer]
            values = [round(x) for x in own]
            assert r.n_usable == len(own) and abs(r[f"deviation_{d}"] - statistics.pstdev(own)) < 1e-9
            assert (r[f"low_{d}"], r[f"high_{d}"], r[f"scatter_{d}"]) == (min(values), max(values), round(statistics.pstdev(values), 1))
    listed = scoring.sample_values(df, ["writer"], ["seq"])
    assert listed.count() == len(usable) * len(scoring.NAMES)


def test_phrases_in_pages_are_those_of_one_look(spark):
    words = "i think that it is at the end of my sense is let me be honest i can so we".split()
    draw = random.Random(6)
    rows = [(w, [draw.choice(words) for _ in range(400)]) for w in ("a", "b", None)]
    df = spark.createDataFrame(rows, "writer string, tokens array<string>")
    got = lambda first: sorted(map(str, vocabulary.recurring_phrases(df, ["writer"], first=first).collect()))
    assert got(3) == got(10_000) and len(got(3)) == 3


def test_entries_end_where_the_prompt_would(spark):
    def typed(text, paste):
        lines, done, rest = [], [], text.split("\n")
        for line in rest:
            if line.strip() == "." if paste else not line.strip() and lines:
                done.append("\n".join(lines).strip())
                lines = []
            else:
                lines.append(line)
        return [*done, "\n".join(lines).strip()] if lines else done

    draw = random.Random(1)
    texts = [(i, "\n".join(draw.choice(["", " ", "a", "b c", ".", " . "]) for _ in range(draw.randint(1, 12)))) for i in range(60)]
    lines = spark.createDataFrame(texts, "s long, text string").select("s", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    for paste in (False, True):
        found = {}
        for r in files.entered(lines, ["s"], paste).orderBy("s", "entry").collect():
            found.setdefault(r.s, []).append(r.text)
        assert found == {i: typed(t, paste) for i, t in texts}
