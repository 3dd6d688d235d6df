"""A corpus that is summed has the same metrics as one that is analysed as one text."""

import random
import re

from pyspark.sql import functions as F

from idiolect.functions import text as tx
from idiolect.operators import features, metrics, profile, spanning, vocabulary
from idiolect.plans import fixtures as fx
from idiolect.plans import queries

SCHEMA = "writer string, seq long, context string, text string"
PIECES = (
    "it", "was", "really", "been", "been seen", "written", "get", "sort", "of", "kind", "a bit", "I", "do", "not", "is", "at the end", "of the day", "touch", "base", "`x", "y`", "``", "`",
    "```py\nf()\n```", "call()", "`call()`", "Call()", "snake_case", "API", "--flag", "—", "…", "\n\n", "\r", "\n- item", "# Head\n", "The end.", "Why?", "let me", "to be honest", "honest", "e.g.", "﻿", "nähe", " 　",
)


def scattered(seed=3, writers=60, most=25):
    """Writers of short samples, so that phrases, passives, word pairs and code cross one boundary or several."""
    draw = random.Random(seed)
    return [
        (f"w{w}", draw.randint(0, most), None, " ".join(draw.choice(PIECES) for _ in range(draw.choice((1, 1, 2, 3, 8, 30)))))
        for w in range(writers) for _ in range(draw.randint(1, most))
    ]


def joined_up(samples, keys):
    """(keys, sample_count, text): what a corpus is by definition, each group's samples in order in one text."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), F.array_join(rows, spanning.SEPARATOR).alias("text"))


def test_sums_equal_the_whole_where_samples_are_spanned(spark):
    for seed, most in ((3, 25), (9, 4)):
        df = profile.usable(fx.frame(spark, scattered(seed, most=most), SCHEMA))
        whole = {r.writer: r for r in features.analyse(joined_up(df, ["writer"])).select("writer", *profile.CORPUS).collect()}
        sums = {r.writer: r for r in profile.score_groups(df, ["writer"])[0].collect()}
        assert whole.keys() == sums.keys() and len(whole) > 50
        for c in profile.CORPUS:
            assert {w: r[c] for w, r in whole.items()} == {w: r[c] for w, r in sums.items()}, c


def test_lists_of_samples_are_those_of_the_whole(spark):
    rows = profile.usable(fx.frame(spark, scattered(5) + scattered(6, 3, 200), SCHEMA)).select("writer", "seq", "text")
    parts = metrics.measured(tx.normalised(rows)).cache()
    whole = metrics.measured(tx.normalised(joined_up(rows, ["writer"]))).cache()
    got = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for f in (vocabulary.terms, vocabulary.phrase_counts, vocabulary.recurring_phrases):
        assert got(f(parts, ["writer"], order="seq")) == got(f(whole, ["writer"])), f.__name__
    assert got(vocabulary.avoid(parts, ["writer"])) == got(vocabulary.avoid(whole, ["writer"]))
    assert got(vocabulary.recurring_phrases(parts, ["writer"], order="seq", first=3)) == got(vocabulary.recurring_phrases(whole, ["writer"]))


def test_no_corpus_is_brought_together(spark):
    """No aggregate of the plans of lists and scores collects texts: what they collect are terms, values and pieces."""
    for name in ("top_lists", "avoid_list", "phrase_counts", "scoring_results", "context_profiles"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        collected = re.findall(r"collect_list\([^)]*\)", plan)
        assert not [c for c in collected if "text#" in c or "norm#" in c], name


def test_diversity_reads_the_ends_of_pieces_again_not_all_of_them(spark, monkeypatch):
    draw, sizes, resumed = random.Random(11), [], spanning.resumed
    words = [f"w{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(60)]
    texts = [("common", i, " ".join(draw.choice(words) for _ in range(3_000))) for i in range(50)]
    df = tx.normalised(fx.frame(spark, texts, "writer string, seq long, text string"))

    def measured(runs, *rest):
        sizes.append(runs.agg(F.max(F.size("tokens"))).first()[0])
        return resumed(runs, *rest)

    monkeypatch.setattr(spanning, "resumed", measured)
    got = spanning.diversity(df, ["writer"]).first().vocabulary_diversity
    assert got == metrics.mtld_of([w for _, _, t in texts for w in t.split()])
    assert sizes and max(sizes) <= 8_192


def test_diversity_where_scans_do_not_meet_at_the_ends(spark, monkeypatch):
    monkeypatch.setattr(spanning, "HEAD", 4)
    draw = random.Random(12)
    made = {"new": [f"x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(900)], "mixed": [draw.choice("abcdefgh") * draw.randint(1, 9) for _ in range(900)], "few": ["a"] * 5}
    df = fx.frame(spark, [(w, i, " ".join(t[i : i + 30])) for w, t in made.items() for i in range(0, len(t), 30)], "writer string, seq long, text string")
    for piece in (32, 100):
        got = {r.writer: r.vocabulary_diversity for r in spanning.diversity(tx.normalised(df), ["writer"], piece=piece).collect()}
        assert got == {w: metrics.mtld_of(t) for w, t in made.items()}
