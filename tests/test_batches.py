"""What counts a batch of texts together, against the same word by word."""

import random
import re

import numpy as np

from idiolect.functions import text as tx
from idiolect.operators import batches, counting, metrics


def made(n: int, size: int, seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    bits = ["taken", "running", "bs", "abs", "e.g.", "No.", "approx", "...", ". ", '." ', "? )", "! ", "a", "B", "9", "_", "don't", "x--y", "-", "'", "w-x-y", "étéed", "—", " ", " ", "\n"]
    return ["".join(rnd.choice(bits) + rnd.choice((" ", "")) for _ in range(rnd.randrange(size))) for _ in range(n)]


def test_words_and_verbs_of_a_batch_are_those_of_its_texts():
    texts = ["", *made(300, 60), "", "." * 5_000 + '"' * 5_000 + " no. " * 500, "x"]
    c, ends = batches.characters(texts)
    starts, lengths, ids, distinct = batches.words(c)
    got = [[] for _ in texts]
    for r, i in zip(np.searchsorted(ends, starts).tolist(), ids.tolist()):
        got[r].append(distinct[i].as_py())
    assert got == [[w.lower() for w in re.findall(tx.WORD, t)] for t in texts]
    assert lengths.tolist() == [len(w) for t in got for w in t]
    verbs = np.bincount(np.searchsorted(ends, batches.verb_endings(c)), minlength=len(texts)) > 0
    assert verbs.tolist() == [re.search(r"(?i)\w{3}(?:ed|ing|s)\b", t) is not None for t in texts]
    marks, doubtful = batches.sentence_ends(c)
    assert len(marks) == sum(len(re.findall(r"[.!?][\"')\]]*\s", t)) for t in texts) and 0 < doubtful.sum() < len(marks)


def test_diversities_of_a_batch_are_those_of_its_texts():
    rnd = random.Random(7)
    for n in (0, 1, 3, 200):  # few texts are passed over word by word
        texts = [[rnd.randrange(1 + rnd.randrange(1, 400)) for _ in range(rnd.choice((0, 9, 10, 63, 64, 65, 500, 3_000)))] for _ in range(n)]
        texts += [list(range(700)), [1] * 700][: n]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got, distinct = batches.diversities(np.array([w for t in texts for w in t], np.int64), starts, metrics.MTLD_THRESHOLD)
        assert got == [metrics.mtld_of(t) for t in texts] and distinct.tolist() == [len(set(t)) for t in texts]


def test_texts_are_counted_without_a_call_a_word(spark, monkeypatch):
    """Before: some calls for each word, of its number and its place in two passes for diversity."""
    import cProfile
    import pstats

    import pyarrow as pa
    from pyspark.sql import functions as F

    runs = []
    monkeypatch.setattr(F, "arrow_udf", lambda run, *kind: runs.append(run) or (lambda *columns: F.lit(1)))
    counting.counts(F.col("norm"))
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(3_000)}" + "." * (rnd.random() < 0.07) for _ in range(500)) for _ in range(400)]
    batch = (pa.array(texts), pa.array([None] * len(texts), pa.string()))
    profile = cProfile.Profile()
    rows = profile.runcall(lambda: [r for x in runs[0](iter([batch])) for r in x.to_pylist()][: len(texts)])
    words = sum(r["word_count"] for r in rows)
    assert words == 200_000 and [r["vocabulary_diversity"] for r in rows] == [metrics.mtld_of(re.findall(tx.WORD, t)) for t in texts]
    calls = sum(v[1] for k, v in pstats.Stats(profile).stats.items() if "pyarrow" not in k[0])
    assert calls < words / 2
