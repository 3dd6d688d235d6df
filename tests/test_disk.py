"""What profiles write down: of a text one copy, of pieces of words their ends, and no shuffle that is done with."""

import os
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from idiolect.functions import text as tx
from idiolect.operators import metrics, profile, spanning
from idiolect.sources import scratch

SAMPLES = "writer string, seq long, context string, text string"


def texts(n=300, most=600, seed=4):
    """Two writers in two contexts or none, whose words repeat at all distances."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(4_000)]
    return [(f"w{i % 2}", i // 3, draw.choice(["mail", "work", None]), " ".join(words[min(3_999, int(draw.expovariate(0.004)))] for _ in range(draw.choice((0, 3, most))))) for i in range(n)]


def size(path):
    return sum(p.stat().st_size for p in Path(path.removeprefix("file:")).rglob("*.parquet"))


def at(df):
    return os.path.dirname(df.inputFiles()[0].replace("file://", ""))


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_analysed_samples_hold_a_text_once(spark, tmp_path):
    spark.createDataFrame(texts(), SAMPLES).write.parquet(f"{tmp_path}/given")
    given = spark.read.parquet(f"{tmp_path}/given")
    analysed = profile.prepared(given)
    assert size(at(analysed)) < 1.3 * size(f"{tmp_path}/given")
    odd = spark.createDataFrame([("a", 1, None, "“It’s\r\nso”"), ("a", 2, None, None), ("a", 3, None, "plain words")], SAMPLES)
    rows = profile.prepared(odd).orderBy("seq").select("text", "norm", "tokens").collect()
    assert [tuple(r) for r in rows] == [("“It’s\r\nso”", '"It\'s\nso"', ["it's", "so"]), ("", "", []), ("plain words", "plain words", ["plain", "words"])]


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffles(spark)
    rows = scratch.cut(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):
        if not shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert rows.count() == 100


def test_diversity_of_writers_and_contexts_in_one_reading(spark, monkeypatch):
    """Pieces of several groups are open at once; what their heads lack is sought in the texts, and no piece is left on disk."""
    made = texts(90, 200)
    want = {}
    for w, _, c, t in sorted(made, key=lambda r: (r[0], r[1], r[3][: spanning.LEAD], r[3])):
        for k in {(w, 0, None), (w, 1, c)} if c else {(w, 0, None)}:
            want[k] = want.get(k, []) + t.split()
    keys, rows = ["writer", "level", "context"], scratch.cut(spanning.placed(tx.normalised(spark.createDataFrame([(w, i, c, t) for w, i, c, t in made], SAMPLES)), ["writer"]), "texts")
    folder, asked = Path(scratch.shared_dir(spark).removeprefix("file:")), []
    words_of = spanning.words_of
    monkeypatch.setattr(spanning, "words_of", lambda *a: asked.append(1) or words_of(*a))
    for head, most_open in ((4, 1_000_000), (8_192, 150)):
        monkeypatch.setattr(spanning, "HEAD", head)
        monkeypatch.setattr(spanning, "OPEN", most_open)
        got = {tuple(r)[:3]: r.vocabulary_diversity for r in spanning.diversity(rows, keys, piece=300, groups=profile.levels(("writer",))).collect()}
        assert len(got) > 4 and {k: v for k, v in got.items()} == {k: metrics.mtld_of(v) for k, v in want.items() if v}
    assert asked and not list(folder.glob("idiolect-diversity-*"))
