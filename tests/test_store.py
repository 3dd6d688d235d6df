"""Versions of profiles: what a reader sees wherever a writer stops, rebuilds of some writers, streams that come again."""

import json

import pytest
from pyspark.sql import functions as F

from idiolect.operators import contexts, profile
from idiolect.plans import fixtures as fx
from idiolect.sources.store import Conflict, Store
from idiolect.streaming import evidence as stream

TEXTS = "writer string, seq long, source string, context string, text string"


def texts(spark, writers=("ada", "ben", "cy"), seqs=(1, 2, 3, 4, 5)):
    return spark.createDataFrame([(w, s, "f", c, t) for w, s, c, t in fx.SAMPLES if w in writers and s in seqs], TEXTS)


def documents(df):
    """The profiles as objects, without their times."""
    found = []
    for r in df.select("writer", profile.to_json(df).alias("json")).collect():
        told = json.loads(r.json)
        del told["metadata"]["created_at"], told["metadata"]["updated_at"]
        found.append((r.writer, told))
    return sorted(found, key=lambda x: x[0])


def test_only_changed_writers_are_built_and_the_result_is_that_of_a_whole_rebuild(spark, tmp_path, monkeypatch):
    store, asked = Store.open(spark, str(tmp_path)), []
    real = profile.build
    monkeypatch.setattr(profile, "build", lambda samples, *a, **k: asked.append({r.writer for r in samples.select("writer").distinct().collect()}) or real(samples, *a, **k))
    store.add(texts(spark, seqs=(1, 2)), timestamp="t1")
    store.rebuild("t2")
    store.add(texts(spark, ("ben",), (3,)), timestamp="t3")
    store.add(texts(spark, ("ben",), (3,)), timestamp="t3")  # appended again: counts once
    after = store.rebuild("t4")
    assert asked == [{"ada", "ben", "cy"}, {"ben"}] and {r.u for r in after.select(F.col("metadata.updated_at").alias("u")).collect()} == {"t4"}
    store.rebuild("t5")
    assert len(asked) == 2  # nothing changed
    whole = real(texts(spark, seqs=(1, 2)).unionByName(texts(spark, ("ben",), (3,))))
    assert documents(store.load()) == documents(whole.select(store.load().columns))
    assert {r.n for r in store.load(1).where("writer = 'ben'").select(F.col("metadata.sample_count").alias("n")).collect()} == {1} and store.load(7) is None


def test_a_crash_between_any_two_steps_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path))
    flat = spark.createDataFrame([("ada", "{}")], "writer string, json string")
    one, two = (profile.parsed(flat.withColumn("json", F.lit(f'{{"version": "1.0", "profile_id": "{n}", "style": {{}}, "metadata": {{"sample_count": 1, "word_count": {n}}}}}'))) for n in (1, 2))
    monkeypatch.setattr(profile, "errors", lambda p: F.array().cast("array<string>"))
    assert store.load() is None and not store.exists()
    words = lambda: [r.n for r in store.load().select(F.col("metadata.word_count").alias("n")).collect()]
    store.save(one)
    began = store.load()
    with monkeypatch.context() as m:  # data written, no commit
        m.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.save(two)
    assert words() == [1] and store.version().number == 1
    (tmp_path / "profiles" / "commits" / "000000000002").write_text('{"data": ')  # a commit that was not written whole
    assert words() == [1]
    store.save(two)
    assert words() == [2] and store.version().number == 3
    assert [r.n for r in began.select(F.col("metadata.word_count").alias("n")).collect()] == [1]  # a reader stays with its version
    with pytest.raises(Conflict):
        store.save(one, number=3)
    assert words() == [2]


def test_a_stream_keeps_profiles_and_a_batch_that_comes_again_counts_once(spark, tmp_path):
    store, inbox = Store.open(spark, str(tmp_path / "home")), str(tmp_path / "in")

    def follow(checkpoint):
        rows = spark.readStream.schema(TEXTS).json(inbox)
        stream.keep_profiles(rows, store, "inbox", str(tmp_path / checkpoint), "t1").awaitTermination()

    texts(spark, ("ada", "cy"), (2, 3)).unionByName(texts(spark, ("cy",), (1,))).coalesce(1).write.mode("append").json(inbox)
    follow("c")
    assert store.version().batches == {"inbox": 0}
    texts(spark, ("ada",), (1,)).coalesce(1).write.mode("append").json(inbox)  # late: it comes first in order
    follow("c")
    assert store.version().batches == {"inbox": 1} and store.version().number == 2
    follow("lost")  # the checkpoint is gone and all comes again as batch 0
    assert store.version().number == 2
    counted = {r.writer: r.n for r in store.load().select("writer", F.col("metadata.sample_count").alias("n")).collect()}
    assert counted == {"ada": 3, "cy": 1} and store.samples().count() == 4


REQUESTS = "writer string, seq long, context string, text string"


def told(df):
    return {(r.writer, r.context): (r.listed, r.words, r.status) for r in df.collect()}


def test_outcomes_of_requests_for_contexts(spark):
    samples = spark.createDataFrame([("ada", "work", "one " * 150), ("ada", " Work", "two " * 60), ("ada", "chat", "three " * 120), (None, "work", "four " * 200), ("ada", None, "five " * 300)], "writer string, context string, text string")
    asked = [
        ("ada", "WORK ", "more " * 9), ("ada", "chat", "six " * 50), ("ada", "Chat", "six " * 30), ("ada", "my notes", "seven " * 199), ("ada", "blank", "  "), ("ada", "blank", None),
        ("ada", None, "lost " * 300), ("ada", "  ", "lost " * 300), (None, "work", "x"), (None, "chat", "eight " * 200), ("new", "chat", "nine " * 200),
    ]
    requests = spark.createDataFrame(asked, "writer string, context string, text string")
    want = {
        ("ada", "work"): ("work", 210, "known"), ("ada", "chat"): ("work", 200, "started"), ("ada", "my-notes"): ("work", 199, "too short"), ("ada", "blank"): ("work", 0, "no text"),
        (None, "work"): ("work", 200, "known"), (None, "chat"): ("work", 200, "started"), ("new", "chat"): ("none yet", 200, "started"),
    }
    assert told(contexts.outcomes(samples, requests)) == want
    profiled = spark.createDataFrame([("ada",), (None,)], "writer string")
    assert told(contexts.outcomes(samples, requests, profiled)) == want | {("new", "chat"): ("none yet", 0, "no profile")}
    assert contexts.outcomes(samples, requests.limit(0)).isEmpty() and len(told(contexts.outcomes(samples.limit(0), requests))) == 7
    stored = contexts.kept(requests, contexts.outcomes(samples, requests, profiled)).groupBy("writer", "context").count().collect()
    assert {(r.writer, r.context): r["count"] for r in stored} == {("ada", "chat"): 2, ("ada", "my-notes"): 1, (None, "chat"): 1}


def test_a_missing_context_is_started_on_demand(spark, tmp_path):
    store = Store.open(spark, str(tmp_path))
    long = " ".join(t for w, s, c, t in fx.SAMPLES if w == "ada" and t) + " We said what we meant. " * 60
    request = lambda *rows: spark.createDataFrame(list(rows), REQUESTS)
    assert told(store.start_contexts(request(("ada", 0, "letters", long)), "t0"))["ada", "letters"][2] == "no profile" and not store.exists()
    store.add(texts(spark, ("ada",), (1, 2)), timestamp="t1")
    store.rebuild("t2")
    asked = request(("ada", 0, "Letters", long), ("ada", 1, "short", "Too few words."), ("bob", 0, "letters", long))
    got = told(store.start_contexts(asked, "t3"))
    assert got["ada", "letters"][2] == "started" and got["ada", "short"][1:] == (3, "too short") and got["bob", "letters"][2] == "no profile"
    one = store.load().collect()
    assert [r.writer for r in one] == ["ada"] and "letters" in [c.context for c in one[0].contexts] and "short" not in [c.context for c in one[0].contexts]
    assert one[0].metadata.sample_count == 4 and store.version().number == 2
    again = told(store.start_contexts(request(("ada", 0, "letters", long)), "t4"))
    assert again["ada", "letters"][2] == "known" and "letters" in again["ada", "letters"][0] and store.load().first().metadata.sample_count == 4
