"""Scoring, profiles, calibration, rendering and the log."""

import json

import pytest
from pyspark.sql import functions as F

from idiolect.operators import calibration, profile, render, scoring
from idiolect.plans import fixtures as fx
from idiolect.sources import evidence, files
from idiolect.streaming import evidence as stream

SCHEMA = "writer string, seq long, context string, text string"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    verdicts = fx.frame(spark, fx.VERDICTS, "writer string, seq long, formal string, plain string, chosen string")
    path = str(tmp_path_factory.mktemp("built") / "p")
    profile.build(fx.frame(spark, fx.SAMPLES, SCHEMA), verdicts).write.parquet(path)
    return spark.read.parquet(path)


def test_profiles(built):
    rows = {r.writer: r for r in built.collect()}
    assert set(rows) == {"ada", "ben", "cy"}
    ada = rows["ada"]
    assert [s.dimension for s in ada.style] == list(scoring.NAMES)
    assert ada.vocabulary.avoid[:2] == ["hence", "leverage"] and "thus" in ada.vocabulary.prefer and "thus" not in ada.vocabulary.avoid
    assert ada.notes.avoid_confirmed_by_choice == ["hence", "leverage"] and len(ada.vocabulary.avoid) <= 12
    assert [c.context for c in ada.contexts] == ["work"] and ada.contexts[0].metadata.sample_count == 2
    assert rows["ben"].metadata.sample_count == 2 and rows["cy"].contexts == []
    assert built.where(F.size(profile.errors(built)) > 0).count() == 0


def test_broken_profiles_name_every_fault(built):
    bad = built.withColumn("version", F.lit("x")).withColumn("structure", F.struct(F.lit("huge").alias("paragraph_length"), F.lit("low").alias("heading_preference"), F.lit("low").alias("bullet_preference")))
    assert {r.n for r in bad.select(F.size(profile.errors(bad)).alias("n")).collect()} == {2}


def test_json_and_save(spark, built, tmp_path):
    doc = json.loads(built.where("writer = 'ada'").select(profile.to_json(built).alias("j")).first().j)
    assert set(doc["style"]) == set(scoring.NAMES) and doc["version"] == "1.0" and "work" in doc["contexts"]
    profile.save(built, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    with pytest.raises(Exception, match="profile.version"):
        profile.save(built.withColumn("version", F.lit("x")), str(tmp_path / "q"))
    files.save_json(built, str(tmp_path / "j"))
    again = files.load_json(spark, str(tmp_path / "j")).select(built.columns)
    as_text = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())
    assert as_text(again) == as_text(built)


def test_context_overlay(built):
    flat = lambda df: {r.writer: {s.dimension: s.value for s in r.style} for r in df.collect()}
    own = {c.context: {s.dimension: s.value for s in c.style} for r in built.collect() if r.writer == "ada" for c in r.contexts}
    assert flat(profile.for_context(built, " Work "))["ada"] == own["work"]
    assert flat(profile.for_context(built, "nowhere")) == flat(built)


def test_unsure_dimensions_are_not_stated(built):
    for r in built.select("writer", "style", render.summary().alias("s"), render.instructions().alias("i"), render.report().alias("t")).collect():
        for s in r.style:
            phrase = render.PHRASES[s.dimension][min(4, max(0, -(-s.value // 20) - 1))]
            if s.confidence < render.THRESHOLD:
                assert f"- {phrase.capitalize()}." not in r.i and s.dimension in r.s
            else:
                assert f"- {phrase.capitalize()}." in r.i
        assert r.i.endswith("role-play a persona.") and "Samples analysed" in r.t


def test_contradictions(spark):
    rows = spark.createDataFrame([("a", 0, "formality", [50, 50, 50, 50, 50, 82]), ("b", 0, "formality", [20, 22, 78, 80]), ("b", 1, "warmth", [10])], "writer string, place int, dimension string, sample_values array<int>")
    found = scoring.contradictions(rows, ["writer"]).collect()
    assert [(r.writer, r.low, r.high, r.scatter) for r in found] == [("b", 20, 80, 29.0)]


def test_question_banks():
    firsts = [q.targets[0] for q in calibration.CALIBRATION]
    assert all(firsts.count(n) >= 2 for n in scoring.NAMES) and len(calibration.PAIRS) == 19


def test_selection_spreads_over_dimensions(spark):
    none = spark.createDataFrame([], "writer string, dimension string, confidence double")
    asked = spark.createDataFrame([], "writer string, seq long, question_id string")
    picked = calibration.select_questions(none, asked, fx.frame(spark, [("w",)], "writer string")).orderBy("round").collect()
    by_id = {q.id: q for q in calibration.CALIBRATION}
    assert len({by_id[r.question_id].targets[0] for r in picked}) == 3
    every = [("w", i, q.id) for i, q in enumerate(calibration.CALIBRATION)]
    assert calibration.rank_questions(none, fx.frame(spark, every, "writer string, seq int, question_id string"), fx.frame(spark, [("w",)], "writer string")).count() == 0


def test_bad_choices_are_refused(spark):
    with pytest.raises(Exception, match="not a choice"):
        calibration.scripted_choices(fx.frame(spark, [("w", 1, "choice_thus", "perhaps")], "writer string, seq long, pair_id string, answer string")).collect()


def test_splice_is_idempotent(spark):
    df = fx.frame(spark, [("a\n",), ("",)], "existing string")
    block = F.lit("\n".join([render.markers()[0], "x", render.markers()[1]]))
    once = df.select(render.splice(F.col("existing"), block)["text"].alias("existing"))
    twice = once.select(render.splice(F.col("existing"), block).alias("s")).select("s.*").collect()
    assert [r.text for r in twice] == [r.existing for r in once.collect()] and {r.action for r in twice} == {"replaced"}


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    assert evidence.read(spark, path).count() == 0
    texts = fx.frame(spark, [(1, "file", "  One secret sentence about zebras here.  ", "Work")], "seq long, source string, text string, context string")
    made = evidence.records(texts, "writing_sample", F.lit("t"))
    evidence.append(made, path)
    evidence.append(evidence.choice_records(calibration.scripted_choices(fx.frame(spark, fx.CHOICES, "writer string, seq long, pair_id string, answer string")), F.lit("t")), path)
    got = evidence.read(spark, path)
    assert got.count() == 6 and evidence.verdicts(got).count() == 5
    line = spark.read.text(path).where("value like '%writing_sample%'").first().value
    assert "secret sentence" not in line and json.loads(line)["meta"]["context"] == "work" and json.loads(line)["word_count"] == 6
    joined = evidence.labelled_samples(got, made.select("text_ref", "text")).collect()
    assert [(r.text, r.context) for r in joined] == [("One secret sentence about zebras here.", "work")]


def test_stream_counts_each_sample_once(spark, tmp_path):
    texts, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        spark.createDataFrame([(f"{k}{i}", "Some words to count here.") for i in range(3)], "id string, text string").write.mode("append").json(texts)
        stream.keep_features(spark, texts, out, check, ["id"], "id string, text string").awaitTermination()
    assert spark.read.parquet(out).count() == 6 and {r.word_count for r in spark.read.parquet(out).collect()} == {5}


def test_documents_have_defaults_and_every_fault_is_named(spark):
    df = spark.createDataFrame([("a", "{}"), ("b", '{"profile_id": "x", "style": {"warmth": {"value": 5, "confidence": 0.5}}, "vocabulary": {"prefer": ["so"]}}')], "writer string, json string")
    a, b = profile.parsed(df).orderBy("writer").collect()
    assert (a.version, a.profile_id, a.style, a.punctuation, a.contexts) == ("1.0", "", [], {}, []) and a.vocabulary.prefer is None and a.metadata.word_count is None
    assert [tuple(s) for s in b.style] == [("warmth", 5, 0.5)] and b.vocabulary.prefer == ["so"] and b.profile_id == "x"
    assert len(df.select(profile.schema.errors(F.col("json")).alias("e")).first().e) == 4


def test_profiles_are_rebuilt_from_the_log(spark, built, tmp_path):
    from idiolect import Store

    store = Store.open(spark, str(tmp_path))
    assert store.load() is None and store.samples().count() == 0
    rows = [(w, s, "f", c, t) for w, s, c, t in fx.SAMPLES]
    texts = spark.createDataFrame(rows, "writer string, seq long, source string, context string, text string")
    store.add(texts.where("seq > 1"), timestamp="2024-01-01T00:00:00+00:00")
    store.add(texts.where("seq = 1"), timestamp="2024-01-02T00:00:00+00:00")
    store.add_choices(spark.createDataFrame([(w, s, f"choice_{f}", f, p, c) for w, s, f, p, c in fx.VERDICTS], "writer string, seq long, pair_id string, formal string, plain string, chosen string"), "2024-01-03T00:00:00+00:00")
    first = store.rebuild("2024-02-01T00:00:00+00:00")
    times = ["created_at", "updated_at"]
    as_text = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.withColumn("metadata", F.col("metadata").dropFields(*times)).collect())
    assert as_text(first) == as_text(built.select(first.columns)) and {tuple(r) for r in first.select("metadata.created_at", "metadata.updated_at").collect()} == {("2024-02-01T00:00:00+00:00",) * 2}
    store.add(fx.frame(spark, [("dee", 1, "f", None, "One more writer. It is short.")], texts.schema.simpleString()[7:-1].replace(":", " ")), timestamp="2024-02-02T00:00:00+00:00")
    again = {r.writer: (r.metadata.created_at, r.metadata.updated_at) for r in store.rebuild("2024-03-01T00:00:00+00:00").collect()}
    assert again["ada"] == ("2024-02-01T00:00:00+00:00", "2024-03-01T00:00:00+00:00") and again["dee"] == ("2024-03-01T00:00:00+00:00",) * 2 and len(again) == 4


def test_block_in_a_file(spark, tmp_path):
    from idiolect.sources.store import write_block

    start, end = render.markers()
    path = tmp_path / "A.md"
    assert write_block(str(path), f"{start}\none\n{end}", spark=spark) == "created"
    path.write_bytes(b"# T\r\n" + path.read_bytes())
    assert write_block(str(path), f"{start}\ntwo\n{end}", spark=spark) == "replaced" and b"two" in path.read_bytes() and b"one" not in path.read_bytes()
    path.write_text(f"{start}\n")
    with pytest.raises(ValueError, match="without an end"):
        write_block(str(path), "x", spark=spark)
    path.write_bytes(b"\xff")
    with pytest.raises(ValueError, match="UTF-8"):
        write_block(str(path), "x", spark=spark)
