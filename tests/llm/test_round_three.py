"""Filter audit, rolling medians and language identification: brute force, defined cases, held-out accuracy."""

import datetime
import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from idiolect.llm import audit, language, rolling
from idiolect.llm.common import table

SF = "/root/testdata/sf0.001"


# --- 11


def failing(rows):
    """The letters that each (doc_id, text) fails."""
    found = []
    for doc_id, text, *_ in rows:
        words, text = (text or "").encode().split(), text or ""
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        f["E"] = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows)
        found.append({k for k, v in f.items() if v})
    return found


def plain_audit(rows, labels):
    fails, good, toxic = failing(rows), {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = [], {}
    parts = sorted({r[2] or "" for r in rows})
    for part in parts:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                here = [i for i in own if i not in gone and f in fails[i]]
                redundant = sum(1 for i in own if i in gone and f in fails[i])
                gone |= set(here)
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                ids = [rows[i][0] for i in here]
                out.append([part, "".join(order), step, f, len(own) - len(gone), len(here), redundant, sum(fails[i] == {f} for i in own), sum(i in good for i in ids), sum(i in toxic for i in ids)])
    return sorted(tuple([*r, shapley[r[0], r[3]]]) for r in out)


def test_audit_equals_brute_force_with_nulls_ties_and_copies(spark, monkeypatch):
    draw = random.Random(4)
    texts = ["", " ", None, "one two", "SHOUT " * 60, "a b c " * 30, " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(80)) + " 5%", "é è " * 40]
    rows = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice([None, "", "a", "b"]), 1) for _ in range(300)]
    labels = [(draw.choice([None, *range(40)]), draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Part int").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(rows, labels)
    for held in (audit.HELD, 400):
        monkeypatch.setattr(audit, "HELD", held)
        assert sorted(map(tuple, audit.audit(docs, known).collect())) == want, held
    assert audit.audit(docs.limit(0), known).count() == 0


def test_audit_chains_collide_and_small_chains_are_sent_often(monkeypatch):
    """Texts with one fingerprint are told apart by their full text; what a task sends is never more than it holds."""
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda raw: 7)
    rows = [(i, "p", f"text {(i or 0) % 4}".encode()) for i in (5, 3, 9, 1, 2, 8, 1, None, None)]
    for held in (1 << 20, 1):
        monkeypatch.setattr(audit, "HELD", held)
        sent = sorted(audit.routed(iter(rows)), key=lambda x: x[0])
        copies = sorted(d for d, _, m in audit.marked(iter(sent)) if m & audit.COPY)
        assert copies == [5, 9] and len(sent) == len(rows)


def test_audit_of_a_text_that_fills_the_table(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("the same text " * 500).alias("text"), F.lit("s").alias("source")).repartition(6)
    found = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").first()
    assert (found.removed, found.kept, found.unique_fails) == (1_999, 1, 0)


# --- 12

CLICKS = "click_id long, ts timestamp_ntz, kind string, value double, N int"
START = datetime.datetime(2024, 3, 31, 1, 0)


def plain_medians(rows):
    clicks = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2] is not None, r[2] or "")):
        clicks.setdefault(r[0], r)
    cents = {i: None if r[3] is None else int(np.floor(100 * r[3] + 0.5)) for i, r in clicks.items()}
    out = []
    for i, (_, ts, kind, *_) in clicks.items():
        v = sorted(cents[j] for j, o in clicks.items() if o[2] == kind and ts - datetime.timedelta(hours=1) < o[1] <= ts and cents[j] is not None)
        m = d = far = None
        if len(v) >= 2:
            m = int(2 * statistics.median(v))
            d = int(2 * statistics.median(abs(2 * c - m) for c in v))
            far = None if cents[i] is None else 2 * abs(2 * cents[i] - m) > 3 * d
        out.append((i, kind, len(v), m, d, far))
    return sorted(out, key=str)


def some_clicks(seed, n, minutes):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + datetime.timedelta(minutes=draw.randint(0, minutes) if draw.random() < 0.5 else draw.random() * minutes)
        value = draw.choice([None, 0.005, -0.005, 7.0, 7.0, round(draw.gauss(0, 50), 2), draw.random() * 1e6])
        rows.append((i, None if draw.random() < 0.03 else at, draw.choice([None, "", "a", "a", "a"]), value, i))
    return rows + [rows[k] for k in range(0, n, 9)]


@pytest.mark.parametrize(("sizes", "minutes"), [({}, 600), ({"hot": 0, "shard": 4, "block": 8}, 150), ({"hot": 40, "shard": 8, "block": 1_000}, 300), ({"hot": 0, "shard": 1_000, "block": 5}, 90)])
def test_medians_equal_brute_force(spark, sizes, minutes):
    rows = some_clicks(len(sizes) + minutes, 260, minutes)
    df = spark.createDataFrame(rows, CLICKS).repartition(3)
    assert sorted(map(tuple, rolling.medians(df, **sizes).collect()), key=str) == plain_medians(rows)


def test_medians_of_nothing_of_one_time_and_of_one_value(spark, monkeypatch):
    empty = spark.createDataFrame([], CLICKS)
    assert rolling.medians(empty).count() == 0
    lone = [(1, START, None, None, 0), (2, START, "a", 1.0, 0), (None, START, "b", 2.0, 0), (None, START, "b", 2.0, 0), (3, START, "c", float("nan"), 0)]
    assert sorted(map(tuple, rolling.medians(spark.createDataFrame(lone, CLICKS)).collect()), key=str) == sorted([(1, None, 0, None, None, None), (2, "a", 1, None, None, None), (None, "b", 1, None, None, None), (3, "c", 0, None, None, None)], key=str)
    monkeypatch.setattr(rolling, "SALTED", 50)
    one = [(i, START, "a", float(i % 3 == 0), 0) for i in range(300)] + [(1_000 + i, START + datetime.timedelta(seconds=i), "b", 5.0, 0) for i in range(300)]
    df = spark.createDataFrame(one, CLICKS)
    assert sorted(map(tuple, rolling.medians(df, hot=10, shard=7, block=20).collect()), key=str) == plain_medians(one)


def test_no_task_of_a_hot_series_has_all_of_it(spark, monkeypatch):
    """The second round brings a block the values of the few shards that it asks for, and no others."""
    n = 6_000
    rows = spark.range(n).select(F.col("id").alias("click_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 1.1 as decimal(18, 6)))").alias("ts"), F.lit("a").alias("kind"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100.0).alias("value"))
    told = rolling.members(rolling.unique(rows).withColumns({"own_hot": F.lit(True), "next_hot": F.lit(True)}), True)

    def counted(batches):
        import pyarrow as pa

        for (_, hour, block), columns in rolling.groups(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array([hour]), pa.array([block], pa.int32()), pa.array([columns[0].count(1)])], names=["hour", "block", "n"])

    real = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, *a, **k: real(self, counted, "hour long, block int, n long") if f is rolling.answered else real(self, f, schema, *a, **k))
    sizes = [r.n for r in rolling.hot_groups(told, n + 500, 64, 300).collect()]
    assert len(sizes) > 20 and 0 < max(sizes) < n / 4


# --- 13


def plain_phrases(symbols, reference):
    n = at = 0
    text, ref = "".join(map(chr, symbols)), "".join(map(chr, reference))
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in ref:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_phrases_are_longest_matches(spark):
    draw = random.Random(8)
    refs = {"x": "".join(draw.choice("abcd ") for _ in range(400)), "y": "".join(draw.choice("abef ") for _ in range(300)), "z": "b"}
    model = language.fit(refs)
    parser = language.Parser(model)
    lanes = [np.array([draw.randint(0, 7) for _ in range(draw.randint(1, 90))], np.uint8) for _ in range(60)]
    coded = {k: parser.codes[language.points(t)] for k, t in refs.items()}
    assert parser.phrases(lanes).tolist() == [[plain_phrases(lane, coded[k]) for k in sorted(refs)] for lane in lanes]
    whole = "abca" * 3_000  # three blocks
    pieces = [whole[i : i + language.BLOCK] for i in range(0, len(whole), language.BLOCK)]
    counts = sum(np.array([[plain_phrases(parser.codes[language.points(p)], coded[k]) for k in sorted(refs)]]) for p in pieces)[0] * np.array(model.bits)
    assert parser.predictions([whole])[0] == [sorted(refs)[int(np.argmin(counts))]]


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    found = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and text is not null").select("lang", "lang_pred", "score").collect()
    assert len(found) > 200 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_language_defined_cases(spark):
    rows = [(i, f"der die das und {i} nicht mit" if i % 2 else f"the and of to {i} in that", "de" if i % 2 else "en", "s") for i in range(80)]
    rows += [(1_000, None, "de", "s"), (1_001, "123 !? \n", None, "s"), (1_002, "", "en", "s"), (None, "the and of the", "de", "s"), (1_003, "das und die " * 30_000, None, "s"), (1_003, "das und die", None, "s"), (1_004, "Ж", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string")
    found = language.identify(docs).collect()
    at = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and at[1_000].lang_pred == at[1_001].lang_pred == at[1_002].lang_pred == "und" and at[1_000].score == 0
    assert at[1_003].lang_pred == "de" and at[None].lang_pred == "en" and at[None].held_out is False and at[1_004].lang_pred in ("de", "en")
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert all((r.lang_pred == "und") == (r.doc_id in (1_000, 1_001, 1_002)) for r in found)
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0
    # what is held out is never learned from
    odd = docs.withColumn("lang", F.when(language.remainder(F.col("doc_id")) == 2, "xx").otherwise(F.col("lang")))
    assert "xx" not in language.references(odd)
