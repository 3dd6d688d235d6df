"""SimHash, components, WARC, suffix dedup, decontamination, classifier and the pipeline."""

import hashlib
import math
import random

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from idiolect.llm import bpr, classifier, decontam, graph, quality, secrets, simhash, warc
from idiolect.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(ids, fps, most=3):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(root(i), []).append(d)
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


def near_texts():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "one two"]
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(8):
            other = list(base)
            other[draw.randrange(len(other))] = draw.choice(words)
            texts.append(" ".join(other).upper() if draw.random() < 0.3 else " ".join(other))
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("tile", [3, 1024])
def test_simhash_matches_brute_force(spark, tile):
    texts = near_texts()
    ids = [None if i == 7 else 1000 - i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, fp string").withColumn("row", F.lit(1))
    got = sorted(simhash.near_duplicates(df, tile=tile).collect(), key=str)
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(zip(ids, (f"{f:016x}" for f in fps), plain_components(ids, fps)), key=lambda r: str(r))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_every_allocation_finds_all_links(spark):
    draw = random.Random(8)
    fps = set()
    for _ in range(30):
        f = draw.getrandbits(64)
        fps.add(f)
        for k in range(4):
            g = f
            for b in draw.sample(range(64), k + 1):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    for parts in ([(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(64)), 3)] if False else [(list(range(0, 64, 2)), 2), (list(range(1, 64, 2)), 0)], [(list(range(16 * i, 16 * i + 16)), 0) for i in range(4)]):
        edges = simhash.links(simhash.tiled(simhash.probes(nodes, parts), 50))
        assert {(min(r.u, r.v), max(r.u, r.v)) for r in edges.collect()} <= want
        roots = {r.node: r.root for r in graph.components(edges).collect()}
        assert all(roots[a] == roots[b] for a, b in want)


def test_thresholds_are_a_generalised_pigeonhole():
    import numpy as np

    for n in (1_000, 1_000_000, 10**9):
        both = np.full((64, 64), n / 4)
        np.fill_diagonal(both, n / 2)
        parts = simhash.allocate(n, both)
        groups = [simhash.grouped(n, both, m) for m in range(2, 7)]
        assert all(sorted(b for g in gs for b in g) == list(range(64)) for gs in groups)
        m = next(len(gs) for gs in groups if all(g in gs for g, _ in parts))
        assert sum(t for _, t in parts) - (m - len(parts)) == 3 - m + 1


def test_few_edges_take_few_jobs_and_give_what_rounds_give(spark, monkeypatch):
    """A round is a plan of many shuffles: on tables with large groups of copies the rounds' plans and tasks filled the driver."""
    rng = random.Random(5)
    pairs = [(a, a + 1) for a in range(1_000, 1_400)] + [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    edges, counter = spark.createDataFrame(pairs, "u long, v long").repartition(7), spark.sparkContext.statusTracker()
    try:
        spark.sparkContext.setJobGroup("few-edges", "components of few edges")
        few = {r.node: r.root for r in graph.components(edges).collect()}
        assert len(counter.getJobIdsForGroup("few-edges")) <= 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(graph, "EDGES", 0)
    assert few == {r.node: r.root for r in graph.components(edges).collect()}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5), (-3, 1000), (1, 0)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == -3 for i in range(1000, 1100)) and got[-3] == -3
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hubs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIGHT", 5)
    edges = [(0, x) for x in range(1, 400)] + [(x, 1000 + x) for x in range(1, 300)] + [(5000, 5001 + x) for x in range(90)] + [(5000, 399)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(9)).collect()}
    assert len(got) == 400 + 299 + 91 and set(got.values()) == {0}
    rows = spark.createDataFrame([(k % 7 if k < 50 else 9, k) for k in range(300)], "k long, v long")
    assert all(r.low == (r.k if r.k < 7 else 50) for r in graph.with_least(rows, "k", "v", "low", 300).collect())
    docs = spark.createDataFrame([(k, "a b c d" if k % 3 else f"x{k} y{k} z") for k in range(120)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[k] == (1 if k % 3 else k) for k in range(120))


def test_chance_of_few_differences_follows_the_chain():
    import numpy as np

    draw = np.random.default_rng(1)
    bits = draw.random((4000, 3)) < 0.4
    bits[:, 1] = np.where(draw.random(4000) < 0.9, bits[:, 0], bits[:, 1])
    both = np.zeros((64, 64))
    both[:3, :3] = bits.T.astype(float) @ bits
    a, b = draw.integers(0, 4000, 200_000), draw.integers(0, 4000, 200_000)
    differ = (bits[a] != bits[b]).sum(axis=1)
    assert np.allclose(simhash.within(4000, both, [0, 1, 2], 3), [(differ <= t).mean() for t in range(4)], atol=0.01)


def test_warc_round_trip_in_segments(spark):
    pages = [(1, "http://a", "x" * 5000), (2, "http://b", "x" * 5000), (3, None, "é" * 999), (4, "u\r\nv", None), (5, "e", ""), (5, "e", ""), (6, "f", "WARC/1.1\r\n\r\n0\r\n\r\n"), (None, "n", "x" * 5000), (7, "g", "unique")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1)
    got = warc.round_trip(df, segment=700)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        str((i, len((h or "").encode()), warc.sha1((h or "").encode()), "response" if i in (2, 3, 5, 6, 7) else "revisit", None if i in (2, 3, 5, 6, 7) else (2 if h and h[0] == "x" else 5)))
        for i, _, h in pages
    )
    alone = warc.round_trip(df, smallest=100).where("record_type = 'revisit'")
    assert sorted((str(r.page_id), r.refers_to) for r in alone.collect()) == [("1", 2), ("None", 2)]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_notices_a_lost_segment(spark):
    parts = warc.records("7", "7", "u", warc.sha1(b"y" * 3000), 3000, None, None, b"y" * 3000, segment=500)
    assert [n for n, _ in parts] == list(range(1, len(parts) + 1)) and b"WARC-Segment-Total-Length" in parts[-1][1]
    path = warc.scratch(spark, "broken")
    spark.createDataFrame([(bytearray(b),) for n, b in parts if n != 2], "b binary").selectExpr("cast(b as string) value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="missing or repeated"):
        warc.read(spark, path).collect()


def plain_repeats(rows, length=50):
    order = [(bpr.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, x in order:
        for i in range(len(x) - length + 1):
            first[x[i : i + length]] = min(first.get(x[i : i + length], d), d)
    out = []
    for (d, x), (raw, _) in zip(order, rows):
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((raw, len(x), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_matches_brute_force(spark, seed):
    draw = random.Random(seed)
    atoms = ["".join(draw.choice("abé") for _ in range(draw.randint(20, 70))) for _ in range(12)]
    rows = [(draw.randint(0, 40) if draw.random() < 0.95 else None, "".join(draw.choice(atoms) if draw.random() < 0.6 else draw.choice("abc ") * draw.choice((1, 1, 3, 60)) for _ in range(draw.randint(0, 30)))) for _ in range(80)]
    rows += [(100, None), (101, ""), (102, "short"), (103, rows[0][1]), (103, rows[0][1]), (104, "ab" * 200), (105, "ab" * 120), (105, "a" * 50), (106, "a" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = bpr.remove_repeats(df, bucket_bytes=3_000)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_repeats(rows)))
    assert bpr.remove_repeats(df.limit(0)).count() == 0
    texts = bpr.remove_repeats(df.withColumnRenamed("doc_id", "b").withColumn("uid", F.lit(1)), "b", bucket_bytes=3_000, with_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in texts)


def test_anchors_by_blocks_are_those_of_the_whole():
    import numpy as np

    draw = random.Random(3)
    for n in (0, 10, 49, 50, 51, 300, 5_000):
        raw = bytes(draw.choice(b"ab") if draw.random() < 0.9 else draw.randrange(256) for _ in range(n))
        at, h = bpr.anchors(np.frombuffer(raw, np.uint8), np.array([n]))
        for block in (1, 64, 700):
            got_at, got_h = bpr.anchors_of(raw, bpr.LENGTH, bpr.Q, block)
            assert got_at.tolist() == at.tolist() and got_h.tolist() == h.tolist()


def test_contexts_cut_again_and_classes_checked_by_bytes(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(4)
    data = draw.integers(97, 99, 4_000).astype(np.uint8)
    starts, own = np.array([0, 1_500, 1_500, 4_000]), draw.choice([0, 2], 900)
    at = draw.integers(0, np.diff(starts)[own] - bpr.Q)
    kept = bpr.Contexts(starts, data, own, at, bpr.LENGTH, bpr.Q)
    monkeypatch.setattr(bpr, "KEPT_BYTES", 0)
    again = bpr.Contexts(starts, data, own, at, bpr.LENGTH, bpr.Q)
    every = np.arange(len(at))
    assert again.kept is None and np.array_equal(kept.rows(every), again.rows(every))
    rows = np.concatenate([kept.rows(every)] * 2)
    exact = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    for one in (np.zeros(len(rows), np.uint64), bpr.class_keys(rows)[0]):  # hashes that clash, and good ones
        order, group = bpr.classes_of(lambda i: rows[i], len(rows), one, one)
        found = np.empty(len(rows), np.int64)
        found[order] = group
        assert len({(a, b) for a, b in zip(found.tolist(), exact.tolist())}) == len(set(exact.tolist())) == len(set(found.tolist()))


def test_a_long_text_costs_little_memory_beside_itself():
    import tracemalloc

    import numpy as np

    raw = np.random.default_rng(1).integers(97, 123, 20 << 20).astype(np.uint8).tobytes()
    tracemalloc.start()
    at, h = bpr.anchors_of(raw, bpr.LENGTH, bpr.Q, bpr.CHUNK_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) > len(raw) // 30 and peak < 10 * len(raw)


def edits(p, t):
    """Least edits of p against any substring of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_alignment(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 25, 12, 40, 30, 8))] + [(6, None), (7, " "), (8, "xyz"), (9, "Große  Übung " * 5)]
    docs = [None, "", "xyz", "has Xyz inside"]
    for i, t in items:
        for rate in (0, 0.05, 0.09, 0.2, 0.5):
            x = list(decontam.normal(t or ""))
            for _ in range(int(rate * len(x))):
                k = draw.randrange(len(x))
                x[k : k + 1] = draw.choice(["", "z", x[k] + "q"])
            docs.append(" ".join(word() for _ in range(draw.randint(0, 40))) + "  " + "".join(x).upper() + "\n" + word())
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: dict(zip(r["items"], r["edits"])) for r in decontam.flags(df, bench).collect()}
    passages = [(i, decontam.normal(p)) for i, p in items if p and p.split()]
    for d, t in enumerate(docs):
        least = {i: edits(p, decontam.normal(t or "")) for i, p in passages}
        assert got[d] == {i: n for (i, n), (_, p) in zip(least.items(), passages) if n <= len(p) // 10}, (d, t)
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == {d for d in got if not got[d]}
    assert decontam.flags(df.limit(0), bench).count() == 0 and not any(r.contaminated for r in decontam.flags(df, bench.limit(0)).collect())


def edited(draw, text, n):
    x = list(text)
    for _ in range(n):
        k = draw.randrange(len(x))
        x[k : k + 1] = draw.choice(["", "#", x[k] + "#"])
    return "".join(x)


@pytest.mark.parametrize("segment", [50, 1 << 17])
def test_recall_is_whole_at_the_declared_budget(monkeypatch, segment):
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n - 2)).join("xy")
    expected = 0
    for m in [*range(8, 90), *range(95, 201, 15)]:
        items = [(k, decontam.normal(text(m))) for k in range(4)]
        index = decontam.Passages(items)
        for k, t in items[:2]:
            whole = decontam.normal(text(draw.randint(2, 80)) + edited(draw, t, decontam.budget(len(t))) + text(draw.randint(2, 80)))
            found = {i: n for i, n, _ in index.hits(whole.encode())}
            for i, p in (items[k], items[3]):
                least = edits(p, whole)
                assert found.get(i) == (least if least <= len(p) // 10 else None), (m, p, whole)
                expected += least <= len(p) // 10
    assert expected > 150


def test_every_length_has_a_gram_size():
    for m in range(10, 3000):
        e = decontam.budget(m)
        q = decontam.size_for(m, e)
        assert m - q + 1 - q * e >= 1 and q >= 3


def test_blocks_one_by_one_give_the_same(spark):
    draw = random.Random(4)
    items = [(i, "".join(draw.choice("abcdefgh ") for _ in range(60)) + "z") for i in range(12)] + [(2, "again the same id with another text")]
    docs = [None, "", *(f"so {edited(draw, t, 3)} and {items[draw.randrange(12)][1]} on" for _, t in items)]
    df = spark.createDataFrame([(i // 2, t, 1, "k") for i, t in enumerate(docs)], "doc_id long, text string, row int, HITS string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontam.flags(df, bench, block_chars=n).collect())) for n in (1 << 20, 100))
    assert one == many and len(one) == len(docs)
    assert sorted(map(str, decontam.clean(df, bench, block_chars=100).collect())) == sorted(map(str, decontam.clean(df, bench).collect()))
    assert decontam.clean(df, bench).columns == df.columns


def test_benchmark_blocks_cover_all_items(spark):
    bench = spark.createDataFrame([(i, "p" * 30 + str(i)) for i in range(9)], "item_id long, text string")
    found = list(decontam.blocks(bench, "item_id", "text", most=70))
    assert [i for b in found for i, _ in b] == list(range(9)) and max(len(b) for b in found) == 2


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(classifier.sample(docs, labels.where("doc_id % 3 > 0")))
    held = docs.join(classifier.grades(labels), "doc_id").where("doc_id % 3 = 0").toPandas()
    tails = [model.tails(model.score(t.encode())) for t in held.text]
    good = [(t[1] >= 0.5) == (g == 2) for t, g in zip(tails, held.grade)]
    assert sum(good) >= 0.9 * len(good), sum(good) / len(good)
    assert model.cuts[0] <= model.cuts[1]


def test_gradients_are_those_of_the_likelihood():
    import numpy as np

    draw = np.random.default_rng(3)
    s, y, cuts = draw.normal(0, 2, 40), draw.integers(0, 3, 40), np.array([-0.7, 0.9])
    value, by_score, by_cut = classifier.loss(s, y, cuts)
    sig = lambda x: 1 / (1 + math.exp(-x))
    chance = lambda x, g: (sig(x - cuts[0]) if g else 1.0) * 1 - (0 if g else sig(x - cuts[0])) if g != 1 else sig(x - cuts[0]) - sig(x - cuts[1])
    plain = -sum(math.log(sig(x - cuts[1]) if g == 2 else chance(x, g)) for x, g in zip(s, y)) / 40
    assert abs(value - plain) < 1e-9
    step = 1e-6
    for k in range(40):
        up, down = s.copy(), s.copy()
        up[k] += step
        down[k] -= step
        assert abs((classifier.loss(up, y, cuts)[0] - classifier.loss(down, y, cuts)[0]) / (2 * step) - by_score[k]) < 1e-6
    for k in range(2):
        up, down = cuts.copy(), cuts.copy()
        up[k] += step
        down[k] -= step
        assert abs((classifier.loss(s, y, up)[0] - classifier.loss(s, y, down)[0]) / (2 * step) - by_cut[k]) < 1e-6


def test_scores_are_the_plain_formula_and_the_fit_is_good(spark):
    import numpy as np
    import zlib

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.sample(docs, labels)
    model = classifier.fit(rows)
    got = {r.doc_id: r for r in classifier.scores(docs, model).collect()}
    for r in docs.collect():
        words = {w.strip(b".,;:!?\"'()[]") for w in r.text.encode().lower().split()}
        buckets = {zlib.crc32(w) >> (32 - classifier.BITS) for w in words}
        s = sum(model.words[b] for b in buckets) + sum(a * b for a, b in zip(classifier.features(r.text.encode())[1], model.shape))
        tails = [1 / (1 + math.exp(-(s - c))) for c in model.cuts]
        assert abs(got[r.doc_id].tail - tails[1]) < 2e-6 and abs(got[r.doc_id].expected_grade - sum(tails)) < 4e-6
        assert got[r.doc_id].selected == (round(tails[1], 6) >= 0.5)
    y = rows["grade"].to_numpy()
    s = np.array([sum(model.words[b] for b in ids) + np.dot(shape, model.shape) for ids, shape in zip(rows["ids"].to_pylist(), rows["shape"].to_pylist())])
    assert classifier.loss(s, y, model.cuts)[0] < 0.6 * classifier.loss(np.zeros(len(y)), y, np.linspace(-1, 1, 2))[0]


def test_sample_is_bounded_whatever_the_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b")], "doc_id long, text string").withColumn("grade", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert classifier.sample(docs, labels, rows=10).num_rows == 10
    assert classifier.sample(docs, labels, rows=10) == classifier.sample(docs.repartition(7), labels, rows=10)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "a b", None)], "doc_id long, text string, tail double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = classifier.fit(classifier.sample(docs, none))
    assert {r.expected_grade for r in classifier.scores(docs, model).collect()} == {1.0}
    assert classifier.scores(docs.limit(0), model).count() == 0


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline
    import tiktoken  # noqa: F401

    from idiolect.llm import bpe

    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    docs = [(d, t) for d, t in docs if not any(r.rejects(quality.Text(t.encode())) for r in quality.RULES)]
    component = plain_components([d for d, _ in docs], [plain_fingerprint(t) for _, t in docs])
    docs = [x for x, c in zip(docs, component) if x[0] == c]
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if not any(p in decontam.normal(t) for p in items)]  # the table has whole copies
    hidden = secrets.redact(spark.createDataFrame(docs, "doc_id long, text string"), secrets.train(secrets.bundled(spark))).collect()
    coder = bpe.coder(bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    want = {r.doc_id: (len(ids := coder.core.encode_ordinary(r.text)), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()) for r in hidden}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < 200


def test_pipeline_stages_keep_columns_and_empty_tables(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, None, "en", "a", 0, "x"), (2, "w " * 3, "en", "b", 6, "y")], "doc_id long, text string, lang string, source string, n_chars long, rank string")
    for rows in (docs, docs.limit(0)):
        out = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns, name
            assert out.count() == 0
