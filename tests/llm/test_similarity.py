"""Jaccard join, vector search and vector near-duplicates against brute force; the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import jaccard_join as jj
from quarry.llm import packing, quality, toxicity, vector_dedup, vector_search
from quarry.llm.components import components, lookup
from quarry.llm.shingles import shingle_sets


def plain_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(ids, linked):
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(seed, groups, size):
    """Families of texts whose similarities lie around the threshold."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(groups):
        base = list(rng.choice(vocab, int(rng.integers(3, size))))
        for _ in range(int(rng.integers(1, 8))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(copy) // 25))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocab))
            if rng.random() < 0.3:
                copy = copy[: int(len(copy) * rng.uniform(0.7, 1))]
            docs.append(" ".join(copy))
    return docs


def brute_jaccard(docs):
    sets = {i: plain_sets(t) for i, t in docs}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, brute_components(ids, linked)


def test_shingles_equal_plain_sets():
    texts = ["a b c d e f", "A b C d E f", "one two", "", None, " \t\n", "x " * 3000, "é ß ñ ü ö word", "a\x0bb\x0cc d e f g"]
    assert [len(s) for s in shingle_sets(texts)] == [len(plain_sets(t)) for t in texts]
    s = shingle_sets(texts)
    assert (s[0] == s[1]).all() and len(shingle_sets([])) == 0


@pytest.mark.parametrize("size", [12, 60, 400])
def test_jaccard_against_brute_force(spark, size):
    docs = list(enumerate(near_copies(size, 40, size)))
    sets, want = brute_jaccard(docs)
    rows = jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}


def test_jaccard_hot_group_and_odd_rows(spark):
    base = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(5)
    docs = [(0, None), (1, ""), (2, "  "), (3, "two words"), (4, "TWO words"), (5, "x " * 30_000)]
    for i in range(10, 160):  # one large group whose members differ from each other
        copy = list(base)
        for at in rng.choice(120, 3, replace=False):
            copy[at] = f"z{rng.integers(1000)}"
        docs.append((i, " ".join(copy)))
    docs += [(i, " ".join(base)) for i in range(200, 260)]
    _, want = brute_jaccard(docs)
    rows = jj.jaccard_components(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    repeated = docs + [(3, "two words"), (3, "quite another text of seven words here"), (None, "two words")]
    rows = jj.jaccard_components(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
    assert len(rows) == len(repeated)
    assert {r.component_id for r in rows if r.doc_id == 4} == {3} and [r.component_id for r in rows if r.doc_id is None] == [3]
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_crossing_rounds(spark, monkeypatch):
    """Chains that lie beyond their stars' centres, with so few pairs a round that rounds repeat."""
    monkeypatch.setattr(jj, "NEAREST", 1)
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "OFTEN", 6)
    rng = np.random.default_rng(8)
    base, docs = [f"w{i}" for i in range(130)], []
    for family in range(3):
        text = [f"f{family}{w}" for w in base]
        for _ in range(45):  # each differs from the one before; the ends don't link
            text = list(text)
            for at in rng.choice(130, 2, replace=False):
                text[at] = f"z{rng.integers(10_000)}"
            docs.append(" ".join(text))
    docs = list(enumerate(docs))
    _, want = brute_jaccard(docs)
    rows = jj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_components_and_lookup(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1001 + i) for i in range(400)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in set(want) - set(got))
    rows = spark.createDataFrame([(1,)] * 40_000 + [(2,), (None,)], "k long")
    known = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert lookup(rows, "k", known).groupBy("v").count().orderBy("v").collect()[0]["count"] == 40_000
    assert lookup(rows, "k", known, "left").count() == 40_002


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def cloud(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n // 3):  # near copies at various distances
        x[n - 1 - k] = x[k % 7] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3, 0.5])
    return x.astype(np.float32)


ODD_VECTORS = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]


def test_vector_near_duplicates_against_brute_force(spark):
    x = cloud(1, 400)
    rows = [(i, v.tolist(), 1, "s") for i, v in enumerate(x)] + [(1000 + i, v, 1, "s") for i, v in enumerate(ODD_VECTORS)]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(vectors(spark, rows)).collect()}
    d = x.astype(np.float64)
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = brute_components(range(400), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    assert all(got[i].n_links == near[i].sum() - 1 and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(400))
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(ODD_VECTORS)))
    assert vector_dedup.near_duplicates(vectors(spark, [])).count() == 0
    a, b = x[0].tolist(), (x[0] * np.float32(1.5)).tolist()  # a vector without id is a neighbour like any other
    few = vector_dedup.near_duplicates(vectors(spark, [(None, a, 1, "s"), (5, b, 1, "s"), (5, b, 1, "s"), (9, x[1].tolist(), 1, "s")])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in few) == [(-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (9, 0, 9, True)]


def test_window_counts_are_collisions():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=(50, 5))
    assert (vector_dedup.count_collisions(a, b, 0.4) == (np.abs(a[:, None] - b[None]) <= 0.4).sum(axis=2)).all()
    need = vector_dedup.calibrate(16, 24, 1.0, 0.95, 0.0005)
    assert 1 <= need <= 24


def test_vector_search_recall_and_scores(spark):
    x = cloud(4, 3000)
    rows = [(i, v.tolist(), 1, "s") for i, v in enumerate(x)] + [(10_000 + 20 * i, v, 1, "s") for i, v in enumerate(ODD_VECTORS)] + [(40, x[40].tolist(), 1, "s")]
    from pyspark.sql import functions as F

    got = {}
    for r in vector_search.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    d, recall = x.astype(np.float64), []
    for query in range(0, 3000, 20):
        score = d @ d[query]
        score[query] = -np.inf
        best = set(np.lexsort((np.arange(3000), -score))[:20].tolist())
        found = sorted(got[query], key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and all(r.score == pytest.approx(score[r.vec_id], abs=1e-9) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        recall.append(len(best & {r.vec_id for r in found}) / 20)
    assert np.mean(recall) >= 0.9 and set(got) == set(range(0, 3000, 20))
    few = vector_search.search(vectors(spark, [(i, x[i].tolist(), 1, "s") for i in range(5)]), F.col("vec_id") % 20 == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == sorted(range(1, 5), key=lambda i: (-(d[i] @ d[0]), i))
    assert vector_search.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_against_plain_steps(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.train(docs, labels)
    rows = [(i, t) for i, t in rows if model.scores(*quality.bags([t]))[0] >= 0.5]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    civil = toxicity.train(kept, labels)
    rows = [(i, t) for i, t in rows if civil.score(t) < 0.3]
    _, groups = brute_jaccard(rows)
    rows = [(i, t) for i, t in rows if groups[i] == i]
    want = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 50
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in want})


def test_pipeline_stage_keeps_columns_and_one_of_repeated_rows(spark, sf):
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (2, "other words stand in this text", "y"), (None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r.quality_score for r in kept.collect()) == ["x", "y", "z"]
    assert corpus_pipeline.keep_good(spark, docs, sf).columns == docs.columns


def test_copies_of_vectors_do_not_grow_with_their_number(spark, monkeypatch):
    """Rows shuffled for a vector, with chunks so small that a few thousand vectors fill many."""

    def shuffled():  # by stage, of which Spark forgets old ones
        context = spark.sparkContext
        context._jsc.sc().listenerBus().waitUntilEmpty()
        none = context._gateway.new_array(context._jvm.double, 0)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {x.stageId(): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    monkeypatch.setattr(vector_dedup, "CHUNK", 32)
    rows = []
    for n in (1000, 4000):
        x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
        before = shuffled()
        assert vector_dedup.near_duplicates(vectors(spark, [(i, v.tolist(), 1, "s") for i, v in enumerate(x)])).where("n_links > 0").count() == 0
        rows.append(sum(x for k, x in shuffled().items() if k > max(before, default=-1)) / n)
    assert rows[1] < 2 * rows[0]


def test_pairs_at_the_threshold_share_a_cell(spark, monkeypatch):
    """Pairs just above the threshold, vectors alone, and a group that fills chunks of all kinds."""
    monkeypatch.setattr(vector_dedup, "CELL", 4)
    monkeypatch.setattr(vector_dedup, "MANY", 64)
    monkeypatch.setattr(vector_dedup, "CHUNK", 50)
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1500, 48)))
    z = rng.normal(size=(1000, 48))
    z = unit(z - (z * x[:1000]).sum(axis=1, keepdims=True) * x[:1000])
    group = unit(x[-1] + unit(rng.normal(size=(300, 48))) * 0.12)
    every = np.concatenate([x, 0.9501 * x[:1000] + np.sqrt(1 - 0.9501**2) * z, group]).astype(np.float32)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(vectors(spark, [(i, v.tolist(), 1, "s") for i, v in enumerate(every)])).collect()}
    u = unit(every.astype(np.float64))
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert vector_dedup.tables_for(len(every), 0.95, 0.0005)[1] >= 2
    assert sum(got[i].n_links == links[i] for i in range(1000)) >= 995
    assert all(got[i].n_links == links[i] for i in [*range(1000, 1499), *range(2500, 2800)])
