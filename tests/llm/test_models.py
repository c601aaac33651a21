"""Toxicity, quality and language model: held-out results and exact base scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import maxent, quality, toxicity
from quarry.llm.labelled import labelled_sample
from quarry.session import Scratch

SCHEMA = "doc_id long, text string, score double, toxic_score string"
BIG = "/root/testdata/sf0.01"


def held(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def odd_documents(spark):
    return spark.createDataFrame([(1, None, 0.0, "a"), (2, "", 0.0, "a"), (3, "word " * 40_000, 0.0, "a"), (3, "same id", 0.0, "a"), (3, "same id", 0.0, "a"), (None, "no id", 0.0, "a")], SCHEMA)


def test_windows_cover_whole_texts():
    text = "The quick brown fox " * 30
    parts = toxicity.windows(text)
    assert b"".join(p[:-1] for p in parts) + b" " == toxicity.spelled(text)
    assert toxicity.windows(None) == [b"  "]
    for text in ("x" * 5000, "漢字仮名" * 700, "spaced words then " + "y" * 3000 + " and more words " * 20):  # scripts without spaces
        parts = toxicity.windows(text)
        assert max(map(len, parts)) <= toxicity.LONGEST + 1 and len(parts) >= len(text) // toxicity.LONGEST
        assert sum(map(len, parts)) >= len(toxicity.spelled(text))


def test_toxicity_finds_words_it_learnt():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioubcdfg"), 6)) for _ in range(300)]
    plain = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    toxic = [" ".join([*rng.choice(words, 30), *rng.choice(["grumbleton", "snarkwort"], 3), *rng.choice(words, 30)]) for _ in range(80)]
    model = toxicity.fit(toxic[:60], plain[:90])
    assert np.mean([model.score(t) for t in toxic[60:]]) > 0.7
    assert np.mean([model.score(t) for t in plain[90:]]) < 0.3
    assert toxicity.fit([], plain).score("x") == 0.0 and toxicity.fit(toxic, []).score("x") == 1.0


def test_toxicity_on_odd_documents(spark):
    model = toxicity.fit(["bad snarkwort here"] * 8, ["good words here now"] * 8)
    rows = toxicity.score_documents(odd_documents(spark), model, ["doc_id", "text", "score"]).collect()
    assert len(rows) == 6 and all(0 <= r.toxic_score <= 1 for r in rows)
    assert rows[0].toxic_score == rows[1].toxic_score
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score_documents(empty, model, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(empty, labels).score("anything") == 0.0


def test_quality_gradients():
    rng = np.random.default_rng(1)
    model = quality.MilModel(seed=3)
    x, starts, y = rng.normal(0, 1, (7, quality.WIDTH)), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    def loss():
        p = model.scores(x, starts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    gradients = model.gradients(x, starts, y)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        at = int(np.abs(gradients[name]).argmax())
        before, step = flat[at], 1e-5
        flat[at] = before + step
        up = loss()
        flat[at] = before - step
        down = loss()
        flat[at] = before
        assert gradients[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=1e-3)


def test_quality_passages_cover_whole_texts():
    text = "word and more\n" * 900
    parts = quality.passages(text)
    assert b"".join(parts) == text.encode() and len(parts) > 5
    assert quality.passages(None) == [b""] and b"".join(quality.passages("y" * 9000)) == b"y" * 9000


def test_quality_on_odd_documents(spark):
    good = [f"A fine sentence number {i} about things." for i in range(40)]
    bad = ["BUY!! NOW!! " * (i % 5 + 3) for i in range(40)]
    model = quality.fit(good, bad)
    assert model.scores(*quality.bags(["A fine sentence about other things."]))[0] > 0.5
    assert model.scores(*quality.bags(["SELL!! FAST!! SELL!! FAST!!"]))[0] < 0.5
    rows = quality.score_documents(odd_documents(spark), model, ["doc_id"]).collect()
    assert len(rows) == 6 and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.fit([], []).scores(*quality.bags(["x"]))[0] == 1.0
    assert quality.score_documents(spark.createDataFrame([], SCHEMA), model, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    for query, label, least in ((quality.op10, "quality", 0.95), (toxicity.op2, "toxic", 0.85)):
        rows = [r for r in query(spark, BIG).collect() if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in rows]) >= least
        modulus, held_value = (3, 1) if label == "quality" else (4, 2)
        assert all(held(r.doc_id, modulus) == held_value for r in rows)


def test_sample_leaves_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1)], "doc_id long, toxic int")
    texts, counts = labelled_sample(docs, labels, "toxic", 4, 2, {0: 100, 1: 5})
    assert len(texts[1]) == 5 and counts[1] == sum(held(i, 4) != 2 for i in range(60) if i % 2)
    assert set(texts[0]) == {f"text {i}" for i in range(2, 60, 2) if held(i, 4) != 2}  # 0 has two labels
    kept = docs.where("doc_id > 30").withColumn("text", F.expr("CASE WHEN doc_id % 4 = 0 THEN repeat('long text ', 30000) ELSE text END"))
    texts, counts = labelled_sample(kept, labels, "toxic", 4, 2, {0: 100, 1: 100})
    assert counts[0] == len(texts[0]) == sum(held(i, 4) != 2 for i in range(32, 60, 2))  # a stage's own rows, of any length
    assert max(map(len, texts[0])) == 300_000


def corpus(spark, parts):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10 = 0").alias("held_out"))
    return docs.repartition(parts)


def small_model(spark, docs):
    scratch = Scratch(spark)
    training = docs.where("NOT held_out")
    counts = maxent.count_words(training)
    v = maxent.learn_vocabulary(counts, training.count())
    coded = scratch.write(maxent.encode_documents(docs, v, 3), "coded")
    return coded, counts, *maxent.train(coded, v, 3, scratch)


def test_model_is_a_distribution_and_scores_are_its_sums(spark):
    """Scores against a plain loop over dictionaries; probabilities of all words sum to one."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(vocab[int(k)] for k in (rng.integers(0, 8) + np.cumsum(rng.integers(0, 5, rng.integers(0, 40)))) % 60), i % 10 == 0) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    coded, counts, m, shared = small_model(spark, docs)
    v = m.vocabulary
    assert len(m.codes) > 100 and np.isfinite(m.scales).all()
    pairs = dict(zip(m.codes.tolist(), m.weights.tolist()))

    def log_p(target, one, two):
        c = int(v.classes[target])
        z = v.class_share + m.scales[m.often[0][one]] * m.previous[one] + m.scales[maxent.SCALES + m.often[1][two]] * m.skipped[two]
        out = z[c] - math.log(np.exp(z).sum())
        members = [w for w in range(len(v.ids) + 1) if v.classes[w] == c]
        u = {w: v.share[w] + pairs.get(one * maxent.TARGETS + w, 0.0) for w in members}
        return out if target == maxent.COMMON else out + u[target] - math.log(sum(map(math.exp, u.values())))

    for one, two in ((0, 0), (5, 3), (17, 9), (maxent.COMMON + 5, 2)):
        every = [*range(len(v.ids) + 1), maxent.COMMON]
        assert sum(math.exp(log_p(t, one, two)) for t in every) == pytest.approx(1, abs=1e-3)
    rest = math.log10(0.1 / (v.rest_n + 0.1 * (v.rest_v + 1)))
    for r in maxent.score_documents(coded, counts, m, shared).collect():
        tokens = [v.ids.get(w, None) for w in rows[r.doc_id][1].split()] + [0]
        tokens = [maxent.COMMON if t is None else t for t in tokens]
        want = sum(log_p(t, ([0, 0] + tokens)[k + 1], ([0, 0] + tokens)[k]) / math.log(10) + rest * (t == maxent.COMMON) for k, t in enumerate(tokens))
        assert r.score == pytest.approx(want, rel=1e-4)


def test_gradients_of_the_scales(spark):
    rng = np.random.default_rng(0)
    v = maxent.Vocabulary([f"w{i}" for i in range(500)], list(range(500, 0, -1)), 50, 125_300, 501)
    m = maxent.Model(v)
    m.previous[:600] = rng.normal(0, 1, (600, maxent.CLASSES))
    m.skipped[:600] = rng.normal(0, 1, (600, maxent.CLASSES))
    m.often[:, :600] = rng.integers(0, maxent.SCALES, (2, 600))
    tokens = rng.integers(0, 501, 300)
    one, two = maxent.history(tokens, np.array([0, 120, 300]))
    found = m.gradients(tokens, one, two)
    for k in (0, 3, 9, 15):
        def loss(x):
            before, m.scales[k] = m.scales[k], m.scales[k] + x
            value, slope = m.log10(tokens, one, two).sum() * math.log(10), m.gradients(tokens, one, two)[0]
            m.scales[k] = before
            return value, slope
        (up, up_slope), (down, down_slope) = loss(1e-3), loss(-1e-3)
        assert found[0][k] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-2)
        assert found[1:][k] == pytest.approx(-(up_slope - down_slope) / 2e-3, rel=2e-2, abs=2e-1)


def test_pair_weights_meet_their_counts():
    share = np.array([0.1, 0.2, 0.05, 0.3])
    n, total, group = np.array([40.0, 10, 5, 60]), np.array([60.0, 60, 60, 100]), np.array([0, 0, 0, 1])
    w, z = maxent.pair_weights(group, n, total, share, rounds=60)
    p = share * np.exp(w - z)
    assert n - total * p == pytest.approx(maxent.PAIR_DISCOUNT + maxent.PAIR_PENALTY * w, abs=5e-2)  # the regularised optimum, in 16 bits
    sizes = np.bincount(maxent.count_level(np.array([1] * 50 + [2] * 20 + [9] * 5 + [1000])), minlength=maxent.LOG_COUNTS)
    assert [maxent.least_level(sizes, k) for k in (100, 30, 5, 1)] == [0, 2, 10, 10]
    pairs, counts = maxent.counted(np.array([5, 3, 5]), np.array([1, 2, 4]))
    assert pairs.tolist() == [3, 5] and counts.tolist() == [2, 5]


def test_op6_beats_a_discounted_bigram_under_any_partitioning(spark):
    first = {r.doc_id: r for r in maxent.score_corpus(corpus(spark, 2)).collect()}
    other = {r.doc_id: r for r in maxent.score_corpus(corpus(spark, 11)).collect()}
    assert all(other[k].score == pytest.approx(r.score, rel=1e-6) for k, r in first.items())
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in corpus(spark, 1).collect()]
    one, two, heads, kinds, n = Counter(), Counter(), Counter(), Counter(), 0
    for doc, words in docs:
        if held(doc, 10):
            for a, b in zip([b"", *words], [*words, b""]):
                one[b] += 1
                heads[a] += 1
                kinds[a] += (a, b) not in two
                two[a, b] += 1
    total, distinct, bigram, tokens = sum(one.values()), len(one), 0.0, 0
    for doc, words in docs:
        if not held(doc, 10):
            for a, b in zip([b"", *words], [*words, b""]):
                p = (one[b] + 0.1) / (total + 0.1 * (distinct + 1))
                p = max(two[a, b] - 0.75, 0) / heads[a] + 0.75 * kinds[a] / heads[a] * p if heads[a] else p
                bigram += math.log10(p)
                tokens += 1
    score = sum(r.score for r in first.values() if r.held_out)
    print("held-out log10 a token", score / tokens, "bigram", bigram / tokens, "base", sum(r.base_score for r in first.values() if r.held_out) / tokens)
    assert score >= bigram


def test_op6_base_score_and_gain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()]
    counts, ends, words = Counter(), 0, {}
    for doc, text in docs:
        words[doc] = (text or "").encode().lower().split()
        if held(doc, 10):
            counts.update(words[doc])
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    def share(c):
        return math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    rows = maxent.op6(spark, BIG).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.base_score == pytest.approx(sum(share(counts[w]) for w in words[r.doc_id]) + share(ends), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.doc_id]) + 1, sum(counts[w] > 0 for w in words[r.doc_id]) + 1, total)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op6_odd_documents(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "doc_id = 2 AS held_out").fillna({"held_out": False})
    rows = maxent.score_corpus(docs).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 3, 3, 40_001]
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    rows = maxent.score_corpus(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(rows) == 6 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    assert maxent.score_corpus(docs.where("false")).count() == 0
    few = maxent.score_corpus(docs, most=1).collect()  # a bound on pairs that few of them meet
    assert len(few) == 6 and all(math.isfinite(r.score) for r in few)


def test_pairs_beyond_those_that_workers_hold_keep_their_weights(spark):
    """Scores are the same whether weights are held or joined."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in np.cumsum(rng.integers(0, 4, rng.integers(0, 50))) % 40) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, i % 9 == 0) for i, t in enumerate([*texts, None, "new words w1 w2 w2"])], "doc_id long, text string, held_out boolean")
    held = {r.doc_id: r.score for r in maxent.score_corpus(docs).collect()}
    for most in (0, 1, 60):
        joined = {r.doc_id: r.score for r in maxent.score_corpus(docs, most=most).collect()}
        assert joined == pytest.approx(held, abs=1e-9)


def shuffled(spark) -> dict[int, int]:
    """Records that each stage has written to shuffles; Spark forgets old stages."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {x.stageId(): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_rare_pairs_travel_in_packed_lists(spark):
    """What is shuffled for pairs that workers don't hold doesn't grow by a row for each of them."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, 400)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i % 9 == 0) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    rows = []
    for most in (maxent.PAIRS, 0):
        before = shuffled(spark)
        maxent.score_corpus(docs, most=most).collect()
        rows.append(sum(n for k, n in shuffled(spark).items() if k > max(before, default=-1)))
    assert rows[1] - rows[0] < 1_000  # of 24,000 tokens
