"""Sets of every size are keyed by the whole pigeonhole."""

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest

from quarry.llm import jaccard_join as j

NONE = np.zeros(j.SLOTS // 64, np.uint64)


def share_a_key(a, b, common=NONE):
    key, whose = j.keys([a, b], common)
    return bool(np.intersect1d(key[whose == 0], key[whose == 1]).size)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 40, 64, 100, 205, 206, 400, 1000, 5000])
def test_links_share_a_key_at_every_size(n):
    rng = np.random.default_rng(n)
    common = rng.integers(0, 2**63, j.SLOTS // 64, dtype=np.uint64)  # any order of the parts will do
    for larger in sorted({n, n + 1, n * 7 // 6, n * 4 // 3}):
        least = -(-3 * (n + larger) // 7)  # the fewest common shingles of a link
        if least > n:
            continue
        for _ in range(30 if n < 500 else 4):
            pool = np.unique(rng.integers(0, 2**63, n + larger + 20, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:least], pool[n : n + larger - least]]))
            assert len(b) == larger and j.links(a, b)
            assert share_a_key(a, b) and share_a_key(a, b, common)
            assert j.may_link(j.parity_bits(a), j.parity_bits(b), n, larger)


def test_enough_parts_for_every_need():
    sizes = np.arange(1, 200_000, 7)
    for below in range(4):
        _, band, need = j.bands(sizes, below)
        assert (need <= j.band_parts(band)).all()


def test_worst_case_of_one_difference_a_part():
    """A link at the threshold whose differences fall onto as many parts as they can."""
    for n in (153, 600, 4000):
        parts = int(j.band_parts(np.searchsorted(j.EDGES, n, "right") - 1))
        of = lambda part, k: (part + parts * k) << 20  # noqa: E731, B023
        gone = n // 7
        shared = [of(i % parts, 1 + i // parts) for i in range(n - gone)]
        a = np.sort(np.array(shared + [of(i, 100_000) for i in range(gone)], np.uint64))
        b = np.sort(np.array(shared + [of(gone + i, 200_000) for i in range(gone)], np.uint64))
        assert len(a) == len(b) == n and j.links(a, b)
        assert share_a_key(a, b)


def test_keys_that_a_task_sees_often_keep_their_stars():
    key = np.array([5] * 100 + [7] * 3 + [9], np.int64)
    node = np.concatenate([np.arange(200, 100, -1), [3, 2, 1], [8]])
    got_key, got_node = j.spread_often(key, node, own=1)
    buckets = {}
    for k, x in zip(got_key.tolist(), got_node.tolist()):
        buckets.setdefault(k, set()).add(x)
    assert buckets[5] == {101} and buckets[7] == {1, 2, 3} and buckets[9] == {8}
    assert [v for k, v in buckets.items() if k not in (5, 7, 9)] == [set(range(101, 201))]


def test_nearest_pairs_of_each_component():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [base, *(np.sort(np.concatenate([base[k + 1 :], rng.integers(0, 2**63, k + 1, dtype=np.uint64)])) for k in range(6))]
    bits = [np.frombuffer(j.parity_bits(s), np.uint64) for s in sets]
    node, c = np.arange(7), np.array([0, 0, 0, 0, 0, 5, 6])
    size = np.array([len(s) for s in sets])
    everyone, outside = np.ones(7, bool), c != 0
    a, b, more = j.nearest_pairs(node, c, size, bits, everyone, outside, 100)
    assert set(zip(a.tolist(), b.tolist())) == {(x, y) for y in (5, 6) for x in range(7) if x < y} and not more.any()
    a, b, more = j.nearest_pairs(node, c, size, bits, everyone, outside, 2)
    assert more.all() and set(zip(a.tolist(), b.tolist())) >= {(0, 5), (0, 6)}


def test_pairs_whose_only_key_is_common_meet_across_tasks(spark):
    """Two documents of different tasks that share one key alone, one that both tasks see often."""
    rng = np.random.default_rng(3)
    text = lambda: [f"w{x}" for x in rng.integers(0, 10**6, 11)]
    of = lambda words: set(j.keys(j.shingle_sets([" ".join(words)]), NONE)[0].tolist())
    for _ in range(20_000):
        x, other = text(), text()
        y = [*x[:-1], other[-1]]
        shared = of(x) & of(y)
        if len(shared) == 1 and min(shared) >> 56 == 2:  # an empty part
            break
    fillers = [words for words in (text() for _ in range(20_000)) if shared <= of(words)][:160]
    assert len(fillers) == 160
    docs = [" ".join(words) for words in (*fillers[:80], x, *fillers[80:], y)]
    rows = spark.sparkContext.parallelize(list(enumerate(docs)), 1).toDF("doc_id long, text string")
    rows = rows.where("doc_id <= 80").coalesce(1).union(rows.where("doc_id > 80").coalesce(1))
    found = {r.doc_id: r.component_id for r in j.jaccard_components(rows).collect()}
    assert found == {i: i for i in range(161)} | {161: 80}


def test_packed_keys_come_back():
    rng = np.random.default_rng(4)
    key = np.concatenate([rng.integers(0, 1 << j.KEY_BITS, 5000), rng.integers(j.OWN, 2 * j.OWN, 50)])
    node, head = rng.integers(-(2**63), 2**63 - 1, 40)[rng.integers(0, 40, len(key))], rng.random(len(key)) < 0.1
    rows = j.pa.Table.from_batches([j.pack_keys(key, node, head, 7)])
    found = set()
    for bucket in range(7):
        quotient, of = j.unpack_keys(rows.filter(j.pa.compute.equal(rows.column("bucket"), bucket)))
        found |= set(zip(((quotient >> 1) * 7 + bucket).tolist(), of.tolist(), (quotient & 1).tolist()))
    assert found == set(zip(key.tolist(), node.tolist(), head.astype(int).tolist()))


def test_stars_of_a_key_that_tasks_replaced_are_made_whole(spark):
    """Each of three tasks sees one key 100 times; its least node's star then holds all 300."""
    blocks = []
    for task in range(3):
        node = np.arange(100) * 3 + task
        key, node = j.spread_often(np.full(100, 5), node, own=task + 1)
        blocks.append(j.pack_keys(key, node, np.arange(len(key)) >= 100, 2))
    star = j.stars(spark.createDataFrame([tuple(r.values()) for r in j.pa.Table.from_batches(blocks).to_pylist()], j.PACKED))
    assert {r.b for r in star.where("a = 0").collect()} != set(range(1, 300))
    assert {r.b for r in j.whole_stars(star).where("a = 0").collect()} == set(range(1, 300))
