"""N-gram join, vectors and components against brute force."""

import random

import numpy as np
import pytest

from tallyback.llm import ngram_join, vector_neighbours
from tallyback.llm.common import components
from tallyback.llm.ngram_join import ngram_components
from tallyback.llm.vector_neighbours import near_duplicate_vectors, table_masks


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def grams(text, size=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar_texts(seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([6, 12, 60, 300]))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 9999)}"
        if rng.random() < 0.3:
            words = [f"u{rng.randint(0, 10**6)}" for _ in range(20)] + bases[3]
        rows.append((i * 3, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,crowd", [(1, 256), (2, 4), (3, 15)])
def test_ngram_components(spark, seed, crowd):
    rows = similar_texts(seed)
    sets = {d: grams(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), crowd=crowd).collect()
    assert {r.doc_id: r.component_id for r in got} == roots(sets, links)
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}


def test_ngram_pairs_across_the_head(spark):
    """Sets around HEAD near the threshold: one is whole in the tree, the other is cut."""
    rng = random.Random(9)
    fresh = lambda k: [f"v{rng.randint(0, 10**9)}" for _ in range(k)]
    rows = []
    for n in range(52, 86):
        for extra in (n // 4, n // 4 - 2, n // 4 + 1):
            for front in (0, extra // 2):
                words = fresh(n + 4)
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(fresh(front) + words + fresh(extra - front)))]
    sets = {d: grams(t) for d, t in rows}
    links = [(d, d + 1) for d in range(0, len(rows), 2) if 100 * len(sets[d] & sets[d + 1]) >= 80 * len(sets[d] | sets[d + 1])]
    assert len(links) > 100 and any(len(sets[a]) == 64 and len(sets[b]) == 80 for a, b in links)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == roots(sets, links)


def test_parity_bound_never_loses_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        bound = ngram_join.overlap_bound(len(a), ngram_join.parity_signature(a), len(b), ngram_join.parity_signature(b))
        assert bound >= len(np.intersect1d(a, b))


def test_ngram_odd_rows(odd_docs, nulled_docs):
    by = {r.doc_id: r for r in ngram_components(odd_docs).collect()}
    assert [by[i].n_shingles for i in (1, 2, 3, 8, 9)] == [0, 0, 0, 1, 1]
    assert [by[i].component_id for i in range(1, 11)] == [1, 2, 3, 4, 5, 5, 7, 8, 9, 5]
    got = ngram_components(nulled_docs).collect()
    assert len(got) == 12 and [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_components(odd_docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(ids, edges_of(edges))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edges_of(edges):
    return [e for e in edges if e[0] != e[1]]


def vectors(seed, n=600, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    out = []
    for i in range(n):
        if rng.random() < 0.4:
            v = base[rng.integers(20)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.2, 0.3])
        else:
            v = rng.normal(size=dim)
        out.append((i * 2, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return out


def brute(rows, cosine=0.93):
    ids = [r[0] for r in rows]
    v = np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    close = (v @ v.T >= cosine) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(close, False)
    return {ids[i]: {ids[j] for j in np.flatnonzero(close[i])} for i in range(len(ids))}


@pytest.mark.parametrize("block", [512, 16])
def test_vectors_recall(spark, monkeypatch, block):
    monkeypatch.setattr(vector_neighbours, "BLOCK", block)
    rows = vectors(4)
    want = brute(rows)
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    total = sum(map(len, want.values()))
    assert total > 500 and all(got[i].n_links <= len(want[i]) for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * total
    exact = roots(list(want), [(a, b) for a in want for b in want[a]])
    assert sum(got[i].component_id == exact[i] for i in exact) >= 0.97 * len(exact)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_long_blocks_find_as_much(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbours, "table_masks", lambda largest: table_masks(1 << 18))
    rows = vectors(6)
    want = brute(rows)
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(map(len, want.values()))
    assert all(got[i].n_links <= len(want[i]) for i in want)


@pytest.mark.parametrize("largest", [1, 1 << 14, 100_000, 1 << 22, 1 << 26, 1 << 33])
def test_tables_keep_recall_at_any_size(largest):
    masks = table_masks(largest)
    assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])  # keys of bits of their own
    missed = np.prod([1 - (1 - np.arccos(0.93) / np.pi) ** mask.bit_count() for mask in masks])
    assert 1 - missed >= 0.97
    assert all(largest / 2.0 ** mask.bit_count() <= 64 for mask in masks)


@pytest.mark.parametrize("largest", [1 << 22, 1 << 26])
def test_pairs_at_the_threshold_meet(largest):
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a, other = unit(rng.normal(size=(4000, 64))), rng.normal(size=(4000, 64))
    other = unit(other - (other * a).sum(1)[:, None] * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * other
    keys = vector_neighbours._placed(table_masks(largest))
    models = vector_neighbours.learn_rotations(a, 1 + max(word for word, _ in keys))
    x, y = (vector_neighbours.codes_of(v, models) for v in (a, b))
    met = np.any([(x[:, word] ^ y[:, word]) & mask == 0 for word, mask in keys], axis=0)
    assert met.mean() >= 0.96


def test_each_label_has_tables_of_its_own_size():
    tables = vector_neighbours.Tables({7: 1 << 22})
    small, large = (tables.keys(tables.level(label)) for label in (1, 7))
    assert small == vector_neighbours._placed(table_masks(100)) and len(large) > len(small)


def test_labels_of_unlike_sizes_find_as_much(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbours, "PER_KEY", 1)  # labels of more than 256 vectors count as large
    rows = [(i, v, 0 if label else 1) for i, v, label in vectors(8, n=700)]
    want = brute(rows)
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(map(len, want.values()))
    assert all(got[i].n_links <= len(want[i]) for i in want)


def test_given_vectors(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    want = brute(rows)
    got = near_duplicate_vectors(table).collect()
    assert len(got) == len(rows) and sum(r.n_links for r in got) >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 3, 1), (8, [nan, 1.0, 1.0], 1),
            (9, [None, 1.0, 1.0], 1), (10, [inf, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (None, v, 1), (13, [3e38, 0.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, key int, rep string")
    got = {r.vec_id: r for r in near_duplicate_vectors(table).collect()}
    assert len(got) == len(rows)
    assert [(got[i].n_links, got[i].component_id) for i in (1, 2, 3)] == [(2, 1)] * 3
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    assert got[None].n_links == 0 and got[None].component_id is None
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_rows_of_one_vector_id(spark):
    a, b = [1.0, 0.5, 0.0, 0.0], [2.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 0), (1, a, 0), (2, b, 0), (2, [0.0, 0.0, 0.0, 1.0], 3), (4, a, 0)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True)] * 2 + [(2, 2, 1, False)] * 2 + [(4, 2, 1, False)]


def test_crowded_node_grows_with_its_sets(spark):
    """A node of many near copies and one other set deals each copy once, and near copies without common n-grams elsewhere are in no node."""
    from tallyback.llm import ngram_join as J

    grams = [(2, g) for g in range(60)]
    head = "doc_id long, n long, grams array<struct<heads:long,gram:long>>, weight long, sig binary"
    copies = [(i, 60, grams, 120, b"\0" * 8) for i in range(1, 401)]
    other = [(1000, 60, grams[:50] + [(2, 900 + g) for g in range(10)], 120, b"\0" * 8)]
    comp = spark.createDataFrame([(i, 1) for i in range(1, 401)], "doc_id long, component long")
    level = J._crossing_prefixes(spark.createDataFrame(copies + other, head), comp, 80)
    assert level.select("doc_id").distinct().count() == 401
    nodes = level.groupBy("node").count().count()
    assert J._dealt(level, 16).count() == level.filter("comp = 1").count() + level.filter("comp != 1").count() * (1 + 25)
    assert nodes > 1
    found = J._tree_pairs(level, spark.createDataFrame(copies + other, head), 80, 16)
    assert {tuple(r) for r in found.collect()} <= {(i, 1000) for i in range(1, 401)}
    few = [(1000, 60, grams[:10] + [(2, 900 + g) for g in range(50)], 120, b"\0" * 8)]
    assert J._crossing_prefixes(spark.createDataFrame(copies + few, head), comp, 80).count() == 0


def test_node_of_thousands_of_sets_deals_each_about_twice(spark):
    """At the library's chunk size a node of 2,200 sets, 985 of them components of their own, deals no set more than three times."""
    from tallyback.llm import ngram_join as J

    rows = [(7, i, 60, 1 if i <= 1216 else i) for i in range(1, 2201)]
    level = spark.createDataFrame(rows, "node long, doc_id long, n long, comp long")
    dealt = J._dealt(level, J.CROWD)
    assert dealt.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    met = dealt.selectExpr("doc_id", "least(chunk, other) AS c1", "greatest(chunk, other) AS c2").groupBy("c1", "c2")
    assert met.count().agg({"count": "max"}).first()[0] <= 2 * J.CROWD
