"""Own distributed operators against brute force on small frames."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyback.operators import bagged_trees, density, forest, kmeans, moments, neighbours, quantiles
from tallyback.operators.quantiles import exact_quantile, exact_quantile_of_table
from tallyback.operators.ranks import first_row_per_key, global_row_number, percent_ranks, row_number_by_day, total_before
from tallyback.plans import models
from tallyback.plans.returns import order_value_quintile


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def test_global_row_number_matches_sort(spark, rng):
    values = [(int(v), i) for i, v in enumerate(rng.integers(0, 5, 1000))]
    df = spark.createDataFrame(values, "v int, id int").repartition(7)
    got = {r.id: r.n for r in global_row_number(df, [F.col("v"), F.col("id")], "n").collect()}
    assert got == {i: n for n, (v, i) in enumerate(sorted(values), 1)}


def test_total_before_matches_running_sum(spark, rng):
    rows = [(int(v), int(w)) for v, w in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "v int, w long").repartition(5)
    got = {r.v: r.b for r in total_before(df, ["v"], "w", "b").collect()}
    running, want = 0, {}
    for v, w in sorted(rows):
        want[v] = running
        running += w
    assert got == want


def test_percent_ranks_average_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0), ("e", None)], "k string, v double")
    got = {r.k: r.p for r in percent_ranks(df, ["k"], {"p": F.col("v")}).collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0, "e": None}
    twice = percent_ranks(df.unionByName(df), ["k"], {"p": F.col("v")})
    assert twice.count() == 10  # repeated keys keep their rows


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.98, 1.0])
def test_exact_quantile_matches_linear_interpolation(spark, rng, q):
    groups = {"hot": rng.normal(size=30_000).round(3), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "ties": np.repeat([5.0, 7.0], 50)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("two", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.x for r in exact_quantile(df, F.col("v"), q, ["g"], "x").collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, q), abs=1e-12), g
    whole = exact_quantile_of_table(df, F.col("v"), q, "x").first().x
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), q), abs=1e-12)


@pytest.mark.parametrize("few", [1, 1 << 16])
def test_quantiles_of_odd_doubles(spark, few, monkeypatch):
    monkeypatch.setattr("tallyback.operators.quantiles.FEW", few)  # 1: all four passes
    values = [-0.0, 0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, -1.0, -1.0 - 2**-52, 1.0, 1.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("n", None), ("h", 2.5)], "g string, v double")
    ordered = sorted(values)
    for i in (0, 3, 6, 8, 10, 13):
        got = {r.g: r.x for r in exact_quantile(df, F.col("v"), i / 13, ["g"], "x").collect()}
        assert got["h"] == 2.5 and "n" not in got
        if abs(ordered[i]) < 1e300:
            assert got["g"] == pytest.approx(ordered[i], abs=1e-300, rel=1e-15)
    assert exact_quantile_of_table(df.limit(0), F.col("v"), 0.5, "x").first().x is None


@pytest.mark.parametrize("accuracy", [10_000, 20, 1])
def test_quantiles_by_sketch_and_by_bits_agree(spark, rng, accuracy, monkeypatch):
    """A sketch settles the value exactly or not at all, and then the bits do."""
    monkeypatch.setattr("tallyback.operators.quantiles.ACCURACY", accuracy)
    values = {"wide": rng.normal(size=30_000), "ties": rng.integers(0, 3, 20_000).astype(float), "one": np.array([-0.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [(None, 1.0)], "g string, _v double").repartition(5).persist()
    known = df.filter("g IS NOT NULL")
    for q in (0.0, 0.3, 0.5, 1.0):
        bits = {r.g: (r._v0, r._v1) for r in quantiles._by_bits(known, q, ["g"]).collect()}
        marks = quantiles._between_marks(known, q, ["g"])
        assert marks is not None or accuracy == 1
        assert marks is None or {r.g: (r._v0, r._v1) for r in marks.collect()} == bits
        got = {r.g: r.x for r in exact_quantile(df, F.col("_v"), q, ["g"], "x", written=True).collect()}
        assert set(got) == set(values)
        for g, vs in values.items():
            assert got[g] == pytest.approx(np.quantile(vs, q), abs=1e-12)
    df.unpersist()


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 8, 12])
def test_quintiles_of_small_sizes(spark, n):
    amounts = [float(i // 2) for i in range(n)]
    orders = spark.createDataFrame([(str(i), "u", None, a) for i, a in enumerate(amounts)], "order_id string, user_id string, order_date timestamp_ntz, total_amount double")
    got = {r.order_id: r.value_bucket for r in order_value_quintile(orders).collect()}
    edges = [1 + (n - 1) * k / 5 for k in range(6)]
    want = {str(i): max(1, next(k for k in range(1, 6) if i + 1 <= edges[k] + 1e-9)) for i in range(n)}
    assert got == want


def test_row_number_by_day_orders_nulls_last(spark):
    rows = [("u", "2024-01-02 00:00:00", "b"), ("u", "2024-01-02 00:00:00", "a"), ("u", None, "z"), ("u", "2023-12-31 10:00:00", "c"), (None, "2024-01-01 00:00:00", "x")]
    df = spark.createDataFrame(rows, "u string, ts string, id string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.id: r.n for r in row_number_by_day(df, "u", "ts", "id", "n").collect()}
    assert got == {"c": 1, "a": 2, "b": 3, "z": 4, "x": None}


def test_first_row_per_key_puts_nulls_last(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 3, None), ("a", 3, "w"), ("b", None, "z")], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in first_row_per_key(df, "k", ["o"]).collect()} == {("a", 3, "w"), ("b", None, "z")}


def test_first_row_per_key_uses_explicit_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in first_row_per_key(df, "k", ["o"]).collect()} == {("a", 1, "y"), ("b", 5, "z")}


def test_neighbour_vote_matches_brute_force(spark, rng, monkeypatch):
    # tiny limits so that chunks, blocks and cells all come into play
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    points = np.vstack([rng.normal(size=(900, 3)), np.zeros((40, 3))])
    labels = rng.integers(0, 2, len(points))
    queries = np.vstack([rng.normal(size=(150, 3)), np.zeros((3, 3)), points[:5]])
    k = 9

    def frame(prefix, data, label):
        rows = [(f"{prefix}{i}", [float(x) for x in v], int(y)) for i, (v, y) in enumerate(zip(data, label))]
        return spark.createDataFrame(rows, "id string, a array<double>, label int").select("id", "label", array_to_vector("a").alias("features"))

    got = {r.id: r.score for r in neighbours.neighbour_vote(frame("p", points, labels), frame("q", queries, [0] * len(queries)), "id", "features", "label", k).collect()}
    assert len(got) == len(queries)
    names = np.array([f"p{i}" for i in range(len(points))])
    for i, q in enumerate(queries):
        d = np.linalg.norm(points - q, axis=1)
        near = np.lexsort((names, d))[:k]
        if (d[near] == 0).any():
            want = labels[near][d[near] == 0].mean()
        else:
            want = (labels[near] / d[near]).sum() / (1 / d[near]).sum()
        assert got[f"q{i}"] == pytest.approx(want), i


def brute_density(points, reach, min_points):
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    near = d <= reach
    core = near.sum(1) >= min_points
    comp = -np.ones(len(points), dtype=int)
    c = 0
    for i in range(len(points)):
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = c
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if comp[j] < 0:
                        comp[j] = c
                        stack.append(j)
            c += 1
    return near, core, comp


@pytest.mark.parametrize("compared", [0, 256])
def test_density_clusters_match_brute_force(spark, monkeypatch, compared):
    monkeypatch.setattr(density, "COMPARED", compared)  # 0: boxes are halved until their corners decide
    rng = np.random.default_rng(11)
    points = np.vstack(
        [rng.normal(0, 0.3, (300, 3)), rng.normal(4, 0.5, (200, 3)), rng.uniform(-6, 10, (120, 3)), np.repeat([[9.0, -9.0, 0.0]], 20, axis=0)]
        + [np.column_stack([np.linspace(1, 3.2, 60), np.linspace(1, 3.2, 60), np.linspace(1, 3.2, 60)])]
    )
    reach, least = 0.7, 8
    near, core, comp = brute_density(points, reach, least)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, x double, y double, z double")
    got = {r.id: r.cluster for r in density.density_clusters(df, "id", ["x", "y", "z"], reach, least).collect()}
    assert len(got) == len(points)
    mapping = {}
    for i in np.flatnonzero(core):
        assert got[i] >= 0
        assert mapping.setdefault(comp[i], got[i]) == got[i]
    assert len(set(mapping.values())) == len(mapping)
    for i in np.flatnonzero(~core):
        reachable = {mapping[comp[j]] for j in np.flatnonzero(near[i] & core)}
        assert got[i] == (-1 if not reachable else got[i]) and (not reachable or got[i] in reachable)


def test_density_clusters_at_the_reach_itself(spark, monkeypatch):
    """Two dense blocks one reach apart, exactly and just beyond, told apart by halving alone."""
    monkeypatch.setattr(density, "COMPARED", 0)
    grid = [(float(x), float(y)) for x in range(8) for y in range(8)]
    tie = [(x + 15.0, y) for x, y in grid]  # nearest columns 7 and 15: exactly 8 apart
    beyond = [(x + 30.5, y) for x, y in grid]  # 22 and 30.5: 8.5 apart
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(grid + tie + beyond)], "id int, x double, y double")
    got = {r.id: r.cluster for r in density.density_clusters(df, "id", ["x", "y"], 8.0, 5).collect()}
    assert {got[i] for i in range(128)} == {0} and {got[i] for i in range(128, 192)} == {1}


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(62)], "node string")
    got = {r.node: r.component for r in density.connected_components(edges, nodes).collect()}
    assert {got[f"n{i:03d}"] for i in range(31)} == {"n000"}
    assert {got[f"n{i:03d}"] for i in range(31, 61)} == {"n031"}
    assert got["n061"] == "n061"


def test_isolation_forest_finds_planted_outliers(spark, rng):
    data = np.vstack([rng.normal(size=(2000, 2)), rng.normal(12, 0.5, size=(20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(data)], "id int, a double, b double")
    scored = forest.isolation_forest(df, "id", ["a", "b"], trees=60)
    flags = {r.id: r.isolation_forest_flag for r in scored.collect()}
    assert sum(flags.values()) == pytest.approx(0.02 * len(data), abs=2)
    assert sum(flags[i] for i in range(2000, 2020)) >= 19
    again = {r.id: r.isolation_forest_flag for r in forest.isolation_forest(df.repartition(3), "id", ["a", "b"], trees=60).collect()}
    assert again == flags


def test_expected_path():
    assert forest.expected_path(1) == 0 and forest.expected_path(2) == 1
    assert forest.expected_path(256) == pytest.approx(10.2448, abs=1e-3)
    assert math.isfinite(forest.expected_path(10**9))


def _plain_tree(x, y, w, rows, min_leaf):
    """Shares of class 1 by exhaustive weighted Gini splits, for every row of ``x``, with all columns tried."""
    impurity = lambda r: 0 if not len(r) else (w[r] * y[r]).sum() * (w[r] * (1 - y[r])).sum() / w[r].sum()
    best = (1e-12, None)
    for f in range(x.shape[1]):
        for border in np.unique(x[rows, f])[:-1]:
            low, high = rows[x[rows, f] <= border], rows[x[rows, f] > border]
            if min(len(low), len(high)) >= min_leaf:
                gain = impurity(rows) - impurity(low) - impurity(high)
                best = max(best, (gain, (f, border)), key=lambda b: b[0] if b[1] is None or b[0] > best[0] + 1e-9 else -1)
    if best[1] is None:
        return {int(i): (w[rows] * y[rows]).sum() / w[rows].sum() for i in rows}
    f, border = best[1]
    return {**_plain_tree(x, y, w, rows[x[rows, f] <= border], min_leaf), **_plain_tree(x, y, w, rows[x[rows, f] > border], min_leaf)}


def test_one_tree_against_exhaustive_splits(rng, monkeypatch):
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3) ^ (rng.random(300) < 0.1)).astype(float)
    w = np.where(y == 1, 1.7, 0.6) * (1 + rng.random(300) / 1000)  # no equal gains
    codes = bagged_trees.bin_codes(x, bagged_trees.bin_edges(x))

    class Whole:  # every row drawn once instead of a bootstrap sample
        def integers(self, low, high, n):
            return np.arange(n)

        def random(self, shape):
            return np.zeros(shape)

    monkeypatch.setattr(bagged_trees.np.random, "default_rng", lambda seed: Whole())
    tree = bagged_trees.grow_tree(codes, y, w, 1, 3, 4, 100)
    want = _plain_tree(x, y, w, np.arange(300), 4)
    assert tree.scores(codes) == pytest.approx([want[i] for i in range(300)], abs=1e-6)
    assert tree.importance.sum() == pytest.approx(1)


def test_bagged_trees_learn_and_repeat(spark, rng):
    x = rng.normal(size=(1500, 5))
    y = (x[:, 1] + x[:, 3] > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]], 1.0 + int(y[i])) for i in range(1500)], "id int, label int, v array<double>, w double").repartition(4)
    df = df.select("id", "label", array_to_vector("v").alias("features"), "w")
    train, test = df.filter("id < 1000"), df.filter("id >= 1000")
    model = bagged_trees.BaggedTrees(trees=20, min_leaf=3).setWeightCol("w").fit(train)
    scores = {r.id: r.score for r in model.score(test, "id").collect()}
    assert np.mean([(scores[i] > 0.5) == y[i] for i in range(1000, 1500)]) > 0.9
    assert sorted(np.argsort(model.featureImportances.toArray())[-2:]) == [1, 3]
    again = bagged_trees.BaggedTrees(trees=20, min_leaf=3).setWeightCol("w").fit(train.repartition(7))
    assert {r.id: r.score for r in again.score(test, "id").collect()} == scores
    drawn = bagged_trees.BaggedTrees(trees=3, min_leaf=3, max_rows=400).fit(train)
    assert all((t.feature != bagged_trees.LEAF).sum() < 400 for t in drawn.trees) and len(drawn.trees) == 3
    assert model.score(test.limit(0), "id").count() == 0


def _plain_lloyd(rows, centres):
    for _ in range(300):
        own = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([rows[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        if np.sqrt(((moved - centres) ** 2).sum(1)).max() <= kmeans.REST:
            break
        centres = moved
    return centres, ((rows[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_kmeans_grid_against_plain_fits(spark, rng, monkeypatch):
    rows = np.vstack([rng.normal(m, 0.5, (120, 2)) for m in ((0, 0), (4, 0), (0, 5), (6, 6))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, v array<double>").repartition(5)
    df = df.select("id", array_to_vector("v").alias("features"))
    begun, start = [], kmeans.spread_start

    def remember(drawn, k, rng):
        begun.append(start(drawn, k, rng))
        return begun[-1]

    monkeypatch.setattr(kmeans, "spread_start", remember)
    got = kmeans.fit_kmeans_grid(df, "id", "features", [2, 4], 3, 300, 1)
    plain = {k: min((_plain_lloyd(rows, c) for c in begun if len(c) == k), key=lambda f: f[1])[0] for k in (2, 4)}
    for k in (2, 4):
        assert got[k] == pytest.approx(plain[k], abs=1e-9)
    own = {r.id: r.c for r in kmeans.assign_clusters(df, "features", got[4], "c").collect()}
    assert len({own[i] for i in range(0, 480, 120)}) == 4 and all(own[i] == own[i - i % 120] for i in range(480))
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "id int, v array<double>").select("id", array_to_vector("v").alias("features"))
    assert kmeans.fit_kmeans_grid(same, "id", "features", [3], 2, 10, 1)[3].tolist() == [[1.0, 1.0]] * 3


def test_linear_models_from_moments(spark, rng):
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0], [0, 0, 2.0]]) + 5
    y = x @ [1.5, -2, 0.0] + 3 + rng.normal(size=400)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(400)], "id int, v array<double>, y double").repartition(5)
    df = df.select("id", array_to_vector("v").alias("features"), "y")
    found = moments.moments(df, "features", F.col("y"), "id", 5, 1)
    z, c = x - x.mean(0), y - y.mean()
    fits = {"ols": moments.least_squares(found.whole), "ridge": moments.ridge(found.whole, 50.0), "lasso": moments.lasso(found.whole, 0.3)}
    assert fits["ols"].coefficients == pytest.approx(np.linalg.lstsq(z, c, rcond=None)[0])
    assert fits["ridge"].coefficients == pytest.approx(np.linalg.solve(z.T @ z + 50 * np.eye(3), z.T @ c))
    w = fits["lasso"].coefficients
    slope = z.T @ (c - z @ w) / 400  # at the optimum: alpha times the sign, or at most alpha where the coefficient is 0
    assert all(s == pytest.approx(0.3 * np.sign(v)) if v else abs(s) <= 0.3 + 1e-9 for s, v in zip(slope, w)) and w[2] == 0
    for fit in fits.values():
        errors = {r.id: r.y - r.prediction for r in fit.transform(df).collect()}
        assert moments.squared_error(found.whole, fit) == pytest.approx(sum(e * e for e in errors.values()), rel=1e-6)
    tried = []
    best = moments.cross_validated(found, lambda m, a: tried.append(a) or moments.ridge(m, a), [1e6, 1.0])
    assert best.coefficients == pytest.approx(moments.ridge(found.whole, 1.0).coefficients) and len(tried) == 11
    twice = spark.createDataFrame([(i, [float(i), float(i)], 2.0 * i) for i in range(9)], "id int, v array<double>, y double").select("id", array_to_vector("v").alias("features"), "y")
    assert moments.least_squares(moments.moments(twice, "features", F.col("y"), "id", 2, 1).whole).coefficients == pytest.approx([1.0, 1.0])


def test_network_stops_early_and_keeps_its_best(spark, rng, monkeypatch):
    x = rng.normal(size=(600, 2))
    rows = [(float(x[i, 0] * x[i, 1] > 0), [float(v) for v in x[i]]) for i in range(600)]
    df = spark.createDataFrame(rows, "label double, v array<double>").select("label", array_to_vector("v").alias("features"))
    rounds, network = [], models.MultilayerPerceptronClassifier

    def counted(**given):
        rounds.append(given["maxIter"])
        return network(**given)

    monkeypatch.setattr(models, "MultilayerPerceptronClassifier", counted)
    fitted = models.EarlyStoppedNetwork(hidden=(8,), max_iterations=400, step=10, tolerance=0.02).fit(df)
    assert 2 < len(rounds) < 40 and set(rounds) == {10}
    right = fitted.transform(df).filter("prediction = label").count()
    assert right > 540


@pytest.mark.parametrize("rows,piece", [(940, 20), (30, 100)])
def test_neighbour_vote_in_pieces_is_the_vote_of_all_rows(spark, rng, monkeypatch, rows, piece):
    """More labelled rows than travel whole all vote: scores, ties and rows are those of one matrix, for keys that repeat or are null too."""
    monkeypatch.setattr(neighbours, "PIECE_ROWS", piece)
    monkeypatch.setattr(neighbours, "PIECE_QUERIES", 30)
    monkeypatch.setattr(neighbours, "SLICES", 1)
    points = np.vstack([rng.integers(0, 6, size=(rows - 20, 3)), np.zeros((20, 3))]).astype(float)
    queries = np.vstack([rng.integers(0, 9, size=(90, 3)), np.full((2, 3), 50.0), points[:5]])

    def frame(prefix, data):
        keys = [f"{prefix}{i}" for i in range(len(data))]
        keys[0], keys[-1] = None, keys[-2]
        given = [(a, [float(x) for x in v], int(x % 2)) for a, v, x in zip(keys, data, rng.integers(0, 2, len(data)))]
        return spark.createDataFrame(given, "id string, a array<double>, label int").select("id", "label", array_to_vector("a").alias("features"))

    train, test = frame("p", points).dropDuplicates(["id"]).localCheckpoint(), frame("q", queries)
    whole, dealt = ([(r.id or "", r.label, r.score) for r in neighbours.neighbour_vote(train, test, "id", "features", "label", 9, *n).collect()] for n in ((), (7,)))
    assert len(dealt) == len(queries) and sorted(dealt) == sorted(whole)


def test_bagged_trees_of_many_rows_are_those_of_the_matrix(spark, rng, monkeypatch):
    """More rows than travel whole are all used: borders, trees, importances and scores are those of one matrix."""
    x = np.column_stack([rng.normal(size=1203).round(2), rng.integers(0, 3, 1203), np.zeros(1203), rng.exponential(size=1203)])
    y = (x[:, 0] + x[:, 1] > 1).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]], 1.0 + int(y[i])) for i in range(1203)], "id int, label int, v array<double>, w double")
    df = df.repartition(5).select("id", "label", array_to_vector("v").alias("features"), "w")
    whole = bagged_trees.BaggedTrees(trees=12, min_leaf=3).setWeightCol("w").fit(df)
    monkeypatch.setattr(bagged_trees, "SCORED_BYTES", 2_000)
    dealt = bagged_trees.BaggedTrees(trees=12, min_leaf=3, sent_rows=100).setWeightCol("w").fit(df)
    assert len(dealt._groups()) > 1
    assert all((a == b).all() for a, b in zip(whole.edges, dealt.edges)) and whole.featureImportances == dealt.featureImportances
    for a, b in zip(whole.trees, dealt.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.left == b.left).all() and (a.share == b.share).all()
    scores = [{r.id: (r.label, r.score) for r in m.score(df, "id").collect()} for m in (whole, dealt)]
    assert scores[0] == scores[1] and len(scores[0]) == 1203


@pytest.mark.parametrize("name,value", [("STEP_ROWS", 64), ("STEP_NODES", 2), ("ROOM", 10)])
def test_trees_do_not_depend_on_the_size_of_a_step(rng, monkeypatch, name, value):
    codes, y = rng.integers(0, 20, (700, 4)).astype(np.uint8), rng.integers(0, 2, 700).astype(float)
    w = np.where(y == 1, 2.0, 0.5)  # exact in any order of summation
    want = bagged_trees.grow_tree(codes, y, w, 5, 2, 3, 100)
    monkeypatch.setattr(bagged_trees, name, value)
    got = bagged_trees.grow_tree(codes, y, w, 5, 2, 3, 100)
    assert (got.feature == want.feature).all() and (got.left == want.left).all() and (got.cut == want.cut).all() and (got.share == want.share).all()
