"""Grouped learners against plain versions of one model at a time."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import boosting, forest, logistic
from counterpoise.operators import evaluate as V
from counterpoise.operators.training_sets import TABLE, model_scores, training_sets


def _table(seed=1, n=300, width=3, distinct=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, distinct, (n, width)).astype(float)
    y = (x[:, 0] + x[:, 1] % 3 + rng.normal(0, 2, n) > distinct / 2).astype(float)
    return x, y


def plain_boosting(x, y, others, rounds, leaves, min_rows=20):
    """Best-first trees by trying every cut of every leaf."""
    start = math.log(y.mean() / (1 - y.mean()))
    raw, out = [start] * len(y), [start] * len(others)

    def gain(rows, g, h):
        best = (0.0, None, None)
        total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for j in range(x.shape[1]):
            values = sorted(set(x[:, j]))
            for low, high in zip(values, values[1:]):
                left = [i for i in rows if x[i, j] <= (low + high) / 2]
                if len(left) < min_rows or len(rows) - len(left) < min_rows:
                    continue
                lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                value = lg**2 / lh + (total_g - lg) ** 2 / (total_h - lh) - total_g**2 / total_h
                if value > best[0] + 1e-7:
                    best = (value, j, (low + high) / 2)
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        parts = [(list(range(len(y))), list(range(len(others))), gain(range(len(y)), g, h))]
        while len(parts) < leaves:
            best = max(range(len(parts)), key=lambda k: parts[k][2][0])
            rows, ahead, (value, j, edge) = parts[best]
            if j is None:
                break
            parts.pop(best)
            for side in (True, False):
                mine = [i for i in rows if (x[i, j] <= edge) == side]
                parts.append((mine, [i for i in ahead if (others[i, j] <= edge) == side], gain(mine, g, h)))
        for rows, ahead, _ in parts:
            value = -0.1 * sum(g[i] for i in rows) / sum(h[i] for i in rows)
            for i in rows:
                raw[i] += value
            for i in ahead:
                out[i] += value
    return out


@pytest.mark.parametrize("leaves", [2, 5, 31])
def test_boosting_is_best_first(leaves):
    x, y = _table(leaves)
    edges = [boosting.bin_edges(x[:, j]) for j in range(x.shape[1])]
    others = np.random.default_rng(9).integers(0, 12, (40, 3)).astype(float)
    got = boosting.fit_rows(boosting.binned(x, edges), y, boosting.binned(others, edges), 4, leaves)
    assert np.allclose(got, plain_boosting(x, y, others, 4, leaves), atol=1e-6)


def test_looking_ahead_changes_no_tree():
    x, y = _table(4, 500)
    bins = boosting.binned(x, [boosting.bin_edges(x[:, j]) for j in range(3)])
    g, h = boosting.slopes(np.zeros(500), y)
    found = []
    for ahead in (False, True):
        tree, asked = boosting.Tree(9), 0
        while nodes := tree.wanted(ahead):
            asked += 1
            at = boosting.route(tree.table(values=False), bins)
            for node in nodes:
                tree.splits[node] = boosting.best_split(boosting.histograms(bins[at == node], g[at == node], h[at == node]))
        found.append((tree.table()[boosting.route(tree.table(), bins), 4], asked))
    assert np.array_equal(found[0][0], found[1][0]) and found[1][1] < found[0][1]


def test_bins():
    assert boosting.bin_edges(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    many = np.random.default_rng(1).normal(size=5000)
    edges = boosting.bin_edges(many)
    counts = np.bincount(boosting.binned(many[:, None], [edges])[:, 0])
    assert len(counts) == 255 and counts.max() < 3 * counts.min()
    assert boosting.bin_edges(np.ones(5)).tolist() == [] and boosting.bin_edges(np.zeros(0)).tolist() == []


def _frame(spark, tables, extra=0):
    """Rows of several tables: each fifth row a test row, the others in three folds."""
    rows = [
        (v, 1000 * v + i, hash((v, i)) % 10**9, -1 if i % 5 == 0 else i % 3, float(b), [float(c) for c in a])
        for v, (x, y) in enumerate(tables)
        for i, (a, b) in enumerate(zip(x, y))
    ]
    df = spark.createDataFrame(rows, "v bigint, row bigint, draw bigint, part int, label double, x array<double>").repartition(5)
    folds = spark.createDataFrame([(v, 3) for v in range(len(tables))], "v bigint, folds int")
    sizes = {}
    for v, _, _, part, label, _ in rows:
        for f in range(-1, 3):
            if part >= 0 and part != f:
                n, positive = sizes.get((v, f), (0, 0))
                sizes[v, f] = (n + 1, positive + int(label))
    return rows, df, folds, sizes


def test_boosting_in_tasks_and_by_jobs_agree(spark):
    rows, df, folds, sizes = _frame(spark, [_table(1), _table(2, 200)])
    near = {(r.v, r.f, r.row): r.score for r in boosting.local_scores(df, folds, 3, 6).collect()}
    far = {(r.v, r.f, r.row): r.score for r in boosting.wide_scores(df, sizes, 3, 3, 6).collect()}
    assert set(near) == set(far) == {(v, part, row) for v, row, _, part, *_ in rows}
    assert max(abs(near[k] - far[k]) for k in near) < 1e-9


def test_jobs_of_boosting_do_not_grow_with_the_number_of_tables(spark):
    def jobs(tables):
        _, df, _, sizes = _frame(spark, tables)
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "count")
        boosting.wide_scores(df, sizes, 3, 2, 4).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, four = jobs([_table(1)]), jobs([_table(k) for k in range(1, 5)])
    assert four <= one + 12  # a tree of another table may be some levels deeper


def plain_cut(rank, weight, positive):
    best = (-math.inf, 0, 0)
    for low, high in zip(sorted(set(rank)), sorted(set(rank))[1:]):
        sides = [[(w, p) for r, w, p in zip(rank, weight, positive) if (r <= low) == s] for s in (True, False)]
        score = sum((sum(p for _, p in s) ** 2 + sum(w - p for w, p in s) ** 2) / sum(w for w, _ in s) for s in sides)
        if score > best[0] + 1e-9:
            best = (score, low, high)
    return best


def test_forest_cuts():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, nodes = int(rng.integers(1, 60)), 4
        node, rank, weight = rng.integers(0, nodes, n), rng.integers(0, 6, n), rng.integers(1, 4, n)
        positive = weight * rng.integers(0, 2, n)
        cuts = forest.best_cuts(node, rank, weight, positive, nodes)
        for k in range(nodes):
            at = node == k
            want = plain_cut(rank[at].tolist(), weight[at].tolist(), positive[at].tolist())
            assert math.isclose(cuts.gain[k], want[0], rel_tol=1e-9) or (cuts.gain[k] == want[0] == -math.inf)
            if want[0] > -math.inf:
                assert (cuts.below[k], cuts.above[k]) == want[1:]


def test_leaves_are_pure_at_any_depth():
    rng = np.random.default_rng(5)
    x = np.stack([rng.permutation(900), rng.permutation(900)], axis=1).astype(float)
    y = rng.integers(0, 2, 900).astype(float)
    seeds = forest.tree_seed(1, 0, -1, np.arange(6))
    weight = forest.bootstrap(seeds, np.arange(900))
    share = forest.grow(x, y, weight, x, seeds)
    for t in range(6):
        assert np.array_equal(share[t][weight[t] > 0], y[weight[t] > 0])
    # a chain: each level takes one row off
    levels = []
    steps = np.arange(80.0)[:, None]
    labels = (np.arange(80) % 2).astype(float)
    grown = forest.grow(steps, labels, np.ones((1, 80), np.int64), steps, seeds[:1], levels)
    assert np.array_equal(grown[0], labels) and levels[0] > 30


def test_constant_features_are_drawn_past():
    x = np.ones((50, 9))
    x[:, 4] = np.arange(50)
    y = (np.arange(50) > 20).astype(float)
    seeds = forest.tree_seed(2, 0, 0, np.arange(8))
    assert np.array_equal(forest.grow(x, y, np.ones((8, 50), np.int64), x, seeds), np.tile(y, (8, 1)))
    none = forest.grow(np.ones((4, 2)), np.array([0.0, 1, 1, 1]), np.ones((1, 4), np.int64), np.ones((2, 2)), seeds[:1])
    assert none.tolist() == [[0.75, 0.75]]


def test_bootstrap_counts():
    weight = forest.bootstrap(forest.tree_seed(1, 2, 3, np.arange(20)), np.arange(5000))
    assert abs(weight.mean() - 1) < 0.02 and abs((weight == 0).mean() - math.exp(-1)) < 0.01
    assert np.array_equal(weight[4], forest.bootstrap(forest.tree_seed(1, 2, 3, np.array([4])), np.arange(5000))[0])


def _auc(found):
    pos, neg = [s for s, y in found if y > 0], [s for s, y in found if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_forests_in_tasks_and_by_histograms(spark):
    rows, df, folds, sizes = _frame(spark, [_table(1, 400), _table(2, 260)])
    near = forest.local_scores(df, folds, 7, 12, 5).collect()
    far = forest.wide_scores(df, list(sizes), 3, 7, 12, task_rows=60).collect()
    assert {(r.v, r.f, r.row) for r in near} == {(r.v, r.f, r.row) for r in far} == {(v, part, row) for v, row, _, part, *_ in rows}
    for v in (0, 1):
        a, b = (_auc([(r.score, r.label) for r in of if r.v == v and r.f == -1]) for of in (near, far))
        assert a > 0.7 and b > 0.7 and abs(a - b) < 0.1
    # a tree is drawn by the same hashes either way: without histograms above, scores are equal
    same = {(r.v, r.f, r.row): r.score for r in forest.wide_scores(df, list(sizes), 3, 7, 3, task_rows=10**6).collect()}
    local = {(r.v, r.f, r.row): r.score for r in forest.local_scores(df, folds, 7, 3, 2).collect()}
    assert set(same) == set(local) and max(abs(same[k] - local[k]) for k in same) < 1e-12


def plain_logistic(x, y):
    z = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z.T * (c * p * (1 - p))) @ z + np.eye(len(beta)), z.T @ (c * (p - y)) + beta)
    return beta


def test_logistic_coefficients_of_all_sets(spark):
    tables = [_table(1, 300), _table(2, 120)]
    x = np.linspace(-1, 1, 90)[:, None] * np.array([[1.0, 40.0, 0.0]])
    tables.append((x, (x[:, 0] > 0).astype(float)))  # separable
    rows, df, _, sizes = _frame(spark, tables)
    found = logistic.fit(df, sizes, 3)
    for (v, f), beta in found.items():
        mine = [(a, b) for of, _, _, part, b, a in rows if of == v and part >= 0 and part != f]
        want = plain_logistic(np.array([a for a, _ in mine]), np.array([b for _, b in mine]))
        assert np.abs(beta - want).max() < 1e-6
    scored = logistic.scores(df, found).collect()
    assert {(r.v, r.f, r.row) for r in scored} == {(v, part, row) for v, row, _, part, *_ in rows}


def _named(spark, n=240):
    rng = random.Random(2)
    rows = [(i, i % 3, rng.choice("abc"), float(rng.randint(0, 9)), "m" if rng.random() < 0.5 else "f") for i in range(n)]
    rows = [(i, t, s, x + (3 if y == "m" else 0), y) for i, t, s, x, y in rows]
    return spark.createDataFrame(rows, f"id bigint, {TABLE} bigint, isle string, depth double, sex string")


def test_tables_together_score_as_alone(spark):
    tables = _named(spark)
    test = tables.filter("id % 7 = 0").drop(TABLE)
    sizes = {"trees": 4, "rounds": 3, "max_splits": 3}
    every = V.score_tables(tables, test, "sex", key="id", **sizes)
    for v in range(3):
        alone = V.score_tables(tables.filter(F.col(TABLE) == v), test, "sex", key="id", **sizes)[v]
        for m in V.MODELS:
            assert alone[m][3] is None and np.allclose(alone[m][:3], every[v][m][:3], atol=1e-9)
    wide = V.score_tables(tables, test, "sex", models=["hist_gradient"], key="id", local_rows=10, **sizes)
    assert all(np.allclose(wide[v]["hist_gradient"][:3], every[v]["hist_gradient"][:3]) for v in range(3))


def test_unusable_tables_are_named_and_others_scored(spark):
    tables = _named(spark).withColumn("sex", F.when(F.col(TABLE) == 1, "m").otherwise(F.col("sex")))
    test = tables.drop(TABLE)
    found = V.score_tables(tables, test, "sex", models=["logistic"], key="id", max_splits=2)
    assert found[0]["logistic"][3] is None and found[0]["logistic"][2] > 0.5
    assert math.isnan(found[1]["logistic"][2]) and "2 classes" in found[1]["logistic"][3]
    none = V.train_and_score(test.limit(0), test, "sex", "d", models=["logistic", "random_forest", "hist_gradient"], key="id")
    assert all(math.isnan(r[7]) and r[8] for r in none)


def test_codes_and_scaling_are_those_of_the_training_rows(spark):
    train = spark.createDataFrame([(1, 0, "b", 1.0, 5, True, "y"), (2, 0, "a", 3.0, 5, False, "n"), (3, 0, "c", 5.0, 5, True, "y"), (4, 0, "a", 7.0, 5, True, "n"), (5, 0, ".", 9.0, 5, True, "n")], f"id int, {TABLE} int, `a b` string, x double, k int, flag boolean, sex string")
    test = spark.createDataFrame([(9, "zzz", 4.0, 7, True, "other"), (10, "c", 4.0, 5, True, "y")], "id int, `a b` string, x double, k int, flag boolean, sex string")
    sets = training_sets(train, test, "sex", key="id", max_splits=2)
    rows = {(r.part, round(r.x[1], 6)): r for r in sets.rows.collect()}
    s = math.sqrt(5)
    assert sorted(round(r.x[1] * s, 6) for r in sets.rows.filter("part >= 0").collect()) == [-3, -1, 1, 3]
    tests = sets.rows.filter("part = -1").orderBy("x").collect()
    assert [(r.x[0], r.x[1], r.x[2], r.x[3], r.label) for r in tests] == [(0.0, 0.0, 2.0, 1.0, 0.0), (2.0, 0.0, 0.0, 1.0, 1.0)]
    assert len(rows) >= 5 and model_scores(sets, "logistic").count() == 6
