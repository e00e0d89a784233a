import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import describe as D
from counterpoise.operators import descent
from counterpoise.operators import generate as G
from counterpoise.operators import smote as K
from counterpoise.operators.encode import LabelEncoder, string_columns


@pytest.fixture(scope="module")
def birds(spark):
    """A table with the shape of a small field study: linked species, island and size."""
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(600):
        species = ["A", "B", "C"][int(rnd.integers(3))]
        island = {"A": "north", "B": "south", "C": "south"}[species] if rnd.random() < 0.9 else "east"
        mass = float(3000 + 900 * "ABC".index(species) + rnd.normal(0, 100))
        rows.append((i, species, island, mass, int(mass / 20), None if i % 10 == 0 else float(i % 7)))
    return spark.createDataFrame(rows, "id bigint, species string, island string, mass double, flipper bigint, extra double").cache()


def shares(df, *cols):
    n = df.count()
    return {tuple(r[c] for c in cols): r["count"] / n for r in df.groupBy(*cols).count().collect()}


def variation(a, b):
    return sum(abs(a.get(k, 0) - b.get(k, 0)) for k in set(a) | set(b)) / 2


def test_column_kinds(spark, birds):
    kinds = {a.name: a for a in D.column_kinds(birds, skip=["id"])}
    assert kinds["species"].kind == kinds["extra"].kind == "categorical"
    assert kinds["mass"].kind == "histogram" and kinds["flipper"].kind == "histogram"
    assert kinds["extra"].missing == 60
    forced = {a.name: a.kind for a in D.column_kinds(birds, categorical_cols=["flipper"], skip=["id"])}
    assert forced["flipper"] == "categorical"
    few = D.column_kinds(birds.limit(30), skip=["id"])
    assert all(a.kind == "categorical" for a in few)


def test_distribution_sums_to_one_and_lists_empty_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3] + [100] + list(range(40, 70))], "x double")
    dist = D.attribute_distribution(df, D.column_kinds(df)).orderBy("bin").collect()
    assert len(dist) == 10 and dist[-1]["n"] == 1 and dist[2]["n"] == 0
    assert sum(r["prob"] for r in dist) == pytest.approx(1) and dist[-1]["hi"] == 100
    assert all(a["cum_hi"] == b["cum_lo"] for a, b in zip(dist, dist[1:]))
    noisy = D.attribute_distribution(df, D.column_kinds(df), epsilon=0.1).collect()
    assert sum(r["prob"] for r in noisy) == pytest.approx(1) and all(r["prob"] >= 0 for r in noisy)
    assert [r["prob"] for r in noisy] != [r["prob"] for r in dist]


def test_constant_and_empty_columns(spark):
    df = spark.range(50).select(F.col("id"), F.lit(4.5).alias("c"), F.lit(None).cast("string").alias("n"))
    for mode in G.MODES:
        out = G.synthesize(df, 40, mode).collect()
        assert len(out) == 40 and {r["c"] for r in out} == {4.5} and {r["n"] for r in out} == {None}


def test_independent_keeps_marginals_and_drops_links(spark, birds):
    out = G.synthesize(birds.drop("id"), 20_000).cache()
    assert out.count() == 20_000 and out.columns == birds.drop("id").columns
    for c in ("species", "island", "extra"):
        assert variation(shares(birds, c), shares(out, c)) < 0.03
    lo, hi = birds.agg(F.min("mass"), F.max("mass")).first()
    assert out.filter(~F.col("mass").between(lo, hi)).count() == 0
    table = D.bin_table(out.select("species", "island"), D.column_kinds(out.select("species", "island")))
    assert D.mutual_information(table).first()["mi"] < 0.01


def test_correlated_keeps_links(spark, birds):
    df = birds.drop("id")
    desc = G.describe(df, "correlated")
    assert [c for c, _ in desc.network.edges][0] == "extra" and all(len(p) <= 2 for _, p in desc.network.edges)
    out = G.generate(desc, 20_000).cache()
    assert variation(shares(birds, "species", "island"), shares(out, "species", "island")) < 0.1
    heavy = {r["species"]: r["m"] for r in out.groupBy("species").agg(F.avg("mass").alias("m")).collect()}
    assert heavy["A"] < heavy["B"] < heavy["C"]


def test_network_maximises_information_step_by_step(spark, birds):
    df = birds.select("species", "island", "mass", "flipper")
    table = D.bin_table(df, D.column_kinds(df))
    rows = [tuple(r) for r in table.rows.select(*sorted(table.cards)).collect()]
    names = sorted(table.cards)

    def entropy(cols):
        idx = [names.index(c) for c in cols]
        _, n = np.unique([tuple(r[i] for i in idx) for r in rows], axis=0, return_counts=True)
        p = n / n.sum()
        return float(-(p * np.log(p)).sum())

    whole = D.learn_network(table).edges
    with pytest.MonkeyPatch.context() as m:
        m.setattr(D, "SUBSETS_PER_JOB", 3)
        assert D.learn_network(table).edges == whole
    first, second = whole[:2]
    mi = {c: entropy([c]) + entropy([first[0]]) - entropy([c, first[0]]) for c in names if c != first[0]}
    assert mi[second[0]] == pytest.approx(max(mi.values()))


def test_unseen_parents_fall_back_to_uniform(spark):
    df = spark.createDataFrame([("a", "p", "x"), ("b", "q", "y")] * 20, "u string, v string, w string")
    net = D.Network([("u", ()), ("v", ()), ("w", ("u", "v"))])
    desc = G.describe(df, "correlated", network=net)
    got = G.generate(desc, 4_000).filter("u = 'a' and v = 'q'")
    s = shares(got, "w")
    assert s.keys() == {("x",), ("y",)} and abs(s[("x",)] - 0.5) < 0.07
    holes = df.withColumn("w", F.when(F.col("u") == "a", F.col("w")))
    got = G.generate(G.describe(holes, "correlated", network=net), 4_000)
    s = shares(got.filter("u = 'a' and v = 'q'"), "w")
    assert s.keys() == {("x",), (None,)} and shares(got.filter("u = 'b' and v = 'q'"), "w") == {(None,): 1.0}


def test_large_domain_draw_uses_shuffle(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_ROWS", 10)
    monkeypatch.setattr("counterpoise.operators.lookup.fits_broadcast", lambda *a, **k: False)
    df = spark.range(400).select(F.format_string("v%03d", F.least("id", F.lit(250))).alias("c"))
    out = G.synthesize(df, 6_000, categorical_cols=["c"])
    s = shares(out, "c")
    assert abs(s[("v250",)] - 150 / 400) < 0.03 and out.count() == 6_000


def test_text_columns_become_letters_of_like_length(spark):
    df = spark.range(100).select(F.concat(F.lit("n"), F.repeat(F.lit("y"), (F.col("id") % 40).cast("int")), "id").alias("t"))
    lengths = [len(r["t"]) for r in df.collect()]
    out = [r["t"] for r in G.synthesize(df, 200).collect()]
    assert all(t.isalpha() and t.islower() and min(lengths) <= len(t) <= max(lengths) for t in out)


def test_unknown_mode(spark, birds):
    with pytest.raises(ValueError, match="use one of"):
        G.synthesize(birds, 1, "other")


# --- SMOTE ----------------------------------------------------------------------


def brute(rows, k):
    keys = np.array([r["key"] for r in rows])
    x = np.array([r["vec"] for r in rows])
    out = {}
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        order = [j for j in np.lexsort((keys, d)) if j != i][:k]
        out[int(keys[i])] = [int(keys[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["spread", "copies"])
@pytest.mark.parametrize("tile_rows,pivots", [(2_000, None), (40, 6)])
def test_neighbours_equal_brute_force(spark, kind, tile_rows, pivots):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(300, 4)) if kind == "spread" else rnd.integers(0, 3, size=(300, 2)).astype(float)
    if kind == "copies":
        x[:120] = 1.0  # one point holds more than a third of the rows
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, vec array<double>")
    near = K.nearest_neighbours(df, 4, tile_rows=tile_rows, pivots=pivots)
    got = {}
    for r in near.orderBy("key", "pos").collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert got == brute(df.collect(), 4)


def test_new_points_lie_between_their_ends(spark):
    rnd = np.random.default_rng(2)
    x = {i: rnd.normal(size=3) for i in range(40)}
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in x.items()], "key bigint, vec array<double>")
    for n in (10, 500):
        out = K.interpolate(df, n, 5).collect()
        assert len(out) == n
        near = brute(df.collect(), 5)
        for r in out:
            a, b = x[r["base"]], x[r["neighbour"]]
            assert r["neighbour"] in near[r["base"]] and 0 <= r["gap"] < 1
            assert np.allclose(r["vec"], a + r["gap"] * (b - a))


def test_smote_table(spark, birds):
    df = birds.drop("extra").filter("species <> 'C' and (species = 'A' or id % 3 = 0)")
    counts = {r["species"]: r["count"] for r in df.groupBy("species").count().collect()}
    out = K.smote(df, "species", categorical_cols=["island"], key="id").cache()
    after = {r["species"]: r["count"] for r in out.groupBy("species").count().collect()}
    assert after == {"A": counts["A"], "B": counts["A"]} and out.columns[-2:] == ["species", "is_synthetic"]
    assert {r["island"] for r in out.filter("is_synthetic").select("island").distinct().collect()} <= {"south", "east", "north"}
    assert dict(out.dtypes)["flipper"] == "bigint"
    b = df.filter("species = 'B'").agg(F.min("mass"), F.max("mass")).first()
    assert out.filter("is_synthetic").filter(~F.col("mass").between(*b)).count() == 0
    more = K.smote(df, "species", n_new=7, categorical_cols=["island"])
    assert more.filter("is_synthetic").count() == 7


def test_tiny_minorities(spark):
    def rows(n):
        return spark.createDataFrame([(i, float(i), "f" if i < n else "m") for i in range(30)], "id bigint, x double, y string")

    with pytest.raises(ValueError, match="at least 2"):
        K.smote(rows(1), "y", key="id")
    made = [r["x"] for r in K.smote(rows(2), "y", key="id").filter("is_synthetic").collect()]
    assert len(made) == 26 and all(0 <= v <= 1 for v in made)
    assert K.neighbour_count(5, 2) == 1 and K.neighbour_count(5, 100) == 5


def test_nan_null_decimal_and_short_columns(spark):
    """NaN counts as missing, missing values fall into no bin, and all numeric types are binned."""
    df = spark.range(100).select(
        F.when(F.col("id") == 3, float("nan")).when(F.col("id") == 4, None).otherwise(F.col("id") * 1.5).alias("x"),
        F.col("id").cast("decimal(12,2)").alias("d"),
        F.col("id").cast("smallint").alias("s"),
    )
    kinds = {a.name: a for a in D.column_kinds(df)}
    assert {a.kind for a in kinds.values()} == {"histogram"}
    assert (kinds["x"].missing, kinds["x"].lo, kinds["x"].hi) == (2, 0.0, 148.5)
    counts = {(r.attr, r.bin): r.n for r in D.attribute_counts(df, list(kinds.values())).collect()}
    assert sum(n for (a, _), n in counts.items() if a == "x") == 98
    assert [counts["d", b] for b in range(10)] == [10] * 10 == [counts["s", b] for b in range(10)]
    made = G.synthesize(df, 200, "independent")
    assert made.filter("isnan(x)").count() == 0


def _network_table(spark, columns, n=400, seed=3, noise=(0, 0, 0, 1)):
    rng = random.Random(seed)
    above = [0, *(rng.randrange(j) if j > 3 else 0 for j in range(1, columns))]
    rows = []
    for _ in range(n):
        row = [rng.randrange(4)]
        for j in range(1, columns):
            row.append((row[above[j]] + rng.choice(noise)) % (2 + j % 3))
        rows.append([str(x) for x in row])
    return spark.createDataFrame(rows, ", ".join(f"c{j:02d} string" for j in range(columns)))


def plain_network(table, max_parents=2):
    """The greedy search over entropies of all column sets."""
    names = sorted(table.cards)
    ent = D.entropies(table, [s for k in range(1, min(max_parents + 1, len(names)) + 1) for s in itertools.combinations(names, k)])

    def h(cols):
        return ent.get(",".join(sorted(cols)), 0.0)

    edges, placed = [(names[0], ())], [names[0]]
    while len(placed) < len(names):
        size = min(max_parents, len(placed))
        options = [(-round(h([c]) + h(p) - h([c, *p]), 9), c, p) for c in names if c not in placed for p in itertools.combinations(sorted(placed), size)]
        _, child, parents = min(options)
        edges.append((child, parents))
        placed.append(child)
    return edges


@pytest.mark.parametrize("columns, parents", [(1, 2), (2, 2), (8, 1), (8, 2), (6, 3)])
def test_bounded_network_search_finds_the_same_network(spark, columns, parents):
    df = _network_table(spark, columns)
    table = D.bin_table(df, D.column_kinds(df))
    assert D.learn_network(table, parents).edges == plain_network(table, parents)


def test_few_column_sets_are_counted(spark, monkeypatch):
    """Columns that follow from others reach their bound at once."""
    monkeypatch.setattr(D, "SETS_AT_ONCE", 6)
    df = _network_table(spark, 14, 300, noise=(0,))
    table = D.bin_table(df, D.column_kinds(df))
    seen = []
    net = D.learn_network(table, 2, seen)
    assert len(net.edges) == 14 and seen[0] == 14 + 14 * 13 // 2
    assert sum(seen[1:]) < math.comb(14, 3) / 2
    assert net.edges == plain_network(table)


def test_descent_finds_most_neighbours(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(3 * (i % 9), 1) for _ in range(16)]) for i in range(1_500)]
    rows += [(2_000 + i, [1.0] * 16) for i in range(40)]  # more equal vectors than neighbours asked for
    df = spark.createDataFrame(rows, "key bigint, vec array<double>")
    found = descent.descend(df, 5).collect()
    exact = {}
    for r in K.nearest_neighbours(df, 5).collect():
        exact.setdefault(r.key, set()).add(r.neighbour)
    mine = {}
    for r in found:
        mine.setdefault(r.key, set()).add(r.neighbour)
        assert r.key != r.neighbour
    assert set(mine) == set(exact) and all(len(m) == 5 for m in mine.values())
    own = [k for k in exact if k < 2_000]
    assert sum(len(mine[k] & exact[k]) for k in own) >= 0.9 * 5 * len(own)
    # of equal vectors any five are as near
    assert all(r.dist < 1e-6 for r in found if r.key >= 2_000)
    two = descent.descend(df.filter("key < 2"), 5).collect()
    assert [(r.key, r.pos, r.neighbour) for r in sorted(two)] == [(0, 1, 1), (1, 1, 0)]
    with pytest.raises(ValueError):
        descent.descend(df.limit(1), 5)


def test_smote_by_descent(spark):
    rows = [(i, float(i % 20), float(i % 7), "a" if i < 60 else "b") for i in range(260)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, t string")
    out = K.smote(df, "t", 100, key="id", search="descent")
    made = out.filter("is_synthetic").collect()
    assert len(made) == 100 and all(0 <= r.x <= 19 and 0 <= r.y <= 6 and r.t == "a" for r in made)
    with pytest.raises(ValueError):
        K.smote(df, "t", 1, key="id", search="other")


def test_descent_notices_that_it_finds_too_few(spark):
    """Vectors without structure, of which lists of the first width find less than nine neighbours in ten."""
    rnd = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(3_000, 48)))]
    rows += [(5_000 + i, rows[i][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "key bigint, vec array<double>")
    exact = {(r.key, r.neighbour) for r in K.nearest_neighbours(df, 5).collect()}
    found = [(r.key, r.neighbour) for r in descent.descend(df, 5, reverse=4, rounds=3).collect()]
    assert len(found) == len(set(found)) == len(exact) == 5 * 3_200
    assert len(exact & set(found)) >= 0.9 * len(exact)


def test_neighbours_by_blocks_of_queries(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 4, size=(700, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, vec array<double>")
    whole = sorted(K.nearest_neighbours(df, 4).collect())
    monkeypatch.setattr(K, "QUERY_ROWS", 9)
    assert sorted(K.nearest_neighbours(df, 4, tile_rows=50).collect()) == whole
