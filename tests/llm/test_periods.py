import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from counterpoise.llm import periods, queries

SCHEMA = "doc_id bigint, text string, runs string, key int"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_runs(w, least=6, repeats=4):
    """All maximal stretches by trying every period."""
    out = set()
    for q in range(1, len(w) // repeats + 1):
        start = None
        for i in range(len(w) - q + 1):
            if i + q < len(w) and w[i] == w[i + q]:
                start = i if start is None else start
            elif start is not None:
                out.add((start, i + q - start, q))
                start = None
    long = [r for r in out if r[1] >= max(least, repeats * r[2])]
    # of equal stretches the smallest period is the run's
    return sorted(r for r in long if not any(s[0] == r[0] and s[1] == r[1] and s[2] < r[2] for s in long))


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        n = max(j for j in range(1, len(w) - i + 1) if all(w[i : i + j] < w[i + k : i + j] for k in range(1, j)))
        out.append(n)
    return out


def test_lyndon_lengths():
    rng = random.Random(2)
    for _ in range(400):
        letters = rng.randint(1, 4)
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 24))]
        assert periods.lyndon_lengths(w, letters) == brute_lyndon(w), w


def _sequence(rng):
    w = []
    while len(w) < 60:
        root = [rng.randrange(3) for _ in range(rng.randint(1, 7))]
        w += (root * rng.randint(1, 8))[: rng.randint(1, 40)]
    return w


@pytest.mark.parametrize("least, repeats", [(6, 4), (3, 3), (1, 5)])
def test_runs_of_sequences(least, repeats):
    rng = random.Random(repeats)
    for _ in range(300):
        w = np.array(_sequence(rng))
        w = np.unique(w, return_inverse=True)[1]
        assert periods.runs_of(w, least, repeats) == brute_runs(w.tolist(), least, repeats)


def _texts(seed=4):
    rng = random.Random(seed)
    some = [" ".join(f"w{x}" for x in _sequence(rng)) for _ in range(60)]
    some += [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(20)]
    nested = ("a b " * 4 + "c ") * 5
    return [*some, "", None, " \t\n", "a", "a " * 6, "a\x0ba\x0ca a\ra\na", "x " * 5, "é x " * 9, nested, "A a " * 3000, "p q r " * 2 + "p q " * 12]


@pytest.mark.parametrize("least, repeats", [(6, 4), (4, 4)])
def test_texts(spark, least, repeats):
    rows = [(None if i == 3 else i, t, "n", 1) for i, t in enumerate(_texts())]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = periods.periodic_runs(docs, least=least, repeats=repeats)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    wanted = []
    for key, text, *_ in rows:
        w = words_of(text)
        runs = brute_runs(w, least, repeats)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        wanted.append((key, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_the_query(spark, sf):
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(rows)
    planted = 0
    for r in rows:
        w = words_of(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        if n > 3000:
            continue
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        got = found[r.doc_id]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert got.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert planted > 5


def test_equal_exponents_take_the_earlier_run(spark):
    rows = [(1, [(5, 12, 3), (9, 8, 2), (20, 8, 2), (30, 7, 2)]), (2, [(0, 9, 2), (1, 4_000_000_001, 1_000_000_000)]), (3, [])]
    df = spark.createDataFrame(rows, f"k int, runs {periods.RUNS}")
    from pyspark.sql import functions as F

    got = {r.k: r.best for r in df.select("k", periods.most_repeated(F.col("runs")).alias("best")).collect()}
    assert tuple(got[1]) == (5, 12, 3) and tuple(got[2]) == (0, 9, 2) and got[3] is None


def test_long_stretches_stay_quick():
    rng = np.random.default_rng(1)
    one = np.zeros(60_000, np.int64)
    assert periods.runs_of(one) == [(0, 60_000, 1)]
    falling = np.arange(30_000)[::-1].copy()
    assert periods.runs_of(falling) == [] and periods.runs_of(falling[::-1].copy()) == []
    root = rng.integers(0, 50, 900)
    assert (0, 36_000, 900) in periods.runs_of(np.tile(root, 40))
    with pytest.raises(ValueError):
        periods.periodic_runs(None, repeats=2)
