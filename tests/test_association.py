"""Association at depth: nearest neighbours in the plane, phi-k of many levels, MIC and Kendall against plain computation."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.operators import association, neighbours, plane
from tabularium.operators import rows as rows_of


def psi(n):
    x = n + 8.0
    return math.log(x) - 0.5 / x - (1 / 12 - (1 / 120 - (1 / 252 - 1 / 240 / x**2) / x**2) / x**2) / x**2 - sum(1 / (n + i) for i in range(8))


def information_by_pairs(x, y, k=3):
    x, y = ((v - v.mean()) / v.std() if v.std() > 0 else np.zeros(len(v)) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    want, total = min(k, len(x) - 1), 0.0
    for i in range(len(x)):
        reach = np.sort(np.delete(d[i], i))[want - 1]
        if reach > 0:
            near = want, (dx[i] < reach * (1 - 1e-9)).sum(), (dy[i] < reach * (1 - 1e-9)).sum()
        else:
            near = (d[i] == 0).sum(), (dx[i] == 0).sum(), (dy[i] == 0).sum()
        total += psi(near[0]) - psi(near[1]) - psi(near[2])
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("cell", [12, 1024])
def test_information_in_the_plane_by_pairs(spark, monkeypatch, cell):
    """Features of all shapes at once: heavy tails, ties, mostly one value, few values, constant, thin strips."""
    monkeypatch.setattr(plane, "CELL", cell)
    rng = np.random.default_rng(1)
    n = 400
    y = rng.normal(size=n)
    made = {
        "linear": 2 * y + 0.1 * rng.normal(size=n), "noise": rng.normal(size=n), "tails": np.exp(4 * rng.normal(size=n)) + y, "rounded": np.round(y, 1),
        "mostly zero": np.where(rng.random(n) < 0.7, 0.0, y), "two": (y > 0).astype(float), "constant": np.ones(n), "shifted": 1e9 + y,
    }
    targets = {"plain": y, "zeros": np.where(rng.random(n) < 0.5, 0.0, y), "steps": np.round(y)}
    pairs = {f"{f} by {name}": (v, t) for f, v in made.items() for name, t in targets.items()}
    rows = pd.concat([pd.DataFrame({"feature": f, "x": v, "y": t}) for f, (v, t) in pairs.items()])
    got = {r.feature: r.mutual_info for r in plane.plane_information(spark.createDataFrame(rows)).collect()}
    assert got == {f: pytest.approx(information_by_pairs(v, t), abs=1e-6) for f, (v, t) in pairs.items()}


def test_information_in_the_plane_of_few_rows(spark):
    rows = [("one", 1.0, 2.0)] + [("three", float(i), float(i * i)) for i in range(3)] + [("same", 1.0, 1.0)] * 5 + [("nulls", None, 1.0), ("nulls", 1.0, float("nan")), ("nulls", 1.0, 2.0)]
    got = {r.feature: r.mutual_info for r in plane.plane_information(spark.createDataFrame(rows, "feature string, x double, y double")).collect()}
    assert got == {"three": pytest.approx(information_by_pairs(np.arange(3.0), np.arange(3.0) ** 2)), "same": 0.0}
    assert plane.plane_information(spark.createDataFrame([], "feature string, x double, y double")).collect() == []


def test_information_takes_each_pair_of_kinds(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"f": y + 0.2 * rng.normal(size=300), "c": np.where(y > 0, "a", "b"), "_y": y}))
    got = {r.feature: r.mutual_info for r in neighbours.information(df, ["f", "c"], "_y", ["f", "_y"]).collect()}
    assert got["f"] == pytest.approx(information_by_pairs(df.toPandas().f.to_numpy(), y), abs=1e-6) and 0.5 < got["c"] < 0.9


def correlation_by_integration(table, steps=400):
    """Bisection over rectangles of a bivariate normal, integrated on a fine grid."""
    n = table.sum()
    a, b = table.sum(axis=1) / n, table.sum(axis=0) / n
    want = n * ((table / n - np.outer(a, b)) ** 2 / np.outer(a, b)).sum() - (len(a) - 1) * (len(b) - 1)
    if want <= 0:
        return 0.0
    cut = lambda s: np.array([-9.0, *[NormalDist().inv_cdf(v) for v in np.cumsum(s)[:-1]], 9.0])
    xs, ys = cut(a), cut(b)
    erf = np.vectorize(math.erf)

    def chi_of(r):
        p = np.empty((len(a), len(b)))
        for i in range(len(a)):
            h = (xs[i + 1] - xs[i]) / steps
            mid = xs[i] + h * (np.arange(steps) + 0.5)
            upto = 0.5 * (1 + erf((ys - r * mid[:, None]) / math.sqrt(2 * (1 - r * r))))
            p[i] = (np.exp(-mid * mid / 2) / math.sqrt(2 * math.pi) * h) @ np.diff(upto, axis=1)
        return n * ((p - np.outer(a, b)) ** 2 / np.outer(a, b)).sum()

    lo, hi = 0.0, 0.9999
    for _ in range(20):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_of(mid) < want else (lo, mid)
    return hi


@pytest.mark.parametrize("at_once", [1000, 3])
def test_phi_k_by_integration(spark, monkeypatch, at_once):
    monkeypatch.setattr(association, "TASK_LEVELS", at_once)
    rng = np.random.default_rng(3)
    y = rng.normal(size=3000)
    df = pd.DataFrame({"weak": np.digitize(0.3 * y + rng.normal(size=3000), [-1, 0, 0.5]), "strong": np.digitize(y + 0.3 * rng.normal(size=3000), [-1.5, -0.5, 0.2, 1]), "none": rng.integers(0, 4, 3000), "_t": np.digitize(y, [-1, 0.3, 1])})
    df["gone"] = None
    got = {r.feature: r.phik for r in association.phi_k(spark.createDataFrame(df, "weak int, strong int, none int, _t int, gone int"), ["weak", "strong", "none", "gone"], "_t").collect()}
    assert got == {c: pytest.approx(correlation_by_integration(pd.crosstab(df[c], df._t).to_numpy()), abs=2e-4) for c in ("weak", "strong", "none")} | {"gone": None}


def test_phi_k_of_many_levels(spark):
    """500 by 500 levels of a normal of known correlation; equal columns are all but 1."""
    rng = np.random.default_rng(4)
    y = rng.normal(size=400_000)
    x = 0.6 * y + 0.8 * rng.normal(size=len(y))
    cut = lambda v: np.digitize(v, [NormalDist().inv_cdf(i / 500) for i in range(1, 500)])
    df = spark.createDataFrame(pd.DataFrame({"x": cut(x), "_t": cut(y)}))
    got = {r.feature: r.phik for r in association.phi_k(df.withColumn("same", F.col("_t")), ["x", "same"], "_t").collect()}
    assert got["x"] == pytest.approx(0.6, abs=0.01) and got["same"] > 0.99


def grids_by_enumeration(x, y, exponent=0.6):
    """The best over even rows of y and all columns of x, and the other way round."""
    from itertools import combinations

    n, best = len(x), 0.0
    most = max(4.0, n**exponent)
    for u, v in ((x, y), (y, x)):
        size = np.unique(v, return_counts=True)
        middle = np.cumsum(size[1]) - size[1] / 2
        places = np.unique(u)
        for rows in range(2, int(most // 2) + 1):
            of = dict(zip(size[0].tolist(), np.minimum(middle * rows / n, rows - 1).astype(int).tolist()))
            row = np.unique([of[b] for b in v.tolist()], return_inverse=True)[1]
            for columns in range(2, int(most // (row.max() + 1)) + 1):
                for cut in combinations(range(1, len(places)), columns - 1):
                    column = np.searchsorted(places[list(cut)], u, "right")
                    joint = np.zeros((columns, row.max() + 1))
                    np.add.at(joint, (column, row), 1 / n)
                    p = joint[joint > 0]
                    info = (p * np.log(p / np.outer(joint.sum(1), joint.sum(0))[joint > 0])).sum()
                    if row.max():
                        best = max(best, info / math.log(min(columns, row.max() + 1)))
    return best


@pytest.mark.parametrize("seed", range(2))
def test_mic_by_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=26), 2 if seed else 0)
    made = {"square": x * x + 0.1 * rng.normal(size=26), "noise": rng.normal(size=26), "steps": np.round(x), "same": x}
    df = spark.createDataFrame(pd.DataFrame(made | {"_t": x}))
    got = {r.feature: r.mic for r in association.mic(df, list(made), "_t").collect()}
    assert got == {c: pytest.approx(grids_by_enumeration(v, x), abs=1e-9) for c, v in made.items()}


def test_grids_finer_than_before_are_searched():
    """A wave of 40 half-turns needs 40 columns; rows beyond the steps take no time."""
    x = np.arange(6000)
    y = np.argsort(np.argsort(np.sin(np.pi * x / 150) + 1e-9 * x))
    i, j = x * 1000 // 6000, y * 1000 // 6000
    counts = np.zeros((1000, 1000))
    np.add.at(counts, (i, j), 1)
    assert association.grid_information(counts) > 0.95
    assert association.grid_information(np.eye(16) * 10**9) == pytest.approx(1.0)  # as fast as for few rows


def kendall_by_pairs(x, y):
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()) if (a * a).sum() and (b * b).sum() else None


@pytest.mark.parametrize("share,few", [(0.0, 2), (0.5, 10_000), (0.99, 2)])
def test_kendall_of_skewed_targets(spark, monkeypatch, share, few):
    monkeypatch.setattr(association, "FEW_LEVELS", few)
    rng = np.random.default_rng(7)
    n = 800
    y = np.where(rng.random(n) < share, 5.0, rng.integers(-300, 300, n) / 7)
    made = {"a": y + rng.normal(size=n) * 50, "b": rng.integers(0, 3, n).astype(float), "constant": np.ones(n)}
    df = spark.createDataFrame(pd.DataFrame(made | {"_y": y}))
    got = {r.feature: r.kendall for r in association.kendall_scores(df, list(made)).collect()}
    assert got == {c: pytest.approx(kendall_by_pairs(v, y), abs=1e-9) if kendall_by_pairs(v, y) is not None else None for c, v in made.items()}
    codes, bits = association.split_codes(df)
    groups = {}
    weight = dict(zip(*np.unique(y, return_counts=True)))
    for r in codes.collect():
        for level in range(r.depth):
            groups.setdefault((level, r.code >> bits - level), []).append(weight[r._y])
    assert all(sum(g) <= 2 * n / 2**level + 1 for (level, _), g in groups.items() if len(g) > 1) and all(len(g) > 1 for g in groups.values())


# --- rows that fuller rows agree with ---------------------------------------------------------------------------------


def undominated(data):
    rows = {tuple((x.strip() or None) if isinstance(x, str) else x for x in r) for r in data}
    rows = [r for r in rows if any(r)]
    covers = lambda a, b: a != b and all(x is None or x == y for x, y in zip(a, b))
    return sorted(map(str, (r for r in rows if not any(covers(r, b) for b in rows))))


@pytest.mark.parametrize("levels,filled,parents", [(60, 0.2, 400), (2, 0.5, 300)])
def test_dominated_rows_of_sparse_and_dense_tables(spark, levels, filled, parents):
    """40 columns with thousands of patterns, and tables of a few common values, where whole patterns are joined."""
    rng = np.random.default_rng(11)
    width = 40 if levels > 3 else 8
    full = [[f"v{rng.integers(levels)}" if rng.random() < filled else None for _ in range(width)] for _ in range(parents)]
    data = [tuple(r) for r in full]
    for r in full:
        for _ in range(6):  # parts of it, some with a changed cell
            part = [x if rng.random() < 0.6 else None for x in r]
            if rng.random() < 0.3:
                part[rng.integers(width)] = f"v{rng.integers(levels)}"
            data.append(tuple(part))
    data += [(" ",) * width, (None,) * width, data[0]]
    columns = [f"c{i}" for i in range(width)]
    if levels > 3:
        assert len({tuple(x is None for x in r) for r in data}) > 2000
    got = rows_of.drop_dominated(spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns)), columns)
    assert sorted(str(tuple(r)) for r in got.collect()) == undominated(data)
    assert rows_of.drop_dominated(got.limit(0), columns).collect() == []
