"""Nearest rows and the divisive tree against plain versions."""

import numpy as np
import pytest

from dyadic.operators import hierarchy
from dyadic.operators import neighbours as nb

SCHEMA = "drug_id long, vec array<double>"


def rows_of(kind, n=220, d=12):
    rng = np.random.default_rng(8)
    if kind == "clusters":
        centres = rng.standard_normal((9, d)) * 3
        x = centres[rng.integers(0, 9, n)] + 0.15 * rng.standard_normal((n, d))
    elif kind == "copies":
        x = rng.standard_normal((n, d))
        x[: n // 2] = x[0]
    else:
        x = rng.standard_normal((n, d))
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(1000, [2.0] * d), (1001, None), (1002, [None, float("nan")] + [float(v) for v in x[3][2:]])]


def plain_units(rows):
    out = {}
    for i, v in rows:
        if v is not None:
            z = np.array([0.0 if a is None or np.isnan(a) else a for a in v])
            c = z - z.mean()
            if np.linalg.norm(c) > 0:
                out[i] = c / np.linalg.norm(c)
    return out


def plain_nearest(rows, k):
    units = plain_units(rows)
    out = []
    for i, u in units.items():
        near = sorted((np.floor((1 - u @ v) * 1e9 + 0.5), j) for j, v in units.items() if j != i)[:k]
        out += [(i, r + 1, j, d / 1e9) for r, (d, j) in enumerate(near)]
    return sorted(out)


def assert_nearest(got, rows, k):
    got, want = sorted(tuple(r) for r in got.collect()), plain_nearest(rows, k)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 3e-9


@pytest.mark.parametrize("kind", ["clusters", "random", "copies"])
def test_nearest_rows_against_all_pairs(spark, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = nb.nearest_rows(df, 4, pivots=10, rings=3, block=16)
    assert_nearest(got, rows, 4)


def test_pruning_spares_most_meetings(spark):
    rows = rows_of("clusters", 600)
    df = spark.createDataFrame(rows, SCHEMA)
    got, sent = nb._nearest(df, 3, "vec", "drug_id", 24, 4, 64)
    n_rings = 24 * 4
    assert sent.count() < 0.35 * 600 * n_rings
    assert_nearest(got, rows, 3)


def test_nearest_rows_of_few_rows(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [1.0, 2.0, 3.0]), (3, None)], SCHEMA)
    assert sorted((r.drug_id, r.rank, r.neighbour) for r in nb.nearest_rows(few, 5).collect()) == [(1, 1, 2), (2, 1, 1)]
    assert nb.nearest_rows(few.where("drug_id = 3"), 2).count() == 0
    with pytest.raises(ValueError):
        nb.nearest_rows(few.union(few), 2)


def plain_tree(rows, leaves):
    units = plain_units(rows)
    at = {"": sorted(units)}
    height = lambda ids: float(((np.array([units[i] for i in ids]) - np.mean([units[i] for i in ids], axis=0)) ** 2).sum())
    order, heights = [], {"": height(at[""])}
    while len(at) < leaves:
        path = min(at, key=lambda p: (-heights[p], p))
        if heights[path] <= hierarchy.LEAST:
            break
        ids = at.pop(path)
        x = np.array([units[i] for i in ids])
        x = x - x.mean(axis=0)
        basis, axis = hierarchy.first_basis((x * x).mean(axis=0)), None
        for _ in range(hierarchy.PASSES):
            new, basis = hierarchy.ritz(basis, x.T @ (x @ basis))
            done, axis = axis is not None and new @ axis >= 1 - 1e-9, new
            if done:
                break
        order.append(path)
        for side, keep in (("0", x @ axis < 0), ("1", x @ axis >= 0)):
            at[path + side] = [i for i, k in zip(ids, keep) if k]
            heights[path + side] = height(at[path + side])
    return {i: p for p, ids in at.items() for i in ids}, order, heights


@pytest.mark.parametrize("kind", ["clusters", "random", "copies"])
def test_tree_against_plain_version(spark, kind):
    rows = rows_of(kind)
    tree = hierarchy.divisive_tree(spark.createDataFrame(rows, SCHEMA).repartition(5), 9)
    paths, order, heights = plain_tree(rows, 9)
    got = {r.drug_id: (r.path, r.cluster) for r in tree.rows.collect()}
    assert {i: p for i, (p, _) in got.items() if p is not None} == paths
    assert got[1000] == got[1001] == (None, None)
    nodes = {r.path: r for r in tree.nodes.collect()}
    assert [n.path for n in sorted((n for n in nodes.values() if n.split_order), key=lambda n: n.split_order)] == order
    for path, node in nodes.items():
        assert node.n == sum(p.startswith(path) for p in paths.values())
        assert abs(node.height - heights[path]) < 1e-4
        if path:
            assert node.height <= nodes[path[:-1]].height + 1e-6
    assert sorted({c for _, c in got.values() if c is not None}) == list(range(len(set(paths.values()))))


def test_tree_does_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(rows_of("random"), SCHEMA)
    grow = lambda n: sorted(map(tuple, hierarchy.divisive_tree(df.repartition(n), 6).rows.collect()))
    assert grow(1) == grow(7)


def test_axes_are_principal_axes():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 20)) * np.linspace(3, 1, 20)
    x -= x.mean(axis=0)
    basis = hierarchy.first_basis((x * x).mean(axis=0))
    for _ in range(hierarchy.PASSES):
        axis, basis = hierarchy.ritz(basis, x.T @ (x @ basis))
    top = np.linalg.eigh(x.T @ x)
    assert axis @ (x.T @ x) @ axis > 0.999 * top[0][-1]


def test_tree_of_equal_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 5.0]) for i in range(5)], SCHEMA)
    tree = hierarchy.divisive_tree(same, 4)
    assert {(r.path, r.cluster) for r in tree.rows.collect()} == {("", 0)} and tree.nodes.count() == 1
    none = hierarchy.divisive_tree(same.limit(0), 4)
    assert none.rows.count() == 0 and none.nodes.count() == 0
