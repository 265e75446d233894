"""Hard negatives against brute force: ties, nulls, repeated rows, other lengths, several blocks and groups."""

import math
import random

import numpy as np
import pytest

from marketloom.llm import hard_negatives
from marketloom.llm.hard_negatives import mine

KIND = "vec_id long, embedding array<float>, label int, slot string, score int, rank int"


def brute(rows, every, relabel):
    """Anchors of one id are the first by label and vector."""
    rows = [(i, (l + 1) % relabel[1] if i is not None and i % relabel[0] == 0 else l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in rows:
        if i is not None and i % every == 0:
            anchors[i] = min(anchors.get(i, (l, v)), (l, v))
    out = []
    for a, (label, vector) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(v, vector)), i is None, i or 0, l) for i, l, v in rows if i != a and len(v) == len(vector)))
        for s, none, p, _ in [x for x in scored if x[3] == label][:5]:
            found = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, None if none else p, k + 1, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(found)]
    return sorted(out, key=str)


def rows(seed, n=400, dim=8, values=None):
    rng = random.Random(seed)
    out = [(i, [rng.choice(values) if values else rng.gauss(0, 0.3) for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    return out + [(None, out[3][1], 1), (n, None, 1), (n + 1, [1.0, None] + [0.0] * (dim - 2), 1), (n + 2, [float("nan")] * dim, 0), (n + 3, [float("inf")] * dim, 0), (n + 4, out[0][1], None), (50, [0.5, 0.5], 1), (51, [0.5, 0.5], 1), (52, [0.4, 0.4], 2), (60, [], 2), out[7], out[7], out[10], (20, out[9][1], 2)]


def got(spark, table, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in table], KIND).repartition(7)
    return sorted(map(tuple, mine(df, relabel=(7, 3), **options).collect()), key=str)


@pytest.mark.parametrize("values", [None, [0.0, 0.25, 0.5, 1.0]])
def test_brute_force(spark, monkeypatch, values):
    table = rows(1, values=values)
    assert got(spark, table, every=10) == brute(table, 10, (7, 3))
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "GROUP", 20)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    assert got(spark, table, every=10) == brute(table, 10, (7, 3))


def test_copies_and_large_numbers(spark):
    """A third of all rows is one vector; components whose scores no place fits beside."""
    table = rows(2, 200)
    table += [(1000 + i, table[5][1], i % 3) for i in range(150)]
    assert got(spark, table, every=10) == brute(table, 10, (7, 3))
    table = [(i, [float(2**20 + 8 * (i % 13)), float(i % 5)], i % 3) for i in range(120)]
    assert got(spark, table, every=10) == brute(table, 10, (7, 3))
    assert got(spark, [], every=10) == [] and got(spark, [(1, [1.0], 1)], every=10) == []


def test_bounds_skip(monkeypatch):
    """Leaves are scored only where their bounds reach."""
    rng = np.random.default_rng(1)
    centre = rng.integers(-200, 200, (6, 16))
    vectors = np.repeat(centre, 20, 0) + rng.integers(-3, 4, (120, 16))
    block = hard_negatives.Block(np.arange(120), np.zeros(120, int), vectors)
    assert 0 < block.n_inner < 120
    rows = rng.integers(-200, 200, (50, 16))
    exact = block.vectors @ rows.T
    least = np.sort(exact, 1)[:, -3].astype(float)
    scores = block.scores(rows, np.ones(exact.shape, bool), least, np.full(120, np.inf))
    known = scores != hard_negatives.NONE
    assert (scores[known] == exact[known]).all() and known[exact >= least[:, None]].all()
    assert known[block.n_inner :].mean() < 0.3


def test_spanning_tree():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 5))
    parent, length = hard_negatives.spanning_tree(vectors)
    far = np.linalg.norm(vectors[:, None] - vectors[None], axis=2)
    todo, total = {*range(1, 40)}, 0.0
    inside = {0}
    while todo:
        d, j = min((far[i, j], j) for i in inside for j in todo)
        total += d
        inside.add(j)
        todo.remove(j)
    assert np.isclose(length.sum(), total) and (parent < 0).sum() == 1
