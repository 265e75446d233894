"""Components of sets that share signatures, on groups whose members are nearly, but not quite, similar."""

import numpy as np
import pytest

from marketloom.llm import links

SCHEMA = "node long, n long, sketch binary, elements binary"


def _connected(sets: dict[int, np.ndarray], threshold_pct: int) -> dict[int, int]:
    """Component of every linked set, by comparing all pairs."""
    label = {node: node for node in sets}
    nodes = sorted(sets)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= threshold_pct * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {node: x if c == y else c for node, c in label.items()}
    sizes = {c: list(label.values()).count(c) for c in set(label.values())}
    return {node: c for node, c in label.items() if sizes[c] > 1}


def _found(spark, sets: dict[int, np.ndarray], groups: dict[int, list[int]], threshold_pct: int) -> dict[int, int]:
    shared = spark.createDataFrame([(s, a, min(members)) for s, members in groups.items() for a in members], "signature long, a long, b long")
    rows = [(node, len(x), links.odd_sketch(x), x.astype("<u8").tobytes()) for node, x in sets.items()]
    table = spark.createDataFrame([(n, k, bytearray(s), bytearray(e)) for n, k, s, e in rows], SCHEMA)
    parts = links.components_of(shared, lambda nodes: table.join(nodes, "node", "left_semi"), threshold_pct)
    return {r["node"]: r["component"] for r in parts.collect()}


def _family(rng, base: np.ndarray, own: int, count: int) -> list[np.ndarray]:
    return [np.unique(np.concatenate((base[: len(base) - own], links.mix(rng.integers(1, 2**63, own, dtype=np.uint64))))) for _ in range(count)]


@pytest.fixture(scope="module")
def crowd() -> dict[int, np.ndarray]:
    """700 sets of 20 elements that have 17 in common with all others (0.74), and chains of near copies (0.82 and more) among them."""
    rng = np.random.default_rng(5)
    sets = _family(rng, links.mix(rng.integers(1, 2**63, 20, dtype=np.uint64)), 3, 640)
    for x in sets[:20]:
        for _ in range(3):  # each differs from the one before in one of the elements, so the chain's ends are not similar
            x = np.sort(np.append(np.delete(x, rng.integers(len(x))), links.mix(rng.integers(1, 2**63, 1, dtype=np.uint64))))
            sets.append(x)
    order = rng.permutation(len(sets))
    return {int(node) + 1: sets[i] for node, i in enumerate(order)}


def test_no_step_lists_the_pairs_of_a_group(spark, crowd, monkeypatch):
    written, write = {}, links.materialize

    def counted(df, name):
        out = write(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(links, "materialize", counted)
    groups = {1: sorted(crowd), 2: sorted(crowd)[::2]}
    assert _found(spark, crowd, groups, 80) == _connected(crowd, 80)
    # the larger group is two blocks, so its members are three times in blocks at most, those of the other once
    assert max(written.values()) <= 3 * len(crowd) + len(groups[2]), written


def test_cells_of_many_elements_are_cut(spark, crowd, monkeypatch):
    few = {node: crowd[node] for node in sorted(crowd)[:300]}
    pairs = [(x, y) for x in range(300) for y in range(x + 1, 300) if (x + y) % 7 == 0]
    x, y = (np.array(v) for v in zip(*pairs))
    n, prints = np.full(300, 20), np.arange(300, dtype=np.uint64)
    monkeypatch.setattr(links, "CELL_ELEMENTS", 500)
    rows, cell = links._cells(x, y, n, prints)
    inside = {}
    for row, name in zip(rows.tolist(), cell.tolist()):
        inside.setdefault(name, set()).add(row)
    assert all(any({a, b} <= members for members in inside.values()) for a, b in pairs)
    assert max(map(len, inside.values())) <= 2 * (500 // 20 + 1)
    assert _found(spark, few, {1: sorted(few)}, 80) == _connected(few, 80)


def test_long_and_short_sets_of_one_group(spark):
    rng = np.random.default_rng(9)
    sets = []
    for size in (5, 9, 30, 200, 1500):
        base = links.mix(rng.integers(1, 2**63, size, dtype=np.uint64))
        sets += _family(rng, base, max(1, size // 9), 8) + _family(rng, base, size // 4, 8)
    sets = {i + 1: x for i, x in enumerate(sets)}
    assert _found(spark, sets, {s: [i for i in sorted(sets) if i % 3 != s] for s in range(4)}, 80) == _connected(sets, 80)
