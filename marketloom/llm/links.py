"""Connected groups of similar sets, from signatures that similar sets share.

Pairs inside a group of equal signatures are never listed:

1. Sets that are equal form a class; the smallest node stands for it.
2. Each class is compared with the smallest member (hub) of its signature groups, first with the hub it
   shares most signatures with, then with those that are still in another component.
3. What is left are groups with members in several components. Their members are compared by sketches, block by block,
   but what is listed is a forest only: so many pairs as join the components that may be linked, the nearest. Sketches are folded
   for this, as a set is in many groups. What is still apart after these are verified is never listed by pairs: sets that may be
   similar by way of others are a cell, so a block hands on each member once at most. Sets join their cells, and inside a cell
   pairs are verified, the nearest first, unless the links before have joined them; a forest of links comes out.

Before sets are compared, odd sketches (the parity of the elements in each of several buckets) give a
lower bound on how much they differ, which drops pairs below the threshold without their sets. Every
kept link has been verified on the sets, as 64-bit hashes of their elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import FEW, discard, free_shuffles, materialize, small_enough, tidy
from marketloom.llm.components import components


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_bits(n: int) -> int:
    return max(64, 1 << (8 * n).bit_length())


def odd_sketch(elements: np.ndarray) -> bytes:
    """Parities of the elements in buckets, at least eight for each element, so that few differences hide each other."""
    bits = sketch_bits(len(elements))
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound on the number of elements in just one of two sets, from their odd sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # buckets are low bits of the hash: fold the longer sketch
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _pair_schema(df: DataFrame) -> T.StructType:
    kind = df.schema["a"].dataType
    return T.StructType([T.StructField("a", kind), T.StructField("b", kind)])


def _both(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with what ``left`` has for ``a`` and ``right`` for ``b``. Few pairs are broadcast, so only what they need is moved, once."""
    if small_enough(pairs, FEW):
        few = F.broadcast(pairs)
        return left.join(few, "a").join(right.join(few, "b"), ["a", "b"])
    return pairs.join(left, "a").join(right, "b")


def sketch_filter(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (``a``, ``b``) that sizes and sketches allow to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, sa, nb, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb"))):
                most = (na + nb) * (100 - threshold_pct) // (100 + threshold_pct)
                keep.append(differ_at_least(sa, sb) <= most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = _both(pairs, left, right).where((F.col("na") * 100 >= F.col("nb") * threshold_pct) & (F.col("nb") * 100 >= F.col("na") * threshold_pct))
    return near.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(tidy(run), _pair_schema(pairs))


def similar(x: np.ndarray, y: np.ndarray, threshold_pct: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold_pct * (len(x) + len(y) - common)


def verify(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ea"), batch.column("eb")):
                keep.append(similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), threshold_pct))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    return _both(pairs, left, right).select("a", "b", "ea", "eb").mapInArrow(tidy(run), _pair_schema(pairs))


def across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    x = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    y = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


#: Members of a group that are compared at once.
SIDE = 512
#: Comparisons of two sketches that a task is given, about.
TASK_COMPARISONS = 20_000_000
#: Elements of a cell's sets that are held at once, twice at most; a larger cell is compared part by part.
CELL_ELEMENTS = 1 << 20
#: Bytes of sets that a task is given, about.
TASK_BYTES = 64 << 20


def _stack(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sketches of one group as rows of 64-bit words, all folded to the shortest."""
    least = int(size.min())
    out = np.empty((len(size), least), np.uint8)
    for i, (a, n) in enumerate(zip(begin.tolist(), size.tolist())):
        x = data[a : a + n]
        while n > least:  # buckets are low bits of the hash
            n //= 2
            x = x[:n] ^ x[n:]
        out[i] = x
    return out.view(np.uint64)


def _compare(bits: np.ndarray, n: np.ndarray, code: np.ndarray, side: np.ndarray, threshold_pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group (two blocks, or one with itself) across components that sizes and sketches allow, and how much they differ."""
    rows, columns = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    out: list[tuple] = []
    step = max(1, (1 << 19) // max(1, len(columns) * bits.shape[1]))
    for at in range(0, len(rows), step):
        i = rows[at : at + step]
        total = n[i][:, None] + n[columns][None]
        fits = (code[i][:, None] != code[columns][None]) & (n[i][:, None] * 100 >= n[columns][None] * threshold_pct) & (n[columns][None] * 100 >= n[i][:, None] * threshold_pct)
        if not fits.any():
            continue
        differ = np.bitwise_count(bits[i][:, None] ^ bits[columns][None]).sum(2, dtype=np.int64)
        fits &= differ <= total * (100 - threshold_pct) // (100 + threshold_pct)
        x, y = np.nonzero(fits)
        keep = (side[i[x]] != side[columns[y]]) | (i[x] < columns[y])
        x, y = x[keep], y[keep]
        out.append((i[x], columns[y], differ[x, y]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(x: np.ndarray, y: np.ndarray, code: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which pairs, by rising ``order``, join all components that the pairs connect: each round takes every component's first pair out."""
    by = np.argsort(order, kind="stable")
    label = np.unique(code, return_inverse=True)[1]
    taken = []
    while True:
        a, b = label[x[by]], label[y[by]]
        by = by[a != b]
        if not len(by):
            return np.unique(np.concatenate(taken)) if taken else by
        a, b = label[x[by]], label[y[by]]
        _, first = np.unique(np.concatenate((a, b)), return_index=True)
        chosen = np.unique(first % len(by))
        taken.append(by[chosen])
        parent = list(range(int(label.max()) + 1))
        for i, j in zip(a[chosen].tolist(), b[chosen].tolist()):
            parent[_root(parent, i)] = _root(parent, j)
        label = np.array([_root(parent, i) for i in range(len(parent))])[label]


def _cells(x: np.ndarray, y: np.ndarray, n: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, the cell of each): rows that the pairs connect are a cell, named by all its members' ``prints``.

    A cell of more than ``CELL_ELEMENTS`` is cut into parts; each two parts are a cell then.
    """
    rows, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    label = np.arange(len(rows))
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    order = np.argsort(label, kind="stable")
    rows, label = rows[order], label[order]
    first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    size = np.diff(np.append(first, len(rows)))
    name = lambda of, begin, size: mix(np.add.reduceat(mix(prints[of]), begin) + size.astype(np.uint64))
    cell = np.repeat(name(rows, first, size), size)
    large = np.add.reduceat(n[rows], first) > CELL_ELEMENTS
    if not large.any():
        return rows, cell
    whole = ~np.repeat(large, size)
    out = [(rows[whole], cell[whole])]
    for a, z in zip(first[large].tolist(), (first + size)[large].tolist()):
        part = np.cumsum(n[rows[a:z]]) // CELL_ELEMENTS
        part = np.unique(part, return_inverse=True)[1]
        for low in range(int(part.max()) + 1):
            for high in range(min(low + 1, int(part.max())), int(part.max()) + 1):
                two = rows[a:z][(part == low) | (part == high)]
                out.append((two, np.repeat(name(two, np.zeros(1, np.int64), np.array([len(two)])), len(two))))
    return tuple(np.concatenate(v) for v in zip(*out))


#: Times a sketch is halved before it goes to every group that its set is in: a bit or two for each element are left.
HALVED = 3
#: Bytes of a sketch that is not halved any more: no more than the rest of its row.
SLIM = 32


def slim(sets: DataFrame) -> DataFrame:
    """``node``, ``n`` and the folded ``sketch``: far fewer bytes, whose bound is lower but still tells most other sets apart."""
    kind = sets.schema["node"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("sketch"):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                for _ in range(HALVED):
                    if len(x) > SLIM:
                        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(out, pa.binary())], ["node", "n", "sketch"])

    schema = T.StructType([T.StructField("node", kind), sets.schema["n"], T.StructField("sketch", T.BinaryType())])
    return sets.select("node", "n", "sketch").mapInArrow(tidy(run), schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups and where each begins (with the end); rows come in order of ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in keys]
        if last is not None and last == tuple(k[-1] for k in key) and all((k == k[0]).all() for k in key):
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        key = [rows[k].to_numpy() for k in keys]
        first = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])))
        if len(first) > 1:
            yield rows.slice(0, int(first[-1])).combine_chunks(), first
        held, last = rows.slice(int(first[-1])).to_batches(), tuple(k[-1] for k in key)
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.array([0, rows.num_rows])


def _binary(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the n + 1 offsets."""
    values = rows[column].combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8), ends.astype(np.int64)


def _as_parts(df: DataFrame, asked: float, *keys: str) -> DataFrame:
    """``df`` in order of ``keys``, in so many partitions as are asked for, and the session's number at least."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(asked, 100_000))), *keys).sortWithinPartitions(*keys)


def _blocks(left: DataFrame, sets: DataFrame, *more) -> DataFrame:
    """Members of ``signature`` groups with their sketches, a row for each two blocks (``low``, ``high``) that they are compared in.

    Members are dealt to blocks of about ``SIDE``; two blocks are compared by their sketches, and a group with many
    ``members`` is many tasks: partitions are as many as the comparisons ask for. Rows stream in order of their group, so a
    task holds two blocks at a time.
    """
    keys = ("signature", "low", "high")
    sketched = left.join(sets.select(F.col("node").alias("a"), "n", "sketch"), "a")
    blocks = F.ceil(F.col("members") / SIDE).cast("int")
    dealt = sketched.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    work = left.select("signature", "members").distinct().agg(F.sum(F.col("members") * F.col("members") / 2.0)).first()[0] or 0
    # components are only told apart, so a hash of theirs will do
    dealt = dealt.select(*keys, "block", "a", F.xxhash64("c").alias("c"), F.col("n").cast("long").alias("n"), "sketch", *more)
    return _as_parts(dealt, work / TASK_COMPARISONS, *keys)


def _allowed(batches: Iterator[pa.RecordBatch], threshold_pct: int) -> Iterator[tuple[pa.Table, Iterator[tuple]]]:
    """Rows of :func:`_blocks`, and of each two blocks there: where they begin and end, and the pairs that :func:`_compare` finds, if any."""

    def pairs(rows: pa.Table, first: np.ndarray) -> Iterator[tuple]:
        n, code, side = (rows[c].to_numpy() for c in ("n", "c", "block"))
        data, ends = _binary(rows, "sketch")
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            if z - a < 2 or (code[a:z] == code[a]).all():
                continue
            x, y, differ = _compare(_stack(data, ends[a:z], ends[a + 1 : z + 1] - ends[a:z]), n[a:z], code[a:z], side[a:z], threshold_pct)
            if len(x):
                yield a, z, x, y, differ

    for rows, first in _whole_groups(batches, ["signature", "low", "high"]):
        yield rows, pairs(rows, first)


def near_pairs(left: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (``a``, ``b``) across components (``c``) of a ``signature`` group that sizes and sketches allow: of two blocks a forest
    of the nearest, fewer than they have members."""
    schema = T.StructType([T.StructField(c, sets.schema["node"].dataType) for c in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pairs in _allowed(batches, threshold_pct):
            code, found = rows["c"].to_numpy(), []
            for a, z, x, y, differ in pairs:
                kept = _forest(x, y, code[a:z], differ)
                found.append((x[kept] + a, y[kept] + a))
            if found:
                nodes = rows["a"].combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(np.concatenate(v))) for v in zip(*found)], ["a", "b"])

    found = _blocks(left, sets).mapInArrow(tidy(run), schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_cells(left: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """``cell``, ``a``, ``c`` and ``n`` of the members that sizes and sketches allow to be linked with one of another component ``c``.

    All such pairs are inside a cell. The same members of many groups are one cell.
    """
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("a", sets.schema["node"].dataType), T.StructField("c", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pairs in _allowed(batches, threshold_pct):
            n, prints, found = rows["n"].to_numpy(), rows["print"].to_numpy().view(np.uint64), []
            for a, z, x, y, _ in pairs:
                at, cell = _cells(x, y, n[a:z], prints[a:z])
                found.append((at + a, cell))
            if found:
                at, cell = (np.concatenate(v) for v in zip(*found))
                columns = [rows[c].combine_chunks().take(pa.array(at)) for c in ("a", "c", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *columns], schema.names)

    return _blocks(left, sets, F.xxhash64("a").alias("print")).mapInArrow(tidy(run), schema).distinct()


def cell_links(cells: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Verified links (``a``, ``b``) that join all components of a ``cell`` that any links join: a forest, fewer than it has members."""
    schema = T.StructType([T.StructField(c, cells.schema["a"].dataType) for c in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _whole_groups(batches, ["cell"]):
            code = rows["c"].to_numpy()
            data, ends = _binary(rows, "elements")
            pairs: list[tuple[int, int]] = []
            for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                members = [data[i:j].view("<u8") for i, j in zip(ends[a:z].tolist(), ends[a + 1 : z + 1].tolist())]
                sketches = [odd_sketch(x) for x in members]
                size = np.array([len(x) for x in sketches], np.int64)
                bits = _stack(np.frombuffer(b"".join(sketches), np.uint8), np.cumsum(size) - size, size)
                x, y, differ = _compare(bits, np.array([len(x) for x in members], np.int64), code[a:z], np.zeros(z - a, np.int32), threshold_pct)
                label = np.unique(code[a:z], return_inverse=True)[1].tolist()
                parent = list(range(len(label)))
                by = np.argsort(differ, kind="stable")
                for i, j in zip(x[by].tolist(), y[by].tolist()):
                    p, q = _root(parent, label[i]), _root(parent, label[j])
                    if p != q and similar(members[i], members[j], threshold_pct):
                        parent[p] = q
                        pairs.append((a + i, a + j))
            if pairs:
                nodes = rows["a"].combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(x)) for x in zip(*pairs)], ["a", "b"])

    comparisons = F.col("members") * F.col("members") / (2.0 * TASK_COMPARISONS)
    work = cells.groupBy("cell").agg(F.count("*").alias("members"), F.sum("n").alias("n")).agg(F.sum(comparisons), F.sum(F.col("n") * 8 / TASK_BYTES)).first()
    few = F.broadcast(cells) if small_enough(cells, FEW) else cells
    joined = sets.select(F.col("node").alias("a"), "elements").join(few.select("cell", "a", "c"), "a").select("cell", "a", "c", "elements")
    found = _as_parts(joined, max(work[0] or 0, work[1] or 0), "cell").mapInArrow(tidy(run), schema)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components_of(shared: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold_pct: int) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable by links, of nodes that have any link.

    ``shared``: a row for each ``signature`` and each class ``a`` (a node of any type that has an order) that
    shares it with others; ``b`` is the group's smallest member, or the smallest of a part of it. ``sets_of``
    gives ``node``, ``n``, ``sketch`` and ``elements`` (sorted distinct 64-bit hashes) of a table of nodes.
    """
    free_shuffles(shared.sparkSession)
    stars = materialize(shared.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("common")), "hub-pairs")

    wanted = materialize(shared.select(F.col("a").alias("node")).distinct(), "candidates")
    sets = materialize(sets_of(wanted), "candidate-sets")

    links, parts = None, None

    def grow(pairs: DataFrame) -> None:
        near = materialize(sketch_filter(materialize(pairs, "pairs"), sets, threshold_pct), "near-pairs")
        link(materialize(verify(near, sets, threshold_pct), "links"))

    def link(found: DataFrame) -> None:
        nonlocal links, parts
        if parts is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            parts = components(links)

    grow(stars.groupBy("a").agg(F.min_by("b", F.struct(-F.col("common"), F.col("b"))).alias("b")))
    grow(across(stars.select("a", "b"), parts))

    def mixed_groups() -> DataFrame:
        free_shuffles(shared.sparkSession)
        placed = shared.select("signature", "a").distinct().join(parts.select(F.col("node").alias("a"), "component"), "a", "left").select("signature", "a", F.coalesce("component", "a").alias("c"))
        mixed = placed.groupBy("signature").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members")).where("low <> high").select("signature", "members")
        return materialize(placed.join(mixed, "signature"), "mixed-groups")

    # what two hub rounds leave: groups with members in several components
    small = materialize(slim(sets), "slim-sketches")
    left = mixed_groups()
    grow(near_pairs(left, small, threshold_pct))
    discard(left)
    left = mixed_groups()
    cells = materialize(near_cells(left, small, threshold_pct), "cells")
    discard(left)
    link(materialize(cell_links(cells, sets, threshold_pct), "links"))

    for used in (stars, wanted, sets, small, cells):
        discard(used)
    return parts
