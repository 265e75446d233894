"""Hard negatives of anchors by inner product, with bounds along a spanning tree of the anchors.

Vectors become whole numbers (``floor(scale * x)``), so that scores are exact. Anchors are handled in blocks of ``ANCHORS``:
a block's anchors are joined by a minimum spanning tree, and every inner node of it is scored against all candidates. A leaf
is bounded instead: the score of its parent, plus and minus the length of the edge times the candidate's norm. Only where
these bounds reach what the leaf looks for is it scored again: its best of its own label in the first pass over the
candidates, and the windows under its positives' scores in the second.

Each pass scans the candidates once for a group of blocks; tasks keep a few rows for each anchor, and these are ranked by
anchor. Nothing but a group of blocks (``GROUP`` anchors) is broadcast or held by the driver, whatever the table's size.

Cases: rows with a null label or vector, or a null or non-finite component take no part. Vectors of another length than an
anchor's have no score with it. A null id is no anchor and comes last among ties. Of rows repeated under one id each is a
candidate; the anchor of that id is the first by label and vector, and rows of its id are not its candidates. An anchor
without positives, or a positive without negatives, has no row. Extra columns are left out, so clashing names cannot disturb.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import discard, materialize

#: Anchors of one spanning tree.
ANCHORS = 1_024
#: Anchors that are broadcast at once, in blocks.
GROUP = 8 * ANCHORS
#: Candidates that are scored at once.
ROWS = 2_048
#: Scores within this are exact as floating-point numbers, with room for a candidate's place beside them.
EXACT = 2**40
NONE = np.iinfo(np.int64).min
#: Beyond any score, in hundredths.
FAR = 2**62


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents (-1: the root) and lengths of the edges of a minimum spanning tree, by Prim's method."""
    n = len(vectors)
    parent, length, open_ = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    norms, at = (vectors * vectors).sum(1), 0
    for _ in range(n - 1):
        open_[at] = False
        far = np.sqrt(np.maximum(norms + norms[at] - 2 * (vectors @ vectors[at]), 0))
        nearer = open_ & (far < length)
        parent[nearer], length[nearer] = at, far[nearer]
        at = int(np.argmin(np.where(open_, length, np.inf)))
    length[parent < 0] = 0
    return parent, length


class Block:
    """Anchors of one length of vectors with their tree: which are scored, and how the leaves are bounded."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, slots: np.ndarray | None = None):
        parent, length = spanning_tree(vectors.astype(np.float64))
        inner = np.zeros(len(ids), bool)
        inner[parent[parent >= 0]] = True
        inner[parent < 0] = True
        order = np.append(np.flatnonzero(inner), np.flatnonzero(~inner))
        place = np.argsort(order)
        #: The first ``n_inner`` are scored against all candidates; leaves follow.
        self.n_inner, self.parent, self.length = int(inner.sum()), place[parent[order]], length[order]
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        if low is not None:  # scores that an anchor's positives ask for: in hundredths, of each positive
            self.low, self.high, self.slots = low[order], high[order], slots[order]

    def scores(self, rows: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Scores of anchors (down) and candidates; ``NONE`` for a leaf's candidates that are not allowed or out of its bounds.

        ``least``, ``most``: what each anchor looks for.
        """
        exact = np.abs(rows).max(initial=0).astype(np.float64) * np.abs(self.vectors).max(initial=0) * rows.shape[1] < EXACT
        kind = np.float64 if exact else np.int64
        rows, anchors, k = rows.astype(kind), self.vectors.astype(kind), self.n_inner
        out = np.full((len(anchors), len(rows)), NONE)
        out[:k] = anchors[:k] @ rows.T
        if k < len(anchors):
            norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
            near = out[self.parent[k:]].astype(np.float64)
            reach = self.length[k:, None] * norms * (1 + 1e-9) + 1e-6 * (1 + np.abs(near))
            asked = allowed[k:] & (near + reach >= least[k:, None]) & (near - reach <= most[k:, None])
            for i in np.flatnonzero(asked.any(1)):
                some = np.flatnonzero(asked[i])
                out[k + i, some] = rows[some] @ anchors[k + i]
        return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row that are not ``NONE``; of equal ones the first columns."""
    n = scores.shape[1]
    if not n or not len(scores):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= k:
        return np.nonzero(scores != NONE)
    some = scores != NONE
    if np.abs(np.where(some, scores, 0)).max() >= EXACT:  # too large for a place beside them
        order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -np.where(some, scores, NONE + 1)), axis=1)[:, :k]
        row = np.repeat(np.arange(len(scores)), k)
        column = order.ravel()
    else:
        keyed = np.where(some, scores * n + (n - 1 - np.arange(n)), NONE)
        column = np.argpartition(keyed, n - k, axis=1)[:, n - k :].ravel()
        row = np.repeat(np.arange(len(scores)), k)
    keep = some[row, column]
    return row[keep], column[keep]


def _candidates(batch: pa.RecordBatch, scale: float, relabel: tuple[int, int] | None) -> Iterator[tuple]:
    """(ids, which are null, labels, whole vectors) of the rows that take part, by length of vector and rising id."""
    lists = batch.column("embedding")
    lists = lists.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(lists.type) else lists
    sizes = np.array([-1 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    good = (sizes >= 0) & np.asarray(batch.column("label").is_valid()) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    no_id = ~np.asarray(batch.column("vec_id").is_valid())
    ids = batch.column("vec_id").fill_null(2**63 - 1).to_numpy()
    labels = batch.column("label").fill_null(0).to_numpy().astype(np.int64)
    if relabel:
        labels = np.where((ids % relabel[0] == 0) & ~no_id, (labels + 1) % relabel[1], labels)
    for size in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == size))
        at = at[np.lexsort((no_id[at], ids[at]))]
        vectors = np.floor(values[(ends[at] - size)[:, None] + np.arange(size)] * scale)
        yield ids[at], no_id[at], labels[at], np.clip(vectors, -(2.0**62), 2.0**62).astype(np.int64)


KIND = "anchor_id long, slot int, row_id long, score long"


class _Kept:
    """The best rows of each (anchor, slot) that a task has met: at most k of each, in id order among equals."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n > 4_000_000:
            self.close()

    def close(self) -> list[np.ndarray]:
        """anchor, slot, row id, whether that is null, score"""
        if not self.parts:
            return [np.zeros(0, np.int64)] * 5
        anchor, slot, row, none, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((row, none, -score, slot, anchor))
        anchor, slot, row, none, score = (x[order] for x in (anchor, slot, row, none, score))
        first = np.append(True, (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1]))
        at = np.flatnonzero(first)
        rank = np.arange(len(anchor)) - np.repeat(at, np.diff(np.append(at, len(anchor))))
        out = [x[rank < self.k] for x in (anchor, slot, row, none, score)]
        self.parts, self.n = [tuple(out)], len(out[0])
        return out


def _scan(source: DataFrame, blocks: list[Block], k: int, scale: float, relabel, windows: bool) -> DataFrame:
    """Each task's best rows: of the anchor's label (slot 0), or of other labels in each of its windows."""
    sent = source.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(k)
        floors = [np.full(len(b.ids), -np.inf) for b in sent.value]  # of what is kept of one batch: k rows reach it
        for batch in batches:
            for ids, none, labels, vectors in _candidates(batch, scale, relabel):
                for lo in range(0, len(ids), ROWS):
                    part = slice(lo, lo + ROWS)
                    for block, floor in zip(sent.value, floors):
                        if block.vectors.shape[1] == vectors.shape[1]:
                            _meet(kept, block, floor, ids[part], none[part], labels[part], vectors[part], k, windows)
        anchor, slot, row, none, score = kept.close()
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(slot, pa.int32()), pa.array(row, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], ["anchor_id", "slot", "row_id", "score"])

    return source.mapInArrow(run, KIND)


def _meet(kept: _Kept, block: Block, floor: np.ndarray, ids, none, labels, vectors, k: int, windows: bool) -> None:
    other = (block.ids[:, None] != ids) | none
    same = block.labels[:, None] == labels
    allowed = other & (~same if windows else same)
    most = np.full(len(block.ids), np.inf)
    if windows:
        scores = block.scores(vectors, allowed, block.low.min(1, initial=FAR) / 100 - 1, block.high.max(1, initial=-FAR) / 100 + 1)
    else:
        scores = block.scores(vectors, allowed, floor, most)
    scores = np.where(allowed, scores, NONE)
    if not windows:
        row, column = _best(scores, k)
        kept.add(block.ids[row], np.zeros(len(row), np.int64), ids[column], none[column], scores[row, column])
        full = np.bincount(row, minlength=len(block.ids)) == k
        least = np.full(len(block.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, row, scores[row, column])
        floor[full] = np.maximum(floor[full], least[full])
        return
    for j in range(block.slots.shape[1]):
        used = block.slots[:, j] >= 0
        inside = used[:, None] & (scores != NONE) & (100 * scores >= block.low[:, j, None]) & (100 * scores <= block.high[:, j, None])
        row, column = _best(np.where(inside, scores, NONE), k)
        kept.add(block.ids[row], block.slots[row, j], ids[column], none[column], scores[row, column])


def mine(
    df: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, scale: float = 256.0,
    relabel: tuple[int, int] | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per anchor (ids divisible by ``every``) and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score is ``low_pct`` to ``high_pct`` per cent of the positive's:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Higher scores come first, ties by smaller id. ``relabel=(m, n)``: rows whose id is divisible by m get the label
    (label + 1) mod n first.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    chosen = source.where(F.col("vec_id") % every == 0)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, labels, vectors in _candidates(batch, scale, relabel):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), lists], ["anchor_id", "label", "vector"])

    each = chosen.mapInArrow(whole, "anchor_id long, label long, vector array<long>").groupBy("anchor_id").agg(F.min(F.struct("label", "vector")).alias("x"))
    anchors = materialize(each.select("anchor_id", "x.*", F.size("x.vector").alias("dim")), "anchors")
    groups = max(1, -(-anchors.count() // GROUP))
    tables = []
    for g in range(groups):
        # a group is bounded: GROUP anchors on average, dealt by a hash of their ids
        held = anchors.where(F.pmod(F.xxhash64("anchor_id"), F.lit(groups)) == g).orderBy("dim", "anchor_id").toArrow()
        blocks = list(_blocks(held, None))
        top = _ranked(_scan(source, blocks, positives, scale, relabel, False), positives)
        top = materialize(top.select("anchor_id", F.col("rank").alias("slot"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        blocks = list(_blocks(held, top.toArrow(), low_pct, high_pct))
        found = _ranked(_scan(source, blocks, negatives, scale, relabel, True), negatives)
        rows = found.join(top, ["anchor_id", "slot"])
        tables.append(materialize(rows.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        discard(top)
    discard(anchors)
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.col("row_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors: pa.Table, positives: pa.Table | None, low_pct: int = 0, high_pct: int = 0) -> Iterator[Block]:
    """Blocks of one length of vectors, in the order of ``anchors``; with the windows of their positives, if given."""
    ids, labels, dims = (anchors.column(c).to_numpy() for c in ("anchor_id", "label", "dim"))
    vectors = anchors.column("vector").combine_chunks()
    for dim in np.unique(dims):
        of_dim = np.flatnonzero(dims == dim)
        for lo in range(0, len(of_dim), ANCHORS):
            at = of_dim[lo : lo + ANCHORS]
            matrix = vectors.slice(at[0], len(at)).flatten().to_numpy().reshape(len(at), dim)
            if positives is None:
                yield Block(ids[at], labels[at], matrix)
                continue
            anchor, slot, score = (positives.column(c).to_numpy() for c in ("anchor_id", "slot", "positive_score"))
            width = int(slot.max()) if len(slot) else 0
            low, high, slots = np.full((len(at), width), FAR), np.full((len(at), width), -FAR), np.full((len(at), width), -1)
            place = np.searchsorted(ids[at], anchor)
            mine_ = (place < len(at)) & (ids[at][np.minimum(place, len(at) - 1)] == anchor)
            i, j = place[mine_], slot[mine_] - 1
            low[i, j], high[i, j], slots[i, j] = low_pct * score[mine_], high_pct * score[mine_], slot[mine_]
            yield Block(ids[at], labels[at], matrix, low, high, slots)
