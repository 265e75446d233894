"""Substring dedup by a distributed, sampled suffix order.

A byte is removed when a string of ``length`` bytes covers it that also starts anywhere else. Sorting the
suffixes at every byte would move the text many times over (README has figures), so suffixes are sampled by content: the
anchor of a window of ``length`` bytes is the place of its least hashed ``gram``-byte string (leftmost of
equals). It depends on the window's bytes only, so equal windows have their anchors at the same place, and
successive windows share one: together they are a super-window. All that starts anywhere is then found
from the suffixes that begin at anchors:

1. The anchors' suffixes - their first ``gram`` bytes, then the fingerprint of the whole super-window - are
   range-partitioned by Spark's sampled splitters. Each bucket is sorted by multikey quicksort, eight bytes at a time:
   only what shares a token is looked at one token deeper, and the depth at which neighbours part is their common
   prefix. Neighbours that share all of it repeat whole; neighbours with the same ``gram`` bytes but different super-windows
   may share a part. Runs that touch a bucket's edge are compared across buckets, so a run as large as many buckets is no
   larger task than others.
2. One of each set of equal super-windows with such neighbours is looked at in blocks of ``BLOCK``
   windows: if no other has the bytes that all windows of a block share, none repeats; if another has the
   bytes of all of them, all do.
3. Only what is left is compared window by window.

Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

Cases: null and empty texts have nothing to remove, nor have texts shorter than ``length``. Documents are told apart by a
64-bit key of id and text, so texts that differ under one id, and texts without an id, are each cut on their own; rows equal
in both are copies of each other and lose the same bytes. Other columns, of any name, stay as they are. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm.common import discard, materialize, slices, text_bytes, tidy, unused
from marketloom.llm.jaccard_join import _powers, mix

BLOCK = 32
SLICE = 1 << 19
#: Suffixes in a bucket, about.
BUCKET_ROWS = 150_000
#: Numbers that are broadcast at most, in all rows together.
MOST_BROADCAST = 6_000_000
_PLACE = 23  # bits of a place in a slice; longer texts take more
_CODES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


class Prints:
    """Fingerprints of any piece of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        if len(_POWERS[0]) < len(data) + 1:
            _POWERS[:] = _powers(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _POWERS[0][: len(data)], dtype=np.uint64)))

    def of(self, start, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * _POWERS[1][start] + np.asarray(size).astype(np.uint64))


def sliding_min(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` successive values, from running minima of blocks."""
    n = len(x) - wide + 1
    if n <= 0:
        return x[:0]
    y = np.concatenate((x, np.full((-len(x)) % wide, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, wide)
    before, after = np.minimum.accumulate(y, 1).ravel(), np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[wide - 1 : wide - 1 + n])


def super_windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple:
    """(first window, windows, anchor) of each super-window and the :class:`Prints` of ``data``."""
    prints = Prints(data)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, prints
    bits = np.uint64(max(_PLACE, int(len(data)).bit_length()))
    places = np.arange(len(data) - gram + 1)
    key = prints.of(places, gram) >> bits << bits | places.astype(np.uint64)
    least = sliding_min(key, length - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= ends)
    if not len(at):
        return empty, empty, empty, prints
    anchor = anchor[at]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    return at[first], np.diff(np.append(first, len(at))), anchor[first], prints


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def scan_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each super-window: the anchor's first bytes, contents ``f``, document, first window, windows, anchor's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_bytes(part.column("text"))
                first, windows, anchor, prints = super_windows(data, offsets, length, gram)
                row = np.searchsorted(offsets, first, side="right") - 1
                n = len(anchor)
                heads = np.lib.stride_tricks.sliding_window_view(data, gram)[anchor] if n else np.zeros((0, gram), np.uint8)
                ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * gram)
                columns = [
                    pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(heads))]), _signed(prints.of(first, windows - 1 + length)), part.column("row").take(pa.array(row)),
                    pa.array((first - offsets[row]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((anchor - first).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["head", "f", "row", "i", "c", "d"])

    return docs.mapInArrow(tidy(run), "head binary, f long, row long, i int, c int, d int")


def multikey_order(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of ``tokens``, how many leading tokens each shares with the row before it in that order).

    Multikey quicksort of all open parts at once: a part is split by its rows' next token, and only rows equal in it
    are a part one token deeper.
    """
    m, k = tokens.shape
    order, same = np.arange(m), np.zeros(m, np.int64)
    low, high = np.array([0]), np.array([m])
    for depth in range(k):
        size = high - low
        begin = np.cumsum(size) - size
        place = np.repeat(low - begin, size) + np.arange(int(size.sum()))
        part = np.repeat(np.arange(len(low)), size)
        key = tokens[order[place], depth]
        by = np.lexsort((key, part))
        order[place], key = order[place][by], key[by]
        edge = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))[: len(place)]
        same[place[~edge]] = depth + 1
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(place)))
        low = place[start[size > 1]]
        high = low + size[size > 1]
        if not len(low):
            break
    return order, same


def compare_neighbours(bucketed: DataFrame, gram: int) -> DataFrame:
    """Rows of a bucket that repeat (``dup``), share an anchor string ``g`` with others (``multi``) or begin a run at the bucket's edge."""
    names = ["g", "f", "row", "i", "c", "d", "dup", "multi", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        wide = -(-gram // 8)
        heads = np.zeros((rows.num_rows, 8 * wide), np.uint8)
        heads[:, :gram] = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[c.offset * gram : (c.offset + len(c)) * gram] for c in rows["head"].chunks]).reshape(-1, gram)
        tokens = np.empty((rows.num_rows, wide + 1), np.uint64)
        tokens[:, :wide] = heads.view(">u8")
        tokens[:, wide] = rows["f"].to_numpy().view(np.uint64)
        del heads
        order, same = multikey_order(tokens)
        new_g, new_f = same < wide, same <= wide
        run_g, run_f = np.cumsum(new_g) - 1, np.cumsum(new_f) - 1
        dup = np.bincount(run_f)[run_f] > 1
        multi = np.bincount(run_g[new_f])[run_g] > 1
        # one row of each run stands for it across the edges: where a run has more, they are known to repeat
        edge = ((run_g == 0) | (run_g == run_g[-1])) & new_f
        keep = np.flatnonzero(dup | multi | edge)
        of = order[keep]
        g = np.zeros(len(of), np.uint64)
        for depth in range(wide):
            g = mix(g ^ tokens[of, depth])
        take = pa.array(of)
        columns = [_signed(g), *(rows[c].take(take).combine_chunks() for c in names[1:6]), *(pa.array(x[keep]) for x in (dup, multi, edge))]
        yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=100_000)

    return bucketed.mapInArrow(tidy(run), "g long, f long, row long, i int, c int, d int, dup boolean, multi boolean, edge boolean")


def _with_runs(docs: DataFrame, runs: DataFrame, entries: str, how: str = "inner") -> DataFrame:
    """``docs`` with the ``runs`` (written down, one row for each document); they are broadcast only when their ``entries`` are few."""
    numbers = runs.agg(F.sum(F.size(entries) * 5 + 3)).first()[0] or 0
    runs = F.broadcast(runs) if numbers <= MOST_BROADCAST else runs
    return docs.join(runs, "row", how)


def _pieces(docs: DataFrame, runs: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make(prints, offset, g, i, c, d, dup)`` gives for the runs of each document."""
    names = [x.split()[0] for x in schema.split(", ")]
    fields = ("g", "i", "c", "d", "dup")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_bytes(part.column("text"))
                lists = part.column("runs")
                flat = lists.flatten()
                count = np.diff(np.asarray(lists.offsets))
                row = np.repeat(np.arange(len(count)), count)
                values = [flat.field(k).to_numpy(zero_copy_only=False) for k in fields]
                which, columns = make(Prints(data), offsets[row], *values)
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(row[which])), *columns], names)

    by_doc = materialize(runs.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("runs")), "runs")
    return _with_runs(docs, by_doc, "runs").select("row", "text", "runs").mapInArrow(tidy(run), schema)


def _blocks(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """Blocks of windows: ``j`` numbers a super-window's blocks from its anchor, ``core`` and ``hull`` are fingerprints."""

    def make(prints: Prints, base, g, i, c, d, dup):
        low, high = (d - c + 1) // BLOCK, d // BLOCK  # distances to the anchor fall from d to d - c + 1
        n = high - low + 1
        which = np.repeat(np.arange(len(g)), n)
        j = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        anchor = base[which] + i[which] + d[which]
        far = np.minimum(j * BLOCK + BLOCK - 1, d[which])
        near = np.maximum(j * BLOCK, (d - c + 1)[which])
        core = prints.of(anchor - j * BLOCK, length - BLOCK + 1)
        full = far - near == BLOCK - 1
        hull = np.zeros(len(which), np.uint64)
        hull[full] = prints.of((anchor - far)[full], length + BLOCK - 1)
        columns = [
            pa.array(g[which]), pa.array(j.astype(np.int32)), _signed(core), pa.array(hull.view(np.int64), mask=~full), pa.array((anchor - far - base[which]).astype(np.int32)),
            pa.array((far - near + 1).astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(dup[which]),
        ]
        return which, columns

    return _pieces(docs, classes, "row long, g long, j int, core long, hull long, i int, c int, d int, dup boolean", make)


def _windows(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Single windows: anchor string, fingerprint and place."""

    def make(prints: Prints, base, g, i, c, d, dup):
        which = np.repeat(np.arange(len(g)), c)
        at = i[which].astype(np.int64) + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        return which, [pa.array(g[which]), _signed(prints.of(base[which] + at, np.int64(length))), pa.array(at.astype(np.int32)), pa.array(dup[which])]

    return _pieces(docs, runs, "row long, g long, w long, i int, dup boolean", make)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of a document's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def repeated_spans(docs: DataFrame, length: int = 400, gram: int | None = None) -> DataFrame:
    """``row`` (:func:`row_key`) and ``spans``, the merged byte ranges to remove, of every document that has any."""
    gram = gram or max(8, length * 4 // 25)
    spark = docs.sparkSession
    long = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)
    anchors = materialize(scan_anchors(long, length, gram), "anchors")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-anchors.count() // BUCKET_ROWS))
    bucketed = anchors.repartitionByRange(buckets, "head", "f", "row", "i")
    flagged = materialize(compare_neighbours(bucketed, gram), "neighbours")
    discard(anchors)

    # across the edges of buckets
    edge = flagged.where("edge")
    runs_f = edge.groupBy("g", "f").agg((F.count("*") > 1).alias("dup_f"))
    runs_g = edge.groupBy("g").agg((F.min("f") != F.max("f")).alias("multi_g"))
    edge = edge.join(runs_f, ["g", "f"]).join(runs_g, "g").withColumns({"dup": F.col("dup") | F.col("dup_f"), "multi": F.col("multi") | F.col("multi_g")})
    rows = flagged.where("not edge").select("g", "f", "row", "i", "c", "d", "dup", "multi").unionByName(edge.select("g", "f", "row", "i", "c", "d", "dup", "multi"))

    def span(df: DataFrame) -> DataFrame:
        return df.select("row", F.struct(F.col("i").alias("a"), (F.col("i") + F.col("c") - 1 + length).alias("b")).alias("s"))

    spans = [span(rows.where("dup"))]
    classes = rows.where("multi").groupBy("g", "f").agg(F.min(F.struct("row", "i", "c", "d")).alias("r"), F.max("dup").alias("dup"))
    blocks = materialize(_blocks(long, classes.select("r.*", "g", "dup"), length), "blocks")
    by_hull = blocks.groupBy("g", "j", "core", "hull").agg(F.count("*").alias("n"), F.min("dup").alias("all_dup"))
    again = F.col("hull").isNotNull() & (F.col("n") > 1)
    by_core = by_hull.groupBy("g", "j", "core").agg(
        F.sum("n").alias("n_core"), F.count("*").alias("hulls"), F.count_if(F.col("hull").isNull()).alias("cut"), F.count_if(~again & ~F.col("all_dup")).alias("open"),
    )
    shared = by_core.where("n_core > 1 and (hulls > 1 or cut > 0)").where("open > 0 or cut > 0").select("g", "j", "core")
    whole = by_hull.where(again).select("g", "j", "core", "hull")
    spans.append(span(blocks.where("not dup").join(whole, ["g", "j", "core", "hull"])))
    # window by window: one block of each hull, and all blocks that are cut short
    key = F.when(F.col("hull").isNotNull(), F.struct(F.lit(-1).cast("long").alias("x"), F.lit(-1).alias("y"), F.col("hull").alias("z"))).otherwise(F.struct(F.col("row").alias("x"), F.col("i").alias("y"), F.lit(0).cast("long").alias("z")))
    few = blocks.join(shared, ["g", "j", "core"]).withColumn("key", key).groupBy("g", "j", "core", "key").agg(F.min(F.struct("row", "i", "c", "d")).alias("r"), (F.max("dup") | (F.count("*") > 1)).alias("dup"))
    windows = materialize(_windows(long, few.select("r.*", "g", "dup"), length), "windows")
    same = windows.groupBy("g", "w").agg(F.count("*").alias("n")).where("n > 1").select("g", "w")
    found = windows.where("not dup").join(same, ["g", "w"]).select("row", "i", F.lit(1).alias("c"))
    spans.append(span(found))

    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    in_order = Window.partitionBy("row").orderBy("s")
    reach = F.max("s.b").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = every.distinct().withColumn("new", F.coalesce(F.col("s.a") > reach, F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "run").agg(F.min("s.a").alias("a"), F.max("s.b").alias("b"))
    out = materialize(runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")
    for used in (flagged, blocks, windows):
        discard(used)
    return out


def _cut(text: str | None, spans: list | None) -> bytes:
    data = (text or "").encode()
    parts, at = [], 0
    for s in spans or []:
        parts.append(data[at : s["a"]])
        at = s["b"]
    return b"".join([*parts, data[at:]])


def removal_digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every document, and its ``row``."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cuts in zip(batch.column("text"), batch.column("spans").to_pylist()):
                text = text.as_py()
                kept, size = _cut(text, cuts), len((text or "").encode())
                rows.append((size, size - len(kept), len(cuts or []), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], batch.column("row")], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    return _with_runs(rows, spans, "spans", "left").select("doc_id", "text", "spans", "row").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, row long")


def repeats_of(docs: DataFrame, length: int, passage: int) -> DataFrame:
    """:func:`removal_digest` for ``length``, and ``repeated``: whether the document holds a string of ``passage`` bytes that stands elsewhere too.

    ``passage`` is at most ``length``: a string of ``length`` bytes that repeats lies in spans of that size of the shorter
    strings in all its documents, so only these are searched again.
    """
    short = repeated_spans(docs, passage)
    held = short.where(F.exists("spans", lambda x: x["b"] - x["a"] >= length)).select("row")
    few = held.withColumn("held", F.array("row"))
    keyed = _with_runs(docs.select("doc_id", "text", row_key().alias("row")), few, "held", "left_semi")
    digest = removal_digest(docs, repeated_spans(keyed.select("doc_id", "text"), length))
    return _with_runs(digest, short, "spans", "left").select(*digest.columns[:5], F.col("spans").isNotNull().alias("repeated"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans taken out of ``text``; bytes of a character that is cut through go with it."""
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields])
    names, row, cuts_in = docs.columns, unused(docs, "row"), unused(docs, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not cuts else _cut(t.as_py(), cuts).decode("utf-8", "ignore") for t, cuts in zip(batch.column("text"), batch.column(cuts_in).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    numbers = spans.agg(F.sum(F.size("spans") * 5 + 3)).first()[0] or 0
    spans = spans.select(F.col("row").alias(row), F.col("spans").alias(cuts_in))
    marked = docs.withColumn(row, row_key()).join(F.broadcast(spans) if numbers <= MOST_BROADCAST else spans, row, "left")
    return marked.select(*names, cuts_in).mapInArrow(tidy(run), schema)
