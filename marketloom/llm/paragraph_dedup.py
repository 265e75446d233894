"""Substring dedup of paragraphs by MinHash banding.

Two kinds of paragraphs are compared.

Lines of at least ``min_words`` words are sets of word shingles (A-Z as a-z). Bands of MinHash values are tuned
for recall: of all ways to split up to ``MOST_HASHES`` values, the one with the fewest bands whose chance to miss a
pair at the threshold is at most ``miss``. Lines of the same words are one class, of which only the first is banded, so
a line that stands in many documents costs no more than one. Classes that share a band are verified by exact
Jaccard similarity (:mod:`links`), linked classes form components, and each component keeps its first
line, by document and line; the others are removed.

Passages are for what stands inside longer lines or runs across them: a text's words are cut where a hash of three
successive words is the least among ``REACH`` places to each side. Cuts depend on the words around them only, so a text
that is repeated is cut alike inside, wherever its lines end: a passage of more than 50 words holds three or four of these pieces.
They have six words or more, about eleven; at that length a Jaccard similarity of 0.8 leaves room for changes in the outermost
word or two only, and the place of the cuts rules most of these out, so one band that holds the whole set - equality of all
words, by 96 bits - stands for all bands and is its own verification. Equal pieces are a component that keeps its first
piece; of the others successive ones are removed as one span. Successive repeated pieces of under ``PASSAGE_BYTES`` bytes are
a phrase that texts share by chance, and stay.

Cases: null and empty texts have no paragraphs. The minimum is the shingle size (and is raised to it): a line
with fewer words has no shingle and is never removed. A paragraph repeated inside one document is removed there too.
A text of the same word again and again has no cuts and no passages. Rows of the same id and text count as one document;
documents without an id, and different texts under one id, are compared each on its own, after those that an id names (ids are
below 2**62). A piece is not kept in a line that is removed, if it stands anywhere else. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import FEW, discard, materialize, slices, small_enough, text_bytes, tidy
from marketloom.llm.jaccard_join import HASH_BYTES, mix, send_signatures, shared_signatures, word_hashes, word_places
from marketloom.llm.links import components_of, odd_sketch
from marketloom.llm.suffix_dedup import sliding_min

MOST_HASHES = 128
#: Places to each side among which a cut is the least.
REACH = 5
#: Bytes of successive repeated pieces from which on they are a passage; what is shorter, about 14 words, is a phrase and stays.
PASSAGE_BYTES = 80


def tune_bands(threshold_pct: int, miss: float = 1e-3) -> tuple[int, int]:
    """(bands, rows of each): the fewest bands, of at least three rows, that miss a pair at the threshold with chance ``miss`` at most."""
    best = None
    for rows in range(3, 17):
        for bands in range(1, MOST_HASHES // rows + 1):
            if (1 - (threshold_pct / 100) ** rows) ** bands <= miss:
                if best is None or bands < best[0]:
                    best = (bands, rows)
                break
    if best is None:
        raise ValueError("no bands reach the recall at this threshold")
    return best


def _paragraphs(data: np.ndarray, offsets: np.ndarray, words: int, least: int) -> tuple:
    """(text, line number, first byte, end, word hashes, first word, words) of the paragraphs that are compared."""
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], feeds + 1)))
    row = np.searchsorted(offsets, starts, side="right") - 1
    starts, row = starts[starts < len(data)], row[starts < len(data)]
    # a line feed at the end of a text begins no line of the next one
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[row + 1])
    ends = ends - ((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10))
    line = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    hashes, word_ends = word_hashes(data, np.append(starts, len(data)))
    count = np.diff(word_ends)
    keep = count >= max(least, words)
    return row[keep], line[keep], starts[keep], ends[keep], hashes, word_ends[:-1][keep], count[keep]


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes) - words + 1
    return mix(sum(hashes[i : n + i] * factors[i] for i in range(words))) if n > 0 else np.zeros(0, np.uint64)


def _segments(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the segments, start of each segment among them)."""
    begin = np.cumsum(size) - size
    return np.repeat(first - begin, size) + np.arange(int(size.sum())), begin


def scan_paragraphs(docs: DataFrame, words: int, least: int) -> DataFrame:
    """``doc_id``, ``line``, ``node`` (a fingerprint of its words), ``n_chars`` and bytes ``a`` to ``b`` of each line that is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                data, offsets = text_bytes(part.column("text"))
                row, line, start, end, hashes, first, count = _paragraphs(data, offsets, words, least)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(line.astype(np.int32)), pa.array(_prints(hashes, first, count)), pa.array((chars[end] - chars[start]).astype(np.int64))]
                columns += [pa.array((x - offsets[row]).astype(np.int64)) for x in (start, end)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "node", "n_chars", "a", "b"])

    return docs.mapInArrow(tidy(run), "doc_id long, line int, node long, n_chars long, a long, b long")


def scan_bands(docs: DataFrame, words: int, threshold_pct: int, least: int, miss: float) -> DataFrame:
    """The band signatures of each line that is compared, as rows for :func:`shared_signatures`."""
    bands, rows = tune_bands(threshold_pct, miss)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                data, offsets = text_bytes(part.column("text"))
                _, _, _, _, hashes, first, count = _paragraphs(data, offsets, words, least)
                # equal lines of a slice are one
                nodes, at = np.unique(_prints(hashes, first, count), return_index=True)
                if not len(nodes):
                    continue
                places, begin = _segments(first[at], count[at] - words + 1)
                shingles = _shingles(hashes, words)[places]
                for b in range(bands):
                    signature = np.full(len(nodes), b + 1, np.uint64)
                    for r in range(rows):
                        x = shingles * seeds[b * rows + r]
                        signature = mix(signature + np.minimum.reduceat(x ^ (x >> np.uint64(31)), begin))
                    yield signature, nodes

    return docs.select("text").mapInArrow(lambda batches: send_signatures(made(batches)), "signature long, mark int, node long")


def _prints(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the words of each segment."""
    if not len(first):
        return np.zeros(0, np.int64)
    places, begin = _segments(first, count)
    order = mix((np.arange(len(places)) - np.repeat(begin, count)).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(mix(hashes[places]) * order, begin) + count.astype(np.uint64)).view(np.int64)


def scan_sets(docs: DataFrame, wanted: DataFrame, words: int, least: int) -> DataFrame:
    """``node``, ``n``, ``sketch`` and ``elements`` of the wanted lines (``doc_id``, ``line``, ``node``)."""
    lines = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "node")).alias("lines"))
    lines = F.broadcast(lines) if small_enough(wanted, FEW) else lines  # as many numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                data, offsets = text_bytes(part.column("text"))
                row, line, _, _, hashes, first, count = _paragraphs(data, offsets, words, least)
                asked = [{x["line"]: x["node"] for x in lines} for lines in part.column("lines").to_pylist()]
                nodes = _prints(hashes, first, count)
                keep = np.array([asked[r].get(n) == node for r, n, node in zip(row.tolist(), line.tolist(), nodes.tolist())], bool)
                shingles = _shingles(hashes, words)
                sets = [np.unique(shingles[a : a + n - words + 1]) for a, n in zip(first[keep], count[keep])]
                columns = [pa.array(nodes[keep]), pa.array([len(x) for x in sets], pa.int64()), pa.array([odd_sketch(x) for x in sets], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sketch", "elements"])

    return docs.join(lines, "doc_id").select("text", "lines").mapInArrow(run, "node long, n long, sketch binary, elements binary")


def paragraph_groups(docs: DataFrame, words: int = 5, threshold_pct: int = 80, min_words: int = 5, miss: float = 1e-3) -> DataFrame:
    """``doc_id``, ``line``, ``n_chars``, bytes ``a`` to ``b``, ``first_doc`` and ``first_line`` of every line that has a duplicate."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    each = materialize(scan_paragraphs(docs, words, min_words), "paragraphs")
    shared = materialize(shared_signatures(scan_bands(docs, words, threshold_pct, min_words, miss)), "shared-signatures")
    place = F.struct("doc_id", "line")
    first = each.groupBy("node").agg(F.min(place).alias("at"))
    repeated = not each.groupBy("doc_id", "line").count().where("count > 1").isEmpty()

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(nodes.join(first, "node").select("at.doc_id", "at.line", "node"), "candidates")
        sets = scan_sets(docs, wanted, words, min_words)
        return sets.dropDuplicates(["node"]) if repeated else sets

    parts = components_of(shared, sets_of, threshold_pct)
    label = each.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if repeated:  # rows with the same id are one document: of one line the longest text, the first component
        label = label.groupBy("doc_id", "line").agg(*[F.max(c).alias(c) for c in ("n_chars", "a", "b")], F.min("component").alias("component"))
    # partial aggregates of a line that stands everywhere are one row for each task; the join back is with few numbers or split by the engine
    kept = materialize(label.groupBy("component").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select("component", "kept"), "components")
    out = label.join(F.broadcast(kept) if small_enough(kept, FEW) else kept, "component")
    out = materialize(out.select("doc_id", "line", "n_chars", "a", "b", F.col("kept.doc_id").alias("first_doc"), F.col("kept.line").alias("first_line")), "groups")
    for used in (each, shared, kept):
        discard(used)
    return out


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """(text, first byte, end, two fingerprints) of the pieces between successive cuts of each text."""
    hashes, word_ends, starts, _ = word_places(data, offsets)
    n = len(hashes) - 2
    none = np.zeros(0, np.int64)
    if n < 2 * REACH + 2:
        return none, none, none, none, none
    factors = mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)
    three = mix(hashes[:n] * factors[0] + hashes[1 : n + 1] * factors[1] + hashes[2:] * factors[2])
    wide = np.full(n + 2 * REACH, np.iinfo(np.uint64).max, np.uint64)
    wide[REACH : REACH + n] = three
    before = sliding_min(wide, REACH)[:n]  # of the REACH places before each
    after = sliding_min(wide, REACH)[REACH + 1 : REACH + 1 + n]
    text = np.searchsorted(word_ends, np.arange(n), side="right") - 1
    at = np.arange(n)
    # all words that a cut depends on are of its own text
    inside = (at - REACH >= word_ends[text]) & (at + REACH + 3 <= word_ends[text + 1])
    cut = np.flatnonzero((three < before) & (three <= after) & inside)
    of = text[cut]
    first = np.flatnonzero(of[1:] == of[:-1])
    if not len(first):
        return none, none, none, none, none
    low, high = cut[first], cut[first + 1]
    places, begin = _segments(low, high - low)
    order = mix((np.arange(len(places)) - np.repeat(begin, high - low)).astype(np.uint64)) | np.uint64(1)
    seen, length = hashes[places], (high - low).astype(np.uint64)
    f1, f2 = (mix(np.add.reduceat(mix(seen ^ s) * order, begin) + length).view(np.int64) for s in factors[:2])
    return of[first], starts[low], starts[high], f1, f2.astype(np.int32)


#: Pieces that a task holds before it sends them on, and how many of them may be equal before all but the first go their own way.
HELD, COMMON = 1 << 18, 16
#: What is known of a piece when it is sent: nothing, that it repeats, that it repeats and is not the first.
OPEN, REPEATS, LATER = 0, 1, 2
PIECE = ["f1", "f2", "doc_id", "a", "b", "known"]


def _send_pieces(held: list[tuple]) -> pa.RecordBatch:
    f1, f2, doc, a, b = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((a, doc, f2, f1))
    f1, f2, doc, a, b = (x[order] for x in (f1, f2, doc, a, b))
    first = np.flatnonzero(np.append(True, (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])))
    size = np.diff(np.append(first, len(f1)))
    known = np.where(np.repeat(size > COMMON, size), np.int32(LATER), np.int32(OPEN))
    # the first of many equal ones, and rows of the same place, go to where all others are
    known[(known == LATER) & (doc == np.repeat(doc[first], size)) & (a == np.repeat(a[first], size))] = REPEATS
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (f1, f2, doc, a.astype(np.int64), b.astype(np.int64), known)], PIECE)


def scan_pieces(docs: DataFrame) -> DataFrame:
    """``f1``, ``f2``, ``doc_id``, bytes ``a`` to ``b`` of every piece, and what is ``known`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                data, offsets = text_bytes(part.column("text"))
                row, a, b, f1, f2 = cut_pieces(data, offsets)
                ids, base = part.column("doc_id").to_numpy(zero_copy_only=False), offsets[row]
                held.append((f1, f2, ids[row], a - base, b - base))
                size += len(f1)
                if size >= HELD:
                    yield _send_pieces(held)
                    held, size = [], 0
        if size:
            yield _send_pieces(held)

    return docs.mapInArrow(run, "f1 long, f2 int, doc_id long, a long, b long, known int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``a``, ``b``, ``first`` and prints of every piece that stands elsewhere too; ``first`` marks the one that is kept.

    One shuffle and a sort; of a piece that stands very often, a task sends all but its first to partitions at random.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the group that the batch before ended in: its prints, its first piece, and whether that has been told
        group, hub, told = None, (0, 0, 0), True
        for batch in batches:
            if not batch.num_rows:
                continue
            f1, f2, doc, a, b, known = (batch.column(c).to_numpy() for c in PIECE)
            new = np.append(group != (f1[0], f2[0]), (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1]))
            first = np.flatnonzero(np.append(True, new[1:]))
            size = np.diff(np.append(first, len(f1)))
            hubs = np.stack([doc[first], a[first], b[first]], 1)
            goes_on = not new[0]
            if goes_on:
                hubs[0] = hub
            least = np.repeat(hubs, size, 0)
            # later ones stand last in a group; where they are alone, none of them is the first
            other = (doc != least[:, 0]) | (a != least[:, 1]) | (known == LATER)
            begins = known[first] != LATER
            if goes_on:
                begins[0] = False
            repeats = (np.add.reduceat(other.astype(np.int64), first) > 0) | (np.maximum.reduceat(known, first) > OPEN)
            tell = repeats & begins
            late = goes_on and not told and bool(repeats[0])
            rows = [np.concatenate((x[other], hubs[tell, i], np.full(int(late), hub[i], np.int64))) for i, x in enumerate((doc, a, b))]
            prints = [np.concatenate((x[other], x[first][tell], x[:late])) for x in (f1, f2)]
            firsts = np.concatenate((np.zeros(int(other.sum()), bool), np.ones(int(tell.sum()) + late, bool)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in rows), pa.array(firsts), *map(pa.array, prints)], ["doc_id", "a", "b", "first", "f1", "f2"])
            if len(first) > 1 or not goes_on:
                told = bool(repeats[-1]) or known[first[-1]] == LATER
            else:
                told = told or late
            group, hub = (f1[-1], f2[-1]), tuple(hubs[-1].tolist())

    where = F.when(F.col("known") == LATER, F.xxhash64("doc_id", "a")).otherwise(F.col("f1"))
    ordered = scan_pieces(docs).repartition(where).sortWithinPartitions("f1", "f2", F.col("known") == LATER, "doc_id", "a")
    found = materialize(ordered.mapInArrow(tidy(run), "doc_id long, a long, b long, first boolean, f1 long, f2 int"), "repeated-passages")
    # rows with the same id and text are one document
    return found.groupBy("doc_id", "a", "b", "f1", "f2").agg(F.max("first").alias("first"))


#: Bytes of the stretches by which pieces and lines of a document are brought together.
STRETCH = 4_096


def _touching(pieces: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id``, ``a``, ``b`` of the pieces that share a byte with a line (``doc_id``, ``a``, ``b``) of their document."""
    stretches = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / STRETCH), F.floor((F.col(b) - 1) / STRETCH)))
    of_lines = lines.select("doc_id", F.col("a").alias("la"), F.col("b").alias("lb")).where("lb > la").withColumn("stretch", stretches("la", "lb"))
    of_pieces = pieces.select("doc_id", "a", "b").withColumn("stretch", stretches("a", "b"))
    return of_pieces.join(of_lines, ["doc_id", "stretch"]).where("a < lb and b > la").select("doc_id", "a", "b").distinct()


def keep_passages_outside(passages: DataFrame, lines: DataFrame) -> DataFrame:
    """``passages`` whose ``first`` is none in a removed line, if there is another: what a line takes along must stay elsewhere."""
    passages = materialize(passages, "passages")
    lost = passages.where("first").join(_touching(passages.where("first"), lines), ["doc_id", "a", "b"], "left_semi").select("f1", "f2").distinct()
    lost = materialize(lost, "lost-passages")
    if lost.isEmpty():
        return passages
    members = passages.join(F.broadcast(lost) if small_enough(lost, FEW) else lost, ["f1", "f2"], "left_semi")
    inside = _touching(members, lines).withColumn("inside", F.lit(True))
    flagged = members.join(inside, ["doc_id", "a", "b"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    place = F.struct("doc_id", "a", "b")
    chosen = materialize(flagged.groupBy("f1", "f2").agg(F.min(F.struct("inside", *[F.col(c) for c in ("doc_id", "a", "b")])).alias("x")).select("f1", "f2", F.struct("x.doc_id", "x.a", "x.b").alias("chosen")), "chosen-passages")
    joined = passages.join(F.broadcast(chosen) if small_enough(chosen, FEW) else chosen, ["f1", "f2"], "left")
    return joined.withColumn("first", F.when(F.col("chosen").isNull(), F.col("first")).otherwise(F.col("chosen") == place)).drop("chosen")


def passage_runs(passages: DataFrame) -> DataFrame:
    """``doc_id``, ``n_passages``, ``n_passage_bytes`` (both with those kept) and ``removed_spans`` of documents with repeated passages."""
    in_order = Window.partitionBy("doc_id").orderBy("a")
    again = F.lag("b").over(in_order) == F.col("a")
    # a run of pieces, and inside it a run of pieces that go, begins where the piece before does not touch or is of the other kind
    kind = F.lag("first").over(in_order) == F.col("first")
    marked = passages.withColumns({"new": (~F.coalesce(again, F.lit(False))).cast("int"), "part": (~F.coalesce(again & kind, F.lit(False))).cast("int")})
    marked = marked.withColumns({"part_no": F.sum("part").over(in_order), "run_no": F.sum("new").over(in_order)})
    marked = marked.withColumn("long", F.sum(F.col("b") - F.col("a")).over(Window.partitionBy("doc_id", "run_no"))).where(F.col("long") >= PASSAGE_BYTES)
    parts = marked.groupBy("doc_id", "part_no", "first").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("new").alias("runs"))
    gone = F.when(~F.col("first"), F.struct("a", "b"))
    return parts.groupBy("doc_id").agg(F.sum("runs").alias("n_passages"), F.sum(F.col("b") - F.col("a")).alias("n_passage_bytes"), F.sort_array(F.collect_list(gone)).alias("removed_spans"))


def gone_lines(groups: DataFrame) -> DataFrame:
    """The lines of ``groups`` that are not the first of theirs."""
    return groups.where((F.col("doc_id") != F.col("first_doc")) | (F.col("line") != F.col("first_line")))


def removals(groups: DataFrame) -> DataFrame:
    """One row for each document that loses lines: the lines, their characters and where the text is kept."""
    return gone_lines(groups).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"), F.sum("n_chars").alias("n_removed_chars"), F.sort_array(F.collect_set("first_doc")).alias("kept_in"))


#: Keys of documents whose id does not name them begin here; ids are smaller.
UNNAMED = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, which names a document: its id, or a fingerprint where the id is null or several texts have it.

    Rows of the same id and text have the same key. Keys of fingerprints come after all ids (which are below 2**62).
    """
    text = F.col("text").cast("string")
    at = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_print": F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), text, text.isNull())})
    shared = at.where("_id is not null").groupBy("_id").agg(F.min("_print").alias("x"), F.max("_print").alias("y")).where("x <> y").select("_id", F.lit(True).alias("_shared"))
    shared = materialize(shared, "shared-ids")
    other = F.col("_print").bitwiseAND(UNNAMED - 1) + UNNAMED
    if shared.isEmpty():
        return at.withColumn("key", F.when(F.col("_id").isNull(), other).otherwise(F.col("_id"))).select(*docs.columns, "key")
    at = at.join(F.broadcast(shared) if small_enough(shared, FEW) else shared, "_id", "left")
    return at.withColumn("key", F.when(F.col("_id").isNull() | F.col("_shared"), other).otherwise(F.col("_id"))).select(*docs.columns, "key")


def paragraph_dedup(docs: DataFrame, **parameters) -> DataFrame:
    """A row for each document.

    Lines: ``n_paragraphs``, ``n_removed``, ``n_removed_chars``, ``removed_lines`` and ``kept_in``. Passages: ``n_passages`` that stand
    elsewhere too and their ``n_passage_bytes``, those kept here included, and the ``removed_spans`` of bytes. ``repeated`` says whether the
    document holds any such passage.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumnRenamed("id", "doc_id"))
    named, rows = rows, rows.select(F.col("key").alias("doc_id"), "text")
    groups = paragraph_groups(rows, **parameters)
    runs = passage_runs(keep_passages_outside(repeated_passages(rows), gone_lines(groups)))
    gone = removals(groups)
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    every = named.select(F.col("doc_id").alias("id"), F.col("key").alias("doc_id"), lines.alias("n_paragraphs"))
    unnamed = named.where(F.col("key") >= UNNAMED).select(F.col("key").alias("kept"), F.col("doc_id").alias("id")).distinct()
    if not unnamed.isEmpty():  # what is kept in documents of such a key is told by their ids, if they have one
        at = gone.select("doc_id", F.explode("kept_in").alias("kept")).join(unnamed, "kept", "left")
        ids = at.select("doc_id", F.when(F.col("kept") < UNNAMED, F.col("kept")).otherwise(F.col("id")).alias("kept")).groupBy("doc_id").agg(F.sort_array(F.collect_set("kept")).alias("kept_in"))
        gone = gone.drop("kept_in").join(ids, "doc_id")
    out = every.join(gone, "doc_id", "left").join(runs, "doc_id", "left").drop("doc_id").withColumnRenamed("id", "doc_id")
    return out.select(
        "doc_id", "n_paragraphs", F.coalesce(F.size("removed_lines"), F.lit(0)).alias("n_removed"), F.coalesce("n_removed_chars", F.lit(0)).cast("long").alias("n_removed_chars"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), F.coalesce("kept_in", F.array().cast("array<long>")).alias("kept_in"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_passage_bytes", F.lit(0)).cast("long").alias("n_passage_bytes"),
        F.coalesce("removed_spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("removed_spans"), (F.coalesce("n_passages", F.lit(0)) > 0).alias("repeated"),
    )


def remove_paragraphs(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the lines in ``gone`` (:func:`removals`, by ``doc_id``), with all their other columns."""
    marked = docs.join(gone.select("doc_id", "removed_lines"), "doc_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains(F.col("removed_lines"), i)), "\n")
    return marked.withColumn("text", F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
