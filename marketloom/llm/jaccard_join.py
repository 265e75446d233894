"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word shingles. Set sizes are cut into bands whose ends differ by the factor
``1 / threshold``; similar sets lie in the same or in neighbouring bands. For a pair of bands that end at sizes
r and s, similar sets differ in at most ``k = (r + s) (1 - t) / (1 + t)`` elements. The element domain is cut
(by hash) into ``n1`` parts, so few that k < n1 (DIFFER + 1), and each part into ``PIECES`` pieces: at least
one part has at most ``DIFFER`` pieces in which similar sets differ. So of every part all subsets of
``PIECES - DIFFER`` pieces are enumerated, and each subset gives one signature, a commutative hash of the
set's elements there, for the band pair that ends with the set's own band and for the one that ends with the
next. No similar pair can fail to share a signature, and a signature speaks for more elements than a single
piece would, so dissimilar sets rarely share one.

Signatures are rows that are shuffled once, by their value, and sorted (spilling where a partition asks for it);
a stream over the sorted rows names the smallest member (hub) of each group. A signature that very many sets of
one task share goes on with the smallest of them only; the others keep a group of that task's own, so no
partition gathers a common signature.

Groups of equal signatures become components of verified links (:mod:`links`).

Cases: text without words, and null, is an empty set, linked with nothing. A text with fewer words than
a shingle is one shingle of all its words. Repeated rows and equal texts are one class and each get
their row; texts that differ under one id are told apart. Documents without an id are linked like others, and do not
name a component: of such documents alone it is null. Empty tables give empty results. Other columns are not
looked at. Sets are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import FEW, discard, materialize, slices, small_enough, text_bytes, tidy, unused
from marketloom.llm.links import components_of, mix, odd_sketch

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]  # A-Z as a-z
#: Text handled at once; hashing holds several 64-bit numbers for each byte.
HASH_BYTES = 1 << 19
#: PartEnum's second level: pieces of each part, and in how many of them similar sets may differ.
PIECES, DIFFER = 3, 1
#: The enumerated subsets of a part's pieces.
SUBSETS = list(combinations(range(PIECES), PIECES - DIFFER))
#: Signatures that a task holds before it sends them on.
HELD = 1 << 18
#: Sets held at once that may share a signature before only their smallest goes on to all others'.
COMMON = 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POWERS: list = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, n + 1 offsets of the texts' words, first byte and end of each); words are runs without ASCII white space, A-Z as a-z."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    if len(_POWERS[0]) < len(data):
        _POWERS[:] = _powers(len(data))
    word = ~_SPACES[data]
    begin, end = word.copy(), np.zeros(len(data), bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[-1] = word[-1]
    end[:-1] = word[:-1] & (~word[1:] | edge[1:-1])
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[data] * _POWERS[0][: len(data)], dtype=np.uint64)))
    hashes = (sums[stops] - sums[starts]) * _POWERS[1][starts]
    return mix(hashes + (stops - starts).astype(np.uint64)), np.searchsorted(starts, offsets), starts, stops


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two of :func:`word_places`."""
    return word_places(data, offsets)[:2]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, ends = word_hashes(data, offsets)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes) - words + 1
    shingles = mix(sum(hashes[i : n + i] * factors[i] for i in range(words))) if n > 0 else np.zeros(0, np.uint64)
    for a, b in zip(ends, ends[1:]):
        if b - a >= words:
            yield np.unique(shingles[a : b - words + 1])
        elif b > a:
            short = hashes[a:b]
            yield mix(np.array([(short * factors[: len(short)]).sum(dtype=np.uint64) + np.uint64(len(short))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def bands(threshold_pct: int, most: int) -> list[tuple[int, int]]:
    """Size bands (least, most) up to a band that holds ``most``."""
    out, low = [], 1
    while not out or out[-1][1] < most:
        high = max(low, low * 100 // threshold_pct)
        out.append((low, high))
        low = high + 1
    return out


_BANDS: dict[int, list[tuple[int, int]]] = {}


def signatures(sets: list[np.ndarray], threshold_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(PartEnum signatures of all sets, which set each is of); sets are sorted mixed hashes, none of them empty."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = _BANDS.setdefault(threshold_pct, bands(threshold_pct, 1000))
    if known[-2][1] < sizes.max():
        known = _BANDS[threshold_pct] = bands(threshold_pct, 4 * int(sizes.max()))
    ends = np.array([b for _, b in known], np.int64)
    own = np.searchsorted(ends, sizes)
    elements = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)))
    out, owner = [], []
    for band in (own, own + 1):
        # of two similar sets the smaller lies in the band before, or both do
        differ = (ends[band] + ends[np.maximum(band - 1, 0)]) * (100 - threshold_pct) // (100 + threshold_pct)
        parts = np.where((band > 0) & (differ > 0), differ // (DIFFER + 1) + 1, 0)  # sets that may not differ at all are equal: one class
        pieces = parts * PIECES
        begin = np.cumsum(pieces) - pieces
        # sorted elements fall into a set's pieces in order
        piece = begin[row] + ((elements >> np.uint64(32)) * pieces[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        inside = pieces[row] > 0
        at = np.flatnonzero(inside)
        cuts = np.searchsorted(piece[at], np.arange(int(pieces.sum()) + 1))
        at = np.append(at, len(elements))
        # a set's elements are successive, so the sum over a piece is a difference of running sums
        low = at[cuts[:-1]]
        total = sums[np.minimum(low + np.diff(cuts), len(elements))] - sums[low]
        total = total.reshape(-1, PIECES)
        of = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        for i, subset in enumerate(SUBSETS):
            name = (band[of].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) * np.uint64(len(SUBSETS)) + np.uint64(i)
            out.append(mix(total[:, subset].sum(1, dtype=np.uint64) + mix(name)))
            owner.append(of)
    return np.concatenate(out), np.concatenate(owner)


def fingerprint(elements: np.ndarray) -> np.int64:
    return (mix(elements ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(elements))).astype(np.int64)


def scan_classes(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``row``, the set's size ``n`` and its fingerprint ``node`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                sets = list(shingle_sets(*text_bytes(part.column("text")), words))
                columns = [part.column("doc_id"), part.column("row"), pa.array([len(x) for x in sets], pa.int64()), pa.array([int(fingerprint(x)) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "node"])

    return docs.select("doc_id", "row", "text").mapInArrow(tidy(run), "doc_id long, row long, n long, node long")


def _send(signature: np.ndarray, node: np.ndarray, mark: int) -> pa.RecordBatch:
    """Rows of ``signature``, ``mark`` and ``node``: groups of more than COMMON sets have ``mark``, others and one set of each such group 0."""
    signature = signature.view(np.int64)
    order = np.lexsort((node, signature))
    signature, node = signature[order], node[order]
    new = np.append(True, (signature[1:] != signature[:-1]) | (node[1:] != node[:-1]))
    signature, node = signature[new], node[new]
    first = np.flatnonzero(np.append(True, signature[1:] != signature[:-1]))
    size = np.diff(np.append(first, len(signature)))
    marks = np.where(np.repeat(size > COMMON, size), np.int32(mark), np.int32(0))
    hubs = first[size > COMMON]
    columns = [np.concatenate((signature, signature[hubs])), np.concatenate((marks, np.zeros(len(hubs), np.int32))), np.concatenate((node, node[hubs]))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "mark", "node"])


def send_signatures(made: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """:func:`_send` for (signatures, nodes) whenever ``HELD`` of them have come together."""
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    size = 0

    def deal() -> pa.RecordBatch:
        whole, of = np.concatenate(held), np.concatenate(owners)
        # the same rows give the same mark, so a task that is run again sends the same
        return _send(whole, of, int(mix(whole[:1] ^ np.uint64(len(whole)))[0] & np.uint64(0x7FFFFFFE)) + 1)

    for signature, node in made:
        held.append(signature)
        owners.append(node)
        size += len(signature)
        if size >= HELD:
            yield deal()
            held, owners, size = [], [], 0
    if size:
        yield deal()


def scan_signatures(docs: DataFrame, words: int, threshold_pct: int) -> DataFrame:
    """``signature``, ``mark`` (not 0 for groups of one task) and ``node`` of every set, once for each task it occurs in."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen = set()
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                sets, nodes = [], []
                for elements in shingle_sets(*text_bytes(part.column("text")), words):
                    node = int(fingerprint(elements))
                    if len(elements) and node not in seen:  # equal sets of a task give the same rows
                        if len(seen) < 50_000:
                            seen.add(node)
                        sets.append(elements)
                        nodes.append(node)
                signature, owner = signatures(sets, threshold_pct)
                yield signature, np.array(nodes, np.int64)[owner] if len(nodes) else np.zeros(0, np.int64)

    return docs.select("text").mapInArrow(tidy(lambda batches: send_signatures(made(batches))), "signature long, mark int, node long")


def shared_signatures(sent: DataFrame) -> DataFrame:
    """``signature``, ``a`` and its group's smallest member ``b`` for every member of a group of at least two sets.

    One shuffle and a sort; the stream over sorted rows carries one group's smallest member from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub, told, last = None, np.int64(0), False, np.int64(0)
        for batch in batches:
            signature, mark, node = (batch.column(c).to_numpy() for c in ("signature", "mark", "node"))
            if not len(node):
                continue
            new = np.append(group != (signature[0], mark[0]), (signature[1:] != signature[:-1]) | (mark[1:] != mark[:-1]))
            again = ~new & np.append(node[0] == last, node[1:] == node[:-1])
            first = np.flatnonzero(np.append(True, new[1:]))
            size = np.diff(np.append(first, len(node)))
            hubs = node[first]
            if not new[0]:
                hubs[0] = hub
            least = np.repeat(hubs, size)
            other = (node != least) & ~again
            others = np.add.reduceat(other.astype(np.int64), first) > 0
            say = others.copy()  # groups whose smallest member gets its own row now
            if not new[0] and told:
                say[0] = False
            rows = [np.concatenate((signature[other], signature[first][say])), np.concatenate((node[other], hubs[say])), np.concatenate((least[other], hubs[say]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["signature", "a", "b"])
            told = bool(others[-1]) or (len(first) == 1 and not new[0] and told)
            group, hub, last = (signature[-1], mark[-1]), hubs[-1], node[-1]

    keys = ["signature", "mark"]
    return sent.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(tidy(run), "signature long, a long, b long")


def scan_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node``, ``n``, ``sketch`` and ``elements`` (little-endian 64-bit numbers) of documents in ``wanted`` (``row``, ``node``)."""
    wanted = F.broadcast(wanted) if small_enough(wanted, FEW) else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASH_BYTES):
                asked = part.column("node").to_pylist()
                sets = [(node, x) for node, x in zip(asked, shingle_sets(*text_bytes(part.column("text")), words)) if node == fingerprint(x)]
                columns = [pa.array([c for c, _ in sets], pa.int64()), pa.array([len(x) for _, x in sets], pa.int64()), pa.array([odd_sketch(x) for _, x in sets], pa.binary()), pa.array([x.astype("<u8").tobytes() for _, x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sketch", "elements"])

    return docs.join(wanted, "row").select("node", "text").mapInArrow(tidy(run), "node long, n long, sketch binary, elements binary")


def _classes(docs: DataFrame, words: int, threshold_pct: int) -> DataFrame:
    """``doc_id``, ``row`` (a 64-bit key of id and text), ``n`` and ``component`` (a fingerprint) of every document of ``docs`` (``doc_id``, ``text``)."""
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    each = materialize(scan_classes(docs, words), "set-classes")
    shared = materialize(shared_signatures(scan_signatures(docs, words, threshold_pct)), "shared-signatures")
    first = each.where("n > 0").groupBy("node").agg(F.min("row").alias("row"))
    repeated = not each.groupBy("row").count().where("count > 1").isEmpty()

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(nodes.join(first, "node").select("row", "node"), "candidates")
        sets = scan_sets(docs, wanted, words)
        return sets.dropDuplicates(["node"]) if repeated else sets

    parts = components_of(shared, sets_of, threshold_pct)
    out = each.join(parts, "node", "left").select("doc_id", "row", "n", F.coalesce("component", "node").alias("component"))
    out = materialize(out, "set-components")
    discard(each)
    discard(shared)
    return out


def jaccard_components(docs: DataFrame, words: int = 3, threshold_pct: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links, of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_doc = _classes(docs, words, threshold_pct)
    # only components of several rows are joined; they are numbers, broadcast when few, so a large component is no large task
    smallest = of_doc.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    smallest = materialize(smallest, "component-names")
    out = of_doc.join(F.broadcast(smallest) if small_enough(smallest, FEW) else smallest, "component", "left")
    inside = (F.col("n") > 0) & F.col("least").isNotNull()
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(inside, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold_pct: int = 80) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any others) with one document of each component: that of the smallest id, ids before null.

    Documents without words all stay. No text is shuffled: the ids to drop are joined with the scan; only where rows
    are equal in id and text, those rows are brought together to keep one.
    """
    key, row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), unused(docs, "row_key")
    of_doc = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words, threshold_pct).where("n > 0")
    best = of_doc.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("best"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    best = materialize(best, "component-names")
    gone = of_doc.join(F.broadcast(best) if small_enough(best, FEW) else best, "component").where(F.col("row") != F.col("best.row")).select(F.col("row").alias(row)).distinct()
    gone = materialize(gone, "near-duplicates")
    gone = F.broadcast(gone) if small_enough(gone, FEW) else gone
    names = docs.columns
    kept = docs.withColumn(row, key).join(gone, row, "left_anti")
    again = materialize(of_doc.groupBy(F.col("row").alias(row)).count().where("count > 1").select(row), "repeated-rows")
    if again.isEmpty():
        return kept.select(*names)
    again = F.broadcast(again) if small_enough(again, FEW) else again
    once = kept.join(again, row, "left_anti").select(*names)
    return once.unionByName(kept.join(again, row, "left_semi").dropDuplicates([row]).select(*names))
