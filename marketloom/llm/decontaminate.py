"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m bytes stands in a text within k edits only if some region of the text shares at
least ``m + 1 - q (k + 1)`` of its q-grams, and their diagonals (place in the text less place in the item)
differ by at most k. So texts are scanned once for q-grams of the benchmark; hits are counted in
overlapping bands of ``2 (k + 1)`` diagonals; bands that reach the bound are verified by banded alignment,
which gives the edit distance and the region.

Both sides are compared as UTF-8 bytes in lower case (A-Z) with runs of white space as one space; the edit
budget is ``floor(rate * m)``. The default q of ``0.6 / rate`` keeps the bound positive and hits rare; an item too short
for it has the largest q that keeps its bound positive, down to its whole length.

The benchmark goes to the executors in blocks of about ``BLOCK_BYTES``, each a scan of the texts; one block
is the usual case. Of several, each is searched and its finds written down before the next is read, so the driver holds
one. Nothing else is broadcast and no text is shuffled.

Cases: null and empty texts hold nothing. Items shorter than the default q stand in a text only between word
boundaries (a one-letter item is not found inside words). Empty and null items are not searched. Equal items are found each
by its own id; items without an id are searched too and found with a null ``item_id``. An empty benchmark finds nothing. Documents without an id are searched like others, repeated rows each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import materialize, slices, text_bytes, tidy

BLOCK_BYTES = 2 << 20
TABLE_BITS = 22
#: Text searched at once; several 64-bit numbers are held for each byte.
FIND_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACES] = 0x20

#: Bytes of words: letters, digits and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Shorter items are found between word boundaries only.
SHORT_BYTES = 12


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place of each byte in the original) in lower case with single spaces."""
    out = _LOWER[data]
    space = out == 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = offsets[:-1][offsets[:-1] < len(out)]
    keep[starts] = True
    places = np.flatnonzero(keep)
    return out[places], np.searchsorted(places, offsets), places


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on (q <= 16)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q < 8:
        h = np.zeros(n, np.uint64)
        for i in range(q):
            h = h << np.uint64(8) | data[i : n + i].astype(np.uint64)
        return (h + np.uint64(q)) * np.uint64(0x9E3779B97F4A7C15)
    data = np.ascontiguousarray(data)
    head = np.ndarray((n,), "<u8", data, strides=(1,))
    tail = np.ndarray((n,), "<u8", data, q - 8, strides=(1,))
    h = head * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += tail
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x94D049BB133111EB)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(least edit distance, end in ``text``) of ``item`` against a piece of ``text`` along the diagonals low .. high."""
    wide = high - low + 1
    shift = np.arange(wide)
    padded = np.full(len(item) + wide + 2, -1, np.int16)  # text from diagonal low on; -1 beyond its ends
    a, b = max(0, -low), min(len(padded), len(text) - low)
    if b > a:
        padded[a:b] = text[a + low : b + low]
    big = 1 << 20
    now = np.where((shift + low >= 0) & (shift + low <= len(text)), 0, big).astype(np.int64)  # any start is free
    for i, c in enumerate(item):
        other = padded[i : i + wide]
        down = np.append(now[1:], big) + 1
        step = np.minimum(now + np.where(other == c, 0, np.where(other < 0, big, 1)), down)
        now = np.minimum.accumulate(step - shift) + shift
        now[(i + 1 + low + shift < 0) | (i + 1 + low + shift > len(text))] = big
    best = int(np.argmin(now))
    return int(now[best]), len(item) + low + best


def _item(text: str) -> np.ndarray:
    data, offsets = text_bytes(pa.array([text], pa.string()))
    data, _, _ = normalise(data, offsets)
    data = data[1:] if len(data) and data[0] == 0x20 else data
    return data[:-1] if len(data) and data[-1] == 0x20 else data


def _edge(text: np.ndarray, at: int) -> bool:
    """Whether a word begins or ends at a place of a text."""
    return at <= 0 or at >= len(text) or not (_WORD[text[at - 1]] and _WORD[text[at]])


class Benchmark:
    """A block of benchmark items, indexed by the q that each is searched with."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        by_q: dict[int, list] = {}
        for item_id, text in items:
            data = _item(text)
            if len(data):
                k = int(rate * len(data))
                by_q.setdefault(min(q, len(data) // (k + 1)), []).append((item_id, data, k))
        self.parts = [Index(of_q, own, own < q) for own, of_q in sorted(by_q.items())]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, edits) of every region of the texts that holds an item, in bytes of the text."""
        return [row for part in self.parts for row in part.find(data, offsets)]


class Index:
    """The q-grams of items that are searched with the same q; ``short``: items, which stand between word boundaries only."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], q: int, short: bool):
        self.q, self.short, self.items = q, short, []
        hashes, owners, places = [], [], []
        for item_id, data, k in items:
            h = gram_hashes(data, q)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append((item_id, data, k, len(data) + 1 - q * (k + 1)))
        empty = [np.zeros(0, np.int64)]
        h = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], np.concatenate(owners or empty)[order], np.concatenate(places or empty)[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hash >> np.uint64(64 - TABLE_BITS)] = True
        self.edits = np.array([x[2] for x in self.items], np.int64)
        self.bound = np.array([x[3] for x in self.items], np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, edits) of every region of the texts that holds an item, in bytes of the text."""
        small, ends, places = normalise(data, offsets)
        h = gram_hashes(small, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
        first = np.searchsorted(self.hash, h[at], side="left")
        found = np.searchsorted(self.hash, h[at], side="right") - first
        at, first, found = at[found > 0], first[found > 0], found[found > 0]
        if not len(at):
            return []
        row = np.searchsorted(ends, at, side="right") - 1
        inside = at + self.q <= ends[row + 1]
        at, first, found, row = at[inside], first[inside], found[inside], row[inside]
        total = int(found.sum())
        if not total:
            return []
        posting = np.repeat(first - (np.cumsum(found) - found), found) + np.arange(total)
        row, item = np.repeat(row, found), self.owner[posting]
        diagonal = np.repeat(at, found) - ends[row] - self.place[posting]
        step = self.edits[item] + 1
        out: dict[tuple[int, int], list] = {}
        for lag in (0, 1):  # a hit counts in the two bands that overlap there
            band = diagonal // step - lag
            keys = np.stack([row, item, band])
            order = np.lexsort(keys[::-1])
            keys = keys[:, order]
            edge = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if keys.shape[1] else np.zeros(0, np.int64)
            out_keys = keys[:, edge]
            counts = np.diff(np.append(edge, keys.shape[1]))
            out.setdefault("bands", []).append((out_keys, counts))
        keys = np.concatenate([k for k, _ in out["bands"]], 1)
        counts = np.concatenate([c for _, c in out["bands"]])
        if not keys.shape[1]:
            return []
        order = np.lexsort(keys[::-1])
        keys, counts = keys[:, order], counts[order]
        edge = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
        counts, keys = np.add.reduceat(counts, edge), keys[:, edge]
        held = counts >= self.bound[keys[1]]
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r, i, band in keys[:, held].T.tolist():
            item_id, wanted, k, _ = self.items[i]
            text = small[ends[r] : ends[r + 1]]
            low, high = band * (k + 1), (band + 2) * (k + 1) - 1
            edits, end = align(wanted, text, low, high)
            if edits > k:
                continue
            # the start, from the reversed texts
            _, back = align(wanted[::-1], text[max(0, end - len(wanted) - k) : end][::-1], -k, k)
            if self.short and len(wanted) < SHORT_BYTES and not (_edge(text, end - back) and _edge(text, end)):
                continue
            best.setdefault((r, i), []).append((edits, end - back, end))
        rows = []
        for (r, i), regions in best.items():
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(regions):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    first_byte, last_byte = int(places[ends[r] + a]), int(places[ends[r] + b - 1]) + 1
                    rows.append((r, self.items[i][0], first_byte - int(offsets[r]), last_byte - int(offsets[r]), edits))
        return rows


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The benchmark in blocks of about ``BLOCK_BYTES``, read one at a time, and whether there are more than one."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for i in range(n):
        yield [tuple(r) for r in rows.where(part == i).orderBy("item", "text").collect()], n > 1


def _q(rate: float, q: int | None) -> int:
    return min(16, max(8, q or round(0.6 / rate)))


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, q: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``end`` (bytes of the text) and ``edits`` of every region that holds an item."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block, several in blocks(benchmark, item_col, item_text_col):
        index = Benchmark(block, _q(rate, q), rate)

        def run(batches: Iterator[pa.RecordBatch], index: Benchmark = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", FIND_BYTES):
                    rows = index.find(*text_bytes(part.column("text")))
                    r, item, start, end, edits = zip(*rows) if rows else ((), (), (), (), ())
                    columns = [part.column("id").take(pa.array(r, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "end", "edits"])

        found = source.mapInArrow(tidy(run), "doc_id long, item_id long, start long, end long, edits int")
        found = materialize(found, "found-items") if several else found
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, q: int | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; a filter inside the scan."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    for block, several in blocks(benchmark, item_col, item_text_col):
        index = Benchmark(block, _q(rate, q), rate)

        def run(batches: Iterator[pa.RecordBatch], index: Benchmark = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, FIND_BYTES):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in index.find(*text_bytes(part.column(text_col)))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
        docs = materialize(docs, "clean-so-far") if several else docs
    return docs
