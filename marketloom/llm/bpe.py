"""Byte-level BPE encoding and decoding in padded numpy matrices.

Texts are split into pre-tokens, each distinct one of a slice that is not remembered becomes a row of byte ids in a
matrix of its bucket of lengths, and in each round every row of a matrix merges its leftmost pair of least rank:

* ranks of pairs come from a hash table (open addressing) of all pairs of tokens whose bytes together are a token;
* after a merge the row is compacted, so that a matrix loses one column a round, and rows without a pair leave it;
* only the two pairs beside a merge are looked up again.

Rows beyond ``WIDE`` bytes would need a round for each byte. They merge all pairs of the least rank at once where the
pairs that this makes, also those in between, are all of a higher rank, which one at a time would give as well; else
their leftmost only.

Cases: null and empty texts have no ids; texts of any length are encoded whole (a long one in pieces, cut before the
space after a printable ASCII character, where a pre-token begins in any case). Repeated rows and null document ids
stay rows of their own; other columns are left out, so clashing names cannot disturb. Decoding null ids gives no bytes;
an id that is not in the ranks is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import pre_tokens, slices, text_bytes

# Fixed value: the splitting pattern that `split` cuts by without a regular expression engine.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of a pre-token from which its row is merged on its own.
WIDE = 256
#: Cells of one matrix.
CELLS = 1 << 20
#: Distinct pre-tokens that one Python worker remembers, those of up to 40 bytes; a bound on memory, not on results.
REMEMBERED = 400_000
#: Bytes of one text that are split at once.
PIECE = 4 << 20

NONE = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For every code point: letter, number, white space or another."""
    if not _KINDS:
        import regex

        table, every = np.full(0x110000, OTHER, np.uint8), "".join(map(chr, range(0x110000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _KINDS.append(table)
    return _KINDS[0]


def split(data: np.ndarray, offsets: np.ndarray, alone: bool = False) -> np.ndarray:
    """Whether a pre-token of ``PATTERN`` begins at a byte; ``data``, ``offsets`` as of :func:`text_bytes`.

    ``alone``: leave out the begins behind two or more white-space characters, which make one pre-token where nothing
    follows; a text cut at any of the other begins has the same pre-tokens in its parts.

    A run of letters, of numbers or of others is a pre-token, with a space (U+0020) before it; white space before
    that is another, and a last white-space character that is no space one more. An apostrophe alone takes the letters
    of a contraction along.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width) - width
    n = len(points)
    head = np.zeros(n + 4, bool)
    first = np.searchsorted(at, offsets)
    head[first] = True
    head[n:] = True
    kind = np.full(n + 4, SPACE, np.uint8)
    kind[:n] = kinds()[points]
    points = np.append(points, np.zeros(4, np.uint32))
    begins = head.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:])  # white space before something else
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    mark = np.flatnonzero((points == 0x27) & begins)
    mark = mark[(kind[mark + 1] == LETTER) & ~head[mark + 1]]
    one, two = points[mark + 1], points[mark + 2]
    short = mark[np.isin(one, [ord(c) for c in "stmd"])]
    begins[short + 1] = False
    begins[short + 2] = True
    long = mark[((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~head[mark + 2]]
    begins[long + 1] = False
    begins[long + 3] = True
    if alone:
        begins[2:] &= head[2:] | (kind[2:] == SPACE) | (kind[1:-1] != SPACE) | (kind[:-2] != SPACE)
    out = np.zeros(len(data), bool)
    out[at[begins[:n]]] = True
    return out


def split_by(pattern: str):
    """Like :func:`split`, for any pattern whose matches cover the text."""
    if pattern == PATTERN:
        return split
    import regex

    compiled = regex.compile(pattern)

    def other(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data), bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text, end, done = data[a:b].tobytes().decode("utf-8"), 0, a
            for m in compiled.finditer(text):
                if m.start() != end or m.end() == end:
                    raise ValueError("the pattern's matches must cover every text")
                if done < len(out):
                    out[done] = True
                done += len(m[0].encode())
                end = m.end()
            if end != len(text):
                raise ValueError("the pattern's matches must cover every text")
        return out

    return other


class Pairs:
    """Hash table from two token ids to the id of their bytes together."""

    FREE = np.uint64(2**64 - 1)
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(len(left), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.FREE), np.full(1 << bits, NONE)
        keys = self._key(left, right)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == self.FREE]
            self.keys[slot[free]] = keys[free]  # of several for one slot one stays
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = slot[todo] + 1 & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.FACTOR >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids of pairs, ``NONE`` where there is none; negative ids are in no pair."""
        out = np.full(left.shape, NONE)
        keys = self._key(left, right)
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (found != self.FREE) & (left >= 0) & (right >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != self.FREE)]
        return out


def take(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[begins[i] : begins[i] + sizes[i]]`` of all i, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Ranks:
    """A file of ranks: one line for each token, its bytes in base64 and its rank, which is its id."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        get = self.ranks.get
        pairs = [
            (left, right, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
            if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None
        ]
        self.pairs = Pairs(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.single = np.array([get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("every byte must be a token")
        self.sizes, self.begins = np.full(max(self.ranks.values()) + 1, -1, np.int64), np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        known = np.maximum(self.sizes, 0)
        self.begins = np.cumsum(known) - known
        self.flat = np.zeros(int(known.sum()), np.uint8)
        for token, rank in self.ranks.items():
            self.flat[self.begins[rank] : self.begins[rank] + len(token)] = np.frombuffer(token, np.uint8)
        self.split = split_by(pattern)
        self.known: dict[bytes, bytes] = {}

    # -- merging

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of pre-tokens; a pre-token that is a token is that one."""
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if (rank := self.ranks.get(word)) is not None:
                out[i] = np.array([rank], np.int32)
            else:
                buckets.setdefault((len(word) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            if 1 << bits > WIDE:
                for i in rows:
                    out[i] = self._merge_wide(self.single[np.frombuffer(words[i], np.uint8)])
                continue
            for lo in range(0, len(rows), CELLS >> bits):
                some = rows[lo : lo + (CELLS >> bits)]
                for i, ids in zip(some, self._merge_rows([words[i] for i in some])):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([*map(len, words)])
        bytes_, ids = np.frombuffer(b"".join(words), np.uint8), np.full((len(words), sizes.max()), -1, np.int32)
        ids[np.arange(sizes.max()) < sizes[:, None]] = self.single[bytes_]
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        out, rows = [None] * len(words), np.arange(len(words))
        while len(rows):
            width = ids.shape[1]
            each = np.arange(len(rows))
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            best = ranks[each, at] if width > 1 else np.full(len(rows), NONE)
            ended = best == NONE
            if ended.any():
                for row, left in zip(rows[ended].tolist(), ids[ended]):
                    out[row] = left[left >= 0]
                rows, ids, ranks, at, best = (x[~ended] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    break
                each = np.arange(len(rows))
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            i, j = np.append(before, after), np.append(at[before] - 1, at[after])
            ranks[i, j] = self.pairs(ids[i, j], ids[i, j + 1])
        return out

    def _merge_wide(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # of neighbours that share a token every second one, from the left
            run = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            joined = at[1:][np.diff(at) == 2]  # pairs right behind another one that merges
            between = self.pairs(np.full(len(joined), best, np.int32), ids[joined])
            now = self._wide_step(ids, ranks, at, best) if (between > best).all() else None
            if now is None or (now[2] <= best).any():
                now = self._wide_step(ids, ranks, at[:1], best)
            ids, ranks = now[:2]
        return ids

    def _wide_step(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the pairs at ``at``: (ids, ranks of pairs, ranks of the new pairs)."""
        ids = ids.copy()
        ids[at] = best
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids[keep]
        keep = np.ones(len(ranks), bool)
        keep[at] = False
        ranks = ranks[keep]
        at = at - np.arange(len(at))
        new = np.unique(np.append(at - 1, at))
        new = new[(new >= 0) & (new < len(ranks))]
        ranks[new] = fresh = self.pairs(ids[new], ids[new + 1])
        return ids, ranks, fresh

    # -- texts

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of distinct pre-tokens."""
        asked = words.cast(pa.large_binary()).to_pylist()
        found = [*map(self.known.get, asked)]
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self.merge([asked[i] for i in new])):
            found[i] = ids.tobytes()
            if len(asked[i]) <= 40 and len(self.known) < REMEMBERED:
                self.known[asked[i]] = found[i]
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        data, offsets = text_bytes(texts)
        parts, ends, done = [], [], 0
        for a, b in pieces(data, offsets):
            inside = np.unique(np.clip(offsets, a, b) - a)
            ids, bounds = self._encode(data[a:b], inside)
            parts.append(ids)
            ends.append(np.stack([a + inside[1:], done + bounds[1:]]))
            done += len(ids)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        at, ids = np.concatenate([np.zeros((2, 1), np.int64), *ends], 1)
        return np.concatenate(parts), ids[np.searchsorted(at, offsets)]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, _, first = pre_tokens(data, offsets, self.split(data, offsets))
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices)
        flat, sizes = self.lookup(coded.dictionary)
        counts = sizes[codes]
        total = np.concatenate(([0], np.cumsum(counts)))
        return take(flat, (np.cumsum(sizes) - sizes)[codes], counts), total[first]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, how many each has)."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
            raise ValueError("an id that is not in the ranks")
        return take(self.flat, self.begins[ids], self.sizes[ids]), self.sizes[ids]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``most`` bytes: whole texts, or parts of a longer text cut before a space."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + most, n)
        if b < n:
            whole = offsets[np.searchsorted(offsets, b, side="right") - 1]
            if whole > a:
                b = int(whole)
            else:
                text_end, at = int(offsets[np.searchsorted(offsets, a, side="right")]), b
                b = text_end
                while at < text_end:  # the next space after a printable ASCII character
                    some = data[at - 1 : min(at + most, text_end)]
                    cut = np.flatnonzero((some[1:] == 0x20) & (some[:-1] > 0x20) & (some[:-1] < 0x7F))
                    if len(cut):
                        b = at + int(cut[0])
                        break
                    at += len(some) - 1
        yield a, b
        a = b


_RANKS: dict[tuple[str, str], Ranks] = {}


def ranks_of(path: str, pattern: str = PATTERN) -> Ranks:
    """One for each file and Python worker."""
    if (path, pattern) not in _RANKS:
        _RANKS[path, pattern] = Ranks(path, pattern)
    return _RANKS[path, pattern]


def encode(df: DataFrame, ranks_file: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(ranks_file, pattern)
        for batch in batches:
            for part in slices(batch):
                ids, ends = ranks.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["id", "ids"])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_file: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (the bytes of all tokens of ``ids``) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(ranks_file)
        for batch in batches:
            column = batch.column("ids")
            sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (PIECE >> 2), side="right")))
                part = column.slice(start, stop - start)
                decoded, each = ranks.decode(part.flatten().to_numpy())
                bounds = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(sizes[start:stop])))]
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - start, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(decoded))])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, stop - start), part, out.cast(pa.binary())], ["id", "ids", "decoded"])
                start = stop

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col("ids").cast("array<int>").alias("ids"))
    return source.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
