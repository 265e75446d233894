"""Alignment of two tokenizers' tokens by the bytes where both end.

``A`` is a byte-level BPE of the ``tokenizers`` library, ``B`` a sentencepiece model, which puts a space before a text;
``A`` is given the text with that space. Offsets where a token of either ends cut a document into groups; the last
tokens of a group, which end together, are a link. How often each pair of ids is linked in the corpus is counted:

1. Documents are aligned; each task counts its own pairs and writes them.
2. Distinct pairs are dealt into shards by a hash, and each shard gets a minimal perfect hash (:mod:`perfect_hash`).
3. Each group of up to ``FAN`` tasks' counts becomes a dense vector by that index, and vectors are summed in a tree of
   fan ``FAN``; a vector has ``SHARD_KEYS`` numbers or so, whatever the corpus.
4. Documents are aligned again, and their links' counts looked up by index, with verified keys.

Tables of up to ``FEW_PAIRS`` pairs are broadcast; larger ones are joined by a shuffle of each document's distinct pairs,
with the pairs that many links have (at most ``HOT_PAIRS`` of them) broadcast, so that no key is hot.

Cases: null and empty texts, and texts whose tokens' bytes are not the text's (U+2581 is a space to ``B``), have no
tokens: zeros and no groups. Repeated rows and null document ids stay rows of their own and each counts. Other columns
are left out, so clashing names cannot disturb. Texts are aligned whole; a very long one takes some 100 bytes of memory
for each of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import perfect_hash
from marketloom.llm.bpe import split, take
from marketloom.llm.common import discard, materialize, pre_tokens, slices, text_bytes
from marketloom.llm.token_counts import counter

#: Words that one Python worker remembers, some 250 bytes each; then it forgets all. A bound on memory, not on results.
REMEMBERED = 500_000
#: Keys of a shard, about.
SHARD_KEYS = 8_192
#: Tasks' counts, or vectors, that are summed at once.
FAN = 16
#: Pairs that are broadcast at most, 17 bytes each.
FEW_PAIRS = 2_000_000
#: Pairs with more links than this share of all, of which there are fewer than this number.
HOT_PAIRS = 10_000
#: Pairs that a task holds before it writes their counts.
HELD_PAIRS = 1_000_000


class ByteLevel:
    """Ids of words by a byte-level BPE file of the ``tokenizers`` library with its usual splitting pattern and no normaliser."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        # the characters that stand for bytes: printable ones for themselves, the others from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        vocabulary = self.tokenizer.get_vocab()
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the tokens up to a byte and from there on are the same if a text is cut there."""
        return split(data, offsets, alone=True)

    def encode(self, words: list[str]) -> list[list[int]]:
        out = []
        for lo in range(0, len(words), 20_000):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(words[lo : lo + 20_000], add_special_tokens=False)]
        return out


class Pieces:
    """Ids of words by a sentencepiece model without normalisation; words are cut as in :mod:`token_counts`."""

    def __init__(self, path: str):
        counts = counter(path)
        self.model, self.safe, self.first = counts.model, counts.cut, counts.first
        is_byte = self.model.is_byte
        self.token = [bytes([int(p[3:5], 16)]) if is_byte(i) else p.replace("▁", " ").encode() for i in range(self.model.get_piece_size()) for p in [self.model.id_to_piece(i)]]

    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether nothing can be merged across the place before a byte."""
        out = np.zeros(len(data), bool)
        out[1:] = self.safe[data[:-1], data[1:]]
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        # the model itself adds the space of a word; a line break, which joins with nothing, comes before the others
        own = [w[0] == " " and w.strip(" ") != "" for w in words]
        out = self.model.encode([w[1:] if x else "\n" + w for w, x in zip(words, own)], num_threads=1)
        return [ids if x else ids[self.first :] for ids, x in zip(out, own)]


class Tokens:
    """The ids of many words by one tokenizer, with where each token ends among all words' bytes."""

    def __init__(self, tokenizer: ByteLevel | Pieces, words: list[str], data: np.ndarray, offsets: np.ndarray):
        encoded = tokenizer.encode(words)
        self.counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.ids = np.fromiter(chain.from_iterable(encoded), np.int32, int(self.counts.sum()))
        begins, flat = tokenizer.flat
        sizes = begins[self.ids + 1] - begins[self.ids]
        self.bounds = np.append(0, np.cumsum(self.counts))
        total = np.append(0, np.cumsum(sizes))
        #: Whether a word's tokens have other bytes than the word.
        self.other = (total[self.bounds[1:]] - total[self.bounds[:-1]]) != np.diff(offsets)
        if not self.other.any():
            self.ends = total[1:]
            wrong = np.flatnonzero(take(flat, begins[self.ids], sizes) != data)
            self.other[np.searchsorted(offsets, wrong, side="right") - 1] = True


class Words:
    """Words between places where both tokenizers' texts can be cut, each with its tokens, groups and links.

    A word's first and last byte are those of a group, so a text's groups are those of its words.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        for x in (a, b):
            sizes = np.array([*map(len, x.token)], np.int64)
            x.flat = np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(x.token), np.uint8)
        # ids as text with what follows: 0 inside a group, 1 at the end of its half, 2 at the end of a word
        self.a_names = np.array([[f"{i},", f"{i}|"] for i in range(len(a.token))], object).T
        self.b_names = np.array([[f"{i},", f"{i};", str(i)] for i in range(len(b.token))], object).T
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: a word whose tokens have other bytes
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of a, of b, links, and where its links begin
        self.pairs = np.zeros(0, np.int64)

    def _align(self, words: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(groups, numbers, pairs) of words."""
        data, offsets = text_bytes(pa.array(words, pa.large_string()))
        a, b = Tokens(self.a, words, data, offsets), Tokens(self.b, words, data, offsets)
        if (other := a.other | b.other).any():
            good = np.flatnonzero(~other)
            groups, numbers, pairs = [None] * len(words), np.zeros((len(words), 4), np.int64), np.zeros(0, np.int64)
            if len(good):
                some, numbers[good], pairs = self._align([words[i] for i in good])
                for i, x in zip(good.tolist(), some):
                    groups[i] = x
            return groups, numbers, pairs
        ends = np.zeros(len(data) + 1, bool)
        ends[a.ends] = True
        b_at = np.flatnonzero(ends[b.ends])  # the links' tokens
        a_at = np.searchsorted(a.ends, b.ends[b_at])
        bounds = np.append(0, np.searchsorted(b.ends[b_at], offsets[1:], side="right"))
        n_a, n_b = len(a.ids), len(b.ids)
        a_group, b_group, a_last, b_last = (np.zeros(n, np.int64) for n in (n_a, n_b, n_a, n_b))
        a_group[a_at[:-1] + 1] = 1
        b_group[b_at[:-1] + 1] = 1
        a_last[a_at] = 1
        b_last[b_at] = 1
        b_last[b.bounds[1:] - 1] = 2
        parts = np.empty(n_a + n_b, object)
        parts[np.arange(n_a) + np.append(0, b_at + 1)[np.cumsum(a_group)]] = self.a_names[a_last, a.ids]
        parts[np.arange(n_b) + (a_at + 1)[np.cumsum(b_group)]] = self.b_names[b_last, b.ids]
        parts, places = parts.tolist(), (a.bounds + b.bounds).tolist()
        groups = ["".join(parts[x:y]) for x, y in zip(places, places[1:])]
        return groups, np.stack([a.counts, b.counts, np.diff(bounds), bounds[:-1]], 1), a.ids[a_at].astype(np.int64) << 32 | b.ids[b_at]

    def rows(self, words: list[str]) -> np.ndarray:
        """Where distinct words are in ``groups`` and ``numbers``, until the next call."""
        if len(self.known) > REMEMBERED:
            self._forget()
        found = [*map(self.known.get, words)]
        new = [w for w, x in zip(words, found) if x is None]
        if new:
            groups, numbers, pairs = self._align(new)
            numbers[:, 3] += len(self.pairs)
            self.known.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
            self.groups += groups
            self.numbers, self.pairs = np.concatenate([self.numbers, numbers]), np.append(self.pairs, pairs)
            found = [*map(self.known.get, words)]
        return np.array(found, np.int64)


class Aligned:
    """A slice of texts: the rows of its distinct words, each text's words among them, and which texts have tokens."""

    def __init__(self, words: Words, texts: pa.Array):
        import pyarrow.compute as pc

        self.words = words
        texts, none = pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, none))
        data, offsets = text_bytes(texts)
        self.n = len(texts)
        if not len(data):
            self.rows, self.codes, self.first, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64), np.zeros(self.n, bool)
            return
        strings, _, self.first = pre_tokens(data, offsets, words.a.begins(data, offsets) & words.b.begins(data, offsets))
        coded = strings.dictionary_encode()
        self.codes = np.asarray(coded.indices)
        self.rows = words.rows(coded.dictionary.to_pylist())
        self.good = np.diff(self.first) > 0
        other = np.array([words.groups[i] is None for i in self.rows.tolist()])
        if other.any():
            self.good[np.searchsorted(self.first, np.flatnonzero(other[self.codes]), side="right") - 1] = False

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """What the words of each text add up to."""
        total = np.append(0, np.cumsum(of_word[self.codes]))
        return np.where(self.good, total[self.first[1:]] - total[self.first[:-1]], 0)

    def numbers(self) -> list[np.ndarray]:
        """Tokens of a and of b, and links of each text."""
        return [self.sums(self.words.numbers[self.rows, k]) for k in range(3)]

    def groups(self) -> list[str]:
        names = np.array([self.words.groups[i] for i in self.rows.tolist()], object)[self.codes].tolist() if len(self.rows) else []
        return [";".join(names[x:y]) if good else "" for x, y, good in zip(self.first.tolist(), self.first[1:].tolist(), self.good.tolist())]

    def pairs(self, rows: np.ndarray) -> np.ndarray:
        """The linked pairs of words, one after another."""
        return take(self.words.pairs, self.words.numbers[rows, 3], self.words.numbers[rows, 2])

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs, their links) of the slice."""
        words = np.bincount(self.codes[np.repeat(self.good, np.diff(self.first))], minlength=len(self.rows))
        return _summed(self.pairs(self.rows), np.repeat(words, self.words.numbers[self.rows, 2]))


_WORDS: dict[tuple[str, str], Words] = {}


def words_of(a_file: str, b_file: str) -> Words:
    """One for each pair of files and Python worker."""
    if (a_file, b_file) not in _WORDS:
        _WORDS[a_file, b_file] = Words(ByteLevel(a_file), Pieces(b_file))
    return _WORDS[a_file, b_file]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _count_pairs(source: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """``pair``, ``h`` (what shards go by), ``n`` and ``task``: every task's counts of its links' pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(a_file, b_file)
        task, keys, counts = TaskContext.get().partitionId(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(perfect_hash.shard_hash(keys)), pa.array(counts), pa.array(np.full(len(keys), task), pa.int32())], ["pair", "h", "n", "task"])

        for batch in batches:
            for part in slices(batch):
                new, n = Aligned(words, part.column("text")).pair_counts()
                new, n = new[n > 0], n[n > 0]
                keys, counts = _summed(np.append(keys, new), np.append(counts, n))
                if len(keys) >= HELD_PAIRS:
                    yield close()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield close()

    return source.select("text").mapInArrow(run, "pair long, h long, n long, task int")


class PairCounts:
    """Counts of the corpus' pairs as one row for each shard: perfect hash, keys and dense counts by index."""

    def __init__(self, partial: DataFrame):
        """``partial``: of :func:`_count_pairs`, written."""
        distinct = materialize(partial.select("pair", "h").distinct(), "distinct-pairs")
        totals = partial.agg(F.sum("n"), F.max("task")).first()
        self.n_pairs, self.n_links = distinct.count(), totals[0] or 0
        self.n_shards = max(1, -(-self.n_pairs // SHARD_KEYS))
        shard, salts = F.pmod("h", F.lit(self.n_shards)).cast("int").alias("shard"), (totals[1] or 0) // FAN + 1

        def build(table: pa.Table) -> pa.Table:
            sizes, words, keys = perfect_hash.build(table.column("pair").to_numpy())
            return pa.table({"shard": table.column("shard").slice(0, 1), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())), "words": [words.tobytes()], "keys": [keys.tobytes()]})

        kind = "shard int, sizes array<long>, words binary, keys binary"
        functions = materialize(distinct.select("pair", shard).groupBy("shard").applyInArrow(build, kind), "perfect-hashes")
        discard(distinct)

        def dense(key: tuple, counts: pa.Table, function: pa.Table) -> pa.Table:
            table = table_of(function.to_pylist())
            sums = np.zeros(len(table.keys), np.int64)
            if counts.num_rows:
                np.add.at(sums, table(counts.column("pair").to_numpy()), counts.column("n").to_numpy())
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "counts": [sums.tobytes()]})

        def add(key: tuple, vectors: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x.as_buffer(), np.int64) for x in vectors.column("counts"))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "counts": [sums.tobytes()]})

        salted = partial.select("pair", "n", shard, F.floor(F.col("task") / FAN).cast("int").alias("salt")).groupBy("shard", "salt")
        copies = functions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("shard", "salt")
        vectors = salted.cogroup(copies).applyInArrow(dense, "shard int, salt int, counts binary")
        while salts > 1:
            salts = -(-salts // FAN)
            vectors = vectors.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")).groupBy("shard", "salt").applyInArrow(add, "shard int, salt int, counts binary")
        self.table = materialize(functions.join(vectors.drop("salt"), "shard"), "pair-counts")
        discard(functions)

    def rows(self) -> DataFrame:
        """``pair`` and ``n``, one row for each distinct pair."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (keys, counts)], ["pair", "n"])

        return self.table.select("keys", "counts").mapInArrow(run, "pair long, n long")

    def best(self, n_b: int) -> np.ndarray:
        """The highest count of any pair of each B id: a vector as long as B's vocabulary."""
        out = np.zeros(n_b, np.int64)
        for b, n in self.rows().groupBy(F.col("pair").bitwiseAND(LOW).alias("b")).agg(F.max("n").alias("n")).collect():
            out[b] = n
        return out


def table_of(rows: list[dict]) -> perfect_hash.Table:
    """The rows of shards in their order, as one table."""
    return perfect_hash.Table([(np.array(r["sizes"], np.int64), np.frombuffer(r["words"], "<u8"), np.frombuffer(r["keys"], np.int64)) for r in rows])


COUNTED = "n_a long, n_b long, n_groups long, n_links long, groups string"
#: The bits of a pair that are its B id.
LOW = 0xFFFFFFFF


def align(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", few_pairs: int = FEW_PAIRS) -> DataFrame:
    """Per document: ``id_col``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair's count
    is the highest of its B id in the corpus, ties included), ``count_sum`` (over links) and ``groups``, as
    ``a1,a2|b1;a3|b2,b3`` in decimal ids, empty without tokens.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    partial = materialize(_count_pairs(source, a_file, b_file), "pairs")
    counts = PairCounts(partial)
    discard(partial)
    best = spark.sparkContext.broadcast(counts.best(len(words_of(a_file, b_file).b.token)))
    if counts.n_pairs <= few_pairs:
        return _looked_up(source, counts, best, a_file, b_file).withColumnRenamed("id", id_col)
    return _joined(source, counts, best, a_file, b_file).withColumnRenamed("id", id_col)


def _doc_columns(ids: pa.Array, x: Aligned) -> list[pa.Array]:
    a, b, links = (pa.array(n) for n in x.numbers())
    return [ids, a, b, links, links, pa.array(x.groups(), pa.string())]


def _looked_up(source: DataFrame, counts: PairCounts, best, a_file: str, b_file: str) -> DataFrame:
    rows = sorted((r.asDict() for r in counts.table.collect()), key=lambda r: r["shard"])  # FEW_PAIRS at most
    sent = source.sparkSession.sparkContext.broadcast([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()} for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = words_of(a_file, b_file), table_of(sent.value)
        numbers = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in sent.value)])
        for batch in batches:
            for part in slices(batch):
                x = Aligned(words, part.column("text"))
                pairs, links = x.pairs(x.rows), words.numbers[x.rows, 2]
                at = table(pairs)
                n = np.where(at >= 0, numbers[at], 0) if len(numbers) else np.zeros(len(at), np.int64)  # none: only in texts without tokens
                bounds = np.append(0, np.cumsum(links))
                sums = [np.diff(np.append(0, np.cumsum(y))[bounds]) for y in ((n == best.value[pairs & LOW]) & (at >= 0), n)]
                yield pa.RecordBatch.from_arrays([*_doc_columns(part.column("id"), x), *(pa.array(x.sums(y)) for y in sums)], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

    return source.mapInArrow(run, f"id long, {COUNTED}, n_best long, count_sum long").select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def _joined(source: DataFrame, counts: PairCounts, best, a_file: str, b_file: str) -> DataFrame:
    """Counts by a join of each document's distinct pairs, for tables too large to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = words_of(a_file, b_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                x = Aligned(words, part.column("text"))
                links = words.numbers[x.rows, 2][x.codes]
                doc = np.repeat(np.repeat(np.arange(x.n), np.diff(x.first)), links)
                pairs = x.pairs(x.rows[x.codes])
                pairs, doc = pairs[x.good[doc]], doc[x.good[doc]]
                order = np.lexsort((pairs, doc))
                pairs, doc = pairs[order], doc[order]
                first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1]))) if len(pairs) else order
                bounds = pa.array(np.searchsorted(doc[first], np.arange(x.n + 1)), pa.int32())
                times = np.diff(np.append(first, len(pairs)))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(y)) for y in (pairs[first], times)]
                uid = pa.array(row + np.arange(x.n))
                row += x.n
                yield pa.RecordBatch.from_arrays([*_doc_columns(part.column("id"), x), uid, *lists], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "uid", "pairs", "times"])

    docs = materialize(source.mapInArrow(run, f"id long, {COUNTED}, uid long, pairs array<long>, times array<long>"), "aligned")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, b = batch.column("n").to_numpy(), batch.column("pair").to_numpy() & LOW
            yield pa.RecordBatch.from_arrays([batch.column("pair"), batch.column("n"), pa.array(n == best.value[b])], ["pair", "n", "is_best"])

    table = counts.rows().mapInArrow(rated, "pair long, n long, is_best boolean")
    hot = F.col("n") > counts.n_links // HOT_PAIRS
    links = docs.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    links = links.join(F.broadcast(table.where(hot).select("pair", F.col("n").alias("hot_n"), F.col("is_best").alias("hot_best"))), "pair", "left")
    common = links.where("hot_n is not null").select("uid", "times", F.col("hot_n").alias("n"), F.col("hot_best").alias("is_best"))
    rare = links.where("hot_n is null").select("uid", "times", "pair").join(table.where(~hot), "pair").select("uid", "times", "n", "is_best")
    sums = common.unionByName(rare).groupBy("uid").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = docs.drop("pairs", "times").join(sums, "uid", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
