"""Token ids as binary files in document order, and back.

``write_token_files`` sorts the documents by id over range partitions, encodes each partition's
texts and codes the ids by Simple-8b (:mod:`simple8b`) into segments. The container is Parquet,
written by Spark's committer, so that any store that Spark writes to will do and a lost executor
only repeats its own tasks: one row for each segment with the columns ``part`` (the range
partition, ascending with the ids), ``segment`` (its number inside), ``n_ids`` and ``payload``.

A payload, little-endian::

    4 bytes    magic "S8T2"
    3 x uint32 documents d, blocks b, words w
    d x uint8  whether a document has no id
    d x int64  document ids, 0 where there is none
    d x uint32 ids of each document
    (b + 1) x uint32 first word of each block, and the end
    w x uint64 Simple-8b words

Cases: null and empty texts have only the end id. Repeated document ids keep their own rows, in
any order among them. Documents without an id come before all others. An empty table gives no segments. Very long texts stay in one segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import simple8b
from marketloom.llm.common import pre_tokens, slices, text_bytes
from marketloom.llm.jaccard_join import mix

MAGIC = b"S8T2"
#: Ids after which a segment is closed.
SEGMENT_IDS = 2 << 20
#: Distinct pre-tokens that one Python worker remembers, about 50 bytes each; a bound on memory, not on results.
REMEMBERED = 1_500_000
#: Words that the library encodes as one text.
JOINED = 2_000

_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.default_rng(13).integers(1, 2**63, (2, 256), dtype=np.uint64)
_POWER: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    known = _POWER.get(inverse)
    if known is None or len(known) < n:
        base = np.full(max(n, 1), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        base[0] = 1
        known = _POWER[inverse] = np.multiply.accumulate(base)
    return known[:n]


class WordEncoder:
    """Ids of a ``tokenizers`` file whose pre-tokenizer drops white space and parts letters from the rest.

    Texts are cut where the tokenizer's own normaliser and splitting pattern start anew in any case:
    at white space, and between an ASCII or Latin-1 letter and what is neither letter nor white space
    (but not before a letter, as an apostrophe may join it). Each distinct pre-token of a slice that is not
    remembered is encoded by the library; words of ASCII letters many at a time, as their last token tells where each
    ends. Texts with a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # kinds of bytes: 0 others of ASCII, 1 white space, 2 letters, 3 parts of other characters
        self.kind = np.zeros(256, np.uint8)
        self.kind[[0x20, *range(0x09, 0x0E)]] = 1
        self.kind[[*range(65, 91), *range(97, 123)]] = 2
        self.kind[128:] = 3
        # whether a pre-token begins at a byte, by the kinds of the byte before and its own
        self.begins = np.zeros(16, bool)
        self.begins[[4 * 1 + 0, 4 * 1 + 2, 4 * 1 + 3, 4 * 2 + 0]] = True
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower
        self.keys = np.zeros((0, 2), np.uint64)  # of what is remembered, by rising first key: two hashes
        self.place = np.zeros((0, 2), np.int64)  # and where its ids begin and how many they are
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each)."""
        sizes, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii() and w.strip(" \t\n\v\f\r").isalpha()] if self.ends_word.any() else []
        rest = set(range(len(words)))
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(words[i] for i in g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group) or len(ids) != ends[-1]:
                continue  # they are not one piece each after all
            for i, a, b in zip(group, np.append(0, ends[:-1]).tolist(), ends.tolist()):
                parts[i] = ids[a:b]
                sizes[i] = b - a
            rest.difference_update(group)
        left = sorted(rest)
        for lo in range(0, len(left), 20_000):
            some = left[lo : lo + 20_000]
            for i, ids in zip(some, self._encode([words[i] for i in some])):
                parts[i] = np.array(ids, np.uint32)
                sizes[i] = len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes

    def _lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin among them, and how many they are) of distinct words."""
        data, offsets = text_bytes(words)
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[data] * _powers(len(data)), dtype=np.uint64))) for codes in _CODES]
        back = _powers(len(data) + 1, inverse=True)[offsets[:-1]]
        size = np.diff(offsets).astype(np.uint64)
        keys = np.stack([mix((x[offsets[1:]] - x[offsets[:-1]]) * back + size) for x in sums], 1)
        at = np.minimum(np.searchsorted(self.keys[:, 0], keys[:, 0]), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == keys).all(1) if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        ids, sizes = self._encode_words(words.take(pa.array(new)).to_pylist())
        begins, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if known.any():
            begins[known], counts[known] = self.place[at[known]].T
        flat = np.concatenate((self.ids, ids))
        begins[new], counts[new] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        if len(self.keys) + len(new) <= REMEMBERED:
            self.ids = flat
            order = new[np.argsort(keys[new, 0], kind="stable")]
            where = np.searchsorted(self.keys[:, 0], keys[order, 0])
            self.keys = np.insert(self.keys, where, keys[order], 0)
            self.place = np.insert(self.place, where, np.stack([begins[order], counts[order]], 1), 0)
        return flat, begins, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if whole.any():
            parts = [self._encode([t])[0] if w else None for t, w in zip(texts.to_pylist(), whole)]
            rest, ends = self._cut(texts.filter(pa.array(~whole)))
            at = iter(range(len(ends) - 1))
            parts = [np.array(p, np.uint32) if w else rest[ends[k := next(at)] : ends[k + 1]] for p, w in zip(parts, whole)]
            return np.concatenate(parts).astype(np.uint32), np.cumsum([0, *map(len, parts)])
        return self._cut(texts)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        kind = self.kind[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = self.begins[kind[:-1] << 2 | kind[1:]]
        # the two bytes of a Latin-1 letter, before what is no letter
        c3 = np.flatnonzero(data[:-2] == 0xC3)
        second = data[c3 + 1]
        cut[c3[(second != 0x97) & (second != 0xB7) & (kind[c3 + 2] == 0)] + 2] = True
        data = self.lower[data]
        words, _, first = pre_tokens(data, offsets, cut)
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices)
        flat, begin, sizes = self._lookup(coded.dictionary)
        counts = sizes[codes]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.repeat(begin[codes] - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack(no_id: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    head = struct.pack("<4s3I", MAGIC, len(doc_ids), len(offsets) - 1, len(words))
    return b"".join([head, no_id.astype(np.uint8).tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which documents have no id, document ids, ids of each, all ids) of a segment."""
    magic, d, b, w = struct.unpack_from("<4s3I", payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at, out = 16, []
    for kind, n in (("?", d), ("<i8", d), ("<u4", d), ("<u4", b + 1), ("<u8", w)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * out[-1].itemsize
    return out[0], out[1], out[2].astype(np.int64), simple8b.decode(out[4], out[3])


def write_token_files(df: DataFrame, path: str, tokenizer_file: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write the ids of ``text_col`` in ascending order of ``id_col`` as token files under ``path``.

    One shuffle, of the texts by ranges of ids; nothing passes through the driver.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size, segment = encoder(tokenizer_file).encode, [], 0, 0

        def close() -> pa.RecordBatch:
            none, docs, sizes, ids = (np.concatenate(x) for x in zip(*held))
            payload = pack(none, docs, sizes, ids)
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["segment", "n_ids", "payload"])

        for batch in batches:
            for part in slices(batch):
                ids, ends = encode(part.column("text"))
                if end:
                    ids = np.insert(ids, ends[1:], end[0])
                    ends = ends + np.arange(len(ends))
                docs = part.column("id")
                held.append((docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy(), np.diff(ends), ids))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield close()
                    held, size, segment = [], 0, segment + 1
        if held:
            yield close()

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # many rows of one id, or of none, are split by their texts
    ranged = source.repartitionByRange(n, F.col("id"), F.xxhash64("text")).sortWithinPartitions("id")
    segments = ranged.mapInArrow(run, "segment int, n_ids long, payload binary").withColumn("part", F.spark_partition_id())
    segments.write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of token files: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``.

    ``with_ids`` adds the ids themselves as ``ids``. The only broadcast is one row for each segment's
    partition: the ids before it.
    """
    kinds = "part int, segment int, n_ids long, payload binary"
    files = spark.read.schema(kinds).parquet(path)
    by_part = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n_ids"))
    each = by_part.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    # one row for each range partition of the writer
    base = each.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("segment")
    bases = by_part.withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids")).join(base, "part").select(F.col("part").alias("b_part"), F.col("segment").alias("b_segment"), (F.col("part_base") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, payload in zip(batch.column("part").to_pylist(), batch.column("segment").to_pylist(), batch.column("payload")):
                none, docs, sizes, ids = unpack(payload.as_buffer())
                ids, ends = ids.astype("<u4"), np.cumsum(sizes)
                begins = ends - sizes
                columns = [
                    pa.array(np.full(len(docs), part), pa.int32()), pa.array(np.full(len(docs), segment), pa.int32()), pa.array(docs, mask=none), pa.array(begins), pa.array(sizes),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                ]
                names = ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(np.append(begins, len(ids)), pa.int64()), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = files.mapInArrow(run, schema)
    joined = docs.join(bases, (F.col("part") == F.col("b_part")) & (F.col("segment") == F.col("b_segment")))
    return joined.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
