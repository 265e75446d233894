"""Token counts by the whole-token shortcut.

A word-piece vocabulary is examined once ("offline", before any text is read):

* Two neighbouring characters that no vocabulary string holds side by side can never be merged,
  so a text may be cut there without changing its tokens. This gives a table of safe cuts.
* Every vocabulary string that the tokenizer, given it alone, returns as exactly one token is put
  into a table of whole tokens.

Texts are cut at the safe places; pre-tokens found in the table count one, and only the rest go
through the tokenizer's merges, each distinct one of a slice of rows once.

Cases: null and empty text have 0 tokens. Very long texts are counted whole. Any text is allowed:
where no cut is safe, longer pre-tokens are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import pre_tokens, slices, text_bytes, tidy

#: Distinct merged pre-tokens that one Python worker remembers; a bound on memory, not on results.
REMEMBERED = 400_000
#: Text that is cut and looked up at once.
COUNT_BYTES = 1 << 20


class PieceCounter:
    """Counts tokens of a sentencepiece BPE model without begin and end tokens."""

    def __init__(self, model_file: str):
        import numpy as np
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model, mark = self.model, "▁"
        sample = "A\u00e9e\u0301  b\n\u2460 "
        if model.normalize(sample) != mark + sample.replace(" ", mark):
            raise ValueError("this model normalises its text; the shortcut does not hold for it")
        plain = [p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)]]
        #: cut[a, b]: no vocabulary string has a character that ends in byte a before one that begins with byte b.
        self.cut = np.ones((256, 256), bool)
        for piece in plain:
            chars = [c.encode() for c in piece.replace(mark, " ")]
            for x, y in zip(chars, chars[1:]):
                self.cut[x[-1], y[0]] = False
        self.cut[:, 0x80:0xC0] = False  # inside a character
        written = mark.encode()  # the mark itself in a text means a space
        self.cut[written[-1], :] = False
        self.cut[:, written[0]] = False
        self.first = len(model.encode("\n"))
        words = [p.replace(mark, " ") for p in plain]
        spaced, headed = [w[1:] for w in words if w[0] == " "], [w for w in words if w[0] != " "]
        self.known = {
            True: {w: 1 for w, n in zip(spaced, self._merge(spaced, True)) if n == 1},
            False: {w: 1 for w, n in zip(headed, self._merge(headed, False)) if n == 1},
        }
        self.whole = {k: len(v) for k, v in self.known.items()}

    def _merge(self, words: list[str], spaced: bool) -> list[int]:
        """Token counts of pre-tokens by the tokenizer. spaced: each follows a space, which the model adds."""
        if spaced:
            only = [w.strip(" ") == "" for w in words]
            out = [len(x) for x in self.model.encode(words, num_threads=1)]
            for i in (i for i, x in enumerate(only) if x):
                out[i] = len(self.model.encode("\n " + words[i])) - self.first
            return out
        return [len(x) - self.first for x in self.model.encode(["\n" + w for w in words], num_threads=1)]

    def _lookup(self, words: list[str], spaced: bool) -> list[int]:
        known = self.known[spaced]
        found = [known.get(w, -1) for w in words]
        todo = [i for i, n in enumerate(found) if n < 0]
        if todo:
            rest = [words[i] for i in todo]
            for i, w, n in zip(todo, rest, self._merge(rest, spaced)):
                found[i] = n
                if len(known) < REMEMBERED and len(w) < 40:
                    known[w] = n
        return found

    def count(self, texts: pa.Array) -> "numpy.ndarray":  # noqa: F821
        import numpy as np
        import pyarrow.compute as pc

        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = self.cut[data[:-1], data[1:]]
        words, starts, first = pre_tokens(data, offsets, cut)
        coded = words.dictionary_encode()
        codes, distinct = np.asarray(coded.indices), coded.dictionary
        blank = data[starts] == 0x20
        opening = np.zeros(len(starts), bool)
        opening[first[:-1][np.diff(offsets) > 0]] = True  # the model adds a space before a text
        counts = np.zeros(len(starts), np.int64)
        for spaced, at in ((True, np.flatnonzero(blank & ~opening)), (False, np.flatnonzero(~blank & ~opening)), (True, np.flatnonzero(opening))):
            used = np.unique(codes[at])
            asked = distinct.take(pa.array(used))
            if len(at) and blank[at[0]] and not opening[at[0]]:
                asked = pc.utf8_slice_codeunits(asked, 1)
            table = np.zeros(len(distinct), np.int64)
            table[used] = self._lookup(asked.to_pylist(), spaced)
            counts[at] = table[codes[at]]
        total = np.concatenate(([0], np.cumsum(counts)))
        return total[first[1:]] - total[first[:-1]]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """One counter for each model and Python worker."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def count_tokens(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row; one scan, no shuffle.

    Null and empty text: 0 bytes, 0 tokens. Repeated rows stay. Other columns are left out,
    so clashing names cannot disturb.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counts = counter(model_file)
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                text = part.column("text")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), pa.array(counts.count(text), pa.int64())],
                    ["id", "n_bytes", "n_tokens"],
                )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
