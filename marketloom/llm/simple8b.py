"""Simple-8b word-aligned coding of integer sequences with numpy.

Each 64-bit word has a 4-bit selector on top and 60 bits of payload. Selector k from 1 to 14
says how many ids of how many bits follow, ``MODES[k]``; of all modes that fit the next ids the
one that packs most is taken. Selector 15 is the escape: the word after it holds one id of more
than 60 bits. A sequence is cut into blocks of ``BLOCK`` ids that begin at a fresh word; the
index of each block's first word allows blocks to be decoded alone. All blocks are coded side by
side, a word of each at a time; decoding has no loop over words: words of one selector are
unpacked together.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: selector -> (ids in a word, bits of each).
MODES = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 15
BLOCK = 1 << 12

_COUNT = np.array([0] + [MODES[k][0] for k in range(1, 15)] + [1], np.int64)


#: Bits of small ids.
_WIDTH = np.array([max(1, i.bit_length()) for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    most = int(ids.max()) if len(ids) else 0
    if most < 1 << 16:
        return _WIDTH[ids]
    out = np.ones(len(ids), np.uint8)
    for b in range(1, most.bit_length()):
        out += ids >= np.uint64(1 << b)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block with the end appended) of any unsigned integers."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    ids = ids.astype(np.uint64)
    blocks = -(-n // BLOCK)
    bits = np.full(blocks * BLOCK, 255, np.uint8)  # past the end nothing fits
    bits[:n] = _bits(ids)
    bits = bits.reshape(blocks, BLOCK)
    selector = np.where(bits <= 60, np.uint8(14), np.uint8(ESCAPE))
    # widest[w][:, i]: the most bits among ids i .. i + w - 1 of a block, from narrower windows that overlap
    widest, wide = {1: bits}, 1
    for k in range(13, 0, -1):
        count, most = MODES[k]
        while wide < count:
            step = min(count - wide, wide)
            widest[wide + step] = np.maximum(widest[wide][:, : BLOCK - wide - step + 1], widest[wide][:, step : BLOCK - wide + 1])
            wide += step
        fits = widest[count] <= most
        selector[:, : fits.shape[1]][fits] = k
    jump, starts = _COUNT[selector.ravel()], np.zeros(blocks * BLOCK, bool)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        starts[at] = True
        at = at + jump[at]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    starts = np.flatnonzero(starts)
    chosen = selector.ravel()[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        if k == ESCAPE:
            continue
        count, most = MODES[int(k)]
        rows = np.flatnonzero(chosen == k)
        packed, first = words[rows], starts[rows]
        for j in range(count):
            packed |= ids[first + j] << np.uint64(j * most)
        words[rows] = packed
    escaped = chosen == ESCAPE
    sizes = np.bincount(starts // BLOCK, weights=1 + escaped, minlength=blocks)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.uint64)
    escaped = np.flatnonzero(escaped)
    return (np.insert(words, escaped + 1, ids[starts[escaped]]) if len(escaped) else words), offsets


def decode_block(words: np.ndarray) -> np.ndarray:
    """The ids of one or more whole blocks."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = None
    if (selector == ESCAPE).any():
        raw, keep, at, marks = [], np.ones(len(words), bool), 0, selector == ESCAPE
        for at in np.flatnonzero(marks):  # the word after an escape is no selector, whatever its top bits
            if keep[at]:
                keep[at + 1] = False
                raw.append(words[at + 1])
        words, selector = words[keep], selector[keep]
    counts = _COUNT[selector]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(selector):
        rows = np.flatnonzero(selector == k)
        if k == ESCAPE:
            out[first[rows]] = raw
            continue
        count, most = MODES[int(k)]
        mask = np.uint64((1 << most) - 1)
        for j in range(count):
            out[first[rows] + j] = (words[rows] >> np.uint64(j * most)) & mask
    return out


def decode(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids of successive blocks: ``words`` from the first of ``offsets`` to the last."""
    return decode_block(words[int(offsets[0]) : int(offsets[-1])])
