"""Words of many texts at once, as NumPy arrays over the Arrow byte buffer.

Three word classes are used: runs of bytes other than ASCII white space, and,
after lower-casing A-Z, runs of letters and non-ASCII characters with or
without digits.  All are decided byte by byte in UTF-8, so a whole block is split without a Python
loop.  A word is known by a 64-bit hash that consumes its bytes eight at a
time; words of up to eight bytes never collide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from metroscope.llm.runtime import raw_text

_byte = np.arange(256)
NOT_SPACE = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LETTERS = ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)

_CLASSES = {"space": NOT_SPACE, "alnum": ALNUM, "letters": LETTERS}

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` for every span; another ``seed`` gives another hash."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = (end - start).astype(np.int64)
    out = mix(length.astype(np.uint64), seed)
    live, at, left = np.arange(len(start)), start.astype(np.int64), length
    while len(live):
        keep = left > 0
        if not keep.all():
            live, at, left = live[keep], at[keep], left[keep]
            continue
        block = eight[at]
        short = left < 8
        block = np.where(short, block & ((np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), block)
        out[live] = mix(out[live] ^ block, 1)
        at, left = at + 8, left - 8
    return out


@dataclass
class Words:
    """Words of a block: byte spans in ``buf``; those of text i are ``first[i]:first[i+1]``."""
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that do not cross text boundaries."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    starts[head], ends[tail] = inside[head], inside[tail]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def split(texts: pa.StringArray, kind: str) -> Words:
    """Words of each text; ``kind`` is "space" (white-space words, unchanged), "alnum" or "letters" (both lower-cased)."""
    buf, off = raw_text(texts)
    if kind != "space":
        buf = LOWER[buf]
    start, end = _runs(_CLASSES[kind][buf], off)
    return Words(buf, start, end, np.searchsorted(start, off))


def windows(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive items (``len(h) - k + 1`` values).

    A polynomial in the item hashes, built by doubling, then mixed.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(mix(np.array([seed + 17], np.uint64))[0]) | 1
    with np.errstate(over="ignore"):
        acc, width, have, have_len = h, 1, None, 0  # acc: runs of `width`; have: runs of `have_len`
        bits = k
        while bits:
            if bits & 1:
                if have is None:
                    have, have_len = acc, width
                else:  # have run, then acc run
                    m = len(h) - have_len - width + 1
                    have = have[:m] * np.uint64(pow(base, width, 1 << 64)) + acc[have_len:have_len + m]
                    have_len += width
            bits >>= 1
            if bits:
                m = len(h) - 2 * width + 1
                if m <= 0:
                    m = 0
                acc = acc[:m] * np.uint64(pow(base, width, 1 << 64)) + acc[width:width + m]
                width *= 2
    return mix(have[:n], seed)


def inside_text(w: Words, k: int) -> np.ndarray:
    """Word positions at which a run of ``k`` words stays in its text (index into windows())."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    last = np.repeat(w.first[1:], w.counts)[:n]  # one past the text's last word
    return np.flatnonzero(np.arange(n) + k <= last)
