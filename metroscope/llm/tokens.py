"""Token ids of whole texts with a byte-level BPE file of the ``tokenizers`` library.

A text is cut at places where the pre-tokenizer always starts a new piece (a
white-space character between visible ones, ASCII punctuation after a Latin
letter or digit), so pieces can be encoded alone; each distinct piece is
encoded once per worker and the ids are laid out with NumPy.  The ids are those
of ``Tokenizer.encode(text, add_special_tokens=False)``.  With ``added`` texts
are first split at the file's added tokens, as the library does; without it
special-token strings are ordinary text (``encode_special_tokens``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from metroscope.llm.runtime import raw_text
from metroscope.llm.words import hash_spans

# the byte-level pre-tokenizer's split pattern (fixed by the vocabulary file's format)
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# distinct pieces a worker remembers; it starts anew beyond them
MEMORY = 2_000_000

_b = np.arange(256)
_SPACE = (_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D))
_GRAPH = (_b >= 0x21) & (_b <= 0x7E)
_ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A))
_PUNCT = _GRAPH & ~_ALNUM
_TWO = (_b >= 0xC3) & (_b <= 0xDF)  # lead bytes of two-byte characters without white space
_AFTER = _GRAPH | _TWO | ((_b >= 0xE4) & (_b <= 0xF4))
_LATIN = ((_b >= 0x80) & (_b <= 0xBF)) & (_b != 0x97) & (_b != 0xB7)  # after C3: letters


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def cut_points(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of every piece: text starts and the safe boundaries inside texts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.zeros(n, bool)
    before = np.zeros(n, bool)  # the character before is surely no white space
    before[1:] = _GRAPH[buf[:-1]]
    before[2:] |= _TWO[buf[:-2]]
    before[3:] |= buf[:-3] >= 0xE4
    cut[:-1] = _SPACE[buf[:-1]] & before[:-1] & _AFTER[buf[1:]]
    word = np.zeros(n, bool)
    word[1:] = _ALNUM[buf[:-1]]
    word[2:] |= (buf[:-2] == 0xC3) & _LATIN[buf[1:-1]]
    cut |= _PUNCT[buf] & word
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes blocks of texts; keeps the pieces it has seen in sorted arrays."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(path)
        self.model = whole.model
        tokens = whole.get_added_tokens_decoder() if added else {}
        if any(t.single_word or t.lstrip or t.rstrip for t in tokens.values()):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t.content: i for i, t in tokens.items()}
        # the longest token that starts at a place is taken
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if tokens else None
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        letters, tokenize, known, out = self.letters, self.model.tokenize, {}, []
        for piece in pieces:
            got = []
            for p in PIECES.findall(piece.decode("utf-8")):
                if p not in known:
                    known[p] = [t.id for t in tokenize("".join([letters[b] for b in p.encode("utf-8")]))]
                got += known[p]
            out.append(got)
        return out

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        new = self._encode(pieces)
        size = np.fromiter(map(len, new), np.int32, len(new))
        flat = np.fromiter((i for x in new for i in x), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used:self.used + len(flat)] = flat
        where = np.searchsorted(self.seen, h)
        self.at = np.insert(self.at, where, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.seen = np.insert(self.seen, where, h)
        self.used += len(flat)

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): each text's ids and then ``end_id``."""
        marked = set(self._marked(texts))
        if not marked:
            return self._parts(texts, end_id)
        # a marked text is encoded in parts; each but its last ends with the id of the added token after it
        parts, last, ends = [], [], []
        for i, t in enumerate(texts.to_pylist()):
            found = list(self.marks.finditer(t)) if i in marked else []
            parts += [t[a:b] for a, b in zip([0, *(m.end() for m in found)], [*(m.start() for m in found), len(t)])]
            ends += [*(self.added[m.group()] for m in found), end_id]
            last.append(len(parts))
        ids, off = self._parts(pa.array(parts, pa.large_string()), end_id)
        ids[off[1:] - 1] = ends
        return ids, off[[0, *last]]

    def _marked(self, texts: pa.StringArray) -> list[int]:
        """Numbers of the texts that hold an added token."""
        holds = [pc.match_substring(texts, t) for t in self.added]
        return sorted({i for h in holds for i in np.flatnonzero(h.to_numpy(zero_copy_only=False)).tolist()})

    def _parts(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without added tokens."""
        buf, off = raw_text(texts)
        n = len(off) - 1
        start = cut_points(buf, off)
        if not len(start):
            return np.full(n, end_id, np.uint32), np.arange(n + 1)
        end = np.append(start[1:], len(buf))
        h, first, back = np.unique(hash_spans(buf, start, end), return_index=True, return_inverse=True)
        if len(self.seen) + len(h) > MEMORY:
            self._forget()
        slot = np.searchsorted(self.seen, h)
        new = np.ones(len(h), bool) if not len(self.seen) else self.seen[np.minimum(slot, len(self.seen) - 1)] != h
        if new.any():
            at = first[new]
            raw = buf.tobytes()
            self._learn(h[new], [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
            slot = np.searchsorted(self.seen, h)
        size = self.size[slot][back].astype(np.int64)
        source = self.at[slot][back]
        # an end id follows the last piece of each text
        piece_of = np.searchsorted(start, off)  # first piece of each text
        total = np.concatenate([[0], np.cumsum(size)])
        doc_off = total[piece_of] + np.arange(n + 1)
        out = np.empty(int(total[-1]) + n, np.uint32)
        place = np.ones(len(out), bool)
        place[doc_off[1:] - 1] = False
        out[~place] = end_id
        out[place] = self.ids[np.repeat(source - total[:-1], size) + np.arange(total[-1])]
        return out, doc_off
