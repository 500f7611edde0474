"""Subword encoding by a public tokenizer, with a bounded table of pieces already encoded.

The tokenizer never joins across white space, and it always parts a letter or digit from
punctuation that follows (other than an apostrophe); so a text's ids are those of the pieces between
such places, end to end.  It lower-cases, so pieces that differ in the case of A-Z are one.

Pieces are cut, hashed and looked up by numpy for a whole batch.  The table has a fixed number of
slots, each of which keeps the first piece that came to it; other pieces are encoded once a batch.
Runs of lower-case letters among them are encoded in one call: each ends with an id that marks the
end of a word, and is cut there.
"""

from __future__ import annotations

import os

import numpy as np

from .common import _LOWER, _SEPARATOR, ragged, utf8, word_hashes

#: Slots of the table of one Python worker (16 bytes each, and the ids of their pieces).
TABLE_BITS = 22
#: Pieces that go to the tokenizer at once; it needs about 1 KB for each.
NEW_AT_ONCE = 16384
#: The tokenizer's file, among the public ones.
VOCABULARY = "word_bpe_49k.json"
#: Punctuation before which a piece may be cut.
CLOSING = b".,;:!?|*$%&#"

_CLOSING = np.zeros(256, bool)
_CLOSING[list(CLOSING)] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of U+00C0 to U+00FF that are letters
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each piece, and the number of each text's first (one more than texts)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~_SEPARATOR[raw]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    new[1:n] = ~inside[:-1]
    mark = np.flatnonzero(_CLOSING[raw[1:]]) + 1
    before = raw[mark - 1]
    letter = _ALNUM[before] | (_LATIN[before] & (raw[np.maximum(mark - 2, 0)] == 0xC3) & (mark > 1))
    new[mark[letter]] = True
    new[at[:-1]] = True
    starts = np.flatnonzero(inside & new[:n])
    ends = np.flatnonzero(inside & (new[1:] | np.append(~inside[1:], True))) + 1
    return starts, ends, np.searchsorted(starts, at)


class Encoder:
    """Ids of texts as numpy arrays of the given type."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for runs of lower-case letters between spaces.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.dtype = np.dtype(dtype)
        self.key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.start = np.zeros(1 << TABLE_BITS, np.int32)
        self.size = np.zeros(1 << TABLE_BITS, np.int32)
        self.held = np.zeros(1 << 16, self.dtype)  # of which the first are used
        self.used = 0

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], self.dtype), np.array([len(x) for x in ids], np.int64)

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.letters.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        # One end a run, or the vocabulary isn't of this kind.
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(runs) else self._each(runs)

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has."""
        run = np.array([_is_run(p) for p in pieces], bool)
        size = np.zeros(len(pieces), np.int64)
        parts = {}
        for kind, encode in ((True, self._runs), (False, self._each)):
            own = np.flatnonzero(run == kind)
            if len(own):
                ids, n = encode([pieces[i] for i in own])
                size[own] = n
                parts[kind] = (own, ids, np.cumsum(n) - n)
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), self.dtype)
        for own, ids, _ in parts.values():
            n = size[own]
            out[np.repeat(begin[own], n) + ragged(n)] = ids
        return out, size

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts end to end, and how many each text has; null is empty."""
        raw, at = utf8(column)
        data = raw.tobytes()
        if b"<|" in data:  # may be a special token, whose name has a case
            return self._each([data[a:b].decode() for a, b in zip(at[:-1], at[1:])])
        starts, ends, first = cut(raw, at)
        h = word_hashes(raw, starts, ends) | np.uint64(1)  # 0 marks an empty slot
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        known = self.key[slot] == h
        size, start = self.size[slot].astype(np.int64), self.start[slot].astype(np.int64)
        if not known.all():
            where = np.flatnonzero(~known)
            fresh, i, back = np.unique(h[where], return_index=True, return_inverse=True)
            low = _LOWER[raw].tobytes()
            parts = []
            for lo in range(0, len(i), NEW_AT_ONCE):
                parts.append(self._new([low[starts[j] : ends[j]].decode() for j in where[i[lo : lo + NEW_AT_ONCE]].tolist()]))
            ids, n = (np.concatenate(c) for c in zip(*parts))
            begin = np.cumsum(n) - n
            size[where], start[where] = n[back], self.used + begin[back]
            self._put(ids)
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - total[:-1], size)
        at += np.arange(len(at))
        out = self.held.take(at)
        if not known.all():
            self._keep(fresh, ids, begin, n)
        return out, np.diff(total[first])

    def _put(self, ids: np.ndarray) -> None:
        """Write ids after those used."""
        if self.used + len(ids) > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.empty(self.used + 2 * len(ids), self.dtype)])
        self.held[self.used : self.used + len(ids)] = ids

    def _keep(self, h: np.ndarray, ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        """Put pieces in slots that are free; the first of each slot."""
        slot, i = np.unique((h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), return_index=True)
        free = self.key[slot] == 0
        slot, i = slot[free], i[free]
        if len(i):
            size = n[i]
            self.key[slot], self.size[slot] = h[i], size
            self.start[slot] = self.used + np.cumsum(size) - size
            kept = ids[np.repeat(begin[i], size) + ragged(size)]
            self._put(kept)
            self.used += len(kept)


def _is_run(piece: str) -> bool:
    """Lower-case letters below U+0240 only: nothing to normalize."""
    if piece.isascii():
        return piece.isalpha()
    return piece.isalpha() and piece == piece.lower() and max(piece) < "ɀ"


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """The worker's encoder for this file; its table lasts as long as the worker."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]
