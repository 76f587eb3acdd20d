"""Token ids of a word-level BPE file, computed once per distinct word of a worker.

The vocabulary splits a text into runs of letters, single digits and runs of
other marks before merging, so ids depend on the word alone. Words are cut and
hashed with numpy over a whole batch; only words not seen before go through the
tokenizer's own merge step. Texts with characters outside the checked range, an
apostrophe (contractions cut words differently) or a special token's string are
given to the tokenizer as they are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from shroud.llm import textscan as ts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words a worker remembers (about 25 bytes each); later new words are merged per batch.
CACHE_WORDS = 4_000_000
_LETTER, _DIGIT, _MARK, _SPACE, _ODD = range(5)
_RANGE = 0x180


def _char_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point below _RANGE."""
    kind, lower = np.full(_RANGE + 1, _ODD, np.uint8), np.arange(_RANGE + 1, dtype=np.uint32)
    for c in range(_RANGE):
        ch = chr(c)
        if len(ch.lower()) != 1 or ord(ch.lower()) >= _RANGE or ch == "'":
            continue
        lower[c] = ord(ch.lower())
        if ch.isalpha():
            kind[c] = _LETTER
        elif "0" <= ch <= "9":
            kind[c] = _DIGIT
        elif ch in " \t\n\r":
            kind[c] = _SPACE
        elif 0x20 < c < 0x7F:
            kind[c] = _MARK
    return kind, lower


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.kind, self.lower = _char_classes()
        self.alphabet = _byte_alphabet()
        self.keys = np.empty(0, np.uint64)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut, table = self.model.tokenize, self.alphabet
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(table) for w in words]
        found = [[t.id for t in cut(w)] for w in spelled]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return length, np.fromiter((i for x in found for i in x), np.uint32, int(length.sum()))

    def _lookup(self, key: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, ids) of distinct sorted keys; word(i) gives the text of key i."""
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        new = np.flatnonzero(~known)
        length, ids = self._merge([word(i) for i in new.tolist()])
        begin = np.cumsum(length) - length + len(self.ids)
        start, size = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        start[known], size[known] = self.start[at[known]], self.length[at[known]]
        start[new], size[new] = begin, length
        every = np.concatenate([self.ids, ids]) if len(new) else self.ids
        if len(new) and len(self.keys) + len(new) <= CACHE_WORDS:
            self.keys = np.insert(self.keys, at[new], key[new])
            self.start = np.insert(self.start, at[new], begin)
            self.length = np.insert(self.length, at[new], length)
            self.ids = every
        return start, size, every

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts whose characters are all in the checked range."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        off = np.concatenate([[0], np.cumsum(size)])
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        code = self.lower[code]
        kind = np.append(self.kind[code], np.uint8(_SPACE))
        before = np.concatenate([[np.uint8(_SPACE)], kind[:-1]])
        edge = (kind != before) | (kind == _DIGIT)
        edge[off] = True
        cuts = np.flatnonzero(edge)
        cuts = cuts[cuts < len(code)]
        ends = np.append(cuts[1:], len(code))
        keep = kind[cuts] != _SPACE
        cuts, ends = cuts[keep], ends[keep]
        prefix = ts.prefix_hash(code.astype(np.uint64) + np.uint64(1))
        h = ts.span_hash(prefix, cuts, ends)
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        text = code.tobytes().decode("utf-32-le")
        begin, end = cuts[first].tolist(), ends[first].tolist()
        start, length, every = self._lookup(key, lambda i: text[begin[i] : end[i]])
        start, length = start[back], length[back]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = every[np.repeat(start - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(cuts, off)]

    def encode(self, texts: list[str], max_chars: int = 300_000) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= max_chars):
                chars += len(texts[hi])
                hi += 1
            yield from self._encode(texts[lo:hi])
            lo = hi

    def _is_plain(self, text: str) -> bool:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return not (self.kind[np.minimum(code, _RANGE)] == _ODD).any() and not any(s in text for s in self.special)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [self._is_plain(t) for t in texts]
        ids, bounds = self._plain([t for t, p in zip(texts, plain, strict=True) if p])
        at = 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                yield ids[bounds[at] : bounds[at + 1]]
                at += 1
            else:
                yield np.asarray(self.full.encode(t, add_special_tokens=False).ids, np.uint32)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
