"""Token ids of whole texts, with a per-worker cache of words.

Both vocabularies used here split a text into words before merging, and merge inside
words only. A word is therefore encoded once by the ``tokenizers`` library and looked
up afterwards. Texts with characters beyond Latin Extended-A, rare controls or
non-breaking blanks, where normalisation and word classes need the library's own
tables, and texts that may hold an added token (``<|endoftext|>``) are encoded by the library as a whole.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
#: Texts made of these only have the same words here as in the library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*")
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d|"
_WORDS = {
    "word": re.compile(f"{_SUFFIX}[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+"),
    "byte": re.compile(f"{_SUFFIX} ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+"),
}
#: Words kept in a worker at most, and how many of them stay when there are more: those used most.
CACHE_WORDS, KEPT_WORDS = 150_000, 50_000
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _symbols(word: str) -> str:
    """A word in the byte-level alphabet, as the model takes it."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", "\u0120")
    return word.encode().decode("latin-1").translate(_ALPHABET)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs of these lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])


#: Stands for the end of a text among words; no word holds this character.
_STOP = "\0end"


class _Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code


class Encoder:
    """Encodes lists of texts; one per Python worker and vocabulary."""

    _open: dict = {}

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What all added tokens begin with, up to the first letter: texts with it go to the library whole.
        self.added = re.match("[^A-Za-z]*", commonprefix(added))[0] if added else None
        self.words, self.lower = _WORDS[kind], kind == "word"
        self._clear()

    @classmethod
    def get(cls, path: str, kind: str) -> "Encoder":
        if (path, kind) not in cls._open:
            cls._open[path, kind] = cls(path, kind)
        return cls._open[path, kind]

    def _clear(self) -> None:
        self.codes, self.known = _Codes(), 0
        self.lengths, self.ids, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the words used most, the end mark among them in its place; older uses count half."""
        self.uses[0] = self.uses.max()
        stay = np.sort(np.argsort(-self.uses, kind="stable")[:KEPT_WORDS])
        words = list(self.codes)
        self.codes, self.known = _Codes(zip(map(words.__getitem__, stay.tolist()), range(len(stay)))), len(stay)
        self.ids = self.ids[_runs((np.cumsum(self.lengths) - self.lengths)[stay], self.lengths[stay])]
        self.lengths, self.uses = self.lengths[stay], self.uses[stay] >> 1

    def _learn(self, words: list[str]) -> None:
        """Let the library's model merge words that were not seen before."""
        found = [[x.id for x in merged] for merged in map(self.tokenizer.model.tokenize, map(_symbols, words))]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.known += len(words)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text followed by ``end``, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.known > CACHE_WORDS:
            self._shrink()
        look, split = self.codes.__getitem__, self.words.findall
        look(_STOP)
        per_text, whole = [], {}
        for k, text in enumerate(texts):
            if _PLAIN.fullmatch(text) and (self.added is None or self.added not in text):
                words = split(text.lower() if self.lower else text)
            else:
                whole[k] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end], np.int32)
                words = []
            words.append(_STOP)
            per_text.append(np.fromiter(map(look, words), np.int64, len(words)))
        if self.known == 0:  # code 0 is the end mark
            self.lengths, self.ids, self.uses, self.known = np.ones(1, np.int64), np.array([end], np.int32), np.zeros(1, np.int64), 1
        if len(self.codes) > self.known:
            self._learn(list(islice(self.codes, self.known, None)))
        codes = np.concatenate(per_text)
        self.uses += np.bincount(codes, minlength=self.known)
        n = self.lengths[codes]
        ids = self.ids[_runs((np.cumsum(self.lengths) - self.lengths)[codes], n)]
        ends = np.cumsum(n)[np.cumsum(np.fromiter(map(len, per_text), np.int64, len(texts))) - 1]
        counts = np.diff(ends, prepend=0)
        if whole:
            parts = np.split(ids, ends[:-1])
            for k, found in whole.items():
                parts[k], counts[k] = found, len(found)
            ids = np.concatenate(parts)
        return ids, counts


def crc32_of(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids (little-endian, 32 bits); ``ends``: where runs end."""
    raw, out, a = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.empty(len(ends), np.int64), 0
    for k, b in enumerate(ends.tolist()):
        out[k] = zlib.crc32(raw[4 * a : 4 * b])
        a = b
    return out


def in_chunks(texts: list[str], most: int = 1_000_000):
    """Ranges of texts of about ``most`` characters, at least one text each, so that memory stays bounded; Arrow's free memory goes back at the end."""
    a = size = 0
    for b, text in enumerate(texts):
        if size and size + len(text) > most:
            yield a, b
            a, size = b, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)
    pa.default_memory_pool().release_unused()


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))
