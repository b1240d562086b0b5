"""Tokenizer helpers for use inside tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex


#: Words of these letters take the short way, as their lower case is one of them, too; any other word goes through the whole tokenizer.
_LETTERS = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
LATIN = re.escape("".join(c for c in _LETTERS if c.lower() in _LETTERS))


def _byte_letters() -> dict[int, str]:
    """For each Latin letter, its UTF-8 bytes in the alphabet that byte-level vocabularies print bytes with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x21, 0x250)}


class _Table(dict):
    """Strings to numbers, and for each number a list of ids; a string not seen before gets the next number and waits in `new`."""

    def __init__(self, *first: str):
        super().__init__(zip(first, range(len(first)), strict=True))
        self.first, self.new = first, list(first)
        self.start, self.count, self.met = (np.zeros(1024, np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, where: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Lists of n ids each for the numbers given."""
        self.start, self.count, self.met = (self._room(a, len(self)) for a in (self.start, self.count, self.met))
        self.count[where] = n
        self.start[where] = self.used + np.cumsum(n) - n
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def flat(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these numbers in order, and how many each has."""
        n = self.count[codes]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.start[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    def meet(self, codes: np.ndarray, times: np.ndarray | None = None) -> None:
        n = np.bincount(codes, times).astype(np.int64)
        self.met[: len(n)] += n

    def often(self, most: int) -> _Table:
        """A table of the strings met more than once, or an empty one if these are over half of `most`. They must be met again to stay once more."""
        kept = np.flatnonzero(self.met[: len(self)] > 1)
        kept = kept[kept >= len(self.first)] if 2 * len(kept) <= most else kept[:0]
        words, out = list(self), _Table(*self.first)
        kept = np.concatenate([np.arange(len(self.first)), kept])
        out.update(zip(map(words.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        ids, n = self.flat(kept)
        out.new = []
        out.add(np.arange(len(kept)), n, ids)
        out.met[: len(kept)] = 1
        return out


class WordEncoder:
    """Whole-text ids of a tokenizer whose tokens never cross white space, from a table of words.

    It is for a lower-casing byte-level BPE that drops white space. The texts are cut at spaces and
    line ends, and each word is encoded once. New Latin words are lower-cased and cut together by the tokenizer's
    own pattern, and their parts go to the tokenizer's BPE model, each part once; other words go through the whole
    tokenizer. A full table (of `most` words, or twice as many parts, which cost more)
    keeps what was met several times, so memory stays bounded.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # The model alone, over parts in lines.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        pattern = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(f"\n|{pattern}")
        self.bytes = _byte_letters()
        self.odd = re.compile("|".join([f"[^{LATIN}\n]", *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())]))
        # The line end between two words is the part 0, without ids.
        self.codes, self.parts = _Table(), _Table("\n")
        self.parts.add(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32))
        self.parts.new = []

    def _parts_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of Latin words, and the number of ids of each."""
        found = self.pattern.findall("\n".join(words).lower())
        codes = np.fromiter(map(self.parts.__getitem__, found), np.int64, len(found))
        if new := self.parts.new:
            self.parts.new = []
            out = self.model.encode("\n".join(new).translate(self.bytes), add_special_tokens=False)
            n = np.bincount(np.array(out.word_ids, np.int64), minlength=len(new))
            self.parts.add(np.arange(len(self.parts) - len(new), len(self.parts)), n, np.array(out.ids, np.uint32))
        self.parts.meet(codes)
        ids, n = self.parts.flat(codes)
        sizes = np.bincount(np.cumsum(codes == 0), n, len(words)).astype(np.int64)
        if len(self.parts) > 2 * self.most:
            self.parts = self.parts.often(2 * self.most)
        return ids, sizes

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        at = len(self.codes) - len(new)
        lines = "\n".join(new)
        ends, plain = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1), np.ones(len(new), bool)
        plain[np.searchsorted(ends, [m.start() for m in self.odd.finditer(lines)], "right")] = False
        for short in (True, False):
            where = np.flatnonzero(plain == short)
            if not len(where):
                continue
            words = [new[i] for i in where.tolist()]
            if short:
                ids, n = self._parts_of(words)
            else:
                found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
                n = np.fromiter(map(len, found), np.int64, len(found))
                ids = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
            self.codes.add(at + where, n, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if len(self.codes) > self.most:
            self.codes = self.codes.often(self.most)
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        sizes = np.diff(split.offsets.to_numpy())
        words = split.flatten().dictionary_encode()
        own = words.dictionary.to_pylist()
        codes = np.fromiter(map(self.codes.__getitem__, own), np.int64, len(own))
        if self.codes.new:
            self._learn()
        places = words.indices.to_numpy()
        self.codes.meet(codes, np.bincount(places, minlength=len(own)))
        ids, n = self.codes.flat(codes[places])
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(ends)


def in_chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, at least one text each."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; its words are bounded, and forget() lets them go."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Lets a worker's encoders go: for steps that need the memory themselves and run in the same workers."""
    _ENCODERS.clear()
