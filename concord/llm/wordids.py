"""Token ids of texts from the ids of their words, each word encoded once while it keeps coming back.

A tokenizer that never joins text across certain places gives the same ids for a text and for its words between those
places. A task numbers the words that it meets and keeps their ids end to end in one array, up to a limit; words beyond it
are encoded with the texts they are in and forgotten again. A worker hands its memory on to the next task of the same
vocabulary.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers: about 170 bytes each. Once half of them are taken, only words that come again are added.
MEMO_WORDS, SEEN_SLOTS = 800_000, 1 << 21
#: Texts that are encoded together hold about so many characters; a longer text is encoded alone.
TEXT_AT_ONCE = 1 << 21
#: A word longer than this is never remembered.
LONG_WORD = 64

#: Letters that stay single letters under composition and lower case (U+0130 does not), and marks no letter joins.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
MARKS = r"!-/:-@\[-`{-~"

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a vocabulary file, for which special tokens written in a text are ordinary text."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


class SpacedWords:
    """Words of a vocabulary that drops white space, ends every word, and ignores case.

    Letters and the run of ASCII marks behind them are encoded apart: the vocabulary's pieces don't cross from one to the
    other, and with these letters normalisation doesn't either.
    """

    _PARTS = re.compile(f"([{LETTERS}]+)([{MARKS}]+)").fullmatch

    def cut(self, texts: list[str]) -> pa.Array:
        """The words of each text; an empty word at an end of a text has no ids."""
        return pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))

    def text(self, word: str) -> str:
        return word

    def parts(self, word: str) -> tuple[str, str]:
        found = self._PARTS(word)
        core, marks = found.groups() if found else (word, "")
        return (core.lower() if core.isascii() and core.isalpha() else core), marks


class LedWords:
    """Words of a byte-level vocabulary, whose pieces take white space at most at their beginning.

    Between anything else and white space there is always a cut, and one between letters and the marks behind them.
    Most words follow a single space, which is left out of their name; the name of a word without it begins with two line
    ends, or is the text itself where that begins with one line end.
    """

    _MIXED = re.compile(r"\s[ \n]").search
    _CUT = re.compile(r"(?<=\S)(?=[ \n])")
    _PARTS = re.compile(f"((?:\n\n|\n)?[{LETTERS}]+)([{MARKS}]+)").fullmatch

    def cut(self, texts: list[str]) -> pa.Array:
        """The names of the words of each text."""
        mixed = [i for i, text in enumerate(texts) if self._MIXED(text)]
        plain = [f"\n\n{text.replace('\n', ' \n')}" for text in texts]
        for i in mixed:
            plain[i] = ""
        words = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        if not mixed:
            return words
        odd = pa.array([[self._name(x) for x in self._CUT.split(texts[i])] for i in mixed], words.type)
        places = np.arange(len(texts))
        places[mixed] = len(texts) + np.arange(len(mixed))
        return pa.concat_arrays([words, odd]).take(pa.array(places))

    def _name(self, text: str) -> str:
        if text[:1] == " " and text[1:2] not in (" ", "\n"):
            return text[1:]
        return text if text[:1] == "\n" and text[1:2] != "\n" else f"\n\n{text}"

    def text(self, word: str) -> str:
        if word[:2] == "\n\n":
            return word[2:]
        return word if word[:1] == "\n" else f" {word}"

    def parts(self, word: str) -> tuple[str, str]:
        found = self._PARTS(word)
        return (found[1], f"\n\n{found[2]}") if found else (word, "")


class _Numbers(dict):
    """Numbers words in the order in which they are first looked up."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of texts, as numpy arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str, rule: SpacedWords | LedWords, limit: int = MEMO_WORDS, at_once: int = TEXT_AT_ONCE):
        self.encode_batch = tokenizer(path).encode_batch_fast
        self.rule = rule
        self.limit = limit
        self.at_once = at_once
        self.numbers = _Numbers()
        self.seen = bytearray(SEEN_SLOTS)
        #: Ids of all numbered words end to end, and where each word begins (one entry more than words).
        self.ids = np.empty(1 << 16, dtype="<u4")
        self.begins = np.zeros(1 << 14, dtype=np.int64)

    def _append(self, first: int, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Adds the ids of words numbered from ``first`` on."""
        last = first + len(lengths)
        start = int(self.begins[first])
        while len(self.begins) <= last:
            self.begins = np.concatenate((self.begins, np.zeros_like(self.begins)))
        self.begins[first + 1 : last + 1] = start + np.cumsum(lengths)
        while len(self.ids) < start + len(ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[start : start + len(ids)] = ids

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each word has."""
        begins = self.begins[numbers]
        lengths = self.begins[numbers + 1] - begins
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(begins - ends + lengths, lengths) + np.arange(total)], lengths

    def _learn(self, words: list[str]) -> list[str]:
        """Ids of words just numbered: whole words, or the ids of their parts put together. Returns all words added."""
        numbers = self.numbers
        first = len(numbers) - len(words)
        parts = [self.rule.parts(word) for word in words]
        numbers.new = []
        # Numbers the parts too: they are words of their own, and often seen again.
        each = (x for core, rest in parts for x in ((core, rest) if rest else (core,)))
        at = np.fromiter(map(numbers.__getitem__, each), dtype=np.int64)
        counts = np.fromiter((1 + bool(rest) for _, rest in parts), dtype=np.int64, count=len(parts))
        plain, numbers.new = numbers.new, []
        # A word that is its own part is encoded in its place, then the parts that were new.
        own = [i for i, (word, (core, rest)) in enumerate(zip(words, parts)) if core == word and not rest]
        wanted = [words[i] for i in own] + plain
        lengths = np.empty(len(wanted), dtype=np.int64)
        ids: list[list[int]] = []
        for start in range(0, len(wanted), 4096):
            some = self.encode_batch([*map(self.rule.text, wanted[start : start + 4096])], add_special_tokens=False)
            ids.extend(e.ids for e in some)
        lengths[:] = [len(x) for x in ids]
        flat = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(lengths.sum()))
        # The encoded words stand behind the numbered ones for a moment, and parts are looked up there.
        end = len(numbers)
        begins = np.concatenate(([0], np.cumsum(lengths)))
        place = np.full(end - first, -1, dtype=np.int64)
        place[own] = np.arange(len(own))
        place[len(words) :] = np.arange(len(own), len(wanted))
        fresh = at >= first
        source = np.where(fresh, place[np.where(fresh, at - first, 0)], 0)
        known = np.where(fresh, 0, at)
        part_begin = np.where(fresh, begins[source], self.begins[known])
        part_length = np.where(fresh, begins[source + 1] - begins[source], self.begins[known + 1] - self.begins[known])
        of_word = np.repeat(np.arange(len(words)), counts)
        word_length = np.bincount(of_word, weights=part_length, minlength=len(words)).astype(np.int64)
        ends = np.cumsum(part_length)
        total = int(ends[-1]) if len(ends) else 0
        spot = np.repeat(part_begin - ends + part_length, part_length) + np.arange(total)
        from_new = np.repeat(fresh, part_length)
        whole = np.empty(total, dtype="<u4")
        whole[from_new] = flat[spot[from_new]]
        whole[~from_new] = self.ids[spot[~from_new]]
        rest = slice(int(begins[len(own)]), None)
        self._append(first, np.concatenate((word_length, lengths[len(own) :])), np.concatenate((whole, flat[rest])))
        return words + plain

    def _forget(self, first: int, added: list[str]) -> None:
        """Keeps of the words numbered from ``first`` on those that there is room for."""
        if len(self.numbers) <= self.limit // 2:
            return
        seen, last, stay = self.seen, SEEN_SLOTS - 1, []
        room = self.limit - first
        for number, word in enumerate(added, first):
            at = hash(word) & last
            if seen[at] and len(stay) < room and len(word) <= LONG_WORD:
                stay.append(number)
            else:
                seen[at] = 1
            del self.numbers[word]
        kept = np.array(stay, dtype=np.int64)
        ids, lengths = self._gather(kept)
        for number in stay:
            self.numbers[added[number - first]] = len(self.numbers)
        self._append(first, lengths, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts together."""
        split = self.rule.cut(texts)
        # Equal words are found in compiled code, and each one is looked up once.
        coded = split.flatten().dictionary_encode()
        numbers = self.numbers
        first = len(numbers)
        found = np.fromiter(map(numbers.__getitem__, coded.dictionary.to_pylist()), dtype=np.int64)
        new, numbers.new = numbers.new, []
        if new:
            new = self._learn(new)
        ids, lengths = self._gather(found[coded.indices.to_numpy()])
        words = np.cumsum(pc.list_value_length(split).to_numpy())
        ends = np.concatenate(([0], np.cumsum(lengths)))[words]
        if new:
            self._forget(first, new)
        return np.split(ids, ends[:-1])

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of any number of texts, taken by size."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= self.at_once or len(some) >= 4096:
                yield from self.encode(some)
                some, size = [], 0
        if some:
            yield from self.encode(some)


_MEMORY: dict[tuple, WordIds] = {}


def word_ids(path: str, rule: SpacedWords | LedWords, limit: int = MEMO_WORDS, at_once: int = TEXT_AT_ONCE) -> WordIds:
    """The memory of this worker for one vocabulary; that of another one is given up."""
    key = (path, type(rule), limit, at_once)
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = WordIds(path, rule, limit, at_once)
    return _MEMORY[key]


def release() -> None:
    """Gives up the memory of this worker, for tasks that need the room for something else."""
    _MEMORY.clear()
    _TOKENIZERS.clear()
