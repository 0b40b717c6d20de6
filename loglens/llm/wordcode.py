"""Exact word-by-word encoding for tokenizers that drop white space.

The tokenizer ``word_bpe_49k.json`` normalises (NFC, lower case), cuts the text at every white space
and drops it.  Nothing before the cut can change what follows it, so a text's ids are the ids of
its words, one after the other.  Words repeat, so each worker keeps a bounded table from a word's
bytes to its ids.  Words are cut at ASCII white space only; any other white space stays
inside a "word" and is left to the library.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from itertools import chain, islice

import numpy as np

#: Words longer than this are encoded each time and not kept.
LONGEST_KEPT = 256

_SPECIAL_START = "<|"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_ODD = re.compile(r"[^!-~À-ÖØ-öø-ÿ\n]|<\|")
_LINES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the 256 bytes (a public convention):
    printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


class WordCoder:
    """Ids of a text, word by word; ``render`` turns a word's ids into what is kept for it."""

    def __init__(self, path: str, render=bytes, max_words: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        steps = [p.get("type") for p in (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        split = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if steps[:1] != ["Split"] or not split.get("invert") or split.get("behavior") != "Removed":
            raise ValueError(f"{path}: not a tokenizer that drops white space between words")
        norm = [n.get("type") for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        self._known = norm == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._model = self.tokenizer.model
        self._letters = str.maketrans(_byte_letters())
        self._render = render
        self._max = max_words
        self._words: dict = {}
        self._pieces: dict = {}
        self._forget_pieces()

    def clear(self) -> None:
        self._words.clear()
        self._pieces.clear()
        self._forget_pieces()

    def _encoded(self, piece: str) -> list:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(shown)]

    def _piece(self, piece: str) -> tuple:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = tuple(self._encoded(piece))
            if len(piece) <= LONGEST_KEPT:
                if len(self._pieces) >= self._max:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def ids(self, word: str) -> tuple:
        """Ids of one word (or of any text)."""
        if self._known and _PLAIN.fullmatch(word) and _SPECIAL_START not in word:
            pieces = _PIECES.findall(word.lower())
            if len(pieces) == 1:
                return self._piece(pieces[0])
            out: list = []
            for p in pieces:
                out.extend(self._piece(p))
            return tuple(out)
        return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def ids_of(self, words: list[bytes]) -> list[tuple]:
        """Ids of many distinct words."""
        lengths, flat = self.flat_ids(words)
        ends, flat = np.cumsum(lengths).tolist(), flat.tolist()
        return [tuple(flat[end - n:end]) for end, n in zip(ends, lengths.tolist())]

    def flat_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of many distinct words has, and their ids one after the other; the pieces of plain words are
        cut in one go."""
        text = b"\n".join(words).decode()
        if not self._known:
            odd = dict(enumerate(text.split("\n"))) if words else {}
        elif _ODD.search(text):
            texts = text.split("\n")
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            found = np.searchsorted(starts, [m.start() for m in _ODD.finditer(text)], "right") - 1
            odd = {i: texts[i] for i in dict.fromkeys(found.tolist())}
            text = "\n".join(["" if i in odd else t for i, t in enumerate(texts)])
        else:
            odd = {}
        pieces = [] if len(odd) == len(words) else _LINES.findall(text.lower())
        if len(self._number) >= self._max:
            self._forget_pieces()
        number, first = self._number, len(self._number)
        at = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        self._learn(list(islice(number, first, None)))
        # a line break ends a word; odd words stand between them as empty ones
        sizes = self._sizes[at]
        upto = np.r_[0, np.cumsum(sizes)][np.r_[np.flatnonzero(at == 0), len(at)]] if len(pieces) else np.zeros(len(words), np.int64)
        lengths = np.diff(upto, prepend=0)[:len(words)]
        flat = self._flat[np.repeat(self._starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        if odd:
            lists = [self.ids(t) for t in odd.values()]
            where = np.fromiter(odd, np.int64, len(odd))
            more = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.insert(flat, np.repeat(upto[where], more), np.fromiter(chain.from_iterable(lists), flat.dtype, int(more.sum())))
            lengths[where] = more
        return lengths, flat

    def _forget_pieces(self) -> None:
        """An empty table of the pieces of ``flat_ids``: their numbers, and by number their ids; the line break is 0 and has none."""
        self._number = defaultdict()
        self._number.default_factory = self._number.__len__  # a new piece gets the next number
        self._number["\n"]
        self._starts, self._sizes, self._flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        lists = list(map(self._encoded, pieces))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self._starts = np.r_[self._starts, len(self._flat) + np.cumsum(sizes) - sizes]
        self._sizes = np.r_[self._sizes, sizes]
        self._flat = np.r_[self._flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))]

    def values(self, data: bytes) -> list:
        """The kept value of every word of a text given as UTF-8."""
        words = data.split()
        kept = self._words
        try:
            return [kept[w] for w in words]
        except KeyError:
            pass
        fresh = set(words)
        missing = [w for w in fresh if w not in kept]
        if len(kept) + len(missing) > self._max and kept:
            kept.clear()
            missing = fresh
        once = {}
        for w in missing:
            (kept if len(w) <= LONGEST_KEPT else once)[w] = self._render(self.ids(w.decode()))
        if once:
            return [kept[w] if len(w) <= LONGEST_KEPT else once[w] for w in words]
        return [kept[w] for w in words]


_CODERS: dict = {}


def coder(path: str, render, max_words: int = 300_000) -> WordCoder:
    """The worker's coder for a file and rendering; its words are forgotten between tasks, so that a worker that goes
    on to other work doesn't hold them."""
    key = (path, render.__qualname__, max_words)
    if key not in _CODERS:
        _CODERS[key] = WordCoder(path, render, max_words)
    _CODERS[key].clear()
    return _CODERS[key]


def forget() -> None:
    """Empties the word tables of this worker, at the end of a task."""
    for one in _CODERS.values():
        one.clear()
