"""Whole texts to token ids with the tokenizers library, one segment at a time.

Both vocabularies split a text before they merge, and no piece of theirs
runs across the end of a word. So a text is cut at single spaces and
newlines, and each distinct segment is encoded by the library once and then
looked up. Texts for which that cut is not proven safe (white space that is
doubled, or other than space and newline) are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np

CACHE_SEGMENTS = 600_000
END_ID = 2
_ODD_SIGNS = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31)]
_ODD_WIDE = re.compile(r"[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD_PAIRS = ("  ", "\n\n", " \n", "\n ")
#: Letters that are letters in every version of Unicode, each its own composed form, with a lower case of one letter.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Signs that both vocabularies take together as one piece when they end a word; apostrophes are left to the library.
_TAIL = "!#$%&*.,;:?"
#: Stands before a segment that has no space before it.
_BARE = "\0"


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    table, extra = {}, 256
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255):
            table[b] = extra
            extra += 1
    return table


_LETTERS = _byte_letters()
_SPACE = chr(_LETTERS[32])


def is_odd(text: str) -> bool:
    if any(p in text for p in _ODD_PAIRS) or any(c in text for c in _ODD_SIGNS):
        return True
    return not text.isascii() and _ODD_WIDE.search(text) is not None


class _Segments(dict):
    """Segment to the number of its ids' place; an unknown one is encoded when it is looked up."""

    def __init__(self, tokenizer, spaced: bool):
        super().__init__()
        self.tokenizer, self.tokenize, self.spaced = tokenizer, tokenizer.model.tokenize, spaced
        self.ids, self.ends = array("I"), array("q", [0])
        self.marks: dict[str, list[int]] = {}

    def __missing__(self, segment: str) -> int:
        if segment.isalpha():
            ids = self._word(segment, True)
        else:
            word = segment.rstrip(_TAIL)
            bare = self.spaced and word[:1] == _BARE
            if word[bare:].isalpha() and (word.isascii() or _PLAIN.fullmatch(word, bare)):
                known = self.get(word)
                ids = self._word(word[bare:], not bare) if known is None else self.ids[self.ends[known] : self.ends[known + 1]].tolist()
                tail = segment[len(word) :]
                ids = ids + self._signs(tail) if tail else ids
            else:
                ids = None
        if ids is None:
            if not self.spaced or segment == "\n":
                text = segment
            else:
                text = segment[1:] if segment[:1] == _BARE else " " + segment
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        place = self[segment] = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return place

    def _signs(self, tail: str) -> list[int]:
        """Ids of a run of signs at the end of a word."""
        if tail not in self.marks:
            if len(tail) > 8:
                return [t.id for t in self.tokenize(tail)]
            self.marks[tail] = [t.id for t in self.tokenize(tail)]
        return self.marks[tail]

    def _word(self, word: str, after_space: bool) -> list[int] | None:
        """Ids of a run of letters; None where it needs the tokenizer's own steps before the merges."""
        if not word.isascii():
            if _PLAIN.fullmatch(word) is None:
                return None
            word = (word if self.spaced else word.lower()).encode().decode("latin-1").translate(_LETTERS)
        elif not self.spaced:
            word = word.lower()
        return [t.id for t in self.tokenize(_SPACE + word if self.spaced and after_space else word)]


class SegmentEncoder:
    """spaced: whether a segment keeps the space before it (byte-level), or white space is dropped."""

    def __init__(self, path: str, spaced: bool, most: int = CACHE_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced, self.most = spaced, most
        self.place = _Segments(self.tokenizer, spaced)

    def whole(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), each text's followed by the end id, and n+1 offsets."""
        if len(self.place) > self.most:
            self.place = _Segments(self.tokenizer, self.spaced)
        parts: list[list[str]] = []
        odd: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            if not self.spaced:
                parts.append(t.replace("\n", " ").split(" "))
            elif is_odd(t):
                odd[k] = self.whole([t])[0]
                parts.append([])
            else:
                own = t.replace("\n", " \n " + _BARE).split(" ")
                own[0] = _BARE + own[0]
                parts.append(own)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
        flat = np.frombuffer(self.place.ids, np.uint32) if self.place.ids else np.zeros(0, np.uint32)
        ends = np.frombuffer(self.place.ends, np.int64)
        begin = ends[place]
        size = ends[place + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        del flat, ends  # their arrays grow again
        at = total[np.concatenate([[0], np.cumsum(count)])]
        pieces = []
        for k in range(len(parts)):
            pieces += [np.array(odd[k], np.uint32) if k in odd else ids[at[k] : at[k + 1]], _END]
        out = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        length = np.diff(at) + 1
        for k, x in odd.items():
            length[k] = len(x) + 1
        return out, np.concatenate([[0], np.cumsum(length)])


_END = np.array([END_ID], np.uint32)
_held: dict[tuple[str, bool, int], SegmentEncoder] = {}


def encoder(path: str, spaced: bool, most: int = CACHE_SEGMENTS) -> SegmentEncoder:
    """The worker process's own encoder of that file; its cache is emptied beyond ``most`` segments."""
    key = path, spaced, most
    if key not in _held:
        _held[key] = SegmentEncoder(*key)
    return _held[key]


def text_runs(texts: Sequence[str | None], limit: int = 1 << 19):
    """(first, end, texts) in runs of about ``limit`` characters; null is empty."""
    a, size, run = 0, 0, []
    for k, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= limit:
            yield a, k + 1, run
            a, size, run = k + 1, 0, []
    if run:
        yield a, a + len(run), run
