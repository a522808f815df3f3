"""Line-first quality rules.

Every line with a word is judged by itself: navigation bars, symbol noise,
shouted lines, short boilerplate and short lines without final punctuation
fail. Failing lines are cut out; a document that loses too large a share of
its words that way, or fails the base rules on the whole text, is rejected.

Defined results: null and empty texts have no words and fail the base rules;
very long texts are judged whole, in memory of some forty times their bytes;
each row is judged by itself, so repeated rows and ties need no rule; an
empty table gives no row; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import bytescan as B
from linkspark.llm.storage import as_struct, extended, packed, unpacked

# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "terms of use", "terms of service",
    "privacy policy", "cookie", "subscribe", "click here", "sign up", "log in", "read more", "share this", "javascript",
)
SYMBOLS = b"#*$%&|<>"
TERMINAL = b".!?:;\"')]"


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules; counts are words unless named otherwise."""

    nav_pipes: int = 2  # a line with so many pipes ...
    nav_share: int = 5  # ... and a pipe for each so many words is navigation
    symbol_share: int = 5  # one symbol for each so many code points of its words is noise
    shout_share: int = 2  # one exclamation mark for each so many words is shouting
    short_open: int = 8  # shorter lines need final punctuation
    boilerplate_words: int = 30  # longer lines are prose even with such a phrase
    keep_percent: int = 50  # a document must keep so many percent of its words
    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8


_SYM = np.zeros(256, bool)
_SYM[list(SYMBOLS)] = True
_END = np.zeros(256, bool)
_END[list(TERMINAL)] = True


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeat_words(word: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Per document: words inside windows that occur twice or more in it."""
    value, where = B.windows(word, first, size)
    docs = len(first) - 1
    if not len(value):
        return np.zeros(docs, np.int64)
    owner = np.searchsorted(first, where, "right") - 1
    key = B.mix(value + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, where[twice], 1)
    np.add.at(edge, where[twice] + size, -1)
    covered = _running(np.cumsum(edge)[:-1] > 0)
    return covered[first[1:]] - covered[first[:-1]]


def judge_slice(raw: np.ndarray, at: np.ndarray, rules: LineRules) -> dict[str, np.ndarray]:
    docs = len(at) - 1
    starts, ends, first = B.words(raw, at)
    word = B.hashes(raw, starts, ends)
    n_words = np.diff(first)
    chars = B.char_starts(raw)
    blank = _running(B.SPACE[raw])
    symbols = _running(_SYM[raw])
    pipes = _running(raw == 124)
    bangs = _running(raw == 33)

    line_start, line_end = B.runs(raw != 10, at)
    line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    full = line_words > 0
    line_start, line_end, line_words = line_start[full], line_end[full], line_words[full]
    owner = np.searchsorted(at, line_start, "right") - 1

    line_key = B.mix(B.hashes(raw, line_start, line_end) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, earliest = np.unique(line_key, return_index=True)
    dup = np.ones(len(line_key), bool)
    dup[earliest] = False

    def within(total: np.ndarray) -> np.ndarray:
        return total[line_end] - total[line_start]

    visible = within(chars) - within(blank)
    stop = ends[np.searchsorted(starts, line_end) - 1] - 1 if len(line_end) else line_end
    closed = _END[raw[stop]] | (raw[stop] >= 0x80) & _closed_wide(raw, stop)
    pipe, bang = within(pipes), within(bangs)
    failed = (pipe >= rules.nav_pipes) & (rules.nav_share * pipe >= line_words)
    failed |= rules.symbol_share * within(symbols) > visible
    failed |= (bang > 0) & (rules.shout_share * bang >= line_words)
    failed |= ~closed & (line_words < rules.short_open)
    for k in _boilerplate(raw, line_start, line_end):
        failed[k] |= line_words[k] <= rules.boilerplate_words

    lost = np.bincount(owner[failed], weights=line_words[failed], minlength=docs).astype(np.int64)
    n_repeat = _repeat_words(word, first, rules.repeat_window)
    base = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    kept_words = n_words - lost
    return {
        "n_words": n_words,
        "word_chars": (chars[at[1:]] - chars[at[:-1]]) - (blank[at[1:]] - blank[at[:-1]]),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": np.bincount(owner[dup], minlength=docs).astype(np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": base,
        "kept": ~base & (100 * kept_words >= rules.keep_percent * n_words),
        "n_kept_words": kept_words,
        "_failed": (line_start[failed], line_end[failed]),
    }


# Closing punctuation of more than one byte.
_WIDE = [c.encode() for c in "…”’»。！？"]


def _closed_wide(raw: np.ndarray, stop: np.ndarray) -> np.ndarray:
    out = np.zeros(len(stop), bool)
    for mark in _WIDE:
        fits = stop >= len(mark) - 1
        hit = fits.copy()
        for k, c in enumerate(reversed(mark)):
            hit &= raw[np.maximum(stop - k, 0)] == c
        out |= hit
    return out


def _boilerplate(raw: np.ndarray, line_start: np.ndarray, line_end: np.ndarray) -> set[int]:
    low = B.LOWER[raw].tobytes()
    found = set()
    for phrase in BOILERPLATE:
        phrase_bytes = phrase.encode()
        i = low.find(phrase_bytes)
        while i >= 0:
            k = int(np.searchsorted(line_start, i, "right")) - 1
            if k >= 0 and i + len(phrase_bytes) <= line_end[k]:
                found.add(k)
            i = low.find(phrase_bytes, i + 1)
    return found


def line_quality(docs: DataFrame, text: str = "text", rules: LineRules = LineRules(), with_clean_text: bool = False) -> DataFrame:
    """Adds the figures, ``base_failed``, ``kept`` and ``n_kept_words`` to every row, and on request ``clean_text``.

    ``clean_text`` is the text without its failing lines. Input columns of those names are replaced.
    """
    new = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_kept_words", "long")]
    if with_clean_text:
        new.append(("clean_text", "string"))
    source, back = packed(docs, text, [n for n, _ in new])
    schema = extended(source.schema, ", ".join(f"{n} {t}" for n, t in new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for i, j, raw, at in B.slices(column):
                out = judge_slice(raw, at, rules)
                arrays = [pa.array(out[n]) for n, _ in new if n in out]
                if with_clean_text:
                    arrays.append(pa.array(_without(raw, at, *out["_failed"]), pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), *arrays], names=schema.names)

    return back(source.mapInArrow(run, schema))


def _without(raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        lo, hi = np.searchsorted(starts, [a, b])
        parts, here = [], a
        for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True):
            parts.append(raw[here:s].tobytes())
            here = min(e + 1, b)
        parts.append(raw[here:b].tobytes())
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return out


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents with their failing lines removed; columns as they came."""
    out = line_quality(docs.select(as_struct(docs), F.col("text").alias("__text")), "__text", rules, with_clean_text=True)
    return out.where("kept").select(*unpacked(docs.columns, {"text": F.col("clean_text")}))
