"""Tokens, n-grams, sentences and link trims as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"

# Fixed value: where a sentence may end, and the guards before it. White space is looked for first, as little else has to be tried then.
SENTENCE_BREAK = r"\s(?:(?<=[.?!]\s)(?<!\s[a-z]\.\s)(?<!\w\.\w.\s)(?<![A-Z][a-z]\.\s)(?<![Ii]nc\.\s)(?<![Pp]ty\.\s)(?<![Ll]td\.\s)|(?:(?<=\n)|\s*\n)\s*)"
_BREAK = re.compile(SENTENCE_BREAK, re.ASCII)


def tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, bits: int = 7) -> Column:
    """For each number the sum of those before it. In blocks of 2 ** bits, so that long arrays take little more than linear time."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(a: Column) -> Column:
        whole = F.sequence(F.lit(0), F.shiftright(F.size(a), bits))
        blocks = F.transform(whole, lambda k: total(F.slice(a, F.shiftleft(k, bits) + 1, 1 << bits)))

        def placed(b: Column) -> Column:
            before = F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k)))
            return let(before, lambda c: F.transform(a, lambda _, i: F.get(c, F.shiftright(i, bits)) + total(F.slice(a, F.shiftleft(F.shiftright(i, bits), bits) + 1, i.bitwiseAND((1 << bits) - 1)))))

        return let(blocks, placed)

    return let(numbers, of)


def grams_of(toks: Column, max_n: int = 1, min_n: int = 1) -> Column:
    """All n-grams of an array of tokens, joined by spaces, for n from min_n to max_n."""
    if max_n == min_n == 1:
        return toks
    none = F.array().cast("array<string>")

    def all_sizes(t: Column) -> Column:
        def runs(n: int) -> Column:
            if n == 1:
                return t
            at = F.sequence(F.lit(1), F.size(t) - n + 1)
            return F.when(F.size(t) >= n, F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none)

        return F.concat(*(runs(n) for n in range(min_n, max_n + 1)))

    return let(toks, all_sizes)


def ngrams(text: Column, max_n: int = 1, min_n: int = 1, lowercase: bool = False, within_sentences: bool = False) -> Column:
    text = F.lower(text) if lowercase else text
    if not within_sentences:
        return grams_of(tokens(text), max_n, min_n)
    parts = F.transform(sentence_spans(text), lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"]))
    return F.flatten(F.transform(parts, lambda p: grams_of(tokens(p), max_n, min_n)))


def sentence_places(text: str | None) -> tuple[list[int], list[int]]:
    """(starts, stops) of the non-empty stretches between sentence breaks."""
    starts: list[int] = []
    stops: list[int] = []
    begin = 0
    for m in _BREAK.finditer(text or ""):
        stop, onward = m.span()
        if stop > begin:
            starts.append(begin)
            stops.append(stop)
        begin = onward
    if text and begin < len(text):
        starts.append(begin)
        stops.append(len(text))
    return starts, stops


def spans_of(text: str | None) -> list[dict[str, int]]:
    """Non-empty stretches between sentence breaks."""
    return [{"start": a, "stop": b} for a, b in zip(*sentence_places(text), strict=True)]


def sentence_spans(text: Column) -> Column:
    """Array of structs (start, stop). Linear in the text, which no built-in running sum over an array is."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def spans(column: pd.Series) -> pd.Series:
        return column.map(spans_of)

    return spans(text)


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any alphabet."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_subsection(link: Column) -> Column:
    return F.substring_index(link, "#", 1)


def trim_protocol(link: Column) -> Column:
    return F.regexp_replace(link, r"(?s)\A.*?://", "")


def trim_link(link: Column) -> Column:
    return trim_protocol(trim_subsection(link))
