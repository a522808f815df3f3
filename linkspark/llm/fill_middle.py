"""Fill-in-the-middle training texts, by splitting with lookarounds.

A text is cut into units, and a deterministic hash of its id chooses two of
the places between them: prefix, middle and suffix. A unit grammar is a list
of runs of character classes, such as ``S*W+|S+``. It is translated to one
zero-width regex: a unit ends between two neighbouring characters whose
classes never stand side by side inside a unit, which a lookbehind and a
lookahead see. Spark's ``split`` at that regex cuts nothing away, so the
pieces are the units, and any run of them joins to a part of the text.

Everything is built of Spark's own functions: one pass, no shuffle, no Python.

Defined results: null text is empty; empty text has no unit and stays plain,
apart from the split, which would give one empty unit; very long texts are
one array of units; a text that holds a marker stays plain, so each output
has one way back; a null id is hashed as the empty text; repeated rows are
treated alike; an empty table gives no row; other columns pass through, but
for those that a new one replaces.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.storage import as_struct, quoted, unpacked, without

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKER = "<[PSM]>"

_SPACE = r"\x20\x09-\x0D"
#: Character classes by letter, which together hold every character once, and the units made of them.
GRAMMARS: dict[str, tuple[dict[str, str], str]] = {
    "words": ({"S": f"[{_SPACE}]", "W": f"[^{_SPACE}]"}, "S*W+|S+"),
    "lines": ({"N": r"\n", "C": r"[^\n]"}, "C*N|C+"),
    "code": ({"S": f"[{_SPACE}]", "W": r"[\p{L}\p{N}_]", "O": rf"[^{_SPACE}\p{{L}}\p{{N}}_]"}, "S+|W+|O"),
    "chars": ({"A": r"[\s\S]"}, "A"),
}


def boundary(classes: dict[str, str], units: str) -> str:
    """The regex between the units of a grammar: the pairs of classes that no unit has side by side.

    For grammars whose units are told by neighbours: each alternative is a sequence of classes, each once,
    repeated (``+``) or left out or repeated (``*``).
    """
    inside = set()
    for unit in units.split("|"):
        runs = re.findall(r"([A-Z])([*+]?)", unit)
        for i, (left, times) in enumerate(runs):
            if times:
                inside.add((left, left))
            for right, more in runs[i + 1 :]:
                inside.add((left, right))
                if more != "*":
                    break
    return "|".join(f"(?<={classes[a]})(?={classes[b]})" for a, b in product(classes, classes) if (a, b) not in inside)


def pieces(text: Column, unit: str = "words") -> Column:
    """The units of a text, which joined are the text; none of an empty one, of which ``split`` would make one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(*GRAMMARS[unit]), -1))


def fill_in_middle(docs: DataFrame, unit: str = "words", rate: int = 50, spm_rate: int = 80, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows with n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    rate: of 100 texts those that are rearranged; spm_rate: of 100 of these those with the suffix first.
    """
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("__hash", 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]
    rows = docs.select(as_struct(docs), body.alias("__text"), digest.alias("__hash"))
    rows = rows.select("__row", "__text", pieces(F.col("__text"), unit).alias("__units"), *h)
    rows = rows.withColumn("__n", F.size("__units").cast("long"))
    cut = [F.col(f"__h{k}") % (F.col("__n") + 1) for k in (1, 2)]
    plain = (F.col("__text") == "") | F.rlike("__text", F.lit(_MARKER)) | (F.col("__h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("__row", "__text", "__units", "__n", form.alias("__form"), F.least(*cut).cast("int").alias("__a"), F.greatest(*cut).cast("int").alias("__b"))

    def part(begin: Column, end: Column, name: str) -> Column:
        return F.when(F.col("__form") != "plain", F.array_join(F.slice("__units", begin + 1, end - begin), "")).alias(name)

    a, b = F.col("__a"), F.col("__b")
    rows = rows.select("__row", "__text", "__n", "__form", part(F.lit(0), a, "__prefix"), part(a, b, "__middle"), part(b, F.col("__n").cast("int"), "__suffix"))
    psm = F.concat(F.lit(PREFIX), "__prefix", F.lit(SUFFIX), "__suffix", F.lit(MIDDLE), "__middle")
    spm = F.concat(F.lit(SUFFIX), "__suffix", F.lit(PREFIX), "__prefix", F.lit(MIDDLE), "__middle")
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", spm).otherwise(F.col("__text"))
    made = [F.col("__n"), F.col("__form"), F.length("__prefix").cast("long"), F.length("__middle").cast("long"), output]
    return rows.select(*unpacked(without(docs, new)), *(c.alias(n) for c, n in zip(made, new, strict=True)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text between markers holds one, so they part it in an empty piece and three others."""

    def joined(order: tuple[int, int, int]) -> Column:
        return F.concat(*(F.get(F.split(output, _MARKER, -1), F.lit(k)) for k in order))

    return F.when(form == "psm", joined((1, 3, 2))).when(form == "spm", joined((2, 3, 1))).otherwise(output)
