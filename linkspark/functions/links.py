"""Anchors in markup, and normal forms of links, without user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions.text import let, running_sums, strip

WIKI_PREFIX = "en.wikipedia.org/wiki/"
# Fixed value: an anchor, its target and its text. (?d): only \n ends a line.
ANCHOR = r'(?d)<a href="(.+?)">(.+?)</a>'


def plain_text(content: Column) -> Column:
    """The markup with each anchor replaced by its text."""
    return F.regexp_replace(content, ANCHOR, "$2")


def link_structs(content: Column, normalise=None) -> Column:
    """Array of (target, start, stop) of all anchors, with offsets into ``plain_text``.

    What lies between anchors and the anchors' texts alternate, so a link starts after all gaps
    up to it and all texts before it.
    """
    gaps = F.transform(F.split(content, ANCHOR, -1), F.length)
    names = F.transform(F.regexp_extract_all(content, F.lit(ANCHOR), F.lit(2)), F.length)
    parts = let(gaps, lambda g: let(names, lambda n: F.transform(n, lambda size, i: F.struct(F.get(g, i).alias("gap"), size.alias("size")))))
    found = let(
        parts,
        lambda p: F.struct(
            p.alias("parts"),
            running_sums(F.transform(p, lambda x: x["gap"] + x["size"])).alias("since"),
            F.regexp_extract_all(content, F.lit(ANCHOR), F.lit(1)).alias("targets"),
        ),
    )

    def of(f: Column) -> Column:
        def one(target: Column, i: Column) -> Column:
            part = F.get(f["parts"], i)
            start = F.get(f["since"], i) + part["gap"]
            shown = normalise(target) if normalise else target
            return F.struct(shown.alias("target"), start.alias("start"), (start + part["size"]).alias("stop"))

        return F.transform(f["targets"], one)

    return F.coalesce(let(found, of), F.array().cast("array<struct<target:string,start:int,stop:int>>"))


def normalise_title(title: Column) -> Column:
    """Spaces to underscores, none at the ends, and the first letter in upper case."""
    bare = strip(F.trim(F.translate(title, " ", "_"), F.lit("_")))
    first = F.left(bare, F.lit(1))
    raised = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)  # letters without a capital stay
    return F.concat(raised, F.substring(bare, 2, 1 << 30))


def normalise_link(link: Column) -> Column:
    return F.when(F.startswith(link, F.lit(WIKI_PREFIX)), F.concat(F.lit(WIKI_PREFIX), normalise_title(F.substring(link, len(WIKI_PREFIX) + 1, 1 << 30)))).otherwise(link)
