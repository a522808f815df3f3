"""Builds a model from stored inputs and prints or saves its lines.

    python -m linkspark.cli entity_counts --docs docs/ --save out/ --format tsv
    python -m linkspark.cli index_mentions --docs docs/ --input vocab=vocab/ --option lowercase=true
    python -m linkspark.cli entity_embeddings --input mentions=mentions/
    python -m linkspark.cli wiki_articles --input pages=dump.xml --input redirects=redirects/
"""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from linkspark import schemas
from linkspark.operators import embeddings, entities, redirects, relations, terms
from linkspark.plans import corpora
from linkspark.sources import readers, writers


def _json(schema: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: readers.json_lines(spark, path, schema)


#: How each kind of input is read.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "docs": _json(schemas.DOCUMENTS),
    "pages": readers.wiki_dump,
    "crawl": readers.warc_crawl,
    "kb": readers.kb_dump,
    "redirects": readers.redirects,
    "from_redirects": readers.redirects,
    "vocab": readers.vocab,
    "idfs": _json(schemas.IDFS),
    "mentions": _json(schemas.MENTIONS),
}


@dataclass(frozen=True)
class Builder:
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ("docs",)
    may_lack: tuple[str, ...] = ()  # inputs that are None if they aren't given
    instead: tuple[tuple[str, str], ...] = ()  # (an input, another kind that may be given in its place)


_STORED = (("docs", "mentions"),)


def _of_mentions(model):
    """A model of mentions, stored ones or those in documents; options go to whichever of the two names them."""

    def build(source: DataFrame, *others: DataFrame, **options):
        own = inspect.signature(terms.entity_mentions).parameters
        finding = {k: options.pop(k) for k in list(options) if k in own}
        stored = "links" not in source.columns
        if stored and finding:
            raise SystemExit(f"stored mentions take no {', '.join(finding)}")
        return model(source if stored else terms.entity_mentions(source, **finding), *others, **options)

    return build


_OF_DOCUMENTS = (
    entities.entity_counts, entities.entity_name_counts, entities.name_part_counts, entities.entity_inlinks, entities.entity_inlink_pairs, entities.entity_vocab, entities.entity_comentions,
    terms.term_frequencies, terms.term_document_frequencies, terms.term_vocab, terms.term_idfs, terms.entity_mentions,
)
MODELS: dict[str, Builder] = {f.__name__: Builder(f) for f in _OF_DOCUMENTS} | {
    "mapped_comentions": Builder(entities.mapped_comentions, ("docs", "vocab")),
    "index_mentions": Builder(_of_mentions(terms.index_mentions), ("docs", "vocab"), instead=_STORED),
    "entity_term_weights": Builder(_of_mentions(terms.entity_term_weights), ("docs", "idfs"), instead=_STORED),
    "entity_embeddings": Builder(_of_mentions(embeddings.entity_embeddings), instead=_STORED),
    "wiki_corpus": Builder(lambda pages: pages, ("pages",)),
    "wiki_redirects": Builder(redirects.wiki_redirects, ("pages",)),
    "wiki_articles": Builder(corpora.wiki_articles, ("pages", "redirects"), ("redirects",)),
    "warc_corpus": Builder(lambda crawl: crawl, ("crawl",)),
    "web_articles": Builder(corpora.web_articles, ("crawl",)),
    "relations": Builder(relations.relations, ("kb",)),
    "map_redirects": Builder(redirects.map_redirects, ("from_redirects", "redirects")),
    "redirect_documents": Builder(corpora.redirect_documents, ("docs", "redirects")),
}


def _value(text: str):
    low = text.lower()
    if low in ("true", "false", "none"):
        return {"true": True, "false": False, "none": None}[low]
    try:
        return int(text)
    except ValueError:
        return text


def _pairs(given: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in given)


def build(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    model = MODELS[args.model]
    paths = _pairs(args.input) | ({"docs": args.docs} if args.docs else {})
    kinds = [next((other for own, other in model.instead if own == i and own not in paths and other in paths), i) for i in model.inputs]
    if missing := [i for i in kinds if i not in paths and i not in model.may_lack]:
        raise SystemExit(f"{args.model} needs --input {'=PATH --input '.join(missing)}=PATH")
    inputs = [READERS[i](spark, paths[i]) if i in paths else None for i in kinds]
    rows = model.build(*inputs, **{k: _value(v) for k, v in _pairs(args.option).items()})
    extra = {"prefix": args.prefix, "serializer": args.serializer, "field": args.field} if args.format == "redis" else {}
    return writers.FORMATS[args.format](rows, **extra)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("model", choices=sorted(MODELS))
    p.add_argument("--docs", help="JSON lines of linked documents; short for --input docs=PATH")
    p.add_argument("--input", action="append", default=[], metavar="KIND=PATH", help=f"an input of the model: {', '.join(READERS)}")
    p.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="an option of the model")
    p.add_argument("--format", choices=sorted(writers.FORMATS), default="json")
    p.add_argument("--prefix", default="")
    p.add_argument("--serializer", choices=("json", "pickle", "msgpack", "raw"), default="json")
    p.add_argument("--field")
    p.add_argument("--save", help="a folder to overwrite; without it, a sample is printed")
    p.add_argument("--sample", type=int, default=1)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("linkspark").getOrCreate()
    lines = build(spark, args)
    if args.save:
        writers.save_lines(lines, args.save, separator="\r\n" if args.format == "redis" else "\n")
    else:
        for row in lines.limit(args.sample).collect():
            print(row.value)


if __name__ == "__main__":
    main()
