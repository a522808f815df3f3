"""From dumps and crawls to linked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions import content, html, links, markup
from linkspark.operators.redirects import relink


def linked(pages: DataFrame, markup_column: str, normalise=None, more: tuple[str, ...] = ()) -> DataFrame:
    """Documents (_id, text, links) from pages whose markup has anchors only, with the columns ``more`` after these."""
    found = F.col(markup_column)
    return pages.select("_id", links.plain_text(found).alias("text"), links.link_structs(found, normalise).alias("links"), *more)


def wiki_articles(pages: DataFrame, redirects: DataFrame | None = None, keep_unlinked: bool = False) -> DataFrame:
    """Documents of encyclopedia articles: main namespace, no redirects, some content. Those are filtered before any markup is parsed."""
    own = pages.where((F.col("namespace") == "0") & F.col("redirect").isNull() & (F.coalesce("content", F.lit("")) != ""))
    docs = linked(own.select("_id", markup.remove_markup(F.col("_id"), F.col("content")).alias("__markup")), "__markup", links.normalise_link)
    return docs if redirects is None else relink(docs, redirects, keep_unlinked)


def web_articles(pages: DataFrame, most_chars: int | None = html.MOST_CHARS, by_tree: bool = False) -> DataFrame:
    """Documents of web pages: main content, anchors kept. Pages whose content has ``most_chars`` or more go; None keeps all.

    by_tree: the content is what the densities of the page's tree say (``content``), not each block by itself.
    """
    markup_of = content.main_content_markup if by_tree else html.article_markup
    found = pages.select("_id", markup_of(F.col("content"), most_chars).alias("__markup")).where(F.col("__markup").isNotNull())
    return linked(found, "__markup")


def redirect_documents(docs: DataFrame, redirects: DataFrame) -> DataFrame:
    """Documents with redirected targets replaced; those without links go."""
    return relink(docs, redirects)
