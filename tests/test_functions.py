import re
import time

import pytest
from pyspark.sql import functions as F

from linkspark.functions import html, links, markup
from linkspark.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("s", "sub", "proto"), [("http://h/a#x", "http://h/a", "h/a#x"), ("#x", "", "#x"), ("a?u=http://b", "a?u=http://b", "b"), ("plain", "plain", "plain")])
def test_trims(spark, s, sub, proto):
    assert one(spark, X.trim_subsection(F.col("s")), s=s) == sub
    assert one(spark, X.trim_protocol(F.col("s")), s=s) == proto


def test_ngrams(spark):
    t = "The cat, sat 4x."
    assert one(spark, X.ngrams(F.col("t"), 2, lowercase=True), t=t) == ["the", "cat", "sat", "4x", "the cat", "cat sat", "sat 4x"]
    assert one(spark, X.ngrams(F.col("t"), 3, 3), t="a b") == []
    assert one(spark, X.ngrams(F.col("t")), t=None) == []
    assert one(spark, X.ngrams(F.col("t"), 2, 2, within_sentences=True), t="One two. Three four.") == ["One two", "Three four"]


def test_sentences():
    t = "He met Dr. Who of Acme Inc. today. It rained, e.g. hard!  Yes?\n\nNo"
    found = [t[s["start"] : s["stop"]] for s in X.spans_of(t)]
    assert found == ["He met Dr. Who of Acme Inc. today.", "It rained, e.g. hard!", "Yes?", "No"] or found == ["He met Dr. Who of Acme Inc. today.", "It rained, e.g. hard!", " Yes?", "No"]
    assert X.spans_of("") == X.spans_of(None) == []


def test_links(spark):
    c = 'é𝄞 <a href="x#1">one</a> and <a href="y">two</a>!\n<a href="z"></a>'
    row = spark.createDataFrame([(c,)], "c string").select(links.plain_text(F.col("c")), links.link_structs(F.col("c"))).first()
    expected, at = [], 0
    for m in re.finditer(r'<a href="(.+?)">(.+?)</a>', c):
        start = m.start() - at
        at += len(m[0]) - len(m[2])
        expected.append((m[1], start, start + len(m[2])))
    assert [tuple(x) for x in row[1]] == expected
    assert [row[0][a:b] for _, a, b in expected] == ["one", "two"]


def test_running_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)], "a array<int>")
    for a, sums, small in df.select("a", X.running_sums(F.col("a")), X.running_sums(F.col("a"), 2)).collect():
        assert sums == small == [sum(a[:k]) for k in range(len(a))]


def test_many_links_in_a_page(spark):
    """Offsets of a page's links take no time that grows with their square."""
    n = 10_000
    c = "".join(f'gap{k} <a href="t{k}">name {k}</a>' for k in range(n))
    df = spark.createDataFrame([(c,)], "c string").coalesce(1)
    df.select(F.sum(F.size(links.link_structs(F.substring("c", 1, 1000))))).collect()  # compiled
    start = time.time()
    text, found = df.select(links.plain_text(F.col("c")), links.link_structs(F.col("c"))).first()
    assert time.time() - start < 5
    assert len(found) == n and all(text[x.start : x.stop] == f"name {k}" and x.target == f"t{k}" for k, x in enumerate(found))


def test_normal_titles(spark):
    assert one(spark, links.normalise_link(F.col("s")), s="en.wikipedia.org/wiki/ foo bar_") == "en.wikipedia.org/wiki/Foo_bar"
    assert one(spark, links.normalise_link(F.col("s")), s="http://x/ y") == "http://x/ y"


def test_markup():
    src = "{{Infobox|a={{b}}}}'''Foo''' is [[bar|a ''bar'']], see [[Baz]] &amp;lt; [http://x.org a site].<ref>no</ref> (  )\n== See ==\n[[File:a.png|thumb|A [[cap]] here]][[Category:X]]"
    out = markup.plain_markup("en.wikipedia.org/wiki/Foo", src)
    assert '<a href="en.wikipedia.org/wiki/Foo">Foo</a> is <a href="en.wikipedia.org/wiki/bar">a "bar"</a>' in out
    assert '<a href="en.wikipedia.org/wiki/Baz">Baz</a> &lt; <a href="x.org"> a site</a>.' in out
    assert "Infobox" not in out and "See" in out and "==" not in out and "here." in out and "Category" not in out and "no" not in out.split("site")[1]
    assert markup.without_templates("a{{b{c}d}}e{{open") == "ae"
    assert markup.captions_only("x [[File:a|b|open") == "x open"
    assert markup.unescape("&eacute;&#65;&#x42;&nope;&#xZZ;") == "éAB&nope;&#xZZ;"
    assert markup.plain_markup("u", None) is None
    for src in ("[[File:a|b [[c]] d [[e]] f]] g", "[[File:a|[[b [[c]] d]] e", "[[Image:a|b]] [[file:c|d", "[[File:a|x]] y]]"):
        assert markup.captions_only(src) == plain_captions(src), src


def plain_captions(text):
    """Looks for closing and opening brackets one after the other."""
    for kind in ("file", "image"):
        out, here = "", 0
        for m in re.finditer(rf"\[\[[{kind[0]}{kind[0].upper()}]{kind[1:]}:(.*?)(\|[^\]\[]+?)*\|", text):
            if m.start() < here:
                continue
            at = m.end()
            while (close := text.find("]]", at)) >= 0 and 0 <= text.find("[[", at) < close:
                at = close + 2
            out += text[here : m.start()]
            if close < 0:
                here = m.end()
                continue
            caption = text[m.end() : close]
            out += caption + "." * (not caption.strip("] ").endswith(".")) if caption.strip("] ") else ""
            here = close + 2
        text = out + text[here:]
    return text


def test_article():
    page = '<html><head><title>t</title></head><body><nav><a href="/n">nav link text that is long enough</a></nav><p>This is a long enough paragraph with <a href="/x" class="c">a &amp; b</a> in it.</p><p>short</p><script>var x = "<p>no</p>"</script></body></html>'
    assert html.article(page) == 'This is a long enough paragraph with <a href="/x">a &amp; b</a> in it.'
    assert html.article(None) is None and html.article("") == ""
    long = f"<p>{'word ' * 60_000}</p>"
    assert html.article(long) is None and len(html.article(long, most_chars=None)) > 250_000
