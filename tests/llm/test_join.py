import re
from collections import Counter

import pytest

from linkspark.llm import ngram_join


def shingles(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for _, t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(texts))


# the second spreads every list over all tasks and holds little; the third's sketch tells nothing
RULES = [ngram_join.JoinRules(), ngram_join.JoinRules(sketch_bits=12, spread_from=3, spread_factor=0, flush=200, chunk=2, bucket_shingles=100), ngram_join.JoinRules(sketch_bits=1)]


@pytest.mark.parametrize("rules", RULES)
def test_components(docs, texts, rules):
    got = Counter(tuple(r) for r in ngram_join.join_components(docs, rules).collect())
    assert got == brute(texts)


def test_keep_one(docs, texts):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {c for i, n, c in brute(texts) if n and c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i not in (300, 301, 302)) == sorted(groups)
    assert {300, 301, 302} <= set(ids)


def test_nothing(no_docs):
    assert ngram_join.join_components(no_docs).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


def test_random_null_ids(spark):
    """A fifth of the rows have no id; links through them count as all others."""
    import random

    rng = random.Random(17)
    texts = []
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(rng.randint(30, 70))]
        for _ in range(rng.randint(2, 9)):
            for _ in range(rng.randint(0, 2)):  # a chain of changes: its ends may be linked by what lies between them only
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
            texts.append((None if rng.random() < 0.2 else len(texts), " ".join(words)))
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for rules in RULES:
        assert Counter(tuple(r) for r in ngram_join.join_components(d, rules).collect()) == brute(texts)


def test_sets_of_null_ids_only(spark):
    """A near copy that only a row without id holds gets its group's id, and links the two sides that don't link themselves."""
    words = [f"w{k}" for k in range(60)]
    edited = [" ".join(["x" if k in at else w for k, w in enumerate(words)]) for at in ((), (20,), (20, 45))]
    texts = [(5, edited[0]), (None, edited[1]), (None, edited[1]), (6, edited[2]), (7, "quite another text of seven words"), (None, "text of a null id that is alone")]
    assert 75 * len(shingles(edited[0]) | shingles(edited[2])) > 100 * len(shingles(edited[0]) & shingles(edited[2]))
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in ngram_join.join_components(d).collect())
    assert got == brute(texts) and {i: c for i, _, c in got if i} == {5: 5, 6: 5, 7: 7}
