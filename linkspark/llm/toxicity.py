"""Toxic spans by a linear-chain conditional random field.

Document labels are carried over to tokens: in a toxic training document a
token is labelled when its word or one of its beginnings is many times more
frequent, by documents, in toxic than in other documents. The field is
trained on those tokens; its forward-backward marginals give the offending
offsets. The number of toxic tokens that they expect, and its share of the
text, give a calibrated document score: one word that only looks like an
offence doesn't make a text toxic.

Training uses a bounded sample (``per_class`` documents a label of at most
``max_chars`` code points, near copies once); scoring covers every whole
text. The model has a fixed size whatever the sample.

Defined results: null and empty texts have no span and the score of a
document without any marginal; very long texts are scored whole, but not
learned from; without training rows of both labels every score is 0; an id
with several labels has the largest; of an id's several texts the least is
learned; each row is scored by itself, so repeated rows are scored alike; an
empty table gives no row; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import bytescan as B
from linkspark.llm import crf
from linkspark.llm.sampling import fold, sample_ids, training_texts
from linkspark.llm.storage import as_struct, extended, packed, unpacked

PREFIXES = (4, 5, 6)
BITS = 18
LIKELY = 0.2  # marginals from which tokens count as expected ones
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass(frozen=True)
class ToxicityRules:
    per_class: int = 2000
    max_chars: int = 10_000
    sketch: int = 32  # least shingle hashes of a training document ...
    copy_share: float = 0.5  # ... which is a copy if earlier ones have this share of them
    min_ratio: float = 8.0  # document frequency in toxic over other documents
    min_gain: float = 40.0  # log-likelihood ratio statistic over all toxic documents
    min_rest_gain: float = 14.0  # the same over those not explained yet
    context: int = 8  # tokens kept around each labelled one for training
    clean_tokens: int = 64  # length of the run kept of each other document
    span_threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each hashed feature, then the bias
    trans: np.ndarray
    curve: np.ndarray  # weights of the figures of ``figures_of``

    def scores(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(figures @ self.curve, -40, 40)))


def figures_of(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document logarithms of the expected toxic tokens and of their share, and a one.

    p: marginals of all tokens. first: where each document's begin, and their number.
    """
    docs = len(first) - 1
    likely = np.flatnonzero(p >= LIKELY)  # the others' small values would add up with length
    expected = 0.02 + np.bincount(np.searchsorted(first, likely, "right") - 1, weights=p[likely], minlength=docs)
    return np.stack([np.log(expected), np.log(expected / (np.diff(first) + 100)), np.ones(docs)], 1)


def token_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bare word and of its first bytes; one row a token."""
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        ends -= (ends - starts > 1) & _PUNCT[raw[ends - 1]]
        starts += (ends - starts > 1) & _PUNCT[raw[starts]]
    low = B.LOWER[raw]
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = B.hashes(raw, starts, ends, lower=True)
    code = np.zeros(len(starts), np.uint64)
    last = len(raw) - 1
    for k in range(max(PREFIXES)):
        byte = low[np.minimum(starts + k, last)].astype(np.uint64)
        byte[starts + k >= ends] = 0
        code |= byte << np.uint64(8 * k)
        if k + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(k + 1)] = B.mix(code + np.uint64(k + 1 << 56))
    return out


def _slots(features: np.ndarray) -> np.ndarray:
    kinds = np.arange(features.shape[1], dtype=np.uint64) << np.uint64(BITS - 2)
    return ((features >> np.uint64(64 - BITS + 2)) + kinds).astype(np.int64)


def fit(texts: list[tuple[str, int]], rules: ToxicityRules = ToxicityRules(), totals: dict[int, int] | None = None) -> Model | None:
    """None if a label has no text with a word. totals: how many documents have each label, if the texts are a sample."""
    kept: list[tuple[np.ndarray, int]] = []
    sketches: set[int] = set()
    for text, label in texts:
        raw, at = B.text_buffers(pa.array([text]))
        starts, ends, _ = B.words(raw, at)
        if not len(starts):
            continue
        own = B.shingle_sets(raw, at)[0][: rules.sketch].tolist()
        if sum(s in sketches for s in own) >= max(1, rules.copy_share * len(own)):
            continue
        sketches.update(own)
        kept.append((token_features(raw, starts, ends), int(label > 0)))
    found = Counter(label for _, label in kept)
    if not found[0] or not found[1]:
        return None
    table = _telling(kept, rules)
    hits = [np.isin(features, table).any(1) if label else np.zeros(len(features), bool) for features, label in kept]
    alike = np.unique(np.concatenate([features[hit].reshape(-1) for (features, _), hit in zip(kept, hits, strict=True)]))
    chains, labels = [], []
    for n, ((features, label), hit) in enumerate(zip(kept, hits, strict=True)):
        near = np.zeros(len(features) + 1, np.int64)
        at = np.flatnonzero(hit if label else np.isin(features, alike).any(1))  # of other documents, tokens that look like labelled ones
        np.add.at(near, np.maximum(at - rules.context, 0), 1)
        np.add.at(near, np.minimum(at + rules.context + 1, len(features)), -1)
        if not label:
            size = min(len(features), rules.clean_tokens)
            begin = (n * 7919) % (len(features) - size + 1)
            near[begin] += 1
            near[begin + size] -= 1
        inside = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        for piece in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1) if len(inside) else []:
            chains.append(features[piece])
            labels.append(hit[piece].astype(np.int64))
    first = np.zeros(sum(map(len, chains)), bool)
    first[np.cumsum([0, *(len(c) for c in chains[:-1])])] = True
    weight, trans = crf.train(_slots(np.concatenate(chains)), np.concatenate(labels), first, 1 << BITS)
    figures = np.concatenate([_figures([f for f, _ in kept[a : a + 200]], weight, trans) for a in range(0, len(kept), 200)])
    label = np.array([label for _, label in kept])
    share = np.array([(totals or found).get(k, 0) / found[k] for k in (0, 1)])  # of documents that each of the sample stands for
    return Model(weight.astype(np.float32), trans, _calibrate(figures, label, (share / share.min())[label]))


def _figures(features: list[np.ndarray], weight: np.ndarray, trans: np.ndarray) -> np.ndarray:
    first = np.cumsum([0, *(len(f) for f in features)])
    slots = _slots(np.concatenate(features))
    head = np.zeros(len(slots), bool)
    head[first[:-1]] = True
    return figures_of(crf.marginals(weight[slots].sum(1) + weight[-1], head, trans), first)


def _telling(kept: list[tuple[np.ndarray, int]], rules: ToxicityRules) -> np.ndarray:
    """Features far more frequent, by documents, in toxic documents.

    A feature counts if it is significant over all of them, or else (greedily, the best first) over
    those toxic documents that have none of the features taken so far.
    """
    by_label = [np.concatenate([np.unique(f) for f, label in kept if label == k]) for k in (0, 1)]
    clean, n_clean = np.unique(by_label[0], return_counts=True)
    pos = sum(label for _, label in kept)
    neg = len(kept) - pos

    def stat(feature: np.ndarray, a: np.ndarray, pos: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(clean, feature), len(clean) - 1)
        b = np.where(clean[at] == feature, n_clean[at], 0)
        share, rest = (a + b) * pos / (pos + neg), (a + b) * neg / (pos + neg)
        g = 2 * (a * np.log(a / share) + np.where(b > 0, b * np.log(np.maximum(b, 1) / rest), 0))
        return np.where(a / pos > rules.min_ratio * (b + 0.5) / neg, g, 0)

    toxic, n_toxic = np.unique(by_label[1], return_counts=True)
    taken = set(toxic[stat(toxic, n_toxic, pos) >= rules.min_gain].tolist())
    while True:
        known = np.array(sorted(taken), np.uint64)
        left = [np.unique(f) for f, label in kept if label and not np.isin(f, known).any()]
        if not left:
            break
        feature, a = np.unique(np.concatenate(left), return_counts=True)
        g = np.where(a >= 2, stat(feature, a, len(left)), 0)
        if g.max() < rules.min_rest_gain:
            break
        taken.add(int(feature[int(np.argmax(g))]))
    return np.array(sorted(taken), np.uint64)


def _calibrate(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the figures; more toxic tokens never lower a score, so a figure of negative weight is left out."""
    fits = []
    for used in ([0, 1, 2], [0, 2], [1, 2]):
        w, value = _logistic(x[:, used], label, weight)
        if (w[:-1] >= 0).all():
            full = np.zeros(x.shape[1])
            full[used] = w
            fits.append((value, full))
    return max(fits, key=lambda f: f[0])[1] if fits else np.zeros(x.shape[1])


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the greatest penalised likelihood, and that, by Newton steps that are halved until they gain."""

    def value(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (label * z - np.logaddexp(0, z))).sum() - 0.05 * w @ w)

    w = np.zeros(x.shape[1])
    best = value(w)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (label - q)) - 0.1 * w)
        while (new := value(w + step)) < best and np.abs(step).max() > 1e-9:
            step = step / 2
        if new - best < 1e-9:
            break
        w, best = w + step, new
    return w, best


def score_slice(raw: np.ndarray, at: np.ndarray, model: Model | None, threshold: float) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Scores, spans as ``start:end,...`` in code points, and the number of toxic tokens, of each document."""
    docs = len(at) - 1
    starts, ends, first = B.words(raw, at)
    if model is None:
        return np.zeros(docs), [""] * docs, np.zeros(docs, np.int64)
    slots = _slots(token_features(raw, starts, ends)) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    begin = np.zeros(len(starts), bool)
    begin[first[np.flatnonzero(np.diff(first))]] = True
    p = crf.marginals(model.weight[slots].sum(1, dtype=np.float64) + float(model.weight[-1]), begin, model.trans)
    figures = figures_of(p, first)
    hit = np.flatnonzero(p >= threshold)
    spans = [""] * docs
    number = np.zeros(docs, np.int64)
    if len(hit):
        chars = B.char_starts(raw)
        owner = np.searchsorted(first, hit, "right") - 1
        number = np.bincount(owner, minlength=docs)
        joined = np.zeros(len(hit), bool)
        joined[1:] = (np.diff(hit) == 1) & (np.diff(owner) == 0)
        heads = np.flatnonzero(~joined)
        tails = np.append(heads[1:], len(hit)) - 1
        texts: dict[int, list[str]] = {}
        for h, t in zip(heads, tails, strict=True):
            d = int(owner[h])
            texts.setdefault(d, []).append(f"{chars[starts[hit[h]]] - chars[at[d]]}:{chars[ends[hit[t]]] - chars[at[d]]}")
        for d, found in texts.items():
            spans[d] = ",".join(found)
    return model.scores(figures), spans, number


def train_model(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> Model | None:
    """From the labelled documents outside the held-out fold."""
    fits = docs.where(F.col("text").isNotNull() & (F.length("text") <= rules.max_chars)).select("doc_id", "text")
    ids = sample_ids(labels, "toxic", rules.per_class, eligible=fits)
    one = labels.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    totals = {int(k): n for k, n in training.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    return fit(training_texts(fits, one, "toxic"), rules, totals)


def score_documents(docs: DataFrame, model: Model | None, text: str = "text", rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """Adds ``score, predicted, toxic_spans, n_toxic_tokens`` to every row; columns of those names are replaced."""
    new = [("score", "double"), ("predicted", "int"), ("toxic_spans", "string"), ("n_toxic_tokens", "long")]
    source, back = packed(docs, text, [n for n, _ in new])
    schema = extended(source.schema, ", ".join(f"{n} {t}" for n, t in new))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, 1 MB
    threshold = rules.span_threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for i, j, raw, at in B.slices(column):
                score, spans, number = score_slice(raw, at, shared.value, threshold)
                arrays = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.string()), pa.array(number, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), *arrays], names=schema.names)

    return back(source.mapInArrow(run, schema))


def drop_toxic(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """The rows that are not predicted toxic; columns as they came."""
    scored = score_documents(docs.select(as_struct(docs), F.col("text").alias("__text")), train_model(docs, labels, rules), "__text", rules)
    return scored.where("predicted = 0").select(*unpacked(docs.columns))
