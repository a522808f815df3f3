"""Language identification by error-correcting output codes.

Each language gets a codeword; one linear classifier of hashed byte
trigrams predicts each bit. Decoding takes the language whose codeword has
the least logistic loss over all bits, and flags the text as ambiguous when
the runner-up is close.

Training uses a bounded sample of every language (``per_language`` texts but
no more than ``most_texts`` in all, of long ones the first ``max_chars`` code
points); prediction covers every whole text.

Defined results: null texts and texts without a letter are ``und`` with
score 0; very long texts are judged whole; without training rows every text
is ``und``; with one language all others get it; of equal losses the first
language in order wins, and is flagged; an id with several languages or
texts is learned once in each language, by its least text; repeated rows are
judged alike; an empty table gives no row; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm import bytescan as B
from linkspark.llm.sampling import sample_ids, training_texts
from linkspark.llm.storage import extended, packed

BINS = 1 << 13
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, bytes of other characters as they are, all else a gap.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class LangRules:
    per_language: int = 400
    most_texts: int = 8000  # of all languages together, if there are not more languages; 32 KB each on the driver
    max_chars: int = 10_000
    steps: int = 150
    rate: float = 20.0
    penalty: float = 1e-4
    ambiguous: float = 0.2  # least lead of the best language's score


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weight: np.ndarray  # (bins + 1) x bits, the last row is the bias


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes up to 6 languages; for more, those of random codes that keep the largest distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = 2 ** (n - 1) - 1
        return np.array([[1.0 if b >> (n - 1 - k) & 1 or k == 0 else -1.0 for b in range(bits)] for k in range(n)])
    bits, best, far = int(np.ceil(10 * np.log2(n))), None, -1
    rng = np.random.default_rng(n)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        product = code @ code.T - 2 * bits * np.eye(n)
        if (near := bits - int(product.max())) > far:
            best, far = code, near
    return best


def histograms(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of trigram counts, one row a document."""
    docs = len(at) - 1
    out = np.zeros((docs, BINS), np.float32)
    if len(raw) >= 3:
        c = _CLASS[raw].astype(np.uint32)
        code = c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)
        fits = ((c[:-2] != 32) | (c[1:-1] != 32)) & ((c[1:-1] != 32) | (c[2:] != 32))
        edge = at[1:-1]
        for k in (1, 2):
            e = edge - k
            fits[e[(e >= 0) & (e < len(fits))]] = False
        here = np.flatnonzero(fits)
        slot = (code[here] * np.uint32(2654435761)) >> np.uint32(32 - 13)
        cut = np.searchsorted(here, at)
        for d in range(docs):
            out[d] = np.bincount(slot[cut[d] : cut[d + 1]], minlength=BINS)
    np.sqrt(out, out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def fit(texts: list[tuple[str, str]], rules: LangRules = LangRules()) -> Model | None:
    texts = [(t, lang) for t, lang in texts if t]
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    code = codewords(len(languages))
    x = np.concatenate([histograms(raw, at) for _, _, raw, at in B.slices(pa.array([t for t, _ in texts]))])
    own = np.array([languages.index(lang) for _, lang in texts])
    share = (1 / np.bincount(own, minlength=len(languages)))[own] / len(languages)
    y = code[own].astype(np.float32)
    weight, bias = np.zeros((BINS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    pull = np.zeros_like(weight)
    for _ in range(rules.steps):
        off = (y / (1 + np.exp(np.clip(y * (x @ weight + bias), -30, 30))) * share[:, None]).astype(np.float32)
        pull = 0.9 * pull + (x.T @ off - rules.penalty * weight)
        weight += rules.rate * pull
        bias += rules.rate * 0.1 * off.sum(0)
    return Model(languages, code, np.vstack([weight, bias]).astype(np.float32))


def predict(raw: np.ndarray, at: np.ndarray, model: Model | None, ambiguous: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    docs = len(at) - 1
    letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    has = letters[at[1:]] > letters[at[:-1]]
    for d in np.flatnonzero(~has & (np.diff(at) > 0)):
        has[d] = _LETTER.search(raw[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")) is not None
    if model is None or not has.any():
        return ["und"] * docs, np.zeros(docs), has
    margin = histograms(raw, at) @ model.weight[:-1] + model.weight[-1]
    loss = np.stack([np.logaddexp(0, -margin * c).sum(1) for c in model.code], 1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    score = np.where(has, p.max(1), 0.0)
    second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(docs)
    return [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], score, ~has | (score - second < ambiguous)


def train_model(docs: DataFrame, rules: LangRules = LangRules()) -> Model | None:
    """From texts with a language outside the held-out fold."""
    full = docs.where(F.length("text") > 0)
    ids = sample_ids(full, "lang", rules.per_language, most=rules.most_texts)
    return fit(training_texts(full.select("doc_id", "lang", F.left("text", F.lit(rules.max_chars)).alias("text")), ids, "lang"), rules)


def identify(docs: DataFrame, model: Model | None, text: str = "text", rules: LangRules = LangRules()) -> DataFrame:
    """Adds ``lang_pred, score, ambiguous`` to every row; columns of those names are replaced."""
    new = [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")]
    source, back = packed(docs, text, [n for n, _ in new])
    schema = extended(source.schema, ", ".join(f"{n} {t}" for n, t in new))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x bits numbers
    bound = rules.ambiguous

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in B.slices(batch.column(1)):
                for a in range(0, len(at) - 1, 512):
                    b = min(a + 512, len(at) - 1)
                    lang, score, unsure = predict(raw[at[a] : at[b]], at[a : b + 1] - at[a], shared.value, bound)
                    arrays = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(i + a, b - a) for c in batch.columns), *arrays], names=schema.names)

    return back(source.mapInArrow(run, schema))
