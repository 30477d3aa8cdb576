"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are folded to lower-case letters with single blanks between words; n-grams of one to three
characters are hashed to ``DIM`` features. Document frequencies cover every training document.
Weights are fitted on a bounded sample of labelled rows by follow-the-regularised-leader with an
elastic-net penalty, then a temperature is fitted on a part of that sample set aside. Prediction
is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import row_key, small
from slicewise.sinks.tables import landed

DIM_BITS = 17
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
#: Bound of the fit: labelled documents per language, at most; a fifth of them for calibration.
SAMPLE_PER_LANG = 1500
#: Follow-the-regularised-leader: learning rate, its offset, penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
SCALE = 20.0
UNDETERMINED = "und"
_CHUNK = 1 << 20
_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point to lower-case letter, everything else to a blank; built once per process."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def folded(text: str | None) -> np.ndarray:
    """Code points of letters with one blank around each word; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint64)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _fold_table()[cp]
    blank = c == 32
    if blank.all():
        return np.zeros(0, np.uint64)
    c = c[~(blank & np.append(True, blank[:-1]))]
    space = np.full(1, 32, np.uint64)
    return np.concatenate([space, c, space])


def grams(c: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, in pieces of bounded size."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(c), _CHUNK):
        for n in ORDERS:
            part = c[lo:lo + _CHUNK + n - 1]
            size = len(part) - n + 1
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = (h ^ part[k:k + size]) * mix
                h ^= h >> np.uint64(29)
            yield ((h * mix) >> np.uint64(64 - DIM_BITS)).astype(np.int32)


@dataclass
class Model:
    """Weights per feature and language with the inverse document frequency multiplied in."""

    langs: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        c = folded(text)
        if not len(c) or not self.langs:
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.langs)), 0
        for f in grams(c):
            total += self.weights[f].sum(0, dtype=np.float64)
            n += len(f)
        z = (total / n * SCALE + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, dim: int = DIM, alpha: float = ALPHA,
         beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS
         ) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dim, k) and bias (k) from sparse rows (features, values, class), one row at a
    time. The last feature slot is the bias, which is not penalised."""
    z, n = np.zeros((dim + 1, k)), np.zeros((dim + 1, k))
    l1s = np.full((dim + 1, 1), l1)
    l1s[dim] = 0.0

    def weights(at) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1s[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1s[at], 0.0, w)

    for _ in range(epochs):
        for feats, values, y in rows:
            at, v = np.append(feats, dim), np.append(values, 1.0)
            w = weights(at)
            p = _softmax(v @ w)
            p[y] -= 1.0
            g = v[:, None] * p[None]
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[at] = nn + g * g
    w = weights(np.arange(dim + 1))
    return w[:dim], w[dim]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden section."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fold_of(doc_id: Column) -> Column:
    """Remainder modulo 3 of the CRC-32 of the id as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document frequencies of one task, as one row of bytes."""
    df, n = np.zeros(DIM, np.int64), 0
    for b in batches:
        for text in b["text"]:
            c = folded(text)
            if len(c):
                seen = np.zeros(DIM, bool)
                for f in grams(c):
                    seen[f] = True
                df += seen
                n += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(df[at], n)})


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        feats, counts = [], []
        for text in b["text"]:
            parts = [np.unique(f, return_counts=True) for f in grams(folded(text))]
            f = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
            c = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            u, inv = np.unique(f, return_inverse=True)
            feats.append(u.astype(np.int32))
            counts.append(np.bincount(inv, weights=c, minlength=len(u)).astype(np.float32))
        yield pd.DataFrame({"lang": b["lang"], "key": b["key"], "feats": feats, "counts": counts})


def _fit(langs: list[str], idf: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        data = []
        for lang, feats, counts in zip(rows["lang"], rows["feats"], rows["counts"]):
            f, c = np.asarray(feats, np.int64), np.asarray(counts, np.float64)
            if len(f):
                data.append((f, c / c.sum() * idf[f] * SCALE, langs.index(lang)))
        kept = [r for k, r in enumerate(data) if k % 5]
        aside = [r for k, r in enumerate(data) if k % 5 == 0]
        w, bias = ftrl(kept, len(langs))
        logits = np.array([v @ w[f] + bias for f, v, _ in aside]).reshape(-1, len(langs))
        t = temperature(logits, np.array([y for _, _, y in aside], int))
        return pd.DataFrame({"weights": [w.astype(np.float32).tobytes()],
                             "bias": [bias.astype(np.float64).tobytes()], "temperature": [t]})
    return run


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model from the rows whose text and lang are not null and whose id is in fold 0 or 2.

    Document frequencies are taken over all of those rows. Weights come from at most ``per_lang``
    rows of each language, chosen by a hash of the row. No labelled row gives a model that knows
    no language. What reaches the driver: the languages with their counts, ``DIM`` document
    frequencies, and the weights.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    train = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()
                        & (fold_of(F.col("doc_id")) != 1)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model()
    df, n = np.zeros(DIM), 0
    for r in (train.select("text").mapInPandas(_frequencies, "feature int, n long")
              .groupBy("feature").agg(F.sum("n").alias("n")).collect()):
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    # a hash threshold per language brings the rows near the bound before any text is moved
    unit = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, 1.2 * per_lang / sizes[lang])).otherwise(share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "key"))
    sample = (train.withColumn("unit", unit).filter(F.col("unit") < share)
              .select("lang", "text", "unit", key.alias("key"))
              .withColumn("r", rank).filter(F.col("r") <= per_lang)
              .select("lang", "key", "text")
              .mapInPandas(_sparse, "lang string, key string, feats array<int>, counts array<float>"))
    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _fit(langs, idf), "weights binary, bias binary, temperature double").first()
    if got is None:
        return Model()
    weights = np.frombuffer(got["weights"], np.float32).reshape(DIM, len(langs)) * idf[:, None]
    return Model(langs, weights.astype(np.float32), np.frombuffer(got["bias"], np.float64), got["temperature"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, key, lang_pred, score`` for every row, from its text alone.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows get equal
    results; ties of probability go to the language first in sorted order; other columns are
    not read; an empty table gives an empty one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [model.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"],
                                "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return rows.mapInPandas(run, "doc_id long, key string, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs)).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or predicted with a score below
    ``min_score``. All columns stay."""
    bad = landed(predict(docs, fit(docs)).filter((F.col("lang_pred") == UNDETERMINED)
                                                 | (F.col("score") < min_score)).select("key").distinct(), "lang-bad")
    bad = small(bad, bad.count() * 4)          # within the bound no text has to move
    held = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return held.join(bad, "key", "left_anti").select("row.*")
