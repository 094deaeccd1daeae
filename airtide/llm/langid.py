"""Language identification by multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams per language on the executors over a bounded sample of labelled rows and returns a small
log-probability matrix; ``predict`` broadcasts that matrix and scores whole texts in numpy batches.

Defined results: a null text, an empty text and a text without any letter give ``und`` with score 0. Repeated rows
get equal results, a null id is passed through, an empty table gives no rows. Ties go to the language that sorts first.
If no labelled row exists, everything is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_texts, small_batches

#: Documented bound of the training sample, in documents (expected size; chosen by a hash of the id).
SAMPLE_DOCS = 20_000
#: 2**BITS hashed features.
BITS = 16
#: Code points that are scored at once.
CHUNK = 400_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_DIM = 1 << BITS
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _pieces(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[list[int], str, list[int]]]:
    """Groups of (row numbers, joined text, where each begins); a text longer than ``limit`` is cut with an overlap of two."""
    rows: list[int] = []
    parts: list[str] = []
    starts: list[int] = []
    at = 0
    for row, text in enumerate(texts):
        for begin in range(0, max(len(text), 1), limit):
            part = text[max(0, begin - 2) : begin + limit]
            if at and at + len(part) > limit:
                yield rows, "\0\0".join(parts), starts
                rows, parts, starts, at = [], [], [], 0
            rows.append(row)
            starts.append(at)
            parts.append(part)
            at += len(part) + 2
    if rows:
        yield rows, "\0\0".join(parts), starts


def _features(joined: str) -> np.ndarray:
    """A hashed feature for the bigram and for the trigram at each code point, shape (2, n); n-grams over a text's end get feature 2**BITS."""
    a = np.frombuffer((joined + "\0\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    real = a != 0
    a = np.where(a < 128, _FOLD[np.minimum(a, 127)], a)
    two = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77)
    three = two * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
    out = np.empty((2, len(two)), dtype=np.int32)
    for k, h in enumerate((two, three)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[k] = h >> np.uint32(32 - BITS)
    keep = real[:-2] & real[1:-1]
    out[0][~keep] = _DIM
    out[1][~(keep & real[2:])] = _DIM
    return out


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: (2**BITS + 1, languages); the last row is 0 and stands for no feature.
    log_p: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from the rows with a language; about ``sample_docs`` of them, picked by a hash of the id, whatever the input's size."""
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = rows.where(F.col("lang").isNotNull() & F.col("k").isNotNull() & F.col("text").isNotNull())
    total = known.select("lang", "k").count()
    share = 1 << 20
    if total > sample_docs:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(share)) < int(share * sample_docs / total))
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                into = counts.setdefault(name, np.zeros(_DIM + 1, dtype=np.int64))
                docs_of[name] = docs_of.get(name, 0) + len(group)
                for _, joined, _ in _pieces([t.lower() for t in group["text"]]):
                    into += np.bincount(_features(joined).ravel(), minlength=_DIM + 1)
        for name, c in counts.items():
            at = np.flatnonzero(c[:_DIM])
            yield pd.DataFrame({"lang": name, "feature": np.append(at, -1), "n": np.append(c[at], docs_of[name])})

    found = (
        known.select("lang", "text")
        .mapInPandas(count, "lang string, feature long, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(found["lang"].unique()) if len(found) else []
    log_p = np.zeros((_DIM + 1, len(langs)), dtype=np.float32)
    prior = np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = found[found["lang"] == name]
        prior[k] = own.loc[own["feature"] < 0, "n"].sum()
        own = own[own["feature"] >= 0]
        c = np.full(_DIM, 0.5)
        c[own["feature"].to_numpy()] += own["n"].to_numpy()
        log_p[:_DIM, k] = np.log(c / c.sum())
    return Model(langs, log_p, np.log(prior / prior.sum()) if langs else prior)


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    langs, log_p = model.langs, model.log_p
    clean = ["" if t is None or not _LETTER.search(t) else t.lower() for t in texts]
    total = np.zeros((len(clean), len(langs))) + model.prior
    for rows, joined, starts in _pieces(clean):
        f = _features(joined)
        if not f.shape[1] or not langs:
            continue
        each = log_p[f[0]]
        each += log_p[f[1]]
        np.add.at(total, rows, np.add.reduceat(each, np.minimum(starts, len(each) - 1), axis=0, dtype=np.float64))
    if not langs:
        return [UNKNOWN] * len(clean), np.zeros(len(clean))
    best = total.argmax(axis=1)
    odds = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[b] if t else UNKNOWN for b, t in zip(best, clean)], np.where([bool(t) for t in clean], odds, 0.0)


def predict(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x languages floats, whatever the input's size

    def run(texts: list[str | None]) -> list[list]:
        names, odds = score_texts(texts, shared.value)
        return [names, odds]

    return map_texts(docs, run, "lang_pred string, score double", key=key, text=text)


def language_table(docs: DataFrame) -> DataFrame:
    """The contract's digest: train on ids with crc32 mod 4 other than 2, predict all."""
    fold = fold_of(F.col("doc_id"), 4)
    model = fit(docs.where(fold != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
