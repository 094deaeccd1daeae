"""Toxicity by a linear-chain conditional random field over the words of a text.

``fit`` takes a bounded sample of labelled documents and
1. finds words that mark toxic documents (likelihood ratio above what chance gives among so many words),
2. labels tokens: such a word in a toxic document is offending, any other token is not,
3. trains the field on windows around all such words, equal ones together, documents with many of them counting no more
   than others: a weight for each marking word, one for all other words, transitions,
4. calibrates document scores by a logistic curve over the chance that any token offends.

``score`` broadcasts the field, whose words are those of the bounded sample, and runs forward-backward over whole texts.
Runs of words without a weight of their own have one transfer matrix, whose powers stand for the runs, so the marginals
are those of the full chain. A token whose marginal is at least one half is an offending span, in code points of the text,
whatever the document's own score.

Defined results: null and empty texts have no token and get the score of a text without marking words. Repeated rows get
equal results, null ids pass through and are never held out, an empty table gives no rows. Several labels of one id count
as toxic if one is. Without usable labels every score is 0; where no word marks toxic documents every score is the same,
below one half.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_texts, small_batches, stored

#: Documented bound of the training sample, in labelled documents (expected; picked by a hash of the id).
SAMPLE_DOCS = 20_000
MIN_DOCS = 3
#: Tokens on either side of a training window's middle.
REACH = 5
#: Windows of a document that count whole; those of one with more share that much, so that no document outweighs many.
EACH = 8
STEPS = 150

_TOKEN = re.compile(r"[^\W\d_]+")


def _document(marginals: np.ndarray) -> np.ndarray:
    """What a document's marginals come to: 1, logit of the chance that any token offends, log of one more than their sum."""
    any_ = -np.expm1(np.log1p(-np.minimum(marginals, 1 - 1e-12)).sum())
    any_ = min(max(any_, 1e-6), 1 - 1e-6)
    return np.array([1.0, math.log(any_ / (1 - any_)), math.log1p(marginals.sum())])


@dataclass
class Field:
    """Log-weights of the states (0 clean, 1 offending)."""

    #: Of state 1, by word.
    words: dict[str, float] = field(default_factory=dict)
    other: float = -8.0
    #: Of a step from row to column.
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Score = 1 / (1 + exp(-(bias + by_any * logit(any) + by_sum * log(1 + sum)))).
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self._runs: dict[int, np.ndarray] = {}

    def run(self, n: int) -> np.ndarray:
        """Transfer over n words without a weight of their own, scaled."""
        found = self._runs.get(n)
        if found is None:
            if len(self._runs) > 4096:
                self._runs.clear()
            one = np.exp(self.step) * np.exp([0.0, self.other])
            m = np.linalg.matrix_power(one / np.linalg.eigvals(one).real.max(), n)
            found = self._runs[n] = m / m.sum()
        return found

    def marginals(self, at: list[int], weights: list[float], n: int) -> np.ndarray:
        """P(offending) of the tokens at these positions of a text of n tokens."""
        into, ahead = np.exp(self.step), []
        left = np.array([1.0, 0.0]) @ self.run(at[0])  # before the text: clean
        for k, w in enumerate(weights):
            f = (left @ into) * (1.0, math.exp(min(w, 50.0)))
            f /= f.sum()
            ahead.append(f)
            left = f @ self.run(at[k + 1] - at[k] - 1) if k + 1 < len(at) else f
        out = np.empty(len(at))
        back = self.run(n - 1 - at[-1]) @ np.ones(2)
        for k in range(len(at) - 1, -1, -1):
            p = ahead[k] * back
            out[k] = p[1] / p.sum()
            if k:
                back = self.run(at[k] - at[k - 1] - 1) @ (into @ (back * (1.0, math.exp(min(weights[k], 50.0)))))
                back /= back.sum()
        return out

    def judge(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """(marginals, token numbers) of the tokens with a weight of their own, in a whole text."""
        if not text:
            return np.empty(0), []
        tokens = [t.lower() for t in _TOKEN.findall(text)]
        words = self.words
        at = [i for i, t in enumerate(tokens) if t in words]
        if not at:
            return np.empty(0), []
        return self.marginals(at, [words[tokens[i]] for i in at], len(tokens)), at

    def score(self, marginals: np.ndarray) -> float:
        x = self.curve @ _document(marginals)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, marginal) of offending tokens, in code points of the text."""
        return self.offending(text, *self.judge(text))

    def offending(self, text: str | None, p: np.ndarray, at: list[int]) -> list[tuple[int, int, float]]:
        """The same from what ``judge`` found."""
        chance = {i: x for i, x in zip(at, p) if x >= 0.5}
        if not chance:
            return []
        found = enumerate(_TOKEN.finditer(text))
        return [(m.start(), m.end(), float(chance[i])) for i, m in found if i in chance]


def _marking(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """Words whose document counts (in toxic, in clean) speak for toxicity beyond chance."""

    def g2(a: int, b: int) -> float:
        n, out = toxic + clean, 0.0
        for seen, row, col in ((a, a + b, toxic), (b, a + b, clean), (toxic - a, n - a - b, toxic), (clean - b, n - a - b, clean)):
            if seen:
                out += 2 * seen * math.log(seen * n / (row * col))
        return out

    limit = 2 * math.log(max(len(counts), 2)) + 3
    found = [(g2(a, b), w) for w, a, b in counts if a * clean > 4 * b * toxic and a >= MIN_DOCS]
    return [w for g, w in sorted(found, key=lambda x: (-x[0], x[1])) if g >= limit]


def _trained(windows: np.ndarray, labels: np.ndarray, times: np.ndarray, words: list[str]) -> Field:
    """Maximum likelihood with a small penalty. ``windows``: word number from 1, 0 another word, -1 padding; ``labels``: 0 or 1; ``times`` each occurs."""
    n, length = windows.shape
    every = np.broadcast_to(times[:, None], windows.shape)
    weight = np.zeros(len(words) + 1)  # the first is for other words
    weight[0] = -2.0
    step = np.zeros((2, 2))
    real = windows >= 0
    ids = np.maximum(windows, 0)
    seen_w = np.bincount(ids[real], weights=(labels * every)[real], minlength=len(weight))
    follow = real[:, 1:] & real[:, :-1]
    seen_s = np.zeros((2, 2))
    np.add.at(seen_s, (labels[:, :-1][follow], labels[:, 1:][follow]), every[:, 1:][follow])
    moments = [np.zeros(len(weight) + 4), np.zeros(len(weight) + 4)]
    for turn in range(1, STEPS + 1):
        e = np.ones((n, length, 2))
        e[:, :, 1] = np.exp(np.clip(weight[ids], -30, 30))
        t = np.exp(step)
        ahead, back = np.empty_like(e), np.ones_like(e)
        ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, length):
            f = (ahead[:, i - 1] @ t) * e[:, i]
            ahead[:, i] = np.where(real[:, i, None], f / f.sum(axis=1, keepdims=True), ahead[:, i - 1])
        for i in range(length - 2, -1, -1):
            f = (back[:, i + 1] * e[:, i + 1]) @ t.T
            back[:, i] = np.where(real[:, i + 1, None], f / f.sum(axis=1, keepdims=True), 1.0)
        p = ahead * back
        p /= p.sum(axis=2, keepdims=True)
        hope_w = np.bincount(ids[real], weights=(p[:, :, 1] * every)[real], minlength=len(weight))
        pair = ahead[:, :-1, :, None] * t * (e * back)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        hope_s = (pair * every[:, 1:, None, None])[follow].sum(axis=0)
        grad = np.append((seen_w - hope_w) - 0.05 * weight, (seen_s - hope_s - 0.05 * step).ravel())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        move = 0.2 * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
        weight += move[: len(weight)]
        step += move[len(weight) :].reshape(2, 2)
    return Field({w: float(x) for w, x in zip(words, weight[1:])}, float(weight[0]), step)


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression with a small penalty, by Newton steps that are halved until the loss falls.

    The first column is 1. More marginals never make a document less toxic, so columns whose weight would be negative are left out.
    """
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        part, w = x[:, use], np.zeros(int(use.sum()))

        def loss(w: np.ndarray, part: np.ndarray = part) -> float:
            z = part @ w
            return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w)

        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(part @ w, -700, 700)))
            grad = part.T @ (q - y) + ridge * w
            step = np.linalg.solve((part * (q * (1 - q))[:, None]).T @ part + ridge * np.eye(len(w)), grad)
            size, now = 1.0, loss(w)
            while size > 1e-9 and loss(w - size * step) > now - 1e-4 * size * float(grad @ step):
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        out = np.zeros(x.shape[1])
        out[use] = w
        if (out[1:] >= 0).all():
            return out
        use &= out >= 0
        use[0] = True


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Field:
    """Learn from documents with a label; about ``sample_docs`` of them, whatever the input's size."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    total = known.count()
    share = 1 << 20
    if total > sample_docs:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(share)) < int(share * sample_docs / total))
    # The labels to broadcast are about sample_docs rows.
    sample = stored(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select("id", "text", "toxic"), "toxic-sample")
    small_batches(spark)

    def each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {"", *(w.lower() for w in _TOKEN.findall(t or ""))}  # the empty word counts documents
                words += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["w", "y"])

    counts = sample.select("text", "toxic").mapInArrow(each_word, "w string, y int").groupBy("w")
    counts = stored(counts.agg(F.sum(F.expr("int(y > 0)")).alias("a"), F.sum(F.expr("int(y = 0)")).alias("b")), "toxic-words")
    whole = counts.where("w = ''").first()
    if whole is None or not whole["a"]:
        return Field()
    toxic, clean = whole["a"], whole["b"]
    # Words that few toxic documents have, or that clean ones have as often, cannot mark; what is left is small, the sample being bounded.
    kinds = counts.count()
    able = counts.where(f"w <> '' and a >= {MIN_DOCS} and a * {clean} > 4 * b * {toxic}").collect()
    marking = _marking([(r["w"], r["a"], r["b"]) for r in able] + [("", 0, 0)] * max(0, kinds - len(able)), toxic, clean)
    number = {w: k + 1 for k, w in enumerate(marking)}
    size = 2 * REACH + 1

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, labelled, share = [], [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [number.get(w.lower(), 0) for w in _TOKEN.findall(t or "")]
                at = [i for i, x in enumerate(ids) if x]
                middles = at + [len(ids) // 4, 3 * len(ids) // 4] if ids else []
                for m in middles:
                    w = ids[max(0, m - REACH) : m + REACH + 1]
                    found.append(w + [-1] * (size - len(w)))
                    labelled.append([int(bool(y and x > 0)) for x in found[-1]])
                    share.append(EACH / max(EACH, len(middles)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(labelled, pa.list_(pa.int32())), pa.array(share, pa.float64())], names=["x", "y", "n"])

    made = sample.select("text", "toxic").mapInArrow(window_rows, "x array<int>, y array<int>, n double")
    # Equal windows are one row; most hold one marking word, so there are few more than marking words.
    rows = made.groupBy("x", "y").agg(F.sum("n").alias("n")).orderBy("x", "y").collect()
    if not marking or not rows:
        return Field(curve=(min(math.log((toxic + 0.5) / (clean + 0.5)), -0.01), 0.0, 0.0))  # a field that marks nothing rejects nothing
    model = _trained(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["n"] for r in rows], dtype=float), marking)

    def sums(texts: list[str | None]) -> list[list]:
        found = [_document(model.judge(t)[0]) for t in texts]
        return [[f[1] for f in found], [f[2] for f in found]]

    pairs = map_texts(sample.withColumn("y", F.col("toxic")), sums, "u double, v double", key="y", text="text").collect()
    x, y = np.array([(1.0, r["u"], r["v"]) for r in pairs]), np.array([r["y"] for r in pairs], dtype=float)
    curve = _curve(x, y)
    model.curve = tuple(map(float, curve))
    return model


def score(docs: DataFrame, model: Field, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted, spans) for every row; spans are ``start:end`` of offending words, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each marking word of the bounded sample

    def run(texts: list[str | None]) -> list[list]:
        own = shared.value
        judged = [own.judge(t) for t in texts]
        scores = [own.score(p) for p, _ in judged]
        spans = [",".join(f"{a}:{b}" for a, b, _ in own.offending(t, *j)) for t, j in zip(texts, judged)]
        return [scores, [int(s >= 0.5) for s in scores], spans]

    return map_texts(docs, run, "score double, predicted int, spans string", key=key, text=text)


def without_toxic(docs: DataFrame, model: Field, *, text: str = "text") -> DataFrame:
    """The rows whose score is below one half, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each marking word of the bounded sample
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(own.judge(t)[0]) < 0.5 for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: learn from ids with crc32 mod 5 other than 0, score all."""
    model = fit(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")
