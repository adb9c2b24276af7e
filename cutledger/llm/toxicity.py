"""Toxicity scores learned from confirmed toxic examples and unlabelled text, by a non-negative risk estimator.

Texts outside the learning set carry no label here, and those labelled 0 are not used as examples: the learner
knows confirmed toxic texts P and a sample U of all texts, toxic ones included, and the share ``prior`` of toxic texts. Its risk is
``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])``. When a batch makes the second term
negative, which only overfitting can do, the step goes up that term instead of down the sum.

A word's score is the sum of the weights of its hashed features (the word, its first 3 to 6 bytes); a text's logit is a
bias plus the mean of its words' scores, each weighted by the exponential of its own score, so a few toxic words
decide in a text of any length. The threshold is set on texts the weights were not learned from, by the same risk with the zero-one loss,
and is moved to a score of 0.5. Scoring reads whole texts in parts and adds up per text.

Learning takes at most ``MAX_TOXIC`` distinct toxic texts and ``MAX_UNLABELLED`` distinct texts, the first by hash, of
``MAX_CHARS`` code points at most: these bound what reaches the driver. ``prior`` is a statistic of all learnable labels.

Defined cases: a null or wordless text has the score of the bias alone; without a confirmed toxic text every score is the
prior (0 without labels); a document is confirmed toxic if one of its label rows says 1; null labels and null ``doc_id`` are not learned from; rows are scored
one by one, so repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cutledger.llm import common as cm, hashing

MAX_TOXIC, MAX_UNLABELLED, MAX_CHARS = 2000, 6000, 20_000
BITS, PREFIXES, SHARP = 18, (3, 4, 5, 6), 2.0
EPOCHS, BATCH, RATE, DECAY, LEAST_STEPS = 12, 128, 0.15, 1e-4, 200
SEGMENT = 1 << 21
#: Letters and digits of ASCII, and all bytes of other characters, make up words.
IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LEAST_PRIOR, MOST_PRIOR = 0.001, 0.9


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the decimal ``doc_id`` is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bytes, owner of each byte)`` of lower-cased texts, about ``SEGMENT`` bytes at a time, cut between words."""
    data, owner, held = [], [], 0
    for i, text in enumerate(texts):
        raw = np.frombuffer(((text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
        at = 0
        while at < len(raw):
            end = at + SEGMENT - held
            if end < len(raw):
                gaps = np.flatnonzero(~IN_WORD[raw[max(at, end) :]])
                end = max(at, end) + int(gaps[0]) + 1
            data.append(raw[at:end])
            owner.append(np.full(len(data[-1]), i, np.int32))
            held, at = held + len(data[-1]), end
            if held >= SEGMENT:
                yield np.concatenate(data), np.concatenate(owner)
                data, owner, held = [], [], 0
    if data:
        yield np.concatenate(data), np.concatenate(owner)


def word_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features of each different word, which of them each word is, start of each word)``."""
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    prefix = hashing.running(data)
    _, first, which = np.unique(hashing.substrings(prefix, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first], ends[first]
    columns = [hashing.substrings(prefix, a, np.minimum(b, a + n)) if n else hashing.substrings(prefix, a, b) for n in (0, *PREFIXES)]
    salted = [hashing.pair(np.full(len(c), j + 1, np.uint64), c) >> np.uint64(64 - BITS) for j, c in enumerate(columns)]
    return np.stack(salted, axis=1).astype(np.int32) if len(a) else np.zeros((0, len(columns)), np.int32), which, starts


@dataclass
class Model:
    """Weights of the hashed features, the bias, and the logit that stands for a score of 0.5."""

    weights: np.ndarray
    bias: float
    middle: float


def pooled(model: Model, texts: list[str | None]) -> np.ndarray:
    """Logit of every whole text."""
    top, bottom = np.zeros(len(texts)), np.zeros(len(texts))
    for data, owner in parts(texts):
        features, which, starts = word_features(data)
        if len(starts):
            s = np.clip(model.weights[features].sum(axis=1), -20, 20)[which]
            e = np.exp(SHARP * s)
            who = owner[starts]
            top += np.bincount(who, e * s, len(texts))
            bottom += np.bincount(who, e, len(texts))
    return model.bias + top / np.maximum(bottom, 1e-300)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    return sigmoid(pooled(model, texts) - model.middle)


class Sample:
    """Features of the words of learning texts, by text."""

    def __init__(self, texts: list[str]):
        found = [word_features(np.frombuffer((t.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)) for t in texts]
        self.features = [f[w] for f, w, _ in found]

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(features, owner)`` of all words of some texts."""
        return np.concatenate([self.features[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(self.features[r]) for r in rows])


def forward(weights: np.ndarray, bias: float, features: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits of ``n`` texts and the derivative of each by its words' scores."""
    s = np.clip(weights[features].sum(axis=1), -20, 20)
    e = np.exp(SHARP * s)
    share = e / np.maximum(np.bincount(owner, e, n), 1e-300)[owner]
    mean = np.bincount(owner, share * s, n)
    return bias + mean, share * (1 + SHARP * (s - mean[owner]))


def train(toxic: list[str], unlabelled: list[str], prior: float, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Minimise the non-negative risk by momentum on batches of texts of P and of U.

    All weights share one step size, the rate over the largest gradient: a step of its own for each would let the rare
    words of single texts grow as fast as those that toxic texts have in common.
    """
    rng = np.random.default_rng(seed)
    p, u = Sample(toxic), Sample(unlabelled)
    # A fifth of the texts sets the threshold only; with a handful of texts all do both.
    order = [rng.permutation(len(toxic)), rng.permutation(len(unlabelled))]
    cut = [len(o) // 5 if len(o) >= 25 else 0 for o in order]
    (p_rest, p_own), (u_rest, u_own) = ((o[:c] if c else o, o[c:]) for o, c in zip(order, cut, strict=True))
    weights, bias = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    first, largest, b1, b2 = np.zeros_like(weights), 0.0, 0.0, 0.0
    steps = max(LEAST_STEPS, epochs * -(-len(u_own) // BATCH))
    for step in range(1, steps + 1):
        rows_p, rows_u = rng.choice(p_own, min(BATCH, len(p_own)), replace=False), rng.choice(u_own, min(BATCH, len(u_own)), replace=False)
        fp, op = p.batch(rows_p)
        fu, ou = u.batch(rows_u)
        zp, dp = forward(weights, bias, fp, op, len(rows_p))
        zu, du = forward(weights, bias, fu, ou, len(rows_u))
        # Logistic losses: log(1 + exp(-z)) as positive, log(1 + exp(z)) as negative; their derivatives by z.
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
        if negative < 0:
            gu, gp = -gu, -gp
        else:
            gp = gp - prior * (1 - sigmoid(zp)) / len(zp)
        words = np.concatenate([gp[op] * dp, gu[ou] * du])
        flat = np.concatenate([fp, fu])
        g = np.bincount(flat.reshape(-1), np.repeat(words, flat.shape[1]), len(weights))
        gb = gp.sum() + gu.sum()
        rate = RATE * (1 - (step - 1) / steps) + 1e-4
        first += 0.1 * (g - first)
        largest += 0.05 * (np.abs(g).max() - largest)
        b1, b2 = b1 + 0.1 * (gb - b1), b2 + 0.05 * (abs(gb) - b2)
        fix1, fix2 = 1 - 0.9**step, 1 - 0.95**step
        weights -= rate * ((first / fix1) / (largest / fix2 + 1e-12) + DECAY * weights)
        bias -= rate * (b1 / fix1) / (b2 / fix2 + 1e-12)
    logit = lambda s, rows: forward(weights, bias, *s.batch(rows), len(rows))[0]
    return Model(weights, bias, threshold(logit(p, p_rest), logit(u, u_rest), prior))


def threshold(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The middle of the widest gap between texts, of the logits within one standard error of the least zero-one risk.

    One in 50 more toxic texts than at the least risk may be missed for a wider gap, so a single odd example doesn't set it.
    """
    cuts = np.unique(np.concatenate([toxic, unlabelled]))
    edges = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    above = lambda z: 1 - np.searchsorted(np.sort(z), edges) / len(z)
    missed, wrong = 1 - above(toxic), above(unlabelled) - prior * above(toxic)
    risk = prior * missed + np.maximum(0, wrong)
    slack = (prior * (1 - prior) / len(unlabelled)) ** 0.5
    best = np.flatnonzero((risk <= risk.min() + slack) & (missed <= missed[risk.argmin()] + 0.02))
    gaps = np.concatenate([[0], np.diff(cuts), [0]])
    return float(edges[best[np.argmax(gaps[best])]])


def sample_texts(docs: DataFrame, hashes: DataFrame, bound: int) -> list[str]:
    """The texts of the first ``bound`` distinct ``h`` of ``hashes``."""
    spark = docs.sparkSession
    picked = [(r["h"],) for r in cm.least_hashes(hashes.select("h", F.lit(0).alias("g")).distinct(), bound)]
    near = F.broadcast(spark.createDataFrame(picked, "h long"))  # bound rows at most
    rows = docs.select(F.xxhash64("text").alias("h"), "text").where(F.col("text").isNotNull())
    return [r["text"] for r in rows.join(near, "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()]


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED, max_chars: int = MAX_CHARS) -> tuple[Model | None, float]:
    """The classifier (None without a toxic example) and the prior, learned from rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None, 0.0
    learn = docs.where(F.col("text").rlike(r"[\p{L}\p{N}]") & (F.length("text") <= max_chars) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    hashes = cm.saved(learn.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).agg(F.count("*").alias("n")))
    toxic = sample_texts(learn, hashes.join(known.where("toxic = 1"), "doc_id"), max_toxic)
    if not toxic:
        return None, float(prior)
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, float(prior)))
    return train(toxic, sample_texts(learn, hashes, max_unlabelled), prior), prior


def score(docs: DataFrame, model: Model | None, prior: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            texts = got.column(2)
            for a, b in cm.slices(texts, SEGMENT):
                made = scores(model, texts.slice(a, b - a).to_pylist()) if model is not None else np.full(b - a, prior)
                yield pa.RecordBatch.from_arrays([got.column(0).slice(a, b - a), got.column(1).slice(a, b - a), pa.array(made), pa.array((made >= 0.5).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``docs`` and ``labels`` and score every row of ``docs``."""
    return score(docs, *fit(docs, labels))
