"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads bytes in both directions, labels every position, and a document's probabilities are
the mean over all its positions. It is trained in numpy by backpropagation through time on a bounded
sample of labelled, distinct texts (``TRAIN_ROWS``), dealt over the languages and in each the first by hash;
prediction reads whole texts, cut into chunks that are run side by side.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every text when no
labelled row can be learned from; a null label is not learned from; rows are independent, so repeated rows
repeat; an empty table gives no rows; other input columns are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutledger.llm import common as cm

TRAIN_ROWS, CHUNK, LANES = 3000, 96, 512
HIDDEN, STEPS, BATCH, RATE = 8, 160, 64, 0.03
UNKNOWN = "und"
#: Bytes of text read from a batch at a time.
ROOM = 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    """Piecewise-linear gate: ``x`` within 0 and 1, in place."""
    return np.minimum(np.maximum(x, 0, out=x), 1, out=x)


def inner(x: np.ndarray) -> np.ndarray:
    """``x`` within -1 and 1, in place."""
    return np.minimum(np.maximum(x, -1, out=x), 1, out=x)


@dataclass
class Network:
    """Per direction: byte table (3H, 256), recurrent weights (3H, H); output (L, 2H) and bias (L, 1)."""

    tables: list[np.ndarray]
    loops: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    langs: list[str]

    @property
    def hidden(self) -> int:
        return self.loops[0].shape[1]

    def params(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, self.out, self.bias]


def start(langs: list[str], hidden: int, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    gates = np.repeat(np.float32([0.5, 0]), [2 * hidden, hidden])[:, None]
    return Network([draw(3 * hidden, 256, scale=0.2) + gates for _ in "ab"], [draw(3 * hidden, hidden, scale=0.3 / hidden**0.5) for _ in "ab"],
                   draw(len(langs), 2 * hidden, scale=0.3), np.zeros((len(langs), 1), np.float32), langs)


def sweep(table: np.ndarray, loop: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, B) of one direction over byte steps (T, B); ``keep`` gets what backpropagation needs."""
    n = loop.shape[1]
    h = np.zeros((n, steps.shape[1]), np.float32)
    states = np.empty((len(steps), *h.shape), np.float32)
    room, steps = np.empty((3 * n, steps.shape[1]), np.float32), steps.astype(np.intp)
    for t in range(len(steps)):
        x = table.take(steps[t], axis=1, out=None if keep is not None else room, mode="clip")
        zr = x[: 2 * n]
        zr += loop[: 2 * n] @ h
        unit(zr)
        c = x[2 * n :]
        c += loop[2 * n :] @ (zr[n:] * h)
        inner(c)
        if keep is not None:
            keep.append((zr[:n], zr[n:], c, h))
        step = np.subtract(c, h, out=states[t])
        step *= zr[:n]
        step += h
        h = step
    return states


def unroll(loop: np.ndarray, steps: np.ndarray, keep: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of byte table and recurrent weights by backpropagation through time."""
    n = loop.shape[1]
    d_table, d_loop = np.zeros((256, 3 * n), np.float32), np.zeros_like(loop)
    dh = np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(steps) - 1, -1, -1):
        z, r, c, h = keep[t]
        dh = dh + d_states[t]
        dc = dh * z * (np.abs(c) < 1)
        d_rh = loop[2 * n :].T @ dc
        dx = np.concatenate([dh * (c - h) * ((z > 0) & (z < 1)), d_rh * h * ((r > 0) & (r < 1)), dc])
        np.add.at(d_table, steps[t], dx.T)
        d_loop[: 2 * n] += dx[: 2 * n] @ h.T
        d_loop[2 * n :] += dc @ (r * h).T
        dh = dh * (1 - z) + d_rh * r + loop[: 2 * n].T @ dx[: 2 * n]
    return d_table.T, d_loop


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the second axis of (T, L, B), in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def probabilities(net: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """(T, L, B) from the states of both directions, the second one in reading order."""
    n = net.hidden
    p = np.matmul(net.out[:, :n], ahead)
    p += np.matmul(net.out[:, n:], back)
    p += net.bias
    return softmax(p)


def gradients(net: Network, steps: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients where every live position of (T, B) steps should carry its chunk's label."""
    ahead_kept, back_kept = [], []
    ahead = sweep(net.tables[0], net.loops[0], steps, ahead_kept)
    back = sweep(net.tables[1], net.loops[1], steps[::-1], back_kept)[::-1]
    p = probabilities(net, ahead, back)
    want = np.eye(len(net.langs), dtype=np.float32)[:, label]
    weight = (live / max(1, live.sum())).astype(np.float32)[:, None, :]
    loss = float(-(np.log(np.maximum((p * want).sum(axis=1, keepdims=True), 1e-9)) * weight).sum())
    d = (p - want) * weight
    n = net.hidden
    d_ahead, d_back = np.matmul(net.out[:, :n].T, d), np.matmul(net.out[:, n:].T, d)
    ta, la = unroll(net.loops[0], steps, ahead_kept, d_ahead)
    tb, lb = unroll(net.loops[1], steps[::-1], back_kept, d_back[::-1])
    d_out = np.matmul(d, np.concatenate([ahead, back], axis=1).transpose(0, 2, 1)).sum(axis=0)
    return loss, [ta, tb, la, lb, d_out, d.sum(axis=(0, 2))[:, None]]


def chunks(text: bytes, size: int) -> np.ndarray:
    """Rows of ``size`` bytes, the last one filled with zero bytes."""
    n = -(-len(text) // size)
    return np.frombuffer(text.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def train(rows: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, rate: float = RATE, size: int = CHUNK) -> Network | None:
    """Learn from ``(passage, language)`` rows; None when there are none."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    net = start(langs, hidden)
    x = np.concatenate([chunks(t[:size], size) for t, _ in rows])
    y = np.array([langs.index(lang) for _, lang in rows])
    rng = np.random.default_rng(11)
    params = net.params()
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    per_round = -(-len(y) // BATCH)
    rounds = -(-steps // per_round)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a : a + BATCH]
            read = np.ascontiguousarray(x[pick].T)
            _, grads = gradients(net, read, read > 0, y[pick])
            step += 1
            lr = rate * (1 - (step - 1) / (rounds * per_round)) + 1e-4
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def predict(net: Network, texts: list[bytes], size: int = CHUNK, lanes: int = LANES) -> np.ndarray:
    """Mean probability of each language over all positions of each text."""
    total = np.zeros((len(texts), len(net.langs)))
    pending, owners, held = [], [], 0

    def flush() -> None:
        nonlocal pending, owners, held
        x, owner = np.concatenate(pending), np.concatenate(owners)
        for a in range(0, len(x), lanes):
            steps = np.ascontiguousarray(x[a : a + lanes].T)
            ahead = sweep(net.tables[0], net.loops[0], steps)
            back = sweep(net.tables[1], net.loops[1], steps[::-1])[::-1]
            p = probabilities(net, ahead, back)
            p *= (steps > 0)[:, None, :]
            np.add.at(total, owner[a : a + lanes], p.sum(axis=0).T)
        pending, owners, held = [], [], 0

    for k, text in enumerate(texts):
        if text:
            for a in range(0, len(text), size * lanes):
                part = chunks(text[a : a + size * lanes], size)
                pending.append(part)
                owners.append(np.full(len(part), k))
                held += len(part)
            if held >= lanes:
                flush()
    if pending:
        flush()
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def held_out(key) -> F.Column:
    """Rows that are never learned from: crc32 of the decimal ``doc_id`` leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, max_rows: int = TRAIN_ROWS, size: int = CHUNK) -> Network | None:
    """Train on at most ``max_rows`` distinct labelled texts, a share for each language; a passage of each is learned."""
    mix = F.xxhash64("text")
    room = F.greatest(F.length("text") - size, F.lit(0)) + 1
    learn = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sample = learn.select(
        mix.alias("h"), F.col("lang").cast("string").alias("g"), F.substring(F.col("text"), F.pmod(F.xxhash64("text", F.lit(1)), room).cast("int") + 1, F.lit(size)).alias("part"))
    # Copies of a text are one row, whatever their number; a text under several labels keeps its first.
    distinct = sample.groupBy("h").agg(F.min(F.struct("g", "part")).alias("one")).select("h", "one.g", "one.part")
    return train([(r["part"].encode()[:size], r["g"]) for r in cm.least_hashes(distinct, max_rows)], size=size)


def judged(net: Network | None, texts: pa.Array, letters: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``letters`` says which have one."""
    made = [t if has else None for t, has in zip(texts.to_pylist(), letters.to_pylist(), strict=True)]
    if net is None:
        return [UNKNOWN] * len(made), [0.0] * len(made)
    p = predict(net, [(t or "").encode() for t in made])
    langs = [net.langs[i] if t is not None else UNKNOWN for i, t in zip(p.argmax(axis=1), made, strict=True)]
    return langs, [float(min(1.0, s)) if t is not None else 0.0 for s, t in zip(p.max(axis=1, initial=0), made, strict=True)]


def with_letters() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of every whole text."""
    cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            *kept, texts, letters = got.columns
            for a, b in cm.slices(texts, ROOM):
                langs, scores = judged(net, texts.slice(a, b - a), letters.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[*got.schema.names[:-2], "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text"), with_letters().alias("__letters")).mapInArrow(run, ", ".join([*cols, "lang_pred string", "score double"]))


def told(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The rows of ``docs``, as they are, whose language gets ``least`` of their positions; null text and text without a letter go.

    Every text travels once, and a few megabytes of a batch are read at a time. Without a network no language can be told, so no row stays.
    """
    cm.small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = pa.RecordBatch.from_arrays(got.columns[:-1], names=names)
            for a, b in cm.slices(rows.column(at), ROOM):
                langs, scores = judged(net, rows.column(at).slice(a, b - a), got.column(len(names)).slice(a, b - a))
                yield rows.slice(a, b - a).filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.select(*[F.col(f"`{n}`") for n in names], with_letters().alias("__letters")).mapInArrow(cm.frugal(run), docs.schema)
