"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Each byte has a learned vector, learned
filters slide over the chunk, and each filter's largest answer in the chunk is kept. Mean and maximum of these over the
chunks of the document go through one hidden layer to one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import fold, text_bytes
from concord.llm.wordids import release

CHUNKS_AT_ONCE = 128


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and of the fit. The fit reads at most ``per_class`` labelled texts of each class, each of at
    most ``longest`` bytes: this bound is the only one, scoring reads every text whole."""

    chunk: int = 512
    overlap: int = 32
    vector: int = 8
    width: int = 12
    step: int = 4
    filters: int = 32
    hidden: int = 16
    per_class: int = 1200
    longest: int = 32_768
    rounds: int = 12
    batch: int = 48
    rate: float = 0.004
    seed: int = 7


@dataclass
class Network:
    """Weights by name; ``prior`` is the logit shift from the balanced fit to the share of the classes."""

    shape: Shape
    weights: dict[str, np.ndarray]

    def score(self, data: bytes) -> float:
        """Probability of label 1 for a whole text, in memory that doesn't grow with it (but for the bytes)."""
        return float(self.scores([data])[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of several texts, a bounded number of chunks at a time."""
        total = np.zeros((len(texts), self.shape.filters), dtype=np.float64)
        most = np.zeros((len(texts), self.shape.filters), dtype=np.float32)
        counts = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if owner:
                pooled = self.pooled(np.stack(held))
                np.add.at(total, owner, pooled)
                np.maximum.at(most, owner, pooled)
                held.clear()
                owner.clear()

        for i, data in enumerate(texts):
            raw = np.frombuffer(data, dtype=np.uint8)
            for start in chunk_starts(len(raw), self.shape):
                part = raw[start : start + self.shape.chunk]
                held.append(part if len(part) == self.shape.chunk else np.pad(part, (0, self.shape.chunk - len(part))))
                owner.append(i)
                counts[i] += 1
                if len(owner) == CHUNKS_AT_ONCE:
                    flush()
        flush()
        mean = (total / counts[:, None]).astype(np.float32)
        return self.head(np.concatenate((mean, most), axis=1))[0]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        s = self.shape
        vectors = self.weights["byte"][chunks]
        places = (s.chunk - s.width) // s.step + 1
        a, b, c = vectors.strides
        view = np.lib.stride_tricks.as_strided(
            vectors, (len(chunks), places, s.width * s.vector), (a, s.step * b, c), writeable=False
        )
        return view.reshape(-1, s.width * s.vector)

    def answers(self, windows: np.ndarray, chunks: int) -> np.ndarray:
        return (windows @ self.weights["filter"]).reshape(chunks, -1, self.shape.filters)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        top = self.answers(self.windows(chunks), len(chunks)).max(axis=1)
        return np.maximum(top + self.weights["filter_bias"], 0)

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        hidden = np.tanh(features @ w["hidden"] + w["hidden_bias"])
        logit = hidden @ w["out"] + w["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40))), hidden


def chunk_starts(length: int, shape: Shape) -> range:
    """Starts of the chunks that cover ``length`` bytes; an empty text has one chunk."""
    step = shape.chunk - shape.overlap
    return range(0, max(1, length - shape.overlap), step)


def fit(texts: list[bytes], labels: list[int], shape: Shape = Shape()) -> Network:
    """Fits the network by gradient descent (Adam) on the logistic loss, classes weighted alike.

    One class alone, or no text, leaves the constant answer of that class (0.5 without any text).
    """
    rng = np.random.default_rng(shape.seed)
    wide = shape.width * shape.vector
    draw = lambda *size, scale: rng.normal(0, scale, size).astype(np.float32)
    net = Network(
        shape,
        {
            "byte": draw(256, shape.vector, scale=0.5),
            "filter": draw(wide, shape.filters, scale=wide**-0.5),
            "filter_bias": np.zeros(shape.filters, np.float32),
            "hidden": draw(2 * shape.filters, shape.hidden, scale=(2 * shape.filters) ** -0.5),
            "hidden_bias": np.zeros(shape.hidden, np.float32),
            "out": draw(shape.hidden, scale=shape.hidden**-0.5),
            "out_bias": np.zeros(1, np.float32),
        },
    )
    y = np.asarray(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        net.weights["out"][:] = 0
        net.weights["out_bias"][:] = 0 if not len(y) else (6 if y[0] else -6)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    cut = [_chunks(t, shape) for t in texts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    steps, total = 0, shape.rounds * -(-len(y) // shape.batch)
    for _ in range(shape.rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(order), shape.batch):
            steps += 1
            rate = shape.rate * (1 - (steps - 1) / total)
            _step(net, [cut[i] for i in order[at : at + shape.batch]], y[order[at : at + shape.batch]],
                  weight[order[at : at + shape.batch]], moments, steps, rate, rng)
    return net


def _chunks(data: bytes, shape: Shape) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = chunk_starts(len(raw), shape)
    padded = np.zeros(starts[-1] + shape.chunk, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.stack([padded[a : a + shape.chunk] for a in starts])


def _step(net, docs, y, weight, moments, steps, rate, rng) -> None:
    s, w = net.shape, net.weights
    docs = [d if len(d) <= 12 else d[np.sort(rng.choice(len(d), 12, replace=False))] for d in docs]
    sizes = np.array([len(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), sizes)
    chunks = np.concatenate(docs)
    windows = net.windows(chunks)
    answers = net.answers(windows, len(chunks))
    best = answers.argmax(axis=1)
    top = np.take_along_axis(answers, best[:, None, :], axis=1)[:, 0] + w["filter_bias"]
    pooled = np.maximum(top, 0)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mean = np.add.reduceat(pooled, starts) / sizes[:, None]
    most = np.maximum.reduceat(pooled, starts)
    features = np.concatenate((mean, most), axis=1).astype(np.float32)
    p, hidden = net.head(features)
    g = ((p - y) * weight / len(y)).astype(np.float32)
    g_hidden = np.outer(g, w["out"]) * (1 - hidden**2)
    g_features = g_hidden @ w["hidden"].T
    g_mean, g_most = np.split(g_features, 2, axis=1)
    first = pooled == most[owner]
    g_pooled = (g_mean / sizes[:, None])[owner] + g_most[owner] * first
    g_pooled *= top > 0
    places = answers.shape[1]
    at = (np.arange(len(chunks))[:, None] * places + best).ravel()
    chosen = windows[at].reshape(len(chunks), s.filters, -1)
    g_window = g_pooled[:, :, None] * w["filter"].T[None]
    cells = (best[:, :, None] * s.step + np.arange(s.width)).reshape(len(chunks), -1)
    bytes_ = np.take_along_axis(chunks, cells, axis=1).ravel()
    by_byte = g_window.reshape(-1, s.vector).T
    g_byte = np.stack([np.bincount(bytes_, weights=g, minlength=256) for g in by_byte], axis=1).astype(np.float32)
    grads = {
        "byte": g_byte,
        "filter": np.einsum("cf,cfk->kf", g_pooled, chosen),
        "filter_bias": g_pooled.sum(axis=0),
        "hidden": features.T @ g_hidden + 1e-4 * w["hidden"],
        "hidden_bias": g_hidden.sum(axis=0),
        "out": hidden.T @ g + 1e-4 * w["out"],
        "out_bias": np.array([g.sum()], np.float32),
    }
    for name, grad in grads.items():
        m, v = moments[name]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w[name] -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)


# ---- Spark


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", shape: Shape = Shape(),
          id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> Network:
    """Learns ``label`` from a bounded sample: of each class the ``per_class`` labelled documents with the smallest hash of
    the id, outside fold 0 of ``folds``, with texts up to ``longest`` bytes.

    Null ids, null labels and ids with contradicting labels teach nothing; repeated labels and rows count once.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & (fold(F.col(id_col), folds) != 0))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("other"))
        .where("id IS NOT NULL AND y = other")
    )
    order = F.xxhash64(F.lit(shape.seed), "id")
    # Twice as many labels as texts, for labels without a document or with one above the bound.
    pick = known.where("y = 0").orderBy(order, "id").limit(2 * shape.per_class).select("id", "y")
    pick = pick.union(known.where("y = 1").orderBy(order, "id").limit(2 * shape.per_class).select("id", "y"))
    body = text_bytes(F.col(text_col))
    texts = docs.where(F.octet_length(body) <= shape.longest).select(F.col(id_col).alias("id"), body.alias("body"))
    found = texts.join(F.broadcast(pick), "id").groupBy("id", "y").agg(F.min("body").alias("body"))
    rows = sorted(found.select("y", order.alias("order"), "id", "body").collect(), key=lambda r: (r.order, r.id))
    rows = [r for y in (0, 1) for r in [x for x in rows if x.y == y][: shape.per_class]]
    return fit([bytes(r.body) for r in rows], [r.y for r in rows], shape)


def score_column(net: Network, text: Column) -> Column:
    """Probability of label 1 for a whole text; null counts as empty."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        release()  # a worker may come from a stage that encodes
        out = np.empty(len(texts))
        for at in range(0, len(texts), 64):
            part = [x.as_py() for x in texts.slice(at, 64)]
            out[at : at + len(part)] = net.scores(part)
        return pa.array(out)

    return of(text_bytes(text))


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3,
             folds: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score and predicted (1 from ``least`` on).

    Null and empty texts get the score of an empty text; repeated rows stay; an empty table gives no rows; other columns
    are not looked at.
    """
    scored = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(F.col(id_col), folds) == 0).alias("held_out"),
        score_column(net, F.col(text_col)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the network doesn't reject, columns unchanged."""
    return docs.where(score_column(net, F.col(text_col)) >= least)
