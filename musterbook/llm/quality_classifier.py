"""Quality of a text by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by character and word
statistics and a hidden layer; gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``,
weighs the passages, and the weighted sum of their hidden vectors is scored. Weights are
learned from document labels alone, on a sample of at most ``MOST_LABELLED`` labelled documents (a documented
bound of the fit), by all passages of each; scoring takes every passage of every text. The driver
fits on 68 bytes for each passage of the sample.

Defined results: a NULL or empty text is one passage without characters; conflicting labels of a document
drop it from the fit; without labels of both kinds every score is the share of label 1 (0.5
without any); repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterbook.llm.common import id_remainder, pieces, text_buffer
from musterbook.llm.ngram_jaccard import span_hashes

PASSAGE = 512
HIDDEN = 16
ATTENTION = 8
MOST_LABELLED = 6000
EPOCHS = 300
RATE = 0.02
DECAY = 1e-4
SEED = 7

# Classes of bytes whose shares describe a passage.
GROUPS = [
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "abcdefghijklmnopqrstuvwxyz",
    "0123456789",
    " \t\r\x0b\x0c",
    "\n",
    ".",
    ",;:",
    "!?",
    "#*$%&",
    "|<>=/\\_~^+",
    "\"'()[]{}-@`",
]
FEATURES = len(GROUPS) + 6
_CLASS = np.full(256, len(GROUPS), np.uint8)
for _k, _group in enumerate(GROUPS):
    _CLASS[np.frombuffer(_group.encode(), np.uint8)] = _k


def _distinct_share(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Per owner: distinct values over all its values (1 for none)."""
    order = np.lexsort((values, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (values[order][1:] != values[order][:-1])
    total = np.bincount(owner, minlength=n)
    return np.where(total > 0, np.bincount(owner[order][new], minlength=n) / np.maximum(total, 1), 1.0)


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch, and the bounds of each text's passages (one more than texts)."""
    data, offsets = text_buffer(texts)
    sizes = np.diff(offsets)
    n_texts = len(sizes)
    parts = np.maximum(-(-sizes // PASSAGE), 1)
    bounds = np.concatenate([[0], np.cumsum(parts)])
    n = int(bounds[-1])
    text = np.repeat(np.arange(n_texts), sizes)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    passage = bounds[text] + within // PASSAGE
    length = np.bincount(passage, minlength=n)
    kinds = len(GROUPS) + 1
    shares = np.bincount(passage * kinds + _CLASS[data], minlength=n * kinds).reshape(n, kinds)
    gap = np.isin(data, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    first, last = ~gap, ~gap
    if len(data):
        edges = offsets[:-1][sizes > 0]
        first = first.copy()
        first[1:] &= gap[:-1]
        first[edges] = ~gap[edges]
        last = last.copy()
        last[:-1] &= gap[1:]
        ends = offsets[1:][sizes > 0] - 1
        last[ends] = ~gap[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = span_hashes(data, starts, stops)
    word_text, word_passage = text[starts], passage[starts]
    n_words = np.bincount(word_passage, minlength=n)
    triples = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if len(words) > 2:
        same = word_text[2:] == word_text[:-2]
        triples = (words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7))[same]
        owner = word_text[:-2][same]
    of_text = np.repeat(np.arange(n_texts), parts)
    full = np.maximum(length, 1)
    return (
        np.column_stack(
            [
                shares / full[:, None],
                n_words / full,
                np.where(n_words > 0, np.bincount(word_passage, stops - starts, n) / np.maximum(n_words, 1), 0) / 20,
                _distinct_share(word_passage, words, n),
                _distinct_share(owner, triples, n_texts)[of_text],
                np.log1p(sizes)[of_text] / 10,
            ]
        ).astype(np.float64),
        bounds,
    )


class Model:
    """Parameters of the network, as plain arrays."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, mean, spread, **weights):
        self.mean, self.spread = mean, spread
        self.weights = weights

    def forward(self, x: np.ndarray, bounds: np.ndarray):
        p = self.weights
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        sizes = np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds[:-1]), sizes))
        a = e / np.repeat(np.add.reduceat(e, bounds[:-1]), sizes)
        z = np.add.reduceat(a[:, None] * h, bounds[:-1], axis=0)
        return x, h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x, h, t, g, a, z, score = self.forward(x, bounds)
        sizes = np.diff(bounds)
        miss = (score - y) / len(y)
        dz = np.repeat(miss[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bounds[:-1]), sizes))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh,
            "b": dh.sum(axis=0),
            "V": h.T @ dt,
            "U": h.T @ dg,
            "w": (t * g).T @ de,
            "c": z.T @ miss,
            "d": miss.sum(),
        }


def train(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit by Adam over all bags at once."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(
        x.mean(axis=0),
        x.std(axis=0) + 1e-6,
        W=rng.normal(0, n**-0.5, (n, HIDDEN)),
        b=np.zeros(HIDDEN),
        V=rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        U=rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        w=rng.normal(0, ATTENTION**-0.5, ATTENTION),
        c=np.zeros(HIDDEN),
        d=np.log(share / (1 - share)),
    )
    m = {k: 0.0 for k in Model.NAMES}
    v = {k: 0.0 for k in Model.NAMES}
    for step in range(1, epochs + 1):
        for k, grad in model.gradients(x, bounds, y).items():
            grad = grad + DECAY * model.weights[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            model.weights[k] = model.weights[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED
) -> tuple[Model | None, float]:
    """The network and the share of label 1 among at most ``most`` labelled documents of ``docs``, chosen by hash."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marks = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label"))
        .where("label in (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .join(texts.select("id"), "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
        .select("id", "label")
    )
    known = texts.join(marks, "id")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x, bounds = encode_passages(piece.column("text"))
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("id").slice(k, 1),
                            piece.column("label").cast(pa.int32()).slice(k, 1),
                            pa.array([x[a:b].astype(np.float32).tobytes()], pa.binary()),
                        ],
                        ["id", "label", "x"],
                    )

    bags = known.mapInArrow(run, "id long, label int, x binary").toArrow().sort_by("id")
    y = bags.column("label").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return None, float(y.mean()) if len(y) else 0.5
    sets = [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(np.float64) for b in bags.column("x").to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return train(np.concatenate(sets), bounds, y), float(y.mean())


def predict(docs: DataFrame, fitted: tuple[Model | None, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names give way."""
    model, share = fitted
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    arrays = None if model is None else (model.mean, model.spread, model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        arrays = shared.value
        network = None if arrays is None else Model(arrays[0], arrays[1], **arrays[2])
        for batch in batches:
            for piece in pieces(batch, text):
                score = np.full(piece.num_rows, share)
                if network is not None:
                    x, bounds = encode_passages(piece.column(text))
                    score = network.forward(x, bounds)[-1]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in own], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    [*own, "score", "predicted"],
                )

    return kept.mapInArrow(run, T.StructType(list(kept.schema)).add("score", "double").add("predicted", "integer"))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``; learned on what is not held out."""
    learned = labels.where(id_remainder(F.col(doc_id), 3) != 1)
    fitted = fit(docs, learned, doc_id, text)
    scored = predict(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), fitted)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
