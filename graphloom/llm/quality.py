"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Each passage is
described by what kinds of characters it has, how long and how varied its words
are; an encoder (one tanh layer) maps that to a vector, gated attention
(tanh times sigmoid) weighs the passages, and a logistic unit scores the
weighted mean.  Only the documents have labels; encoder, attention and scorer
are trained together by gradient descent.

Training takes at most about ``PER_CLASS`` labelled documents of each class,
chosen by a hash of the id, so that the driver's memory is bounded.  Scoring
covers whole texts of all rows, map only.

Defined results: a null text counts as empty; an empty one is a single passage
without words and gets its score like any other; without labels of both
classes every score is the prior (0.5 without any label); repeated rows are
scored one by one; columns other than key and text are not read; an empty
table gives an empty result.  A score of exactly 0.5 counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import code_points, labelled_texts, segment_sums, slices, tidy

PER_CLASS = 1500
PASSAGE_WORDS = 64
KINDS = ".,!?#$%&*|-'\":;()/<>{}[]=_@+\\^~`"
N_KINDS = 7 + len(KINDS)
N_FEATURES = N_KINDS + 5
HIDDEN, ATTENTION = 16, 8

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Kind of each code point below 0x3000; above, all are 'other letter'."""
    global _CLASS
    if _CLASS is None:
        table = np.zeros(0x3001, dtype=np.uint8)
        for c in range(0x3000):
            ch = chr(c)
            if ch in KINDS:
                table[c] = 7 + KINDS.index(ch)
            elif ch.isalpha():
                table[c] = (2 if c > 127 else 1) if ch.islower() else (4 if c > 127 else 3)
            else:
                table[c] = 5 if ch.isdigit() else 6 if ch.isspace() else 0
        table[0x3000] = 2
        _CLASS = table
    return _CLASS


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text plus the end)."""
    pieces: list[str] = []
    words_in: list[tuple[int, int]] = []
    first = [0]
    for t in texts:
        words = t.split()
        for i in range(0, max(1, len(words)), PASSAGE_WORDS):
            run = words[i : i + PASSAGE_WORDS]
            pieces.append(" ".join(run))
            words_in.append((len(run), len(set(run))))
        first.append(len(pieces))
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    # a blank after the last passage too, so that each has the same features wherever it stands
    points = np.minimum(code_points(" ".join([*pieces, ""])), 0x3000)
    kind = _classes()[points].astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), size + 1)
    counts = np.bincount(owner * N_KINDS + kind, minlength=len(pieces) * N_KINDS).reshape(-1, N_KINDS).astype(float)
    n = np.array(words_in, dtype=float).reshape(-1, 2)
    chars = np.maximum(size, 1)[:, None]
    x = np.concatenate(
        [
            np.sqrt(counts / chars),
            np.log1p(size)[:, None] / 6,
            np.log1p(n[:, :1]) / 4,
            n[:, 1:] / np.maximum(n[:, :1], 1),
            np.minimum(size[:, None] / np.maximum(n[:, :1], 1), 40) / 8,
            (n[:, :1] == 0).astype(float),
        ],
        axis=1,
    )
    return x, np.array(first)


@dataclass
class Model:
    prior: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x, first = passages(texts)
        return _forward(self.weights, (x - self.weights["mean"]) / self.weights["std"], first)[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    h = np.tanh(x @ w["E"] + w["e"])
    v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (v * u) @ w["a"]
    top = np.maximum.reduceat(logit, first[:-1])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    share = np.exp(logit - top[owner])
    share /= segment_sums(share, first[:-1], first[1:])[owner]
    z = segment_sums(share[:, None] * h, first[:-1], first[1:])
    return _sigmoid(z @ w["c"] + w["d"]), h, v, u, share, z, owner


def loss(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, each: np.ndarray) -> float:
    """Weighted cross-entropy with a small penalty on encoder and scorer."""
    p = np.clip(_forward(w, x, first)[0], 1e-15, 1 - 1e-15)
    return float(-(each * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 5e-5 * ((w["c"] ** 2).sum() + (w["E"] ** 2).sum()))


def gradient(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
    """Of ``loss``, through scorer, attention and encoder."""
    p, h, v, u, share, z, owner = _forward(w, x, first)
    dz_out = (p - y) * each
    g = {"c": z.T @ dz_out + 1e-4 * w["c"], "d": dz_out.sum(keepdims=True)}
    dz = dz_out[:, None] * w["c"][None, :]
    inner = (h * dz[owner]).sum(1)
    base = segment_sums(share * inner, first[:-1], first[1:])
    dlogit = share * (inner - base[owner])
    g["a"] = (v * u).T @ dlogit
    dv = dlogit[:, None] * w["a"] * u * (1 - v * v)
    du = dlogit[:, None] * w["a"] * v * u * (1 - u)
    g["V"], g["U"] = h.T @ dv, h.T @ du
    dh = (share[:, None] * dz[owner] + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
    g["E"], g["e"] = x.T @ dh + 1e-4 * w["E"], dh.sum(0)
    return g


def fit(texts: list[str], labels: list[int], prior: float, steps: int = 250, rate: float = 0.02, seed: int = 7) -> Model:
    """Full-batch Adam on class-balanced cross-entropy; the scorer's bias is then set to the classes' prior."""
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return Model(prior)
    x, first = passages(texts)
    mean, std = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / std
    rng = np.random.default_rng(seed)
    w = {
        "E": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        "e": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "a": rng.normal(0, 0.5, ATTENTION),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.zeros(1),
    }
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for step in range(1, steps + 1):
        g = gradient(w, x, first, y, each)
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    w["d"] = w["d"] + np.log(prior / (1 - prior))
    return Model(prior, w | {"mean": mean, "std": std})


def train_model(docs: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fits on labelled rows where ``use`` holds; by default crc32(key) mod 3 is not 1."""
    use = F.crc32(F.col(key).cast("string")) % 3 != 1 if use is None else use
    rows, counts = labelled_texts(docs, labels, label, use, key, text, per_class)
    total = sum(counts.values())
    prior = min(0.99, max(0.01, counts.get(1, 0) / total)) if total else 0.5
    return fit([t for t, _ in rows], [y for _, y in rows], prior)


def score_quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, passages) of every row."""
    rows = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1).to_pylist(), 1 << 20):
                n = [max(1, -(-len(t.split()) // PASSAGE_WORDS)) for t in texts]
                yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(first, len(texts)), "score": shared.value.score(texts), "passages": pa.array(n, pa.int64())})

    return rows.mapInArrow(tidy(run), f"`{key}` {rows.schema[key].dataType.simpleString()}, score double, passages bigint")
