"""Quality: random-indexing word vectors pooled per document, scored by a small calibrated network.

Every token falls into one of BUCKETS rows. A row's vector is the sum of the fixed
sparse random vectors of the tokens beside it, over the whole corpus. A document
is the mean and spread of its tokens' vectors and how often tokens repeat; a network with one hidden
layer, fitted in numpy on a bounded labelled sample, scores it, and a temperature
fitted on a part it has not seen calibrates the probability.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import in_worker, labelled_sample, materialise, per_batch, scored, texts_of

BUCKETS, DIMS, NONZERO = 4096, 64, 4
#: Documents of each label in the fitting sample; hidden units; share kept back for the temperature.
PER_CLASS, HIDDEN, CALIBRATION = 4000, 32, 0.2
_CACHE = 500_000
_TOKEN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
_GROUP = 256


def random_vectors() -> np.ndarray:
    """The fixed sparse vectors: NONZERO entries of +1 or -1 in each row."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((BUCKETS, DIMS), np.int32)
    for row in out:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


class Buckets:
    """text -> token buckets, kept per white-space chunk."""

    def __init__(self):
        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                self[chunk] = out = np.array([zlib.crc32(t.encode()) % BUCKETS for t in _TOKEN.findall(chunk)], np.uint16).tobytes()
                return out

        self.chunks = Chunks()

    def __call__(self, text: str) -> np.ndarray:
        if len(self.chunks) > _CACHE:
            self.chunks.clear()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.split())), np.uint16)


def buckets() -> Buckets:
    return in_worker(("quality",), Buckets)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all buckets from all documents; whole-number sums, so order does not matter.

    Each task sends at most BUCKETS rows, whatever it has read.
    """

    def run(batches):
        find, together = buckets(), np.zeros(BUCKETS * BUCKETS, np.int32)
        for batch in batches:
            for text in texts_of(batch):
                ids = find(text).astype(np.int64)
                np.add.at(together, ids[:-1] * BUCKETS + ids[1:], 1)
        together = together.reshape(BUCKETS, BUCKETS)
        fixed = random_vectors().astype(np.float64)
        sums = (together @ fixed + together.T @ fixed).astype(np.int64)
        rows = np.flatnonzero(sums.any(axis=1))
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(sums[rows, d]) for d in range(DIMS))], ["bucket", *(f"d{d}" for d in range(DIMS))])

    parts = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"d{d} long" for d in range(DIMS)))
    total = np.zeros((BUCKETS, DIMS))
    for r in parts.groupBy("bucket").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS))).collect():  # at most BUCKETS rows
        total[r["bucket"]] = r[1:]
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)).astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's token vectors, and four rates of repetition; zeros for an empty text."""
    find, both = buckets(), np.hstack([vectors, vectors**2])
    out = np.zeros((len(texts), 2 * DIMS + 4), np.float32)
    for at in range(0, len(texts), _GROUP):
        counts, rates = np.zeros((len(texts[at : at + _GROUP]), BUCKETS), np.float32), []
        for row, text in zip(counts, texts[at : at + _GROUP], strict=True):
            ids = find(text)
            n = max(1, len(ids))
            row[:] = np.bincount(ids, minlength=BUCKETS) / n
            rates.append(((ids[1:] == ids[:-1]).sum() / n, (ids[2:] == ids[:-2]).sum() / n, np.count_nonzero(row) / n, 1 / (1 + len(ids))))
        sums = counts @ both
        mean = sums[:, :DIMS]
        out[at : at + _GROUP] = np.hstack([mean, np.sqrt(np.maximum(sums[:, DIMS:] - mean**2, 0)), np.array(rates, np.float32)])
    return out


def forward(x: np.ndarray, net: tuple[np.ndarray, ...]) -> np.ndarray:
    shift, scale, w1, b1, w2, b2 = net
    return np.tanh((x - shift) / scale @ w1 + b1) @ w2 + b2


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[tuple[np.ndarray, ...], float]:
    """A two-layer network by full-batch Adam, and its temperature; rows must be in a fixed order."""
    rng = np.random.Generator(np.random.PCG64(11))
    keep = rng.random(len(x)) >= CALIBRATION
    if len(set(y[keep])) < 2 or len(set(y[~keep])) < 2:
        keep = np.ones(len(x), bool)
    shift, scale = x[keep].mean(0), x[keep].std(0) + 1e-3
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, t = (x[keep] - shift) / scale, y[keep]
    weight = np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum()))
    for step in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) * weight
        back = error[:, None] * p[2] * (1 - h**2)
        grads = [z.T @ back + 1e-3 * p[0], back.sum(0), h.T @ error + 1e-3 * p[2], error.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = (shift, scale, *p)
    left = ~keep if (~keep).any() else keep
    logits, truth = forward(x[left], net), y[left]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(truth == 1, 1, -1) * logits / g)) for g in grid]
    return net, float(grid[int(np.argmin(loss))])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the whole text counts, null as empty.

    Repeated rows get equal scores. Without labels of both kinds every score is
    0.5. An empty table gives no rows.
    """
    vectors = word_vectors(docs)
    sample = materialise(labelled_sample(docs, labels, "quality", PER_CLASS), "quality-sample").repartition(16)

    def pooled():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pool(texts_of(batch), vectors)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "y", "x"])

        return step

    rows = sorted(per_batch(sample.select("doc_id", "y", "text"), pooled, "doc_id long, y int, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["y"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return scored(docs, lambda: lambda texts: [0.5] * len(texts), 0.5)
    net, temperature = fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64), y)
    return scored(docs, lambda: lambda texts: (1 / (1 + np.exp(-np.clip(forward(pool(texts, vectors), net) / temperature, -30, 30)))).tolist(), 0.5)
