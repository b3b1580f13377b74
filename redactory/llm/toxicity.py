"""Toxicity: a linear model over words and word beginnings, regularised by counterfactuals.

Features are chosen by their association with the toxic label in a bounded sample.
For each sampled document that mentions a group, the identity terms in its
sentences are swapped for others of the same kind, and once left out; the fit pays
for every change of score between the versions, so that terms of a kind weigh alike
and the mention itself weighs next to nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import in_worker, keep_where, labelled_sample, materialise, per_batch, scored, texts_of

#: Documents of each label in the fitting sample, features kept, least association, and the penalty's weight.
PER_CLASS, FEATURES, LEAST_Z, LEAST_DOCS, COUNTERFACTUAL = 3000, 1200, 6.0, 4, 4.0
THRESHOLD = 0.7
#: Floors of the intercept to choose from, by the halves of the labelled sample: a higher one lets fewer features suffice.
FLOORS = (-5.0, -4.0, -3.0, -2.0, -1.0)
_CACHE = 200_000
_WORD = regex.compile(r"\p{L}+")
_SENTENCE = regex.compile(r"(?<=[.!?\n])")
#: Kinds of identity terms; a term is swapped for the next of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("mexican", "chinese", "indian", "american", "german", "french", "spanish"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("juden", "muslime", "christen"),
    ("ausländer", "einwanderer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("juifs", "musulmans", "chrétiens"),
    ("étrangers", "immigrés", "réfugiés"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("judíos", "musulmanes", "cristianos"),
    ("extranjeros", "inmigrantes", "refugiados"),
)
_NEXT = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, t in enumerate(kind)}


def word_features(word: str) -> list[str]:
    """A lower-case word and its beginnings of three to six letters (marked by a hyphen)."""
    return [word, *(f"{word[:n]}-" for n in range(3, 7) if len(word) > n)]


def features_of(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def swap_identities(text: str, neutral: bool = False) -> str:
    """The text with each identity term in its sentences replaced, or left out if neutral; unchanged if it has none."""

    def swap(sentence: str) -> str:
        return _WORD.sub(lambda m: ("" if neutral else _NEXT[m[0]]) if m[0] in _NEXT else m[0], sentence) if not _NEXT.keys().isdisjoint(_WORD.findall(sentence)) else sentence

    return "".join(map(swap, _SENTENCE.split(text.lower())))


def choose_features(sample: DataFrame) -> list[str]:
    """The features most associated with toxic texts, identity terms included: at most FEATURES and those."""

    def setup():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("y"), pa.array([sorted(features_of(t)) for t in texts_of(batch)], pa.list_(pa.string()))], ["y", "f"])

        return step

    found = per_batch(sample.select("y", "text"), setup, "y int, f array<string>")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    counts = found.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1) / ((F.col("n") + 0.5) / (neg + 1)))
    best = counts.withColumn("z", odds * F.sqrt(F.col("p") + F.col("n"))).where((F.col("p") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "f").limit(FEATURES)
    found_in = {r["f"]: r["p"] for r in best.select("f", "p").collect()}
    return [*dict.fromkeys([f for f in found_in if not _implied(f, found_in)] + list(_NEXT))]


def _implied(name: str, found_in: dict[str, int]) -> bool:
    """Whether a word beginning says no more than one longer feature that has nearly all of its documents."""
    stem = name.removesuffix("-")
    return name != stem and any(g.startswith(stem) and len(g.removesuffix("-")) > len(stem) and n >= 0.95 * found_in[name] for g, n in found_in.items())


def fit(x: np.ndarray, change: np.ndarray, y: np.ndarray, floor: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights, none below zero, and an intercept, not below the floor.

    Each row of change is a text's features less those of its version with other or
    no identity terms; the mean square of its score is the penalty.
    """
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    moments = np.zeros((2, x.shape[1] + 1))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -30, 30))) - y) * weight
        grad = x.T @ error + 1e-5 * w
        if len(change):
            grad += COUNTERFACTUAL * change.T @ (change @ w) / len(change)
        both = np.append(grad, error.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * both
        moments[1] = 0.999 * moments[1] + 0.001 * both**2
        move = 0.1 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0).astype(np.float32), max(b - move[-1], floor)
    return w.astype(float), float(b)


def choose_floor(x: np.ndarray, changes: list[np.ndarray], y: np.ndarray, half: np.ndarray) -> float:
    """The floor whose fit on either half of the sample errs least on the other.

    An error is the mean of the shares of toxic and of clean texts on the wrong side of
    THRESHOLD; equal ones are settled by the mean log loss, then by the lower floor. If
    a half lacks a label, the lowest floor stays.
    """
    if any(len(set(y[half == h])) < 2 for h in (0, 1)):
        return FLOORS[0]

    def cost(floor: float) -> tuple[float, float]:
        wrong = loss = 0.0
        for h in (0, 1):
            w, b = fit(x[half == h], changes[h], y[half == h], floor, steps=300)
            p, own = 1 / (1 + np.exp(-np.clip(x[half != h] @ w + b, -30, 30))), y[half != h]
            for label in (0, 1):
                q = p[own == label]
                wrong += float(np.mean((q >= THRESHOLD) != label)) / 4
                loss -= float(np.mean(np.log(np.maximum(q if label else 1 - q, 1e-12)))) / 4
        return wrong, loss

    return min(FLOORS, key=lambda f: (*cost(f), f))


def _scorer(names: tuple[str, ...], weights: bytes, intercept: float):
    """Texts to scores, with what is known of their words."""
    return in_worker(("toxicity", names, weights, intercept), lambda: _new_scorer(names, weights, intercept))


def _new_scorer(names: tuple[str, ...], weights: bytes, intercept: float):
    index, w = {n: i for i, n in enumerate(names)}, np.frombuffer(weights)

    class Chunks(dict):
        def __missing__(self, chunk: str) -> tuple[int, ...] | None:
            self[chunk] = out = tuple({index[f] for word in _WORD.findall(chunk) for f in word_features(word) if f in index}) or None
            return out

    chunks = Chunks()

    def score(texts: list[str]) -> list[float]:
        out = []
        for text in texts:
            if len(chunks) > _CACHE:
                chunks.clear()
            hits = {i for found in filter(None, map(chunks.__getitem__, set(text.lower().split()))) for i in found}
            out.append(1 / (1 + np.exp(-np.clip(intercept + w[sorted(hits)].sum(), -30, 30))))
        return out

    return score


def train(docs: DataFrame, labels: DataFrame) -> tuple[tuple[str, ...], bytes, float]:
    """Feature names, weights and intercept, from a bounded sample of labelled documents."""
    sample = materialise(labelled_sample(docs, labels, "toxic", PER_CLASS).dropDuplicates(["text"]), "toxic-sample").repartition(16)
    names = choose_features(sample)
    index = {n: i for i, n in enumerate(names)}

    def indices(text: str) -> list[int]:
        return sorted(index[f] for f in features_of(text) if f in index)

    def setup():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, twins, bare = [], [], []
            for text in texts_of(batch):
                swapped = swap_identities(text)
                own.append(indices(text))
                twins.append(indices(swapped) if swapped != text.lower() else None)
                bare.append(indices(swap_identities(text, neutral=True)) if swapped != text.lower() else None)
            return pa.RecordBatch.from_arrays([batch.column("y"), batch.column("half"), *(pa.array(i, pa.list_(pa.int32())) for i in (own, twins, bare))], ["y", "half", "own", "twin", "bare"])

        return step

    half = (F.crc32(F.col("text").cast("binary")) % 2).cast("int").alias("half")
    rows = per_batch(sample.orderBy("doc_id").select("y", half, "text"), setup, "y int, half int, own array<int>, twin array<int>, bare array<int>").collect()
    if not rows:
        return tuple(names), np.zeros(len(names)).tobytes(), FLOORS[0]

    def matrix(lists: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(lists), len(names)), np.float32)
        for i, found in enumerate(lists):
            out[i, found] = 1
        return out

    def changes(some: list) -> np.ndarray:
        some = [r for r in some if r["twin"] is not None]
        own = matrix([r["own"] for r in some])
        return np.concatenate([own - matrix([r[k] for r in some]) for k in ("twin", "bare")])

    x, y, halves = matrix([r["own"] for r in rows]), np.array([r["y"] for r in rows], np.float32), np.array([r["half"] for r in rows])
    floor = choose_floor(x, [changes([r for r in rows if r["half"] == h]) for h in (0, 1)], y, halves)
    w, b = fit(x, changes(rows), y, floor)
    return tuple(names), w.tobytes(), b


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the whole text counts, null as empty.

    Repeated rows get equal scores. Without usable labels every score is that of an
    empty text, near zero. An empty table gives no rows.
    """
    names, weights, intercept = train(docs, labels)
    return scored(docs, lambda: _scorer(names, weights, intercept), THRESHOLD)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic; null texts stay."""
    names, weights, intercept = train(docs, labels)

    def setup():
        score = _scorer(names, weights, intercept)
        return lambda texts: [s < THRESHOLD for s in score([t or "" for t in texts])]

    return keep_where(docs, setup)
