"""Language identification by the nearest of several centroids per language.

A text is lower-cased, reduced to letters with single gaps, and its character n-grams of
length 1 to 3 are hashed into buckets: a TF-IDF vector (log term frequency), normalised.
Training vectors, from a bounded sample per language, are clustered into a few spherical
k-means centroids for each language. A text gets the language of the centroid with the
largest cosine; one whose distance (1 - cosine) to that centroid exceeds what almost all
training texts of the cluster show is marked as rejected.

The fit reads at most ``sample`` rows of each language; prediction reads all rows and
shuffles nothing.

Defined results: null texts and texts without a letter are ``und`` with score 0 and are
rejected; of equal cosines the first language by name wins; repeated rows get equal
results; without training rows everything is ``und``. Extra columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
BUCKETS = 4096
#: Training rows of each language, centroids of each, share of training texts beyond the rejection distance.
SAMPLE, CENTROIDS, BEYOND = 600, 4, 0.005
#: Characters that are hashed at a time.
BLOCK = 1 << 20


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS, dtype=np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), dtype=np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # language of each centroid
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))  # largest accepted distance of each


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def counts(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """n-gram counts by bucket, of the whole text; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters[code]
    if not letter.any():
        return None
    gap = np.where(letter, code, 32)
    gap = np.concatenate(([32], gap[letter | np.append(True, letter[:-1])], [32])).astype(np.uint32)  # one gap after each word
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(gap), BLOCK):
        c = gap[max(0, at - 2) : at + BLOCK]
        skip = at - max(0, at - 2)
        one, two = c[skip:][c[skip:] != 32] * np.uint32(2654435761), c[1:] * np.uint32(40503) + c[:-1] * np.uint32(2246822519)
        three = two[1:] * np.uint32(3266489917) + c[:-2] * np.uint32(668265263)
        for h in (one, two[max(0, skip - 1) :], three):
            total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(20), minlength=BUCKETS)
    return total


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count).astype(np.float32) * idf
    return x / max(float(np.linalg.norm(x)), 1e-9)


def clustered(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts; centroids and each row's cluster."""
    k = min(k, len(x))
    starts = [0]
    while len(starts) < k:
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    centroids = x[starts]
    for _ in range(rounds):
        label = np.argmax(x @ centroids.T, axis=1)
        sums = np.array([x[label == j].sum(axis=0) if (label == j).any() else centroids[j] for j in range(k)])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids.astype(np.float32), np.argmax(x @ centroids.T, axis=1)


def fit(texts: list[str], langs: list[str]) -> Model:
    """On a sample that the caller has bounded."""
    letters = _letters()
    counted = [(counts(t, letters), g) for t, g in zip(texts, langs, strict=True)]
    counted = [(c, g) for c, g in counted if c is not None]
    if not counted:
        return Model()
    tf = np.array([c for c, _ in counted])
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 0.1).astype(np.float32)
    x = np.array([vector(c, idf) for c in tf])
    names = np.array([g for _, g in counted])
    languages = sorted(set(names))
    parts = [clustered(x[names == g], CENTROIDS) for g in languages]
    reach = []
    for g, (centroids, label) in zip(languages, parts, strict=True):
        distance = 1 - (x[names == g] * centroids[label]).sum(axis=1)
        reach += [float(np.quantile(distance[label == j], 1 - BEYOND)) if (label == j).any() else 0.0 for j in range(len(centroids))]
    owner = np.repeat(np.arange(len(languages)), [len(c) for c, _ in parts])
    return Model(languages, idf, np.vstack([c for c, _ in parts]), owner, np.array(reach))


def training_sample(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most ``sample`` texts of each language, by hash order, among the rows that ``learn`` marks; a doc_id is learned from once.

    Rows are counted first, and only hashes low enough to hold several times the sample are ranked, so that no task gets more of a language.
    """
    marked = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(learn).select("doc_id", "lang", "text")
    ids = marked.select("doc_id", "lang").distinct()
    share = ids.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * sample) / F.count("*")).alias("share"))
    low = ids.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    chosen = low.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("doc_id", "lang")
    rows = marked.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("doc_id", "lang").toPandas()
    return rows["text"].tolist(), rows["lang"].tolist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred (the nearest language), score (its cosine) and rejected, of every row."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = common.worker_state("letters", _letters)
        for batch in batches:
            names, scores, rejected = [], [], []
            for t in batch["text"]:
                count = counts(t, letters) if model.languages else None
                if count is None:
                    names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                cosine = model.centroids @ vector(count, model.idf)
                k = int(np.argmax(cosine))
                names.append(model.languages[model.owner[k]])
                scores.append(min(1.0, max(0.0, float(cosine[k]))))
                rejected.append(bool(1 - cosine[k] > model.reach[k]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": scores, "rejected": rejected})

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").transform(common.in_batches, task, "doc_id string, lang_pred string, score double, rejected boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
