"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, their stems (first four and five letters), its word pairs, and pairs with one word between them, hashed into
2**20 places and counted once each. FTRL-proximal trains one weight per place with its own learning rate, and L1 keeps most of them
at exactly zero, so the weights that reach every scoring task are a few thousand numbers (at most 2**20). Training reads at most
``TRAINING_ROWS`` labels, chosen by a hash of their id, and where ids repeat in the documents at most twice as many rows, the first by
that hash, id, a hash of the text and label; every text is scored whole.

Defined results: null, empty and wordless texts have the base rate's score; without usable labels every score is 0.5; a
null doc_id is never held out and never labelled; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.hashing import mixed
from tidemark.llm.shipping import ship

PLACES = 1 << 20
TRAINING_ROWS = 12_000
EPOCHS = 5
ALPHA, BETA, L2 = 3.0, 1.0, 1.0
L1_SHARE = 0.05  # L1 is this share of the root of the training rows, at least 1: evidence by chance grows as the root
THRESHOLD = 0.7
STEMS = (4, 5)
MARKS = ".,;:!?\"'()[]{}<>*#%&$-_/\\|"


class Features(dict):
    """Places of a text's features. A word's hashes are computed once while the bounded table holds it."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        bare = word.strip(MARKS) or word
        self[word] = found = xxhash.xxh3_64_digest(bare) + b"".join(xxhash.xxh3_64_digest("^" + bare[:n]) for n in STEMS)
        return found

    def of(self, text: str | None) -> np.ndarray:
        joined = b"".join(map(self.__getitem__, (text or "").lower().split()))
        words, *stems = np.frombuffer(joined, np.uint64).reshape(-1, 1 + len(STEMS)).T
        pairs = words[:-1] * np.uint64(3) + words[1:]
        skips = words[:-2] * np.uint64(5) + words[2:]
        hashes = np.concatenate([words, *stems, mixed(pairs, 1), mixed(skips, 2)])
        return (hashes >> np.uint64(44)).astype(np.int32)


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over rows of (distinct places, label): bias, places with a weight, their weights."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    strength = max(1.0, L1_SHARE * len(rows) ** 0.5)

    def weights(at: np.ndarray) -> np.ndarray:
        own, l1 = z[at], np.where(at == PLACES, 0.0, strength)
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for places, label in rows:
            at = np.append(places, PLACES)
            w = weights(at)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[at])
            n[at] += gradient * gradient
            z[at] += gradient - (np.sqrt(n[at]) - root) / ALPHA * w
    every = weights(np.arange(PLACES + 1))
    held = np.flatnonzero(every[:PLACES]).astype(np.int32)
    return float(every[PLACES]), held, every[held].astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[float, np.ndarray, np.ndarray] | None:
    """Weights from the labelled rows that are not held out: at most ``TRAINING_ROWS`` labels and twice as many rows."""
    ship(docs.sparkSession)
    usable = labels.select(labels[doc_id].alias("id"), labels[label].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    chosen = usable.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "y").limit(TRAINING_ROWS)
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).join(F.broadcast(chosen), "id")  # bounded by the limit

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, found = Features(), []
        for frame in frames:
            found += [(xxhash.xxh3_64_intdigest(str(d)), d, np.unique(features.of(t)), y) for d, t, y in zip(frame.id, frame.text, frame.y)]
        found.sort(key=lambda r: r[:2])
        if found:
            bias, places, weights = train([r[2:] for r in found])
            yield pd.DataFrame({"place": np.append(places, PLACES).astype(np.int32), "weight": np.append(weights, bias).astype(np.float64)})

    bounded = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "y").limit(2 * TRAINING_ROWS)
    learnt = bounded.mapInPandas(learn, "place int, weight double").toPandas()  # one row per place at most
    if learnt.empty:
        return None
    is_bias = learnt.place == PLACES
    return float(learnt.weight[is_bias].iloc[0]), learnt.place[~is_bias].to_numpy(np.int32), learnt.weight[~is_bias].to_numpy(np.float32)


def scorer(model: tuple[float, np.ndarray, np.ndarray] | None):
    """A column function from text to score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, places, weights = model if model else (0.0, np.zeros(0, np.int32), np.zeros(0, np.float32))
        table, features = np.zeros(PLACES, np.float32), Features()
        table[places] = weights

        def one(text: str | None) -> float:
            at = features.of(text)
            at = np.unique(at[table[at] != 0])
            return 1.0 / (1.0 + np.exp(-np.clip(bias + table[at].sum(dtype=np.float64), -35, 35)))

        for part in parts:
            yield pd.Series([one(t) for t in part], dtype="float64")

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    score = scorer(fit(docs, labels))
    shown = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), score(docs["text"]).alias("score"))
    return shown.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    score = scorer(fit(docs, labels))
    return docs.where(score(docs["text"]) < THRESHOLD)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
