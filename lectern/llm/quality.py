"""Quality classifier on supervised subword embeddings.

Every word and its character n-grams are hashed to rows of one embedding matrix; a document is the mean of the rows of
all its words and n-grams; a softmax layer reads it. Matrix and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled documents.

The mean is linear, so scoring needs only one number per row (its vector times the difference of the two output
vectors): executors get a few hundred kilobytes, and a word's share is worked out once per task and kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import training_texts

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
#: Labelled documents of either class that the model is trained on, at most.
PER_CLASS = 1500
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.3
#: Words a task keeps the share of; when full it starts anew.
KEPT_WORDS = 300_000
#: Stands for a word that repeats the one before it, whatever the word.
AGAIN = b"\x00again"


def rows_of(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Rows of the word and of its n-grams of bytes, with the word's borders marked."""
    marked = b"<" + word + b">"
    n = len(marked)
    rows = [zlib.crc32(word, 1) % buckets]
    for width in GRAMS:
        rows += [zlib.crc32(marked[i:i + width]) % buckets for i in range(n - width + 1)]
    return rows


def words_of(text: str) -> list[bytes]:
    """Words, and AGAIN after each word that equals the one before."""
    words = text.encode().split()
    return words + [AGAIN] * sum(a == b for a, b in zip(words, words[1:]))


@dataclass
class Model:
    """share[r]: what row r adds to the logit; bias of the output layer."""

    share: np.ndarray
    bias: float

    def scorer(self):
        share, memory = self.share.tolist(), {}

        def score(text: str) -> float:
            total = count = 0.0
            for word in words_of(text):
                known = memory.get(word)
                if known is None:
                    rows = rows_of(word, len(share))
                    known = (sum(share[r] for r in rows), len(rows))
                    if len(memory) >= KEPT_WORDS:
                        memory.clear()
                    memory[word] = known
                total += known[0]
                count += known[1]
            logit = self.bias + (total / count if count else 0.0)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

        return score


def train_model(bags: list[dict[bytes, int]], y: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE,
                buckets: int = BUCKETS, batch: int = 32, seed: int = 11) -> Model:
    """``bags``: words and counts of each document. Without both classes the model scores 0.5 for everything."""
    if len(np.unique(y)) < 2:
        return Model(np.zeros(buckets), 0.0)
    numbers: dict[bytes, int] = {}
    docs = [
        (np.array([numbers.setdefault(w, len(numbers)) for w in bag], np.int64), np.array(list(bag.values()), float)) for bag in bags
    ]
    parts = [np.array(rows_of(w, buckets), np.int64) for w in numbers]
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    past = np.zeros((buckets, dim))
    out = np.zeros((2, dim))
    bias = np.zeros(2)
    target = np.eye(2)[y.astype(int)]
    steps = epochs * -(-len(docs) // batch)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            now = rate * (1 - done / steps)
            done += 1
            picked = order[at:at + batch]
            ids, weights, owner = [], [], []
            for nth, d in enumerate(picked):
                words, counts = docs[d]
                if not len(words):
                    continue
                # each n-gram weighs as often as its word occurs, over all n-grams of the document
                total = (counts * sizes[words]).sum()
                lengths = sizes[words]
                spots = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                ids.append(flat[spots])
                weights.append(np.repeat(counts / total, lengths))
                owner.append(np.full(len(spots), nth))
            means = np.zeros((len(picked), dim))
            if ids:
                ids, weights, owner = map(np.concatenate, (ids, weights, owner))
                for k in range(dim):
                    means[:, k] = np.bincount(owner, weights * vectors[ids, k], len(picked))
            logits = means @ out.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (target[picked] - p) / len(picked)
            back = error @ out
            out += now * error.T @ means
            bias += now * error.sum(axis=0)
            if len(ids):
                # steps adapt to each number's past gradients: a row is one of thousands in its documents' means
                for k in range(dim):
                    slope = np.bincount(ids, weights * back[owner, k], buckets)
                    past[:, k] += slope * slope
                    vectors[:, k] += now * slope / np.sqrt(past[:, k] + 1e-12)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def _bags(batches):
    for batch in batches:
        rows = []
        for text, label, doc_id in zip(*(batch.column(k).to_pylist() for k in range(3))):
            bag: dict[bytes, int] = {}
            for w in words_of(text):
                bag[w] = bag.get(w, 0) + 1
            rows.append((doc_id, label, list(bag), list(bag.values())))
        yield pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.list_(pa.binary())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
            names=["doc_id", "label", "words", "counts"],
        )


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, column: str = "quality") -> Model:
    """Trains on at most 2 * ``per_class`` whole labelled documents outside the held-out fold."""
    sample = training_texts(docs, labels, column, per_class).select("text", "label", F.col("doc_id").cast("long"))
    rows: pd.DataFrame = sample.mapInArrow(_bags, "doc_id long, label int, words array<binary>, counts array<int>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    bags = [dict(zip(map(bytes, w), map(int, c))) for w, c in zip(rows["words"], rows["counts"])]
    return train_model(bags, rows["label"].to_numpy(float))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``threshold`` on). A null, empty or white text gets the bias alone.

    A very long text is scored whole, inside its row. Texts of the same words in the same number, and repeated rows, tie.
    Columns score and predicted of ``docs`` are replaced, all others stay. An empty table gives an empty result.
    """

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = model.scorer()  # once per task: its memory of words lasts over all batches
        for texts in batches:
            yield pa.array([one(t or "") for t in texts.to_pylist()], pa.float64())

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import fold_of, table

    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )
