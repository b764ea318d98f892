"""Hooks for user models. The factory runs once per Python worker task; texts go through in Arrow
batches, cut into pieces of the size the model likes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embedder(factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16):
    """texts -> ARRAY<FLOAT> of length 1 (norm floored at 1e-6)."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            out = []
            filled = texts.fillna("").tolist()
            for i in range(0, len(filled), batch):
                vec = np.asarray(model(filled[i : i + batch]), dtype="float32")
                norm = np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-6)
                out.extend((vec / norm).tolist())
            yield pd.Series(out)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, T.ArrayType(T.FloatType()))


def reranker(factory: Callable[[], Callable[[str, list[str]], list[float]]]):
    """(question, its texts) -> ARRAY<DOUBLE>; NULL where the model fails, which keeps the question's old order.

    A question's head is one row, so no batch border cuts it and a failure concerns all of it or nothing.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for questions, texts in batches:
            out = []
            for question, rows in zip(questions, texts):
                try:
                    out.append(np.asarray(model(question, list(rows)), dtype="float64").tolist())
                except Exception:  # a failing model must not fail the search
                    out.append(None)
            yield pd.Series(out, dtype="object")

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, T.ArrayType(T.DoubleType()))


def rerank_scores(heads: DataFrame, factory: Callable[[], Callable[[str, list[str]], list[float]]]) -> DataFrame:
    """qid, chunk_id, new_score of the heads that are to be re-ranked (qid, question, chunk_id, text; some thirty rows
    a question). Questions whose model failed give no rows."""
    item = F.struct("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    gathered = heads.groupBy("qid", "question").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    scored = gathered.withColumn("scores", reranker(factory)(F.col("question"), F.col("rows.text"))).filter("scores IS NOT NULL")
    pairs = scored.select("qid", F.explode(F.arrays_zip(F.col("rows.chunk_id").alias("chunk_id"), "scores")).alias("p"))
    return pairs.select("qid", F.col("p.chunk_id").alias("chunk_id"), F.col("p.scores").alias("new_score"))
