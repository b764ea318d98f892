"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises: look-alike letters of other scripts, accents, full-width forms, digits and signs in place of
letters, invisible characters. The lexicon holds words and beginnings of words with their log odds between toxic and
clean documents, learned on Spark from a bounded sample of labelled texts; phrases around a term that occur in clean
documents are exceptions, and terms inside them do not count. A document's sum of weights is divided by a
power of its length and read as a probability by a logistic curve; power and curve are fitted on a third
of the sample that the lexicon has not seen.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import training_texts

#: Labelled texts used at most: toxic ones, clean ones.
PER_CLASS = (2500, 7500)
#: A term's log odds at least, and its log-likelihood ratio against chance.
LEAST_ODDS = 2.0
LEAST_EVIDENCE = 15.0
STEMS = (4, 5, 6, 7)
POWERS = (0.1, 0.25, 0.5, 1.0)
THRESHOLD = 0.5

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip(
    "абвгдеёзийкмнорстухьіјѕԁɡαβεηικνορτυχω",
    "abbrdee3uukmhopctyxbijsdgabenikvoptuxw",
))
#: Digits and signs that stand for letters.
SUBSTITUTES = dict(zip("013457@$", "oieastas"))
INVISIBLE = "­​‌‍⁠﻿"


def fold_table() -> dict[int, str | None]:
    """Code point -> folded form, for lower-case text."""
    table: dict[int, str | None] = {}
    for code in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF00, 0xFF5F)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        table[code] = plain if plain.isalnum() else " "
    table |= {ord("ß"): "ss", ord("æ"): "ae", ord("ø"): "o", ord("ı"): "i", ord("ł"): "l"}
    table |= {code: " " for code in range(0x80) if not chr(code).isalnum()}
    for at, to in (HOMOGLYPHS | SUBSTITUTES).items():
        table[ord(at)] = SUBSTITUTES.get(to, to)
    table |= {ord(c): None for c in INVISIBLE}
    return table


def fold(text: str, table: dict) -> str:
    """Words of plain letters between single or repeated blanks, a blank at either end."""
    return f" {text.lower().translate(table)} "


def _terms(folded: str) -> set[str]:
    """' word ' and ' begin' of every word."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for k in STEMS:
        found.update(f" {w[:k]}" for w in words if len(w) > k)
    return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.25
    slope: float = 1.0
    offset: float = -2.0

    def matcher(self):
        """text -> (sum of weights, number of words)."""
        import ahocorasick

        table, found = fold_table(), ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (term, weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, None))
        if len(found):
            found.make_automaton()

        def match(text: str) -> tuple[float, int]:
            folded = fold(text, table)
            best: dict[int, tuple[float, str]] = {}
            spared: list[tuple[int, int]] = []
            if len(found):
                for end, (term, weight) in found.iter(folded):
                    start = end - len(term) + 1
                    if weight is None:
                        spared.append((start, end))
                    elif start not in best or weight > best[start][0]:
                        best[start] = (weight, term)  # a word counts once, by its best term
            kept, reach, at = [], -1, 0
            spared.sort()
            for start in sorted(best):
                while at < len(spared) and spared[at][0] <= start:
                    reach, at = max(reach, spared[at][1]), at + 1
                if start >= reach:
                    kept.append(best[start])
            # the same term again adds less each time
            total = sum(weight * (1 + math.log(n)) for (weight, _), n in Counter(kept).items())
            return total, len(folded.split())

        return match

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        scaled = total / np.maximum(words, 1.0) ** self.power
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * scaled, -30, 30)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = fold_table()
    for batch in batches:
        for at in range(0, len(batch), 100):  # a text has thousands of terms: count few texts at a time
            part = batch.slice(at, 100)
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts[label].update(_terms(fold(text, table)))
            yield _tally(counts)


def _count_phrases(terms: dict[str, float]):
    """Pairs of words around a term, as ' before word ' and ' word after '."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table()
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold(text, table).split()
                near = set()
                for k, word in enumerate(words):
                    if f" {word} " in terms or any(f" {word[:n]}" in terms for n in STEMS):
                        near.update(f" {a} {b} " for a, b in (words[k - 1:k + 1], words[k:k + 2]) if a != b) if 0 < k < len(words) - 1 else None
                counts[label].update(near)
            yield _tally(counts)

    return run


def _tally(counts: dict[int, Counter]) -> pa.RecordBatch:
    terms = sorted(set(counts[0]) | set(counts[1]))
    return pa.record_batch(
        [pa.array(terms, pa.string()), *[pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0)]],
        names=["term", "toxic", "clean"],
    )


def _odds(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Adds odds (log odds ratio of document rates) and evidence (log-likelihood ratio against one common rate)."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = toxic / max(1, toxic + clean)
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * p))).otherwise(0.0)
    return counts.withColumn("odds", odds).withColumn("evidence", 2 * (part(t, share) + part(c, 1 - share)))


def learn(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, column: str = "toxic") -> Lexicon:
    """Lexicon, exceptions and curve from at most ``per_class`` labelled texts outside the held-out fold.

    Every term with enough odds and evidence in the sample is kept, and every exception: their number is bounded by the sample
    alone. Without toxic examples the lexicon is empty and every score is the same low value.
    """
    sample = training_texts(docs, labels, column, per_class)
    sample = sample.withColumn("_curve", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0).select("text", "label", "_curve").cache()
    try:
        sizes = {(r["_curve"], r["label"]): r["count"] for r in sample.groupBy("_curve", "label").count().collect()}
        toxic, clean = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
        if not toxic:
            return Lexicon({})
        seen = sample.filter("not _curve").select("text", "label")
        schema = "term string, toxic long, clean long"
        counts = seen.mapInArrow(_count_terms, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        best = (
            _odds(counts.filter("toxic >= 2"), toxic, clean)
            .filter((F.col("odds") >= LEAST_ODDS) & (F.col("evidence") >= LEAST_EVIDENCE))
            .orderBy(F.col("evidence").desc(), "term").select("term", "odds").collect()
        )
        weights = {r["term"]: r["odds"] for r in best}
        phrases = seen.mapInArrow(_count_phrases(weights), schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        spared = (
            _odds(phrases.filter("clean >= 2"), toxic, clean).filter("odds <= 0")
            .orderBy(F.col("clean").desc(), "term").select("term").collect()
        )
        lexicon = Lexicon(weights, [r["term"] for r in spared])
        curve = sample.filter("_curve").select("text", "label")
        rows = with_matches(curve, lexicon).select("match.total", "match.words", "label").toPandas()
        rows = rows.sort_values(["total", "words", "label"])
        return _fit_curve(lexicon, *(rows[c].to_numpy(float) for c in ("total", "words", "label")))
    finally:
        sample.unpersist()


def _fit_curve(lexicon: Lexicon, total: np.ndarray, words: np.ndarray, y: np.ndarray) -> Lexicon:
    """Power, slope and offset with the least logistic loss; both classes weigh the same."""
    if len(np.unique(y)) < 2:
        return lexicon
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    best = (np.inf, lexicon.power, lexicon.slope, lexicon.offset)
    for power in POWERS:
        x = np.stack([total / np.maximum(words, 1.0) ** power, np.ones(len(y))], axis=1)
        scale = max(x[:, 0].max(), 1e-9)
        x[:, 0] /= scale
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (weight * (y - p)) - 0.05 * beta
            curvature = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(2)
            step = np.linalg.solve(curvature, slope)
            beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-12, 1 - 1e-12)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
        if loss < best[0] - 1e-9 and beta[0] > 0:
            best = (loss, power, float(beta[0] / scale), float(beta[1]))
    return Lexicon(lexicon.weights, lexicon.exceptions, *best[1:])


_MATCH = T.StructType([T.StructField("total", T.DoubleType()), T.StructField("words", T.LongType())])


def with_matches(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds a struct ``match`` (total weight, words); a null text counts as empty."""

    @F.arrow_udf(_MATCH)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = lexicon.matcher()
        for texts in batches:
            rows = [one(t or "") for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], names=["total", "words"]
            )

    return docs.withColumn("match", match(F.col(text)))


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``threshold`` on). A null, empty or white text has no term and
    gets the curve's lowest score.

    Where several terms begin at one place the heaviest counts, of equal weights the greater by code point. A very long text
    is matched whole, inside its row, in time that grows with its length. Repeated rows get equal scores. Columns score and
    predicted of ``docs`` are replaced and a column match is dropped, all others stay. An empty table gives an empty result.
    """

    @F.arrow_udf(T.DoubleType())
    def score(total: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array(lexicon.score(*(c.to_numpy(zero_copy_only=False).astype(float) for c in (total, words))))

    rows = with_matches(docs, lexicon).withColumn("score", score(F.col("match.total"), F.col("match.words"))).drop("match")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns as they are."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    return scored(whole, lexicon, threshold).filter("predicted = 0").select("doc.*")


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import fold_of, table

    docs = table(spark, folder, "documents")
    lexicon = learn(docs, table(spark, folder, "labels"))
    return scored(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )
