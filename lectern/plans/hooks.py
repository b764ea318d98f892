"""Deterministic stand-ins for user models in the hook queries, and the hooks themselves."""

from __future__ import annotations

import numpy as np

from lectern.functions.models import embedder, rerank_scores  # noqa: F401  (re-exported)


def parity():
    """A 'model': (3, 4) for texts of even length, (0, 5) for the others."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[3, 4] if len(x) % 2 == 0 else [0, 5] for x in texts], dtype="float32")

    return encode


def length_mod():
    """A 'scorer': text length modulo 89; fails for every fifth question."""

    def score(question: str, texts: list[str]) -> list[float]:
        if int(question) % 5 == 0:
            raise RuntimeError("scorer not available")
        return [len(x) % 89 for x in texts]

    return score
