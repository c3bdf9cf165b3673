"""Interfaces of the models, each with a deterministic default that needs no network.

A model is a function from a pandas series to a series; it is called once a batch, so an implementation can load its
weights once a worker and batch its calls.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd

Embedder = Callable[[pd.Series], pd.Series]
Recogniser = Callable[[pd.Series], pd.Series]

# Frequent words that vote for a language.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "von", "zu", "mit"],
    "en": ["the", "and", "of", "to", "is", "that", "in", "for", "was", "with"],
    "es": ["el", "la", "los", "que", "y", "en", "del", "por", "una", "con"],
    "fr": ["le", "la", "les", "et", "est", "que", "des", "une", "dans", "pour"],
    "it": ["il", "lo", "gli", "che", "di", "per", "una", "con", "non", "sono"],
}


def hash_embedder(size: int = 32, task: str = "") -> Embedder:
    """Words are hashed, with the task, to signed buckets; vectors have unit length."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(size)
            for word in re.findall(r"\w+", (text or "").lower()):
                d = hashlib.md5(f"{task}:{word}".encode()).digest()
                v[d[0] % size] += 1 if d[1] & 1 else -1
            out.append((v / max(np.linalg.norm(v), 1e-9)).tolist())
        return pd.Series(out)

    return run


def token_matrix(text: str, size: int = 32) -> tuple[list[str], np.ndarray]:
    """Tokens and a vector for each that also holds some of its neighbours': a stand-in for contextual embeddings."""
    words = (text or "").split()
    rows = np.zeros((len(words), size))
    for i, word in enumerate(words):
        d = hashlib.md5(word.lower().encode()).digest()
        rows[i, d[0] % size] = 1 if d[1] & 1 else -1
    near = rows.copy()
    near[1:] += 0.5 * rows[:-1]
    near[:-1] += 0.5 * rows[1:]
    return words, near


def capitalised_spans(texts: pd.Series) -> pd.Series:
    """(text, label) of runs of capitalised words inside sentences: two or more words a person, one a place."""

    def one(text: str | None) -> list[dict[str, str]]:
        found = re.findall(r"(?<![.!?\n])[ ,]((?:[A-ZÀ-Þ][\w-]+)(?: [A-ZÀ-Þ][\w-]+)*)", text or "")
        return [{"text": x, "label": "PER" if " " in x else "LOC"} for x in sorted(set(found))]

    return texts.map(one)


def overlap_judge(candidates: list[dict[str, str]], text: str) -> list[dict[str, str]]:
    """The default plausibility check: candidates with a url whose description shares a word with the text."""
    words = set(re.findall(r"\w+", text.lower()))
    return [c for c in candidates if c.get("url") and words & set(re.findall(r"\w+", (c.get("description") or "").lower()))]
