"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, runs of digits and runs of marks, as written: case and marks tell prose from junk.
Every token and every pair of neighbours is hashed into one of ``2 ** BITS`` columns, and so is how they are written
(upper case, lower case, digits, marks; a token repeated).  A document is the sparse vector of column counts over the
root of their sum; its score is the logistic function of one sparse dot product.

Scoring is a function of the text alone, so it runs wherever the row is: no shuffle.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.common import Cached, labelled_sample

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
BITS = 18
REMEMBERED = 50_000
# Characters of texts that are taken together.
PASS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _code(token: str) -> int:
    """Hash of a token above, and its shape in the lowest three bits."""
    if token[0].isdigit():
        shape = 0
    elif not token[0].isalpha():
        shape = 1
    elif token.islower():
        shape = 2
    elif len(token) > 1 and token.isupper():
        shape = 3
    else:
        shape = 4
    return zlib.crc32(token.encode("utf-8", "replace")) * 8 + shape


_codes = Cached(_code, REMEMBERED)


def _columns(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (values + np.uint64(salt)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def ngram_columns(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of all n-grams of whole texts, repeated as they occur, and the index of each one's text."""
    each = [TOKEN.findall(t) if t else [] for t in texts]
    sizes = [len(tokens) for tokens in each]
    codes = np.fromiter((_codes[t] for tokens in each for t in tokens), dtype=np.uint64, count=sum(sizes))
    owner = np.repeat(np.arange(len(each)), sizes)
    word, shape = codes >> np.uint64(3), codes & np.uint64(7)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    first, second = word[pair], word[pair + 1]
    with np.errstate(over="ignore"):
        pairs = first * _MIX + second
    # How two neighbours are written, and whether they are the same token.
    shapes = shape[pair] * np.uint64(16) + shape[pair + 1] * np.uint64(2) + (first == second)
    parts = [_columns(word, 1), _columns(pairs, 2), _columns(shape, 3), _columns(shapes, 4)]
    return np.concatenate(parts), np.concatenate([owner, owner[pair], owner, owner[pair]])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and their values for one whole text; empty for a text without tokens."""
    columns, _ = ngram_columns([text])
    distinct, counts = np.unique(columns, return_counts=True)
    return distinct, counts / np.sqrt(max(1, len(columns)))


def train(
    texts: list[str],
    y: np.ndarray,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 7,
) -> np.ndarray:
    """FTRL-proximal logistic regression; returns ``2 ** BITS`` weights and, last, the constant.

    Classes count alike whatever their shares.
    """
    rows = [features(t) for t in texts]
    share = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    importance = len(y) / (2.0 * share)
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            columns = np.append(rows[i][0], size - 1)
            values = np.append(rows[i][1], 1.0)
            own_z, own_n = z[columns], n[columns]
            own = np.where(
                np.abs(own_z) <= l1,
                0.0,
                (np.sign(own_z) * l1 - own_z) / ((beta + np.sqrt(own_n)) / alpha + l2),
            )
            p = 1 / (1 + np.exp(-np.clip(own @ values, -30, 30)))
            slope = (p - y[i]) * values * importance[int(y[i])]
            z[columns] = own_z + slope - (np.sqrt(own_n + slope**2) - np.sqrt(own_n)) / alpha * own
            n[columns] = own_n + slope**2
    np.copyto(w, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), where=np.abs(z) > l1)
    return w


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Scores of whole texts, 0 to 1; texts are taken together up to ``PASS`` characters."""
    z = np.full(len(texts), weights[-1])
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end] or "") <= PASS):
            held += len(texts[end] or "")
            end += 1
        columns, owner = ngram_columns(texts[start:end])
        total = np.bincount(owner, weights=weights[columns], minlength=end - start)
        z[start:end] += total / np.sqrt(np.maximum(1, np.bincount(owner, minlength=end - start)))
        start = end
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quality_model(
    docs: DataFrame, labels: DataFrame, keep: str = "true", per_class: int = 3_000
) -> np.ndarray | float:
    """Weights, or a constant score where the labels hold no two classes to tell apart.

    They are fitted on ``per_class`` labelled documents of each class at most (those for which ``keep`` holds).
    The constant is the share of label 1, and one half without any label.
    """
    sample = labelled_sample(docs, labels, "quality", keep, per_class).toPandas()
    if sample["y"].nunique() < 2:
        return float(sample["y"].mean() if len(sample) else 0.5)
    sample = sample.sort_values(["text", "y"], kind="stable")
    return train(list(sample["text"]), sample["y"].to_numpy())


def quality_score(text: Column, model: np.ndarray | float, docs: DataFrame) -> Column:
    """Score of each text of ``docs``, 0 to 1.  Null texts and those without tokens get the constant's score."""
    if isinstance(model, float):
        return F.lit(model)
    # 2 MB, whatever the input.
    weights = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(list(texts), weights.value))

    return score(text)
