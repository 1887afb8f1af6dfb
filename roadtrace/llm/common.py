"""What several operators share: folds, bounded labelled samples, written tables, cached lookups."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.staging import staged as checkpointed


def remainder(divisor: int) -> str:
    """SQL: crc32 of ``doc_id`` as text, modulo ``divisor``; a null id gives null."""
    return f"crc32(cast(cast(doc_id as string) as binary)) % {divisor}"


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: str, per_class: int) -> DataFrame:
    """Texts of at most ``per_class`` labelled documents of each class 0 and 1: columns ``text``, ``y``.

    ``keep`` says, in SQL and in terms of ``doc_id``, from which documents labels may be learnt.  Which rows are taken
    depends on a hash of the id alone.  The choice is made on the narrow label table and holds at most
    ``2 * per_class`` ids, which is why it may be sent to every task: texts are not shuffled for it.
    """
    known = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & F.expr(keep))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"), F.min("y").alias("low"))
        .where(F.col("y") == F.col("low"))
        .select("doc_id", "y", F.xxhash64("doc_id").alias("turn"))
    )
    chosen = [known.where(F.col("y") == y).orderBy("turn", "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "y"))
    return docs.select("doc_id", "text").join(ids, "doc_id").where(F.col("text").isNotNull()).select("text", "y")


__all__ = ["Cached", "checkpointed", "group_sums", "labelled_sample", "lengths_to_bounds", "logistic_fit", "remainder", "table"]


class Cached(dict):
    """Values of a function of strings, kept for the life of a Python worker, ``limit`` of them at most."""

    def __init__(self, of, limit: int):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.of(key)
        return value


def lengths_to_bounds(lengths: Iterable[int]) -> np.ndarray:
    """Start of each group and the end of the last one."""
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, dtype=np.int64))])


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; empty groups give 0."""
    running = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return running[bounds[1:]] - running[bounds[:-1]]


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a small logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
