"""Bounded, documented samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import held_out, only


def training_labels(labels: DataFrame, target: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most per_class ids of each class, and the classes' sizes before that bound.

    Only ids outside the held-out fold; null labels and ids are left out, an id that is labelled
    more than once counts with its greatest label. The sample is the least by hash of the id, so
    reruns agree. Both results are bounded by per_class and can be broadcast.
    """
    known = (
        only(labels, "doc_id", target)
        .where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max(target) > 0).cast("int").alias("y"))
    )
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    kept = [known.where(F.col("y") == y).orderBy(*by_hash).limit(per_class) for y in (0, 1)]
    return kept[0].unionByName(kept[1]), sizes


def class_weights(y, sizes: dict[int, int]) -> list[float]:
    """Weights that give each class of the sample its share in all labelled rows."""
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    total = max(1, sum(sizes.values()))
    return [sizes.get(c, 0) / total * len(y) / n[c] for c in (0, 1)]
