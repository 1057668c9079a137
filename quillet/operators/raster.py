"""Rasters in long form, (crop_id, y, x, v): histograms and thresholds in expressions, labelling one crop at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paging import by_page


def histogram(pixels: DataFrame) -> DataFrame:
    """(crop_id, v, n, below): how many pixels have a value, and how many a lower one; 256 rows a crop at most."""
    counts = pixels.groupBy("crop_id", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("crop_id").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0)))


def paper_and_white(pixels: DataFrame) -> DataFrame:
    """(crop_id, median, p95): the least values that half, and 95 of a hundred, of the pixels don't exceed."""
    h = histogram(pixels).withColumn("total", F.sum("n").over(Window.partitionBy("crop_id")))
    reached = lambda share: F.min(F.when(F.col("below") + F.col("n") >= share * F.col("total"), F.col("v")))
    return h.groupBy("crop_id").agg(reached(0.5).alias("median"), reached(0.95).alias("p95"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(crop_id, threshold): the value (the least of equals) that best parts a crop's histogram in two; a flat crop has none."""
    up_to = Window.partitionBy("crop_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    crop = Window.partitionBy("crop_id")
    h = histogram(pixels).withColumn("w0", F.sum("n").over(up_to)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(up_to)).withColumn("w", F.sum("n").over(crop)).withColumn("s", F.sum(F.col("n") * F.col("v")).over(crop))
    between = F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), 2)
    scored = h.where("w0 < w").withColumn("score", between).withColumn("k", F.row_number().over(Window.partitionBy("crop_id").orderBy(F.desc("score"), "v")))
    return scored.where("k = 1").select("crop_id", F.col("v").alias("threshold"))


def ink(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The pixels at or below their crop's threshold."""
    return pixels.join(thresholds, "crop_id").where(F.col("v") <= F.col("threshold")).select("crop_id", "y", "x")


def runs(ink_pixels: DataFrame) -> DataFrame:
    """(crop_id, y, x0, x1): horizontal runs of ink, as islands of x minus rank."""
    order = Window.partitionBy("crop_id", "y").orderBy("x")
    return ink_pixels.distinct().withColumn("g", F.col("x") - F.row_number().over(order)).groupBy("crop_id", "y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("g")


def label_components(ink_pixels: DataFrame) -> DataFrame:
    """(crop_id, label, x0, y0, x1, y1, pixels) of 8-connected ink; labels are numbered by top, then left."""

    def label(crop: pd.DataFrame) -> pd.DataFrame:
        crop = crop.drop_duplicates(["y", "x"]).sort_values(["y", "x"])
        y, x = crop.y.to_numpy(), crop.x.to_numpy()
        width = int(x.max() - x.min()) + 3
        key = (y - y.min()) * width + (x - x.min()) + 1
        at = {int(k): i for i, k in enumerate(key)}
        parent = np.arange(len(key))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, k in enumerate(key.tolist()):
            for step in (1, width - 1, width, width + 1):
                j = at.get(k + step)
                if j is not None:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        roots = np.array([root(i) for i in range(len(key))])
        boxes = pd.DataFrame({"root": roots, "x": x, "y": y}).groupby("root").agg(x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max"), pixels=("x", "size"))
        boxes = boxes.sort_values(["y0", "x0"]).reset_index(drop=True)
        boxes["x1"] += 1
        boxes["y1"] += 1
        boxes.insert(0, "label", np.arange(len(boxes)))
        boxes.insert(0, "crop_id", crop.crop_id.iloc[0])
        return boxes

    return by_page(ink_pixels, label, "crop_id long, label int, x0 int, y0 int, x1 int, y1 int, pixels int", key="crop_id")


def suppressed_peaks(peaks: DataFrame, radius: float) -> DataFrame:
    """(page_id, x, y, score): strongest first (then by y, x), each peak that no kept one is nearer to than the radius."""

    def keep(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["score", "y", "x"], ascending=[False, True, True])
        kept: list[tuple[float, float, float]] = []
        for x, y, s in zip(page.x, page.y, page.score):
            if all((x - a) ** 2 + (y - b) ** 2 >= radius**2 for a, b, _ in kept):
                kept.append((x, y, s))
        return pd.DataFrame(kept, columns=["x", "y", "score"]).assign(page_id=page.page_id.iloc[0])[["page_id", "x", "y", "score"]]

    return by_page(peaks, keep, "page_id long, x double, y double, score double")


def local_mean(pixels: DataFrame, radius: int) -> DataFrame:
    """(crop_id, y, x, mean) over a square window, from one table of running sums a crop."""

    def mean(crop: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = crop.y.min(), crop.x.min()
        shape = (int(crop.y.max() - y0) + 1, int(crop.x.max() - x0) + 1)
        v, n = np.zeros(shape), np.zeros(shape)
        at = (crop.y.to_numpy() - y0, crop.x.to_numpy() - x0)
        v[at], n[at] = crop.v, 1
        total, count = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (v, n))
        t, b = np.clip(at[0] - radius, 0, shape[0]), np.clip(at[0] + radius + 1, 0, shape[0])
        l, r = np.clip(at[1] - radius, 0, shape[1]), np.clip(at[1] + radius + 1, 0, shape[1])
        window = lambda a: a[b, r] - a[t, r] - a[b, l] + a[t, l]
        return pd.DataFrame({"crop_id": crop.crop_id, "y": crop.y, "x": crop.x, "mean": window(total) / window(count)})

    return by_page(pixels, mean, "crop_id long, y int, x int, mean double", key="crop_id")
