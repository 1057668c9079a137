"""Embedding near-dedup: sorted projection passes, and an exact cover of each label.

Each pass hashes a vector to the signs of BITS random projections and orders the vectors of a label
by these bits. Every vector is compared, in double precision, with the WINDOW vectors after it in
that order; pairs of cosine THRESHOLD or more are links, and links of all passes are united. All
passes share one range-partitioned sort by (pass, label, bits, id); the few rows at the edges of
partitions are sorted and compared once more, so windows cross partitions. Equal vectors enter
once, as a class with a count.

Windows bound the candidates of a pass, so a label with many vectors, or with vectors close together,
has pairs that no pass brings near each other. Therefore every pair of classes of a label is compared
too, by matrix products over pairs of tiles: links and exact link counts do not depend on PASSES and
WINDOW. A task holds two tiles and sends on at most one link and one count for each of their classes.
The work of a label grows with the square of its classes. Up to WIDE tiles have TILE classes, so that
small labels spread over tasks; larger labels have tiles of up to TILE_BYTES, which bounds the copies
of a vector.

Defined results: vectors that are null, zero, of no components or with null or non-finite
components, and those with a null label or null vec_id, link with nothing: n_links 0, component_id
their own vec_id, kept true (null for a null vec_id). Vectors of different lengths never link. A
repeated row is another vector: it links with its copy. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import materialize, ship_package

from .graph import components, stars
from .text import only

THRESHOLD = 0.93
PASSES = 20
WINDOW = 20
BITS = 48
TILE = 1024
#: Tiles of a label before they grow beyond TILE classes, and the bytes of vectors they grow to.
WIDE = 8
TILE_BYTES = 8 << 20
#: Rows of a tile that are multiplied at once.
STRIP = 256
SEED = 20


def projections(dim: int, passes: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec) with vec as doubles, null where the vector can't link."""
    value = F.col("embedding").cast("array<double>")
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(value) > 0)
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    )
    chosen = only(embeddings, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(F.coalesce(good, F.lit(False)), value).alias("x")
    )

    def pack(batches):
        for batch in batches:
            column = batch.column(2)
            flat = column.values.to_numpy(zero_copy_only=False) if len(column.values) else np.empty(0)
            ends = column.offsets.to_numpy()
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            blobs = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)]
            dims = [int(b - a) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "label", "dim", "vec"])

    return chosen.mapInArrow(pack, "vec_id long, label string, dim int, vec binary")


def _window_links(sorted_rows: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links inside each partition's order as stars (kind 0), and the rows at its edges (kind 1)."""
    schema = "kind int, a long, b long, pass int, label string, dim int, bits long, id long, vec binary"

    def compare(batches):
        held, rows = None, []
        a, b = [], []
        heads: list[pa.Table] = []
        n_head = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if n_head < window:
                heads.append(new.slice(0, window - n_head))
                n_head += heads[-1].num_rows
            joined = pa.concat_tables([held, new]).combine_chunks() if held is not None else new
            n, old = joined.num_rows, held.num_rows if held is not None else 0
            dims = joined["dim"].to_numpy()
            ids = joined["id"].to_numpy()
            same = (joined["pass"].to_numpy(), dims, joined["label"].to_numpy(zero_copy_only=False))
            blobs = joined["vec"].to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit([blobs[i] for i in at], int(dim))
                for shift in range(1, min(window, len(at) - 1) + 1):
                    i, j = at[:-shift], at[shift:]
                    use = (j >= old) & (j - i <= window)
                    for column in same:
                        use &= column[i] == column[j]
                    use = np.flatnonzero(use)
                    cosine = np.einsum("ij,ij->i", x[use], x[use + shift])
                    hit = cosine >= threshold
                    a.append(ids[i[use[hit]]])
                    b.append(ids[j[use[hit]]])
            held = joined.slice(max(0, n - window))
            rows.append(new.num_rows)
        if held is None:
            return
        x, y = stars(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2
        empty = lambda kind: pa.nulls(len(x), kind)
        yield pa.record_batch([pa.array(np.zeros(len(x), np.int32)), pa.array(x), pa.array(y), empty(pa.int32()), empty(pa.string()), empty(pa.int32()), empty(pa.int64()), empty(pa.int64()), empty(pa.binary())], names)
        head = pa.concat_tables(heads)
        total = sum(rows)
        # rows that are both among the first and the last of a small partition are sent once
        edge = pa.concat_tables([head, held.slice(max(0, held.num_rows - (total - head.num_rows)))]) if total > head.num_rows else head
        edge = edge.combine_chunks()
        for part in edge.to_batches():
            n = part.num_rows
            yield pa.record_batch([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *part.columns], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return sorted_rows.mapInArrow(compare, schema)


def links(classes: DataFrame, passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """Star links (a, b) between class ids; classes: (id, label, dim, vec)."""

    def project(batches):
        known: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            dims, blobs = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            for dim in np.unique(dims):
                if int(dim) not in known:
                    known[int(dim)] = projections(int(dim), passes)
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                bits = (unit([blobs[i] for i in at], int(dim)) @ known[int(dim)] > 0).reshape(len(at), passes, BITS) @ weights
                for p in range(passes):
                    yield pa.record_batch(
                        [pa.array(np.full(len(at), p, np.int32)), part.column(1), part.column(2), pa.array(bits[:, p]), part.column(0), part.column(3)], ["pass", "label", "dim", "bits", "id", "vec"]
                    )

    order = ["pass", "label", "dim", "bits", "id"]
    hashed = classes.select("id", "label", "dim", "vec").mapInArrow(project, "pass int, label string, dim int, bits long, id long, vec binary")
    n_parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = hashed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    first = materialize(_window_links(ranged, window, threshold), "windows")
    found = [first.where("kind = 0").select("a", "b")]
    edge = first.where("kind = 1").select(*order, "vec")
    # at most 2 * window rows a partition: fewer partitions each time, then one of bounded size
    n_rows = 2 * window * n_parts
    while True:
        n_parts = max(1, n_rows // 50_000)
        ordered = (edge.repartitionByRange(n_parts, *order) if n_parts > 1 else edge.coalesce(1)).sortWithinPartitions(*order)
        last = materialize(_window_links(ordered, window, threshold), "windows")
        found.append(last.where("kind = 0").select("a", "b"))
        if n_parts == 1:
            break
        edge, n_rows = last.where("kind = 1").select(*order, "vec"), 2 * window * n_parts
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def joined(hit: np.ndarray, x: np.ndarray, y: np.ndarray, group: np.ndarray) -> np.ndarray:
    """group (by place, the least place in it) after the hits between the places x (rows) and y (columns)."""
    while True:
        new = hit & (group[x][:, None] != group[y])
        rows, columns = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
        if not len(rows):
            return group
        # one link of each row and column at a time: the groups with links at least halve
        a = group[np.r_[x[rows], x[new[:, columns].argmax(axis=0)]]]
        b = group[np.r_[y[new[rows].argmax(axis=1)], y[columns]]]
        moved, least = stars(a, b)
        to = np.arange(len(group))
        to[moved] = least
        group = to[group]


def _covered(classes: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Every pair of a label compared: (id, links, other), a count of links (other null) or a link (links null)."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("m"))
    most = F.greatest(F.lit(WIDE), F.ceil(F.col("m") * F.col("dim") * 8 / TILE_BYTES))
    tiles = F.least(F.ceil(F.col("m") / tile), most).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    spread = classes.join(sizes, ["label", "dim"]).withColumn("tiles", tiles).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    n_groups = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spread.withColumn("other", other).select(
        F.xxhash64("label", "dim").alias("part"), "label", "id", "n", "dim", "vec", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        # labels of one tile share groups, larger ones have a group for each pair of tiles
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("label", "dim"), F.lit(n_groups))).otherwise(F.xxhash64("label", "dim", F.least("own", "other"), F.greatest("own", "other"))).alias("at"),
        (F.col("tiles") == 1).alias("small"),
    )

    def compare(table: pa.Table) -> pa.Table:
        d = {c: table[c].to_numpy(zero_copy_only=False) for c in ("part", "id", "n", "dim", "own", "i", "j")}
        names = table["label"].to_pylist()
        d["label"] = np.unique(np.array(names, object), return_inverse=True)[1]  # equal hashes are told apart
        blobs = table["vec"].to_pylist()
        keys = ("part", "label", "dim", "i", "j")
        order = np.lexsort((d["id"], d["own"], *(d[c] for c in reversed(keys))))
        key = np.stack([d[c][order] for c in keys])
        cuts = np.r_[0, np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1, len(order)]
        ids, counts, a, b = [], [], [], []
        for start, end in zip(cuts[:-1], cuts[1:]):
            rows = order[start:end]
            x = unit([blobs[r] for r in rows], int(d["dim"][rows[0]]))
            n, own, id_ = d["n"][rows].astype(float), d["own"][rows], d["id"][rows]
            i, j = d["i"][rows[0]], d["j"][rows[0]]
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            columns = x[right].T
            group, links = np.arange(len(rows)), np.zeros(len(rows))
            for low in range(0, len(left), STRIP):
                strip = left[low : low + STRIP]
                hit = x[strip] @ columns >= threshold
                if i == j:
                    hit[np.arange(len(strip)), low + np.arange(len(strip))] = True  # copies of the class itself
                links[strip] += hit @ n[right]
                if i != j:
                    links[right] += n[strip] @ hit
                group = joined(hit, strip, right, group)
            moved = np.flatnonzero(group != np.arange(len(rows)))
            ids.append(id_)
            counts.append(links)
            a.append(id_[moved])
            b.append(id_[group[moved]])
        ids, a, b = np.concatenate(ids), np.concatenate(a), np.concatenate(b)
        counts = pa.array(np.concatenate(counts).astype(np.int64))
        return pa.table({"id": pa.array(np.r_[ids, a]), "links": pa.concat_arrays([counts, pa.nulls(len(a), pa.int64())]), "other": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(b)])})

    return rows.groupBy("small", "at").applyInArrow(compare, "id long, links long, other long")


def dedup(embeddings: DataFrame, passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept."""
    ship_package(embeddings.sparkSession)
    rows = materialize(_prepared(embeddings), "vectors")
    classes = materialize(rows.where("vec IS NOT NULL").groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    covered = materialize(_covered(classes, threshold, tile), "vector_cover")
    near = links(classes, passes, window, threshold).unionByName(covered.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    found = components(near, "vector_links")
    placed = classes.join(found, classes["id"] == found["node"], "left").drop("node")
    counts = covered.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    summed = placed.join(counts, "id", "left").select(
        "label", "dim", "vec", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", "n") - 1).alias("n_links")
    )
    plain = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("vec IS NOT NULL").join(summed, ["label", "dim", "vec"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(plain).withColumn("kept", F.col("vec_id") == F.col("component_id"))
