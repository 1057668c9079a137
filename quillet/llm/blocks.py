"""Blocks of documents, in id order or by hash, and a compact exchange of their sets of hashes.

Both repeat finders need to know which hashes of a block occur in other blocks. A block sends each
part of the hash space its sorted distinct hashes as one delta-coded blob; the part answers with one
byte string for each block, aligned with that order. So a hash costs the few bytes of its delta on
the way and a bit or a compressed byte on the way back, however often it occurs: a passage that a
third of all documents hold is one entry a block. Blocks and parts grow with the input's root, within
what a task can hold; beyond that the messages between them become smaller, down to one hash each, so
that the exchange stays in proportion to the words.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import binary_column, mix

#: Bytes of text in a block, and hashes in a part of the hash space, on average.
BLOCK_BYTES = 8 << 20
PART_HASHES = 1_500_000
LAST = np.iinfo(np.int64).max  # stands for a null id, which comes after all others
#: Input from which blocks and parts grow with its root, up to GROWTH times, so that there are fewer messages between them.
GROWS_FROM = 64 << 30
GROWTH = 4.0
#: Quantiles of the ids that are asked for at most; between two of them blocks are cut at equal distances.
CUTS = 4096
#: Blocks of one rank: those of an id with more text than a block, or of the null ids.
SUBS = 1 << 20

#: ids (LAST: null) and texts of a batch -> the number of each one's block
Numbering = Callable[[np.ndarray, np.ndarray], np.ndarray]


def growth(n_bytes: int) -> float:
    return min(GROWTH, max(1.0, math.sqrt(n_bytes / GROWS_FROM)))


def text_hash(texts: np.ndarray) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))


def hashed_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[Numbering, int]:
    """Blocks in no order, and the bytes of all texts; docs: (doc_id, text). Rows equal in both share a block."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(16, math.ceil(n_bytes / (block_bytes * growth(n_bytes))))

    def number(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
        return (mix(text_hash(texts) ^ mix(ids.astype(np.uint64))) % np.uint64(n_blocks)).astype(np.int64)

    return number, n_bytes


def ordered_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[Numbering, int]:
    """Blocks whose rank (number // SUBS) follows the ids, and the bytes of all texts; docs: (doc_id, text).

    The driver holds CUTS quantiles, and the ids that have more text than four blocks: those and the
    null ids have several blocks of one rank, by their texts' hash.
    """
    size = F.sum(F.octet_length("text"))
    n_bytes, low, high, null_bytes = docs.agg(size, F.min("doc_id"), F.max("doc_id"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text")))).first()
    n_bytes, null_bytes = n_bytes or 0, null_bytes or 0
    block_bytes = math.ceil(block_bytes * growth(n_bytes))
    n_blocks = max(16, -(-n_bytes // block_bytes))
    hot = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(size.alias("b"), F.count("*").alias("n")).where(f"b > {4 * block_bytes} AND n > 1").orderBy("doc_id").collect()
    n_cuts = min(n_blocks, CUTS)
    cuts = docs.approxQuantile("doc_id", [k / n_cuts for k in range(1, n_cuts)], 1 / (4 * n_cuts)) if low is not None else []
    edges = np.array(sorted({int(c) for c in cuts} | {int(r.doc_id) + k for r in hot for k in (0, 1) if int(r.doc_id) + k < LAST}), np.int64)
    per_cut = -(-n_blocks // n_cuts)
    starts, ends = np.r_[np.int64(low or 0), edges].astype(float), np.r_[edges, np.int64(high or 0)].astype(float)
    hot_ids, hot_subs = np.array([r.doc_id for r in hot], np.int64), np.array([-(-r.b // block_bytes) for r in hot], np.int64)
    null_rank, null_subs = (len(edges) + 1) * per_cut, max(1, -(-null_bytes // block_bytes))

    def number(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
        cut = np.searchsorted(edges, ids, side="right")
        share = (ids - starts[cut]) / np.maximum(ends[cut] - starts[cut], 1.0)
        rank = cut * per_cut + np.clip(np.floor(share * per_cut), 0, per_cut - 1).astype(np.int64)
        subs = np.ones(len(ids), np.int64)
        if len(hot_ids):
            at = np.minimum(np.searchsorted(hot_ids, ids), len(hot_ids) - 1)
            subs = np.where(hot_ids[at] == ids, hot_subs[at], 1)
        rank, subs = np.where(ids == LAST, null_rank, rank), np.where(ids == LAST, null_subs, subs)
        many = np.flatnonzero(subs > 1)
        sub = np.zeros(len(ids), np.int64)
        sub[many] = (text_hash(texts[many]) % subs[many].astype(np.uint64)).astype(np.int64)
        return rank * SUBS + sub

    return number, n_bytes


def pack_documents(docs: DataFrame, number: Numbering) -> DataFrame:
    """(block, blob): the documents of a block that a batch holds, compressed together."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(int(LAST)).to_numpy()
            texts = np.array([t or b"" for t in binary_column(batch, "text")] + [None], object)[:-1]
            block = number(ids, texts)
            blocks, blobs = [], []
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                own = texts[at]
                head = np.array([len(at), *ids[at], *map(len, own)], np.int64).tobytes()
                raw = head + b"".join(own)
                blobs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
                blocks.append(b)
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], ["block", "blob"])

    return docs.mapInArrow(pack, "block long, blob binary")


def unpack_documents(blobs: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block, by id (then by text, so that reruns agree)."""
    ids, texts = [], []
    for blob in blobs:
        raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 2 * n, 8)
        at = 8 + 16 * n
        for doc_id, size in zip(head[:n].tolist(), head[n:].tolist()):
            ids.append(doc_id)
            texts.append(raw[at : at + size])
            at += size
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]


def pack_sorted(h: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(part, n, width, blob) of each part's deltas; hashes sorted by part, then by value."""
    out = []
    if len(h):
        cuts = np.r_[0, np.flatnonzero(np.diff(p)) + 1, len(p)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            deltas = np.diff(h[a:b], prepend=np.uint64(0))
            width = max(1, (int(deltas.max()).bit_length() + 7) // 8)
            raw = deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            out.append((int(p[a]), b - a, width, np.ascontiguousarray(raw).tobytes()))
    return out


def pack_hashes(hashes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, bytes]]]:
    """The order (by part; hashes are sorted) and the packed parts."""
    order = np.argsort(parts, kind="stable")
    return order, pack_sorted(hashes[order], parts[order])


def unpack_hashes(n: int, width: int, blob: bytes) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(n, width)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64)


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and the number of each value's run."""
    first = np.r_[True, sorted_values[1:] != sorted_values[:-1]] if len(sorted_values) else np.empty(0, bool)
    return np.flatnonzero(first), np.cumsum(first) - 1


SETS = "part int, block long, n int, width int, blob binary"
ANSWERS = "block long, part int, n int, answer binary"


def sets_table(block: int, packed: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*packed)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    part, n, width, blob = (pa.array(c, k) for c, k in zip(columns, kinds))
    return pa.table([part, pa.array([block] * len(packed), pa.int64()), n, width, blob], names=["part", "block", "n", "width", "blob"])


def answers_in_order(table: pa.Table, total: int, order: np.ndarray, decode) -> np.ndarray:
    """The parts' answers put back to the order of the block's sorted distinct hashes."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "n", "answer"))))
    flat = np.concatenate([decode(answer, n) for _, n, answer in rows]) if rows else np.empty(0, np.uint8)
    if len(flat) != total:
        raise ValueError(f"{len(flat)} answers to {total} hashes")
    out = np.empty(total, flat.dtype)
    out[order] = flat
    return out
