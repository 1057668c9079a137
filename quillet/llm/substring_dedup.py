"""Substring dedup: prefix-partitioned suffix trees over words.

Every word position that has WINDOW words to the end of its document starts a suffix. Variable-length
prefixes split the suffixes into groups that fit in memory: a prefix goes on while its last word is
one of the corpus's frequent words (a first count over all texts finds them), so no group holds more
suffixes than one infrequent word has occurrences. Prefixes are dealt to parts; each part builds
the subtree of its suffixes to depth WINDOW by sorting their path labels (64-bit hashes inside a
part, so 64 + log2(parts) bits in all). A node at that depth with leaves of two documents or more is
a repeat, and neighbouring ones join to maximal repeats when they are marked in a document's words.
Blocks of documents are in id order, so a part only answers, for each leaf, whether an earlier block
has one too; inside a block the ids decide.

Defined results: a null or empty text has no words and an empty kept text; a null doc_id comes after
all others and is never a smaller id than another; rows with equal doc_id don't remove each
other's words; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import ship_package

from .blocks import ANSWERS, LAST, PART_HASHES, SETS, SUBS, answers_in_order, growth, ordered_blocks, pack_documents, pack_hashes, runs_of, sets_table, unpack_documents, unpack_hashes
from .text import WordHashes, binary_column, mix, only, window_hashes

WINDOW = 13
_STEP = np.uint64(0x9E3779B97F4A7C15)


def frequent_words(docs: DataFrame, share: float) -> np.ndarray:
    """Hashes of the words with at least this share of all words (1 / share of them at most)."""

    def count(batches):
        kept: Counter[bytes] = Counter()
        total = 0
        for batch in batches:
            for text in binary_column(batch, "text"):
                words = (text or b"").split()
                total += len(words)
                kept.update(words)
                if len(kept) > 400_000:  # what is below the share so far may be forgotten: counts only balance the parts
                    kept = Counter({w: n for w, n in kept.items() if n >= share * total / 2})
        rows = [(w, n) for w, n in kept.items() if n >= share * total / 2]
        words, counts = [None, *(r[0] for r in rows)], [total, *(r[1] for r in rows)]  # the null word has the task's total
        yield pa.record_batch([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc(F.col("word").isNull()), F.desc("n"), "word").limit(1 + int(2 / share)).collect()
    total = rows[0].n if rows else 0
    hashes = WordHashes()
    return np.sort(np.array([hashes[bytes(r.word)] for r in rows[1:] if r.n >= share * total], np.uint64))


def suffixes(texts: list[bytes], hashes: WordHashes, frequent: np.ndarray, n_parts: int, window: int):
    """Of a block: the path labels and parts of its suffixes, their documents, and each document's words."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = hashes.of([w for own in words for w in own])
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))  # words up to the document's end
    at = np.flatnonzero(left >= window)
    label = window_hashes(h, window)[at] if len(at) else np.empty(0, np.uint64)
    # the prefix goes on while its last word is frequent
    k = np.searchsorted(frequent, h)
    common = frequent[np.minimum(k, len(frequent) - 1)] == h if len(frequent) else np.zeros(len(h), bool)
    prefix = h[at].copy()
    open_ = np.flatnonzero(common[at])
    for step in range(1, window):
        if not len(open_):
            break
        word = h[at[open_] + step]
        prefix[open_] = prefix[open_] * _STEP + word
        open_ = open_[common[at[open_] + step]]
    return label, (mix(prefix) % np.uint64(n_parts)).astype(np.int32), at, doc, words, sizes


def dedup(documents: DataFrame, window: int = WINDOW, block_bytes: int | None = None, part_hashes: int = PART_HASHES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_text (the kept words, joined by one space)."""
    ship_package(documents.sparkSession)
    docs = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    number, n_bytes = ordered_blocks(docs, block_bytes) if block_bytes else ordered_blocks(docs)
    n_parts = int(max(64, n_bytes // 6 // (part_hashes * growth(n_bytes))))
    frequent = frequent_words(docs, 1 / (4 * n_parts))
    packed = pack_documents(docs, number)

    def leaves(table: pa.Table) -> pa.Table:
        _, texts = unpack_documents(table["blob"].to_pylist())
        label, part, *_ = suffixes(texts, WordHashes(), frequent, n_parts, window)
        distinct, first = np.unique(label, return_index=True)
        return sets_table(table["block"][0].as_py(), pack_hashes(distinct, part[first])[1])

    def subtree(table: pa.Table) -> pa.Table:
        """Deep nodes of one part: a bit for each leaf, whether an earlier block has it too."""
        rows = sorted(zip(*(table[c].to_pylist() for c in ("block", "n", "width", "blob"))))
        label = np.concatenate([unpack_hashes(*r[1:]) for r in rows])
        order = np.argsort(label, kind="stable")  # leaves of a node stay in block order
        starts, run = runs_of(label[order])
        rank = np.repeat([r[0] // SUBS for r in rows], [r[1] for r in rows])[order]
        earlier = np.empty(len(label), bool)
        earlier[order] = rank > rank[starts][run]  # blocks of one rank hold one id, or the null ids
        ends = np.cumsum([r[1] for r in rows])
        bits = [np.packbits(earlier[e - r[1] : e]).tobytes() for e, r in zip(ends, rows)]
        part = [table["part"][0].as_py()] * len(rows)
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array(part, pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(bits, pa.binary())], names=["block", "part", "n", "answer"])

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = unpack_documents(table["blob"].to_pylist()) if table.num_rows else (np.empty(0, np.int64), [])
        label, part, at, doc, words, sizes = suffixes(texts, WordHashes(), frequent, n_parts, window)
        order = np.argsort(label, kind="stable")  # equal labels by document
        starts, run = runs_of(label[order])
        first = order[starts]
        by_part, _ = pack_hashes(label[first], part[first])
        earlier = answers_in_order(answers, len(first), by_part, lambda a, n: np.unpackbits(np.frombuffer(a, np.uint8), count=n))
        least = ids[doc[at[first]]][run]
        again = np.empty(len(label), bool)
        again[order] = (earlier[run] > 0) | (ids[doc[at[order]]] > least)
        change = np.zeros(len(doc) + 1, np.int32)
        np.add.at(change, at[again], 1)
        np.add.at(change, at[again] + window, -1)
        keep = np.cumsum(change[:-1]) == 0
        ends = np.cumsum(sizes)
        n_kept, kept = [], []
        for own, e in zip(words, ends.tolist()):
            mask = keep[e - len(own) : e]
            if mask.all():
                n_kept.append(len(own))
                kept.append(b" ".join(own))
            else:
                left = [own[i] for i in np.flatnonzero(mask).tolist()]
                n_kept.append(len(left))
                kept.append(b" ".join(left))
        null = ids == LAST
        return pa.table(
            [pa.array(ids, mask=null), pa.array(sizes), pa.array(sizes - np.array(n_kept, np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]
        )

    answers = packed.groupBy("block").applyInArrow(leaves, SETS).groupBy("part").applyInArrow(subtree, ANSWERS)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(mark, "doc_id long, n_words long, n_removed long, kept_text string")
