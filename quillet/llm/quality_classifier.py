"""Quality classifier: supervised subword embeddings with a softmax output.

Each word of a text brings the hash of the whole word, of its character n-grams and of the pair it
makes with the word before, and each word that comes again at once the hash of that pattern; the
text's vector is the mean of their learned vectors, and a softmax over two classes follows. Training
is plain stochastic gradient descent in numpy over a bounded sample of labelled rows (PER_CLASS ids of
each class, weighted back to the classes' shares), whose hashed features are counted on the
executors; one task learns from them, so that the driver holds the finished numbers alone. Scoring
folds the two matrices: every feature then has one number, every word a sum of those, and whole texts
are scored by looking up words and pairs.

Defined results: a null or empty text has the score of the bias alone (the prior); null doc_ids
keep their rows and count as the empty id for the fold; repeated rows give repeated rows; extra
columns are ignored; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import ship_package

from .labelled import class_weights, training_labels
from .text import binary_column, filter_rows, held_out, map_batches, mix, only

BUCKETS = 1 << 16
DIM = 8
NGRAMS = (2, 3, 4)
#: Bound on the labelled rows of each class that training uses.
PER_CLASS = 2000
#: Buckets of the two word n-gram patterns "w w" and "w ? w".
REPEATS = (zlib.crc32(b"w w") % BUCKETS, zlib.crc32(b"w ? w") % BUCKETS)
EPOCHS = 12
BATCH = 32
RATE = 40.0
THRESHOLD = 0.3


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, with marks at both ends, and how many each word has."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    marked = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters up to the word's end
    owners = [np.arange(len(words))]
    buckets = [np.fromiter((zlib.crc32(b"w" + w) % BUCKETS for w in words), np.int32, len(words))]
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[at + k]
        buckets.append((mix(h) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[at])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(buckets)[order], np.bincount(np.concatenate(owners), minlength=len(words))


class WordTable(dict):
    """word -> row of tables that are kept beside it; forgets all between batches when it has grown too large."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.new = limit, []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def taken(self) -> list[bytes]:
        """The words that came since the last call."""
        out, self.new = self.new, []
        return out


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of a text's word pairs, from its words' hashes."""
    return (mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) % np.uint64(BUCKETS)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def repeats(words: list[bytes]) -> tuple[int, int]:
    """How often a word is the one before it, and the one before that: word n-grams by their pattern."""
    return sum(map(eq, words, words[1:])), sum(map(eq, words, words[2:]))


def counted_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and each one's share in all its features."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    known = WordTable()
    rows = known.rows(words)
    new = known.taken()
    buckets, sizes = word_features(new)
    total = np.bincount(buckets, np.repeat(np.bincount(rows), sizes), BUCKETS)
    total += np.bincount(pair_buckets(word_hashes(new)[rows]), minlength=BUCKETS)
    np.add.at(total, list(REPEATS), repeats(words))
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / total.sum()).astype(np.float32)


class Model:
    """The embedding and output matrices, learned by stochastic gradient descent."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weights: list[float], seed: int = 7):
        draw = np.random.default_rng(seed)
        self.vectors = np.ascontiguousarray(((draw.random((BUCKETS, DIM)) - 0.5) / DIM).T)  # a row for each dimension
        self.output = draw.standard_normal((DIM, 2)) / DIM
        self.bias = np.zeros(2)
        if len(y):
            prior = np.array([np.mean([weights[c] if c == k else 0.0 for c in y]) for k in (0, 1)])
            self.bias = np.log(np.clip(prior / prior.sum(), 1e-3, 1))
            for epoch in range(EPOCHS):
                rate = RATE * (1 - epoch / EPOCHS)
                order = draw.permutation(len(y))
                for at in range(0, len(y), BATCH):
                    self.step([docs[i] for i in order[at : at + BATCH]], y[order[at : at + BATCH]], weights, rate)

    def step(self, docs: list, y: np.ndarray, weights: list[float], rate: float) -> None:
        docs = [(i, v) if len(i) else (np.zeros(1, np.int32), np.zeros(1, np.float32)) for i, v in docs]
        ids, shares = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
        sizes = np.array([len(d[0]) for d in docs])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        hidden = np.stack([np.add.reduceat(own[ids] * shares, starts) for own in self.vectors], axis=1)
        logits = hidden @ self.output + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        grad = p * np.array(weights)[y][:, None] / len(y)
        back = grad @ self.output.T
        self.output -= rate * 0.05 * hidden.T @ grad
        self.bias -= rate * 0.01 * grad.sum(axis=0)
        doc = np.repeat(np.arange(len(docs)), sizes)
        for own, slope in zip(self.vectors, back.T):
            own -= rate * np.bincount(ids, shares * slope[doc], BUCKETS)

    def per_feature(self) -> tuple[np.ndarray, float]:
        """The log-odds of class 1 are linear in the mean vector: one number a feature, and the bias."""
        odds = self.output[:, 1] - self.output[:, 0]
        return (odds @ self.vectors).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Learn from documents and labels.quality; the features' numbers and the bias alone reach the driver."""
    ship_package(documents.sparkSession)
    chosen, sizes = training_labels(labels, "quality", per_class)
    sample = only(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [counted_features((t or b"").split()) for t in binary_column(batch, "text")]
            blobs = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
            return pa.record_batch([batch.column(0), batch.column(1), *blobs], ["doc_id", "y", "ids", "shares"])

        return step

    def fit(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=lambda k: (table["doc_id"][k].as_py(), table["ids"][k].as_py()))
        found = [(np.frombuffer(table["ids"][k].as_buffer(), np.int32), np.frombuffer(table["shares"][k].as_buffer(), np.float32)) for k in order]
        y = np.array([table["y"][k].as_py() for k in order], int)
        values, bias = Model(found, y, class_weights(y, sizes)).per_feature()
        return pa.table([pa.array([values.tobytes()], pa.binary()), pa.array([bias])], names=["feature_values", "bias"])

    # 2 * per_class rows at most, in one task
    found = map_batches(sample, make, "doc_id long, y int, ids binary, shares binary").groupBy(F.lit(0).alias("all")).applyInArrow(fit, "feature_values binary, bias double").collect()
    if not found:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(bytes(found[0].feature_values), np.float32), found[0].bias


def scorer(per_feature: np.ndarray, bias: float):
    """A function from UTF-8 texts to scores; it keeps the word table between its calls."""
    fresh = lambda: {"known": WordTable(), "value": np.empty(0), "count": np.empty(0), "hash": np.empty(0, np.uint64)}
    state = fresh()

    def sums(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of feature numbers and its number of features."""
        if len(state["known"]) > state["known"].limit:
            state.update(fresh())
        rows = [state["known"].rows(words) for words in texts]
        new = state["known"].taken()
        buckets, sizes = word_features(new)
        if len(sizes):
            state["hash"] = np.r_[state["hash"], word_hashes(new)]
            state["value"] = np.r_[state["value"], np.add.reduceat(per_feature[buckets].astype(float), np.r_[0, np.cumsum(sizes)[:-1]])]
            state["count"] = np.r_[state["count"], sizes]
        pairs = np.array([per_feature[pair_buckets(state["hash"][r])].sum(dtype=float) for r in rows])
        return pairs + [state["value"][r].sum() for r in rows], np.array([state["count"][r].sum() + max(0, len(r) - 1) for r in rows])

    def score(texts: list[bytes | None]) -> np.ndarray:
        scores = []
        for at in range(0, len(texts), 500):
            split = [(t or b"").split() for t in texts[at : at + 500]]
            total, n = sums(split)
            again = np.array([repeats(words) for words in split], float)
            total, n = total + again @ per_feature[list(REPEATS)], n + again.sum(axis=1)
            scores.append(1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + bias, -50, 50))))
        return np.concatenate(scores)

    return score


def score_quality(documents: DataFrame, labels: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD)."""
    ship_package(documents.sparkSession)
    values, bias = model if model is not None else train(documents, labels)
    docs = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(values)  # BUCKETS numbers, whatever the input

    def make():
        score = scorer(shared.value, bias)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = score(binary_column(batch, "text"))
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    return map_batches(docs, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score the threshold or more."""
    ship_package(documents.sparkSession)
    values, bias = train(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(values)

    def make():
        score = scorer(shared.value, bias)
        return lambda batch: score(binary_column(batch, "text")) >= threshold

    return filter_rows(documents, make)
