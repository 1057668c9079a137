"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text (FEATURES): densities of two lexicons (a fixed one and one learned from the
training rows by log-odds), the same after undoing obfuscation, how near lexicon words stand to
second-person pronouns, and rates of capitals, punctuation, digits inside words and repeated letters.
Trees of depth DEPTH are boosted in numpy on the logistic loss over a bounded sample of labelled
rows (PER_CLASS ids of each class, weighted back to the classes' shares); a third of the sample is
kept from the trees and fits the isotonic curve that maps margins to probabilities.

Defined results: a null or empty text has all features 0; null doc_ids keep their rows and count as
the empty id for the fold; repeated rows give repeated rows; extra columns are ignored; without
labelled rows of both classes every score is the prior.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import ship_package

from .labelled import class_weights, training_labels
from .text import held_out, map_batches, only

#: Bound on the labelled rows of each class that training uses, and on the learned lexicon.
PER_CLASS = 3000
LEXICON_SIZE = 300
THRESHOLD = 0.5
ROUNDS, DEPTH, RATE, BINS, MIN_LEAF, RIDGE = 60, 3, 0.15, 32, 20, 1.0

# Common insults and second-person pronouns of the four languages.
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb fool fools clown trash garbage loser losers pathetic worthless
    disgusting scum jerk creep hate hateful ugly imbecile cretin vermin pig swine shut kill die
    dumm trottel arschloch abschaum widerlich schwein hurensohn depp
    connard salaud abruti crétin ordure pourriture débile nul idiote
    estúpido imbécil basura asqueroso tonto cabrón idiota gilipollas""".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself ya u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
)
#: Characters that stand for a letter in obfuscated words.
LOOKALIKES = str.maketrans("013457@$!|+€", "oieastasiite")

FEATURES = (
    "fixed learned fixed_plain learned_plain hidden weight_sum weight_max near_fixed near_learned near_any "
    "capital_words capital_letters exclamations questions marks digits_in_words stretched word_length log_words spaced"
).split()
_LETTERS = re.compile(r"[^\w]|_|\d")
_STRETCHED = re.compile(r"(.)\1\1")


def plain(word: str) -> str:
    """A word as the lexicons hold it: lower case, no marks at its ends."""
    return word.strip("\"'.,;:!?()[]{}<>*#$%&-_~`|/\\+=").lower()


def undone(word: str) -> str:
    """A word with look-alikes, inner marks and stretched letters undone."""
    word = _LETTERS.sub("", word.lower().strip("\"'.,;:?()[]{}<>").translate(LOOKALIKES))
    return _STRETCHED.sub(r"\1", word) if len(word) > 3 else word


#: Columns of the word table: what a word alone tells.
WORD_COLUMNS = "fixed weight hidden_fixed hidden_weight second_person shouted mixed stretched length capitals bangs queries marks single".split()


class WordFacts(dict):
    """word -> row of `table`, whose columns are WORD_COLUMNS; reset() forgets all once it has grown too large."""

    def __init__(self, lexicon: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.lexicon, self.limit, self.new = lexicon, limit, []
        self.table = np.empty((0, len(WORD_COLUMNS)), np.float32)

    def __missing__(self, word: str) -> int:
        base = plain(word)
        other = base if word.isalpha() and not _STRETCHED.search(word) else undone(word)
        hidden = other != base
        self.new.append((
            base in INSULTS, self.lexicon.get(base, 0.0), hidden and other in INSULTS, self.lexicon.get(other, 0.0) if hidden else 0.0,
            base in SECOND_PERSON, len(base) > 1 and word.isupper(),
            any(map(str.isdigit, base)) and any(map(str.isalpha, base)), bool(_STRETCHED.search(base)), len(word),
            sum(map(str.isupper, word)), word.count("!"), word.count("?"), sum(map(word.count, "*#$%&@")), len(base) == 1 and base.isalpha(),
        ))
        found = self[word] = len(self)
        return found

    def rows(self, words: list[str]) -> np.ndarray:
        """The table's rows of the words."""
        if len(self) > self.limit:
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, np.float32)])
            self.new = []
        return self.table[at]


def text_features(a: np.ndarray) -> list[float]:
    """FEATURES of a text from its words' rows."""
    n = len(a)
    if not n:
        return [0.0] * len(FEATURES)
    total = a.sum(axis=0, dtype=np.float64)
    fixed, learned, hidden = a[:, 0] > 0, a[:, 1] > 0, (a[:, 2] > 0) | (a[:, 3] > 0)
    weights = np.maximum(a[:, 1], a[:, 3])
    you = np.flatnonzero(a[:, 4])

    def near(hits: np.ndarray) -> float:
        """1 / (1 + the least distance in words between a hit and a second-person pronoun)."""
        at = np.flatnonzero(hits)
        if not len(at) or not len(you):
            return 0.0
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.clip(k, 0, len(you) - 1)]), np.abs(at - you[np.clip(k - 1, 0, len(you) - 1)]))
        return float(1 / (1 + gap.min()))

    chars = total[8] + n
    spaced = float((a[3:, 13] * a[2:-1, 13] * a[1:-2, 13] * a[:-3, 13]).sum()) if total[13] >= 4 else 0.0
    n_fixed, n_learned = float(fixed.sum()), float(learned.sum())
    return [
        n_fixed / n, n_learned / n, float(n_fixed > 0), n_learned, float(hidden.sum()), float(weights.sum()), float(weights.max()),
        near(fixed | (a[:, 2] > 0)), near(learned), near(fixed | learned | hidden),
        total[5] / n, total[9] / chars, total[10] / n, total[11] / n, total[12] / chars,
        total[6] / n, total[7] / n, total[8] / n, float(np.log1p(n)), spaced,
    ]


def features(text: str, facts: WordFacts) -> list[float]:
    return text_features(facts.rows(text.split()))


def feature_matrix(texts: list[str | None], facts: WordFacts) -> np.ndarray:
    """One row of FEATURES a text; new words of many texts enter the table at once."""
    out = []
    for at in range(0, len(texts), 200):
        split = [(t or "").split() for t in texts[at : at + 200]]
        rows = facts.rows([w for words in split for w in words])
        ends = np.cumsum([len(words) for words in split])
        out += [text_features(rows[e - len(words) : e]) for e, words in zip(ends, split)]
    return np.array(out).reshape(len(texts), len(FEATURES))


class Trees:
    """Boosted regression trees on binned features; each tree is three flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        # a feature that is mostly one value still gets edges among the rest
        for k in range(x.shape[1]):
            rest = x[x[:, k] > 0, k]
            if len(rest) >= MIN_LEAF:
                self.edges[k] = np.unique(np.r_[0.0, self.edges[k], np.quantile(rest, np.linspace(0, 1, 17)[1:-1])])
        b = self.binned(x)
        p = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.trees: list[list[tuple]] = []
        margin = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self.grow(b, w * (y - p), w * p * (1 - p))
            self.trees.append(tree)
            margin += self.walk(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), int)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes (feature, bin, left, right, value); rows with bin <= split go left."""
        nodes: list[tuple] = []

        def make(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append((-1, 0, 0, 0, RATE * gs / (hs + RIDGE)))
            if depth == DEPTH or len(rows) < 2 * MIN_LEAF:
                return at
            best = (1e-9, -1, 0)
            for k, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                size = len(edges) + 1
                gl, hl, nl = (np.cumsum(np.bincount(b[rows, k], v, size))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                gain[(nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF)] = 0
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), k, j)
            if best[1] >= 0:
                _, k, j = best
                left = b[rows, k] <= j
                nodes[at] = (k, j, make(rows[left], depth + 1), make(rows[~left], depth + 1), 0.0)
            return at

        make(np.arange(len(g)), 0)
        return nodes

    @staticmethod
    def walk(tree: list[tuple], b: np.ndarray) -> np.ndarray:
        feature, split, left, right, value = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(b), int)
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            go = b[np.arange(len(b)), np.maximum(feature[at], 0)] <= split[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + sum((self.walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability) of the nearest non-decreasing curve."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        blocks.append([yi * wi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray, sizes: dict[int, int], lexicon: dict[str, float]):
        self.lexicon = lexicon
        total = max(1, sum(sizes.values()))
        self.prior = sizes.get(1, 0) / total if sizes else 0.5
        self.trees = None
        if len(np.unique(y)) < 2 or len(y) < 4 * MIN_LEAF:
            return
        fit, rest = fold != 0, fold == 0
        if len(np.unique(y[fit])) < 2 or len(np.unique(y[rest])) < 2:
            fit = rest = np.ones(len(y), bool)
        weight = np.array(class_weights(y, sizes))[y]
        self.trees = Trees(x[fit], y[fit], weight[fit])
        self.knots = isotonic(self.trees.margin(x[rest]), y[rest].astype(float), weight[rest])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        margin = self.trees.margin(x)
        # a share of the raw probability keeps the order inside flat parts of the curve
        return 0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin))


def learned_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Words that toxic training rows hold far more often, by smoothed log-odds of row counts."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ys, words = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w for w in map(plain, (text or "").split()) if 2 < len(w) <= 40}
                words += own
                ys += [y] * len(own)
            return pa.record_batch([pa.array(ys, pa.int32()), pa.array(words, pa.string())], ["y", "word"])

        return step

    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counts = map_batches(sample.select("y", "text"), make, "y int, word string").groupBy("word").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    odds = F.log((F.col("bad") + 0.1) / (n[1] + 1)) - F.log((F.col("n") - F.col("bad") + 0.1) / (n[0] + 1))
    top = counts.where(F.col("bad") >= 5).withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(size)
    return {r.word: float(r.odds) for r in top.collect()}


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from documents and labels.toxic; the dense features of the sample alone reach the driver."""
    ship_package(documents.sparkSession)
    chosen, sizes = training_labels(labels, "toxic", per_class)
    third = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 3
    sample = only(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", third.cast("int").alias("fold"), "text")
    lexicon = learned_lexicon(sample.where("fold <> 0"))  # the fold of the isotonic curve stays unseen

    def make():
        facts = WordFacts(lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = feature_matrix(batch.column(3).to_pylist(), facts)
            return pa.record_batch([*batch.columns[:3], pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"])

        return step

    rows = map_batches(sample, make, "doc_id long, y int, fold int, x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return Model(x, np.array([r["y"] for r in rows], int), np.array([r["fold"] for r in rows], int), sizes, lexicon)


def score_toxicity(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD)."""
    ship_package(documents.sparkSession)
    learned = model or train(documents, labels)
    docs = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def make():
        facts = WordFacts(learned.lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = feature_matrix(batch.column(2).to_pylist(), facts)
            scores = np.clip(learned.score(x), 0, 1)
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    return map_batches(docs, make, "doc_id long, held_out boolean, score double, predicted int")
