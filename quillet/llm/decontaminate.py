"""Benchmark decontamination: latent semantic retrieval, then longest-common-subsequence and answer checks.

1. Document frequencies of the benchmark's words over all documents, counted in one pass, give IDF
   weights; frequent words weigh little, but never nothing.
2. The benchmark's passages (of PASSAGE words, half overlapping; short items are one passage) are TF-IDF
   rows. A distributed randomised SVD finds their leading right singular vectors: each partition sends
   A'(A Omega) for its rows (a range finder with POWER power steps), and an orthonormal basis is made
   of the sum. The space keeps as many directions as hold KEPT of the rows' energy, RANK at most.
   Words outside the benchmark have no weight in any passage, so the basis is zero there and a
   document's other words only lengthen its vectors.
3. Every window of every whole text (PASSAGE words, in steps of a quarter) is folded into that space;
   its dot product with each passage's unit point, over the window's whole TF-IDF length, is compared
   with CANDIDATE times the share of the passage that the space keeps. The sum of the most that each
   word can add to any passage's product bounds it, so most windows are done after one sum.
4. A candidate is checked by words: the longest common subsequence of the passage and the text around
   the window, over the passage's length. EXACT or more is contamination; between PARAPHRASE and
   EXACT the answer must be there too (the item's answer column, else the rarest words of its last
   sentence, ANSWER of them or more).
5. The cosine's cut can lose a copy among words of great weight, so candidates are found by words too,
   with no loss at any number of documents: a stretch that holds `need` of a passage's m words in order
   holds at least k of its m - need + k rarest. Every two neighbouring blocks of BLOCK words, in which
   any stretch of up to twice a passage's length lies, are counted so for every passage, and those with
   k or more are checked as above, stretch by stretch. Rarity decides the cost alone, not the result.

The benchmark is the stated query set. Its items come to the driver one block of BLOCK_ITEMS at a time,
each with a space of its own; a task holds PASS_BLOCKS blocks, and a larger benchmark is searched in
several passes whose findings are joined by the texts' hashes.

Defined results: null or empty texts are clean; a null doc_id keeps its row; repeated rows give
repeated rows; null or empty items are ignored; items of fewer than MIN_ITEM_WORDS words
have no point in the space and are found by words (step 5), under the same checks; items of fewer than SHORT words must occur word for word, as a few of their words in order are no evidence, which a
hash of every run of as many words finds; an empty benchmark leaves all documents clean; extra columns are ignored by the
report and kept by remove().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import materialize, ship_package

from .text import WordHashes, filter_rows, only, window_hashes

PASSAGE = 32
RANK = 256
#: Share of the passages' squared length that the space keeps, if RANK directions can.
KEPT = 0.9
OVERSAMPLING = 16
POWER = 2
CANDIDATE = 0.35
EXACT = 0.8
PARAPHRASE = 0.6
ANSWER = 0.5
#: Items with fewer words are left to the search by words, those with fewer than SHORT to the exact path.
MIN_ITEM_WORDS = 12
SHORT = 5
BLOCK_ITEMS = 250
#: Blocks of items that a task holds at once.
PASS_BLOCKS = 16
#: Words of a text's block in the search by words: a stretch of 2 * PASSAGE words lies in two neighbouring ones.
BLOCK = 2 * PASSAGE
#: Blocks that are counted at once.
BLOCKS = 256
_STRIP = "\"'.,;:!?()[]{}<>*#$%&|-_"


def normal(word: str) -> str:
    return word.lower().strip(_STRIP)


def words_of(text: str) -> list[str]:
    """Lower-case words without marks at their ends; words of marks only are left out."""
    return [w for w in map(normal, text.split()) if w]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit rows: one big-integer step per word of b."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = masks.get(w)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Benchmark:
    """One block of items: words, passages, weights and, once fitted, the latent space."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        self.items = [(k, words_of(t), words_of(a) if a else None, t) for k, t, a in items]
        self.items = [x for x in self.items if x[1]]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in self.items for w in x[1]}))}
        self.passages: list[tuple[int, int, int]] = []  # item's place, start, end
        for p, (_, words, _, _) in enumerate(self.items):
            starts = [0] if len(words) <= PASSAGE else [*range(0, len(words) - PASSAGE, PASSAGE // 2), len(words) - PASSAGE]
            self.passages += [(p, s, min(len(words), s + PASSAGE)) for s in starts]
        self.idf = np.ones(len(self.vocabulary))
        self.df = np.zeros(len(self.vocabulary))
        self.by_words = self.passages
        self.other = 1.0
        self.basis = self.points = self.limit = None

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Weights by document frequency; short items are left to the search by words."""
        self.idf = np.log((n_docs + 1) / (df + 1)) + 0.1
        self.other = float(np.log(n_docs + 1) + 0.1)
        self.df = df
        long = lambda n: {p for p, x in enumerate(self.items) if len(x[1]) >= n}
        by_words, in_space = long(SHORT), long(MIN_ITEM_WORDS)
        self.by_words = [x for x in self.passages if x[0] in by_words]
        self.passages = [x for x in self.by_words if x[0] in in_space]
        self.exact: dict[int, dict[int, list[int]]] = {}
        hashes = WordHashes()
        for p in sorted(set(range(len(self.items))) - by_words):
            words = [w.encode() for w in self.items[p][1]]
            self.exact.setdefault(len(words), {}).setdefault(int(window_hashes(hashes.of(words), len(words))[0]), []).append(p)

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit TF-IDF rows of the passages: (columns, values)."""
        out = []
        for p, start, end in self.passages:
            ids, tf = np.unique([self.vocabulary[w] for w in self.items[p][1][start:end]], return_counts=True)
            v = tf * self.idf[ids]
            out.append((ids, v / np.linalg.norm(v)))
        return out

    def place(self, basis: np.ndarray) -> None:
        self.basis = (basis * self.idf[:, None]).astype(np.float32)  # a word's contribution to a window's point
        points = np.stack([v @ basis[ids] for ids, v in self.rows()]) if self.passages else np.zeros((0, basis.shape[1]))
        kept = np.maximum(np.linalg.norm(points, axis=1), 1e-9)  # the share of a unit row that the space keeps
        self.points, self.limit = (points / kept[:, None]).astype(np.float32), kept.astype(np.float32)

    def answer(self, p: int) -> list[str]:
        """The answer's words: given, or the rarer half of the item's last sentence."""
        _, words, given, text = self.items[p]
        if given is not None:
            return given
        last = [s for s in re.split(r"[.!?]\s+|\n", text) if words_of(s)][-1]
        own = sorted(set(words_of(last)), key=lambda w: (self.df[self.vocabulary[w]], w))
        return own[: max(1, (len(own) + 1) // 2)]


def randomised_basis(spark, rows: list[tuple[np.ndarray, np.ndarray]], n_words: int, rank: int = RANK, kept: float = 1.0, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors of the unit rows, `rank` or as many as hold `kept` of their energy: power iterations of A'A over partitions of rows."""
    width = min(rank + OVERSAMPLING, n_words, len(rows))
    omega = np.random.default_rng(seed).standard_normal((n_words, width))
    data = spark.createDataFrame(
        pa.table({"ids": pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), "values": pa.array([r[1].astype(np.float64).tobytes() for r in rows], pa.binary())})
    ).repartition(max(1, min(64, len(rows) // 500 + 1)))

    def multiplied(q: np.ndarray) -> np.ndarray:
        """A'(A q), summed over the partitions; each sends the rows of its own words only."""

        def step(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for ids, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at, v = np.frombuffer(ids, np.int32), np.frombuffer(values, np.float64)
                    point = v @ q[at]
                    for i, x in zip(at.tolist(), v):
                        total[i] = total[i] + x * point if i in total else x * point
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["word", "sums"])

        out = np.zeros((n_words, q.shape[1]))
        for r in data.mapInArrow(step, "word int, sums binary").toArrow().to_pylist():
            out[r["word"]] += np.frombuffer(r["sums"], np.float64)
        return out

    q = np.linalg.qr(multiplied(omega))[0]
    for _ in range(POWER - 1):
        q = np.linalg.qr(multiplied(q))[0]
    small, energy, _ = np.linalg.svd(q.T @ multiplied(q), full_matrices=False)  # A'A in the basis: its eigenvectors
    enough = int(np.searchsorted(np.cumsum(energy), kept * len(rows))) + 1  # the rows have unit length
    return (q @ small)[:, : min(rank, enough)]


def _blocks(benchmark: DataFrame) -> list[Benchmark]:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"), answer.alias("answer")).where("text IS NOT NULL")
    block, out = [], []
    for r in items.orderBy("item_id", "text").toLocalIterator():  # the benchmark is the query set: a block of items at a time
        block.append((r.item_id, r.text, r.answer))
        if len(block) == BLOCK_ITEMS:
            out.append(Benchmark(block))
            block = []
    out.append(Benchmark(block))
    return [b for b in out if b.items]


def fit_all(documents: DataFrame, blocks: list[Benchmark]) -> list[Benchmark]:
    """IDF over all documents in one pass, then the latent space of each block's passages."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for b in blocks for w in b.vocabulary}))}

    def count(batches):
        known = frozenset(vocabulary)
        df, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                df[[vocabulary[w] for w in known.intersection(stripped(set(lowered(text or ""))))]] += 1
        df[len(vocabulary)] = n  # in place of other words
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["word", "df"])

    df, n_docs = np.zeros(len(vocabulary)), 0
    for r in only(documents, "text").mapInArrow(count, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():  # the benchmark's words at most
        if r["word"] == len(vocabulary):
            n_docs = r["df"]
        else:
            df[r["word"]] = r["df"]
    for block in blocks:
        block.weigh(n_docs, df[[vocabulary[w] for w in block.vocabulary]])
        rows = block.rows()
        block.place(randomised_basis(documents.sparkSession, rows, len(block.vocabulary), kept=KEPT) if rows else np.zeros((len(block.vocabulary), 1)))
    return blocks


def lowered(text: str) -> list[str]:
    """The text's words in lower case, as normal() has them before it takes the marks; one call for the whole text."""
    return text.lower().split()


def stripped(words: Iterable[str]) -> Iterator[str]:
    """The lower-case words without marks at their ends; words of marks only are empty."""
    return map(str.strip, words, repeat(_STRIP))


class Searcher:
    """Finds a block's items in texts; made once per task."""

    def __init__(self, block: Benchmark, candidate: float, exact: float, paraphrase: float):
        self.b, self.candidate, self.exact, self.paraphrase = block, candidate, exact, paraphrase
        self.square = np.append(block.idf**2, [block.other**2, 0.0])  # by id: benchmark words, other words, none
        self.least = candidate * float(block.limit.min()) if len(block.limit) else 1.0
        # the most that one word adds to the product with any passage's point; other words add nothing
        most = [(block.basis[k : k + 1000] @ block.points.T).max(axis=1) for k in range(0, len(block.basis), 1000)] if len(block.points) else [np.zeros(len(block.basis))]
        self.most = np.append(np.maximum(np.concatenate(most), 0), [0.0, 0.0])
        #: A benchmark word's place; other words are one past them, words of marks only two past.
        self.place = {**block.vocabulary, "": len(block.vocabulary) + 1}
        self.hashes = WordHashes()
        self.index()
        self.place_of = {x[:2]: k for k, x in enumerate(block.by_words)}

    def index(self) -> None:
        """Postings of each passage's rarest words, of which a copy holds `atleast` or more, and the words' places as bits."""
        self.masks, need, atleast, entries = [], [], [], []
        for p, (item, start, end) in enumerate(self.b.by_words):
            ids = [self.b.vocabulary[w] for w in self.b.items[item][1][start:end]]
            masks: dict[int, int] = {}
            for i, w in enumerate(ids):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            need.append(max(1, math.ceil(min(self.exact, self.paraphrase) * len(ids) - 1e-9)))
            atleast.append(max(1, need[-1] // 4))
            rarest = sorted(ids, key=lambda w: (self.b.df[w], w))[: len(ids) - need[-1] + atleast[-1]]
            entries += [(w, p, rarest.count(w)) for w in set(rarest)]
        self.need, self.atleast = need, np.array(atleast)
        entries.sort()
        words, self.of, self.times = (np.array(x, np.int64) for x in (zip(*entries) if entries else ((), (), ())))
        self.n_of = np.bincount(words, minlength=len(self.b.vocabulary) + 2)  # nothing for other words
        self.first_of = np.cumsum(self.n_of) - self.n_of

    def overlaps(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(passage, block) where this block and the next hold enough of the passage's rarest words."""
        out, n_passages = [], len(self.masks)
        for low in range(0, max(1, -(-len(ids) // BLOCK) - 1), BLOCKS):
            part = ids[low * BLOCK : (low + BLOCKS + 1) * BLOCK]
            n_blocks, width = -(-len(part) // BLOCK), len(self.n_of)
            used = np.flatnonzero(self.n_of[part])
            block, word = np.divmod(np.unique(used // BLOCK * width + part[used]), width)
            n = self.n_of[word]
            at = np.arange(n.sum()) + np.repeat(self.first_of[word] - np.cumsum(n) + n, n)
            held = np.bincount(np.repeat(block, n) * n_passages + self.of[at], self.times[at], n_blocks * n_passages).reshape(n_blocks, n_passages)
            if n_blocks > 1:
                held = held[:-1] + held[1:]
            found, passage = np.nonzero(held >= self.atleast)
            out += zip(passage.tolist(), (found + low).tolist())
        return out

    def ordered(self, passage: int, ids: list[int]) -> int:
        """Longest common subsequence of the passage and the ids; where too few ids are the passage's to reach `need`, their number."""
        masks, (_, start, end) = self.masks[passage], self.b.by_words[passage]
        own = [masks[w] for w in ids if w in masks]
        if len(own) < self.need[passage]:
            return len(own)
        full = row = (1 << end - start) - 1
        for m in own:
            u = row & m
            row = (row + u | row - u) & full
        return end - start - row.bit_count()

    def word_hits(self, raw: list[str], place: np.ndarray, ids: np.ndarray, found: dict[int, float]) -> None:
        """Adds the items whose passages a stretch of the text, of up to twice their length, passes the checks for."""
        for passage, block in self.overlaps(ids):
            p, a, z = self.b.by_words[passage]
            item_id, low = self.b.items[p][0], block * BLOCK
            near, best = ids[low : low + 2 * BLOCK].tolist(), found.get(item_id, 0.0)
            # no stretch in here can do more than all of it
            most = self.ordered(passage, near)
            if most < self.need[passage] or most <= best * (z - a):
                continue
            for i in [i for i, w in enumerate(near) if w in self.masks[passage]]:
                share = self.ordered(passage, near[i : i + 2 * (z - a)]) / (z - a)
                if share <= best or not (share >= self.exact or share >= self.paraphrase):
                    continue
                if share < self.exact:
                    answer, there = self.b.answer(p), {normal(raw[k]) for k in place[low + i : low + i + 2 * (z - a)]}
                    if sum(w in there for w in answer) < ANSWER * len(answer):
                        continue
                best = found[item_id] = share

    def hits(self, text: str) -> list[tuple[int, float]]:
        """(item_id, share of the item's best passage that the text holds in order) of the items in the text."""
        raw = lowered(text)
        if not raw:
            return []
        found = self.exact_hits(raw) if self.b.exact else {}
        n_words = len(self.b.vocabulary)
        ids = np.fromiter(map(self.place.get, stripped(raw), repeat(n_words)), np.int64, len(raw))
        place = np.flatnonzero(ids <= n_words)  # words of marks only are left out
        ids = ids[place]
        if len(ids) and self.masks:
            self.word_hits(raw, place, ids, found)
        step = PASSAGE // 4
        n_steps = -(-len(ids) // step)
        if not n_steps or not len(self.b.points):
            return sorted(found.items(), key=lambda x: (x[0] is None, x))
        # sums over steps of 8 words; a window is four steps in a row (fewer in short texts)
        cuts, size = np.arange(0, len(ids), step), min(4, n_steps)
        sums_of = lambda x: np.add.reduceat(x, cuts)
        windowed = lambda x: sum(x[k : len(x) - size + 1 + k] for k in range(size))
        length = np.sqrt(np.maximum(windowed(sums_of(self.square[ids])), 1e-9))
        maybe = np.flatnonzero(windowed(sums_of(self.most[ids])) >= self.least * (1 - 1e-5) * length)
        if not len(maybe):
            return sorted(found.items(), key=lambda x: (x[0] is None, x))
        # the steps of the windows that are left, and of their words those with weight
        steps = np.unique((maybe[:, None] + np.arange(size)).ravel())
        sums = np.zeros((len(steps), self.b.basis.shape[1]), np.float32)
        words = np.flatnonzero((ids < n_words) & np.isin(np.arange(len(ids)) // step, steps))
        of_step = words // step
        first = np.flatnonzero(np.r_[True, of_step[1:] != of_step[:-1]])
        sums[np.searchsorted(steps, of_step[first])] = np.add.reduceat(self.b.basis[ids[words]], first, axis=0)
        first = np.searchsorted(steps, maybe)
        windows = sum(sums[first + k] for k in range(size))
        cosine = (windows / length[maybe][:, None].astype(np.float32)) @ self.b.points.T
        at, passage = np.nonzero(cosine >= self.candidate * self.b.limit)
        at = maybe[at]
        if not len(at):
            return sorted(found.items(), key=lambda x: (x[0] is None, x))
        # neighbouring windows of a passage are checked once, over the text they span
        order = np.lexsort((at, passage))
        at, passage = at[order], passage[order]
        start = np.flatnonzero(np.r_[True, (passage[1:] != passage[:-1]) | (at[1:] > at[:-1] + 4)])
        ends = np.r_[start[1:], len(at)] - 1
        for s, e in zip(start, ends):
            p, a, z = self.b.passages[passage[s]]
            item_id = self.b.items[p][0]
            low, high = max(0, (at[s] - 2) * step), (at[e] + size + 2) * step
            share = self.ordered(self.place_of[p, a], ids[low:high].tolist()) / (z - a)
            if share <= found.get(item_id, 0.0):
                continue
            if share >= self.exact:
                ok = True
            elif share >= self.paraphrase:
                answer, there = self.b.answer(p), {normal(raw[k]) for k in place[low:high]}
                ok = sum(w in there for w in answer) >= ANSWER * len(answer)
            else:
                ok = False
            if ok:
                found[item_id] = max(found.get(item_id, 0.0), share)
        return sorted(found.items(), key=lambda x: (x[0] is None, x))

    def exact_hits(self, raw: list[str]) -> dict[int, float]:
        """Items of the exact path that the text holds word for word."""
        words = [w for w in stripped(raw) if w]
        h = self.hashes.of([w.encode() for w in words])
        out = {}
        for n, known in self.b.exact.items():
            runs = window_hashes(h, n)
            for k in np.flatnonzero(np.isin(runs, np.array(list(known), np.uint64))).tolist():
                for p in known[int(runs[k])]:
                    if words[k : k + n] == self.b.items[p][1]:
                        out[self.b.items[p][0]] = 1.0
        return out


def _passes(documents: DataFrame, benchmark: DataFrame, options: tuple[float, float, float]) -> list:
    """For each pass over the documents, a function that makes its searchers."""
    blocks = fit_all(documents, _blocks(benchmark))

    def maker(own: list[Benchmark]):
        return lambda: [Searcher(b, *options) for b in own]

    return [maker(blocks[k : k + PASS_BLOCKS]) for k in range(0, len(blocks), PASS_BLOCKS)]


def _found(documents: DataFrame, passes: list) -> DataFrame:
    """(h1, h2, item_ids, best_share) of the texts with items, by two hashes of the text, over all passes."""

    def searching(make):
        def search(batches):
            searchers = make()
            for batch in batches:
                found = [[h for s in searchers for h in s.hits(t or "")] for t in batch.column(2).to_pylist()]
                some = pa.array([bool(f) for f in found])
                items, share = pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int64())), pa.array([max((s for _, s in f), default=0.0) for f in found])
                yield pa.record_batch([batch.column(0), batch.column(1), items, share], ["h1", "h2", "item_ids", "best_share"]).filter(some)

        return search

    hashed = documents.select(*_hashes(documents["text"]), documents["text"].cast("string").alias("text"))
    every = [hashed.mapInArrow(searching(make), "h1 long, h2 long, item_ids array<long>, best_share double").distinct() for make in passes]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.groupBy("h1", "h2").agg(F.flatten(F.collect_list("item_ids")).alias("item_ids"), F.max("best_share").alias("best_share"))


def _hashes(text) -> list:
    return [F.xxhash64(text.cast("string")).alias("h1"), F.xxhash64(text.cast("string"), F.lit(1)).alias("h2")]


def find_leaks(documents: DataFrame, benchmark: DataFrame, candidate: float = CANDIDATE, exact: float = EXACT, paraphrase: float = PARAPHRASE) -> DataFrame:
    """The documents' rows with item_ids (array), best_share and contaminated beside doc_id."""
    ship_package(documents.sparkSession)
    docs = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = _passes(docs, benchmark, (candidate, exact, paraphrase))
    if not passes:
        return docs.select("doc_id", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("best_share"), F.lit(False).alias("contaminated"))
    if len(passes) > 1:
        found = materialize(_found(docs, passes), "leaks")
        marked = docs.select("doc_id", *_hashes(docs["text"])).join(found, ["h1", "h2"], "left")
        return marked.select(
            "doc_id", F.coalesce(F.array_sort("item_ids"), F.array().cast("array<long>")).alias("item_ids"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"), F.col("best_share").isNotNull().alias("contaminated")
        )
    make = passes[0]

    def search(batches):
        searchers = make()
        for batch in batches:
            found = [[h for s in searchers for h in s.hits(t or "")] for t in batch.column(1).to_pylist()]
            items = pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), items, pa.array([max((s for _, s in f), default=0.0) for f in found]), pa.array([bool(f) for f in found])], ["doc_id", "item_ids", "best_share", "contaminated"])

    return docs.mapInArrow(search, "doc_id long, item_ids array<long>, best_share double, contaminated boolean")


def remove(documents: DataFrame, benchmark: DataFrame, candidate: float = CANDIDATE, exact: float = EXACT, paraphrase: float = PARAPHRASE) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    ship_package(documents.sparkSession)
    passes = _passes(only(documents, "text"), benchmark, (candidate, exact, paraphrase))
    at = documents.columns.index("text")
    if len(passes) > 1:
        found = materialize(_found(documents, passes), "leaks").select("h1", "h2")
        rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), *_hashes(documents["text"]))
        return rows.join(found, ["h1", "h2"], "left_anti").select(*[F.col("row")[c].alias(c) for c in documents.columns])

    def make():
        searchers = passes[0]() if passes else []
        return lambda batch: np.array([not any(s.hits(t or "") for s in searchers) for t in batch.column(at).to_pylist()])

    return filter_rows(documents, make)
