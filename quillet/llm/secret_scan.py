"""Secret scan: base patterns, and probabilistic automata inferred from labelled credentials.

Base spans come from three fixed patterns. Their matches are the labelled credentials: every distinct
one of each kind, and a few made-up credentials of public formats, train one prefix-tree automaton per kind
over whole values, whose statistically compatible states are merged (ALERGIA: Hoeffding test on the
outgoing frequencies, recursive over successors; states that are seen often and differ in how soon a value
can end stay apart). Characters enter as classes, so that the automaton learns a format and not the values;
values of one shape are counted by Spark and reach the driver as one row. The background is a bigram model
of all the corpus's other long tokens, once for each text that has them, counted where the texts are.
Every token of MIN_TOKEN characters or more of every text is then scored, those of base spans too: mean
log-likelihood per character under the best automaton minus that under the background. Tokens over
THRESHOLD outside the base spans add spans of kind "format"; base spans always stay.

Defined results: a null or empty text has no spans; a null doc_id keeps its row; repeated rows give
repeated rows; extra columns are ignored; an empty table gives no rows and trains on the made-up
credentials alone.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import string
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import ship_package

from .text import map_batches, only

KINDS = ("assign", "access", "hex")
EXTRA_KIND = "format"
#: Least mean log-likelihood ratio (nats per character) of an added span.
THRESHOLD = 0.6
MIN_TOKEN = 12
#: Values that must pass two states before their least distances to an end tell them apart.
SURE = 30
#: Distinct credentials that a task holds before it hands them on.
HELD = 50_000
#: Kind of the rows that count the background's pairs of classes.
PAIR = "pair"

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # maximal runs of 18 or more
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_TOKEN)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base matches, by start, then kind as listed."""
    found = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    found.sort(key=lambda x: x[:2])
    return [(start, end, KINDS[k], value) for start, k, end, value in found]


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Long tokens that no base span overlaps; leading and trailing punctuation is cut."""
    out, k = [], 0
    ends = list(accumulate((e for _, e, _, _ in taken), max))  # by start: the furthest end so far
    for m in _TOKEN.finditer(text):
        token = m[0].strip("+/_.=-")
        if len(token) < MIN_TOKEN:
            continue
        start = m.start() + m[0].index(token)
        end = start + len(token)
        while k < len(taken) and taken[k][0] < end:
            k += 1
        if not k or ends[k - 1] <= start:
            out.append((start, end, token))
    return out


# --- automata -----------------------------------------------------------------------------------


def symbol(c: str) -> str:
    """The class of a character: hex digits and letters, other letters by case, digits, marks as they are."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "A"
    if "G" <= c <= "Z":
        return "Z"
    return c if c in "+/_.=-" else "?"


#: Size of each class, so that likelihoods are per character and not per class.
CLASS_SIZE = {"0": 10, "a": 6, "z": 20, "A": 6, "Z": 20}


class _Classes(dict):
    """Character code -> class, for str.translate."""

    def __missing__(self, code: int) -> str:
        found = self[code] = symbol(chr(code))
        return found


_CLASSES = _Classes()

#: A state, or a branch of the tree that one shape alone takes: (shape's number, position).
Node = int | tuple[int, int]


class Automaton:
    """A probabilistic automaton: transitions state -> symbol -> (next, count), and counts of ends.

    words are values or shapes, repeated or with their counts. The tree holds a state only where shapes part;
    the rest of a shape is a reference into it until a merge needs its states.
    """

    def __init__(self, words: list[str] | dict[str, int], alpha: float = 0.05):
        shapes: Counter[str] = Counter()
        for word, n in Counter(words).items():
            shapes[word.translate(_CLASSES)] += n
        self.shapes, self.weights = sorted(shapes), [n for _, n in sorted(shapes.items())]
        self.next: list[dict[str, Node]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.soonest: list[float] = [math.inf]
        for k in range(len(self.shapes)):
            self.insert(k)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        # the least number of characters to an end; a child's place in the list is after its parent's
        for q in range(len(self.next) - 1, -1, -1):
            self.soonest[q] = min([0 if self.ends[q] else math.inf, *(1 + self.look(t)[3] for t in self.next[q].values())])
        self.merge_all()

    def insert(self, k: int) -> None:
        at, n = 0, self.weights[k]
        for pos, s in enumerate(self.shapes[k]):
            self.count[at][s] = self.count[at].get(s, 0) + n
            if s not in self.next[at]:
                self.next[at][s] = (k, pos + 1)
                return
            at = self.state(at, s)
        self.ends[at] += n

    def state(self, q: int, s: str) -> int:
        """The state that s leads to from q, made from its reference if need be."""
        target = self.next[q][s]
        if isinstance(target, tuple):
            _, ends, count, soonest, following = self.look(target)
            self.ends.append(ends)
            self.count.append(dict(count))
            self.next.append(dict(following))
            self.soonest.append(soonest)
            target = self.next[q][s] = len(self.next) - 1
        return target

    def look(self, q: Node) -> tuple[int, int, dict[str, int], float, dict[str, Node]]:
        """Values that reach q and that end there, counts of symbols, least distance to an end, successors."""
        if not isinstance(q, tuple):
            return self.ends[q] + sum(self.count[q].values()), self.ends[q], self.count[q], self.soonest[q], self.next[q]
        k, pos = q
        shape, n = self.shapes[k], self.weights[k]
        if pos == len(shape):
            return n, n, {}, 0, {}
        return n, 0, {shape[pos]: n}, len(shape) - pos, {shape[pos]: (k, pos + 1)}

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, q: Node, r: Node) -> bool:
        """Hoeffding test on ends and symbols, and on the successors of both."""
        stack, seen = [(q, r)], set()
        while stack:
            q, r = stack.pop()
            if q == r or (q, r) in seen:
                continue
            if not isinstance(r, tuple):  # a reference only moves on
                seen.add((q, r))
            n1, ends1, count1, soonest1, next1 = self.look(q)
            n2, ends2, count2, soonest2, next2 = self.look(r)
            if self.bound >= math.sqrt(min(n1, n2)):  # so few that no difference, here or further on, is beyond the bound
                continue
            if self.differ(ends1, n1, ends2, n2) or min(n1, n2) >= SURE and soonest1 != soonest2:
                return False
            for s in count1.keys() | count2.keys():
                if self.differ(count1.get(s, 0), n1, count2.get(s, 0), n2):
                    return False
                if s in next1 and s in next2:
                    stack.append((next1[s], next2[s]))
        return True

    def fold(self, q: int, r: Node) -> list[int]:
        """Add the subtree at r, the root of a tree part, to q and let its states go. The states that got a successor."""
        stack, grown = [(q, r)], []
        while stack:
            q, r = stack.pop()
            if isinstance(r, tuple):
                k, pos = r
                shape, n = self.shapes[k], self.weights[k]
                while pos < len(shape):
                    s, pos = shape[pos], pos + 1
                    self.count[q][s] = self.count[q].get(s, 0) + n
                    if s not in self.next[q]:
                        self.next[q][s] = (k, pos)
                        grown.append(q)
                        break
                    q = self.state(q, s)
                else:
                    self.ends[q] += n
                continue
            self.ends[q] += self.ends[r]
            count, following = self.count[r], self.next[r]
            self.count[r] = self.next[r] = None
            for s, target in following.items():
                self.count[q][s] = self.count[q].get(s, 0) + count[s]
                if s not in self.next[q]:
                    self.next[q][s] = target
                    grown.append(q)
                else:
                    stack.append((self.state(q, s), target))
        return grown

    def merge_all(self) -> None:
        """Red states are final; the first successor of the earliest red state that is not red is next."""
        red, place, open_ = [0], {0: 0}, [0]
        while open_:
            p = red[open_[0]]
            s = min((s for s, t in self.next[p].items() if t not in place), default=None)
            if s is None:
                heapq.heappop(open_)
                continue
            r = self.next[p][s]
            for q in red:
                if self.compatible(q, r):
                    self.next[p][s] = q
                    for grown in self.fold(q, r):
                        if grown in place:
                            heapq.heappush(open_, place[grown])
                    break
            else:
                r = self.state(p, s)
                place[r] = len(red)
                heapq.heappush(open_, len(red))
                red.append(r)
        self.next = [{s: place[t] for s, t in self.next[q].items()} for q in red]
        self.count, self.ends = [self.count[q] for q in red], [self.ends[q] for q in red]
        self.totals = [n + sum(c.values()) for n, c in zip(self.ends, self.count)]
        self.states = list(range(len(red)))
        del self.shapes, self.weights, self.soonest

    def score(self, word: str) -> float:
        """Log-likelihood of word; a step never seen costs as one of a hundred."""
        at, out = 0, 0.0
        for s in word.translate(_CLASSES):
            seen = self.count[at].get(s, 0)
            out += math.log((seen + 0.01) / (self.totals[at] + 0.1)) - math.log(CLASS_SIZE.get(s, 1))
            at = self.next[at].get(s, at)
        return out + math.log((self.ends[at] + 0.01) / (self.totals[at] + 0.1))


class Background:
    """Bigrams of character classes in ordinary tokens, and those that were counted elsewhere ("^" stands before a token)."""

    def __init__(self, tokens: list[str], counted: dict[str, int] | None = None):
        self.pair: dict[str, int] = dict(counted or {})
        self.one: dict[str, int] = {}
        for pair, n in self.pair.items():
            self.one[pair[0]] = self.one.get(pair[0], 0) + n
        for token in tokens:
            before = "^"
            for c in token:
                s = symbol(c)
                self.pair[before + s] = self.pair.get(before + s, 0) + 1
                self.one[before] = self.one.get(before, 0) + 1
                before = s

    def score(self, token: str) -> float:
        before, out = "^", 0.0
        for c in token:
            s = symbol(c)
            out += math.log((self.pair.get(before + s, 0) + 1) / (self.one.get(before, 0) + 14)) - math.log(CLASS_SIZE.get(s, 1))
            before = s
        return out


def seed_credentials(per_format: int = 60, seed: int = 11) -> dict[str, list[str]]:
    """Made-up credentials of public formats, so that each format is known without a corpus example."""
    draw = random.Random(seed)
    alnum = string.ascii_letters + string.digits
    make = lambda head, alphabet, n: head + "".join(draw.choice(alphabet) for _ in range(n))
    formats = {
        "personal_token": lambda: make("ghp_", alnum, 36),
        "live_key": lambda: make("sk_live_", alnum, 24),
        "chat_token": lambda: make("xoxb-", string.digits, 12) + make("-", alnum, 24),
        "cloud_key": lambda: make("AIza", alnum + "_-", 35),
        "registry_token": lambda: make("npm_", alnum, 36),
    }
    return {name: [f() for _ in range(per_format)] for name, f in formats.items()}


#: Ordinary tokens with digits, beside the corpus's own: file names, dates, versions, versioned words.
def background_tokens(seed: int = 12) -> list[str]:
    draw = random.Random(seed)
    syllable = lambda: draw.choice("bcdfghlmnprstvw") + draw.choice("aeiou") + draw.choice(["", "n", "r", "s", "t"])
    word = lambda: "".join(syllable() for _ in range(draw.randint(2, 5)))
    out = []
    for _ in range(400):
        out += [
            word() + "-" + word() + "-" + word(), f"20{draw.randint(10, 29)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", f"{word()}/{word()}/{word()}.{word()[:3]}",
            f"v{draw.randint(0, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 99)}-{word()}", word() + word() + word(), f"www.{word()}.com/{word()}{draw.randint(1, 99)}", f"{word()}_{word()}_{draw.randint(1, 999)}", word().upper() + "-" + word().title(),
        ]
    return out


class Formats:
    """The trained automata and the background: ratio(token) is the best mean log-likelihood ratio."""

    def __init__(self, labelled: dict[str, list[str] | dict[str, int]], pairs: dict[str, int] | None = None):
        self.automata = {kind: Automaton(words) for kind, words in sorted(labelled.items()) if words}
        self.background = Background(background_tokens(), pairs)

    def ratio(self, token: str) -> tuple[float, str]:
        base = self.background.score(token)
        return max(((a.score(token) - base) / len(token), kind) for kind, a in self.automata.items())


#: The classes of the characters that credentials and tokens are made of.
_CHARACTERS = string.ascii_letters + string.digits + "+/_.=-"
_SYMBOLS = "^0azAZ+/_.=-"
_CODES = bytes(_SYMBOLS.index(symbol(chr(b))) if chr(b) in _CHARACTERS else 0 for b in range(256))


def pair_counts(tokens: list[str]) -> np.ndarray:
    """How often each class (column) follows each class or a token's beginning (row); see _SYMBOLS."""
    codes = np.frombuffer("\n".join(["", *tokens, ""]).encode("ascii").translate(_CODES), np.uint8).astype(np.int64)
    return np.bincount(codes[:-1] * len(_SYMBOLS) + codes[1:], minlength=len(_SYMBOLS) ** 2).reshape(-1, len(_SYMBOLS))


def _labelled(documents: DataFrame) -> dict[str, dict[str, int]]:
    """Of the whole corpus: each kind's shapes with the number of distinct credentials of that shape, and the pairs of classes in other long tokens."""

    def count(batches):
        kept: set[tuple[str, str]] = set()
        pairs = np.zeros((len(_SYMBOLS), len(_SYMBOLS)), np.int64)

        def rows(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), (), ()]
            return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["kind", "value", "n"])

        for batch in batches:
            tokens: list[str] = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                kept.update((kind, value) for _, _, kind, value in base)
                tokens += {t for _, _, t in candidates(text, base)}
            pairs += pair_counts(tokens)
            if len(kept) > HELD:
                yield rows([(*x, 1) for x in kept])
                kept.clear()
        found = [(PAIR, _SYMBOLS[i] + _SYMBOLS[j], int(pairs[i, j])) for i, j in np.argwhere(pairs[:, 1:]) + [0, 1]]
        yield rows([(*x, 1) for x in kept] + found)

    values = only(documents, "text").mapInArrow(count, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    shape = F.translate("value", _CHARACTERS, "".join(map(symbol, _CHARACTERS)))
    shapes = values.groupBy("kind", shape.alias("shape")).agg(F.sum(F.when(F.col("kind") == PAIR, F.col("n")).otherwise(1)).alias("n"))
    out: dict[str, dict[str, int]] = {kind: {} for kind in (*KINDS, PAIR)}
    for kind, found, n in shapes.collect():
        out[kind][found] = n
    return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(documents: DataFrame, formats: Formats | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, counts of base spans, base_sha256, spans and each span's best automaton and score."""
    ship_package(documents.sparkSession)
    if formats is None:
        labelled = _labelled(documents)
        formats = Formats(seed_credentials() | {kind: labelled[kind] for kind in KINDS}, labelled[PAIR])
    model = formats
    order = {kind: k for k, kind in enumerate((*KINDS, EXTRA_KIND))}

    def make():
        known: dict[str, tuple[float, str]] = {}

        def ratio(token: str) -> tuple[float, str]:
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                known[token] = model.ratio(token)
            return known[token]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = [(s, e, kind) for s, e, kind, _ in base]
                scores = [(s, kind, ratio(value)) for s, _, kind, value in base]
                for start, end, token in candidates(text or "", base):
                    value = ratio(token)
                    if value[0] >= threshold:
                        spans.append((start, end, EXTRA_KIND))
                        scores.append((start, EXTRA_KIND, value))
                counts = [sum(x[2] == kind for x in spans) for kind in KINDS]
                every = sorted(spans, key=lambda x: (x[0], order[x[2]]))
                rows.append((*counts, hashlib.sha256(digest([x for x in every if x[2] != EXTRA_KIND]).encode()).hexdigest(), digest(every), ",".join(f"{like}:{value:.3f}" for _, _, (value, like) in sorted(scores, key=lambda x: (x[0], order[x[1]])))))
            columns = [batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), *(pa.array([r[k] for r in rows], pa.string()) for k in range(3, 6))]
            return pa.record_batch(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

        return step

    return map_batches(
        documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"]), make,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string",
    )
