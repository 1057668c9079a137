"""N-gram Jaccard join: a token-group matrix over the documents' rarest shingles.

A document's set is its distinct SHINGLE-word shingles. Two documents link when their Jaccard
similarity is THRESHOLD percent or more. The join loses no link between different sets:

1. Blocks of documents exchange their sets (blocks.py) and learn for each shingle how many blocks
   hold it. Shingles are ordered by that count, then by hash; two sets of similarity t share one of
   the first n - ceil(t n) + 1 shingles of each in any common order. Shingles that one document
   alone holds come first and match nothing, so most documents are left with an empty prefix and
   are done. The rest keep their shared shingles; equal sets become one class.
2. Leaders: documents whose prefixes share a shingle go to the leader of most of their shingles (the
   one with the fewest shingles of its own, as an original among its near copies, then by a fresh
   hash); those that truly link to it are united, and only shingles that documents of different
   components hold go on.
3. Token-group matrix over what is left: documents that share their most frequent passage lie on one
   shelf of about SHELF documents, in groups of GROUP. Shingles that the same documents hold are one
   entry. A document asks a shelf if they share an entry, and sizes and places in the order let the
   overlap reach what a link needs; the task that holds the shelf bounds the overlap with each group
   by the group's union of shingles and opens only groups that qualify, member by member.

Inside a component nothing is compared again, so a large group of near copies costs a number of
comparisons in proportion to its size, not its square.

Defined results: a null text, or one without words, has the empty set and links with nothing; with
fewer than SHINGLE words the whole sequence is the one shingle; null doc_ids keep their rows, link
with nothing and have a null component; rows with equal doc_id are one document if their
sets are equal, and else each links by its own set under the same id; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import materialize, ship_package

from .blocks import ANSWERS, LAST, PART_HASHES, SETS, answers_in_order, growth, hashed_blocks, pack_documents, pack_sorted, runs_of, sets_table, unpack_documents, unpack_hashes
from .graph import components, stars
from .text import WordHashes, mix, only, window_hashes

SHINGLE = 5
#: Percent: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
GROUP = 64
#: Documents whose groups one task holds at once: a query is sent to a shelf, not to each of its groups.
SHELF = 2048
#: Rounds of leaders before the matrix; what they leave, the matrix finds.
LEADER_TURNS = 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bits of a shingle's hash inside its part in step 1, where a false match costs no link.
SKETCH_BITS = 40


def shingle_sets(texts: list[bytes], hashes: WordHashes, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, concatenated and sorted within a text, and how many each has."""
    words = [t.translate(_LOWER).split() for t in texts]
    out, sizes = [], []
    for own in words:
        h = hashes.of(own)
        if not len(h):
            s = np.empty(0, np.uint64)
        elif len(h) < shingle:
            s = window_hashes(h, len(h)) + np.uint64(len(h))  # told apart from windows of other lengths
        else:
            s = np.unique(window_hashes(h, shingle))
        out.append(s)
        sizes.append(len(s))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array(sizes, np.int64)


def all_shingles(texts: list[bytes], hashes: WordHashes, shingle: int) -> np.ndarray:
    """The shingles of all texts, in one array and not made distinct."""
    words = [t.translate(_LOWER).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = hashes.of([w for own in words for w in own])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))
    long = window_hashes(h, shingle)
    out = [long[left[: len(long)] >= shingle]]
    ends = np.cumsum(sizes)
    for e, n in zip(ends[sizes < shingle].tolist(), sizes[sizes < shingle].tolist()):
        if n:
            out.append(window_hashes(h[e - n : e], n) + np.uint64(n))
    return np.concatenate(out)


def needed(n, threshold: int):
    """The least overlap of a set of n elements with any set that links to it: ceil(t n)."""
    return -(-n * threshold // 100)


def linked(both, n1, n2, threshold: int):
    return 100 * both >= threshold * (n1 + n2 - both)


def document_sets(documents: DataFrame, shingle: int, threshold: int, block_bytes: int | None, part_hashes: int) -> DataFrame:
    """(doc_id, n_shingles, digest, alone, n_prefix, tokens): tokens are the shared shingles in the common order, after `alone` others, null without a prefix."""
    docs = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    number, n_bytes = hashed_blocks(docs, block_bytes) if block_bytes else hashed_blocks(docs)
    n_parts = int(max(64, n_bytes // 6 // (part_hashes * growth(n_bytes))))
    packed = pack_documents(docs, number)

    def sketched(tokens: np.ndarray) -> np.ndarray:
        """A part and a shorter hash of each shingle in one number, which sorts by both."""
        mixed = mix(tokens)
        return (mixed & np.uint64(0xFFFFFF)) % np.uint64(n_parts) << np.uint64(SKETCH_BITS) | mixed >> np.uint64(64 - SKETCH_BITS)

    def leaves(table: pa.Table) -> pa.Table:
        _, texts = unpack_documents(table["blob"].to_pylist())
        keys = np.unique(sketched(all_shingles(texts, WordHashes(), shingle)))
        part = (keys >> np.uint64(SKETCH_BITS)).astype(np.int32)
        return sets_table(table["block"][0].as_py(), pack_sorted(keys & np.uint64((1 << SKETCH_BITS) - 1), part))

    def count(table: pa.Table) -> pa.Table:
        """For each block's hashes: how many blocks hold each (255: as many or more)."""
        rows = sorted(zip(*(table[c].to_pylist() for c in ("block", "n", "width", "blob"))))
        label = np.concatenate([unpack_hashes(*r[1:]) for r in rows])
        order = np.argsort(label, kind="stable")
        _, run = runs_of(label[order])
        held = np.empty(len(label), np.uint8)
        held[order] = np.minimum(np.bincount(run), 255)[run]
        ends = np.cumsum([r[1] for r in rows])
        answers = [pa.compress(held[e - r[1] : e].tobytes(), codec="zstd", asbytes=True) for e, r in zip(ends, rows)]
        part = [table["part"][0].as_py()] * len(rows)
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array(part, pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(answers, pa.binary())], names=["block", "part", "n", "answer"])

    def choose(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = unpack_documents(table["blob"].to_pylist()) if table.num_rows else (np.empty(0, np.int64), [])
        tokens, sizes = shingle_sets(texts, WordHashes(), shingle)
        keys = sketched(tokens)
        order = np.argsort(keys)
        starts, run = runs_of(keys[order])
        local = np.bincount(run, minlength=len(starts))
        held = answers_in_order(answers, len(starts), np.arange(len(starts)), lambda a, n: np.frombuffer(pa.decompress(a, decompressed_size=n, codec="zstd", asbytes=True), np.uint8))
        # 0: one document has it; 1: documents of one block have it; then the number of blocks
        by_key = np.where(held > 1, held, local > 1).astype(np.uint8)
        weight = np.empty(len(tokens), np.uint8)
        weight[order] = by_key[run]
        lonely = np.r_[0, np.cumsum(weight == 0)]
        digests, lonelies, n_prefix, kept = [], [], [], []
        end = 0
        for i, n in enumerate(sizes.tolist()):
            own, w = tokens[end : end + n], weight[end : end + n]
            alone = int(lonely[end + n] - lonely[end])
            end += n
            prefix = n - int(needed(n, threshold)) + 1 - alone if n else 0
            if prefix <= 0 or ids[i] == LAST or alone == n:
                digests.append(None), lonelies.append(alone), n_prefix.append(0), kept.append(None)
                continue
            shared = np.lexsort((own, w))[alone:]
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            lonelies.append(alone)
            n_prefix.append(min(prefix, len(shared)))
            kept.append(own[shared].tobytes())
        return pa.table(
            [pa.array(ids, mask=ids == LAST), pa.array(sizes), pa.array(digests, pa.binary()), *(pa.array(x, pa.int32()) for x in (lonelies, n_prefix)), pa.array(kept, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "alone", "n_prefix", "tokens"],
        )

    answers = packed.groupBy("block").applyInArrow(leaves, SETS).groupBy("part").applyInArrow(count, ANSWERS)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(choose, "doc_id long, n_shingles long, digest binary, alone int, n_prefix int, tokens binary")


def _tokens(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


class Members:
    """Sets of a few documents as one sorted list of (token, member), to count overlaps with any set."""

    def __init__(self, blobs: list[bytes]):
        sets = [_tokens(b) for b in blobs]
        token = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        self.token, self.member, self.size = token[order], member[order], len(sets)
        self.union = self.token[runs_of(self.token)[0]]

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.token, tokens, "left"), np.searchsorted(self.token, tokens, "right")
        some = high > low
        low, n = low[some], (high - low)[some]
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return np.bincount(self.member[at], minlength=self.size)


EDGE = "a long, b long"


def _edges(a: list[int], b: list[int]) -> pa.Table:
    x, y = stars(np.array(a, np.int64), np.array(b, np.int64)) if a else (np.empty(0, np.int64),) * 2
    return pa.table([pa.array(x), pa.array(y)], names=["a", "b"])


def _leader_links(classes: DataFrame, placed: DataFrame, turn: int, threshold: int) -> DataFrame:
    """Verified links of documents with the leader of most of their crossing tokens.

    A token's leader is at first the document of which the least share is its own, as an original is
    among its near copies; in later turns the least by a fresh hash.
    """
    own = F.least(F.floor(F.col("alone") * 1000 / F.col("n")), F.lit(1000)).cast("long") * (1 << 50) if turn == 0 else F.lit(0).cast("long")
    key = own + F.xxhash64("id", F.lit(turn)).bitwiseAND(F.lit((1 << 50) - 1))
    keyed = placed.withColumn("key", key)
    leaders = keyed.groupBy("token").agg(F.min("key").alias("leader"))
    votes = keyed.join(leaders, "token").where("key <> leader").groupBy("id", "leader").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "leader")).alias("best")).select("id", F.col("best.leader").alias("leader"))
    # a leader of many is read once for each salt
    salt = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("m") / 512))).cast("int")
    sizes = best.groupBy("leader").agg(F.count("*").alias("m"))
    body = classes.select("id", "n", "tokens", key.alias("key"))
    asking = best.join(sizes, "leader").withColumn("salt", salt).join(body.drop("key"), "id").select("leader", "salt", "id", "n", "tokens")
    spread = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("m") / 512)).cast("int") - 1)).alias("salt")
    heads = sizes.join(body.withColumnRenamed("key", "leader"), "leader").select("leader", spread, "id", "n", "tokens")
    n_groups = 8 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asking.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True))).withColumn("at", F.pmod(F.xxhash64("leader", "salt"), F.lit(n_groups)))

    def verify(table: pa.Table) -> pa.Table:
        d = {c: table[c].to_pylist() for c in ("leader", "salt", "id", "n", "tokens", "head")}
        head = {(lead, s): k for k, (lead, s, h) in enumerate(zip(d["leader"], d["salt"], d["head"])) if h}
        a, b = [], []
        sets: dict = {}
        for k, is_head in enumerate(d["head"]):
            if is_head:
                continue
            h = head[d["leader"][k], d["salt"][k]]
            if h not in sets:
                sets[h] = np.sort(_tokens(d["tokens"][h]))
            own, other = _tokens(d["tokens"][k]), sets[h]
            at = np.searchsorted(other, own)
            both = int((other[np.minimum(at, len(other) - 1)] == own).sum())
            if linked(both, d["n"][k], d["n"][h], threshold):
                a.append(d["id"][k]), b.append(d["id"][h])
        return _edges(a, b)

    return rows.groupBy("at").applyInArrow(verify, EDGE)


def _placed(entries: DataFrame, known: DataFrame | None) -> DataFrame:
    """The prefix entries of tokens that documents of different components hold, with their components."""
    if known is not None:
        entries = entries.join(known.toDF("comp", "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    crossing = entries.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    return materialize(entries.join(crossing, "token").select("token", "id", "n", "alone", "after", "comp"), "crossing")


def _group_links(classes: DataFrame, placed: DataFrame, group: int, shelf: int, threshold: int) -> DataFrame:
    """Verified links between components: the token-group matrix over what components still share."""
    # tokens that the same documents hold, as those of one passage, are one
    same = placed.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    named = placed.join(same.select("token", "df", F.xxhash64("df", "x", "y").alias("passage")), "token")
    entries = materialize(named.groupBy("passage", "id").agg(*[F.first(c).alias(c) for c in ("n", "comp", "df")], F.max("after").alias("after")), "passages")
    # of two that link, the smaller one has its first common token among those with `later` or more tokens from there on
    later = F.ceil(2 * threshold * F.col("n") / (100 + threshold) - 1e-9)
    stored = entries.where(F.col("after") >= later)
    # documents that share their most frequent passage lie together
    family = stored.groupBy("id").agg(F.max(F.struct("df", "passage")).alias("most")).select("id", F.col("most.passage").alias("family"))
    size = family.groupBy("family").agg(F.count("*").alias("m"))
    shelves = family.join(size, "family").select("id", F.xxhash64("family", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / shelf))).alias("shelf"))
    shelves = materialize(shelves, "shelves")
    matrix = stored.join(shelves, "id").groupBy("passage", "shelf").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("after").alias("longest"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    t = threshold / 100
    overlap = t / (1 + t) * (F.col("n") + F.col("least")) - 1e-6
    pairs = (
        entries.join(matrix, "passage")
        .where((F.col("low") != F.col("comp")) | (F.col("high") != F.col("comp")))
        .where((F.col("least") <= F.col("n")) & (F.col("most") >= t * F.col("n") - 1e-6) & (F.col("after") >= overlap) & (F.col("longest") >= overlap))
        .select("id", "shelf").distinct()
    )
    pairs = materialize(pairs, "shelf_queries")
    body = classes.select("id", "n", "tokens").join(entries.select("id", "comp").distinct(), "id")
    # a shelf that many ask is read once for each salt
    load = pairs.groupBy("shelf").agg(F.ceil(F.count("*") / 2048).cast("int").alias("salts"))
    asking = pairs.join(load, "shelf").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    inside = shelves.join(load, "shelf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = asking.select("shelf", "salt", "id", F.lit(True).alias("asks")).unionByName(inside.select("shelf", "salt", "id", F.lit(False).alias("asks"))).join(body, "id")
    n_groups = 16 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("shelf", "salt"), F.lit(n_groups)))

    def open_groups(table: pa.Table) -> pa.Table:
        d = {c: table[c].to_pylist() for c in ("shelf", "salt", "id", "n", "comp", "tokens", "asks")}
        inside: dict = {}
        asking: dict = {}
        for k, asks in enumerate(d["asks"]):
            (asking if asks else inside).setdefault((d["shelf"][k], d["salt"][k]), []).append(k)
        a, b = [], []
        for key, queries in asking.items():
            # documents of a component, and of like tokens, share a group
            rows = sorted(inside[key], key=lambda r: (d["comp"][r], d["tokens"][r][:8], d["id"][r]))
            groups = [rows[k : k + group] for k in range(0, len(rows), group)]
            members = [Members([d["tokens"][r] for r in g]) for g in groups]
            unions = Members([m.union.tobytes() for m in members])  # the matrix: which group holds which token
            sizes, comps = ([np.array([d[c][r] for r in g]) for g in groups] for c in ("n", "comp"))
            for q in queries:
                own, n = _tokens(d["tokens"][q]), d["n"][q]
                for k in np.flatnonzero(unions.overlaps(own) >= needed(n, threshold)).tolist():
                    other = (comps[k] != d["comp"][q]) & (100 * sizes[k] >= threshold * n) & (sizes[k] <= n)
                    if other.any():
                        hit = np.flatnonzero(other & linked(members[k].overlaps(own), n, sizes[k], threshold))
                        a += [d["id"][q]] * len(hit)
                        b += [d["id"][groups[k][h]] for h in hit]
        return _edges(a, b)

    return rows.groupBy("at").applyInArrow(open_groups, EDGE)


def join(documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, group: int = GROUP, block_bytes: int | None = None, part_hashes: int = PART_HASHES) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id (the least doc_id reachable by links)."""
    ship_package(documents.sparkSession)
    sets = materialize(document_sets(documents, shingle, threshold, block_bytes, part_hashes), "sets")
    some = sets.where("tokens IS NOT NULL")
    # a class of equal sets is known by the hash of its digest, since rows of one id may have different sets
    keys = some.groupBy(F.col("digest").alias("key")).agg(F.min("doc_id").alias("doc"))
    least = (F.col("digest") == F.col("key")) & (F.col("doc_id") == F.col("doc"))
    classes = some.join(keys, least).select(F.xxhash64("digest").alias("id"), "doc", F.col("n_shingles").alias("n"), "alone", "n_prefix", "tokens")
    classes = materialize(classes.dropDuplicates(["id"]), "set_classes")

    def firsts(batches):
        for batch in batches:
            ids, n, alone, k, blobs = (batch.column(i).to_pylist() for i in range(5))
            tokens = [_tokens(b)[:m].view(np.int64) for b, m in zip(blobs, k)]
            sizes = [len(t) for t in tokens]
            after = np.concatenate([np.arange(x - y, x - y - s, -1) for x, y, s in zip(n, alone, sizes)] or [np.empty(0, np.int64)]).astype(np.int64)
            columns = [np.concatenate(tokens) if tokens else np.empty(0, np.int64), *(np.repeat(np.array(x, np.int64), sizes) for x in (ids, n, alone)), after]
            yield pa.record_batch([pa.array(c) for c in columns], ["token", "id", "n", "alone", "after"])

    prefix = classes.select("id", "n", "alone", "n_prefix", "tokens").mapInArrow(firsts, "token long, id long, n long, alone long, after long")
    placed = _placed(prefix.withColumn("comp", F.col("id")), None)
    # each round's links are contracted, so that the next one sees what components still share
    rounds = []
    for turn in range(LEADER_TURNS):
        found = _leader_links(classes, placed, turn, threshold)
        rounds.append(_contracted(found, rounds, f"leaders{turn}"))
        placed = _placed(placed, rounds[-1])
    # rows of one id with different sets are one document
    same_id = some.select("doc_id", F.xxhash64("digest").alias("id"))
    twice = same_id.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id", "a")
    twice = same_id.join(twice, "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
    more = _group_links(classes, placed, group, SHELF, threshold)
    rounds.append(_contracted(more.unionByName(twice), rounds, "groups"))
    named = classes.select("id", "doc").join(_rooted(classes.select("id", F.col("id").alias("comp")), "comp", rounds), "id")
    least = named.groupBy("comp").agg(F.min("doc").alias("component"))
    by_digest = named.join(least, "comp").select("id", "component")
    joined = sets.withColumn("id", F.xxhash64("digest")).join(by_digest, "id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _rooted(rows: DataFrame, column: str, rounds: list[DataFrame]) -> DataFrame:
    """The rows, with the column's ids replaced by their components after each round."""
    for found in rounds:
        rows = rows.join(found.toDF(column, "_root"), column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")
    return rows


def _contracted(edges: DataFrame, rounds: list[DataFrame], name: str) -> DataFrame:
    """Components of links between the components of earlier rounds."""
    found = materialize(edges, name)
    return materialize(components(_rooted(_rooted(found, "a", rounds), "b", rounds), f"{name}_components"), f"{name}_roots")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns: one row of each component, with its least id.

    A row of null id takes part with a hash of its text in place of an id, above other ids, so it stays only
    where no copy has an id. Of several rows with a component's least id the one of least hash stays. Rows
    without words link with nothing and stay.
    """
    text = documents["text"].cast("string")
    unnamed = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    named = F.coalesce(documents["doc_id"].cast("long"), unnamed)
    worded = F.coalesce(F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")) != "", F.lit(False))
    order = F.struct(F.xxhash64(text), F.xxhash64(*[F.to_json(F.struct(documents[c])) for c in documents.columns if c != "text"]))
    # columns of the input may have any names: they travel in one struct
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), named.alias("id"), worded.alias("worded"), order.alias("order"))
    ids = documents.select(named.alias("doc_id"), text.alias("text"), worded.alias("worded"))
    later = join(ids.select("doc_id", "text"), **options).where("component_id <> doc_id").select(F.col("doc_id").alias("id"), F.lit(True).alias("later"))
    twice = ids.where("worded").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.lit(False).alias("later"))
    marks = materialize(later.unionByName(twice).groupBy("id").agg(F.max("later").alias("later")), "later_ids")
    alone = rows.join(marks, (rows["id"] == marks["id"]) & rows["worded"], "left_anti").select("row")
    # rows of one id are reduced before they are shuffled, so an id that many rows have is one row a task
    one = rows.where("worded").join(marks.where("NOT later"), "id", "left_semi").groupBy("id").agg(F.min_by("row", "order").alias("row")).select("row")
    out = alone.unionByName(one) if marks.where("NOT later").head(1) else alone
    return out.select(*[F.col("row")[c].alias(c) for c in documents.columns])
