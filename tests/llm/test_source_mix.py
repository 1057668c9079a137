import re
from collections import defaultdict

from quillet.llm.source_mix import GOLDEN, blocks, mix, ranked, schedule, sized, targets
from pyspark.sql import functions as F


def brute_targets(sizes):
    """The contract's loop: share by weight, stop at 3 times the size, share the excess anew."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_match_the_loop(spark):
    for sizes in ({"a": 100, "b": 5, "c": 1000, None: 7}, {"x": 10}, {"b": 0, "a": 3, "é": 900, "z": 1, "Z": 40}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_schedule_against_brute_force(spark):
    goals = targets(spark.createDataFrame([("a", 5000), ("b", 9000), ("c", 4000)], "source string, source_size long"))
    rows = sorted((r.slot, r.source) for r in schedule(goals).collect())
    want = {r.source: r.target for r in goals.collect()}
    total, edges, at = sum(want.values()), [], 0.0
    for s in sorted(want):
        at += want[s]
        edges.append((at / total, s))
    for slot, source in rows:
        x = (slot + 0.5) * GOLDEN % 1
        assert source == next(s for up, s in edges if x < up)


def test_mix_contract(spark):
    rows = [(i, "w " * (i % 40) + "\n\x0bé", f"s{i % 4}" if i % 9 else None) for i in range(600)] + [(None, None, "s1"), (5, "", "s2"), (5, "a b", "s2"), (5, "a b", "s2")]
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1))).collect()
    assert len(out) == len(rows)
    size, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = brute_targets(dict(size))
    for s in size:
        assert abs(goal[s] - want[s]) < 1e-6 and abs(taken[s] - goal[s]) <= 0.5


def test_words(spark):
    texts = [None, "", "  ", "a", " a  b\t\n c\x0b\x0cd\r", "é x y", "\x00 z"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in sized(df).collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
    empty = mix(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert empty.collect() == []


def test_small_sources_and_the_order(spark):
    sizes = {"a": 30, "b": 40, "c": 5000, "d": 20}
    rows: list = []
    for name, total in sizes.items():
        while total:
            n = min(total, 7 + len(rows) % 11)
            rows.append((len(rows), "w " * n, name))
            total -= n
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = blocks(df, 16).collect()
    out = {r.doc_id: r for r in mix(df, 16).collect()}
    words, per_slot = defaultdict(int), defaultdict(list)
    for r in pieces:
        words[r.doc_id] += r.words
        per_slot[r.source, r["rank"]].append(r)
    assert {i: r.taken for i, r in out.items()} == {i: words[i] for i in out}
    for s in sizes:
        assert abs(sum(r.taken for r in out.values() if r.source == s) - next(r.target for r in out.values() if r.source == s)) <= 0.5
        full = [sum(r.words for r in per_slot[k]) for k in sorted(k for k in per_slot if k[0] == s)]
        assert full[:-1] == [16] * (len(full) - 1)  # equal blocks, the last one cut at the target
    assert [s for s in {r.slot for r in pieces}] and all(len({r.slot for r in p}) == 1 for p in per_slot.values())


def test_ranks_over_chunks(spark):
    goals = targets(spark.createDataFrame([("a", 700_000), (None, 300_000)], "source string, source_size long"))
    rows = sorted((r.slot, r.source, r["rank"]) for r in ranked(schedule(goals, 8)).withColumn("source", F.coalesce("source", F.lit("z"))).collect())
    seen = defaultdict(int)
    for slot, source, rank in rows:
        assert rank == seen[source]
        seen[source] += 1
    assert len(rows) == 125_000


def test_a_large_source(spark):
    """Words of a thousand such tables: nothing overflows."""
    sizes = {"a": 100_000_000_000_000, "b": 10**17, "c": 7}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) <= 1e-9 * want[s] for s in want)
