import random

import numpy as np

from quillet.llm.decontaminate import CANDIDATE, EXACT, PARAPHRASE, Benchmark, Searcher, find_leaks, lcs_length, randomised_basis, remove, words_of


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_matches_the_plain_table():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.choice("abcdef") for _ in range(draw.randrange(40))] for _ in range(2))
        assert lcs_length(a, b) == plain_lcs(a, b)


def test_basis_spans_what_the_exact_decomposition_spans(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 30))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    basis = randomised_basis(spark, [(np.arange(30), row) for row in dense], 30, rank=6)
    exact = np.linalg.svd(dense, full_matrices=False)[2][:6].T
    assert np.allclose(basis @ basis.T, exact @ exact.T, atol=1e-6)


def test_planted_passages(spark):
    draw = random.Random(7)
    word = lambda: draw.choice(["the", "of", "and", "to"]) if draw.random() < 0.4 else "".join(draw.choice("abcdefghiklmnoprst") for _ in range(6))
    items = [(k, ". ".join(" ".join(word() for _ in range(draw.randrange(8, 20))) for _ in range(3))) for k in range(30)] + [(90, "four little lone words"), (91, None), (92, "")]
    rows, want = [], {}
    for i in range(120):
        body = [word() for _ in range(draw.randrange(30, 300))]
        if i % 4 == 0:
            k = draw.randrange(30)
            text = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: a tenth of the words go or change
                text = [word() if draw.random() < 0.05 else w for w in text if draw.random() > 0.05]
            at = draw.randrange(len(body))
            body[at:at] = text
            want[i] = k
        rows.append((i, " ".join(body)))
    rows += [(500, "x four little lone words y"), (501, "four little words lone"), (502, None), (503, ""), (None, items[0][1])]
    want[500] = 90
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in find_leaks(docs, bench).collect()}
    assert {i for i, r in out.items() if r.contaminated} == {*want, None}
    assert all(k in out[i].item_ids for i, k in want.items())
    kept = remove(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {*want, None}
    assert not any(r.contaminated for r in find_leaks(docs, bench.limit(0)).collect())
    assert find_leaks(docs.limit(0), bench).collect() == []


def test_long_items_have_overlapping_passages():
    b = Benchmark([(1, " ".join(f"w{i}" for i in range(100)), None)])
    covered = set()
    for _, s, e in b.passages:
        covered |= set(range(s, e))
    assert covered == set(range(100)) and words_of("a, b. --") == ["a", "b"]


def searcher(items, n_docs, df):
    """A searcher with a whole basis, as if `df(word)` of n_docs documents had the word."""
    b = Benchmark([(k, t, None) for k, t in items])
    b.weigh(n_docs, np.array([df(w) for w in b.vocabulary], float))
    b.place(np.eye(len(b.vocabulary)))
    return Searcher(b, CANDIDATE, EXACT, PARAPHRASE)


def test_every_copy_is_a_candidate_at_any_number_of_documents():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghiklmnoprst") for _ in range(5))
    common = [word() for _ in range(40)]
    items = [(k, " ".join(word() if draw.random() < 0.3 else draw.choice(common) for _ in range(draw.randrange(15, 60)))) for k in range(20)]
    for n_docs in (1_000, 10**9):
        s = searcher(items, n_docs, lambda w: n_docs * (0.05 if w in common else 0.002))
        for k, text in items:
            want = text.split()
            body = [word() for _ in range(draw.randrange(600))]
            at = draw.randrange(len(body) + 1)
            # every seventh word is another: six in seven or more stay in order
            copy = [word() if i % 7 == 3 else w for i, w in enumerate(want)]
            found = dict(s.hits(" ".join(body[:at] + copy + body[at:])))
            assert found.get(k, 0) >= 0.8, (n_docs, k)
        # more blocks than are counted at once, a copy across the seam
        body = [word() for _ in range(64 * 600)]
        body[64 * 256 - 5 : 64 * 256 - 5] = items[0][1].split()
        assert dict(s.hits(" ".join(body))).get(0) == 1.0


def test_items_of_words_that_a_group_of_copies_makes_frequent():
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghiklmnoprst") for _ in range(5))
    first, second = ([word() for _ in range(n)] for n in (20, 64))
    # a third of all documents hold the first item and the second one's first passage
    often = {*first, *second[:32]}
    s = searcher([(1, " ".join(first)), (2, " ".join(second))], 1000, lambda w: 330 if w in often else 2)
    changed = lambda words: [word() if i % 7 == 3 else w for i, w in enumerate(words)]
    body = [word() for _ in range(100)]
    assert dict(s.hits(" ".join(body[:40] + changed(first) + body[40:]))).keys() == {1}
    assert dict(s.hits(" ".join(body[:40] + changed(second[:32]) + body[40:]))).keys() == {2}
    assert s.hits(" ".join(body + first[:8] + body)) == []


def test_short_items_with_a_word_changed():
    items = [(1, "which river runs past bremen town"), (2, "seven small words stand right here in one row"), (3, "two words")]
    s = searcher(items, 1000, lambda w: 5)
    assert [k for k, _ in s.hits("so which river runs past old town then")] == [1]
    assert [k for k, _ in s.hits("seven small words stand left here in one long row")] == [2]
    assert [k for k, _ in s.hits("just two words")] == [3]
    assert s.hits("two other words, which river, seven words in one town; past here small") == []


def test_against_every_stretch(spark, monkeypatch):
    """No copy that the word checks take is lost, whatever share of the documents holds the item; passes add up."""
    from quillet.llm import decontaminate

    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghiklmnoprst") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(draw.choice((9, 15, 40, 70))))) for k in range(12)] + [(40, " ".join(word() for _ in range(40)))]
    rows = []
    for i in range(100):
        body = [word() for _ in range(draw.randrange(10, 200))]
        k, text = items[-1] if i % 10 < 3 else draw.choice(items[:-1])
        copy = [word() if j % 8 == 7 else w for j, w in enumerate(text.split())] if i % 10 < 3 else [word() if draw.random() < draw.choice((0.1, 0.3, 0.5)) else w for w in text.split()]
        at = draw.randrange(len(body))
        rows.append((i, " ".join(body[:at] + copy + body[at:])))
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: set(r.item_ids) for r in find_leaks(docs, bench).collect()}
    b = Benchmark([(k, t, None) for k, t in items])
    df = {w: sum(w in t.split() for _, t in rows) + 5 * (w in " ".join(t for _, t in rows[:5]).split()) for w in b.vocabulary}
    b.weigh(105, np.array([df[w] for w in b.vocabulary], float))
    for i, text in rows:
        near, must = text.split(), set()
        for p, s, e in b.by_words:
            want, m = b.items[p][1][s:e], e - s
            for j in range(len(near)):
                if near[j] in want:
                    stretch = near[j : j + 2 * m]
                    share = plain_lcs(want, stretch) / m
                    answer = b.answer(p)
                    if share >= EXACT or share >= PARAPHRASE and sum(w in stretch for w in answer) >= 0.5 * len(answer):
                        must.add(b.items[p][0])
                        break
        assert must <= found[i], (i, must, found[i])
        assert all(max(plain_lcs(b.items[p][1][s:e], near) / (e - s) for p, s, e in b.by_words if b.items[p][0] == k) >= PARAPHRASE for k in found[i])
        assert i % 10 >= 3 or 40 in found[i]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    again = find_leaks(docs, bench).collect()
    assert {r.doc_id: set(r.item_ids) for r in again} == found and len(again) == 105
    assert sorted(r.doc_id for r in remove(docs, bench).collect()) == sorted(i for i in [*range(100), *range(5)] if not found[i])


def test_small_tables(spark):
    item = " ".join(f"w{k}" for k in range(40))
    changed = " ".join(f"x{k}" if k % 8 == 7 else f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for n in (1, 6, 10):
        docs = spark.createDataFrame([(k, f"other words {k} and more of them") for k in range(n - 1)] + [(99, f"before {changed} after")], "doc_id long, text string")
        assert [r.doc_id for r in find_leaks(docs, bench).where("contaminated").collect()] == [99]
