import random
from collections import Counter, defaultdict

from quillet.llm.line_dedup import digest, drop_templates


def brute(rows, min_docs=8, similarity=0.7):
    """The same tree, one line at a time in plain Python; returns kept texts by (id, text)."""
    lines, leaves = [], defaultdict(set)
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            tokens = ["<*>" if any(c in "0123456789@/" for c in t) else t for t in line.encode().decode().replace("\t", " ").split(" ") if t]
            if len(tokens) >= 3:
                leaf = (len(tokens), *tokens[:3])
                lines.append((i, text, k, leaf, tuple(tokens)))
                leaves[leaf].add(tuple(tokens))
    heads = {}
    for leaf, members in leaves.items():
        head = []
        for column in zip(*members):
            n, token = max((n, t) for t, n in Counter(column).items())
            head.append(token if 2 * n >= len(column) else None)
        heads[leaf] = head
    def template(leaf, tokens):
        head = heads[leaf]
        fixed = [h for h in head if h is not None]
        if len(fixed) / len(head) >= similarity and sum(t == h for t, h in zip(tokens, head)) / len(fixed) >= similarity:
            return leaf
        return (leaf, tokens)
    texts, first = defaultdict(set), {}
    last = lambda i: 2**63 - 1 if i is None else i
    for i, text, k, leaf, tokens in lines:
        t = template(leaf, tokens)
        texts[t].add(text)
        first[t] = min(first.get(t, (2**63, 0)), (last(i), k))
    gone = defaultdict(set)
    for i, text, k, leaf, tokens in lines:
        t = template(leaf, tokens)
        if len(texts[t]) >= min_docs and (last(i), k) != first[t]:
            gone[i, text].add(k)
    return sorted((-1 if i is None else i, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i, text]) if text is not None else "~") for i, text in rows)


def test_against_brute_force(spark):
    draw = random.Random(8)
    word = lambda: f"w{'abcdefgh'[draw.randrange(8)]}{'klmnop'[draw.randrange(6)]}"
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(5))]
        if i % 3 == 0:
            lines.insert(0, f"Page {i} of 99 printed on 2024-01-{i:02}")
        if i % 4 == 0:
            lines.append(f"All rights  reserved by the {word()} company now")
        if i % 5 == 0:
            lines += ["a b", "a b"]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(None, "Page 7 of 9 printed on x1"), (8, None), (9, ""), (3, rows[3][1])]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, line_no int, gone string")
    out = drop_templates(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, "~" if r.text is None else r.text) for r in out) == brute(rows)
    assert any(r.n_dropped for r in out) and {"line_no", "gone"} <= set(df.columns)


def test_empty(spark):
    assert digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
