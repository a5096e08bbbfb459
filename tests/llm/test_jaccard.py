import random

import numpy as np

from textgauge.llm.components import components
from textgauge.llm import jaccard_join as J


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            i = len(sets[a] & sets[b])
            if same or sets[a] and sets[b] and 100 * i >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((-1 if i is None else i, len(sets[k]), -1 if (c := low.get(find(k)) if sets[k] else i) is None else c) for k, (i, _) in enumerate(rows))


def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(60)]
    base = [draw.choice(words) for _ in range(150)]
    rows = []
    for i in range(260):  # a group of near copies, documents that share a passage, small sets
        kind = i % 4
        if kind == 0:
            t = base[:]
            for _ in range(draw.choice([0, 1, 2, 3, 5])):
                t[draw.randrange(len(t))] = f"x{draw.random()}"
        elif kind == 1:
            t = passage + [draw.choice(words) for _ in range(draw.choice([3, 10, 40]))]
        elif kind == 2:
            t = base[: 5 + draw.randrange(14)]
        else:
            t = [draw.choice(words) for _ in range(draw.randrange(30))]
        rows.append((1000 - i, " ".join(t)))
    return rows + [(7, None), (8, ""), (9, " \n "), (1000, rows[0][1]), (None, rows[4][1]), (10, "One two"), (11, "one  TWO"), (12, "one")]


def test_components_match_brute_force(spark):
    rows = corpus()
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `set`", "2 as n")).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == brute(rows)


def test_long_lists_and_small_sets(spark, monkeypatch):
    for name, value in (("LIGHT", 3), ("SEEN", 2), ("POSTING_COST", 1000.0)):
        monkeypatch.setattr(J, name, value)
    rows = corpus()
    join = J.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    got = join.result().collect()
    assert join.boundary > 8 and join.long.count() > 100
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == brute(rows)


def test_bounds_and_boundary():
    for n in range(1, 60):
        for m in range(n, 60):
            for i in range(n + 1):
                assert (i >= J.need(n, m)) == (100 * i >= 80 * (n + m - i))
    assert J.choose_boundary({}) == 0 and J.choose_boundary({5: 10, 9: 100}) > 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: y for x, y in label.items() if x != y}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert np.uint64(3) == np.uint64(3)
