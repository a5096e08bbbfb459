import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from textgauge.llm import katz
from textgauge.llm.katz import DISCOUNTED, KatzModel, discounts, score_corpus


def tokens(text):
    fold = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in fold.replace("\n", " ").replace("\t", " ").split(" ") if w] + ["</s>"]


def brute(rows, mod=7, out=2):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % mod == out for i, _ in rows]
    uni, bi = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            ws = tokens(t)
            uni.update(ws)
            bi.update(zip(["<s>", *ws], ws))
    total, v = sum(uni.values()), len(uni)

    def counts(c):
        n = Counter(min(x, DISCOUNTED + 2) for x in c.values())
        return np.array([0] + [n[r] for r in range(1, DISCOUNTED + 2)])

    d1, d2 = discounts(counts(uni)), discounts(counts(bi))
    disc = lambda c, d: c * (d[c] if c < len(d) else 1.0)
    left = sum(c - disc(c, d1) for c in uni.values()) / total if total else 1.0
    scale, unknown = (1.0, left) if left > 0 else (total / (total + 1), 1 / (total + 1))
    p1 = lambda w: scale * disc(uni[w], d1) / total if uni[w] else unknown
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = c

    def p2(h, w):
        seen = after.get(h)
        if not seen:
            return p1(w)
        n = sum(seen.values())
        rest = sum(c - disc(c, d2) for c in seen.values()) / n
        s, rest = (1.0, rest) if rest > 0 else (n / (n + 1), 1 / (n + 1))
        if w in seen:
            return s * disc(seen[w], d2) / n
        return rest / max(1 - sum(map(p1, seen)), unknown) * p1(w)

    result = []
    for (i, t), h in zip(rows, held):
        ws = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (total + v + 1)) for w in ws)
        result.append((i, h, len(ws), sum(uni[w] > 0 for w in ws), total, base, sum(math.log10(p2(a, w)) for a, w in zip(["<s>", *ws], ws))))
    return result, p2, uni, after


ROWS = [(i, " ".join(f"w{(i * j * j + j) % (3 + i % 11)}" for j in range(i % 23))) for i in range(60)] + [(60, None), (61, ""), (62, "W1 w2\tunseen\n"), (3, "w1 w1 w1"), (None, "w0 w1")]


def test_scores_match_brute_force(spark):
    want, p2, uni, after = brute(ROWS)
    got = score_corpus(spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as held", "0 as chunk"), order=2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], abs_tol=1e-6) and math.isclose(g[6], w[6], abs_tol=1e-6), (g, w)
    for h in ["<s>", "w1", "never"]:  # sums to one over all known words and one unknown
        assert math.isclose(sum(p2(h, w) for w in [*uni, "unknown word"]), 1, abs_tol=1e-9)


def test_split_histories(spark, monkeypatch):
    import textgauge.llm.katz as katz

    rows = [(i, " ".join(f"the w{(i * 37 + j) % 900}" for j in range(200))) for i in range(40)]
    want, *_ = brute(rows)
    got = score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), order=2).collect()
    by = {r.doc_id: r for r in got}
    for w in want:
        assert math.isclose(by[w[0]].score, w[6], abs_tol=1e-6)
    assert katz.PARTS > 1


def test_frequent_ends_of_texts(spark):
    rows = [(i, "a b") for i in range(2000)] + [(2000 + i, "c") for i in range(50)]
    want, *_ = brute(rows)
    got = {r.doc_id: r for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), order=2).collect()}
    assert all(math.isclose(got[w[0]].score, w[6], abs_tol=1e-6) for w in want)
    longer = score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()
    assert sorted(r.doc_id for r in longer) == [w[0] for w in want]


def test_empty(spark):
    assert score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = score_corpus(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert one.n_tokens == 1


def test_longer_orders_match_brute_force(spark):
    split = [(100 + i, " ".join(f"the the w{(i * 37 + j) % 900}" for j in range(100))) for i in range(40)]
    for rows, order in ((ROWS, 3), (ROWS, 4), (split, 3)):
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
        grams = [Counter() for _ in range(order + 1)]
        for (_, t), h in zip(rows, held):
            padded = ["<s>"] * (order - 1) + tokens(t)
            for n in range(1, order + 1) if not h else ():
                grams[n].update(tuple(padded[k - n + 1 : k + 1]) for k in range(order - 1, len(padded)))
        total = sum(grams[1].values())
        d, after = [None], [None, None]
        for c in grams[1:]:
            n = Counter(min(x, DISCOUNTED + 2) for x in c.values())
            d.append(discounts(np.array([0] + [n[r] for r in range(1, DISCOUNTED + 2)])))
        for c in grams[2:]:
            after.append(defaultdict(dict))
            for g, x in c.items():
                after[-1][g[:-1]][g[-1]] = x
        disc = lambda c, n: c * (d[n][c] if c <= DISCOUNTED else 1.0)
        unknown = sum(c - disc(c, 1) for c in grams[1].values()) / total
        weights = {}

        def p(h, w):
            n = len(h) + 1
            if n == 1:
                return disc(grams[1][w,], 1) / total if grams[1][w,] else unknown
            seen = after[n].get(h)
            if not seen:
                return p(h[1:], w)
            if h not in weights:
                c = sum(seen.values())
                rest = sum(x - disc(x, n) for x in seen.values()) / c
                s, rest = (1.0, rest) if rest > 0 else (c / (c + 1), 1 / (c + 1))
                weights[h] = s / c, rest / max(1 - sum(p(h[1:], x) for x in seen), unknown if n == 2 else 1e-12)
            return weights[h][0] * disc(seen[w], n) if w in seen else weights[h][1] * p(h[1:], w)

        want = []
        for i, t in rows:
            padded = ["<s>"] * (order - 1) + tokens(t)
            want.append((str(i), len(tokens(t)), sum(math.log10(p(tuple(padded[k - order + 1 : k]), padded[k])) for k in range(order - 1, len(padded)))))
        got = [(str(r.doc_id), r.n_tokens, r.score) for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()]
        assert len(got) == len(want)
        for g, w in zip(sorted(got), sorted(want)):
            assert g[:2] == w[:2] and math.isclose(g[2], w[2], abs_tol=1e-6), (order, g, w)
        for h in list(after[order])[:5] + [("w1",) * (order - 1), ("never",) * (order - 1)]:
            assert math.isclose(sum(p(h, w) for (w,) in [*grams[1], ("unknown word",)]), 1, abs_tol=1e-9)


def test_a_stored_model_scores_other_texts(spark, tmp_path):
    split = [(100 + i, " ".join(f"the the w{(i * 37 + j) % 900}" for j in range(100))) for i in range(40)]
    for rows, order in ((ROWS, 2), (ROWS, 3), (split, 3)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as `kind`", "0 as bucket")
        training = docs.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2")
        katz.train(training, order=order).save(f"file://{tmp_path}/model")
        model = KatzModel.load(spark, f"file://{tmp_path}/model")
        got = katz.score(model, docs).collect()
        want = score_corpus(docs, order=order).collect()
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.base_score, 6))
        assert len(got) == len(want) == len(rows)
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert g.doc_id == w.doc_id and g[2:5] == w[2:5] and g.held_out
            assert math.isclose(g.base_score, w.base_score, abs_tol=1e-9) and math.isclose(g.score, w.score, abs_tol=1e-9)
        assert katz.score(model, docs.where("false")).count() == 0


def test_long_text_and_colliding_cuts(spark, monkeypatch):
    rows = [(1, " ".join(f"v{i % 701}" for i in range(60_000))), (2, "v1 v2 v3"), (3, "v1 v2 v3")]
    want, *_ = brute(rows)
    got = {r.doc_id: r for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string"), order=2).collect()}
    assert all(math.isclose(got[w[0]].score, w[6], rel_tol=1e-9) and got[w[0]].n_tokens == w[2] for w in want)
    h, w = np.array([70_000, 3, 3, 3], np.uint32), np.array([5, 9, 8, 9], np.uint64)  # 17 bits: one of w is cut off
    order, new = katz.in_order(h, w)
    assert [(int(h[k]), int(w[k])) for k in order] == [(3, 8), (3, 9), (3, 9), (70_000, 5)] and new.tolist() == [True, True, False, True]
    code = np.array([5, 1, 5, 9], np.int64)
    for most in (10, 1 << 63):
        codes, one, at = katz.distinct(code, most)
        assert codes.tolist() == [1, 5, 9] and at.tolist() == [1, 0, 1, 2] and code[one].tolist() == [1, 5, 9]
