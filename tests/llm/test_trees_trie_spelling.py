import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from textgauge.llm import common, prefix_trie, reply_trees, spelling

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
TURNS = "conv_id long, turn long, role string, text string"
TRICKY = ["", None, "<|im_end|>", "<|im_start|>user\n", "<\\|im_end|>", "<\\\\\\|", "a<b|c", "\n\n", "<|", "|<", "é 字 \U0001f600", "%7C%250A", "<<<|||", "x" * 50_000]


def in_turn_order(rows):
    tie = lambda r: hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, tie(r))):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def conversations(seed=5):
    """Shared beginnings, copies, repeated and null turns, null roles, conversations of one base, a long one and one without an id."""
    rng, rows = random.Random(seed), []
    said = ["a b", "c", "  d  e ", "", None, "a b c"]
    for c in [*range(0, 70), 140, 141, 143, 159, 1_000_007, -1, -20, -21, None]:
        n = rng.choice([1, 1, 2, 3, 4, 5, 6])
        rows += [(c, rng.choice([t, t, t, t, None]), rng.choice(["user", "assistant", "user", None]), rng.choice(said[: 2 + (c or 0) % 5])) for t in range(n)]
    rows += [(40, 3, "user", "a b")] * 2
    rows += [(c, t, "user", f"long {t % 7}") for c in (60, 61, 62, 100, 103) for t in range(37 + c % 3)]
    return rows


def test_conversations_come_back(spark, monkeypatch):
    monkeypatch.setattr(common, "TURNS", 4)
    rows = conversations() + [(500 + i, t, r, x) for i, x in enumerate(TRICKY) for t, r in enumerate(["user", "assistant", "ass|istant\n%", "assistant"])]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as tree", "2 as __at")
    formatted = reply_trees.format_paths(reply_trees.replies(df), "conv_id", "message", "parent")
    want = {c: (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), sum(len(x) for r, x in ts if r == "assistant"), sha("".join(x for r, x in ts if r == "assistant"))) for c, ts in in_turn_order(rows).items()}
    got = reply_trees.conversation_digests(formatted).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)
    for f in formatted.collect():
        assert len(f.formatted) == next(r.formatted_chars for r in got if str(r.conv_id) == str(f.tree))
        assert f.formatted.count("<|im_start|>") == f.formatted.count("<|im_end|>") == f.n_turns
    assert reply_trees.conversation_digests(reply_trees.format_paths(reply_trees.replies(df.limit(0)), "conv_id", "message", "parent")).count() == 0


def test_branches_are_ranked(spark):
    tree = "tree string, id string, parent string, role string, text string, score double"
    rows = [("t", "r", None, "user", "q", 1.0), ("t", "a", "r", "assistant", "good", 5.0), ("t", "b", "r", "assistant", "bad", -1.0), ("t", "a1", "a", "user", "more", 0.0), ("t", "b1", "b", "user", "hm", None),
            ("t", "b1", "b", "user", "hm", None), ("t", "o", "gone", "user", "orphan", 2.0), ("t", "x", "y", "user", "circle", 9.0), ("t", "y", "x", "user", "circle", 9.0), ("t", "z", "y", "user", "on a circle", 9.0),
            ("t", None, "b", "user", "nameless", 3.0), (None, "r", None, "user", "no tree", None), ("t", "s", "s", "user", "itself", 1.0)]
    rows += [("wide", "w", None, "user", "w", 0.0)] + [("wide", f"w{i:03}", "w", "assistant", str(i), float(i // 2)) for i in range(300)]
    df = spark.createDataFrame(rows, tree).selectExpr("*", "1 as node", "2 as up")
    of = lambda most: reply_trees.format_paths(df, "tree", "id", "parent", score="score", most=most).collect()
    best = {r.tree: r for r in of(1)}
    assert set(best) == {"t", "wide", None}
    assert best["t"].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and best["t"].path_score == 2.0
    assert best["wide"].leaf == "=w298" and best["wide"].rank == 1 and best["wide"].n_turns == 2
    two = sorted((r.tree, r.rank, r.leaf) for r in of(2) if r.tree)
    assert two == [("t", 1, "=a1"), ("t", 2, "=o"), ("wide", 1, "=w298"), ("wide", 2, "=w299")]
    every = of(None)
    assert sorted(r.formatted.count("<|im_start|>") for r in every if r.tree == "t") == [1, 3, 3, 3] and sum(r.tree == "wide" for r in every) == 300


def trie(rows):
    turns = {c: ts for c, ts in in_turn_order(rows).items() if c is not None}
    made, rem = {}, lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(rem(c), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = lambda q: sum(len(x) == len(q) + 1 and x[:-1] == q for x in members if x)
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        ends = sorted(c for c in cs if len(made[c]) == len(p))
        out[min(cs), len(p)] = (min(members[p[:-1]]) if p else None, len(cs), children(p), sum(children(q) == 0 for q in below), sum((len(members[q]) - 1) * words(q) for q in below), sha(",".join(map(str, ends))))
    return out


def test_trie_equals_brute_force(spark, monkeypatch):
    for stretch in (4, 1 << 10):
        monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
        monkeypatch.setattr(prefix_trie, "LISTED", stretch)
        rows = conversations(stretch) + [(c, t, "user", "same") for c in range(200, 240) for t in range(6)]
        got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as c", "2 as said", "3 as d")).collect()
        want = trie(rows)
        assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == want and len(got) == len(want)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    alone = prefix_trie.conversation_trie(spark.createDataFrame([(7, None, None, None)], TURNS)).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in alone} == trie([(7, None, None, None)])


def test_chains_of_chains(spark):
    """Each conversation leaves the one before it a turn later, so that chains hang on chains to any height."""
    rows = [(20 * c, t, "user", f"{t}" if t < c else f"{c} {t}") for c in range(1, 14) for t in range(c + 2)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == trie(rows)


def variants(rows):
    counts = defaultdict(int)
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and spelling.one_apart(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_spelling_equals_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 12))) for _ in range(25)] + ["aaaaaaaa", "abababab", "Straßenbahn", "x" * 500, "y" * 49 + "z", "ÀÉÿ×÷abc"]
    texts = []
    for s in stems:
        for _ in range(40):
            w, i = s, rng.randrange(len(s))
            w = rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :], w[:i] + "c" + w[i + 1 :]])
            texts += [w.upper() if rng.random() < 0.1 else w] * rng.choice([1, 2, 40])
    texts += ["planted"] * 600 + ["plantid"] * 45 + ["plaqtid"] * 3
    rng.shuffle(texts)
    rows = [(i if i % 50 else None, rng.choice([" ", ", ", "1", "字"]).join(texts[j : j + 9])) for i, j in enumerate(range(0, len(texts), 9))]
    rows += [(1, None), (2, ""), (3, "short 123"), (5, rows[5][1]), (5, rows[5][1])]
    df, want = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n"), variants(rows)
    assert len(want) > 300 and any(v[0] and v[1] != v[0] for v in want.values())
    for hot, shard in ((1 << 14, 1 << 16), (3, 64)):
        got = spelling.spelling_variants(df, hot_half=hot, shard=shard).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_escapes_can_be_undone(spark):
    df = spark.createDataFrame([(x,) for x in TRICKY if x is not None], "t string")
    rows = df.select("t", reply_trees.escape(F.col("t")).alias("e"), reply_trees.escape_role(F.col("t")).alias("r"))
    for r in rows.select("*", reply_trees.unescape(F.col("e")).alias("t2"), reply_trees.unescape_role(F.col("r")).alias("t3")).collect():
        assert r.t == r.t2 == r.t3 and "<|" not in r.e and not set("\n|") & set(r.r)
