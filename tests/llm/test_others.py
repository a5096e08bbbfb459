import hashlib
import itertools
import json
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from textgauge.llm import cotraining, decontaminate, language_id, mixing, packed, token_shards
from textgauge.llm.common import scratch


def test_packed_words_and_blocks():
    texts = ["Ab  cd\n", None, "", "x", "é ü z ab", "ab" * 4000]
    w = packed.Words(pa.array(texts, pa.string()))
    assert w.count.tolist() == [len([x for x in (t or "").replace("\n", " ").split(" ") if x]) for t in texts]
    assert w.hash[0] == packed.Words(pa.array(["zz ab"])).hash[1] == w.hash[-2]
    a, b = np.arange(1000, dtype=np.uint64) ** 3, np.array([], np.int32)
    back = packed.unpack(packed.pack(a, b, np.array([1.5, -2.0])))
    assert (back[0] == a).all() and len(back[1]) == 0 and back[2].tolist() == [1.5, -2.0]


def test_contaminated(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(draw.choice([2, 4, 5, 12, 30, 60])))) for i in range(40)] + [(40, None), (41, ""), (3, "dup item of six words here")]
    docs = []
    for i in range(200):
        t = [word() for _ in range(draw.choice([0, 3, 50, 800]))]
        for _ in range(draw.choice([0, 0, 1, 3, 12])):
            words = (draw.choice(items)[1] or "").upper().split()
            if draw.random() < 0.4 and words:
                words[draw.randrange(len(words))] = "changed"
            at = draw.randrange(len(t) + 1)
            t[at:at] = words
        docs.append((i, " ".join(t)))
    docs += [(500, None), (500, ""), (None, items[5][1])]

    def runs(t, k):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}

    want = []
    for i, t in docs:
        for j, s in items:
            n = len((s or "").split())
            mine = runs(s, min(5, n)) if n else set()
            shared = len(mine & runs(t, min(5, n))) if n else 0
            if mine and 100 * shared >= 80 * len(mine):
                want.append((i, j, len(mine), shared))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = [tuple(r)[:4] for r in decontaminate.contaminated(d, b, block_bytes=block).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    left = decontaminate.decontaminate(d, b)
    assert left.count() == len(docs) - sum(any(w[0] == i for w in want) for i, _ in docs) and left.columns == d.columns
    assert decontaminate.contaminated(d, b.where("false")).count() == 0 and decontaminate.contaminated(d.where("false"), b).count() == 0
    assert decontaminate.rows_per_band(30, 32) > 0 and decontaminate.rows_per_band(5, 1 << 20) == 0


def earliest_deadlines(weights, n):
    """n slots by the plain rule, with rational numbers: of the released blocks the one with the earliest deadline, then by name."""
    total, had, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(n):
        due = {s: (math.ceil((had[s] + 1) * total / w), s) for s, w in weights.items() if math.floor(had[s] * total / w) <= t}
        s = min(due, key=due.get)
        out.append((s, had[s]))
        had[s] += 1
    return out


UNEVEN = {"a": 0.6004, "b": 0.2493, "c": 0.1, "d": 0.0499, "e": 0.0004}


def test_pfair_schedule_keeps_within_one_block():
    for weights in ({"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, UNEVEN, {str(i): 1.0 + i % 7 for i in range(30)}, {"big": 1000.0, "small": 0.001}):
        raw = {s: Fraction(w) for s, w in weights.items()}
        had, total = dict.fromkeys(weights, 0), sum(raw.values())
        slots = [x for x, _ in zip(mixing.slots_of(mixing.exact_weights(weights)), range(3000))]
        assert slots == earliest_deadlines(raw, 3000)
        for t, (s, k) in enumerate(slots, 1):
            assert k == had[s]
            had[s] += 1
            assert all(abs(had[x] - w * t / total) < 1 for x, w in raw.items())
    assert list(mixing.slots_of({})) == []


def brute_mix(rows, weights, block, horizon):
    """(slot, source, block, place, epoch, id) by the plain rule; rows are (id, source)."""
    sizes = Counter(s or "" for _, s in rows)
    raw = {s: Fraction(w) for s, w in weights.items() if s in sizes and w > 0}
    blocks = {s: -(-sizes[s] // block) for s in raw}
    n, had = 0, Counter()
    slots = earliest_deadlines(raw, sum(blocks.values()) * 40)
    for n, (s, _) in enumerate(slots, 1):
        had[s] += 1
        done = [had[x] >= blocks[x] for x in raw]
        if all(done) if horizon == "cover" else any(done):
            break
    return [(t, s, k % blocks[s], k // blocks[s]) for t, (s, k) in enumerate(slots[:n])], blocks, sizes


def test_mix_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 32)
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else None), f"t{i}" * (2000 if i == 7 else 1)) for i in range(400)] + [(0, "big", "again"), (0, "big", "again"), (None, "mid", "x"), (5, None, None)]
    names = "share total offset i blocks j k row source2 id hash all bucket number slot first rank had epoch n mix_slot mix_rank mix_hash mix_bucket mix_number __row".split()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", *(f"concat('own ', {k}) as `{x}`" for k, x in enumerate(names)))
    cases = [({"big": 0.6004, "mid": 0.2493, "": 0.1503}, "cover"), ({"big": 1, "mid": 3, "gone": 5, "": 0}, "shortest"), (None, "cover")]
    for weights, horizon in cases:
        got = mixing.mix(docs, weights, block=4, horizon=horizon).collect()
        given = {s: n**mixing.TEMPERATURE for s, n in mixing.source_counts(docs).items()} if weights is None else weights
        want, blocks, sizes = brute_mix([(i, s) for i, s, _ in rows], given, 4, horizon)
        assert sorted({(r.mix_slot, r.mix_source, r.mix_block, r.mix_epoch) for r in got}) == want
        by = Counter((r.mix_slot, r.mix_source) for r in got)
        for t, s, b, _ in want:  # each block is whole
            assert by[t, s] == min(4, sizes[s] - 4 * b)
        assert len({(r.mix_slot, r.mix_place) for r in got}) == len(got)
        for r in got:  # the user's columns are as they were
            assert all(r[x] == f"own {k}" for k, x in enumerate(names) if x != "mix_slot")
        if horizon == "cover":
            first = Counter((r.doc_id, r.source, r.text) for r in got if r.mix_epoch == 0)
            assert first == Counter(rows)
    again = [sorted(map(str, mixing.mix(docs.repartition(k), block=4).collect())) for k in (1, 5)]
    assert again[0] == again[1]
    empty = mixing.mix(docs.where("false"))
    assert empty.count() == 0 and empty.columns == mixing.mix(docs).columns


def test_mix_keeps_exact_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 500)
    weights = {"hot": 5000.0} | {f"s{i:03}": 25.0 for i in range(400)}
    rows = [(i, "hot" if i < 1000 else f"s{i % 400:03}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, {s: 1000.0 if s == "hot" else 5.0 for s in weights}, block=1).collect()
    assert sorted(r.mix_slot for r in got) == list(range(len(got)))
    assert {r.doc_id for r in got} == {i for i, _ in rows} and len(got) == 3000  # nothing is repeated
    rare = mixing.mix(docs, {"hot": 1.0, "s001": 1.0 / 1024}, block=1, horizon="cover").where("mix_source = 's001'").collect()
    assert len(rare) == 5 and {r.mix_epoch for r in rare} == {0}  # due less than a slot of a thousand


def test_permutation():
    for n in (1, 2, 3, 5, 100, 4097):
        assert sorted(token_shards.permute(np.arange(n), n).tolist()) == list(range(n))
        assert token_shards.permute(token_shards.permute(np.arange(n), n), n, back=True).tolist() == list(range(n))
    assert token_shards.permute(np.arange(100), 100, 1).tolist() != token_shards.permute(np.arange(100), 100, 2).tolist()


def test_encoder_is_exact():
    e = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read(), token_shards.PATTERN)
    alphabet = ["a", "Word", "don't", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "12", "!?", "\r\n", "😀", " ", "x" * 300]
    draw = random.Random(2)
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(300)] + [None, "", " ", "\n", "a ", " a", "a\n b", "a\n\n b"]
    for part in (texts[:150], texts[150:], texts):
        tokens, count = e.encode(pa.array(part, pa.string()))
        want = [[*e.bpe.encode_ordinary(t or ""), token_shards.END] for t in part]
        assert count.tolist() == [len(w) for w in want] and tokens.tolist() == list(itertools.chain(*want))


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(packed, "span_hashes", lambda raw, s, e: (e - s).astype(np.uint64))  # all pieces of a length collide
    e = token_shards.Encoder(open(token_shards.VOCABULARY, "rb").read(), token_shards.PATTERN)
    texts = ["one two six", "ten one", "", "abc abd", " a b"]
    for _ in range(2):
        tokens, count = e.encode(pa.array(texts))
        want = [[*e.bpe.encode_ordinary(t), token_shards.END] for t in texts]
        assert count.tolist() == [len(w) for w in want] and tokens.tolist() == list(itertools.chain(*want))


def test_shards_round_trip(spark):
    rows = [(i, f"text number {i} " * (i % 17)) for i in range(150)] + [(None, "no id"), (5, None), (6, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = scratch(spark, "test")
    listed = token_shards.write_shards(docs, folder, length=64, per_shard=10).collect()
    facts = json.loads(spark.read.text(f"{folder}/_facts").first()[0])
    assert facts["sequences"] == len(listed) and sorted(r.slot for r in listed) == list(range(len(listed)))
    read = dict(token_shards.read_sequences(folder, facts))
    assert [s for s, _ in token_shards.read_sequences(folder, facts, 13, 27)] == list(range(13, 27))
    assert any(r.slot != r.sequence for r in listed)
    stream = np.concatenate([read[r.slot][: r.n_tokens] for r in sorted(listed, key=lambda r: r.sequence)]).tolist()
    e = token_shards.encoder(open(token_shards.VOCABULARY, "rb").read(), token_shards.PATTERN)
    cut = [list(g) for k, g in itertools.groupby(stream, lambda x: x == token_shards.END) if not k]
    assert sorted(e.decode(x) for x in cut) == sorted(t for _, t in rows if t)
    assert stream.count(token_shards.END) == len(rows)
    assert [r.n_tokens for r in sorted(listed, key=lambda r: r.sequence)][:-1] == [64] * (len(listed) - 1)  # only the last is filled
    for r in listed:
        mine, own = r.doc_ids, [x for x in read[r.slot][: r.n_tokens]]
        assert len(mine) - 1 <= own.count(token_shards.END) + 1 and r.byte == r.slot % 10 * 128
        assert r.sha256 == hashlib.sha256(read[r.slot].tobytes()).hexdigest()
    for rounds in (1, 2):  # the rounds make no difference
        other = token_shards.write_shards(docs.selectExpr("*", "1 as slot", "2 as id", "'x' as shard"), scratch(spark, "test"), length=64, per_shard=10, rounds=rounds)
        assert sorted(map(tuple, other.collect())) == sorted(map(tuple, listed))
    assert token_shards.write_shards(docs.where("false"), scratch(spark, "test")).count() == 0


def test_language(spark):
    draw = random.Random(4)
    syllables = {"aa": ["ba", "be", "bi", "lo"], "bb": ["schu", "ung", "ker", "pf"], "cc": ["été", "oux", "ça", "re"]}
    rows = [(i, " ".join("".join(draw.choice(syllables[x]) for _ in range(3)) for _ in range(12)), x) for i, x in enumerate(draw.choice(list(syllables)) for _ in range(200))]
    rows += [(500, None, "aa"), (501, "", None), (502, "123 !?", "bb"), (503, "babebi 😀", None), (None, "schuung", "bb"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(got) == len(rows)
    lang = {(i, t): x for i, t, x in rows}
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502)) and by[503].lang_pred == "aa"
    assert sum(by[i].lang_pred == x for i, t, x in rows[:200]) >= 198 and all(0 <= r.score <= 1 for r in got) and lang
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs.where("false"))).collect()} == {"und"}
    kept = language_id.keep_identified(docs, language_id.train(docs))
    assert kept.columns == docs.columns and kept.where("doc_id in (500, 501, 502)").count() == 0 and kept.count() >= 200
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.identify(docs.selectExpr("doc_id", "text"), language_id.train(docs)).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert all(found[r.doc_id, r.text][0] == r.lang and found[r.doc_id, r.text][1] >= language_id.CHANCE for r in kept.where("doc_id is not null").collect())
    assert {r.lang for r in language_id.keep_identified(docs, language_id.train(docs), wanted=["aa"]).collect()} == {"aa"}


def hyperdimensional(text, vectors):
    """A text's vector, gram by gram."""
    out = np.zeros(language_id.DIMENSIONS)
    letters = [x if x.isalpha() else " " for x in (text or "").lower()]
    line = " " + "".join(letters) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    for k in range(1, len(line) - 1):
        if line[k] != " ":
            codes = [0 if x == " " else int(language_id.letter_codes()[ord(x)]) for x in line[k - 1 : k + 2]]
            out += np.roll(vectors[codes[0]], 2) * np.roll(vectors[codes[1]], 1) * vectors[codes[2]]
    return out


def test_language_matches_brute_force(spark):
    draw = random.Random(14)
    alphabet = {"aa": "abcde ", "bb": "efghij ", "cc": "äöüßé x"}
    rows = [(i, "".join(draw.choice(alphabet[x]) for _ in range(draw.randrange(0, 60))), x) for i, x in enumerate(draw.choice(list(alphabet)) for _ in range(120))]
    rows += [(900, "abc " * 20_000, "aa"), (901, "Abc, DEF! é1ß", None), (902, None, "bb"), (903, "123", "bb")]
    vectors = language_id.letter_vectors()
    own = [hyperdimensional(t, vectors) for _, t, _ in rows]
    sums = {}
    for (i, _, x), v in zip(rows, own):
        if x and zlib.crc32(str(i).encode()) % 5:
            sums[x] = sums.get(x, 0) + v
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    for (i, t, _), v in zip(rows, own):
        cosines = {x: float(v @ s / max(np.linalg.norm(v) * np.linalg.norm(s), 1e-12)) for x, s in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        known = any(c.isalpha() for c in t or "")
        assert math.isclose(got[i].score, max(0, cosines[best]) if known else 0, abs_tol=1e-4), i
        assert got[i].lang_pred == (best if known else "und") or sorted(cosines.values())[-1] - sorted(cosines.values())[-2] < 1e-4
    assert language_id.identify(docs.where("false"), language_id.train(docs)).count() == 0


def quality_rows(draw, n):
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        words = [draw.choice(["the", "words", "of", "prose", "and", "others"]) for _ in range(30)]
        rows.append((i, " ".join(words if good else [w + "$$$" for w in words]), "s1" if good == (draw.random() < 0.9) else "s2", "en", 100))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


DOCUMENTS = "doc_id long, text string, source string, lang string, n_chars long"


def test_cotraining(spark):
    rows, labels = quality_rows(random.Random(6), 600)
    truth = {r[0]: "$$$" not in r[1] for r in rows}
    rows += [(900, None, None, None, None), (901, "", "s1", "en", 0), (3, rows[3][1], "s1", "en", 1), (None, "x " * 200_000, "s1", None, 4)]
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 as quality", "2 as `row`", "3 as id", "4 as meta", "5 as y", "6 as z")
    marks = spark.createDataFrame([*labels, (None, 1), (7000, 0), (5, None)], "doc_id long, quality long")
    model = cotraining.train(docs, marks)
    got = cotraining.score_quality(docs, model).collect()
    assert len(got) == len(rows) and sum(model.pseudo) > 0
    assert sum(r.keep == truth[r.doc_id] for r in got if r.doc_id in truth) >= 590
    assert all(0 <= r.quality <= 1 for r in got)
    assert {r.quality for r in cotraining.score_quality(docs, cotraining.train(docs, marks.where("false"))).collect()} == {0.5}
    assert cotraining.score_quality(docs.where("false"), model).count() == 0
    assert cotraining.score_quality(docs.select("doc_id", "text"), model).count() == len(rows)
    assert {r.quality for r in cotraining.score_quality(docs, cotraining.train(docs.where("false"), marks)).collect()} == {0.5}


def test_cotraining_matches_brute_force(spark):
    """The same rounds over rows in memory, all of them sorted."""
    rows, labels = quality_rows(random.Random(7), 300)
    rows += [(1000 + k, rows[0][1], "s1", "en", 100) for k in range(40)] + [(2000, rows[1][1], "s2", "en", 100)] * 3  # ties
    columns = list(zip(*rows))
    text = cotraining.text_features(pa.array(columns[1], pa.string()))
    meta = cotraining.meta_features(pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64()))
    views, ids, known = (text, meta), columns[0], dict(labels)
    own = sorted((i, k) for k, i in enumerate(ids) if i in known)
    held = [k for i, k in own if zlib.crc32(str(i).encode()) % cotraining.FOLDS == 0]
    fit = [k for _, k in own if k not in held]
    y = {k: float(known[i]) for i, k in own}
    share, step = np.mean([y[k] for k in fit]), max(1, int(cotraining.GROWTH * len(fit)))
    counts = {0: max(1, round(step * (1 - share))), 1: max(1, round(step * share))}
    given, pool = [{}, {}], [k for k, i in enumerate(ids) if i not in known]

    def learn(v):
        ks = [*fit, *given[v]]
        return cotraining.Logistic(views[v][ks], np.array([y[k] for k in fit] + list(given[v].values()), float), np.array([1.0] * len(fit) + [0.5] * len(given[v])))

    models = [learn(0), learn(1)]
    for _ in range(cotraining.ROUNDS):
        for v in (0, 1):
            z = models[v].logit(views[v])
            free = [k for k in pool if k not in given[1 - v] and abs(z[k]) > cotraining.SURE]
            ties = lambda k: (ids[k], text[k].tobytes(), meta[k].tobytes())
            for label, sign in ((0, 1), (1, -1)):
                for k in sorted((k for k in free if (z[k] > 0) == label), key=lambda k: (sign * z[k], *ties(k)))[: counts[label]]:
                    given[1 - v][k] = label
        models = [learn(0), learn(1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    model = cotraining.train(docs, spark.createDataFrame(labels, "doc_id long, quality long"))
    assert model.pseudo == [len(g) for g in given] and min(model.pseudo) > 0
    order = [k for _, k in own]
    plain = cotraining.CoTrained(models, (text[order], meta[order]), np.array([y[k] for k in order]), np.array([k in held for k in order]), [0, 0])
    want = dict(zip(ids, plain.score(text, meta)[2]))
    for r in cotraining.score_quality(docs, model).collect():
        assert math.isclose(r.quality, want[r.doc_id], abs_tol=1e-6)


def test_metadata_say_nothing_of_the_text(spark):
    a = spark.createDataFrame([(1, "one text", "s", "en", 5), (2, "others\nmore", "s", "en", 5)], DOCUMENTS)
    got = cotraining.views_of(a).collect()
    assert got[0].meta == got[1].meta and got[0].text != got[1].text


@pytest.mark.parametrize("name", ["pipeline", "op1_katz_lm", "op10_cotraining"])
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries()
