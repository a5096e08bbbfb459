import hashlib
import math
import random
import re

from textgauge.llm.pii import find_pii, likelihoods


def luhn(d):
    return sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + k % 2)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, "email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, "ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, "card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, "phone", m.start(), m.end()))
    return [f"{k}:{a}:{b}" for _, k, a, b in sorted(out)]


TEXTS = [
    None,
    "",
    "no data here",
    "mail a.b@c.example.com, and a@b.c_x@d.e or é😀 x@y.z.",
    "a@b.c@d.e @@ x@y z@.com",
    "1.2.3.4 999.1.1.1 001.002.003.255 1.2.3.4.5 0000256.1.1.1 10.0.0.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111111111",
    "call +1 (888) 555-6841 or +123 or +4930 1234567 and +1234567890123456",
    "😀+1 (888) 555-6841 4111111111111111 a@b.co 8.8.8.8",
    "1" * 5000 + " x",
    "a" * 5000 + "@" + "b." * 200 + "c",
    "john (at) example (dot) com",
    "tel (212) 555-0199 now",
]


def test_base_spans_match_python(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[8])]
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kind", "2 as row")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in rows:
        want, got = base(t), by[i]
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, got.spans)
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(got.spans.split(",")) | {""}
    assert by[11].spans.startswith("email:0:") and by[11].n_added == 1
    assert by[7].n_added == 0  # pieces of a strict number are no candidates
    assert by[8].n_added == 1  # its strict match runs on into the card and has too many digits
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likelihoods_trust_the_labeler_that_agrees():
    patterns = [((1, 1, 1), 50.0), ((-1, -1, 1), 40.0), ((1, 1, -1), 30.0), ((-1, -1, -1), 20.0)]
    p = likelihoods(patterns)
    assert p[0] > 0.9 and p[2] > 0.9 and p[1] < 0.1 and p[3] < 0.1
    assert likelihoods([]) == []


def plain_em(rows, rounds=400):
    """EM over single votes, one row after the other, from the majority vote."""
    post = [1 / (1 + math.exp(-2.0 * sum(v))) for v in rows]
    for _ in range(rounds):
        prior = (sum(post) + 1) / (len(rows) + 2)
        new = []
        tables = []
        for j in range(len(rows[0])):
            t = {}
            for y in (0, 1):
                weight = {x: 1 + sum((p if y else 1 - p) for v, p in zip(rows, post) if v[j] == x) for x in (-1, 0, 1)}
                for x in weight:
                    t[x, y] = weight[x] / sum(weight.values())
            tables.append(t)
        for v in rows:
            yes, no = prior, 1 - prior
            for t, x in zip(tables, v):
                yes, no = yes * t[x, 1], no * t[x, 0]
            new.append(yes / (yes + no))
        post = new
    return post


def test_em_matches_plain_one():
    draw = random.Random(8)
    rows = []
    for _ in range(300):
        y = draw.random() < 0.4
        rows.append(tuple(draw.choices([1, 0, -1], [r, 1, 1 - r] if y else [1 - r, 1, r])[0] for r in (0.9, 0.8, 0.7, 0.55)))
    kinds = sorted(set(rows))
    got = dict(zip(kinds, likelihoods([(k, float(rows.count(k))) for k in kinds], 400)))
    assert all(math.isclose(got[v], p, abs_tol=1e-5) for v, p in zip(rows, plain_em(rows)))


def test_obfuscated_items_are_added(spark):
    """Planted loose items and decoys among plain ones: nine in ten of the items are added, and nine in ten of what is added are items."""
    draw = random.Random(9)
    prose = lambda k: " ".join("".join(draw.choice("abdeimnorstu") for _ in range(draw.randrange(2, 9))) for _ in range(k))
    name = lambda: f"{prose(1)}.{prose(1)}"
    area, hosts = ["212", "415", "646", "917"], ["example.com", "mail.org", "work.net"]
    rows, planted = [], []
    for i in range(400):
        area_code, host = draw.choice(area), draw.choice(hosts)
        number = f"{draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}"
        user, domain = name(), host.split(".")
        item = [
            ("plain", f"mail {user}@{host}"),
            ("plain", f"call +1 ({area_code}) {number}"),
            ("email", f"{user} (at) {domain[0]} (dot) {domain[1]}"),
            ("email", f"{user} [at] {domain[0]} [dot] {domain[1]}"),
            ("phone", f"({area_code}) {number}"),
            ("phone", f"{area_code}-{number}"),
            ("decoy", f"{draw.randrange(10, 99)}:{draw.randrange(10, 60)}:{draw.randrange(10, 60)}:{draw.randrange(10, 99)}"),
            ("decoy", f"order {draw.choice(['00', '11'])}0-000-0000"),
            ("decoy", f"isbn {draw.randrange(10, 99)}-{draw.randrange(100, 999)}-0000-{draw.randrange(10, 99)}"),
        ][i % 9]
        cue = {"email": draw.choice(["contact ", "mail "]), "phone": draw.choice(["tel ", "call "])}.get(item[0], "") if draw.random() < 0.6 else ""
        before = f"{prose(6)} {cue}"
        rows.append((i, f"{before}{item[1]} {prose(6)}"))
        planted.append(f"{item[0]}:{len(before)}:{len(before) + len(item[1])}" if item[0] in ("email", "phone") else None)
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = [i for i, x in enumerate(planted) if x]
    caught = sum(planted[i] in got[i].spans.split(",") for i in wanted)
    added = sum(r.n_added for r in got.values())
    assert caught >= 0.9 * len(wanted) and caught >= 0.9 * added, (caught, len(wanted), added)


def test_long_text_and_repeated_rows(spark):
    long = "x " * 400_000 + "a@b.co"
    rows = [(1, long), (2, "a@b.co"), (2, "a@b.co"), (None, None)]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tag", "2 as strict", "3 as entry")).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in got) == [("1", 1, "email:800000:800006"), ("2", 1, "email:0:6"), ("2", 1, "email:0:6"), ("None", 0, "")]
