"""Personal data against plain Python with the contract's patterns."""

import hashlib
import random
import re

from plumbline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def by_hand(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, h int")
    got = pii.scan(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t, *_ in rows:
        spans = by_hand(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.setdefault(d, set()).add((*(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest(), joined))
    for r in got:
        assert any((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == w[:5] and (r.spans == w[5] or r.spans.startswith(w[5])) for w in want[r.doc_id]), r
    return got


HARD = [
    None, "", "a@b.c_d@e.f", "x.y+z@host-1.co.uk, a@b a@.c @x.y a@b..c", "é.a@b.cé 日本a@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 000001.2.3.0255 1.2.3", "1.2.3.99999999999999999999",
    "4111 1111 1111 1111 x 4111-1111-1111-1111 41111111111111111111", "4111 1111 1111  1111", "+1 (499) 555-6503 +49.30.123456- +1+1+1 +123 +12345678901234567", "tel +1 2345678 4111111111111111", "a" * 2000 + "@b.c", "1" * 1500 + " 4111111111111111", "@" * 999, "  1.2.3.4\n5.6.7.8",
]


def test_hard(spark):
    check(spark, [(i, t, "s", 1) for i, t in enumerate(HARD)] + [(3, HARD[3], "s", 1), (None, "a@b.cd", "s", 1)])
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_take_linear_time(spark):
    rows = [(1, "a" * 400_000 + "@b.c"), (2, "1" * 4000 + "x" + "1." * 100_000), (3, "w " * 200_000 + "1.2.3.4"), (4, "+" * 100_000)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "email:0:400004" and got[3].spans == "ip:400000:400007" and got[2].n_ip == 25_000 and got[4].spans == ""


def test_random(spark):
    r = random.Random(8)
    for alphabet in ("ab@.-_ ", "12.5 3", "0123456789 -", "+12 ().-x"):
        check(spark, [(i, "".join(r.choice(alphabet) for _ in range(r.randint(1, 60))), "s", 1) for i in range(400)])


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text, "", 0) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_bootstrapping(spark):
    """Numbers in the contexts of known cards are found where the check digit fails; numbers in other contexts are left alone."""
    r = random.Random(1)

    def card():
        d = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    rows = [(i, f"pay with card number {card()} today or page {1000 + i} now", "", 0) for i in range(60)]
    rows += [(100, "pay with card number 4111111111111112 today", "", 0), (101, "see page 4711 now", "", 0)]
    got = {x.doc_id: x for x in check(spark, rows)}
    assert got[100].spans == "id:21:37" and got[101].spans == ""
    assert sum(x.n_extra for x in got.values()) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int")
    out = {x.doc_id: x for x in pii.redact(docs).collect()}
    assert out[100].text == "pay with card number <ID> today" and out[101].text == rows[-1][1]
    assert out[0].text == "pay with card number <CARD> today or page 1000 now" and out[0].n_chars == len(out[0].text)


def test_redact(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    for x in out.collect():
        assert (x.text is None) == (rows[x.doc_id][1] is None)
        assert x.text is None or not by_hand(x.text) or x.doc_id == 2 or "<" in x.text


def words_in(text):
    return [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def found_by_hand(texts):
    """Bootstrapping as described, over plain dictionaries: (text number, start, end) of the spans it adds."""
    instances = {}
    for d, text in enumerate(texts):
        tokens, base = words_in(text), by_hand(text)
        for k, m in enumerate(tokens):
            core = re.search(r"[^\W_](?:.*[^\W_])?", m[0], re.S)
            if not re.search("[0-9@]", m[0]) or not core or len(core[0]) < 4:
                continue
            a, b = m.start() + core.start(), m.start() + core.end()
            words = [t[0].lower() for t in tokens]
            before = words[max(0, k - 2) : k]
            mixed = re.sub(r"(?:[0-9]+[^\W\d_]|[^\W\d_]+[0-9])[^\W_]*", "*", core[0])
            shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", mixed))
            contexts = [("before", before[-1] if before else ""), ("before2", " ".join(before) if len(before) == 2 else ""), ("after", words[k + 1] if k + 1 < len(words) else "")]
            inside = any(x < b and a < y for _, x, y in base)
            instances[d, a, b] = (inside, inside or bool(re.fullmatch("[0-9a-f]{32,}", core[0])), [(*c, shape) for c in contexts if c[1]])
    score = {k: float(seed) for k, (_, seed, _) in instances.items()}
    for _ in range(pii.ROUNDS):
        sums = {}
        for k, (_, _, patterns) in instances.items():
            for p in patterns:
                sums.setdefault(p, []).append(score[k])
        sure = {p: sum(v) / (len(v) + pii.SHRINK) for p, v in sums.items()}
        sure = {p: c for p, c in sure.items() if c >= pii.CONFIDENT}
        reach = {}
        for k, (inside, _, patterns) in instances.items():
            own = [sure[p] for p in patterns if p in sure]
            rest = 1.0
            for c in own:
                rest *= 1 - min(c, 0.9999)
            reach[k] = (1 - rest if own and not inside else 0.0, len(own))
        score = {k: 1.0 if seed else reach[k][0] for k, (_, seed, _) in instances.items()}
    return {k for k, (r, n) in reach.items() if r >= pii.ACCEPT and n >= 2}


def test_bootstrapping_by_hand(spark):
    """The spans that the method adds to the given documents are those of a plain version, and there are some."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    got = {(r.doc_id, *map(int, s.split(":")[1:])) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans.split(",") if s.startswith("id:")}
    want = found_by_hand([t or "" for _, t in rows])
    assert got == {(rows[d][0], a, b) for d, a, b in want} and len(got) > 50
    # nearly every one is a key or token, the rest are numbers in the contexts of known ones
    secret = [bool(re.fullmatch("[0-9a-f]{32,}", rows[d][1][a:b])) for d, a, b in want]
    assert sum(secret) >= 0.9 * len(secret)
