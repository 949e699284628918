"""Conversation repair against a plain dynamic programme and against every edit of small conversations."""

import hashlib
import itertools
import re
import zlib

import pytest

from plumbline.llm import conversations as cv

#: state -> initial -> next state
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}
WS = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        yield from [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "ok" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def least(rows, faults):
    """(cost, audit) by plain dynamic programming over whole audits."""

    def inserted(best):
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                for t, nxt in STEP[s].items():
                    if t in NAMES:
                        best[nxt] = min(best.get(nxt, (10**9, "")), (c + 2, a + "I"))
        return best

    best = inserted({"": (0, "")})
    for (_, _, role, _), fault in zip(rows, faults, strict=True):
        after = {}
        for s, (c, a) in best.items():
            options = [(s, c + 3, "D")]
            if fault in ("ok", "truncated"):
                more = fault == "truncated"
                options += [(nxt, c + more, "K") for t, nxt in STEP[s].items() if t == role[:1]]
                options += [(nxt, c + 2 + more, "R") for t, nxt in STEP[s].items() if t in NAMES]
            for nxt, cost, edit in options:
                after[nxt] = min(after.get(nxt, (10**9, "")), (cost, a + edit))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def repaired(rows, audit):
    out, state, rows = [], "", iter(rows)
    for edit in audit:
        want = next(t for t in STEP[state] if t in NAMES)
        if edit == "I":
            out.append((NAMES[want], ""))
            state = STEP[state][want]
            continue
        _, _, role, text = next(rows)
        if edit == "D":
            continue
        out.append((NAMES[want], text) if edit == "R" else (role, text))
        state = STEP[state][want if edit == "R" else role[:1]]
    return out


def by_hand(table, with_damage=True):
    out = []
    rows = list(damage(table)) if with_damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in table]
    for conv in {r[0] for r in table}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = faults_of(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit = least(mine, faults)
        initials = [r[2][:1] for r in mine]
        text = "\n".join(f"{r}:{x}" for r, x in repaired(mine, audit))
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, part int, n string, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def check(spark, rows, damage=True):
    got = sorted(map(tuple, cv.repair_digests(frame(spark, rows), damage).collect()), key=repr)
    assert got == by_hand(rows, damage)


def made(seed, n, turns):
    import random

    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "u"], ["Hello.", "Why? ", "cut off", "", " \t", "Yes!", None, "é…", "long. " * 50]
    return [(c, t if r.random() < 0.9 else None, r.choice(roles[:3] if r.random() < 0.9 else roles), r.choice(texts) if r.random() < 0.5 else f"word {r.random()}" + r.choice([".", ""])) for c in range(n) for t in range(r.randint(1, turns)) if r.random() < 0.95]


@pytest.mark.parametrize("damage", [True, False])
def test_random(spark, damage):
    check(spark, made(1, 150, 9), damage)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_long_conversation(spark):
    """Most rows are of one conversation, over several partitions; its opening repeats, so that duplicates lie far apart."""
    rows = [(5, t, ["user", "assistant", "assistant", "user", "system"][t * t % 5], ["same.", f"text {t}.", f"open {t}"][t % 3]) for t in range(700)]
    rows += made(3, 60, 6) + [(None, t, "user", "x.") for t in range(6)] + [(None, None, None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = cv.faults(cv.damaged(frame(spark, rows)))
        cut = {(r.conv_id, r.part) for r in cv.parts(found).collect()}
        assert len({p for c, p in cut if c == 5}) > 2
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_and_empty(spark):
    rows = made(4, 10, 5)
    check(spark, rows + rows[:7] * 3)
    assert cv.repair_digests(frame(spark, [])).count() == 0
    dropped = next((c, 0, "user", "x.") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = cv.repair_digests(frame(spark, [dropped])).collect()[0]
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = made(9, 40, 7)
    want = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        want += [(conv, k, role, text) for k, (role, text) in enumerate(repaired(mine, least(mine, faults_of(mine))[1]))]
    assert sorted((r.conv_id, r.position, r.role, r.text) for r in cv.repair(frame(spark, rows)).collect()) == sorted(want)


def parse(rows):
    chart = cv.Chart()
    for initial, fault in rows:
        chart.read(initial, fault)
    return cv.joined([{cv.START: chart.exits()}])


def test_all_edits_of_small_conversations():
    """Every audit of up to three rows, by brute force over edits."""
    names = {cv.OK: "ok", cv.CUT_OFF: "truncated", cv.DUPLICATE: "duplicate"}

    def every(rows):
        # inserts between rows need never be more than two in a row
        for edits in itertools.product("KRD", repeat=len(rows)):
            for inserts in itertools.product(range(3), repeat=len(rows) + 1):
                state, cost, audit, ok = "", 0, "", True
                for k in range(len(rows) + 1):
                    for _ in range(inserts[k]):
                        state, cost, audit = STEP[state][next(t for t in STEP[state] if t in NAMES)], cost + 2, audit + "I"
                    if k == len(rows):
                        break
                    (initial, fault), e = rows[k], edits[k]
                    audit += e
                    if e == "D":
                        cost += 3
                        continue
                    t = initial if e == "K" else next(t for t in STEP[state] if t in NAMES)
                    if fault == cv.DUPLICATE or t not in STEP[state]:
                        ok = False
                        break
                    cost, state = cost + (e == "R") * 2 + (fault == cv.CUT_OFF), STEP[state][t]
                if ok and state in ("", "a"):
                    yield cost, audit

    for n in range(4):
        for k, rows in enumerate(itertools.product([(i, f) for i in "suax" for f in names], repeat=n)):
            if n < 3 or k % 3 == 0 or all(f == cv.OK for _, f in rows):
                assert parse(rows) == min(every(rows)), rows


@pytest.mark.parametrize("seed", range(8))
def test_parts_join_as_the_whole(seed):
    import random

    r = random.Random(seed)
    rows = [(r.choice("uuaasx"), r.choice([cv.OK] * 4 + [cv.CUT_OFF, cv.DUPLICATE, cv.BLANK])) for _ in range(60)]
    cuts = sorted({0, 60, *(r.randint(1, 59) for _ in range(7))})
    tables = []
    for low, high in itertools.pairwise(cuts):
        tables.append({})
        for entry in cv.ENTRIES:
            chart = cv.Chart(entry)
            for x in rows[low:high]:
                chart.read(*x)
            tables[-1][entry] = chart.exits()
    assert cv.joined(tables) == parse(rows)
