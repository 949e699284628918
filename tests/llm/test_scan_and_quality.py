"""License scans and quality rules against plain Python."""

import re

from plumbline.llm import license_scan, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def quality_by_hand(text):
    words = WORD.findall(text)
    seen, places = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(p + d for p in at for d in range(3))
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(places) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(places), failed


def check_quality(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words string")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    want = sorted((d, *quality_by_hand(t or "")) for d, t, *_ in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_small(spark):
    many = " ".join(f"w{i % 211} x{i % 97}" for i in range(30_000))
    texts = [None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n\nx\r\n", "#*$ %&|<>", "é à\x0bb c", "the of and " * 40, many, "z" * 200_000]
    check_quality(spark, [(i, t, "k", "n") for i, t in enumerate(texts)] + [(4, "a a a", "k", "n")])


def test_quality_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text, "", "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_quality(spark, rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.judge(docs).join(labels, "doc_id").toPandas()
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.2


def licenses_by_hand(text):
    words = LICENSE_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check_licenses(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = license_scan.scan_licenses(docs).collect()
    want = [(d, *licenses_by_hand(t or "")) for d, t, *_ in rows]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    return {r.doc_id: r for r in got}


def test_licenses_small(spark):
    texts = [None, "", "under the MIT license", "Under-the/mit\nLICENSE. under the mit license", "underthe mit license", "cc by nc by nc cc_by-nc", "İ under the mit license é", "ünder the mit license", "under the mitélicense", "APACHE License, Version 2.0 " * 3, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0\nx", "x" * 300_000 + " cc by nc"]
    got = check_licenses(spark, [(i, t, "x") for i, t in enumerate(texts)])
    assert got[10].labels == "apache-2,gpl-3,mit" and got[10].score == 0.5


def test_licenses_documents(spark, sf_dir):
    check_licenses(spark, [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_expressions():
    run = lambda e: license_scan.evaluate(license_scan.parse(e))
    assert run("mit") == (frozenset({"mit"}), 1.0)
    assert run("mit or isc and mpl-2.0") == (frozenset({"mit", "isc", "mpl-2"}), 0.5)
    assert run("gpl-2.0+ with gcc-exception-2.0") == (frozenset({"gpl-2"}), 1.0)
    assert license_scan.parse("and mit") is None and license_scan.parse("(mit") is None and license_scan.parse("") is None
    assert license_scan.parse("mit this is text") == ["mit"]


def test_long_license_expression():
    """An expression is read to the end of its line, however long."""
    text = "SPDX-License-Identifier: (" + "MIT OR " * 900 + "Apache-2.0)\nand GPL-3.0"
    assert license_scan.scan(text, license_scan.automaton())["labels"] == "apache-2,mit"


def test_many_tags_on_one_line():
    """The work follows the text: twice the tags take about twice the tokens, and each tag is read."""
    machine, read = license_scan.automaton(), []
    plain = license_scan.tokens
    try:
        license_scan.tokens = lambda text, at=0: (read.append(1) or t for t in plain(text, at))
        counts = []
        for n in (500, 1000):
            read.clear()
            line = "spdx-license-identifier: mit or " * n + "SPDX-License-Identifier: isc"
            assert license_scan.scan(line, machine)["labels"] == "isc"
            counts.append(len(read))
        assert counts[1] < 2.2 * counts[0]
    finally:
        license_scan.tokens = plain
    assert license_scan.scan("x SPDX-License-Identifier: MIT SPDX-License-Identifier: (ISC OR mit)", machine)["labels"] == "isc,mit"


def test_licenses_of_an_empty_table(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string, labels int")).count() == 0
