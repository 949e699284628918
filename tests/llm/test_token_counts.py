"""Counts under edits equal counts of the edited text."""

import random

import public_tokenizers
import pytest

from plumbline.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(PATH, public_tokenizers.PATTERN)


def test_edits(counter):
    r = random.Random(4)
    alphabet = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "1", ".", "é", "word ", "it's ", "\t", "!?"]
    text = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    for _ in range(300):
        tree = tc.TokenTree(text(r.choice((0, 1, 5, 60, 900))), counter)
        for _ in range(12):
            n = len(tree.text)
            start = r.randint(0, n + 2)
            want_text = None
            end, new = start + r.choice((0, 1, 3, 50)), text(r.choice((0, 1, 2, 40)))
            a, b = min(start, n), min(max(start, end), n)
            want_text = tree.text[:a] + new + tree.text[b:]
            tree.edit(start, end, new)
            assert tree.text == want_text
            assert tree.tokens == len(counter.encoding.encode_ordinary(want_text))
            assert tree.root.chars == len(want_text)


def test_edits_recount_little(counter):
    tree = tc.TokenTree("the quick brown fox, " * 20_000, counter)
    before = counter.recounted
    tree.edit(200_000, 200_003, "slow")
    assert counter.recounted - before < 10


def test_documents(spark, sf_dir, counter):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tc.count_with_edits(docs, PATH, public_tokenizers.PATTERN).collect():
        t = texts[r.doc_id]
        assert r.n_tokens == len(counter.encoding.encode_ordinary(t))
        for start, end, new in tc.sample_edits(r.doc_id, len(t)):
            a = min(start, len(t))
            t = t[:a] + new + t[min(max(a, end), len(t)) :]
        assert r.n_edited == len(counter.encoding.encode_ordinary(t))


def test_small(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "ab " * 100_000, "x"), (3, "ab " * 100_000, "x")]
    got = tc.count_with_edits(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, public_tokenizers.PATTERN, lambda d, n: []).collect()
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 2] and all(r.n_tokens == r.n_edited and r.n_recounted == 0 for r in got)


def test_stored_trees(spark, counter, tmp_path):
    """Trees are written, edited by a table, written again and edited again; nothing but the touched regions is counted anew."""
    base = {k: "it's a word, and " * k * 40 + "end" for k in range(30)}
    docs = spark.createDataFrame([*base.items(), (None, "no edits here"), (7, "another text of doc 7"), (50, None)], "doc_id long, text string").selectExpr("*", "1 n_tokens", "'x' sizes")
    tc.trees(docs, PATH, public_tokenizers.PATTERN).write.parquet(f"{tmp_path}/v0")
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    r = random.Random(6)
    for version in range(2):
        edits = [(k, s, start := r.randint(0, 600), start + r.randint(0, 30), r.choice(["", " new words", "\n\n", "é"])) for k in range(0, 60, 2) for s in range(r.randint(0, 4))]
        table = spark.createDataFrame([*edits, (None, 0, 0, 5, "never")], "doc_id long, seq int, start long, end long, new string")
        tc.apply_edits(spark.read.parquet(f"{tmp_path}/v{version}"), table, PATH, public_tokenizers.PATTERN).write.parquet(f"{tmp_path}/v{version + 1}")
        for n, (k, t) in enumerate(texts):
            for _, _, start, end, new in sorted(e for e in edits if e[0] == k):
                a = min(start, len(t))
                t = t[:a] + new + t[min(max(a, end), len(t)) :]
            texts[n] = (k, t)
        got = spark.read.parquet(f"{tmp_path}/v{version + 1}").collect()
        assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted(texts, key=repr)
        assert all(x.n_tokens == len(counter.encoding.encode_ordinary(x.text)) == sum(tc.unpack(x.counts)) and sum(tc.unpack(x.sizes)) == len(x.text) for x in got)
        assert all(x.n_recounted <= 60 for x in got) and all(x.n_recounted == 0 for x in got if x.doc_id is None or x.doc_id % 2)
    assert tc.unpack(tc.pack([1, 70_000, 0])) == [1, 70_000, 0] and tc.unpack(tc.pack([300])) == [300] and tc.unpack(tc.pack([])) == []
    empty = tc.trees(docs.limit(0), PATH, public_tokenizers.PATTERN)
    assert empty.count() == 0 and tc.count_with_edits(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
