"""BPE against the tokenizers library: whole tables and hard strings."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


def same(own, library, texts):
    for text, (ids, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_hard_strings(own, library):
    same(own, library, ["", " ", "a", "Hello  World's 123 éà <|endoftext|> x", "a<|startoftext|>b's<|endoftext|>", "don't I'LL 's's", "İ ǅ ß ﬁ Σας ΟΔΟΣ 日本語 \x00\x1c\x1d x", "é ́e ̸", "a" * 5000, "ab" * 3000, "!?" * 999, "1234567890" * 30, "x　y z\x85w", "</w> <w/> a</w>b", "🙂🙃" * 40, "ſ K Å"])


def test_random_words(own, library):
    r = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "éàüñ'dtsm", "aA1 !'\t\n", "the of and ing tion".split()]
    same(own, library, ["".join(r.choice(a) for _ in range(r.randint(1, 40))) for a in alphabets for _ in range(1500)])


def test_random_code_points(own, library):
    r = random.Random(5)
    text = lambda: "".join(chr(c) for c in (r.choice((r.randint(0, 0x2FF), r.randint(0x300, 0x36F), r.randint(0x370, 0x2FFF), r.randint(0x3000, 0xD7FF), r.randint(0x1F000, 0x1FAFF))) for _ in range(12)))
    same(own, library, [text() for _ in range(3000)])


def test_proposals_are_verified(own, library):
    """The greedy match alone is often wrong, and the exact merger is not used for every word."""
    before = own.merged
    words = ["underthese", "thorndedble", "worthless", "reasonableness"]
    same(own, library, words)
    assert own.merged - before < len(words) * 2


def test_small_table(spark, library):
    hard = {3: "The end.", 4: "A" * 100_000}
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "The end.", "x"), (3, "The end.", "x"), (4, "A" * 100_000, "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_digests(docs, PATH).collect()}
    assert len(got) == 4 and got[1].n_tokens == got[2].n_tokens == 0
    ids = library.encode("The end.", add_special_tokens=False).ids
    assert got[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    for row in bpe.encode(docs, PATH).collect():
        assert row.ids == library.encode(hard.get(row.doc_id, ""), add_special_tokens=False).ids
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_whole_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in bpe.encode_digests(docs, PATH).collect()}
    for row in docs.collect():
        ids = library.encode(row.text, add_special_tokens=False).ids
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
