"""The pipeline, stage by stage against what each stage promises, with the brute-force helpers of the operators' tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from test_near_dedup import by_hand as groups_by_hand
from test_pii import by_hand as spans_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    d = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 400"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, d).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((before, docs))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "personal data", "mixing", "bpe"]


def test_toxicity(staged):
    before, after = staged[0]
    assert after.columns == COLUMNS
    kept = {r.doc_id: r for r in after.collect()}
    assert 0.6 * before.count() < len(kept) < before.count()
    assert not any("idiot" in r.text.lower() and "moron" in r.text.lower() and "scum" in r.text.lower() for r in kept.values())


def test_near_duplicates(staged):
    before, after = staged[1]
    assert after.columns == COLUMNS
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = groups_by_hand(rows)
    assert sorted(r.doc_id for r in after.collect()) == sorted({want.get(d, d) for d, _ in rows})


def test_personal_data(staged):
    before, after = staged[2]
    assert after.columns == COLUMNS and after.count() == before.count()
    old = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text) and not [s for s in spans_by_hand(r.text) if s[0] in ("email", "card")]
        assert spans_by_hand(old[r.doc_id].text) or "<ID>" in r.text or r.text == old[r.doc_id].text


def test_mixing(staged):
    before, after = staged[3]
    assert after.columns == COLUMNS
    old = {r.doc_id: r for r in before.collect()}
    seen = {}
    for r in after.collect():
        assert old[r.doc_id] == r
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert max(seen.values()) <= 3


def test_bpe(staged):
    from tokenizers import Tokenizer

    before, after = staged[4]
    library = Tokenizer.from_file(corpus_pipeline.tokenizer())
    texts = {r.doc_id: r.text for r in before.collect()}
    got = after.collect()
    assert len(got) == before.count()
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
