"""The stages by plain Python on a small corpus, and what they leave of it."""

import hashlib

import sentencepiece

import corpus_pipeline as P
from keyloom.llm import line_dedup, sentencepiece_bpe

from . import brute_dedup

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "mixing", "sentencepiece"]

    clean = P.drop_toxic(spark, docs, SF)
    assert clean.columns == COLUMNS and 0 < clean.count() <= docs.count()

    lines = P.dedup_lines(spark, clean, SF)
    assert lines.columns == COLUMNS and lines.count() == clean.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    texts = [(r.doc_id, r.text) for r in lines.collect()]
    kept = P.dedup_near(spark, lines, SF)
    want = {i for i, top in brute_dedup.components(texts, 5).items() if i == top}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == want

    mixed = P.mix_sources(spark, kept, SF)
    assert mixed.columns == COLUMNS and {r.doc_id for r in mixed.collect()} <= want

    coded = P.encode(spark, mixed, SF)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    by_id = dict(texts)
    for r in coded.collect():
        assert r.ids == library.encode(by_id[r.doc_id], add_eos=True) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"] and out.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() == 0


def test_lines_stage_is_the_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.text for r in P.dedup_lines(spark, docs, SF).collect()}
    b = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert a == b


def test_without_evidence_no_document_is_dropped(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").limit(8).collect()]
    cases = {"empty": [], "null": [(i, None) for i in ids], "few": [(i, k % 2) for k, i in enumerate(ids)], "toxic_only": [(i, 1) for i in ids]}
    for name, rows in cases.items():
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert P.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == docs.count()
