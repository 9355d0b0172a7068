"""Empty tables, clashing columns and texts of over a million code points, where the other tests don't have them."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridfold.llm import bpe, line_dedup, mixing, pii, quality, secrets
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_and_mixing_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality.judge(none).count() == 0 and quality.keep_good(none).columns == none.columns
    assert mixing.mix(none).count() == 0 and mixing.repeat_rows(none).count() == 0


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
    assert docs.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"]


def test_columns_with_the_operators_own_names(spark):
    """They are not read, and don't change the result."""
    text = " ".join(f"word{k % 37} of row" for k in range(80))
    rows = [(k, f"{text} {k}", "en", "a" if k % 2 else None, 5) for k in range(12)] + [(20, None, None, "b", None)]
    plain = spark.createDataFrame(rows, SCHEMA)
    clash = plain.withColumns({"doc": F.lit("x"), "g": F.lit(1), "s": F.lit(2), "b": F.lit(3), "n": F.lit(4), "size": F.lit(7), "target": F.lit("t"), "copies": F.lit(9), "kept": F.lit(True), "distance": F.lit(0.5)})
    judged = lambda df: sorted((r.doc, r.n_words, r.base_failed, r.kept) for r in quality.judge(df).collect())
    assert judged(clash) == judged(plain)
    mixed = lambda df: sorted((r.doc, r.size, r.target, r.copies) for r in mixing.mix(df).collect())
    assert mixed(clash) == mixed(plain)
    assert quality.keep_good(clash).columns == clash.columns and mixing.repeat_rows(clash).columns == clash.columns


@pytest.fixture(scope="module")
def long_text():
    line = "a line that is long enough, with mail to someone@example.org and +49 170 1234567 in it"
    return "\n".join([line, *(f"row {k} of many words é" for k in range(60_000)), line, "password = hunter2hunter2"])


def test_long_texts(spark, long_text):
    assert len(long_text) > 1_000_000
    df = spark.createDataFrame([(1, long_text), (2, "a line that is long enough, with mail to someone@example.org and +49 170 1234567 in it")], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.with_digests(pii.find(df)).collect()}
    assert (found[1].n_email, found[1].n_phone, found[2].n_email) == (2, 2, 1)
    assert {r.doc: r.n_assign for r in secrets.with_digests(secrets.scan(df)).collect()} == {1: 1, 2: 0}
    kept = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert kept == {1: (60_003, 0), 2: (1, 1)}
    words = {r.n_words: r for r in quality.statistics(df).collect()}
    want = brute.statistics(long_text)
    own = words[want[0]]
    assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == want
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path).select("doc_id", F.sha2("decoded", 256).alias("h")).collect()}
    assert back[1].h == hashlib.sha256(long_text.encode()).hexdigest()
