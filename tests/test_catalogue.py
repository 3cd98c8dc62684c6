"""Registered queries against their check SQL at the smallest scale.

``REGIDX_ALL=1`` runs the whole catalogue (several minutes).
"""

import os

import pytest

from regidx.catalog import CATALOGUE
from regidx.catalog.compare import compare

FOLDER = "/root/testdata/sf0.001"
QUICK = ("registry_standardise", "check_digits", "key_normalise_variants", "code_decode_segment", "clean_documents",
         "company_enrichment", "chunk_texts", "chunk_dedupe", "company_page", "key_lookup_batch", "stats_record",
         "company_search_dashboard", "cosine_topk_filtered", "trigram_similarity", "word_similarity", "hybrid_topk",
         "prompt_messages", "csv_dialect")
NAMES = list(CATALOGUE) if os.environ.get("REGIDX_ALL") else QUICK


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    rows, problem = compare(spark, FOLDER, *CATALOGUE[name])
    assert problem is None and rows > 0


def test_lexical_search_on_whole_texts_equals_full_evaluation(spark):
    """The query without check SQL, by brute force on a small fixture."""
    from pyspark.sql import functions as F
    from regidx.catalog import standins
    from regidx.functions.trigrams import batch_trigrams
    from regidx.plans.search import hybrid_hits
    from test_trigrams import all_stretches

    texts = ["alpha beta gamma delta " * 3, "beta gamma", "delta alpha omega beta", "nothing here at all", "gamma"]
    rows = [(i, text, "en", f"src{i}") for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    index = frame.select(
        F.md5(F.col("doc_id").cast("string")).alias("chunk_id"), F.lpad(F.col("doc_id").cast("string"), 14, "0").alias("cnpj"),
        F.col("text").alias("text_chunk"), standins.metadata(razao_social=F.lit("")).alias("metadata"),
        F.lit(None).cast("timestamp").alias("created_at"), "source",
        F.lit(None).cast("array<float>").alias("embedding"))
    questions = spark.createDataFrame(
        [("a", "beta gamma"), ("b", "omega alpha")], "query_id string, text string").withColumns(
        {name: F.lit(None).cast("string") for name in ("uf", "porte", "source")})
    hits = hybrid_hits(index.repartition(3), questions, 3).collect()
    for question in questions.collect():
        query = set(batch_trigrams([question.text])[0].tolist())
        expected = sorted(
            (-round(0.6 * all_stretches(query, batch_trigrams([text])[0].tolist()), 4), f"{i:014d}")
            for i, text in enumerate(texts))[:3]
        got = sorted((-hit.score, hit.cnpj) for hit in hits if hit.query_id == question.query_id)
        assert got == expected
