"""Prompt dataset: one row per question with its context, messages and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regidx.fixed import CONTEXT_BLOCK, NO_CONTEXT_ANSWER, SYSTEM_PROMPT, UNKNOWN_SOURCE, USER_PROMPT
from regidx.functions.amounts import fixed_places
from regidx.functions.text import filled_or
from regidx.operators.embedding import EncoderFactory
from regidx.plans.search import check_top_k, search

NO_MODEL = "none"


def _template(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def context_block(rank: Column, text: Column, source: Column, score: Column) -> Column:
    """``[i] text`` and a line with source and similarity to three places."""
    return _template(
        CONTEXT_BLOCK, rank, F.btrim(filled_or(text, ""), F.lit(" \t\n\r\x0b\x0c")),
        filled_or(source, UNKNOWN_SOURCE), fixed_places(F.coalesce(score, F.lit(0.0)), 3),
    )


def cited_source() -> Column:
    """The seven fields shown for a cited company."""
    texts = ("cnpj_formatado", "razao_social", "uf", "source")
    named = {name: filled_or(F.col(f"metadata.{name}"), "") for name in texts}
    return F.struct(
        F.col("cnpj"),
        named["cnpj_formatado"].alias("cnpj_formatado"),
        named["razao_social"].alias("razao_social"),
        F.round("score", 4).alias("score"),
        named["uf"].alias("uf"),
        named["source"].alias("source"),
        F.col("text_chunk"),
    )


def contexts(hits: DataFrame) -> DataFrame:
    """Per query: ordered context text and cited sources (at most top-k rows per group)."""
    block = context_block(F.col("rank"), F.col("text_chunk"), F.col("metadata.source"), F.col("score"))
    entry = F.struct(F.col("rank"), block.alias("block"), cited_source().alias("cited"))
    grouped = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return grouped.select(
        "query_id",
        F.size("entries").alias("n_documents"),
        F.array_join(F.col("entries.block"), "\n\n").alias("context"),
        F.col("entries.cited").alias("sources"),
    )


def messages(question: Column, count: Column, context: Column) -> Column:
    user = _template(USER_PROMPT, count, context, F.btrim(question, F.lit(" \t\n\r\x0b\x0c")))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def prompt_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every non-blank question; those without hits carry the fixed answer and no messages."""
    question = F.btrim("text", F.lit(" \t\n\r\x0b\x0c"))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), question.alias("question"))
    joined = asked.filter(F.col("question") != "").join(contexts(hits), "query_id", "left")
    found = F.col("n_documents").isNotNull()
    return joined.select(
        "query_id",
        "question",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.when(found, messages(F.col("question"), F.col("n_documents"), F.col("context"))).alias("messages"),
        F.coalesce("sources", F.array().cast(contexts(hits).schema["sources"].dataType)).alias("sources"),
        F.when(~found, F.lit(NO_CONTEXT_ANSWER)).alias("answer"),
        F.when(~found, F.lit(NO_MODEL)).alias("model_used"),
    )


def build_prompts(
    index: DataFrame, queries: DataFrame, k: int = 5, encoder: EncoderFactory | None = None, buckets: int | None = None
) -> DataFrame:
    """Search every question (state and size filters only) and assemble its prompt row."""
    check_top_k(k, 20)
    asked = queries.drop("source")
    return prompt_rows(asked, search(index, asked, k, encoder, buckets=buckets))
