"""Queries on the index table: listing, statistics, dashboards, mutations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regidx.catalog import standins as S
from regidx.catalog.registry_queries import ALL_SQL, ROOT
from regidx.catalog.sqltext import case_map, head_office_key, masked, word_similarity_ctes
from regidx.fixed import UNKNOWN_SOURCE
from regidx.functions.amounts import json_amount
from regidx.operators.embedding import hashed_trigrams, add_embedding
from regidx.operators.name_postings import NamePostings
from regidx.plans import listing, statistics
from regidx.plans.index_table import IndexTable
from regidx.plans.search import exact_hits, keyed_queries, known_keys, usable_queries
from regidx.functions.vectors import vector_text
from regidx.session import scratch_path, through_storage
from regidx.streaming.dedupe import STAMP, first_seen, stamped_chunk_stream
from regidx.streaming.ingest import chunk_stream, keep_index_current

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


INDEX_SQL = f"""
    keyed AS (SELECT *, {head_office_key(ROOT)} AS cnpj FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey),
    idx AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS chunk_id, cnpj,
                   c_name || ' ' || o_orderpriority AS text_chunk, c_name AS razao_social,
                   {masked('cnpj')} AS cnpj_formatado, o_orderstatus AS situacao, c_mktsegment AS cnae,
                   c_mktsegment AS porte, {case_map('c_mktsegment', S.SEGMENT_CODE)} AS porte_cod, n_name AS uf,
                   o_totalprice AS capital_social, {case_map('o_orderstatus', S.STATUS_SOURCE)} AS source,
                   o_orderpriority AS municipio,
                   CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '' END AS segmento,
                   o_orderdate AS created_at FROM keyed)"""
LATEST_SQL = f"""WITH {INDEX_SQL},
    latest AS (SELECT * FROM idx QUALIFY row_number() OVER (PARTITION BY cnpj ORDER BY created_at DESC, chunk_id) = 1)"""


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# --- listing ------------------------------------------------------------------------
@query(
    "latest_per_company",
    f"{LATEST_SQL} SELECT cnpj, text_chunk, strftime(created_at, '%Y-%m-%d') AS day FROM latest",
)
def latest_per_company(spark, folder) -> DataFrame:
    rows = listing.latest_companies(S.order_index(spark, folder))
    return rows.select("cnpj", "text_chunk", iso("created_at").alias("day"))


@query("company_page", f"{LATEST_SQL} SELECT cnpj, text_chunk FROM latest ORDER BY cnpj LIMIT 20 OFFSET 40")
def company_page(spark, folder) -> DataFrame:
    return listing.index_page(S.order_index(spark, folder), 20, 40).select("cnpj", "text_chunk")


@query(
    "company_items_filtered",
    f"""WITH {INDEX_SQL}, f AS (SELECT * FROM idx WHERE uf = 'NATION_7' AND (porte_cod = '05' OR porte = '05')
            AND source = 'cvm' AND razao_social ILIKE '%customer_0%')
        SELECT cnpj, cnpj_formatado, razao_social, uf, porte, porte_cod, situacao, cnae, capital_social, source FROM f
        QUALIFY row_number() OVER (PARTITION BY cnpj ORDER BY created_at DESC, chunk_id) = 1""",
)
def company_items_filtered(spark, folder) -> DataFrame:
    index = S.order_index(spark, folder)
    return listing.company_items(listing.latest_companies(index, "nation_7", "05", "cvm", "customer_0"))


# --- keys in questions -----------------------------------------------------------------
_QUESTIONS = f"""q AS (SELECT CAST(c_custkey AS VARCHAR) AS query_id, {head_office_key(ROOT)} AS key FROM customer)"""


def customer_questions(spark, folder) -> DataFrame:
    """One question per customer that names its key with the mask."""
    from regidx.functions.keys import key_mask, with_company_key

    customer = S.table(spark, folder, "customer").withColumn("root", F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return with_company_key(customer, "root").select(
        F.col("c_custkey").cast("string").alias("query_id"),
        F.concat(F.lit("quem e "), key_mask(F.col("cnpj")), F.lit("?")).alias("text"),
    )


@query(
    "key_lookup_batch",
    f"""WITH {INDEX_SQL}, {_QUESTIONS}
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank, chunk_id, cnpj,
               1.0 AS score, 'cnpj_exato' AS match_type
        FROM q JOIN idx ON cnpj = key
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) <= 3""",
)
def key_lookup_batch(spark, folder) -> DataFrame:
    hits = exact_hits(S.order_index(spark, folder), usable_queries(customer_questions(spark, folder)), 3)
    return hits.select("query_id", "rank", "chunk_id", "cnpj", "score", "match_type")


@query(
    "key_pattern_routing",
    f"""WITH {INDEX_SQL}, {_QUESTIONS}
        SELECT query_id, key, key IN (SELECT cnpj FROM idx) AS routed FROM q""",
)
def key_pattern_routing(spark, folder) -> DataFrame:
    keyed = keyed_queries(usable_queries(customer_questions(spark, folder)))
    known = known_keys(S.order_index(spark, folder), keyed).select(F.col("cnpj").alias("key"), F.lit(True).alias("seen"))
    return keyed.join(known, "key", "left").select(
        "query_id", "key", F.coalesce("seen", F.lit(False)).alias("routed")
    )


# --- names by their trigrams ---------------------------------------------------------------
_ASKED = """asked AS (SELECT CAST(s_suppkey AS VARCHAR) AS query_id, CASE s_suppkey % 6
        WHEN 0 THEN right(s_name, 4) WHEN 1 THEN 'PPLIER#_000' || right(s_name, 3) WHEN 2 THEN 'omer%' || right(s_name, 3)
        WHEN 3 THEN right(s_name, 2) WHEN 4 THEN 'absent ' || s_name ELSE upper(s_name) END AS text FROM supplier)"""


def _name_postings(spark, folder) -> NamePostings:
    return NamePostings(spark, scratch_path(spark, "names"), 16).build(S.chunks(spark, folder))


@query(
    "name_contains_indexed",
    f"""{ALL_SQL}, {_ASKED} SELECT DISTINCT query_id, razao_social AS name, cnpj FROM asked
        JOIN chunks ON razao_social ILIKE '%' || asked.text || '%'""",
)
def name_contains_indexed(spark, folder) -> DataFrame:
    """Parts of names, with wildcards, short, absent and whole, in the names of all three registries."""
    supplier = S.table(spark, folder, "supplier")
    kind, name = F.col("s_suppkey") % 6, F.col("s_name")
    text = (
        F.when(kind == 0, F.right(name, F.lit(4)))
        .when(kind == 1, F.concat(F.lit("PPLIER#_000"), F.right(name, F.lit(3))))
        .when(kind == 2, F.concat(F.lit("omer%"), F.right(name, F.lit(3))))
        .when(kind == 3, F.right(name, F.lit(2)))
        .when(kind == 4, F.concat(F.lit("absent "), name))
        .otherwise(F.upper(name))
    )
    queries = supplier.select(F.col("s_suppkey").cast("string").alias("query_id"), text.alias("text"))
    return _name_postings(spark, folder).containing(queries)


@query(
    "name_similar_indexed",
    f"""{ALL_SQL}, asked AS (SELECT CAST(n_nationkey AS VARCHAR) AS query_id,
            'supplier ' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS text FROM nation),
        names AS (SELECT DISTINCT razao_social AS name, cnpj FROM chunks),
        pairs AS (SELECT query_id || '|' || cnpj || '|' || name AS pid, query_id, cnpj, name, asked.text AS q, name AS t
                  FROM asked JOIN names ON true),
        {word_similarity_ctes('pairs', 'w')}
        SELECT query_id, name, cnpj, round(ws, 6) AS similarity FROM pairs JOIN w USING (pid) WHERE ws >= 0.7""",
)
def name_similar_indexed(spark, folder) -> DataFrame:
    """Names like a supplier's name, by word similarity."""
    nation = S.table(spark, folder, "nation")
    text = F.concat(F.lit("supplier "), F.lpad(F.col("n_nationkey").cast("string"), 9, "0"))
    queries = nation.select(F.col("n_nationkey").cast("string").alias("query_id"), text.alias("text"))
    found = _name_postings(spark, folder).similar(queries, 0.7)
    return found.withColumn("similarity", F.round("similarity", 6))


# --- statistics -------------------------------------------------------------------------
@query("total_rows", "SELECT count(*) AS total_embeddings FROM orders JOIN customer ON o_custkey = c_custkey")
def total_rows(spark, folder) -> DataFrame:
    return statistics.total_rows(S.order_index(spark, folder))


@query("distinct_companies", f"WITH {INDEX_SQL} SELECT count(DISTINCT cnpj) AS total_companies FROM idx")
def distinct_companies(spark, folder) -> DataFrame:
    return statistics.distinct_companies(S.order_index(spark, folder))


@query("last_ingestion", "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS last_ingestion FROM orders")
def last_ingestion(spark, folder) -> DataFrame:
    return statistics.last_ingestion(S.order_index(spark, folder)).select(iso("last_ingestion").alias("last_ingestion"))


@query(
    "stats_long",
    f"""WITH {INDEX_SQL}
        SELECT 'rows' AS kind, CAST(NULL AS VARCHAR) AS key, count(*) AS total,
               strftime(max(created_at), '%Y-%m-%d') AS day FROM idx
        UNION ALL SELECT 'companies', NULL, count(DISTINCT cnpj), NULL FROM idx
        UNION ALL SELECT 'source', source, count(*), strftime(max(created_at), '%Y-%m-%d') FROM idx GROUP BY source
        UNION ALL (SELECT 'state', uf, count(*) AS n, strftime(max(created_at), '%Y-%m-%d') FROM idx GROUP BY uf
                   ORDER BY n DESC, uf LIMIT 10)""",
)
def stats_long(spark, folder) -> DataFrame:
    return statistics.stats_long(S.order_index(spark, folder)).select("kind", "key", "total", iso("stamp").alias("day"))


@query(
    "stats_record",
    f"""WITH {INDEX_SQL}, s AS (SELECT source, count(*) AS n FROM idx GROUP BY source),
        u AS (SELECT uf, count(*) AS n FROM idx GROUP BY uf ORDER BY n DESC, uf LIMIT 10)
        SELECT (SELECT count(DISTINCT cnpj) FROM idx) AS total_companies,
               (SELECT count(*) FROM idx) AS total_embeddings,
               (SELECT string_agg(source, ',' ORDER BY source) FROM s) AS sources,
               (SELECT string_agg(source || '=' || n, ',' ORDER BY n DESC, source) FROM s) AS by_source,
               (SELECT string_agg(uf || '=' || n, ',' ORDER BY n DESC, uf) FROM u) AS top_uf,
               (SELECT strftime(max(created_at), '%Y-%m-%d') FROM idx) AS last_ingestion, 384 AS embedding_dim""",
)
def stats_record(spark, folder) -> DataFrame:
    def listed(column: str):
        entries = F.transform(
            F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        )
        return F.array_join(entries, ",").alias(column)

    return statistics.stats_record(S.order_index(spark, folder)).select(
        "total_companies", "total_embeddings", F.array_join("sources", ",").alias("sources"), listed("by_source"),
        listed("top_uf"), iso("last_ingestion").alias("last_ingestion"), "embedding_dim",
    )


def _grouped(column: str, name: str, total: str = "total", where: str = "", tail: str = "") -> str:
    return f"WITH {INDEX_SQL} SELECT {column} AS {name}, count(*) AS {total} FROM idx {where} GROUP BY 1 {tail}"


@query("count_by_source_default", _grouped(f"coalesce(source, '{UNKNOWN_SOURCE}')", "source"))
def count_by_source_default(spark, folder) -> DataFrame:
    return statistics.by_source_named(S.order_index(spark, folder))


@query("count_by_source", _grouped("source", "fonte"))
def count_by_source(spark, folder) -> DataFrame:
    return statistics.by_source(S.order_index(spark, folder))


@query("top10_states", _grouped("uf", "estado", tail="ORDER BY total DESC, estado LIMIT 10"))
def top10_states(spark, folder) -> DataFrame:
    return statistics.top_states(S.order_index(spark, folder))


@query(
    "count_by_size",
    _grouped(
        "CASE porte_cod WHEN '01' THEN 'Microempresa' WHEN '03' THEN 'EPP' WHEN '05' THEN 'Demais' "
        "ELSE 'Nao informado' END", "porte",
    ),
)
def count_by_size(spark, folder) -> DataFrame:
    return statistics.by_size(S.order_index(spark, folder))


@query("count_by_size_description", _grouped("porte", "porte"))
def count_by_size_description(spark, folder) -> DataFrame:
    return statistics.by_size_description(S.order_index(spark, folder))


@query(
    "count_by_segment",
    _grouped("coalesce(nullif(segmento, ''), 'Nao informado')", "segmento", "participantes", "WHERE source = 'bacen'"),
)
def count_by_segment(spark, folder) -> DataFrame:
    return statistics.participants_by_segment(S.order_index(spark, folder))


@query("distinct_sources", f"WITH {INDEX_SQL} SELECT DISTINCT source FROM idx WHERE source <> ''")
def distinct_sources(spark, folder) -> DataFrame:
    return statistics.source_names(S.order_index(spark, folder))


@query(
    "company_search_dashboard",
    f"""WITH {INDEX_SQL} SELECT razao_social AS empresa, cnpj_formatado AS cnpj, uf, cnae, situacao,
        CAST(capital_social AS DECIMAL(20, 2)) AS capital_social FROM idx WHERE cnae = 'MACHINERY'
        ORDER BY capital_social DESC NULLS FIRST, cnpj LIMIT 200""",
)
def company_search_dashboard(spark, folder) -> DataFrame:
    return statistics.company_dashboard(S.order_index(spark, folder), activity="MACHINERY")


@query(
    "participants_dashboard",
    f"""WITH {INDEX_SQL} SELECT razao_social AS instituicao, municipio, situacao AS status FROM idx
        WHERE source = 'bacen'""",
)
def participants_dashboard(spark, folder) -> DataFrame:
    return statistics.participant_dashboard(S.order_index(spark, folder))


@query(
    "json_metadata_filter",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DECIMAL(20, 2)) AS k FROM events
       WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS DECIMAL(20, 2)) >= 50""",
)
def json_metadata_filter(spark, folder) -> DataFrame:
    k = json_amount(F.get_json_object("props", "$.k"))
    rows = S.table(spark, folder, "events").filter(F.col("event_type") == "click")
    return rows.select("event_id", k.alias("k")).filter(F.col("k") >= 50)


@query(
    "vector_text",
    """SELECT vec_id, '[' || array_to_string(list_transform(embedding,
           lambda x: printf('%.7g', CAST(x AS DOUBLE))), ',') || ']' AS literal FROM embeddings""",
)
def vector_text_query(spark, folder) -> DataFrame:
    return S.table(spark, folder, "embeddings").select("vec_id", vector_text(F.col("embedding")).alias("literal"))


# --- table mutations -----------------------------------------------------------------------
FIRST, LATER = datetime(2026, 1, 1), datetime(2026, 2, 1)
SMALL = hashed_trigrams()


def _embedded(rows: DataFrame) -> DataFrame:
    return add_embedding(rows, "embed_text", SMALL)


def _table(spark) -> IndexTable:
    return IndexTable(spark, scratch_path(spark, "index"), S.BUCKETS).create()


def _shown(table: IndexTable) -> DataFrame:
    return table.read().select(
        "cnpj", "text_md5", "source", F.col("metadata.municipio").alias("municipio"),
        iso("created_at").alias("day"), F.round("norm", 4).alias("norm"),
    )


def _shown_sql(where: str, municipio: str, day: str) -> str:
    return (
        f"SELECT cnpj, md5(text) AS text_md5, source, {municipio} AS municipio, {day} AS day, 1.0 AS norm "
        f"FROM chunks WHERE {where}"
    )


@query(
    "upsert_snapshot",
    f"""{ALL_SQL} {_shown_sql("true", "CASE WHEN source = 'cvm' THEN 'X' ELSE municipio END",
                            "CASE WHEN source = 'bacen' THEN '2026-02-01' ELSE '2026-01-01' END")}""",
)
def upsert_snapshot(spark, folder) -> DataFrame:
    """Companies and listed first; then listed again with other metadata, and participants."""
    table, rows = _table(spark), S.chunks(spark, folder)
    table.upsert(_embedded(rows.filter(F.col("metadata.source") != "bacen")), FIRST)
    again = rows.filter(F.col("metadata.source") != "receita_federal").withColumn(
        "metadata",
        F.when(
            F.col("metadata.source") == "cvm", F.col("metadata").withField("municipio", F.lit("X"))
        ).otherwise(F.col("metadata")),
    )
    table.upsert(_embedded(again), LATER)
    return _shown(table)


@query(
    "replace_sources",
    f"""{ALL_SQL} {_shown_sql("source <> 'cvm' OR uf > 'NATION_2'", "municipio",
                            "CASE WHEN source = 'cvm' THEN '2026-02-01' ELSE '2026-01-01' END")}""",
)
def replace_sources(spark, folder) -> DataFrame:
    table, rows = _table(spark), S.chunks(spark, folder)
    table.upsert(_embedded(rows), FIRST)
    fresh = rows.filter((F.col("metadata.source") == "cvm") & (F.col("metadata.uf") > "NATION_2"))
    table.replace_sources(_embedded(fresh), ["cvm"], LATER)
    return _shown(table)


@query("delete_source", f"""{ALL_SQL} {_shown_sql("source <> 'bacen'", "municipio", "'2026-01-01'")}""")
def delete_source(spark, folder) -> DataFrame:
    table = _table(spark)
    table.upsert(_embedded(S.chunks(spark, folder)), FIRST)
    table.delete_source("bacen")
    return _shown(table)


@query(
    "stats_upkeep",
    f"""{ALL_SQL}, kept AS (SELECT * FROM chunks WHERE source <> 'bacen'),
        s AS (SELECT source, count(*) AS n FROM kept GROUP BY source),
        u AS (SELECT uf, count(*) AS n FROM kept GROUP BY uf ORDER BY n DESC, uf LIMIT 10)
        SELECT (SELECT count(*) FROM kept) AS total_embeddings, (SELECT count(DISTINCT cnpj) FROM kept) AS total_companies,
               (SELECT string_agg(source || '=' || n, ',' ORDER BY n DESC, source) FROM s) AS by_source,
               (SELECT string_agg(uf || '=' || n, ',' ORDER BY n DESC, uf) FROM u) AS top_uf, '2026-01-01' AS last_ingestion""",
)
def stats_upkeep(spark, folder) -> DataFrame:
    """Statistics from what is kept of each file, after a load, a repeated load of one source and a delete."""
    table, rows = _table(spark), S.chunks(spark, folder)
    table.upsert(_embedded(rows), FIRST)
    table.upsert(_embedded(rows.filter(F.col("metadata.source") == "cvm")), LATER)
    table.delete_source("bacen")

    def listed(column: str):
        entries = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(entries, ",").alias(column)

    return table.statistics().select(
        "total_embeddings", "total_companies", listed("by_source"), listed("top_uf"), iso("last_ingestion").alias("last_ingestion")
    )


@query("stream_upsert", f"{ALL_SQL} SELECT cnpj, md5(text) AS text_md5, source FROM chunks")
def stream_upsert(spark, folder) -> DataFrame:
    """Chunk files loaded by a stream, then replayed with a fresh checkpoint."""
    incoming = scratch_path(spark, "incoming")
    S.chunks(spark, folder).write.json(incoming)
    table = _table(spark)
    for run in ("first", "replay"):
        stream = chunk_stream(spark, incoming)
        keep_index_current(stream, table, scratch_path(spark, run), SMALL).awaitTermination()
    return table.read().select("cnpj", "text_md5", "source")


# --- streaming de-duplication -----------------------------------------------------------------
#: Loads: stamp of their rows; in the third one, every seventh row is stamped before the watermark.
LOADS = ("2026-01-01 00:00:00", "2026-01-01 00:30:00", "2026-01-01 03:00:00", "2026-01-01 03:10:00", "2026-01-01 09:00:00")
LATE = "2025-12-31 20:00:00"


@query(
    "stream_dedupe",
    f"""WITH {INDEX_SQL},
        rows AS (SELECT cnpj, md5(text_chunk) AS text_md5, chunk_id::BIGINT % {len(LOADS)} AS load,
                        chunk_id::BIGINT % {len(LOADS)} = 2 AND chunk_id::BIGINT % 7 = 0 AS late FROM idx),
        first AS (SELECT cnpj, text_md5, min(load) AS load FROM rows WHERE NOT late AND load < 4 GROUP BY ALL),
        -- Before the last load the watermark is 02:10: keys of the first two loads are forgotten, the others are not.
        again AS (SELECT DISTINCT cnpj, text_md5, 4 AS load FROM rows LEFT JOIN first f USING (cnpj, text_md5)
                  WHERE rows.load = 4 AND coalesce(f.load, 0) < 2),
        kept AS (SELECT * FROM first UNION ALL SELECT * FROM again)
        SELECT cnpj, text_md5, load::INT AS load FROM kept""",
)
def stream_dedupe(spark, folder) -> DataFrame:
    """Orders as five loads of a chunk stream: repeats within the delay and late rows go, forgotten keys come again."""
    index = S.order_index(spark, folder)
    number = F.col("chunk_id").cast("long")
    load = number % len(LOADS)
    stamp = F.element_at(F.array(*[F.lit(x) for x in LOADS]), (load + 1).cast("int"))
    rows = index.select(
        "cnpj", F.col("text_chunk").alias("text"), F.lit("").alias("embed_text"), "metadata",
        F.when((load == 2) & (number % 7 == 0), LATE).otherwise(stamp).cast("timestamp").alias(STAMP), load.alias("load"),
    )
    rows = through_storage(rows, "loads", ("load",))
    incoming, out = scratch_path(spark, "incoming"), scratch_path(spark, "deduped")
    for number in range(len(LOADS)):
        rows.where(F.col("load") == number).drop("load").coalesce(1).write.mode("append").json(incoming)
    unique = first_seen(stamped_chunk_stream(spark, incoming, 1), "1 hour")
    stream = unique.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "seen"))
    stream.trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.parquet(out)
    place = F.array_position(F.array(*[F.lit(x).cast("timestamp") for x in LOADS]), F.col(STAMP)) - 1
    return found.select("cnpj", "text_md5", place.cast("int").alias("load"))
