"""Queries on keys, codes, texts, enrichment and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regidx.catalog import standins as S
from regidx.catalog.sqltext import (
    amount,
    case_map,
    check_digits,
    cleaned,
    digits,
    head_office_key,
    masked,
    or_default,
    titled,
    titled_if_upper,
)
from regidx.fixed import NOT_INFORMED, PARTICIPANT_SECTOR
from regidx.functions.amounts import format_amount, json_amount, parse_amount
from regidx.functions.codes import size_code, size_name, status_name
from regidx.functions.keys import key_mask, with_check_digits, with_company_key
from regidx.functions.text import city_name, clean_text
from regidx.operators.enrich import add_office, companies_with_office, headquarters
from regidx.operators.keyed import dedupe_chunks
from regidx.plans.registry import enrichment_rate, standardise_companies, standardise_participants

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


# --- shared check CTEs --------------------------------------------------------
SEGMENT_SIZE = {
    "AUTOMOBILE": "Microempresa (ME)",
    "BUILDING": "Empresa de Pequeno Porte (EPP)",
    "MACHINERY": "Demais (medio/grande porte)",
    "HOUSEHOLD": "Nao informado",
    "FURNITURE": "77",
}
SEGMENT_TWO = {"AUTOMOBILE": "01", "BUILDING": "03", "MACHINERY": "05", "HOUSEHOLD": "00", "FURNITURE": "77"}
PRIORITY_STATUS = {"1": "Nula", "2": "Ativa", "3": "Suspensa", "4": "Inapta", "5": "05"}
ROOT = "lpad(CAST(c_custkey AS VARCHAR), 8, '0')"

COMPANIES_SQL = f"""
    co_raw AS (SELECT c_custkey, {ROOT} AS root,
                      '  ' || c_mktsegment || ' "' || upper(c_name) || '"' || chr(9) || 'S.A. ' AS raw,
                      c_acctbal, c_mktsegment FROM customer),
    co_clean AS (SELECT *, {cleaned('raw')} AS c FROM co_raw),
    companies AS (SELECT c_custkey, {head_office_key('root')} AS cnpj, root AS cnpj_basico,
                         {titled_if_upper('c')} AS razao_social, c_acctbal AS capital_social_num,
                         {case_map('c_mktsegment', SEGMENT_SIZE)} AS porte_desc,
                         {case_map('c_mktsegment', SEGMENT_TWO)} AS porte_cod FROM co_clean)"""
OFFICES_SQL = f"""
    offices AS (SELECT o_custkey, upper(substr(o_orderpriority, 3, 2)) AS uf,
                       '62' || lpad(CAST(o_orderkey % 89 AS VARCHAR), 5, '0') AS cnae,
                       {case_map('substr(o_orderpriority, 1, 1)', PRIORITY_STATUS)} AS status
                FROM orders WHERE o_orderstatus = 'F'
                QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)"""
LISTED_SQL = f"""
    listed AS (SELECT CAST(s_suppkey * 1000003 + 60701190000104 AS VARCHAR) AS cnpj,
                      {titled("s_name || ' S.A'")} AS razao_social,
                      'Fantasia ' || CAST(s_suppkey AS VARCHAR) AS nome_fantasia,
                      CASE WHEN n_nationkey < 8 THEN 'Ativa' WHEN n_nationkey < 16 THEN 'Cancelada'
                           ELSE 'FASE PRE-OPERACIONAL' END AS situacao_desc,
                      r_name AS setor_atividade, upper(n_name) AS uf, 'SAO ' || r_name AS municipio,
                      CAST(s_suppkey AS VARCHAR) AS codigo_cvm
               FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PARTICIPANTS_SQL = f"""
    part_raw AS (SELECT CAST(p_partkey + 18236120000158 AS VARCHAR) AS cnpj,
                        upper(p_name) || ' ' || CAST(p_partkey AS VARCHAR) AS raw, upper(p_brand) AS city,
                        CASE WHEN p_type <> 'ECONOMY' THEN p_type ELSE '' END AS segmento,
                        'org-' || CAST(p_partkey AS VARCHAR) AS organisation_id, p_size FROM part),
    participants AS (SELECT cnpj, {titled('raw')} AS razao_social, {titled('city')} AS municipio, segmento,
                            '{PARTICIPANT_SECTOR}' || CASE WHEN segmento <> '' THEN ' - segmento ' || segmento
                                                           ELSE '' END AS setor_atividade,
                            organisation_id, p_size AS authorisation_servers FROM part_raw)"""
CHUNKS_SQL = f"""
    reg AS (
        SELECT cnpj, razao_social, '{NOT_INFORMED}' AS situacao, '{NOT_INFORMED}' AS cnae,
               CASE WHEN porte_desc = 'Nao informado' THEN '{NOT_INFORMED}' ELSE porte_desc END AS porte, porte_cod,
               '{NOT_INFORMED}' AS uf, capital_social_num AS capital_social, 'receita_federal' AS source,
               CAST(NULL AS VARCHAR) AS nome_fantasia, CAST(NULL AS VARCHAR) AS municipio,
               CAST(NULL AS VARCHAR) AS codigo_cvm, CAST(NULL AS VARCHAR) AS organisation_id,
               CAST(NULL AS VARCHAR) AS segmento FROM companies
        UNION ALL
        SELECT cnpj, razao_social, situacao_desc, setor_atividade, 'Companhia aberta', '05', uf, 0.0, 'cvm',
               nome_fantasia, municipio, CASE WHEN codigo_cvm = '0' THEN '{NOT_INFORMED}' ELSE codigo_cvm END,
               NULL, NULL FROM listed
        UNION ALL
        SELECT cnpj, razao_social, 'Active', setor_atividade, 'Instituicao financeira', '', '{NOT_INFORMED}', 0.0,
               'bacen', NULL, municipio, NULL, organisation_id, nullif(segmento, '') FROM participants),
    extras AS (SELECT *, list_filter([cnae, 'segmento ' || segmento, porte, municipio, uf, situacao],
                                     lambda e: e IS NOT NULL AND e NOT IN ('{NOT_INFORMED}', 'Ativa')) AS e FROM reg),
    chunks AS (SELECT *,
        'Empresa: ' || razao_social || '. CNPJ: ' || cnpj || '. Situacao: ' || situacao || '. CNAE: ' || cnae
        || '. Porte: ' || porte || '. UF: ' || uf || '. Capital: R$ ' || {amount('capital_social')} AS text,
        CASE WHEN len(e) = 0 THEN razao_social ELSE razao_social || ' - ' || array_to_string(e, ', ') END
            AS embed_text,
        {masked('cnpj')} AS cnpj_formatado FROM extras)"""
ALL_SQL = f"WITH {COMPANIES_SQL}, {LISTED_SQL}, {PARTICIPANTS_SQL}, {CHUNKS_SQL}"
COMPANY_CHUNKS_SQL = f"{COMPANIES_SQL}, {LISTED_SQL}, {PARTICIPANTS_SQL}, {CHUNKS_SQL}"


# --- scalar functions -----------------------------------------------------------
@query(
    "registry_standardise",
    f"""WITH {COMPANIES_SQL} SELECT cnpj, cnpj_basico, razao_social, capital_social_num,
        {amount('capital_social_num')} AS capital_text, porte_desc, porte_cod, '{NOT_INFORMED}' AS uf,
        '{NOT_INFORMED}' AS situacao_desc, 'receita_federal' AS source FROM companies""",
)
def registry_standardise(spark, folder) -> DataFrame:
    return standardise_companies(S.raw_companies(spark, folder)).select(
        "cnpj", "cnpj_basico", "razao_social", "capital_social_num",
        format_amount(F.col("capital_social_num")).alias("capital_text"),
        "porte_desc", "porte_cod", "uf", "situacao_desc", "source",
    )


@query(
    "check_digits",
    f"""WITH t AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0')
                         || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS twelve FROM orders)
        SELECT o_orderkey, twelve, {check_digits('twelve')} AS dv FROM t""",
)
def check_digits_query(spark, folder) -> DataFrame:
    rows = S.table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(
            F.lpad(F.col("o_orderkey").cast("string"), 8, "0"),
            F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"),
        ).alias("twelve"),
    )
    return with_check_digits(rows, "twelve", "dv")


@query(
    "key_mask",
    f"""SELECT p_partkey, {masked("lpad(CAST(p_partkey * 7919 AS VARCHAR), 14, '0')")} AS mask FROM part""",
)
def key_mask_query(spark, folder) -> DataFrame:
    return S.table(spark, folder, "part").select(
        "p_partkey", key_mask((F.col("p_partkey") * 7919).cast("string")).alias("mask")
    )


_VARIANT = "CAST(o_custkey AS VARCHAR) || '.' || CAST(o_orderkey AS VARCHAR) || '/' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"


@query(
    "key_normalise_variants",
    f"""WITH raw AS (SELECT o_orderkey, {_VARIANT} AS raw FROM orders),
        d AS (SELECT o_orderkey, raw, {digits('raw')} AS d FROM raw),
        b AS (SELECT *, lpad(d, 8, '0') AS root, CASE WHEN length(d) = 12 THEN d ELSE '000000000000' END AS twelve,
                     CASE WHEN length(d) >= 14 THEN substr(d, 1, 14) ELSE lpad(d, 14, '0') END AS filled FROM d)
        SELECT o_orderkey, raw,
            CASE WHEN length(d) = 12 THEN d || {check_digits('twelve')}
                 WHEN length(d) <= 8 THEN {head_office_key('root')} ELSE filled END AS padded,
            CASE WHEN length(d) = 12 THEN d || {check_digits('twelve')} ELSE filled END AS plain FROM b""",
)
def key_normalise_variants(spark, folder) -> DataFrame:
    raw = S.table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(
            F.col("o_custkey").cast("string"), F.lit("."), F.col("o_orderkey").cast("string"), F.lit("/"),
            F.floor("o_totalprice").cast("string"),
        ).alias("raw"),
    )
    return with_company_key(with_company_key(raw, "raw", "padded"), "raw", "plain", pad_to_head_office=False)


@query(
    "capital_parse_format",
    f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS v FROM orders)
        SELECT o_orderkey, v AS capital, {amount('v')} AS shown,
               CAST(v AS DECIMAL(20, 2)) AS exact FROM t""",
)
def capital_parse_format(spark, folder) -> DataFrame:
    price = F.format_number("o_totalprice", 2)
    written = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("R$ "), F.translate(price, ",.", ".,")))
        .when(F.col("o_orderstatus") == "O", "sem valor")
        .otherwise(F.replace(price, F.lit(","), F.lit("")))
    )
    rows = S.table(spark, folder, "orders").select("o_orderkey", parse_amount(written).alias("capital"))
    return rows.select(
        "o_orderkey", "capital", format_amount(F.col("capital")).alias("shown"),
        json_amount(F.format_string("%.2f", "capital")).alias("exact"),
    )


@query(
    "code_decode_segment",
    f"""SELECT c_custkey, {case_map('c_mktsegment', SEGMENT_SIZE)} AS size_name,
               {case_map('c_mktsegment', SEGMENT_TWO)} AS size_code,
               CASE WHEN c_nationkey = 1 THEN 'Nula' WHEN c_nationkey = 2 THEN 'Ativa' WHEN c_nationkey = 3
                    THEN 'Suspensa' WHEN c_nationkey = 4 THEN 'Inapta' WHEN c_nationkey = 8 THEN 'Baixada'
                    WHEN c_nationkey = 0 THEN '{NOT_INFORMED}' ELSE CAST(c_nationkey AS VARCHAR) END AS status
        FROM customer""",
)
def code_decode_segment(spark, folder) -> DataFrame:
    code = S.mapped(F.col("c_mktsegment"), S.SEGMENT_CODE)
    return S.table(spark, folder, "customer").select(
        "c_custkey", size_name(code).alias("size_name"), size_code(code).alias("size_code"),
        status_name(F.col("c_nationkey").cast("string")).alias("status"),
    )


@query(
    "municipality_normalise",
    f"""WITH t AS (SELECT p_partkey, upper(p_name) || ' D''OESTE' AS raw FROM part),
        c AS (SELECT p_partkey, {cleaned('raw')} AS c FROM t)
        SELECT p_partkey, {titled('c')} AS city FROM c""",
)
def municipality_normalise(spark, folder) -> DataFrame:
    city = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" D'OESTE , Sp"))
    return S.table(spark, folder, "part").select("p_partkey", city_name(city).alias("city"))


@query(
    "clean_documents",
    f"""WITH c AS (SELECT doc_id, {cleaned('text')} AS c FROM documents),
        d AS (SELECT doc_id, {or_default('c', NOT_INFORMED)} AS c FROM c)
        SELECT doc_id, c AS cleaned, length(c) AS n FROM d""",
)
def clean_documents(spark, folder) -> DataFrame:
    rows = S.table(spark, folder, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))
    return rows.withColumn("n", F.length("cleaned").cast("long"))


# --- enrichment -------------------------------------------------------------------
@query(
    "hq_enrichment_left",
    f"""WITH {COMPANIES_SQL}, {OFFICES_SQL}
        SELECT cnpj_basico, coalesce(lower(uf), '{NOT_INFORMED}') AS uf, coalesce(cnae, '{NOT_INFORMED}') AS cnae
        FROM companies LEFT JOIN offices ON c_custkey = o_custkey""",
)
def hq_enrichment_left(spark, folder) -> DataFrame:
    joined = add_office(
        S.raw_companies(spark, folder).drop("file_order"), headquarters(S.raw_establishments(spark, folder))
    )
    return joined.select(
        "cnpj_basico", F.coalesce("uf", F.lit(NOT_INFORMED)).alias("uf"),
        F.coalesce("cnae_fiscal_principal", F.lit(NOT_INFORMED)).alias("cnae"),
    )


@query(
    "hq_semi",
    f"""WITH {COMPANIES_SQL}, {OFFICES_SQL}
        SELECT cnpj_basico FROM companies WHERE c_custkey IN (SELECT o_custkey FROM offices)""",
)
def hq_semi(spark, folder) -> DataFrame:
    offices = headquarters(S.raw_establishments(spark, folder))
    return companies_with_office(S.raw_companies(spark, folder), offices).select("cnpj_basico")


@query(
    "company_enrichment",
    f"""WITH {COMPANIES_SQL}, {OFFICES_SQL}
        SELECT cnpj, razao_social, uf, cnae AS cnae_fiscal_principal, status AS situacao_desc, porte_desc
        FROM companies JOIN offices ON c_custkey = o_custkey""",
)
def company_enrichment(spark, folder) -> DataFrame:
    offices = headquarters(S.raw_establishments(spark, folder))
    return standardise_companies(S.raw_companies(spark, folder), offices).select(
        "cnpj", "razao_social", "uf", "cnae_fiscal_principal", "situacao_desc", "porte_desc"
    )


@query(
    "enrichment_rate",
    f"""WITH {COMPANIES_SQL}, {OFFICES_SQL}
        SELECT count(*) AS rows, count(uf) AS enriched FROM companies LEFT JOIN offices ON c_custkey = o_custkey""",
)
def enrichment_rate_query(spark, folder) -> DataFrame:
    offices = headquarters(S.raw_establishments(spark, folder))
    return enrichment_rate(add_office(S.raw_companies(spark, folder).drop("file_order"), offices))


@query(
    "participants_standardise",
    f"""WITH {PARTICIPANTS_SQL} SELECT cnpj, razao_social, municipio, segmento, setor_atividade, organisation_id,
        authorisation_servers, '' AS porte_cod FROM participants""",
)
def participants_standardise(spark, folder) -> DataFrame:
    return standardise_participants(S.raw_participants(spark, folder)).select(
        "cnpj", "razao_social", "municipio", "segmento", "setor_atividade", "organisation_id",
        "authorisation_servers", "porte_cod",
    )


@query(
    "registry_union",
    f"""{ALL_SQL} SELECT source, count(*) AS rows, count(DISTINCT cnpj) AS companies, count(municipio) AS cities,
        count(nome_fantasia) AS trade_names, count(organisation_id) AS organisations FROM reg GROUP BY source""",
)
def registry_union(spark, folder) -> DataFrame:
    return S.registry(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cnpj").alias("companies"),
        F.count("municipio").alias("cities"), F.count("nome_fantasia").alias("trade_names"),
        F.count("organisation_id").alias("organisations"),
    )


# --- chunks ------------------------------------------------------------------------
@query("chunk_texts", f"{ALL_SQL} SELECT cnpj, text FROM chunks")
def chunk_texts(spark, folder) -> DataFrame:
    return S.chunks(spark, folder).select("cnpj", "text")


@query("embed_texts", f"{ALL_SQL} SELECT cnpj, embed_text FROM chunks")
def embed_texts(spark, folder) -> DataFrame:
    return S.chunks(spark, folder).select("cnpj", "embed_text")


@query(
    "chunk_metadata",
    f"""{ALL_SQL} SELECT cnpj, razao_social, cnpj_formatado, situacao, cnae, porte, porte_cod, uf, capital_social,
        source, nome_fantasia, municipio, codigo_cvm, organisation_id, segmento FROM chunks""",
)
def chunk_metadata(spark, folder) -> DataFrame:
    return S.chunks(spark, folder).select("cnpj", "metadata.*")


@query(
    "chunk_dedupe",
    """SELECT lang AS cnpj, md5(text) AS digest, source, doc_id FROM documents
       QUALIFY row_number() OVER (PARTITION BY lang, text
           ORDER BY CAST(substr(source, 4) AS INTEGER), doc_id) = 1""",
)
def chunk_dedupe(spark, folder) -> DataFrame:
    order = tuple(f"src{number}" for number in range(20))
    kept = dedupe_chunks(S.document_chunks(spark, folder), order)
    return kept.select(
        "cnpj", F.md5("text").alias("digest"), F.col("metadata.source").alias("source"),
        F.col("metadata.razao_social").cast("long").alias("doc_id"),
    )
