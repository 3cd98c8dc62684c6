"""Registry-shaped frames derived from the star-schema test tables.

customer = tax registry, orders = its establishments, supplier = listed
companies, part = participants; orders joined to customer also stand in for an
index with several chunks per company, and embeddings supply vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regidx.functions.keys import key_mask, with_company_key
from regidx.plans.chunks import registry_to_chunks
from regidx.plans.registry import (
    standardise_companies,
    standardise_listed,
    standardise_participants,
    union_registry,
)
from regidx.schemas import METADATA
from regidx.sources.delimited import FILE_ORDER

BUCKETS = 8
STATUS_SOURCE = {"F": "receita_federal", "O": "cvm", "P": "bacen"}
SEGMENT_CODE = {"AUTOMOBILE": "01", "BUILDING": "3", "MACHINERY": "05", "HOUSEHOLD": "", "FURNITURE": "77"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Dealt to all cores: a table in one file or row group would be cleaned by the one task that reads it.

    The condition, true for all rows, keeps Spark from moving filters on cleaned values below the exchange.
    """
    tasks = max(rows.rdd.getNumPartitions(), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks).where(F.spark_partition_id() >= 0)


def mapped(column: Column, names: dict[str, str]) -> Column:
    branches = None
    for key, value in names.items():
        branches = (F if branches is None else branches).when(column == key, F.lit(value))
    return branches


def raw_companies(spark: SparkSession, folder: str) -> DataFrame:
    customer = spread(table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_acctbal"))
    return customer.select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("cnpj_basico"),
        F.concat(F.lit("  "), "c_mktsegment", F.lit(' "'), F.upper("c_name"), F.lit("\"\tS.A. ")).alias("razao_social"),
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("capital_social"),
        mapped(F.col("c_mktsegment"), SEGMENT_CODE).alias("porte"),
        F.struct(F.col("c_custkey")).alias(FILE_ORDER),
    )


def raw_establishments(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("cnpj_basico"),
        F.when(F.col("o_orderstatus") == "F", " 1 ").otherwise("2").alias("identificador_matriz_filial"),
        F.concat(F.lit("0"), F.left("o_orderpriority", F.lit(1))).alias("situacao_cadastral"),
        F.concat(F.lit("62"), F.lpad((F.col("o_orderkey") % 89).cast("string"), 5, "0")).alias("cnae_fiscal_principal"),
        F.lower(F.substring("o_orderpriority", 3, 2)).alias("uf"),
        F.struct("o_orderdate", "o_orderkey").alias(FILE_ORDER),
    )


def located_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    supplier = spread(table(spark, folder, "supplier"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


def raw_listed(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("n_nationkey") < 8, "ATIVO").when(F.col("n_nationkey") < 16, "CANCELADA")
    return located_suppliers(spark, folder).select(
        (F.col("s_suppkey") * 1000003 + 60701190000104).cast("string").alias("cnpj_cia"),
        F.concat(F.upper("s_name"), F.lit(" S.A.")).alias("denom_social"),
        F.concat(F.lit("Fantasia "), F.col("s_suppkey").cast("string")).alias("denom_comerc"),
        status.otherwise("FASE PRE-OPERACIONAL").alias("sit"),
        F.col("s_suppkey").cast("string").alias("cd_cvm"),
        F.col("r_name").alias("setor_ativ"),
        F.lower("n_name").alias("uf"),
        F.concat(F.lit("SAO "), "r_name").alias("mun"),
        F.struct(F.col("s_suppkey")).alias(FILE_ORDER),
    )


def raw_participants(spark: SparkSession, folder: str) -> DataFrame:
    part = spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return part.select(
        F.concat(F.lit("org-"), F.col("p_partkey").cast("string")).alias("OrganisationId"),
        F.lit("").alias("OrganisationName"),
        F.concat(F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("LegalEntityName"),
        F.lit(None).cast("string").alias("RegisteredName"),
        (F.col("p_partkey") + 18236120000158).cast("string").alias("RegistrationNumber"),
        F.lit("Active").alias("Status"),
        F.concat(F.upper("p_brand"), F.lit(", Sp")).alias("City"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("Size"),
        F.to_json(F.sequence(F.lit(1), F.col("p_size"))).alias("AuthorisationServers"),
        F.struct(F.col("p_partkey")).alias(FILE_ORDER),
    )


def registry(spark: SparkSession, folder: str) -> DataFrame:
    return union_registry(
        [
            standardise_companies(raw_companies(spark, folder)),
            standardise_listed(raw_listed(spark, folder)),
            standardise_participants(raw_participants(spark, folder)),
        ],
        spark,
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return registry_to_chunks(registry(spark, folder), keys_checked=True)


def metadata(**fields: Column) -> Column:
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields]
    )


def order_index(spark: SparkSession, folder: str) -> DataFrame:
    """One index row per order; several rows per company, three sources."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    rows = (
        table(spark, folder, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("root", F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    )
    keyed = with_company_key(rows, "root")
    code = mapped(F.col("c_mktsegment"), SEGMENT_CODE)
    source = mapped(F.col("o_orderstatus"), STATUS_SOURCE)
    return keyed.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("chunk_id"),
        "cnpj",
        F.concat("c_name", F.lit(" "), "o_orderpriority").alias("text_chunk"),
        metadata(
            razao_social=F.col("c_name"),
            cnpj_formatado=key_mask(F.col("cnpj")),
            situacao=F.col("o_orderstatus"),
            cnae=F.col("c_mktsegment"),
            porte=F.col("c_mktsegment"),
            porte_cod=code,
            uf=F.col("n_name"),
            capital_social=F.col("o_totalprice"),
            source=source,
            municipio=F.col("o_orderpriority"),
            segmento=F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise(""),
        ).alias("metadata"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        source.alias("source"),
    )


def embedding_index(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings table as an index; the label doubles as state and size code."""
    label = F.col("label").cast("string")
    return table(spark, folder, "embeddings").select(
        F.md5(F.col("vec_id").cast("string")).alias("chunk_id"),
        F.lpad(F.col("vec_id").cast("string"), 14, "0").alias("cnpj"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text_chunk"),
        metadata(razao_social=F.lit(""), uf=F.concat(F.lit("L"), label), porte_cod=label, source=F.lit("cvm")).alias(
            "metadata"
        ),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit("cvm").alias("source"),
        "embedding",
    )


def centroids(df: DataFrame, group: str) -> DataFrame:
    """Mean vector per group, as a query vector."""
    spread = df.select(group, F.posexplode("embedding").alias("place", "x"))
    means = spread.groupBy(group, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
    return ordered.select(group, F.col("v.x").alias("embedding"))


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One vector query per label: the centre of its vectors."""
    return centroids(table(spark, folder, "embeddings"), "label").select(
        F.col("label").cast("string").alias("query_id"),
        F.lit("").alias("text"),
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("uf"),
        F.col("label").cast("string").alias("porte"),
        F.lit("cvm").alias("source"),
        "embedding",
    )


def with_vectors(rows: DataFrame, number: Column, vectors: DataFrame) -> DataFrame:
    """``rows`` with the ``embedding`` whose id is ``number`` modulo the number of vectors."""
    count = vectors.agg(F.count("*").alias("_vectors"))  # one row
    dealt = rows.join(F.broadcast(count)).withColumn("vec_id", F.pmod(number, F.col("_vectors"))).drop("_vectors")
    return dealt.join(vectors.select("vec_id", "embedding"), "vec_id")


def company_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All customers as index rows with names and rendered texts; the vectors are dealt to them in turn."""
    companies = registry_to_chunks(standardise_companies(raw_companies(spark, folder)), keys_checked=True)
    return with_vectors(companies, F.left("cnpj", F.lit(8)).cast("long"), table(spark, folder, "embeddings")).select(
        F.md5(F.concat("cnpj", "text")).alias("chunk_id"),
        "cnpj",
        F.col("text").alias("text_chunk"),
        "metadata",
        F.lit(None).cast("timestamp").alias("created_at"),
        F.col("metadata.source").alias("source"),
        "embedding",
        F.col("metadata.porte").alias("size"),
    )


def size_queries(rows: DataFrame) -> DataFrame:
    """One hybrid query per company size: first name of the group and its mean vector."""
    names = rows.groupBy("size").agg(F.min("metadata.razao_social").alias("text"))
    return centroids(rows, "size").join(names, "size").select(
        F.col("size").alias("query_id"), "text", F.lit(None).cast("string").alias("uf"),
        F.col("size").alias("porte"), F.lit(None).cast("string").alias("source"), "embedding",
    )


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks; exact copies exist, so de-duplication has work to do."""
    return table(spark, folder, "documents").select(
        F.col("lang").alias("cnpj"),
        "text",
        F.col("text").alias("embed_text"),
        metadata(razao_social=F.lpad(F.col("doc_id").cast("string"), 12, "0"), source=F.col("source")).alias("metadata"),
    )


def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as index rows without vectors."""
    return table(spark, folder, "documents").select(
        F.md5(F.col("doc_id").cast("string")).alias("chunk_id"),
        F.lpad(F.col("doc_id").cast("string"), 14, "0").alias("cnpj"),
        F.col("text").alias("text_chunk"),
        metadata(razao_social=F.lit(""), source=F.col("source")).alias("metadata"),
        F.lit(None).cast("timestamp").alias("created_at"),
        "source",
        F.lit(None).cast("array<float>").alias("embedding"),
    )


