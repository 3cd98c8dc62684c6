"""Spark schemas of the tables the jobs exchange."""

from pyspark.sql import types as T

from regidx.fixed import COMPANY_LAYOUT, ESTABLISHMENT_LAYOUT


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


COMPANY_FILE = T.StructType(_strings(*COMPANY_LAYOUT))
ESTABLISHMENT_FILE = T.StructType(_strings(*ESTABLISHMENT_LAYOUT))

PARTICIPANT = T.StructType(
    _strings(
        "OrganisationId",
        "OrganisationName",
        "LegalEntityName",
        "RegisteredName",
        "RegistrationNumber",
        "Status",
        "City",
        "Size",
        "AuthorisationServers",
    )
)

REGISTRY = T.StructType(
    _strings(
        "cnpj",
        "cnpj_basico",
        "razao_social",
        "nome_fantasia",
        "situacao_desc",
        "cnae_fiscal_principal",
        "setor_atividade",
        "porte_desc",
        "porte_cod",
        "uf",
        "municipio",
        "segmento",
        "codigo_cvm",
        "organisation_id",
    )
    + [
        T.StructField("authorisation_servers", T.IntegerType()),
        T.StructField("capital_social_num", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

OPTIONAL_METADATA = (
    "nome_fantasia",
    "municipio",
    "codigo_cvm",
    "organisation_id",
    "segmento",
)
METADATA = T.StructType(
    _strings("razao_social", "cnpj_formatado", "situacao", "cnae", "porte", "porte_cod", "uf")
    + [T.StructField("capital_social", T.DoubleType())]
    + _strings("source", *OPTIONAL_METADATA)
)

CHUNK = T.StructType(
    _strings("cnpj", "text", "embed_text") + [T.StructField("metadata", METADATA)]
)

INDEX = T.StructType(
    _strings("chunk_id", "cnpj", "text_chunk", "text_md5")
    + [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("norm", T.FloatType()),
        T.StructField("metadata", METADATA),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("key_bucket", T.IntegerType()),
    ]
)

HIT = T.StructType(
    _strings("query_id")
    + [T.StructField("rank", T.IntegerType())]
    + _strings("chunk_id", "cnpj", "text_chunk")
    + [
        T.StructField("score", T.DoubleType()),
        T.StructField("vector_score", T.DoubleType()),
        T.StructField("name_score", T.DoubleType()),
        T.StructField("text_score", T.DoubleType()),
        T.StructField("prefix_hit", T.IntegerType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("created_at", T.TimestampType()),
    ]
)
