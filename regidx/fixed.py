"""File layouts, code tables, word lists, templates and patterns.

Everything here is data that results depend on, kept in one place and in the
order in which it is documented.
"""

# --- sentinel and null tokens -------------------------------------------------
NOT_INFORMED = "NAO INFORMADO"
UNKNOWN_SOURCE = "desconhecida"
READ_NULLS = ("", "NA", "NULL")
MISSING_WORDS = ("nan", "nat", "none")
NULL_TOKENS = (
    "",
    "-",
    "--",
    "n/a",
    "na",
    "nan",
    "none",
    "null",
    "nao informado",
    "não informado",
    "nao informada",
    "não informada",
    "0",
    "00000000",
    "*",
)

# --- delimited dialect --------------------------------------------------------
FIELD_SEPARATOR = ";"
FILE_ENCODING = "ISO-8859-1"
QUOTE = '"'

# --- file layouts -------------------------------------------------------------
COMPANY_LAYOUT = (
    "cnpj_basico",
    "razao_social",
    "natureza_juridica",
    "qualificacao_responsavel",
    "capital_social",
    "porte",
    "ente_federativo_responsavel",
)
ESTABLISHMENT_LAYOUT = (
    "cnpj_basico",
    "cnpj_ordem",
    "cnpj_dv",
    "identificador_matriz_filial",
    "nome_fantasia",
    "situacao_cadastral",
    "data_situacao_cadastral",
    "motivo_situacao_cadastral",
    "nome_cidade_exterior",
    "pais",
    "data_inicio_atividade",
    "cnae_fiscal_principal",
    "cnae_fiscal_secundaria",
    "tipo_logradouro",
    "logradouro",
    "numero",
    "complemento",
    "bairro",
    "cep",
    "uf",
    "municipio",
    "ddd_1",
    "telefone_1",
    "ddd_2",
    "telefone_2",
    "ddd_fax",
    "fax",
    "correio_eletronico",
    "situacao_especial",
    "data_situacao_especial",
)
LISTED_RENAMES = {
    "cnpj_cia": "cnpj_raw",
    "denom_social": "razao_social",
    "denom_comerc": "nome_fantasia",
    "sit": "situacao_cadastral",
    "setor_ativ": "setor_atividade",
    "uf": "uf",
    "cd_cvm": "codigo_cvm",
    "categ_reg": "categoria_registro",
    "tp_merc": "tipo_mercado",
    "mun": "municipio",
}
COMPANY_MEMBER = "EMPRE"
ESTABLISHMENT_MEMBER = "ESTABELE"
COMPANY_FILES = "Empresas*.zip"
ESTABLISHMENT_FILES = ("Estabelecimentos*.zip", "*ESTABELE*")
LISTED_FILE = "cad_cia_aberta.csv"
PARTICIPANT_FILE = "open_finance_participants.json"
HEADQUARTERS_FLAG = "1"

# --- code tables --------------------------------------------------------------
SIZE_NAMES = {
    "00": "Nao informado",
    "01": "Microempresa (ME)",
    "03": "Empresa de Pequeno Porte (EPP)",
    "05": "Demais (medio/grande porte)",
}
STATUS_NAMES = {
    "01": "Nula",
    "02": "Ativa",
    "03": "Suspensa",
    "04": "Inapta",
    "08": "Baixada",
}
LISTED_STATUS_NAMES = {
    "ATIVO": "Ativa",
    "CANCELADA": "Cancelada",
    "EM ANALISE": "Em analise",
}
DASHBOARD_SIZE_NAMES = {"01": "Microempresa", "03": "EPP", "05": "Demais"}
DASHBOARD_OTHER = "Nao informado"
ACTIVE = "Ativa"

# --- registries, in the order in which duplicates are resolved ----------------
SOURCES = ("receita_federal", "cvm", "bacen")
LISTED_SIZE = ("Companhia aberta", "05")
PARTICIPANT_SIZE = ("Instituicao financeira", "")
PARTICIPANT_SECTOR = "Instituicao participante do Open Finance Brasil"

# --- check digits -------------------------------------------------------------
CHECK_WEIGHTS = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
HEAD_OFFICE_SUFFIX = "0001"

# --- text templates -----------------------------------------------------------
CHUNK_TEMPLATE = (
    "Empresa: %s. CNPJ: %s. Situacao: %s. CNAE: %s. Porte: %s. UF: %s. Capital: R$ %s"
)
SEGMENT_LABEL = "segmento "
CONTEXT_BLOCK = "[%d] %s\n    (fonte: %s, similaridade: %s)"
SYSTEM_PROMPT = """Voce e um analista de dados financeiros brasileiro.
Responda SEMPRE em portugues do Brasil, de forma objetiva e tecnica.

Regras obrigatorias:
1. Use exclusivamente o CONTEXTO fornecido. Nao invente CNPJs, valores ou nomes.
2. Se o contexto nao contiver a resposta, diga explicitamente que a base
   ingerida nao possui essa informacao e sugira qual fonte poderia te-la
   (Receita Federal, CVM ou diretorio do Open Finance).
3. Cite os CNPJs (formatados) das empresas que embasam a resposta.
4. Nao repita o contexto cru; sintetize.
5. Seja conciso: no maximo 6 frases, salvo se o usuario pedir detalhamento."""
USER_PROMPT = """CONTEXTO RECUPERADO (%d registros da base):
%s

PERGUNTA: %s

RESPOSTA:"""
NO_CONTEXT_ANSWER = (
    "Nao encontrei nenhum registro na base vetorial para essa pergunta. "
    "Rode a ingestao (`python -m regidx.build`) ou reformule a consulta."
)

# --- retrieval ----------------------------------------------------------------
KEY_PATTERN = r"\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}[-\s]?\d{2}|\b\d{14}\b"
NAME_WEIGHT = 0.4
TEXT_WEIGHT = 0.6
PREFIX_WEIGHT = 0.4
MATCH_EXACT = "cnpj_exato"
MATCH_HYBRID = "semantico"
EMBEDDING_DIM = 384
EMBEDDING_BATCH = 32
EMBEDDING_MODEL = "paraphrase-multilingual-MiniLM-L12-v2"
VECTOR_CELLS = 100
PERIOD_PATTERN = r"(\d{4}-\d{2})"
