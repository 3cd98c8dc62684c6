"""Registered queries over the whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regidx.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    embedding_dedup,
    importance,
    lexical_rank,
    line_dedup,
    mixing,
    secrets,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)
from regidx.llm.common import UPPER, table

#: The conversation every chat digest also covers.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), n_chars=None)
    return cut.select("doc_id", "n_lines", "n_dropped", "text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], turns.schema
    )
    return chat_format.digest(chat_format.format_chats(turns.unionByName(extra)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return byte_bpe.digest(coded)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = f"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), 13) AS n FROM it WHERE len(w) > 0),
lay AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM lay),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) JOIN win USING (n, s)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)
"""  # noqa: S608


def _escaped_length(column: str) -> str:
    template = chat_format.ChatTemplate()
    sql = f"replace({column}, '\\', '\\0')"
    for control, code in zip(template.control, chat_format.CODES, strict=False):
        sql = f"replace({sql}, '{control}', '\\{code}')"
    return f"length({sql})"


_T = chat_format.ChatTemplate()
OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', 'assistant', '{EXTRA_TEXT}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(_T.turn + _T.body + _T.end)} + {_escaped_length("r")} + {_escaped_length("x")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""  # noqa: S608

SPACED = r"[^\x20\x09-\x0D]+"
_W = list(mixing.WEIGHTS)
_CELLS = f"greatest(1, (SELECT count(*) + {mixing.CELL_ROWS - 1} FROM documents) // {mixing.CELL_ROWS})"
_CUT = "CASE WHEN {0} > 0 THEN greatest(1, round(({0}) / {1}))::BIGINT ELSE 0 END"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::BIGINT AS size,
      ('0x' || left(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')), 15))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
      FROM d GROUP BY source),
w AS (SELECT *, ({_W})[place % {len(_W)} + 1] AS weight, {mixing.CAP} * source_size AS most FROM s),
v AS (SELECT *, ((sum(source_size) OVER () - (sum(most) OVER r - most))::DOUBLE
      / (sum(weight) OVER () - (sum(weight) OVER r - weight))::DOUBLE) AS level FROM w
      WINDOW r AS (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING)),
u AS (SELECT level AS water FROM v WHERE level * weight <= most ORDER BY most / weight, place LIMIT 1),
t AS (SELECT *, least(most::DOUBLE, weight * water) AS target FROM v, u),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least({mixing.CAP}, floor(target / source_size)) END::BIGINT AS passes FROM t),
q AS (SELECT *, CASE WHEN passes < {mixing.CAP} THEN round(target - passes * source_size) ELSE 0 END::BIGINT AS rest FROM p),
b AS (SELECT *, {_CUT.format("rest", mixing.BLOCK_WORDS)} AS near, {_CUT.format("source_size - rest", mixing.BLOCK_WORDS)} AS far FROM q),
l AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY draw % {_CELLS}, draw, doc_id, size ROWS UNBOUNDED PRECEDING)
      AS upto FROM d),
m AS (SELECT l.*, b.* EXCLUDE (source), (2 * upto - size)::BIGINT AS middle FROM l JOIN b ON l.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * (passes + (middle < 2 * rest)::BIGINT))::BIGINT AS taken FROM m
"""  # noqa: S608


def _crc_table() -> list[int]:
    """The checksum of each byte: eight steps of division by the polynomial 0xEDB88320."""

    def step(value: int) -> int:
        return value >> 1 ^ (0xEDB88320 if value & 1 else 0)

    out = []
    for value in range(256):
        for _ in range(8):
            value = step(value)
        out.append(value)
    return out


_B = importance.BUCKETS
_BYTES = "list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)"
_RUN = "list_reduce({0}, lambda c, b: xor(c >> 8, ({1})[((xor(c, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT)"
OP12_SQL = f"""
WITH a AS (SELECT doc_id AS id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
w AS (SELECT id, side, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM a),
g AS (SELECT id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
each AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
crc AS (SELECT f, (xor({_RUN.format(_BYTES, str(_crc_table()) + "::UBIGINT[]")}, 4294967295::UBIGINT) % {_B})::BIGINT AS bucket FROM each),
n AS (SELECT id, side, bucket FROM g JOIN crc USING (f)),
c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM n GROUP BY bucket),
z AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM c),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (ss + {_B})) / ((s + 1)::DOUBLE * (tt + {_B}))))::BIGINT AS gain FROM c, z),
d AS (SELECT id, count(*) AS n, sum(gain) AS total FROM n JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
o AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features,
      coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
      ('0x' || left(sha256('{importance.SEED}:' || doc_id), 8))::UBIGINT::DOUBLE AS h
      FROM documents LEFT JOIN d ON doc_id = id),
r AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score,
      n_features >= {2 * importance.LEAST_WORDS - 1} AS able FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place,
      {importance.PERCENT} * (sum(able::INT) OVER ()) // 100 AS drawn FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END::BIGINT AS rank FROM k
"""  # noqa: S608

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term
      FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, c GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term
      FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {lexical_rank.KEPT}
"""  # noqa: S608

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_mix_sources": op11_mix_sources,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_lexical_rank": op13_lexical_rank,
}
SQL = {
    "op1_decontaminate": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op11_mix_sources": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_lexical_rank": OP13_SQL,
}
