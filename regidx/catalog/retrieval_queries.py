"""Queries on vectors, trigrams, hybrid search, cells and prompts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regidx.catalog import standins as S
from regidx.catalog.registry_queries import COMPANIES_SQL
from regidx.catalog.sqltext import amount, grams, head_office_key, masked, word_similarity_ctes
from regidx.fixed import NO_CONTEXT_ANSWER, SYSTEM_PROMPT
from regidx.functions.keys import key_mask, with_company_key
from regidx.functions.trigrams import similarity, trigram_set, word_similarity
from regidx.operators.cells import assign_cells, cell_statistics, read_cells, refresh_statistics, train_centroids, write_cells
from regidx.operators.embedding import add_embedding
from regidx.plans.prompts import contexts, prompt_rows
from regidx.plans.search import cell_hits, flat_hits, hybrid_hits, recall_by_probes, search
from regidx.session import scratch_path, through_storage

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


# --- cosine -----------------------------------------------------------------------
def centroid_sql(relation: str, group: str, out: str) -> str:
    return f"""
    {out}_d AS (SELECT {group}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM {relation}),
    {out}_m AS (SELECT {group}, p, avg(CAST(x AS DOUBLE)) AS x FROM {out}_d GROUP BY ALL),
    {out} AS (SELECT {group}, list(x ORDER BY p) AS v FROM {out}_m GROUP BY {group})"""


COSINE_SQL = f"""WITH {centroid_sql('embeddings', 'label', 'q')},
    pairs AS (SELECT CAST(q.label AS VARCHAR) AS query_id, lpad(CAST(vec_id AS VARCHAR), 14, '0') AS cnpj,
                     e.label AS label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score,
                     md5(CAST(vec_id AS VARCHAR)) AS chunk_id
              FROM embeddings e JOIN q ON true)"""


def _cosine_sql(where: str, after: str = "true", k: int = 10) -> str:
    return f"""{COSINE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY score DESC, cnpj, chunk_id) AS rank FROM pairs WHERE {where})
        SELECT query_id, rank, cnpj, round(score, 4) AS score, round(score, 4) AS vector_score
        FROM ranked WHERE rank <= {k} AND {after}"""


def _cosine_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "cnpj", "score", "vector_score")


@query("cosine_topk_exact", _cosine_sql("true"))
def cosine_topk_exact(spark, folder) -> DataFrame:
    queries = S.label_queries(spark, folder).select("query_id", "text", "embedding", *_no_filters())
    return _cosine_columns(hybrid_hits(S.embedding_index(spark, folder), queries, 10))


def _no_filters():
    return [F.lit(None).cast("string").alias(name) for name in ("uf", "porte", "source")]


@query("cosine_topk_filtered", _cosine_sql("query_id = CAST(label AS VARCHAR)"))
def cosine_topk_filtered(spark, folder) -> DataFrame:
    """State, size and source filters taken from each query."""
    return _cosine_columns(hybrid_hits(S.embedding_index(spark, folder), S.label_queries(spark, folder), 10))


@query("min_score_after_limit", _cosine_sql("true", "score >= 0.1", 50))
def min_score_after_limit(spark, folder) -> DataFrame:
    queries = S.label_queries(spark, folder).select("query_id", "text", "embedding", *_no_filters())
    return _cosine_columns(hybrid_hits(S.embedding_index(spark, folder), queries, 50, min_score=0.1))


@query("ivf_full_probe_equals_exact", _cosine_sql("true"))
def ivf_full_probe_equals_exact(spark, folder) -> DataFrame:
    index = S.embedding_index(spark, folder)
    centroids = train_centroids(index, 8)
    queries = S.label_queries(spark, folder).select("query_id", "text", "embedding", *_no_filters())
    return _cosine_columns(_cell_hits(spark, index, centroids, queries, 8))


def _cell_hits(spark, index: DataFrame, centroids, queries: DataFrame, probes: int) -> DataFrame:
    """Search in a stored copy by cells, with its statistics."""
    path = write_cells(index, centroids, scratch_path(spark, "cells"))
    statistics = refresh_statistics(spark, path, centroids)
    return cell_hits(read_cells(spark, path), statistics, queries, centroids, probes, 10)


CELL_SQL = f"""WITH {centroid_sql('embeddings', 'label', 'c')},
    near AS (SELECT vec_id, c.label AS cell, row_number() OVER (PARTITION BY vec_id
                 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, c.label) AS place
             FROM embeddings JOIN c ON true)"""


@query(
    "ivf_topk",
    f"""{CELL_SQL},
    pairs AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, lpad(CAST(e.vec_id AS VARCHAR), 14, '0') AS cnpj,
                     list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
              FROM embeddings q JOIN near p ON p.vec_id = q.vec_id AND p.place <= 3
              JOIN near h ON h.cell = p.cell AND h.place = 1 JOIN embeddings e ON e.vec_id = h.vec_id
              WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cnpj) AS rank, cnpj,
           round(score, 4) AS score, round(score, 4) AS vector_score FROM pairs
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cnpj) <= 10""",
)
def ivf_topk(spark, folder) -> DataFrame:
    """Three of ten given cells probed for each hundredth vector."""
    index, centroids = S.embedding_index(spark, folder), _label_centroids(spark, folder)
    return _cosine_columns(_cell_hits(spark, index, centroids, _hundredth_vectors(spark, folder), 3))


def _label_centroids(spark, folder) -> np.ndarray:
    """The means of the ten labels as cells 0 to 9."""
    means = S.centroids(S.table(spark, folder, "embeddings"), "label").orderBy("label").collect()
    centroids = np.array([row["embedding"] for row in means])
    return centroids / np.linalg.norm(centroids, axis=1, keepdims=True)


def _hundredth_vectors(spark, folder) -> DataFrame:
    asked = S.table(spark, folder, "embeddings").where("vec_id % 100 = 0")
    return asked.select(F.col("vec_id").cast("string").alias("query_id"), F.lit("").alias("text"), "embedding", *_no_filters())


@query(
    "ivf_recall",
    f"""{CELL_SQL},
    pairs AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
                  list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank
              FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0),
    needed AS (SELECT p.place FROM pairs JOIN near h ON h.vec_id = pairs.vec_id AND h.place = 1
               JOIN near p ON p.vec_id = query_id AND p.cell = h.cell WHERE rank <= 10)
    SELECT probes::INT AS probes, round((SELECT count(*) FROM needed WHERE place <= probes) / (SELECT count(*) FROM needed), 6)
        AS recall FROM range(1, 1 + (SELECT count(DISTINCT label) FROM embeddings)) r(probes)""",
)
def ivf_recall(spark, folder) -> DataFrame:
    """Recall of each number of probes, measured against the exact search."""
    cells = through_storage(assign_cells(S.embedding_index(spark, folder), centroids := _label_centroids(spark, folder)), "cells")
    found = recall_by_probes(cells, _hundredth_vectors(spark, folder), centroids)
    return found.select("probes", F.round("recall", 6).alias("recall"))


@query(
    "cell_statistics",
    f"""{CELL_SQL} SELECT (row_number() OVER (ORDER BY cell) - 1)::INT AS cell, count(*) AS "rows",
        round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)), 4) AS mean_cosine,
        round(min(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)), 4) AS least_cosine
        FROM near JOIN embeddings USING (vec_id) JOIN c ON c.label = cell WHERE place = 1 GROUP BY cell""",
)
def cell_statistics_query(spark, folder) -> DataFrame:
    index, centroids = S.embedding_index(spark, folder), _label_centroids(spark, folder)
    found = cell_statistics(assign_cells(index, centroids), centroids)
    return found.select("cell", "rows", *[F.round(name, 4).alias(name) for name in ("mean_cosine", "least_cosine")])


# --- trigrams ------------------------------------------------------------------------
TURNS_SQL = """SELECT a.conv_id * 1000 + a.turn AS pid, a.text AS q, b.text AS t
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def following_turns(spark, folder) -> DataFrame:
    """Each turn with the one that follows it."""
    turns = S.table(spark, folder, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return turns.join(after, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pid"), F.col("text").alias("q"), "t"
    )


@query(
    "trigram_similarity",
    f"""WITH pairs AS ({TURNS_SQL}), g AS (SELECT pid, list_distinct({grams('q')}) AS a, list_distinct({grams('t')}) AS b
        FROM pairs)
        SELECT pid, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g""",
)
def trigram_similarity(spark, folder) -> DataFrame:
    sets = following_turns(spark, folder).select(
        "pid", trigram_set(F.col("q")).alias("a"), trigram_set(F.col("t")).alias("b")
    )
    return sets.select("pid", F.round(similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(
    "word_similarity",
    f"""WITH pairs AS ({TURNS_SQL}), {word_similarity_ctes('pairs', 'w')}
        SELECT pid, round(ws, 6) AS word_similarity FROM w""",
)
def word_similarity_query(spark, folder) -> DataFrame:
    return following_turns(spark, folder).select(
        "pid", F.round(word_similarity("q", "t"), 6).alias("word_similarity")
    )


# --- hybrid ----------------------------------------------------------------------------
HYBRID_SQL = f"""WITH {COMPANIES_SQL},
    shown AS (SELECT *, CASE WHEN porte_desc = 'Nao informado' THEN 'NAO INFORMADO' ELSE porte_desc END AS size
              FROM companies),
    idx AS (SELECT cnpj, razao_social AS name, size, embedding,
        'Empresa: ' || razao_social || '. CNPJ: ' || cnpj || '. Situacao: NAO INFORMADO. CNAE: NAO INFORMADO. Porte: '
        || size || '. UF: NAO INFORMADO. Capital: R$ ' || {amount('capital_social_num')} AS text
        FROM shown JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)),
    {centroid_sql('idx', 'size', 'c')},
    asked AS (SELECT c.size AS query_id, v, (SELECT min(name) FROM idx i WHERE i.size = c.size) AS term FROM c),
    both_sides AS (SELECT query_id, cnpj, name, text, term, idx.size,
                          list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS vs FROM idx JOIN asked ON true
                   WHERE __WHERE__),
    np AS (SELECT query_id || cnpj AS pid, term AS q, name AS t FROM both_sides),
    tp AS (SELECT query_id || cnpj AS pid, term AS q, text AS t FROM both_sides),
    {word_similarity_ctes('np', 'n')}, {word_similarity_ctes('tp', 'x')},
    scored AS (SELECT b.*, n.ws AS ns, x.ws AS ts, starts_with(lower(name), lower(term))::INT AS hit,
                      vs + 0.4 * n.ws + 0.6 * x.ws + 0.4 * starts_with(lower(name), lower(term))::INT AS score
               FROM both_sides b JOIN n ON n.pid = query_id || cnpj JOIN x ON x.pid = query_id || cnpj),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cnpj, md5(cnpj || text)) AS rank
               FROM scored)"""


def _hybrid_sql(where: str, tail: str) -> str:
    return HYBRID_SQL.replace("__WHERE__", where) + tail


HIT_SQL = """ SELECT query_id, rank, cnpj, name AS razao_social, round(score, 4) AS score, round(vs, 4) AS vector_score,
    round(ns, 4) AS name_score, round(ts, 4) AS text_score, hit AS prefix_hit, 'semantico' AS match_type
    FROM ranked WHERE rank <= 10"""


def _hit_columns(hits: DataFrame) -> DataFrame:
    return flat_hits(hits).select(
        "query_id", "rank", "cnpj", "razao_social", "score", "vector_score", "name_score", "text_score", "prefix_hit",
        "match_type",
    )


def _stored_vectors(spark, folder) -> DataFrame:
    """The index as it is used: a stored table."""
    return through_storage(S.company_vectors(spark, folder), "vectors")


@query("hybrid_topk", _hybrid_sql("true", HIT_SQL))
def hybrid_topk(spark, folder) -> DataFrame:
    index = _stored_vectors(spark, folder)
    queries = S.size_queries(index).withColumn("porte", F.lit(None).cast("string"))
    return _hit_columns(hybrid_hits(index, queries, 10))


@query("hybrid_filtered", _hybrid_sql("query_id = idx.size", HIT_SQL))
def hybrid_filtered(spark, folder) -> DataFrame:
    """Each query keeps to companies of its own size."""
    index = _stored_vectors(spark, folder)
    return _hit_columns(hybrid_hits(index, S.size_queries(index), 10))


ROUTED_SQL = (
    HYBRID_SQL[: HYBRID_SQL.index("asked AS (")]
    + f"""
    asks AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS query_id, s_suppkey % 8 AS kind,
             {head_office_key("lpad(CAST(s_suppkey AS VARCHAR), 8, '0')")} AS known,
             {head_office_key("CAST(99000000 + s_suppkey AS VARCHAR)")} AS unknown FROM supplier),
    texts AS (SELECT query_id, kind, known, i.size, i.embedding AS v, CASE
                 WHEN kind = 1 THEN 'quem e ' || {masked("unknown")} || '?' WHEN kind = 2 THEN i.name END AS term
              FROM asks JOIN idx i ON i.cnpj = known),
    exact AS (SELECT query_id, 1 AS rank, cnpj, name AS razao_social, 1.0 AS score, 0.0 AS vector_score, 0.0 AS name_score,
                     0.0 AS text_score, 0 AS prefix_hit, 'cnpj_exato' AS match_type
              FROM texts JOIN idx ON cnpj = known WHERE kind NOT IN (1, 2, 3, 7)),
    asked AS (SELECT query_id, CAST(v AS DOUBLE[]) AS v, term, size AS own FROM texts WHERE term IS NOT NULL),"""
    + HYBRID_SQL[HYBRID_SQL.index("both_sides AS (") :].replace("__WHERE__", "own = idx.size")
)


@query("search_routed", f"{ROUTED_SQL} SELECT * FROM exact UNION ALL ({HIT_SQL.replace('<= 10', '<= 5')})")
def search_routed(spark, folder) -> DataFrame:
    """The whole search for one table of questions: masked and bare keys, unknown keys, names and blanks."""
    index = _stored_vectors(spark, folder)
    suppliers = S.table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") % 8).alias("kind"))
    keyed = with_company_key(suppliers.withColumn("root", F.lpad(F.col("s_suppkey").cast("string"), 8, "0")), "root", "known")
    keyed = with_company_key(keyed.withColumn("root", (F.col("s_suppkey") + 99000000).cast("string")), "root", "unknown")
    own = index.select(F.col("cnpj").alias("known"), F.col("metadata.razao_social").alias("name"), "size", "embedding")
    kind = F.col("kind")
    text = (
        F.when(kind == 1, F.concat(F.lit("quem e "), key_mask(F.col("unknown")), F.lit("?")))
        .when(kind == 2, F.concat(F.lit("  "), "name", F.lit(" ")))
        .when(kind == 3, "   ")
        .when(kind == 7, F.lit(None))
        .when(kind == 4, F.concat(F.lit("cnpj "), "known"))
        .otherwise(F.concat(F.lit("quem e "), key_mask(F.col("known")), F.lit("?")))
    )
    queries = keyed.join(own, "known").select(
        F.col("s_suppkey").cast("string").alias("query_id"), text.alias("text"), F.col("size").alias("porte"), "embedding"
    )
    return _hit_columns(search(index, queries, 5))


@query("lexical_topk_documents")
def lexical_topk_documents(spark, folder) -> DataFrame:
    """Benchmark passages against whole documents by word similarity."""
    questions = S.table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), "text", *_no_filters()
    )
    # One small file is one split; long texts are worth spreading over all cores.
    documents = S.document_index(spark, folder).repartition(2 * spark.sparkContext.defaultParallelism)
    hits = hybrid_hits(documents, questions, 5)
    return hits.select("query_id", "rank", "cnpj", "score", "text_score")


@query(
    "embed_batch_unit_norm",
    "SELECT doc_id, 384 AS dimension, 1.0 AS norm FROM documents",
)
def embed_batch_unit_norm(spark, folder) -> DataFrame:
    rows = add_embedding(S.table(spark, folder, "documents").select("doc_id", "text"), "text")
    squared = F.aggregate(
        F.col("embedding"), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return rows.select("doc_id", F.size("embedding").alias("dimension"), F.round(F.sqrt(squared), 4).alias("norm"))


# --- prompts ---------------------------------------------------------------------------------
_BLOCK = "'[' || rank || '] ' || text || chr(10) || '    (fonte: receita_federal, similaridade: ' || printf('%.3f', round(score, 4)) || ')'"
_CONTEXT = f"string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank)"


def _prompt_hits(spark, folder):
    index = _stored_vectors(spark, folder)
    queries = S.size_queries(index)
    return queries, hybrid_hits(index, queries, 3)


@query(
    "prompt_context",
    _hybrid_sql(
        "query_id = idx.size",
        f""" SELECT query_id, count(*) AS n_documents, {_CONTEXT} AS context,
             string_agg(cnpj || ':' || printf('%.4f', round(score, 4)), ',' ORDER BY rank) AS cited
             FROM ranked WHERE rank <= 3 GROUP BY query_id""",
    ),
)
def prompt_context(spark, folder) -> DataFrame:
    _, hits = _prompt_hits(spark, folder)
    cited = F.transform(
        "sources", lambda s: F.concat(s["cnpj"], F.lit(":"), F.format_string("%.4f", s["score"]))
    )
    return contexts(hits).select(
        "query_id", F.col("n_documents").cast("long").alias("n_documents"), "context",
        F.array_join(cited, ",").alias("cited"),
    )


@query(
    "prompt_messages",
    _hybrid_sql(
        "query_id = idx.size",
        f""" SELECT query_id, '{SYSTEM_PROMPT}' AS system,
             'CONTEXTO RECUPERADO (' || count(*) || ' registros da base):' || chr(10) || {_CONTEXT}
             || chr(10) || chr(10) || 'PERGUNTA: ' || any_value(term) || chr(10) || chr(10) || 'RESPOSTA:' AS "user"
             FROM ranked WHERE rank <= 3 GROUP BY query_id""",
    ),
)
def prompt_messages(spark, folder) -> DataFrame:
    queries, hits = _prompt_hits(spark, folder)
    return prompt_rows(queries, hits).select(
        "query_id", F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("user")
    )


@query(
    "no_context_rows",
    f"""SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS query_id, '{NO_CONTEXT_ANSWER}' AS answer,
        'none' AS model_used, 0 AS n_sources FROM conversations WHERE role = 'user' AND trim(text) <> ''""",
)
def no_context_rows(spark, folder) -> DataFrame:
    """User turns asked against hits that belong to none of them."""
    turns = S.table(spark, folder, "conversations").filter(F.col("role") == "user")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    _, hits = _prompt_hits(spark, folder)
    rows = prompt_rows(asked, hits)
    return rows.filter(F.col("answer").isNotNull()).select(
        "query_id", "answer", "model_used", F.size("sources").alias("n_sources")
    )
