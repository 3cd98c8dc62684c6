"""Index table invariants and search against a plain full evaluation."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regidx.functions.trigrams import batch_trigrams
from regidx.operators.cells import probe_cells, train_centroids, write_cells
from regidx.operators.embedding import add_embedding
from regidx.plans.chunks import registry_to_chunks
from regidx.plans.index_table import IndexTable, index_rows
from regidx.plans.listing import company_items, company_page, index_page, company_page_after, latest_companies
from regidx.plans.prompts import build_prompts, prompt_rows
from regidx.operators import hybrid
from regidx.operators.query_blocks import store_queries, stream_queries
from regidx.plans import search as search_plan
from regidx.plans.search import flat_hits, hybrid_hits, search, usable_queries
from regidx.plans.statistics import stats_record
from regidx.streaming.ingest import chunk_stream, keep_index_current
from test_trigrams import all_stretches

WORDS = ["Banco", "Nu", "Pagamentos", "Itau", "Unibanco", "Credito", "Digital", "Padaria", "Ze", "Norte", "Sul"]
FIRST, LATER = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 2)


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    rows = [
        (f"{i % 90:014d}", " ".join(rng.sample(WORDS, rng.randint(1, 4))), rng.choice(["SP", "RS", "DF"]),
         rng.choice(["01", "03", "05"]), float(rng.randint(0, 9999)), rng.choice(["cvm", "bacen", "receita_federal"]))
        for i in range(120)
    ]
    registry = spark.createDataFrame(
        rows, "cnpj string, razao_social string, uf string, porte_cod string, capital_social_num double, source string")
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or '/tmp'}/regidx-test-{rng.random()}"
    add_embedding(registry_to_chunks(registry), "embed_text").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, chunks):
    return index_rows(chunks, 4, FIRST)


def test_upsert_twice_is_once(spark, chunks, tmp_path):
    table = IndexTable(spark, str(tmp_path / "t"), 4).create()
    assert table.read().isEmpty()
    keys = chunks.select("cnpj", "text").distinct().count()
    assert table.upsert(chunks, FIRST) == chunks.count()
    once = table.read().orderBy("chunk_id").collect()
    assert len(once) == keys
    changed = chunks.withColumn("metadata", F.col("metadata").withField("municipio", F.lit("X")))
    table.upsert(changed, LATER)
    twice = table.read().collect()
    assert len(twice) == keys
    assert {row.created_at for row in twice} == {FIRST} and {row.metadata.municipio for row in twice} == {"X"}
    moved = chunks.withColumn("metadata", F.col("metadata").withField("source", F.lit("cvm")))
    table.upsert(moved, LATER)
    assert {(row.source, row.metadata.source) for row in table.read().collect()} == {("cvm", "cvm")}
    assert table.read().count() == keys
    key = twice[0].cnpj
    assert {row.cnpj for row in table.lookup(key[:8] + "-" + key[8:]).collect()} == {key}


def test_replace_delete_truncate(spark, chunks, tmp_path):
    table = IndexTable(spark, str(tmp_path / "t"), 4).create()
    table.upsert(chunks)
    sizes = {row.source: row["count"] for row in table.read().groupBy("source").count().collect()}
    half = chunks.filter("metadata.source = 'cvm' AND metadata.uf = 'SP'")
    table.replace_sources(half, ["cvm"])
    now = {row.source: row["count"] for row in table.read().groupBy("source").count().collect()}
    assert now == {**sizes, "cvm": half.select("cnpj", "text").distinct().count()}
    # Rows out of the same table, and a source without new rows.
    own = table.read().filter("source = 'cvm'").selectExpr("cnpj", "text_chunk AS text", "metadata", "embedding")
    assert table.replace_sources(own, ["cvm", "bacen"]) == now["cvm"]
    assert {row.source: row["count"] for row in table.read().groupBy("source").count().collect()} == now
    assert table.delete_source("bacen") == sizes["bacen"]
    assert table.read().filter("source = 'bacen'").isEmpty()
    table.truncate()
    assert table.read().isEmpty()


def grams(text):
    return batch_trigrams([text])[0].tolist()


def full_evaluation(rows, text, vector, k, **filters):
    scored = []
    for row in rows:
        meta = row.metadata
        if any(value and meta[name] != value for name, value in filters.items()):
            continue
        v = np.array(row.embedding, dtype=np.float64)
        cosine = float(v @ vector / np.linalg.norm(v) / np.linalg.norm(vector))
        name, body = (all_stretches(set(grams(text)), grams(target)) for target in (meta.razao_social, row.text_chunk))
        hit = int(meta.razao_social.lower().startswith(text.lower()))
        score = cosine + (0.4 * name + 0.6 * body + 0.4 * hit if text.strip() else 0)
        scored.append((-score, row.cnpj, row.chunk_id))
    return [(cnpj, chunk, round(-score, 4)) for score, cnpj, chunk in sorted(scored)[:k]]


QUERIES = [("a", "Nu Pagamentos", None, None), ("b", "itau", "SP", None), ("c", "padaria do ze", None, "cvm"),
           ("d", "credito norte sul", "rs", "bacen")]


def asked(spark):
    df = spark.createDataFrame(QUERIES, "query_id string, text string, uf string, source string")
    return add_embedding(df.withColumn("porte", F.lit(None).cast("string")), "text")


@pytest.mark.parametrize("spread", [1, 3])
def test_hybrid_equals_full_evaluation(spark, index, spread):
    rows = index.collect()
    queries = asked(spark)
    hits = hybrid_hits(index.repartition(5), queries, 7, spread=spread).orderBy("query_id", "rank").collect()
    for query in queries.collect():
        expected = full_evaluation(rows, query.text, np.array(query.embedding, dtype=np.float64), 7,
                                   uf=query.uf.upper() if query.uf else None, source=query.source)
        got = [(hit.cnpj, hit.chunk_id, hit.score) for hit in hits if hit.query_id == query.query_id]
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert np.allclose([g[2] for g in got], [e[2] for e in expected], atol=1.1e-4)


def test_queries_are_streamed_from_storage_in_bounded_blocks(spark):
    queries = usable_queries(asked(spark).unionByName(asked(spark).withColumn("embedding", F.lit(None).cast("array<float>"))))
    path = store_queries(queries, 3)
    blocks = list(stream_queries(path, 2))
    assert all(0 < len(block) <= 2 for block in blocks)
    assert sorted(q.query_id for block in blocks for q in block) == sorted("abcd" * 2)
    assert sum(q.vector is None for block in blocks for q in block) == 4


def test_many_queries_take_one_pass_and_no_driver(spark, index, monkeypatch):
    """More blocks than a task keeps, small slices: the same hits, from one scan of the index."""
    rows = index.repartition(3)
    queries = asked(spark)
    few = {(hit.query_id, hit.rank): (hit.cnpj, hit.score) for hit in hybrid_hits(rows, queries, 4).collect()}
    many = queries.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn(
        "query_id", F.concat_ws("-", "query_id", "copy"))
    monkeypatch.setattr(hybrid, "KEPT_BLOCKS", 2)
    monkeypatch.setattr(hybrid, "SLICE_ROWS", 50)
    monkeypatch.setattr(hybrid, "ROWS_PER_STEP", 20)
    monkeypatch.setattr(search_plan, "QUERIES_PER_STEP", 7)
    hits = hybrid_hits(rows, many, 4)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan
    got = hits.collect()
    assert len(got) == 60 * len(few)
    assert all(few[hit.query_id.split("-")[0], hit.rank] == (hit.cnpj, hit.score) for hit in got)


def test_blank_text_is_pure_cosine_and_min_score_cuts_after_limit(spark, index):
    queries = asked(spark).withColumn("text", F.lit(" "))
    hits = hybrid_hits(index, queries, 5).collect()
    assert hits and all(hit.score == hit.vector_score and hit.prefix_hit == 0 for hit in hits)
    cut = hybrid_hits(index, queries, 5, min_score=0.2).collect()
    assert sorted(h.chunk_id + h.query_id for h in cut) == sorted(
        h.chunk_id + h.query_id for h in hits if h.vector_score >= 0.2)


def test_search_routes_keys(spark, index):
    key = index.first().cnpj
    mask = f"{key[:2]}.{key[2:5]}.{key[5:8]}/{key[8:12]}-{key[12:]}"
    queries = spark.createDataFrame(
        [("k", f"quem e {mask}?", "XX"), ("m", "99.999.999/9999-99 banco", None), ("s", "  ", None),
         ("h", "banco digital", None)], "query_id string, text string, uf string")
    for buckets in (None, 4):
        flat = flat_hits(search(index, queries, 3, buckets=buckets)).collect()
        by = {}
        for row in flat:
            by.setdefault(row.query_id, []).append(row)
        assert set(by) == {"k", "m", "h"}
        assert {(r.cnpj, r.score, r.match_type) for r in by["k"]} == {(key, 1.0, "cnpj_exato")}
        assert {r.match_type for r in by["m"] + by["h"]} == {"semantico"} and len(by["h"]) == 3
    with pytest.raises(ValueError):
        search(index, queries, 51)


def test_cells(spark, index, tmp_path):
    centroids = train_centroids(index, 6)
    path = write_cells(index, centroids, str(tmp_path / "cells"))
    stored = spark.read.parquet(path)
    assert stored.count() == index.count()
    queries = asked(spark)
    exact = sorted(hybrid_hits(index, queries, 5).collect())
    assert sorted(hybrid_hits(stored, probe_cells(queries, centroids, 6), 5).collect()) == exact
    probed = hybrid_hits(stored, probe_cells(queries, centroids, 2), 5).collect()
    assert 0 < len(probed) <= len(exact)


def test_listing(spark, index):
    newer = index.withColumn("created_at", F.lit(LATER)).withColumn("text_chunk", F.lit("new"))
    both = index.unionByName(newer)
    latest = latest_companies(both)
    assert latest.count() == index.select("cnpj").distinct().count()
    assert {row.text_chunk for row in latest.collect()} == {"new"}
    some = latest_companies(index, state="sp", size="01", name="ban_o%")
    for row in company_items(some).collect():
        assert row.uf == "SP" and row.porte_cod == "01" and "banco" in row.razao_social.lower()
    page = [row.cnpj for row in company_page(latest, 10, 10).collect()]
    assert page == [f"{i:014d}" for i in range(10, 20)]
    assert [row.cnpj for row in company_page_after(latest, page[0], 3).collect()] == page[1:4]
    direct = index_page(both, 10, 10)
    assert [(row.cnpj, row.text_chunk) for row in direct.collect()] == [(key, "new") for key in page]
    assert [r.cnpj for r in index_page(both, 3, 0, "sp", "01").collect()] == [
        r.cnpj for r in company_page(latest_companies(both, "sp", "01"), 3).collect()]
    plan = direct._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "TakeOrderedAndProject" in plan


def test_stats(spark, index):
    row = stats_record(index).first()
    expected = {r.source: r["count"] for r in index.groupBy("source").count().collect()}
    assert row.by_source == expected and row.sources == sorted(expected)
    assert row.total_embeddings == index.count() and row.total_companies == 90
    assert row.top_uf == {r.uf: r["count"] for r in index.groupBy("metadata.uf").count().collect()}
    assert row.last_ingestion == FIRST and row.embedding_dim == 384
    empty = stats_record(index.filter("false")).first()
    assert (empty.total_embeddings, empty.total_companies, empty.by_source, empty.last_ingestion) == (0, 0, {}, None)


def test_prompts(spark, index):
    queries = asked(spark).select("query_id", "text")
    hits = hybrid_hits(index, asked(spark).filter("query_id <> 'd'"), 2)
    rows = {row.query_id: row for row in prompt_rows(queries, hits).collect()}
    first = rows["a"]
    assert first.n_documents == 2 and [m.role for m in first.messages] == ["system", "user"]
    user = first.messages[1].content
    assert user.startswith("CONTEXTO RECUPERADO (2 registros da base):\n[1] Empresa:")
    assert "\n\n[2] Empresa:" in user and user.endswith("PERGUNTA: Nu Pagamentos\n\nRESPOSTA:")
    assert f"similaridade: {first.sources[0].score:.3f})" in user
    assert rows["d"].messages is None and rows["d"].model_used == "none" and rows["d"].sources == []


def test_build_prompts(spark, index):
    queries = spark.createDataFrame([("q", " banco digital ", "SP"), ("z", "", "SP")], "query_id string, text string, uf string")
    row, = build_prompts(index, queries, 2).collect()
    assert row.question == "banco digital" and row.n_documents == 2 and {s.uf for s in row.sources} == {"SP"}
    with pytest.raises(ValueError):
        build_prompts(index, queries, 21)


def test_stream_equals_batch(spark, chunks, tmp_path):
    plain = chunks.drop("embedding").select("cnpj", "text", "metadata", "embed_text")
    folder = str(tmp_path / "in")
    plain.repartition(3).write.json(folder)
    table = IndexTable(spark, str(tmp_path / "t"), 2).create()
    for run in ("one", "two"):
        keep_index_current(chunk_stream(spark, folder, 2), table, str(tmp_path / run)).awaitTermination()
        assert table.read().count() == plain.select("cnpj", "text").distinct().count()


@pytest.mark.parametrize("kept", [8, 0])
def test_only_rows_that_pass_a_blocks_filters_are_compared(monkeypatch, kept):
    rng = np.random.default_rng(4)
    rows = [(f"c{i:04d}", f"{i:014d}", f"nome {i % 37}", f"texto {i % 53} {i % 7}", rng.normal(size=4).tolist(), f"S{i % 9}") for i in range(6000)]
    names = ["chunk_id", "cnpj", "name", "text_chunk", "embedding", "uf"]
    columns = {name: [row[at] for row in rows] for at, name in enumerate(names)}
    columns |= {name: [None] * len(rows) for name in ("porte", "porte_cod", "source")}
    batch = pa.RecordBatch.from_pydict(columns)
    queries = [hybrid.Query(str(i), f"nome {i} texto", rng.normal(size=4), f"s{i % 9}") for i in range(18)]
    queries.sort(key=lambda query: query.state)
    compared, real = [], hybrid._score_allowed

    def counted(prepared, block, floors, allowed):
        compared.append(prepared.batch.num_rows * len(block.queries))
        return real(prepared, block, floors, allowed)

    def best(members):
        blocks = lambda: iter([members[at : at + 2] for at in range(0, len(members), 2)])
        found = [r for b in hybrid.score_batches(iter([batch]), blocks, hybrid.Weights(), 3, ["chunk_id", "cnpj"]) for r in b.to_pylist()]
        return {q.query_id: sorted((-r["score"], r["cnpj"]) for r in found if r["query_id"] == q.query_id)[:3] for q in members}

    monkeypatch.setattr(hybrid, "_score_allowed", counted)
    monkeypatch.setattr(hybrid, "KEPT_BLOCKS", kept)
    monkeypatch.setattr(hybrid, "SLICE_ROWS", 2048)
    got = best(queries)
    assert sum(compared) <= 6000 * len(queries) // 9 + 9 * len(queries)
    for query in queries:
        mine = batch.filter(pa.array([row[5] == query.state.upper() for row in rows]))
        plain = hybrid.Query(query.query_id, query.text, query.vector)
        whole = [r for b in hybrid.score_batches(iter([mine]), lambda: iter([[plain]]), hybrid.Weights(), mine.num_rows, ["chunk_id", "cnpj"]) for r in b.to_pylist()]  # noqa: B023
        assert sorted((-r["score"], r["cnpj"]) for r in whole)[:3] == got[query.query_id]
