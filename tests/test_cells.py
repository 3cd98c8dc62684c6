"""Search by cells against the exact search: salted cells, stale statistics, odd vectors, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regidx.catalog import standins
from regidx.operators.cells import assign_cells, read_cells, refresh_statistics, train_centroids, write_cells
from regidx.plans.search import cell_hits, choose_probes, hybrid_hits, recall_by_probes

FOLDER = "/root/testdata/sf0.001"


def made_index(spark, vectors):
    rows = [(i, None if v is None else [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    label = F.col("label").cast("string")
    return df.select(
        F.md5(F.col("vec_id").cast("string")).alias("chunk_id"), F.lpad(F.col("vec_id").cast("string"), 14, "0").alias("cnpj"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text_chunk"),
        standins.metadata(razao_social=F.concat(F.lit("name "), label), uf=F.concat(F.lit("L"), label), source=F.lit("cvm")).alias("metadata"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit("cvm").alias("source"), "embedding")


def asked(spark, vectors, uf=None, text=""):
    rows = [(str(i), text, None if v is None else [float(x) for x in v], uf) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "query_id string, text string, embedding array<double>, uf string")
    return df.withColumns({name: F.lit(None).cast("string") for name in ("porte", "source")})


def found(hits):
    return {(h.query_id, h["rank"]): (h.cnpj, h.score) for h in hits.collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A third of all vectors lies in one cell."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vectors = [centres[0 if i % 3 == 0 else i % 6] + 0.2 * rng.normal(size=8) for i in range(400)] + [None, np.zeros(8)]
    index = made_index(spark, vectors)
    centroids = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    path = write_cells(index, centroids, str(tmp_path_factory.mktemp("cells") / "copy"))
    return index, read_cells(spark, path), refresh_statistics(spark, path, centroids), centroids, vectors


@pytest.mark.parametrize("uf,text", [(None, ""), ("l1", ""), (None, "name 2")])
def test_all_cells_probed_equal_the_exact_search(spark, made, uf, text):
    index, cells, statistics, centroids, vectors = made
    queries = asked(spark, vectors[:25], uf, text)
    exact = found(hybrid_hits(index, queries, 7))
    for known in (statistics, None, statistics.where("cell > 2").withColumn("rows", F.lit(1))):
        hits = cell_hits(cells, known, queries, centroids, 6, 7, part_rows=40, block_queries=4)
        assert found(hits) == exact


def test_only_probed_cells_are_searched(spark, made):
    _, cells, statistics, centroids, vectors = made
    hits = found(cell_hits(cells, statistics, asked(spark, vectors[:10]), centroids, 2, 400, part_rows=30))
    unit = np.array([v / np.linalg.norm(v) for v in vectors[:400]])
    cell_of = np.argmax(unit @ centroids.T, axis=1)
    for number in range(10):
        near = set(np.argsort(-(centroids @ vectors[number]))[:2])
        wanted = {f"{i:014d}" for i in range(400) if cell_of[i] in near} | ({f"{i:014d}" for i in (400, 401)} if 0 in near else set())
        assert {cnpj for (query, _), (cnpj, _) in hits.items() if query == str(number)} == wanted


def test_statistics(spark, made):
    _, cells, statistics, centroids, vectors = made
    rows = {r.cell: r for r in statistics.collect()}
    assert sum(r.rows for r in rows.values()) == 402 and rows[0].rows > 130
    unit = np.array([v / np.linalg.norm(v) for v in vectors[:400]])
    best = (unit @ centroids.T).max(axis=1)
    assert np.isclose(min(r.least_cosine for r in rows.values()), best.min(), atol=1e-5)


def test_vectors_of_another_length_are_an_error(spark, made):
    wrong = made_index(spark, [np.ones(8), np.ones(5)])
    with pytest.raises(Exception, match="array|shape|reshape|dimension"):
        assign_cells(wrong, made[3]).collect()


def recall_of(index, hits, queries, k):
    exact = {(q, c) for (q, _), (c, _) in found(hybrid_hits(index, queries, k)).items()}
    return len(exact & {(q, c) for (q, _), (c, _) in found(hits).items()}) / len(exact)


def test_recall_at_three_probes_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    vectors = [centres[i % 30] + 0.5 * rng.normal(size=16) for i in range(1500)]
    index = made_index(spark, vectors)
    centroids = train_centroids(index, 12)
    path = write_cells(index, centroids, str(tmp_path / "cells"))
    queries = asked(spark, [c + 0.5 * rng.normal(size=16) for c in centres])
    statistics = refresh_statistics(spark, path, centroids)
    cells = read_cells(spark, path)
    recall = recall_of(index, cell_hits(cells, statistics, queries, centroids, 3, 10), queries, 10)
    measured = {r.probes: r.recall for r in recall_by_probes(cells, queries, centroids, 10).collect()}
    assert recall >= 0.9 and np.isclose(measured[3], recall) and measured[12] == 1.0


def test_probes_are_chosen_by_measured_recall_where_nothing_clusters(spark, tmp_path):
    """The test tables' vectors have no clusters: three probes of eight find some 0.7 of the true hits."""
    index = standins.embedding_index(spark, FOLDER)
    centroids = train_centroids(index, 8)
    cells = read_cells(spark, write_cells(index, centroids, str(tmp_path / "cells")))
    sample = asked(spark, [r.embedding for r in index.where("cnpj LIKE '%7'").select("embedding").collect()])
    probes = choose_probes(recall_by_probes(cells, sample, centroids), 0.9)
    queries = asked(spark, [r.embedding for r in index.where("cnpj LIKE '%3'").select("embedding").collect()])
    assert 3 < probes < 8 and recall_of(index, cell_hits(cells, None, queries, centroids, probes, 10), queries, 10) >= 0.88
