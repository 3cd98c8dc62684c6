import json

import pytest
from pyspark.sql import functions as F

from regidx.fixed import NOT_INFORMED
from regidx.operators.enrich import row_cap
from regidx.operators.keyed import dedupe_chunks
from regidx.plans.chunks import build_chunks, count_duplicates, registry_to_chunks
from regidx.plans.registry import load_companies, load_listed, load_participants, loaders, run_sources
from regidx.sources.chunk_files import load_chunks, save_chunks
from fixtures_registry import STATES, key, root, write_landing


@pytest.fixture
def landing(tmp_path):
    return write_landing(tmp_path)


@pytest.fixture
def landing_with_offices(tmp_path):
    return write_landing(tmp_path, offices=True)


def by_key(df, key="cnpj"):
    return {row[key]: row for row in df.collect()}


def test_companies_from_latin1_zip(spark, landing):
    rows = by_key(load_companies(spark, landing, 100))
    assert set(rows) == {key(1), key(2)}
    mill = rows[key(1)]
    assert (mill.razao_social, mill.capital_social_num, mill.uf) == ("Moinho Aurora Ltda", 1500.25, NOT_INFORMED)
    assert rows[key(2)].porte_cod == "03"


def test_listed(spark, landing):
    rows = by_key(load_listed(spark, landing))
    assert set(rows) == {key(1), key(5)}
    assert {row.uf for row in rows.values()} == set(STATES[:2])
    assert rows[key(1)].situacao_desc == "Ativa"


def test_participants(spark, landing):
    rows = by_key(load_participants(spark, landing))
    assert set(rows) == {key(5), key(6)}
    yard = rows[key(5)]
    assert (yard.uf, yard.municipio, yard.segmento, yard.porte_desc, yard.porte_cod, yard.authorisation_servers) == (
        NOT_INFORMED, "Recife", "Medium", "Instituicao financeira", "", 3)


@pytest.mark.parametrize("payload, rows", [
    ({"data": [{"OrganisationName": "A", "RegistrationNumber": 191}]}, 1),
    ({"data": [], "participants": [{"LegalEntityName": "B", "RegistrationNumber": "1"}, 5, "x", None]}, 1),
    ({"other": 1}, 0), ({"data": {"a": 1}}, 0), ("text", 0), ([], 0),
])
def test_participant_envelopes(spark, tmp_path, payload, rows):
    (tmp_path / "open_finance_participants.json").write_text(json.dumps(payload))
    assert load_participants(spark, str(tmp_path)).count() == rows


def test_missing_sources_are_empty(spark, tmp_path):
    for load in (load_companies, load_listed, load_participants):
        assert load(spark, str(tmp_path)).isEmpty()


def test_offices_fill_state_activity_and_status(spark, landing_with_offices):
    rows = by_key(load_companies(spark, landing_with_offices, 100), "cnpj_basico")
    assert set(rows) == {root(1)}  # the other company has offices, but no head office among them
    first = rows[root(1)]
    assert (first.uf, first.cnae_fiscal_principal, first.situacao_desc) == (STATES[0], "1062700", "Ativa")


def test_all_sources(spark, landing):
    chunks, run = build_chunks(spark, landing, 100)
    rows = chunks.collect()
    counts = {}
    for row in rows:
        counts[row.metadata.source] = counts.get(row.metadata.source, 0) + 1
        assert len(row.cnpj) == 14 and row.embed_text != row.text and row.text.startswith("Empresa:")
    assert counts == {"receita_federal": 2, "cvm": 2, "bacen": 2}
    assert run.rows_read() == counts and not run.failures
    yard = next(row for row in rows if row.metadata.source == "bacen" and row.cnpj == key(5))
    assert yard.metadata.municipio == "Recife" and yard.metadata.segmento == "Medium" and "segmento Medium" in yard.text
    assert yard.embed_text == ("Estaleiro Pagamentos Ltda - Instituicao participante do Open Finance Brasil - "
                               "segmento Medium, segmento Medium, Instituicao financeira, Recife, Active")


def test_caps(spark, landing):
    assert [row_cap(v) for v in (None, 0, -1, 1, 20000)] == [None, None, None, 1, 20000]
    assert build_chunks(spark, landing, 1)[0].count() == 4
    assert build_chunks(spark, landing, 0)[0].count() == 6


def test_state_reaches_the_text(spark, landing_with_offices):
    rows = build_chunks(spark, landing_with_offices, 100, ["receita_federal"])[0].collect()
    assert {row.metadata.uf for row in rows} == {STATES[0]}
    assert any(f"UF: {STATES[0]}" in row.text for row in rows)


def test_source_subset(spark, landing):
    rows = build_chunks(spark, landing, None, ["cvm", "bacen"])[0]
    assert {row.s for row in rows.select(F.col("metadata.source").alias("s")).collect()} == {"cvm", "bacen"}


def test_failing_source_is_skipped(spark, landing):
    builders = loaders(spark, landing)

    def broken():
        raise ValueError("bad file")

    run = run_sources({**builders, "cvm": broken})
    assert set(run.frames) == {"receita_federal", "bacen"} and run.failures == {"cvm": "bad file"}


def test_files_that_cannot_be_read_cost_their_own_data_alone(spark, landing_with_offices):
    import pathlib

    for path in pathlib.Path(landing_with_offices).rglob("*"):
        if "stabele" in path.name.lower():
            path.write_bytes(b"no archive at all, whatever its name says")
        elif path.suffix == ".json":
            path.write_text("{nao e json")
    rows, run = build_chunks(spark, landing_with_offices)
    assert {row.s for row in rows.select(F.col("metadata.source").alias("s")).collect()} == {"receita_federal", "cvm"}
    assert set(run.failures) == {"establishments", "bacen"}


def test_dedupe_is_idempotent_and_prefers_early_sources(spark, landing):
    chunks, _ = build_chunks(spark, landing)
    doubled, before, after = count_duplicates(chunks.unionByName(chunks))
    assert sorted(doubled.collect()) == sorted(chunks.collect())
    assert (before.get["rows"], after.get["rows"]) == (12, 6)
    one = chunks.limit(1)
    late = one.withColumn("metadata", F.col("metadata").withField("source", F.lit("bacen")))
    early = one.withColumn("metadata", F.col("metadata").withField("source", F.lit("cvm")))
    assert dedupe_chunks(late.union(early)).first().metadata.source == "cvm"


def test_optional_zero_becomes_sentinel(spark):
    row = [("1" * 14, "Acme", "0", "", None)]
    df = spark.createDataFrame(row, "cnpj string, razao_social string, municipio string, segmento string, uf string")
    chunk = registry_to_chunks(df).first()
    assert chunk.metadata.municipio == NOT_INFORMED and chunk.metadata.segmento is None
    assert chunk.metadata.source == "desconhecida" and chunk.text.endswith("UF: NAO INFORMADO. Capital: R$ 0,00")


def test_chunk_files_round_trip(spark, landing, tmp_path):
    chunks, _ = build_chunks(spark, landing)
    path = save_chunks(chunks, str(tmp_path / "chunks"))
    assert sorted(load_chunks(spark, path).collect()) == sorted(chunks.collect())
    lines = [json.loads(line) for part in (tmp_path / "chunks").glob("part-*") for line in part.open()]
    assert len(lines) == 6 and set(lines[0]) == {"cnpj", "text", "metadata", "embed_text"}
    assert load_chunks(spark, str(tmp_path / "absent")).isEmpty()


def test_chunk_file_defaults(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"cnpj": "1", "text": "t"}\n\n{"cnpj": "2", "text": "u", "embed_text": ""}\n')
    rows = by_key(load_chunks(spark, str(tmp_path / "c.jsonl")))
    assert rows["1"].embed_text == "t" and rows["2"].embed_text == "u" and rows["1"].metadata is not None
