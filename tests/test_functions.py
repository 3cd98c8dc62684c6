"""Scalar goldens and a random comparison against plain-Python restatements."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from regidx.fixed import NOT_INFORMED, NULL_TOKENS
from regidx.functions import amounts, codes, keys, rendering, text, vectors


def x():
    return F.col("x")


def keys_of(spark, inputs, pad=True):
    df = spark.createDataFrame(list(enumerate(inputs)), "place int, x string")
    out = keys.with_company_key(df, "x", "k", pad).orderBy("place").collect()
    return [row.k for row in out]


def test_company_key_goldens(spark):
    inputs = ["00000000", "11111111", "18.236.120/0001-58", "18236120000158", "60.701.190/0001-04",
              None, "", "sem digitos"]
    assert keys_of(spark, inputs) == ["00000000000191", "11111111000191", "18236120000158",
                                      "18236120000158", "60701190000104", "", "", ""]
    assert keys_of(spark, ["123"], pad=False) == ["00000000000123"]


def plain_key(value, pad):
    digits = "".join(ch for ch in value or "" if ch in "0123456789")

    def check(number):
        for start in (5, 6):
            total, weight = 0, start
            for digit in number:
                total += int(digit) * weight
                weight = 9 if weight == 2 else weight - 1
            rest = total % 11
            number += str(0 if rest < 2 else 11 - rest)
        return number

    if not digits:
        return ""
    if len(digits) == 12:
        return check(digits)
    if len(digits) <= 8 and pad:
        return check(digits.rjust(8, "0") + "0001")
    return digits[:14].rjust(14, "0")


@pytest.mark.parametrize("pad", [True, False])
def test_company_key_random(spark, pad):
    rng = random.Random(3)
    inputs = ["".join(rng.choice("0123456789.-/ x") for _ in range(rng.randint(0, 22))) for _ in range(3000)]
    assert keys_of(spark, inputs, pad) == [plain_key(value, pad) for value in inputs]


def test_key_mask_and_lookup(values):
    assert values(keys.key_mask(x()), ["00000000000191", "191", None]) == [
        "00.000.000/0001-91", "00.000.000/0001-91", "00.000.000/0000-00"]
    assert values(keys.key_in_text(x()), [
        "quem e 18.236.120/0001-58?", "cnpj 18236120000158", "18 236 120 0001 58", "bancos", "123456"
    ]) == ["18236120000158", "18236120000158", "18236120000158", None, None]


def test_parse_amount(values):
    inputs = ["90000000000,00", "1.000.000,00", "10000", "1234.5", "", None, "texto invalido", "1.000.000",
              "-5,5", "R$ 10,00", "5-"]
    assert values(amounts.parse_amount(x()), inputs) == [9e10, 1e6, 1e4, 1234.5, 0, 0, 0, 0, -5.5, 10.0, 0]


def test_format_amount(values):
    inputs = [1234567.5, 0.0, 0.125, 2.675, 1e11, -1234.5]
    expected = [f"{v:,.2f}".translate(str.maketrans(",.", ".,")) for v in inputs]
    assert values(amounts.format_amount(x()), inputs, "double") == expected


def test_codes(values):
    assert values(codes.size_name(x()), ["01", "03", "05", "1", "", None, "99", "x"]) == [
        "Microempresa (ME)", "Empresa de Pequeno Porte (EPP)", "Demais (medio/grande porte)",
        "Microempresa (ME)", "Nao informado", "Nao informado", "99", "Nao informado"]
    assert values(codes.size_code(x()), ["5", "013", None]) == ["05", "01", "00"]
    assert values(codes.status_name(x()), ["02", "08", "ATIVO", "cancelada", "77", "", "Em Liquidacao"]) == [
        "Ativa", "Baixada", "Ativa", "Cancelada", "77", NOT_INFORMED, "Em Liquidacao"]


def test_clean_text_goldens(values):
    assert values(text.clean_text(x(), title=True), ["  BANCO   DO\x07 BRASIL  "]) == ["Banco Do Brasil"]
    assert values(text.clean_text(x()), [None, "", "nan", "-", " NaT ", "0", "N/A"]) == [NOT_INFORMED] * 7
    assert values(text.clean_text(x(), ""), ["", None]) == ["", ""]
    assert values(text.clean_text(x()), ["ASSOCIAÇÃO SÃO JOÃO"]) == ["ASSOCIAÇÃO SÃO JOÃO"]


def plain_clean(value, default, title):
    if value is None or value.strip().lower() in ("nan", "nat", "none"):
        return default
    out = "".join(ch for ch in unicodedata.normalize("NFKC", value) if not unicodedata.category(ch).startswith("C"))
    out = " ".join(re.split("[�\"'`^~\\s]+", out))
    out = out.strip(" .,;-")
    if out.lower() in NULL_TOKENS:
        return default
    if title and out.isupper():
        out = out.title()
    return out


@pytest.mark.parametrize("title", [True, False])
def test_clean_text_random_latin1(values, title):
    rng = random.Random(5)
    common = "ABCÇÃÉ abc.,;-'\"^~0ºª½¼µ\t\n"
    inputs = ["".join(rng.choice(common) if rng.random() < .7 else chr(rng.randrange(1, 256))
                      for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    inputs += ["S.A.", "EMPRESA S.A./B&C 3D", "ÀS ÓRFÃS", "0", "NÃO INFORMADO", "a' 'b"]
    got = values(text.clean_text(x(), "PADRAO", title), inputs)
    assert got == [plain_clean(value, "PADRAO", title) for value in inputs]


def test_clean_text_any_unicode(values):
    inputs = ["ﬁnance Ｂａｎｃｏ", "é", "漢字 ①", "﻿x�y", None]
    got = values(text.clean_text(x(), "", any_unicode=True), inputs)
    assert got == [plain_clean(value, "", False) for value in inputs]


def test_city_name(values):
    inputs = ["Sao Paulo, Sp", "Sao Paulo", "SAO PAULO, SP", "Porto Alegre, Rs", "", None, "x" * 80]
    assert values(text.city_name(x()), inputs) == [
        "Sao Paulo", "Sao Paulo", "Sao Paulo", "Porto Alegre", "", "", "X" + "x" * 59]


def test_embedding_input(values):
    assert values(text.embedding_input(x()), [None, "   ", "texto\x00sujo", " a "]) == [" ", " ", "texto sujo", "a"]


def test_embedding_text(spark):
    rows = [
        ("Nu Pagamentos S.A.", "Instituicao participante", "S1/S2", "Instituicao financeira", "Sao Paulo",
         NOT_INFORMED, "Active"),
        ("Acme Ltda", NOT_INFORMED, "", NOT_INFORMED, None, NOT_INFORMED, NOT_INFORMED),
        ("Acme", "Bancos", None, "bancos", " BANCOS ", "SP", "Ativa"),
        ("Acme", "", "", "", "sp", "SP", "Baixada"),
    ]
    df = spark.createDataFrame(rows, "n string, a string, g string, p string, m string, u string, s string")
    extras = rendering.embedding_extras(*[F.col(c) for c in ("a", "g", "p", "m", "u", "s")])
    got = [row.t for row in df.select(rendering.embedding_text(F.col("n"), extras).alias("t")).collect()]
    assert got == [
        "Nu Pagamentos S.A. - Instituicao participante, segmento S1/S2, Instituicao financeira, Sao Paulo, Active",
        "Acme Ltda", "Acme - Bancos, SP", "Acme - sp, Baixada"]


def test_display_text(spark):
    df = spark.range(1).select(rendering.display_text(
        *[F.lit(v) for v in ("Nu Pagamentos S.A.", "18236120000158", "Ativa", "Servicos", "Demais", "SP")],
        F.lit(1000.0)).alias("t"))
    assert df.first().t == ("Empresa: Nu Pagamentos S.A.. CNPJ: 18236120000158. Situacao: Ativa. CNAE: Servicos. "
                            "Porte: Demais. UF: SP. Capital: R$ 1.000,00")


def test_vector_functions(spark):
    df = spark.createDataFrame(
        [([0.1, -0.25, 3.0], [1.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0]),
         ([1e-5, 1234567.0, 12345678.0], [0.0, 1.0, 0.0]), ([0.00012345678, 99.99999, 1e10], [0.0, 0.0, 1.0]),
         ([2.0 ** -11, -3 * 2.0 ** -13, 2.0 ** 30], [0.0, 0.0, 1.0])],
        "a array<float>, b array<float>")
    out = df.select(vectors.vector_text(F.col("a")).alias("t"), "a",
                    vectors.cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()
    for row in out:
        assert row.t == "[" + ",".join(f"{v:.7g}" for v in row.a) + "]"
    assert out[0].t == "[0.1,-0.25,3]"
    assert out[1].c is None and abs(out[0].c - 0.1 / (0.01 + 0.0625 + 9) ** 0.5) < 1e-6
