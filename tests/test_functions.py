import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions import values as v


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r




@pytest.mark.parametrize(("text", "want"), [("45 0, 00", "450.00"), ("R$ 1.234,5", "1234.50"), ("1.234", "1234.00"), ("12.34", "12.34"), ("R$ 1.234.567,89", "1234567.89"), ("none", None), ("", None), ("-5,00", "-5.00"), (None, None), (",50", "0.50")])
def test_parse_money(spark, text, want):
    assert one(spark, lambda C: v.parse_money(C), text) == (want and Decimal(want))


@pytest.mark.parametrize(("text", "want"), [("31/02/2024", None), ("5 de marco de 2024", "2024-03-05"), ("5 de março de 2024", None), ("31 de abril de 2024", None), ("7/2/2024", "2024-02-07"), ("2024-02-07", "2024-02-07"), (" 07.02.2024 ", None), ("07/02/24", "2024-02-07"), ("14-2-26", "2026-02-14"), ("2026/02/14", None), ("soon", None), (None, None)])
def test_parse_date(spark, text, want):
    assert one(spark, lambda C: v.parse_date(C), text) == (want and datetime.date.fromisoformat(want))


@pytest.mark.parametrize(("text", "want"), [("30%", 30.0), ("0.3", 30.0), ("x", None)])
def test_parse_percent(spark, text, want):
    assert one(spark, lambda C: v.parse_percent(C), text) == want


def test_recency_shapes_and_hamming(spark):
    as_of = F.lit("2024-06-01").cast("date")
    assert [one(spark, lambda C: v.is_recent(C.cast("date"), as_of), d) for d in ("2024-06-02", "2024-06-03", "2019-06-01", "2019-05-31")] == [True, False, True, False]
    assert one(spark, lambda C: v.has_shape(F.lit("cpf"), C), "000.000.001-91") and not one(spark, lambda C: v.has_shape(F.lit("cpf"), C), "000.000.001")
    assert one(spark, lambda C: v.has_shape(F.lit("name"), C), "x") and not one(spark, lambda C: v.has_shape(F.lit("name"), C), " ")
    assert one(spark, lambda C: v.hamming(C, F.lit(-1).cast("long")), 0, "long") == 64
    assert one(spark, lambda C: v.clamp(C, 0, 1), 7.5, "double") == 1


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (t.normalize_whitespace, " a  \n b ", "a b"),
        (t.remove_diacritics, "ÁÉçñ ßó", "AEcn ßo"),
        (t.fix_missing_spaces, "a,b(c)d 12x aB", "a, b (c)) d 12 x a B"),
        (t.collapse_spaced_letters, "o d i r e t o r foi", "odiretor foi"),
        (t.fix_title_glue, "umaCasa abC", "uma Casa abC"),
        (t.normalize_for_match, "Órgão nº 5/A", "orgao n 5/a"),
        (t.normalize_for_similarity, "A1\tb22", "a# b##"),
        (t.anchor_text, "Ação: nº-7", "acao n 7"),
        (t.collapse_doubled, "AABBCC", "ABC"),
        (t.collapse_doubled, "AABBC", "AABBC"),
        (t.collapse_doubled, "abcdef", "abcdef"),
        (t.block_pattern, "ab c  d ef", "W11W"),
        (t.typed_pattern, "João 12 AB a@b.co x1 1.234,50 --", "T2N2U2EM2V2S"),
        (t.typed_pattern, "529.982.247-25 52998224725: R$ nº n° : de 14/2/26 1ª 2º 5 a", "F2F2:VR2R2SP2A2N2aN2oN1P1"),
        (t.typed_pattern, "12345678000195 0801234-56.2024.8.15.2001 x,5 McX É ç", "J2Q2V2M2U1L1"),
        (t.block_pattern, "a : b: cd", "1:WW"),
        (t.collapse_spaced_letters, "D I R E da CO MA RCA x\ny", "DIRE da COMARCAx y"),
        (t.fix_uppercase_split_tokens, "VA NOS RA", "VA NOS RA"),
        (t.fix_broken_words, "magis tra tura d o rei wor dThe", "magis tra turado reiword The"),
        (t.fix_broken_words, "trib un al ab cd", "tribunalabcd"),
        (t.fix_uppercase_word_splits, "COMA RCA DE ABCDE", "COMARCA DE ABCDE"),
        (t.fix_uppercase_prefix_splits, "CO MARCA DE LIMA", "COMARCA DE LIMA"),
        (t.digits, "a1-2", "12"),
        (t.compact, "É-a 1!", "ea1"),
        (t.process_number, "/x/12 ab-3.pdf", "123"),
        (t.process_number, "/x/ab.pdf", None),
        (t.strip_nul, "a\0b", "ab"),
        (t.fix_uppercase_split_tokens, "o DI RE TOR DE AB", "o DIRETOR DE AB"),
        (t.fix_uppercase_token_runs, "A B C x AB CD", "ABC x AB CD"),
        (t.fix_uppercase_token_runs, "AB CD EF GH i", "ABCDEFGH i"),
        (t.fix_uppercase_glue, "CONSELHODAMAGISTRATURA", "CONS E LHO DA MAGISTRATURA"),
        (t.fix_uppercase_glue, "Conselhodamagistratura", "Conselhodamagistratura"),
        (t.fix_line_break_splits, "magis-\n tratura e-mail", "magistratura e-mail"),
        (t.normalize_full_text, " d i r e t o r  foi,aqui ", "diretor foi, aqui"),
    ],
)
def test_text(spark, function, text, want):
    assert one(spark, lambda C: function(C), text) == want


def test_text_with_parameters(spark):
    assert one(spark, lambda C: t.odd_spacing_ratio(C), "a b cd ef") == 0.5 and one(spark, lambda C: t.odd_spacing_ratio(C), "") == 0
    assert one(spark, lambda C: t.count_of(C, "aa"), "aaaaa") == 2
    assert one(spark, lambda C: t.snippet(C, F.lit(3), 1), "abcdef") == "bcd"
    assert one(spark, lambda C: t.top_lines(C, 2), "a\n\n b \nc") == ["a", "b"] and one(spark, lambda C: t.bottom_lines(C, 2), "a\n\n b \nc") == ["b", "c"]
    assert one(spark, lambda C: t.contains_loosely(C, "red ring"), "x REDRING y") and not one(spark, lambda C: t.contains_loosely(C, "red"), "r ed")
    assert one(spark, lambda C: t.wildcard(C, "ab*d"), "ABcÉd") and not one(spark, lambda C: t.wildcard(C, "ab*d"), "xabd")
    assert one(spark, lambda C: F.regexp_extract(C, t.template_regex("fee of {{value}} due"), 1), "a fee  of 12 due") == "12"
    assert one(spark, lambda C: v.format_money(C), Decimal("1234.50"), "decimal(18,2)") == "R$ 1.234,50"
    assert one(spark, lambda C: t.fix_split_words(C, ["de"]), "carr o de casa e x") == "carro de casae" + "x"
