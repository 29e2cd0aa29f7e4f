"""Edge rows of the scalar functions."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywise.functions import filenames as fn, money as mn, text as tx
from tallywise.functions.dates import lenient_date, shape_of
from tallywise.functions.missing import first_present


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_lenient_number(spark):
    got = apply(spark, mn.lenient_number, [" 12 ", "\t7\n", "1e3", "1.0d", "1,234.5", "", "nan", None, "abc", "-.5", "5.", "inf"])
    assert got == [12.0, 7.0, 1000.0, None, None, None, None, None, None, -0.5, 5.0, None]


def test_bank_and_any_money(spark):
    assert apply(spark, mn.bank_money, ["PHP 1,234.50", "-20", "PHP", None]) == [Decimal("1234.50"), Decimal("-20.00"), None, None]
    assert apply(spark, mn.any_money, ["$1,234.50", "(12.30)", "EUR 5", "₱(1,000.00)", "5 CAD"]) == [
        Decimal("1234.50"), Decimal("-12.30"), Decimal("5.00"), Decimal("-1000.00"), None]


def test_percent_and_size(spark):
    assert apply(spark, mn.percent_to_ratio, ["41%", "52.33%", "x%"]) == [0.41, pytest.approx(0.5233), None]
    assert apply(spark, mn.human_size, [100, 1048576, 1048575, 299264], "long") == ["0.1 KB", "1.0 MB", "1024.0 KB", "292.2 KB"]


def test_lenient_date(spark):
    got = apply(spark, lenient_date, ["2025-08-13", "8/13/2025", "13/08/2025", "07/08/2025", "2025-02-30", "not a date", " 2025-01-02 ", None,
                                      "2025-01-02 10:11:12"])
    d = dt.date
    assert got == [d(2025, 8, 13), d(2025, 8, 13), None, d(2025, 7, 8), None, None, d(2025, 1, 2), None, d(2025, 1, 2)]
    assert shape_of("yyyyMMdd") == r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"


def test_first_present(spark):
    rows = spark.createDataFrame([("  ", "b"), ("NaN", None), (None, "nan"), ("a", "b")], "x string, y string")
    got = [r[0] for r in rows.select(first_present([F.col("x"), F.col("y")], F.lit("-"))).collect()]
    assert got == ["b", "-", "-", "a"]


def test_split_signed(spark):
    rows = spark.createDataFrame([(Decimal("5.00"),), (Decimal("-5.00"),), (Decimal("0.00"),), (None,)], "a decimal(18,2)")
    o, i = mn.split_signed(F.col("a"))
    assert [(float(r[0]), float(r[1])) for r in rows.select(o, i).collect()] == [(5, 0), (0, 5), (0, 0), (0, 0)]


NAMES = {
    "acme_gold_2024-03_predictions_20240229_235959.csv": ("acme_gold", "2024-03", "predictions", "20240229_235959", True),
    "household_cash_corrected_20240229_235959.csv": ("household_cash", None, "corrected", "20240229_235959", True),
    "reviewed_batch_part_7_20240311_121314_121316.csv": ("reviewed_batch_part_7", None, "20240311", "121314_121316", False),
    "a_b_c.csv": (None, None, None, None, False),
    "x_2025-07x_input_20240229_235959.csv": ("x", "2025-07x", "input", "20240229_235959", True),
    "x_2025-07_input_20241308_235959.csv": ("x", "2025-07", "input", "20241308_235959", False),
    "2025-07_input_20240229_235959.csv": (None, "2025-07", "input", "20240229_235959", False),
}


def test_names_parse_and_validate(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "v string").select(
        "v", fn.parse_name(F.col("v")).alias("p"), fn.name_is_standard(F.col("v")).alias("ok")).collect()
    for r in rows:
        assert (r.p.source, r.p.period, r.p.stage, r.p.timestamp, r.ok) == NAMES[r.v], r.v


def test_names_round_trip(spark):
    name = "acme_gold_2024-03_predictions_20240229_235959.csv"
    nxt = lambda stage: lambda c: fn.next_stage_name(c, stage, F.lit("20250101_000000"))
    assert apply(spark, nxt("corrected"), [name]) == ["acme_gold_2024-03_corrected_20240229_235959.csv"]
    assert apply(spark, nxt("accounting"), ["reviewed_batch_part_7_20240311_121314_121316.csv", "zzz.csv"]) == [
        "legacy_file_accounting_20240311_121314.csv", "legacy_file_accounting_20250101_000000.csv"]


def test_sources_of_names(spark):
    got = apply(spark, fn.source_of, ["My automl card Statement UNIONBANK Visa 2024-03.csv", "Kept House Kitty sheet 2024-02.csv",
                                      "automl statement acme gold 2025-01.csv", "random.csv"])
    assert got == ["unionbank_visa", "household_cash", "acme_gold", "unknown"]
    assert apply(spark, fn.standard_source, ["Union Bank", "BPI Gold!", "  ", "My  Bank"]) == ["unionbank_visa", "bpi_mastercard", "unknown", "my_bank"]
    assert apply(spark, fn.strip_upload_prefix, ["part_9_20240311_121314_my x.csv", "plain.csv"]) == ["121314_my x.csv", "plain.csv"]
    assert apply(spark, fn.version_in, ["training_data_household_v12_2025.csv", "none"]) == [12, None]


def test_tokens_and_ngrams(spark):
    assert apply(spark, tx.word_ngrams, ["A Big Red-Fox", "", "x"]) == [["big", "red", "fox", "big red", "red fox"], [], []]
    words = apply(spark, tx.padded_words, ["Été  a", ""])
    assert words == [[" ete ", " a "], []]
    grams = apply(spark, tx.char_ngrams, [" a "])[0]
    assert sorted(grams) == sorted([" ", "a", " ", " a", "a ", " a "])
