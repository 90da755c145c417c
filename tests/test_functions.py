"""Values of single columns, as tables of input and expectation."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, describe, extract, money, redact, text, validate
from ledgerloom.sources import docx


def value(spark, column, v, kind="string"):
    return spark.createDataFrame([(v,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "wanted"), [
    ("1.200,50", 1200.5), ("$1,200.50", 1200.5), ("70000", 70000.0), ("", None), (None, None), ("50.000,00", 50000.0), ("50,000.00", 50000.0), ("$50.000,00", 50000.0),
    ("COP 50.000,00", 50000.0), ("50000", 50000.0), ("50 000,00", 50000.0), ("50.000", 50000.0), ("50.0000", 50.0), ("abc", None)])
def test_parse_currency(spark, given, wanted):
    assert value(spark, money.parse_currency, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("50.0000", "500000.00"), ("50.000,00", "50000.00"), ("1,5", "1.50"), ("-", None), (None, None), ("1.005", "1005.00"), ("2,345.678", "2345.68")])
def test_normalize_amount(spark, given, wanted):
    got = value(spark, money.normalize_amount, given)
    assert got == (Decimal(wanted) if wanted else None)


def test_validator_amount_drops_commas(spark):
    assert value(spark, money.validator_amount, "$50.000,00") == Decimal("50")


@pytest.mark.parametrize(("given", "wanted"), [
    ("2:00 pm", "14:00"), ("2:00 p. m.", "14:00"), ("02:00 PM", "14:00"), ("11:49 a. m.", "11:49"), ("12:00 am", "00:00"), ("12:00 a. m.", "00:00"), ("12:00 pm", "12:00"),
    ("12:00 p. m.", "12:00"), ("05:52", "05:52"), ("14:30", "14:30"), ("10:13:03", "10:13")])
def test_time_24h(spark, given, wanted):
    got = value(spark, dates.time_24h, given)
    assert (got["value"], got["error"]) == (wanted, None)


def test_time_24h_errors_and_blanks(spark):
    assert value(spark, dates.time_24h, "25:00")["error"] and value(spark, dates.time_24h, "13:00 pm")["error"]
    assert tuple(value(spark, dates.time_24h, " ")) == (None, None) and tuple(value(spark, dates.time_24h, None)) == (None, None)


@pytest.mark.parametrize(("given", "wanted"), [("pago 2026-4-5 x", "2026-04-05"), ("5/4/26", "2026-04-05"), ("31/02/2026", ""), ("ayer  tarde", "AYER TARDE"), (None, "")])
def test_normalize_date(spark, given, wanted):
    assert value(spark, dates.normalize_date, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("9:05", "09:05"), ("9h05", "09:05"), ("0905", "09:05"), ("2575", "2575"), ("", "")])
def test_normalize_time(spark, given, wanted):
    assert value(spark, dates.normalize_time, given) == wanted


def test_detect_date(spark):
    assert value(spark, dates.detect_date, "Fecha 01 de ABRIL de 2026, 3/4/26") == "01/04/2026"
    assert value(spark, dates.detect_date, "el 3-4-26") == "03/04/2026"
    assert value(spark, dates.detect_date, "nada") is None


def test_parse_date_any_takes_both_forms(spark):
    assert value(spark, dates.parse_date_any, "15/04/2026") == value(spark, dates.parse_date_any, "2026-04-15") == date(2026, 4, 15)


def test_score_text(spark):
    assert value(spark, text.score_text, "") == 0 and value(spark, text.score_text, None) == 0
    assert value(spark, text.score_text, "10/04/2026 08:30 ref 12345 consignacion banco valor $10.000") > 10


def test_clean_text(spark):
    got = value(spark, text.clean_text, "Fecha de proceso: 05-05-26   Importe Total: $ 360 . 000,00\n\n x")
    assert got["cleaned"] == "Fecha de proceso: 05/05/2026 Importe Total: $360.000,00\nx" and got["corrections"] > 0 and 0 <= got["confidence"] <= 1
    assert value(spark, text.clean_text, "  ")["issues"] == ["no_text"]


def test_matches_of_a_long_text(spark):
    """Fifty thousand amounts in one text, in seconds."""
    import time

    one = spark.createDataFrame([("pago $ 1.500 y " * 50_000,), (None,), ("nada",)], "t string")
    began = time.perf_counter()
    got = one.select(text.matches(F.col("t"), r"\d+\.\d+").alias("m")).select(F.size("m").alias("n"), F.get("m", F.size("m") - 1).alias("last")).collect()
    assert time.perf_counter() - began < 20
    assert (got[0]["n"], got[0]["last"]["text"], got[0]["last"]["start"]) == (50_000, "1.500", 15 * 49_999 + 7) and got[2]["n"] == 0


def test_matches_give_places(spark):
    s = "a 12 b 345 c"
    assert [(m["text"], m["start"], m["end"]) for m in value(spark, lambda c: text.matches(c, r"\d+"), s)] == [("12", 2, 4), ("345", 7, 10)]


RECEIPTS = [
    ("Referencia M08326455 Fecha 01 ABRIL 2026 Valor 2026", None), ("Referencia M08326455 Valor 1149 Fecha 01 ABRIL 2026", None), ("Referencia M08326455 Valor 3176771287 Numero Nequi 3176771287", None),
    ("Pago exitoso Nequi\n¿Cuánto? $70.000,00\nFecha 01 de abril de 2026 a las 11:49 a. m.\nReferencia M08326455\nNúmero Nequi 317036520", ("01/04/2026", "11:49", "M08326455", 70000.0)),
    ("Referencia MCTX001 Valor $30.000,00", (None, None, "MCTX001", 30000.0)), ("", None), (None, None)]


def test_extract_record(spark):
    df = extract.with_record(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RECEIPTS)], "i int, text string"))
    got = {r["i"]: r["record"] and tuple(r["record"]) for r in df.collect()}
    assert got == {i: w for i, (_, w) in enumerate(RECEIPTS)}


def test_resolve_date_prefers_text(spark):
    r = spark.range(1).select(extract.resolve_date(F.lit("05/05/2026"), F.lit(None).cast("string"), F.lit("30/04/2026")).alias("r"), extract.resolve_date(F.lit(""), F.lit(" "), F.lit("30/04/2026")).alias("c")).first()
    assert tuple(r["r"]) == ("05/05/2026", "ocr_text") and tuple(r["c"]) == ("30/04/2026", "document_context")


@pytest.mark.parametrize(("reference", "amount", "day", "ok"), [
    ("REF1", "50.000,00", "15/04/2026", True), ("REF1", "0", "15/04/2026", False), ("REF1", "-50.000,00", None, False), ("ok", "5000", None, False), ("REF1", "5000", "2026-04-15", False),
    ("REF1", "5000", "05/ABR/26", True), ("pago exitoso 1", "5000", None, False), (None, "5000", None, False)])
def test_valid_record(spark, reference, amount, day, ok):
    df = spark.createDataFrame([(reference, amount, day)], "r string, a string, d string")
    got = df.select(validate.valid_record(F.col("r"), F.col("a"), F.col("d"), F.lit(None).cast("string")).alias("v")).first()["v"]
    assert (got["error"] is None) == ok
    if day == "05/ABR/26":
        assert got["fecha_consignacion"] == "05/04/2026"


def test_validate_record(spark):
    df = spark.createDataFrame([("REF001", "50000.00", "15/04/2026", "09:30"), ("", "x", "99/99/2026", "99:99"), ("AB", "5", None, None)], "r string, a string, d string, t string")
    v = [r["v"] for r in df.select(validate.validate_record(F.col("r"), F.col("a"), F.col("d"), F.col("t"), F.lit(date(2026, 4, 20))).alias("v")).collect()]
    assert v[0]["is_valid"] and not v[0]["needs_review"] and v[0]["confidence"] == 1.0 and v[0]["raw_confidence"] == pytest.approx(1.21)
    assert not v[1]["is_valid"] and v[1]["confidence"] == 0
    assert v[2]["is_valid"] and v[2]["needs_review"] and {i["field"] for i in v[2]["issues"]} == {"referencia"}


@pytest.mark.parametrize(("amount", "wanted"), [("1000", "amount_looks_like_time"), ("1160", ""), ("500", "amount_looks_like_time"), ("2026", "amount_looks_like_year"), ("3176771287", "amount_looks_like_phone"), (None, "missing_transaction_amount"), ("70.000", "")])
def test_amount_reject_reason(spark, amount, wanted):
    assert value(spark, validate.amount_reject_reason, amount) == wanted


def test_reference_reject_reason(spark):
    assert [value(spark, validate.reference_reject_reason, v) for v in ("Nequi ", " ", None, "R1")] == ["reference_too_generic", "missing_transaction_reference", "", ""]


def test_observations(spark):
    see = lambda d: value(spark, lambda c: validate.observations(c, 4, 2026), d)
    assert tuple(see("15/03/2026")) == (["Fecha fuera del periodo valido configurado"], False) and tuple(see("15/04/2026")) == ([], True)
    assert tuple(see(None)) == (["Fecha no identificada"], None) and tuple(see("x")) == (["Fecha invalida"], None)


def test_criteria_rules(spark):
    fields = [{"key": "x", "label": "X", "required": True, "rules": [{"kind": "min", "value": 10}, {"kind": "regex", "pattern": "0$", "message": "end"}, {"kind": "equals", "value": "20", "message": "eq"}]}]
    see = lambda v: spark.createDataFrame([(v,)], "x string").select(validate.criteria_rules(fields).alias("y")).first()["y"]
    assert see("20") == [] and see("5") == ["X no es valido", "end", "eq"] and see(None) == ["X es obligatorio"]


def test_description(spark):
    rows = ["Pago a David Guevara", "tel 317 677 1287", "DAV1D GUEVARA", "Group Dyd Comunicaciones Sas", "GRO*** DYD***", "otra empresa", "", None]
    got = describe.with_description(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string"), "t").orderBy("i")
    assert [r["description"] for r in got.collect()] == ["NEQUI", "NEQUI", "NEQUI", "CUENTA", "CUENTA", "NINGUNO", "NINGUNO", "NINGUNO"]


def test_redaction(spark):
    got = value(spark, redact.redact_payload, '{"a": {"llm_api_key": "x", "t": "' + "y" * 5000 + '"}, "d": "data:image/png;base64,AA"}')
    assert '"llm_api_key": "[redacted]"' in got and "[truncated 1000 chars]" in got and "base64-data-url" in got
    assert value(spark, redact.mask_payload, '{"has_token": true, "my_token": "x"}') == '{"has_token": true, "my_token": "***"}'
    assert value(spark, redact.redact_payload, "no json") is None


@pytest.mark.parametrize(("fast", "slow", "texts"), [
    (dates.normalize_date, dates._date_within, ["", None, "2026-04-15", "2026-02-30", "15/04/2026", "31/04/2026", "29/02/2024", "15/04/2026\n", " 15/04/2026", "0026-04-15", "15/04/0026", "15/04/26", "5/4/2026", "00/00/2026", "el 15/04/2026 x", "​15/04/2026"]),
    (dates.normalize_time, dates._time_within, ["", None, "7:05", "07:05", "23:59", "24:00", "7:60", "7:05\n", " 7:05 ", "0930", "9h30", "007:05", "x 7:05", "​7:05"]),
    (money.normalize_reference, money._reference_within, ["", None, " ref001 ", "REF001", "a b", "  ", "ref\t1", "ref1\n", "​ref1", "ñandú", " ß ", "a ", "\\Q|ref"]),
])
def test_short_ways_read_as_the_patterns_do(spark, fast, slow, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fast(F.col("t")).alias("fast"), slow(F.col("t")).alias("slow")).collect()
    assert [(r["t"], r["fast"]) for r in rows] == [(r["t"], r["slow"]) for r in rows]


def test_rows_of_documents_go_out_together_within_bounds():
    small = [[("d", 1, 1, "t", None, None, None, None)] * 2 for _ in range(5)]
    assert [len(x) for x in docx.stretches(small, most_rows=4)] == [4, 4, 2]
    large = [[("d", 1, 1, "", "m", b"x" * 10, "h", None)] for _ in range(4)]
    assert [len(x) for x in docx.stretches(large, most_bytes=20)] == [2, 2] and list(docx.stretches([])) == []


def test_matches_are_found_in_one_pass_with_their_places(spark):
    """Places as plain Python finds them, also in texts that hold the mark; with_record runs the costly pattern over a text once, but for texts with the mark."""
    import re

    from ledgerloom.functions import extract, text

    texts = ["", None, "a1b22", "1", "12 \x01 3\x0145", "\x01", "é7ñ88\n9", "x" * 50 + "1a" * 3000, "no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for got in (df.select("i", text.matches(F.col("t"), r"\d+").alias("m")), text.with_matches(df, F.col("t"), m=r"\d+")):
        for r in got.collect():
            want = None if texts[r["i"]] is None else [(m.group(), m.start(), m.end()) for m in re.finditer(r"\d+", texts[r["i"]])]
            assert (r["m"] if r["m"] is None else list(map(tuple, r["m"]))) == want
    plan = extract.with_record(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    # Once for all texts and three times in the branch for those with the mark; it stood there six times, for all texts, before.
    assert plan.count(extract.MONEY) <= 4


def test_looks_before_patterns_lose_no_match(spark):
    from ledgerloom.functions import extract

    def same(pattern, plain, texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows) and any(r["a"] for r in rows)

    texts = ["CUÁNTO valor İMPORTE ımporte MONTO Total  a pagar", "COP 1.000 cop1,000.50 $ 5 000 col$1.000 12345 x1234 \t1.000 2000", "Nequi NÚMERO  NEQUI llave ıdentificación NIT Cédula", "Ref: ABC1 no. 12345 TRANSACCIÓN#X9/2 comprobante 777 operacion-AB1"]
    for pattern in (extract.MONEY, extract.AMOUNT_LABEL, extract.OTHER_LABEL, extract.REFERENCE_LABEL):
        same(pattern, pattern[pattern.index("(?i"):], texts)


def test_cleaned_text_is_clean_texts_text(spark):
    from ledgerloom.functions import text

    texts = ["", None, " \n\t", "$ 5  x", "1 . 234 , 50", "3-4-2020 y 3/4/20 a las 10:30 \n\n z ", "03-04-21 5", "€ 7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.clean_text(F.col("t"))["cleaned"].alias("a"), text.cleaned_text(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


ODD_TEXTS = ["", None, " ", "\n", "\u0085", "abc \u0085", "x\r\n", " a  b\n\n c \n", "$ 5  x", "€12", "1 . 234 , 50", "12.345 .67", "1.23 .45", "1-4-2026", "1/4-2026 y 3/4/20", "3/4/20261",
             "Referencia ABC-12 Valor 2026 Monto $ 1.000,00 celular 3176771287 total  a pagar 12345", "cuantotal a pagar 50.000\tno. XYZ9", "Numero Nequi 12.345 Referencia nequi", "Valor 1149 ref: M08326455", "Importe 123456789012 banco\x01 7.000",
             "Comprobante de pago banco\nMonto $ 12.345,50\nFecha 15/04/1998 07:05\nReferencia: M00000001", "Valor $0 Referencia R12345", "valor" + " " * 40 + "$ 9.999 llave 5000" + " x" * 60 + " 8.888"]


def test_texts_are_cleaned_as_before_where_patterns_are_left_out(spark):
    rows = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string").select(text.clean_text(F.col("t"))["cleaned"].alias("a"), text.cleaned_text(F.col("t")).alias("b"), text.one_blank(F.col("t")).alias("c"), F.regexp_replace("t", "[ \t]+", " ").alias("d")).collect()
    assert [(r["a"], r["c"]) for r in rows] == [(r["b"], r["d"]) for r in rows]


def test_records_are_the_same_without_their_candidates(spark):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "i int, t string")
    whole = extract.with_record(df, "t").select("i", "reason", "record", extract.best_amount(F.col("candidates")).alias("best"))
    lean = extract.with_record(df, "t", candidates=False)
    assert "candidates" not in lean.columns
    got = lean.select("i", "reason", "record", extract.best_amount(extract.amount_candidates(F.coalesce(text.one_blank(F.col("t")), F.lit("")))).alias("best"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.collect())) and whole.filter("record IS NOT NULL").count() > 2


@pytest.mark.parametrize("given", ["", None, "5", "12.50", "12.500", "1.5", "0.00", "1234567890123456789.25", "12.50\n", "-5", "$5", "٣.٥٠"])
def test_plain_amounts_read_as_by_patterns(spark, given):
    assert value(spark, money.parse_currency, given) == value(spark, money._currency_within, given)


@pytest.mark.parametrize(("day", "wanted"), [("01/02/2026", "01/02/2026"), (" 01/02/2026\n", "01/02/2026"), ("1/2/2026", None), ("NULL", None), ("5-ABR-26", "05/04/2026"), (None, None)])
def test_schema_date(spark, day, wanted):
    got = value(spark, validate.schema_date, day)
    assert got["value"] == wanted and (got["error"] is None) == (day != "1/2/2026")


@pytest.mark.parametrize(("clock", "wanted"), [("07:05", "07:05"), ("23:59", "23:59"), ("24:00", None), ("7:05 p. m.", "19:05"), ("07:05\n", "07:05"), (None, None)])
def test_time_24h(spark, clock, wanted):
    got = value(spark, dates.time_24h, clock)
    assert got["value"] == wanted and (got["error"] is None) == (clock != "24:00")
