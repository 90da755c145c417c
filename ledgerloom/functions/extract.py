"""One conservative deposit record per text: amount, reference, date and time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import CLOCK, NUMERIC_DATE, detect_date, detect_time
from ledgerloom.functions.money import parse_currency
from ledgerloom.functions.text import begin, digits_only, let, matches, one_blank, settled, strip, with_matches

# Patterns and words of receipts.
MONEY = begin("Cc$ \n0123456789") + r"(?i)(?:(?:COP|COL\$|\$)?\s*\d{1,3}(?:[.,\s]\d{3})+(?:[.,]\d{2})?|\b\d{4,}(?:[.,]\d{2})?\b)"
AMOUNT_LABEL = begin("cvmitCVMIT") + r"(?iu)(?:cu[aá]nto|valor|monto|importe|total\s+a\s+pagar)"
OTHER_LABEL = begin("nlcibtdNLCIBTD") + r"(?iu)(?:n[uú]mero\s+nequi|llave|cuenta(?:\s+a\s+debitar)?|identificaci[oó]n|banco\s+destino|celular|tel[eé]fono|documento|c[eé]dula|nit)"
REFERENCE_LABEL = begin("rctonRCTON") + r"(?iu)\b(?:ref(?:erencia)?|comprobante|transacci[oó]n|operaci[oó]n|no\.?)[:#\s-]*([A-Z0-9][A-Z0-9\-/]{2,})\b"
REFERENCE_TOKEN = r"(?i)\b[A-Z0-9][A-Z0-9\-/]{4,}\b"
GENERIC_REFERENCES = ("nequi", "banco", "disponible", "pap", "valor", "monto", "referencia")
FIELD_WORDS = ("valor", "fecha", "hora", "banco", "consignacion", "consignación")


def _window(text: Column, low: Column, high: Column) -> Column:
    """Characters from low to high, 0-based, low cut at 0."""
    low = F.greatest(low, F.lit(0))
    return F.substring(text, low + 1, F.greatest(high - low, F.lit(0)))


def looks_like_hhmm(digits: Column) -> Column:
    """Three or four digits that read as a time of day."""
    return F.length(digits).isin(3, 4) & digits.rlike(r"^\d{1,2}[0-5]\d$") & (F.substring(digits, 1, F.length(digits) - 2).try_cast("int") <= 23)


def _misread(x: dict[str, Column]) -> list[tuple[Column, str]]:
    """What the number alone tells against an amount."""
    value, digits = x["value"], x["digits"]
    return [(value.isNull() | (value <= 0), "amount_not_parseable"), (F.floor(value).between(1900, 2100), "amount_looks_like_year"),
            (looks_like_hhmm(digits), "amount_looks_like_time"), (F.length(digits).isin(9, 10) & digits.startswith("3"), "amount_looks_like_phone")]


def _other_field(x: dict[str, Column]) -> Column:
    return ~(x["signed"] | _labelled(x, 30)) & x["near"].rlike(OTHER_LABEL)


def _bare(x: dict[str, Column]) -> Column:
    return ~x["labelled"] & (((F.length(x["digits"]) >= 9) & ~x["signed"]) | ~x["near"].contains("$"))


def _labelled(x: dict[str, Column], n: int) -> Column:
    """Whether a label stands in the n characters before. One there is one in the 80 before as well, so without one there is none to look for."""
    return x["labelled"] & F.right(x["before"], F.lit(n)).rlike(AMOUNT_LABEL)


def _score(x: dict[str, Column]) -> Column:
    return F.when(_labelled(x, 70), 4).otherwise(0) + F.when(x["signed"] | F.right(x["before"], F.lit(10)).contains("$"), 2).otherwise(0)


def _number(m: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
    return let(digits_only(m["text"]), lambda digits: let(parse_currency(m["text"]), lambda value: body({"value": value, "digits": digits})))


def _around(text: Column, m: Column, number: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    near = _window(text, m["start"] - 80, m["end"] + 40)
    return let(_window(text, m["start"] - 80, m["start"]), lambda before: let(before.rlike(AMOUNT_LABEL), lambda labelled: body(
        number | {"signed": m["text"].contains("$"), "before": before, "near": near, "labelled": labelled})))


def amount_candidates(text: Column, found: Column | None = None) -> Column:
    """array of (text, start, end, value, reason, score); reason is null where the amount may be taken. found: the matches of MONEY, where they are there already."""
    def one(m: Column) -> Column:
        return _number(m, lambda number: _around(text, m, number, lambda x: scored(m, x)))

    def scored(m: Column, x: dict[str, Column]) -> Column:
        (unread, why), *others = _misread(x)
        reason = F.when(unread, why).when(_other_field(x), "amount_near_non_amount_label")
        for against, name in others:
            reason = reason.when(against, name)
        return F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), x["value"].alias("value"), reason.when(_bare(x), "amount_without_money_context").alias("reason"), _score(x).alias("score"))
    return F.transform(matches(text, MONEY) if found is None else found, one)


def open_amount(text: Column, found: Column) -> Column:
    """best_amount of amount_candidates, without the reasons against the others: what the number tells is asked first, and what stands around only of those that are left."""
    def one(m: Column) -> Column:
        return _number(m, lambda number: F.when(~reduce(or_, (against for against, _ in _misread(number))), _around(text, m, number, lambda x: scored(m, x))))

    def scored(m: Column, x: dict[str, Column]) -> Column:
        return F.when(~(_other_field(x) | _bare(x)), _ranked(_score(x), m["start"], x["value"], m["text"]))
    return F.array_max(F.transform(found, one))


def _plausible(token: Column) -> Column:
    whole = lambda p: token.rlike("^(?:" + p + ")$")
    return ~whole(NUMERIC_DATE) & ~whole(CLOCK) & ~F.lower(token).isin(*FIELD_WORDS) & (token.rlike("[a-zA-Z]") | (F.length(digits_only(token)) >= 5))


def find_reference(text: Column, found: Column | None = None) -> Column:
    """The first labelled reference that no other label stands before, else the first plausible token. found: the matches of REFERENCE_LABEL, where they are there already."""
    trim = lambda c: F.regexp_replace(c, r"^[ .,:;]+|[ .,:;]+$", "")
    labelled = F.transform(matches(text, REFERENCE_LABEL) if found is None else found, lambda m: F.when(
        ~_window(text, m["start"] - 25, m["start"]).rlike(OTHER_LABEL), trim(F.regexp_extract(m["text"], REFERENCE_LABEL, 1))))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE_TOKEN), F.lit(0)), trim)
    first = lambda a: F.get(F.filter(a, lambda t: t.isNotNull() & _plausible(t)), F.lit(0))
    return F.coalesce(first(labelled), first(tokens))


def generic_reference(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\s+", " ")).isin(*GENERIC_REFERENCES)


def _ranked(score: Column, start: Column, value: Column, token: Column) -> Column:
    return F.struct(score.alias("score"), (-start).alias("order"), value.alias("value"), token.alias("text"))


def best_amount(candidates: Column) -> Column:
    """The highest score, of equal ones the first."""
    open_ = F.filter(candidates, lambda x: x["reason"].isNull())
    return F.array_max(F.transform(open_, lambda x: _ranked(x["score"], x["start"], x["value"], x["text"])))


def with_record(df, text: str = "text", out: str = "record", candidates: bool = True):
    """df with a struct of the extracted record (null fields without one), `candidates` (unless they are not asked for) and `reason` why there is none."""
    t, best, reference = F.col("_extract_text"), F.col("_extract_best"), F.col("_extract_reference")
    df = settled(df, _extract_text=F.coalesce(one_blank(F.col(text)), F.lit("")))
    df = with_matches(df, t, _extract_money=MONEY, _extract_labels=REFERENCE_LABEL)
    if candidates:
        df = settled(df, candidates=amount_candidates(t, F.col("_extract_money")))
    df = settled(df, _extract_best=best_amount(F.col("candidates")) if candidates else open_amount(t, F.col("_extract_money")))
    # Without an amount there is no record, whatever the reference; a reference found holds no white space.
    df = settled(df, _extract_reference=F.when(best.isNotNull(), find_reference(t, F.col("_extract_labels")))).drop("_extract_money", "_extract_labels")
    reason = (
        F.when(~t.rlike(r"\S"), "empty_text")
        .when(best.isNull(), "missing_transaction_amount")
        .when(reference.isNull(), "missing_transaction_reference")
        .when(F.lower(reference).isin(*GENERIC_REFERENCES), "reference_too_generic")
    )
    df = settled(df, reason=reason)
    record = F.when(F.col("reason").isNull(), F.struct(
        detect_date(t).alias("fecha_consignacion"), detect_time(t).alias("hora_consignacion"), reference.alias("referencia"), best["value"].alias("valor")))
    return settled(df, **{out: record}).drop("_extract_text", "_extract_reference", "_extract_best")


def resolve_date(text_date: Column, record_date: Column, context_date: Column) -> Column:
    """struct of the date that holds and where it is from: text, then record, then context."""
    some = lambda c: F.nullif(strip(c), F.lit(""))
    a, b, c = some(text_date), some(record_date), some(context_date)
    source = F.when(a.isNotNull(), "ocr_text").when(b.isNotNull(), "record").when(c.isNotNull(), "document_context").otherwise("missing")
    return F.struct(F.coalesce(a, b, c).alias("date"), source.alias("source"))
