"""Dates and times in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import INVISIBLE, let, strip

# Month names of receipts.
SPANISH_MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7,
    "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
MONTH_ALIASES = {
    "ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12,
}
NUMERIC_DATE = r"(?=\d)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
CLOCK = r"(?=\d)\b\d{1,2}:\d{2}\b"
TEXT_DATE = r"(?=\d)(?iu)\b(\d{1,2})\s*(?:de\s+)?(" + "|".join(SPANISH_MONTHS) + r")\s*(?:de\s+)?(20\d{2}|\d{2})\b"


def _two(c: Column) -> Column:
    return F.lpad(c.try_cast("int").cast("string"), 2, "0")


def _year(c: Column) -> Column:
    y = c.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def _month(c: Column, names: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), c)


def _real_date(year: Column, month: Column, day: Column) -> Column:
    """A date, null where the calendar has none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def detect_date(c: Column) -> Column:
    """DD/MM/YYYY of the first date: with a Spanish month name if the calendar has it, else in digits as they stand."""
    t = F.coalesce(c, F.lit(""))
    part = lambda found, i: F.regexp_extract(found, TEXT_DATE, i)

    def in_words(found: Column) -> Column:
        # What is found matches by itself in the same way, so its parts need no more passes over the text.
        return F.when(found != "", let(F.struct(part(found, 1).alias("d"), part(found, 2).alias("m"), part(found, 3).alias("y")), named))

    def named(x: Column) -> Column:
        month = F.coalesce(_month(F.lower(x["m"]), SPANISH_MONTHS), F.lit(0))
        return F.date_format(_real_date(_year(x["y"]), month, F.coalesce(x["d"].try_cast("int"), F.lit(0))), "dd/MM/yyyy")

    def plain(p: Column) -> Column:
        year = F.get(p, F.lit(2))
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(F.lpad(year, 4, "0"))
        return F.when(F.size(p) == 3, F.concat_ws("/", _two(F.get(p, F.lit(0))), _two(F.get(p, F.lit(1))), year))

    return F.coalesce(
        let(F.regexp_extract(t, TEXT_DATE, 0), in_words),
        let(F.split(F.regexp_extract(t, NUMERIC_DATE, 0), "[/-]"), plain))


def detect_time(c: Column) -> Column:
    clock = F.regexp_extract(F.coalesce(c, F.lit("")), CLOCK, 0)
    return F.when(clock != "", F.lpad(clock, 5, "0"))


def parse_date_any(c: Column) -> Column:
    """date of DD/MM/YYYY or ISO text, null for anything else."""
    return F.coalesce(
        F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(c, "d/M/yyyy")),
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")))


def to_ddmmyyyy(c: Column) -> Column:
    """ISO text as DD/MM/YYYY; other text as it is."""
    return F.coalesce(F.when(strip(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date(strip(c), "yyyy-MM-dd"), "dd/MM/yyyy")), strip(c))


def normalize_date(c: Column) -> Column:
    """ISO text of a date anywhere in the text; '' where the calendar has none; else the text in upper case.

    Texts that are a date and nothing else, most of them, are read by their places, with the same result as by patterns.
    """
    part = lambda at, n: F.substring(c, at, n)
    real = lambda t: F.when(t.try_cast("date").isNotNull(), t).otherwise("")
    return (F.when(F.coalesce(c, F.lit("")) == "", "").when(c.rlike(r"\A[1-9]\d{3}-\d{2}-\d{2}\z"), real(c))
            .when(c.rlike(r"\A\d{2}/\d{2}/[1-9]\d{3}\z"), real(F.concat(part(7, 4), F.lit("-"), part(4, 2), F.lit("-"), part(1, 2)))).otherwise(_date_within(c)))


def _date_within(c: Column) -> Column:
    iso, local = r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b", r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})\b"

    def read(t: Column) -> Column:
        num = lambda p, i: F.coalesce(F.regexp_extract(t, p, i).try_cast("int"), F.lit(0))
        text = lambda d: F.coalesce(d.cast("string"), F.lit(""))
        return (F.when(t.rlike(iso), text(_real_date(num(iso, 1), num(iso, 2), num(iso, 3))))
                .when(t.rlike(local), text(_real_date(_year(F.regexp_extract(t, local, 3)), num(local, 2), num(local, 1))))
                .otherwise(F.upper(F.regexp_replace(t, r"\s+", " "))))

    return let(strip(F.translate(F.coalesce(c, F.lit("")), INVISIBLE, "")), read)


def normalize_time(c: Column) -> Column:
    """HH:MM of H:MM, HhMM or compact digits; else the text in upper case. Texts that are blank or a time and nothing else need no patterns."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(c.rlike(r"\A(?:[01]?\d|2[0-3]):[0-5]\d\z"), F.lpad(c, 5, "0")).otherwise(_time_within(c))


def _time_within(c: Column) -> Column:
    def read(t: Column) -> Column:
        out = F.upper(F.regexp_replace(t, r"\s+", " "))
        for pattern in (r"\b(\d{1,2})(\d{2})\b", r"\b(\d{1,2})[:.hH](\d{2})\b"):
            hour, minute = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
            out = F.when((hour.try_cast("int") <= 23) & (minute.try_cast("int") <= 59), F.concat_ws(":", _two(hour), minute)).otherwise(out)
        return out

    return let(strip(F.translate(F.coalesce(c, F.lit("")), INVISIBLE, "")), read)


def time_24h(c: Column) -> Column:
    """struct of value (HH:MM) and error, from 12- and 24-hour text."""
    half, whole = r"\b(\d{1,2})\s*[:.h]\s*(\d{2})(?:\s*:?\s*\d{2})?\s*(am|pm)\b", r"\b(\d{1,2})\s*[:.h]\s*(\d{2})(?:\s*[:.h]\s*\d{2})?\b"
    result = lambda value, error: F.struct(value.cast("string").alias("value"), error.cast("string").alias("error"))
    clock = lambda h, mi: F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(mi.cast("string"), 2, "0"))
    none = F.lit(None)

    def read(m: Column) -> Column:
        num = lambda p, i: F.regexp_extract(m, p, i).try_cast("int")
        hour = num(half, 1) % 12 + F.when(F.regexp_extract(m, half, 3) == "pm", 12).otherwise(0)
        return (F.when(m.isNull() | m.isin("", "null", "none", "n/a"), result(none, none))
                .when(m.rlike(half), F.when(num(half, 1).between(1, 12) & (num(half, 2) <= 59), result(clock(hour, num(half, 2)), none)).otherwise(result(none, F.lit("invalid 12-hour time"))))
                .when(m.rlike(whole) & (num(whole, 1) <= 23) & (num(whole, 2) <= 59), result(clock(num(whole, 1), num(whole, 2)), none))
                .otherwise(result(none, F.lit("must be HH:MM"))))

    within = let(F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?i)\ba\s*\.?\s*m\.?(?=\W|$)", "am"), r"(?i)\bp\s*\.?\s*m\.?(?=\W|$)", "pm")), read)
    # A null or a time of two and two digits needs none of these patterns.
    return F.when(c.isNull() | c.rlike(r"\A(?:[01]\d|2[0-3]):[0-5]\d\z"), result(c, none)).otherwise(within)
