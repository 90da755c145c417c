"""Which account a deposit text belongs to."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import digits_only, fold

# Names and the number that tell accounts apart.
PERSON, COMPANY, PHONE = "DAVID GUEVARA", "GROUP DYD COMUNICACIONES SAS", "3176771287"
PERSON_LIKE, COMPANY_LIKE = 0.88, 0.72
# Where a payload tells who sent a deposit.
PAYLOAD_KEYS = ("remitente", "telefono_remitente", "empresa_origen", "sender", "nombre_remitente", "originador", "titular", "cuenta_origen", "telefono", "numero_nequi", "ocr_text", "raw_text")


@F.pandas_udf(T.StructType([T.StructField("person", T.DoubleType()), T.StructField("company", T.DoubleType())]))
def seq_ratios(person: pd.Series, company: pd.Series) -> pd.DataFrame:
    """Likeness to the person's and the company's name by longest common blocks; no built-in measures that. Null texts are not compared."""
    def likeness(texts: pd.Series, name: str) -> list[float]:
        matcher = SequenceMatcher(None, "", name)
        out = []
        for text in texts:
            if text is None:
                out.append(0.0)
                continue
            matcher.set_seq1(text)
            out.append(matcher.ratio())
        return out
    return pd.DataFrame({"person": likeness(person, PERSON.replace(" ", "")), "company": likeness(company, COMPANY.replace(" ", ""))})


def may_reach(text: Column, name: str, least: float) -> Column:
    """Whether a text may be as like a name as `least`: by its length, and where that allows it by its letters, as common blocks hold no more of a letter than both have.

    Likeness is 2 * (letters in common blocks) / (sum of lengths), so 2 * (letters both have) / sum is never below it.
    """
    size = F.length(text)
    both = sum((F.least(size - F.length(F.replace(text, F.lit(x), F.lit(""))), F.lit(name.count(x))) for x in sorted(set(name))), F.lit(0))
    by_length = 2 * F.least(size, F.lit(len(name))) >= least * (size + len(name))
    return F.when(by_length, 2 * both >= least * (size + len(name))).otherwise(False)


def company_marks(c: Column) -> Column:
    """Whether a text names the company, whole, in part or masked."""
    n, raw = fold(c), F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", " ")
    has = n.contains
    dyd = has("DYD") | has("D Y D")
    group, dyd_masked = raw.rlike(r"\bGR[O0][A-Z*]*\b"), raw.rlike(r"\bDYD[A-Z*]*\b|\bD\s*\*?\s*Y\s*\*?\s*D[A-Z*]*\b")
    com_masked = raw.rlike(r"\bC[O0]M[A-Z*]*\b")
    return (has("GROUP") & has("DYD") & has("COMUNIC")) | dyd & (has("GRUPO") | has("GRO") | has("GROUP") | has("COM") | has("SAS")) | dyd_masked & (group | com_masked)


def _asked(df: DataFrame, text: str) -> tuple[Column, Column, Column]:
    """Of a column with folded text: what is decided without the likeness, and the texts whose likeness to the person or the company has to be asked."""
    n = F.col("_describe_text")
    decided = F.when(n == "", "NINGUNO").when(n.contains(PERSON) | digits_only(n).contains(PHONE), "NEQUI").when(company_marks(F.col(text)), "CUENTA")
    open_row = F.coalesce(decided, F.lit("")).isin("", "CUENTA")
    squeezed, marks_off = F.replace(n, F.lit(" "), F.lit("")), F.regexp_replace(n, "[^A-Z0-9]", "")
    return decided, F.when(open_row & may_reach(squeezed, PERSON.replace(" ", ""), PERSON_LIKE), squeezed), F.when(open_row & may_reach(marks_off, COMPANY.replace(" ", ""), COMPANY_LIKE), marks_off)


def asked_share(df: DataFrame, text: str) -> DataFrame:
    """n rows, and how many of them the likeness is asked for."""
    df = df.withColumn("_describe_text", fold(F.col(text)))
    _, person, company = _asked(df, text)
    return df.agg(F.count("*").alias("n"), F.count_if(person.isNotNull() | company.isNotNull()).alias("asked"))


def with_description(df: DataFrame, text: str, out: str = "description") -> DataFrame:
    """df with NEQUI, CUENTA or NINGUNO. The likeness, one call for both names, is asked only where nothing simpler decided and length and letters allow it."""
    n, sure, both = "_describe_text", "_describe_sure", "_describe_like"
    df = df.withColumn(n, fold(F.col(text)))
    decided, person, company = _asked(df, text)
    df = df.withColumn(sure, decided).withColumn(both, seq_ratios(person, company))
    answer = (F.when(F.col(sure) == "NINGUNO", "NINGUNO").when((F.col(sure) == "NEQUI") | (F.col(f"{both}.person") >= PERSON_LIKE), "NEQUI")
              .when((F.col(sure) == "CUENTA") | (F.col(f"{both}.company") >= COMPANY_LIKE), "CUENTA").otherwise("NINGUNO"))
    return df.withColumn(out, answer).drop(n, sure, both)


def payload_text(payload: Column) -> Column:
    """The values of a JSON object under PAYLOAD_KEYS, in their order, joined by spaces."""
    v = F.try_parse_json(payload)
    return F.array_join(F.array(*[F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in PAYLOAD_KEYS]), " ")


def plain_values(payload: Column) -> Column:
    """The strings and numbers of a JSON object, joined by spaces; nested values are left out."""
    values = F.map_values(F.from_json(payload, "map<string,variant>"))
    plain = F.filter(values, lambda v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
    return F.coalesce(F.array_join(F.transform(plain, lambda v: F.try_variant_get(v, "$", "string")), " "), F.lit(""))


def describe_payload(df: DataFrame, payload: str, out: str = "description") -> DataFrame:
    """df with the account that a structured payload names; NINGUNO where it is no JSON object."""
    return with_description(df.withColumn("_describe_payload", payload_text(F.col(payload))), "_describe_payload", out).drop("_describe_payload")


def describe_deposit(df: DataFrame, payload: str = "structured_payload", texts: tuple[str, ...] = ("ocr_raw_text", "context_text"), out: str = "description") -> DataFrame:
    """df with the account of a deposit, by its payload's plain values and the texts of its image, as far as df has such columns."""
    parts = [plain_values(F.col(payload))] if payload in df.columns else []
    seen = F.concat_ws(" ", *parts, *[F.coalesce(F.col(c), F.lit("")) for c in texts if c in df.columns])
    return with_description(df.withColumn("_describe_seen", seen), "_describe_seen", out).drop("_describe_seen")
