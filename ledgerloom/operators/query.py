"""Query specs: a dict with source, select, filters, aggregations, group_by, order_by and limit becomes a DataFrame.

Fields, filters and aggregates outside a source's whitelist are left out with a warning, as are
bad operands; a spec never fails. Days are half-open time ranges, so filters reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import ACCENTS
from ledgerloom.sources import files

DEFAULT_LIMIT, MAX_LIMIT, MAX_LATEST = 30, 200, 50
# Marks of an invalid deposit.
INVALID_MARKS = ("error", "invalida", "incorrect", "no identificada")
READ_ONLY_FIELDS = {"id", "created_at", "updated_at"}
REDUCED_OPS = {"eq", "ne", "in", "gt", "gte", "lt", "lte", "contains", "icontains", "isnull", "date_eq", "date_gte", "date_lte", "in_last_days"}


@dataclass
class Source:
    """A table with its whitelist: names that specs use, and the expressions they stand for."""

    frame: DataFrame
    fields: dict[str, str]
    default_select: tuple[str, ...] = ("id", "created_at")
    default_order: tuple[str, ...] = ("id",)
    warnings: list[str] = field(default_factory=list)


def _day(value, as_of: date) -> date:
    return {"today": as_of, "yesterday": as_of - timedelta(days=1)}.get(value) or (value if isinstance(value, date) else date.fromisoformat(str(value)[:10]))


def _at(d: date) -> Column:
    return F.lit(d.isoformat()).cast("timestamp")


def filter_ops(as_of: date) -> dict[str, Callable[[Column, object], Column]]:
    """Operators by name. ne and not_in keep null rows."""
    text = lambda c: c.cast("string")
    low = lambda c: F.lower(c.cast("string"))
    one = timedelta(days=1)

    def between(c: Column, v) -> Column:
        a, b = v
        return c.between(a, b)

    return {
        "eq": lambda c, v: c.isNull() if v is None else c == v, "ne": lambda c, v: ~c.eqNullSafe(v),
        "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~F.coalesce(c.isin(*v), F.lit(False)),
        "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "between": between,
        "contains": lambda c, v: text(c).contains(v), "icontains": lambda c, v: low(c).contains(str(v).lower()),
        "startswith": lambda c, v: text(c).startswith(v), "istartswith": lambda c, v: low(c).startswith(str(v).lower()),
        "endswith": lambda c, v: text(c).endswith(v), "iendswith": lambda c, v: low(c).endswith(str(v).lower()),
        "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
        "date_eq": lambda c, v: (c >= _at(_day(v, as_of))) & (c < _at(_day(v, as_of) + one)),
        "date_gte": lambda c, v: c >= _at(_day(v, as_of)), "date_lte": lambda c, v: c < _at(_day(v, as_of) + one),
        "in_last_days": lambda c, v: c >= _at(as_of - timedelta(days=min(3650, max(0, int(v))))),
    }


def _element_test(op: Callable, value) -> Callable[[Column], Column]:
    return lambda x: op(x, value)


def predicate(source: Source, filters: list[dict], as_of: date, allowed: set[str] | None = None, strict: bool = False) -> Column:
    """All filters that can be applied, and-ed. Array fields match if any element does. strict: one that cannot be applied raises ValueError."""
    ops, out = filter_ops(as_of), F.lit(True)
    types = dict(source.frame.dtypes)
    for f in filters or []:
        name, op = f.get("field"), f.get("op")
        if name not in source.fields or op not in ops or (allowed and op not in allowed):
            if strict:
                raise ValueError(f"filter not allowed: {name} {op}")
            source.warnings.append(f"filter ignored: {name} {op}")
            continue
        column = source.fields[name]
        try:
            if types.get(column, "").startswith("array"):
                out = out & F.exists(column, _element_test(ops[op], f.get("value")))
            else:
                out = out & ops[op](F.col(column), f.get("value"))
        except (TypeError, ValueError) as error:
            if strict:
                raise ValueError(f"filter not allowed: {name} {op}: {error}") from error
            source.warnings.append(f"filter ignored: {name} {op}: {error}")
    return out


def clamp_limit(value) -> int:
    try:
        return max(1, min(MAX_LIMIT, int(value)))
    except (TypeError, ValueError):
        return DEFAULT_LIMIT


AGGREGATES = {"count": F.count, "distinct_count": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def run_query(source: Source, spec: dict, as_of: date) -> DataFrame:
    """The rows of a spec. Every order ends in the id, so a limit always cuts at the same place."""
    frame = source.frame.filter(predicate(source, spec.get("filters"), as_of))
    known = lambda names: [n for n in names or [] if n in source.fields or source.warnings.append(f"field ignored: {n}")]
    groups = known(spec.get("group_by"))
    aggregates = []
    for a in spec.get("aggregations") or []:
        kind, name = a.get("type"), a.get("field") or "id"
        if kind == "count" and not a.get("field") and name not in source.fields:
            aggregates.append(F.count("*").alias(a.get("alias") or "count_id"))
        elif kind in AGGREGATES and name in source.fields:
            aggregates.append(AGGREGATES[kind](source.fields[name]).alias(a.get("alias") or f"{kind}_{name}"))
        else:
            source.warnings.append(f"aggregation ignored: {kind} {name}")
    if groups:
        frame = frame.groupBy(*[F.col(source.fields[g]).alias(g) for g in groups]).agg(*(aggregates or [F.count("*").alias("rows_count")]))
    elif aggregates:
        return frame.agg(*aggregates)
    order, names = [], [] if groups else list(source.fields)
    for o in spec.get("order_by") or []:
        name, desc = o.lstrip("-"), o.startswith("-")
        if name in (frame.columns if groups else names):
            c = F.col(name if groups else source.fields[name])
            order.append(c.desc() if desc else c.asc())
        else:
            source.warnings.append(f"order ignored: {name}")
    tail = groups if groups else [source.fields[n] for n in (*(() if order else source.default_order), "id") if n in source.fields]
    frame = frame.orderBy(*order, *tail)
    if "limit" in spec or not groups:
        frame = frame.limit(clamp_limit(spec.get("limit")))
    if groups:
        return frame
    chosen = known(spec.get("select")) or [n for n in source.default_select if n in source.fields] or list(source.fields)
    return frame.select(*[F.col(source.fields[c]).alias(c) for c in chosen])


def valid_deposits(deposits: DataFrame) -> DataFrame:
    """Without rows whose observations, accents folded, speak of an error."""
    text = F.lower(F.translate(F.array_join("observations", " "), *ACCENTS))
    bad = F.lit(False)
    for mark in INVALID_MARKS:
        bad = bad | text.contains(mark)
    return deposits.filter(~F.coalesce(bad, F.lit(False)))


def today_or_all_valid(deposits: DataFrame, as_of: date) -> DataFrame:
    """Valid deposits of the day; if it has none, all valid ones. One scalar count gates both branches."""
    valid = valid_deposits(deposits)
    today = filter_ops(as_of)["date_eq"](F.col("created_at"), as_of)
    n = valid.filter(today).agg(F.count("*")).scalar()
    return valid.filter((n == 0) | today)


def period(name: str, as_of: date, **more) -> tuple[date, date]:
    """First and last day of a preset period."""
    first = as_of.replace(day=1)
    month_end = lambda y, m: (date(y + m // 12, m % 12 + 1, 1) - timedelta(days=1))
    if name == "current_month":
        return first, as_of
    if name == "previous_month":
        last = first - timedelta(days=1)
        return last.replace(day=1), last
    if name == "this_year":
        return as_of.replace(month=1, day=1), as_of
    if name == "named_month":
        year = more.get("year") or as_of.year
        return date(year, more["month"], 1), month_end(year, more["month"])
    if name == "between":
        return min(more["start"], more["end"]), max(more["start"], more["end"])
    if name == "exact_day":
        return more["day"], more["day"]
    raise ValueError(f"no such period: {name}")


#: Periods that go by the day of the deposit; all others go by when it was stored.
BY_DEPOSIT = {"current_month", "previous_month", "last_30_days"}


def period_filters(name: str, as_of: date, **more) -> list[dict]:
    """A preset period as filters of a query spec."""
    column = "fecha_date" if name in BY_DEPOSIT else "created_at"
    if name in ("last_7_days", "last_30_days"):
        return [{"field": column, "op": "in_last_days", "value": int(name.split("_")[1])}]
    start, end = period(name, as_of, **more)
    return [{"field": column, "op": "date_gte", "value": start}, {"field": column, "op": "date_lte", "value": end}]


def in_period(frame: DataFrame, name: str, as_of: date, **more) -> DataFrame:
    source = Source(frame, {"fecha_date": "fecha_date", "created_at": "created_at"})
    return frame.filter(predicate(source, period_filters(name, as_of, **more), as_of, strict=True))


def amount_number(text) -> int:
    """A whole amount with its marks taken out."""
    return int(re.sub(r"[^0-9]", "", str(text)))


def amount_filters(kind: str, text) -> list[dict]:
    """kind: gt, lt, eq or near (within a tenth)."""
    n = amount_number(text)
    if kind == "near":
        off = max(1, int(n * 0.1))
        return [{"field": "valor", "op": "between", "value": [max(0, n - off), n + off]}]
    return [{"field": "valor", "op": kind, "value": n}]


def observation_filters(kind: str) -> list[dict]:
    """kind: fecha, valor, referencia, or error for any."""
    if kind not in ("fecha", "valor", "referencia", "error"):
        raise ValueError(f"no such kind of observation: {kind}")
    return [{"field": "observations", "op": "icontains", "value": kind}]


def preset(name: str, n: int = 10) -> dict:
    """The spec of a preset question over deposits; filters may be added to it."""
    newest, dearest = ["-created_at"], ["-valor"]
    detail = ["id", "referencia", "valor", "fecha_consignacion", "created_at"]
    total, count = {"type": "sum", "field": "valor", "alias": "total_valor"}, {"type": "count", "field": "id", "alias": "total_transacciones"}
    specs = {
        "total_value": {"aggregations": [total]}, "average_value": {"aggregations": [{"type": "avg", "field": "valor", "alias": "promedio_valor"}]}, "count_records": {"aggregations": [count]},
        "group_by_day": {"group_by": ["fecha_date"], "aggregations": [count, total], "order_by": ["-fecha_date"], "limit": 60},
        "highest_value": {"select": detail, "order_by": dearest, "limit": 1}, "lowest_value": {"select": detail, "order_by": ["valor"], "limit": 1}, "top_n_value": {"select": detail, "order_by": dearest, "limit": n},
        "latest_n": {"select": detail, "order_by": newest, "limit": max(1, min(MAX_LATEST, n))}, "all_deposits": {"select": detail, "order_by": newest, "limit": MAX_LIMIT},
    }
    return specs[name]


def day_totals(deposits: DataFrame) -> DataFrame:
    """Deposits stored per day, and their sum."""
    return deposits.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.sum("valor").alias("total"))


def amount_near(column: Column, value: int) -> Column:
    """Within a tenth of value, at least 1, never below 0."""
    off = max(1, int(value * 0.1))
    return column.between(max(0, value - off), value + off)


def reference_lookup(frame: DataFrame, text: str) -> DataFrame:
    """Rows whose reference holds the text, which must have four characters at least."""
    return frame.filter(F.lower("referencia").contains(text.lower()) if len(text) >= 4 else F.lit(False))


def create_rows(frame: DataFrame, new: DataFrame, as_of: date) -> DataFrame:
    """frame with the rows of new. Ids go on behind the largest one, created_at is as_of; what new says about the columns that no one may write is not taken."""
    start = F.coalesce(frame.agg(F.max("id")).scalar(), F.lit(0))
    made = new.drop(*READ_ONLY_FIELDS).withColumn("id", start + 1 + F.monotonically_increasing_id())
    if "created_at" in frame.columns:
        made = made.withColumn("created_at", _at(as_of).cast(dict(frame.dtypes)["created_at"]))
    return frame.unionByName(made.select(*[c for c in made.columns if c in frame.columns]), allowMissingColumns=True)


def _hit(source: Source, filters: list[dict], as_of: date) -> Column:
    """Rows for which all filters hold; no filter at all, or one that is not known, raises ValueError."""
    if not filters:
        raise ValueError("a write needs a filter")
    return F.coalesce(predicate(source, filters, as_of, REDUCED_OPS, strict=True), F.lit(False))


def update_rows(source: Source, filters: list[dict], values: dict, as_of: date) -> DataFrame:
    """The table with writable fields set where all filters hold; a column `_updated` says where. A filter that is not known raises ValueError, as do no filter and no writable value."""
    hit = _hit(source, filters, as_of)
    types = dict(source.frame.dtypes)
    ok = {k: v for k, v in values.items() if k in source.fields and k not in READ_ONLY_FIELDS}
    source.warnings += [f"field not writable: {k}" for k in values if k not in ok]
    if not ok:
        raise ValueError("an update needs a value that may be written")
    return source.frame.withColumns({source.fields[k]: F.when(hit, F.lit(v).cast(types[source.fields[k]])).otherwise(F.col(source.fields[k])) for k, v in ok.items()} | {"_updated": hit})


def delete_rows(source: Source, filters: list[dict], as_of: date) -> DataFrame:
    """The table without the rows for which all filters hold; rows with unknown outcome stay. A filter that is not known raises ValueError, as does no filter."""
    return source.frame.filter(~_hit(source, filters, as_of))


class Versions:
    """A table as a folder of versions: each write makes the next one, readers see the last whole one.

    A version is a folder v=<number> that Spark has marked as done, so a write that failed half-way is never
    read, and its number is taken anew. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> int | None:
        found = files.matching(self.spark, f"{self.path}/v=*/_SUCCESS")
        return max((int(re.search(r"/v=(\d+)/_SUCCESS$", f)[1]) for f in found), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.last() if version is None else version
        if version is None:
            raise ValueError(f"no table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={version}")

    def _write(self, frame: DataFrame, count: Column) -> int:
        """Writes the next version; returns the count that was observed on the way."""
        last, seen = self.last(), Observation()
        frame = frame.observe(seen, count.alias("n"))
        frame.drop("_counted").write.mode("overwrite").parquet(f"{self.path}/v={0 if last is None else last + 1}")
        return seen.get["n"]

    def create(self, rows: DataFrame) -> int:
        return self._write(rows, F.count("*"))

    def add(self, new: DataFrame, as_of: date) -> int:
        """Rows of new behind those of the table; how many."""
        old = self.read()
        made = create_rows(old.withColumn("_counted", F.lit(False)), new, as_of)
        return self._write(made, F.count_if(F.col("_counted").isNull()))

    def update(self, fields: dict[str, str], filters: list[dict], values: dict, as_of: date) -> int:
        """How many rows the values were set in."""
        changed = update_rows(Source(self.read(), fields), filters, values, as_of).withColumnRenamed("_updated", "_counted")
        return self._write(changed, F.count_if("_counted"))

    def delete(self, fields: dict[str, str], filters: list[dict], as_of: date) -> int:
        """How many rows are gone."""
        source = Source(self.read(), fields)
        before = Observation()
        hit = _hit(source, filters, as_of)
        source.frame = source.frame.observe(before, F.count_if(hit).alias("n"))
        self._write(source.frame.filter(~hit), F.count("*"))
        return before.get["n"]
