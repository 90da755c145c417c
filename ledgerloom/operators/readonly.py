"""Read-only SQL over given frames: a statement is judged by the plan that Spark's parser makes of it, not by its words.

Every node of the plan, of its subqueries and of its common table expressions must be of a kind listed here;
every relation must be one of the given names or a common table expression; function must be
listed. So commands, files read by path (text.`/x`), table functions, calls into the JVM and statements
behind a semicolon are refused, and a literal or a column may hold word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

DEFAULT_ROWS = 100
#: Kinds of plan nodes that only read and compute.
NODES = frozenset(
    "Aggregate Distinct Except Filter GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project Sort SubqueryAlias Union "
    "UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition".split())
#: Functions by what they are about: none reads a file, calls other code, or differs from call to call.
FUNCTIONS = frozenset(
    ("any any_value array_agg avg bool_and bool_or collect_list collect_set count count_if every first first_value last last_value listagg max max_by mean median min min_by mode "
     "percentile approx_count_distinct stddev stddev_pop stddev_samp string_agg sum try_avg try_sum var_pop var_samp variance "
     "dense_rank lag lead rank row_number "
     "abs ceil ceiling div exp floor greatest least ln log log10 log2 mod negative pmod positive pow power round sign signum sqrt try_add try_divide try_multiply try_subtract "
     "ascii character_length concat concat_ws contains endswith format_number format_string initcap instr left length locate lower lpad ltrim md5 position "
     "regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rlike rpad rtrim sha1 sha2 split split_part startswith substr substring substring_index translate trim upper "
     "add_months date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear extract from_unixtime hour last_day make_date minute month months_between next_day quarter second "
     "to_date to_timestamp trunc try_to_date try_to_timestamp unix_timestamp weekday weekofyear window year "
     "coalesce if ifnull isnan isnotnull isnull nanvl nullif nvl nvl2 when case cast try_cast bigint boolean date decimal double float int string timestamp typeof to_number try_to_number to_char "
     "aggregate array array_contains array_distinct array_join array_max array_min array_position array_size array_sort element_at exists filter forall get get_json_object map named_struct "
     "reduce size slice sort_array struct transform try_element_at").split())


def _all(items: JavaObject) -> Iterator[JavaObject]:
    """The elements of a Scala collection."""
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Gate:
    def __init__(self, spark: SparkSession, names: set[str]):
        self.jvm, self.names = spark.sparkContext._jvm, {n.lower() for n in names}
        self.subquery = self.jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def plan(self, node: JavaObject, known: frozenset[str]) -> None:
        """Raises ValueError at the first thing that is not allowed. known: common table expressions in scope."""
        kind = _kind(node)
        if kind not in NODES:
            raise ValueError(f"not allowed in a read-only statement: {kind}")
        if kind == "UnresolvedWith":
            for pair in _all(node.cteRelations()):
                # A recursive expression may name itself.
                name = pair._1().lower()
                self.plan(pair._2(), known | {name} if node.allowRecursion() else known)
                known = known | {name}
            self.plan(node.child(), known)
            return
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _all(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in self.names | known:
                raise ValueError(f"no such relation: {'.'.join(parts)}")
        for e in _all(node.expressions()):
            self.expression(e, known)
        for child in _all(node.children()):
            self.plan(child, known)

    def expression(self, e: JavaObject, known: frozenset[str]) -> None:
        if self.subquery.isInstance(e):
            self.plan(e.plan(), known)
        if _kind(e) == "UnresolvedFunction":
            parts = [p.lower() for p in _all(e.nameParts())]
            if len(parts) != 1 or parts[0] not in FUNCTIONS:
                raise ValueError(f"function not allowed: {'.'.join(parts)}")
        for child in _all(e.children()):
            self.expression(child, known)


def check_readonly(spark: SparkSession, sql: str, names: set[str]) -> str:
    """The statement without a closing semicolon, if its plan only reads the relations `names`; else ValueError."""
    body = sql.strip().rstrip(";").strip()
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except ParseException as error:
        raise ValueError(f"not one SQL statement: {error}") from error
    _Gate(spark, names).plan(parsed, frozenset())
    return body


def readonly_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int = DEFAULT_ROWS, args: dict | None = None) -> DataFrame:
    """At most `limit` rows (1 at least) of a checked statement over the frames in views.

    The names hold for this statement alone: views of the session are neither seen nor replaced, and
    none stays behind. Order by of the statement decides which rows these are.
    """
    body = check_readonly(spark, sql, set(views))
    own = {name: f"ledgerloom_{uuid.uuid4().hex}" for name in views}
    try:
        for name, frame in views.items():
            frame.createOrReplaceTempView(own[name])
        given = ", ".join(f"`{name}` AS (SELECT * FROM {hidden})" for name, hidden in own.items())
        whole = f"WITH {given} SELECT * FROM ({body}\n)" if given else body
        return spark.sql(whole, args=args or {}).limit(max(1, int(limit)))
    finally:
        for hidden in own.values():
            spark.catalog.dropTempView(hidden)
