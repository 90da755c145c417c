"""Chat formatting: records of several layouts become canonical turns, turns become one marked text with a loss mask.

A record's fingerprint is a hash of the nested field paths that hold a value in it. It selects one
of the declared layouts, each a mapping from paths to turns. The template marks turns with control
strings; where a text holds a control string itself, an escape character is put behind its first
character, one more than stand there already, so that reading back takes exactly one away.

Defined results: null text and null role are empty strings; rows of a conversation go by turn,
null turns first, equal turns by role and text; a null conv_id is a conversation of its own;
repeated rows are repeated turns; a record no layout fits has layout null and no turns; an empty
table gives no rows. A conversation is one output value, so its turns meet in one row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import fresh, table

START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPE = "␛"
#: What may not stand in a text unescaped: first character, then the rest.
CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """A declared mapping. Either `items` names an array with a role and a text field, or `parts` lists (role, path) in order."""

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def shapes(self) -> list[list[str]]:
        """The sets of paths that select this layout: with and without each optional one."""
        if self.items:
            return [sorted([f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"])]
        fixed = [p for _, p in self.parts if p not in self.optional]
        return [sorted([*fixed, *more]) for n in range(len(self.optional) + 1) for more in itertools.combinations(self.optional, n)]

    def turns(self) -> Column:
        if self.items:
            def one(m: Column) -> Column:
                role = m[self.role]
                for theirs, ours in self.roles.items():
                    role = F.when(m[self.role] == theirs, F.lit(ours)).otherwise(role)
                return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))
            return F.transform(F.col(self.items), one)
        listed = F.array(*[F.struct(F.lit(role).alias("role"), F.col(path).alias("text")) for role, path in self.parts])
        return F.filter(listed, lambda t: t["text"].isNotNull())


LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content"),
    Layout("sharing", items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("instruction", parts=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("task", parts=(("user", "instruction"), ("assistant", "output"))),
)


def field_paths(schema: T.StructType, only: set[str] | None = None) -> list[tuple[str, Column]]:
    """(path, holds a value) for the leaves of a schema; array elements are written []."""
    out: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, present) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", lambda test, f=f, up=present: up(lambda v: test(v[f.name])))
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]", lambda test, up=present: up(lambda v: F.coalesce(F.exists(v, test), F.lit(False))))
        else:
            out.append((path, F.coalesce(present(lambda v: v.isNotNull()), F.lit(False))))

    for f in schema.fields:
        if only is None or f.name in only:
            walk(f.dataType, f.name, lambda test, f=f: test(F.col(f"`{f.name}`")))
    return sorted(out, key=lambda x: x[0])


def fingerprint(df: DataFrame, columns: set[str] | None = None) -> Column:
    """Hash of the sorted paths that hold a value in the row."""
    return F.xxhash64(F.concat_ws(" ", *[F.when(there, F.lit(path)) for path, there in field_paths(df.schema, columns)]))


def canonical_turns(records: DataFrame, columns: set[str] | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with `layout` and `turns`, array of (role, text). columns: those that make up a record, else all.

    Where records have columns of these names, the new ones get underscores in front.
    """
    name_layout, name_turns, layout_print = fresh(records, "layout", "turns", "layout_print")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    have = {path for path, _ in field_paths(records.schema, columns)}
    marked = records.withColumn(layout_print, fingerprint(records, columns))
    for one in reversed(layouts):
        shapes = [s for s in one.shapes() if set(s) <= have]
        if shapes:
            chosen = F.col(layout_print).isin([F.xxhash64(F.lit(" ".join(s))) for s in shapes])
            missing = [p for _, p in one.parts if p not in have]
            kept = one if not missing else Layout(one.name, parts=tuple(x for x in one.parts if x[1] in have))
            layout, turns = F.when(chosen, F.lit(one.name)).otherwise(layout), F.when(chosen, kept.turns()).otherwise(turns)
    return marked.withColumns({name_layout: layout, name_turns: F.coalesce(turns, F.array().cast(f"array<{TURN}>"))}).drop(layout_print)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({ESCAPE}*){CONTROL}", f"$1$2{ESCAPE}$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({ESCAPE}*){ESCAPE}{CONTROL}", "$1$2$3")


def format_turns(df: DataFrame, trained: tuple[str, ...] = ("assistant",), turns: str = "turns") -> DataFrame:
    """df with `segments`, array of (text, loss), and `formatted`, their concatenation. turns: the column with the turns.

    Where df has columns of these names, the new ones get underscores in front. Segments are the loss mask in runs: loss is true for the texts of the trained roles and for
    nothing else. Roles are URL-encoded, so that none can hold a line break or a control string.
    """
    def segments(t: Column) -> Column:
        head = F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*trained).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )
    name_segments, name_formatted = fresh(df, "segments", "formatted")
    out = df.withColumn(name_segments, F.flatten(F.transform(turns, segments)))
    return out.withColumn(name_formatted, F.array_join(F.transform(name_segments, lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    def one(b: Column) -> Column:
        role = F.url_decode(F.regexp_extract(b, r"^<\|im_start\|>([^\n]*)\n", 1))
        return F.struct(role.alias("role"), unescape(F.regexp_replace(b, r"^<\|im_start\|>[^\n]*\n", "")).alias("text"))
    return F.transform(blocks, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as one record per conversation, in the layout that what they hold is usually kept in.

    One exchange is a prompt record if the user asks a question, with its system text where there is
    one; else it is an instruction record with a system text and a task record without. Longer
    conversations in which user and assistant take turns go to the sharing layout, all others are message lists.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    g = rows.groupBy("conv_id").agg(ordered.alias("rows"))
    of = lambda role: F.get(F.filter("rows", lambda r: r["role"] == role), F.lit(0))["text"]
    roles = F.array_join(F.transform("rows", lambda r: F.url_encode(r["role"])), " ")
    by_turns = F.forall(F.transform("rows", lambda r, i: r["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    once, asked = roles.isin("user assistant", "system user assistant"), of("user").rlike(r"\?\s*$")
    kind = F.when(once & asked, "prompt").when(roles == "system user assistant", "instruction").when(once, "task").when(by_turns, "sharing").otherwise("messages")
    g = g.withColumn("kind", kind)
    when = lambda value, *kinds: F.when(F.col("kind").isin(*kinds), value)
    theirs = lambda r: F.when(r["role"] == "user", "human").when(r["role"] == "assistant", "gpt").otherwise(r["role"])
    return g.select(
        "conv_id",
        when(of("system"), "prompt").alias("system"), when(of("user"), "prompt").alias("prompt"), when(of("assistant"), "prompt").alias("response"),
        F.coalesce(when(of("system"), "instruction"), when(of("user"), "task")).alias("instruction"), when(of("user"), "instruction").alias("input"), when(of("assistant"), "instruction", "task").alias("output"),
        when(F.transform("rows", lambda r: F.struct(theirs(r).alias("from"), r["text"].alias("value"))), "sharing").alias("conversations"),
        when(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content"))), "messages").alias("messages"),
    )


RECORD = {"system", "prompt", "response", "instruction", "input", "output", "conversations", "messages"}


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    done = format_turns(canonical_turns(records_of(rows.unionByName(extra)), RECORD))
    back = done.select("conv_id", "layout", "formatted", loss_text(F.col("segments")).alias("loss"), read_turns(F.col("formatted")).alias("back"))
    joined = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), gathered AS (
  SELECT conv_id, string_agg(url_encode(role), ' ' ORDER BY turn NULLS FIRST, role, text) AS roles, arg_min(text, struct_pack(a := turn IS NOT NULL, b := turn, c := text)) FILTER (WHERE role = 'user') AS first_user FROM t GROUP BY conv_id
), chosen AS (
  SELECT conv_id, CASE WHEN roles IN ('user assistant', 'system user assistant') AND regexp_matches(first_user, '\?\s*$') THEN 'prompt' WHEN roles = 'system user assistant' THEN 'instruction' WHEN roles = 'user assistant' THEN 'task'
         WHEN regexp_full_match(roles, '(user assistant )*user( assistant)?') THEN 'sharing' ELSE 'messages' END AS layout FROM gathered
)
SELECT t.conv_id, any_value(layout) AS layout, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(url_encode(role)) + 1 + length(text) + 11
           + len(regexp_extract_all(text, '[<\[]␛*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)')))::BIGINT AS formatted_chars
FROM t JOIN chosen ON t.conv_id IS NOT DISTINCT FROM chosen.conv_id GROUP BY t.conv_id
"""
