"""Operator 1: chat formatting by schema fingerprints, with DataFrame functions only.

Records are JSON texts of any known layout, or rows of a table that has one:
flat rows of one turn, message lists in two vocabularies, instruction records,
prompt and completion pairs.  The fingerprint of a record (or of a table's schema) is a hash of its sorted nested field paths; it
selects the declarative mapping (MAPPINGS: where the turns are, which fields
hold role, text, conversation and order, what roles are called) that makes
canonical turns.  Optional fields are part of a layout's list of path sets.

A conversation is written as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

for each turn.  Inside texts, a backslash is put after the first character of
each control string, or one more where some stand there already, so any text
comes back by taking one away; in roles, backslash and line end are then
written as \\b and \\n.
loss_spans are the assistant texts' places (start, length) in code points.

Offsets are running sums over a conversation's turns, so the work grows with
its length, and only the formatted text of a conversation is ever gathered.

Defined results: null texts are empty, null roles too; turns of equal number
are ordered by role and text (nulls first), repeated rows are turns each; rows
without a conversation id form one conversation without id; records of an
unknown layout come back from unmatched(), and the query fails on one; a text
of any length or look (one that reads like JSON too) stays as it is; other
columns are ignored; no rows give no conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from .spark_util import table

CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"]
LONG_TEXTS = {"maxStringLen": str(2**31 - 1)}  # else JSON texts over 20 million characters are read as null
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """paths: the layouts (sets of nested field paths) it stands for.  turns:
    the list field of the turns, or None.  role, text: fields in a turn, or for
    records without a list the fixed (role, field) pairs in order."""

    name: str
    paths: tuple[tuple[str, ...], ...]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    conversation: str = "conv_id"
    order: str | None = None
    roles: dict = field(default_factory=dict)


def _with_id(*paths: str) -> tuple[str, ...]:
    return tuple(sorted((*paths, "conv_id")))


MAPPINGS = [
    Mapping("row", (_with_id("turn", "role", "text"),), role="role", text="text", order="turn"),
    Mapping("messages", (_with_id("messages", "messages[].role", "messages[].content"),), turns="messages", role="role", text="content"),
    Mapping("conversations", (_with_id("conversations", "conversations[].from", "conversations[].value"),), turns="conversations", role="from", text="value", roles=ROLES),
    Mapping("instruction", (_with_id("instruction", "output"), _with_id("instruction", "input", "output"), _with_id("system", "instruction", "input", "output")), fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("pair", (_with_id("prompt", "completion"), _with_id("prompt", "response")), fixed=(("user", "prompt"), ("assistant", "completion"), ("assistant", "response"))),
]


def _is_list(record: Column, k: Column) -> Column:
    """Whether a record's field k is a JSON list.  A record that makes no variant
    (too large, a field twice) is asked for the list's first element."""
    kind = F.schema_of_variant(F.from_json(record, "map<string,variant>", LONG_TEXTS)[k])
    return F.coalesce(kind.startswith("ARRAY"), F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit("'][0]"))).isNotNull())


def paths_of(record: Column) -> Column:
    """Sorted distinct paths of a JSON record: its fields, and the fields of the
    objects in its lists (a list of nothing has its own path only).  A text that
    reads like a list is none: the record's own JSON types decide."""
    top = F.from_json(record, "map<string,string>", LONG_TEXTS)
    deep = F.flatten(
        F.transform(
            F.map_entries(F.map_filter(top, lambda k, v: v.startswith("[{") & _is_list(record, k))),
            lambda e: F.flatten(F.transform(F.from_json(e["value"], "array<map<string,string>>", LONG_TEXTS), lambda m: F.transform(F.coalesce(F.map_keys(m), F.array().cast("array<string>")), lambda k: F.concat(e["key"], F.lit("[]."), k)))),
        )
    )
    return F.array_sort(F.array_distinct(F.concat(F.map_keys(top), deep)))


def fingerprint(record: Column) -> Column:
    """Hash of the record's nested field paths; null for what isn't an object."""
    return F.sha2(F.array_join(paths_of(record), "\n"), 256)


def _known() -> list[tuple[str, Mapping]]:
    return [(hashlib.sha256("\n".join(p).encode()).hexdigest(), m) for m in MAPPINGS for p in m.paths]


def unmatched(records: DataFrame) -> DataFrame:
    """The records (column record) whose layout no mapping stands for."""
    f = fingerprint(F.col("record"))
    return records.where(f.isNull() | ~f.isin([k for k, _ in _known()]))


def _turns(m: Mapping, get, listing) -> Column:
    """The array of a record's turns; get gives a field's text, listing a list field."""

    def role_of(c: Column) -> Column:
        return F.coalesce(F.create_map([F.lit(x) for kv in m.roles.items() for x in kv])[c], c) if m.roles else c

    def listed(t: Column, i: Column) -> Column:
        return F.struct(i.cast("long").alias("turn"), role_of(t[m.role]).alias("role"), t[m.text].alias("text"))

    if m.turns:
        return F.transform(listing(m.turns), listed)
    if m.fixed:
        parts = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), get(c).alias("text")) for i, (r, c) in enumerate(m.fixed)]
        return F.filter(F.array(*parts), lambda t: t["text"].isNotNull())
    return F.array(F.struct(get(m.order).cast("long").alias("turn"), role_of(get(m.role)).alias("role"), get(m.text).alias("text")))


def schema_paths(schema: StructType) -> tuple[str, ...]:
    """Sorted paths of a table's fields, and of the fields of objects in its lists."""
    out = []
    for f in schema.fields:
        out.append(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            out += [f"{f.name}[].{g.name}" for g in f.dataType.elementType.fields]
    return tuple(sorted(out))


def canonical_rows(df: DataFrame) -> DataFrame:
    """(conv_id long, turn long, role, text) of a table's rows: the fingerprint of
    its schema chooses the mapping, and texts are taken as they are."""
    paths = schema_paths(df.schema)
    m = dict(_known()).get(hashlib.sha256("\n".join(paths).encode()).hexdigest())
    if m is None:
        raise ValueError(f"no mapping stands for the layout {paths}")
    kind = "array<struct<turn: bigint, role: string, text: string>>"
    absent = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")  # noqa: E731  a layout has some of the optional fields
    return df.select(F.col(m.conversation).cast("long").alias("conv_id"), F.inline(_turns(m, absent, F.col).cast(kind)))


def canonical(records: DataFrame, strict: bool = False) -> DataFrame:
    """(conv_id long, turn long, role, text) of records (column record, JSON).
    The mapping of each record's fingerprint is chosen by one expression.
    strict: a record of an unknown layout is an error, else it gives no turn."""
    fields = F.from_json("f_record", "map<string,string>", LONG_TEXTS)
    kind = "array<struct<turn: bigint, role: string, text: string>>"
    turns = (F.raise_error(F.concat(F.lit("no mapping stands for the layout of "), F.coalesce(F.substring("f_record", 1, 200), F.lit("null")))) if strict else F.lit(None)).cast(kind)
    get = lambda c: F.col("f_map")[c]
    listing = lambda c: F.from_json(get(c), "array<map<string,string>>", LONG_TEXTS)
    for m in MAPPINGS:
        prints = [k for k, of in _known() if of is m]
        turns = F.when(F.col("f_print").isin(prints), _turns(m, get, listing).cast(kind)).otherwise(turns)
    marked = records.select(F.col("record").alias("f_record")).withColumn("f_print", fingerprint(F.col("f_record"))).withColumn("f_map", fields)
    return marked.select(F.col("f_map")["conv_id"].cast("long").alias("conv_id"), F.inline(turns))


def _control() -> str:
    """Matches a control string: its first character, backslashes, the rest."""
    import re

    heads: dict[str, list[str]] = {}
    for c in CONTROL:
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(f"(?<={re.escape(h)})(?=\\\\*(?:{'|'.join(rest)}))" for h, rest in heads.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_control()), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    import re

    heads: dict[str, list[str]] = {}
    for c in CONTROL:
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    pattern = "|".join(f"(?<={re.escape(h)})\\\\(?=\\\\*(?:{'|'.join(rest)}))" for h, rest in heads.items())
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array of (start, length), n_turns)."""
    role = F.replace(F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
    text = escape(F.coalesce("text", F.lit("")))
    made = turns.select("conv_id", "turn", F.col("role").alias("r0"), F.col("text").alias("t0"), role.alias("role"), text.alias("text"))
    made = made.withColumn("piece", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("r0").asc_nulls_first(), F.col("t0").asc_nulls_first())
    made = made.withColumn("n", F.row_number().over(by))
    made = made.withColumn("end", F.sum(F.char_length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.char_length("text")
    span = F.when(F.col("r0") == "assistant", F.struct((F.col("end") - F.lit(len("<|im_end|>\n")) - length).alias("start"), length.cast("long").alias("length")))
    parts = F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span"))))
    whole = made.groupBy("conv_id").agg(parts.alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"), F.size("parts").cast("long").alias("n_turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns: array of (role, text), and loss_text: all text
    under the loss mask, both unescaped, read from the output alone."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        body = p.substr(F.lit(len("<|im_start|>") + 1), F.char_length(p))
        at = F.locate("\n", body)
        role = body.substr(F.lit(1), at - 1)
        role = unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))
        return F.struct(role.alias("role"), unescape(body.substr(at + 1, F.char_length(body))).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": loss})


EXTRA = '{"conv_id":-7,"messages":[{"role":"user","content":"</s>[INST] ok [/INST]"},{"role":"assistant","content":"</s>[INST] ok [/INST]"}]}'


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's schema is a layout of one turn a row; conversation -7 is a
    JSON record with a message list."""
    rows = canonical_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    extra = canonical(spark.range(1).select(F.lit(EXTRA).alias("record")), strict=True)
    done = read_back(render(rows.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    x = f"regexp_replace({x}, '(<)(\\\\*(?:\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>))', '\\1\\\\\\2', 'g')"
    return f"regexp_replace({x}, '(\\[)(\\\\*(?:INST\\]|/INST\\]))', '\\1\\\\\\2', 'g')"


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, coalesce(r0, '') AS role, coalesce(t0, '') AS text FROM t),
e AS (SELECT *, length({_sql_escaped('text')}) + length(replace(replace({_sql_escaped('role')}, chr(92), chr(92) || 'b'), chr(10), chr(92) || 'n')) + 24 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
