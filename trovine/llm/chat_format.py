"""Chat formatting with linked tool calls. DataFrame and SQL functions only.

An assistant's message may be a JSON object with ``tool_calls``, an array of calls: id, name, arguments (an object, or JSON
in a string; both may stand in ``function``) and depends_on (ids of calls whose results it needs). A tool's message is a
JSON object with ``tool_call_id`` and ``content``. Calls and results are joined by (conversation, id); the calls of a
message are ordered so that each stands after those of the message that it depends on; arguments are checked against the
tools' schemas; all messages are serialised as canonical JSON: keys sorted, no white space, one form for equal values.

Nothing of a message is lost: keys without a meaning here stand under ``other``, and what is no such JSON stands as text.
Every order and join is on a bounded group: a message's own calls, the turns of a block, the messages of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Turns in one record of a conversation, and messages: a longer one is several records, so none grows without bound.
TURNS_PER_RECORD, MESSAGES_PER_RECORD = 256, 1024
#: A type named in a schema, and how Spark calls a JSON value of that type.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}
#: What identifies a call: conversation, turn, digest of the message, place in the message.
CALL = ["conv", "turn", "mid", "idx"]
COUNTS = ("n_calls", "n_linked", "n_invalid", "n_cyclic", "n_unmet")

_ELEMENT = """
transform(calls, x -> named_struct(
  'id', try_variant_get(x, '$.id', 'string'),
  'name', coalesce(try_variant_get(x, '$.name', 'string'), try_variant_get(x, '$.function.name', 'string')),
  'given', to_json(coalesce(try_variant_get(x, '$.arguments', 'variant'), try_variant_get(x, '$.function.arguments', 'variant'))),
  'inner', to_json(try_parse_json(coalesce(try_variant_get(x, '$.arguments', 'string'), try_variant_get(x, '$.function.arguments', 'string')))),
  'depends_on', coalesce(try_variant_get(x, '$.depends_on', 'array<string>'), array()),
  'other', coalesce(to_json(map_filter(try_cast(x AS map<string, variant>), (k, v) ->
     k NOT IN ('id', 'name', 'arguments') AND NOT (k = 'depends_on' AND try_variant_get(x, '$.depends_on', 'array<string>') IS NOT NULL))), to_json(x))))
"""
#: For each call of a message the calls of the message that it depends on.
_BEFORE = """
transform(calls, c -> filter(sequence(0, size(calls) - 1), j -> coalesce(array_contains(c.depends_on, calls[j].id), false)))
"""
#: Levels, -1 while not known; after as many steps as calls have dependencies in the message all that can be known are.
_LEVELS = """
aggregate(sequence(1, 1 + size(filter(before, b -> size(b) > 0))),
  struct(before AS b, transform(before, b -> if(size(b) = 0, 0, -1)) AS l),
  (acc, step) -> struct(acc.b AS b, transform(acc.l, (v, i) -> CASE WHEN v >= 0 THEN v WHEN exists(acc.b[i], j -> acc.l[j] < 0) THEN -1
    ELSE 1 + array_max(transform(acc.b[i], j -> acc.l[j])) END) AS l),
  acc -> acc.l)
"""


def json_text(column: str | Column) -> Column:
    """The JSON form of a string, with its quotes; 'null' for null."""
    whole = F.to_json(F.array(F.col(column) if isinstance(column, str) else column))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def json_list(column: str) -> Column:
    return F.coalesce(F.to_json(F.array_sort(F.col(column))), F.lit("[]"))


def parse_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with calls, their calls).

    The messages: conv_id, conv, turn, role, mid, content and other as JSON. The calls: ``CALL``, id, name, given (the
    arguments as JSON), arguments (the canonical object, null if they are none), depends_on, other, level (null in or after
    a cycle of the message), outside (ids it depends on that are no call of the message).
    """
    said = messages.withColumn("v", F.expr("try_parse_json(text)")).withColumn("calls", F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')"))
    said = said.where("size(calls) > 0")
    said = said.withColumn("calls", F.expr(_ELEMENT)).withColumn("before", F.expr(_BEFORE)).withColumn("levels", F.expr(_LEVELS))
    said = said.select(
        "conv_id", "conv", "turn", "role", F.md5("text").alias("mid"),
        F.coalesce(F.expr("to_json(try_variant_get(v, '$.content', 'variant'))"), F.lit("null")).alias("content"),
        F.expr("to_json(map_filter(try_cast(v AS map<string, variant>), (k, x) -> k NOT IN ('content', 'tool_calls')))").alias("other"),
        F.expr("""transform(calls, (c, i) -> named_struct('idx', i, 'id', c.id, 'name', c.name, 'given', coalesce(c.inner, c.given, 'null'),
          'arguments', CASE WHEN coalesce(c.inner, c.given) LIKE '{%' THEN coalesce(c.inner, c.given) END, 'depends_on', c.depends_on, 'other', c.other,
          'level', nullif(levels[i], -1), 'outside', array_except(c.depends_on, transform(calls, x -> x.id))))""").alias("calls"),
    )
    said = materialise(said, "called")
    return said.drop("calls"), said.select("conv", "turn", "mid", F.explode("calls").alias("c")).select("conv", "turn", "mid", "c.*")


def parse_results(messages: DataFrame) -> DataFrame:
    """conv, id, turn, result (canonical JSON): of several results for one id in one turn the least."""
    said = messages.withColumn("v", F.expr("try_parse_json(text)")).withColumn("id", F.expr("try_variant_get(v, '$.tool_call_id', 'string')")).where("id IS NOT NULL")
    content = F.expr("coalesce(to_json(try_parse_json(try_variant_get(v, '$.content', 'string'))), to_json(try_variant_get(v, '$.content', 'variant')), 'null')")
    return said.select("conv", "id", "turn", content.alias("result")).groupBy("conv", "id", "turn").agg(F.min("result").alias("result"))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``CALL`` and result of the calls that have one: the next result with the call's id, in the call's turn or later, if
    no other call has taken the id before it. Of equal ids in one turn the first call is linked.

    One row per (conversation, id, turn) is left before anything is ordered; the next row is looked up inside a block of
    turns, and from the first rows of blocks where a block ends.
    """
    none = F.lit(None)
    call = F.struct("mid", "idx")
    asked = calls.where("id IS NOT NULL").select("conv", "id", "turn", call.alias("call"), none.cast("string").alias("result"))
    events = asked.unionByName(results.select("conv", "id", "turn", none.cast(asked.schema["call"].dataType).alias("call"), "result"))
    events = events.groupBy("conv", "id", "turn").agg(F.min("call").alias("call"), F.min("result").alias("result"))
    events = events.withColumn("block", F.floor(F.col("turn") / TURNS_PER_RECORD)).withColumn("shown", F.when(F.col("call").isNull(), F.col("result")))
    # ``shown``: what the row before may take; an empty struct tells "a row without" from "no row".
    head = F.struct(F.col("shown").alias("result"))
    inside = events.withColumn("after", F.lead(head).over(Window.partitionBy("conv", "id", "block").orderBy("turn")))
    blocks = events.groupBy("conv", "id", "block").agg(F.min_by(head, "turn").alias("head"))
    blocks = blocks.select("conv", "id", "block", F.lead("head").over(Window.partitionBy("conv", "id").orderBy("block")).alias("beyond"))
    whole = inside.join(blocks, ["conv", "id", "block"]).withColumn("result", F.coalesce("result", F.coalesce("after", "beyond")["result"]))
    return whole.where("call IS NOT NULL AND result IS NOT NULL").select("conv", "turn", "call.mid", "call.idx", "result")


def unmet(calls: DataFrame) -> DataFrame:
    """``CALL`` and id: what a call depends on that is neither a call of its message nor of this turn or an earlier one."""
    asked = calls.select(*CALL, F.explode("outside").alias("id")).where("id IS NOT NULL")
    known = calls.where("id IS NOT NULL").groupBy("conv", "id").agg(F.min("turn").alias("since"))
    return asked.join(known, ["conv", "id"], "left").where("since IS NULL OR since > turn").select(*CALL, "id")


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``CALL`` and problem, a row for each. ``schemas``: name, param, type, required."""
    fields = calls.select(*CALL, "name", F.explode(F.expr("try_cast(try_parse_json(arguments) AS map<string, variant>)")).alias("param", "value"))
    fields = fields.select(*CALL, "name", "param", F.expr("regexp_extract(schema_of_variant(value), '^[A-Z]+', 0)").alias("kind"))
    known = schemas.groupBy("name", "param").agg(F.max("type").alias("type"), F.max("required").alias("required"))
    tools = known.select("name").distinct().withColumn("tool", F.lit(True))
    wanted = calls.select(*CALL, "name").join(known.where("required"), "name").select(*CALL, "param")
    missing = wanted.join(fields.select(*CALL, "param"), [*CALL, "param"], "left_anti").select(*CALL, F.concat(F.lit("missing "), "param").alias("problem"))
    spark_kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("type")]
    numeric = (F.col("type") == "number") & F.col("kind").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    fits = numeric | F.coalesce(F.col("kind") == spark_kind, F.lit(False))
    wrong = fields.join(tools, "name").join(known, ["name", "param"], "left")
    wrong = wrong.withColumn("problem", F.when(F.col("type").isNull(), F.concat(F.lit("unknown "), "param")).when(~fits, F.concat(F.lit("type "), "param")))
    no_tool = calls.join(tools, "name", "left_anti").select(*CALL, F.lit("unknown tool").alias("problem"))
    no_json = calls.where("arguments IS NULL").select(*CALL, F.lit("arguments are no object").alias("problem"))
    return missing.unionByName(wrong.where("problem IS NOT NULL").select(*CALL, "problem")).unionByName(no_tool).unionByName(no_json)


def serialise_calls(calls: DataFrame, notes: DataFrame) -> DataFrame:
    """conv, turn, mid, shown (the message's calls as JSON) and ``COUNTS``."""
    full = calls.join(notes, CALL, "left")
    linked, invalid = F.col("result").isNotNull(), F.coalesce(F.size("problems") > 0, F.lit(False))
    late, cyclic = F.coalesce(F.size("unmet") > 0, F.lit(False)), F.col("level").isNull()
    parts = {
        "arguments": F.col("given"), "cyclic": cyclic.cast("string"), "depends_on": F.to_json("depends_on"), "id": json_text("id"), "linked": linked.cast("string"), "name": json_text("name"),
        "other": F.coalesce("other", F.lit("{}")), "problems": json_list("problems"), "result": F.coalesce("result", F.lit("null")), "unmet": json_list("unmet"), "valid": (~invalid).cast("string"),
    }
    pieces = [x for k, (name, value) in enumerate(parts.items()) for x in (F.lit(("{" if k == 0 else ",") + f'"{name}":'), value)]
    place = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("level"), "idx", F.concat(*pieces, F.lit("}")).alias("shown"))
    return full.groupBy("conv", "turn", "mid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["shown"]), ",").alias("shown"),
        *[F.count_if(x).alias(n) for n, x in zip(COUNTS, (F.lit(True), linked, invalid, cyclic, late), strict=True)],
    )


def format_chats(conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per record: conv_id, record (its turns // ``TURNS_PER_RECORD``), piece, n_messages, ``COUNTS``, json.

    ``conversations``: conv_id, turn, role, text; other columns are ignored. Equal rows are one message; null texts and roles
    are '', a null turn is turn -1; rows without conv_id are one conversation. Messages stand by turn, role and JSON. A record
    of more than ``MESSAGES_PER_RECORD`` messages is dealt out over pieces by a hash of the message; else piece is 0.
    Calls of a message stand in topological order, then by place; those in or after a cycle stand last. Calls without an id,
    or with one that another call has too, are calls like others; ``link`` tells which one a result belongs to. Messages
    and calls of other roles or forms are plain text. Without ``schemas`` nothing is checked. An empty table gives no rows.
    """
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / TURNS_PER_RECORD))
    maybe = F.expr("role = 'assistant' AND text LIKE '%\"tool_calls\"%'")
    called, calls = parse_calls(rows.where(maybe).drop("block").distinct())
    results = parse_results(rows.where("role = 'tool' AND text LIKE '%\"tool_call_id\"%'"))
    none = F.lit(None).cast("string")
    notes = link(calls, results).select(*CALL, "result", none.alias("unmet"), none.alias("problem"))
    notes = notes.unionByName(unmet(calls).select(*CALL, none.alias("result"), F.col("id").alias("unmet"), none.alias("problem")))
    if schemas is not None:
        notes = notes.unionByName(check_arguments(calls, schemas).select(*CALL, none.alias("result"), none.alias("unmet"), "problem"))
    notes = notes.groupBy(*CALL).agg(F.max("result").alias("result"), F.collect_set("unmet").alias("unmet"), F.collect_set("problem").alias("problems"))
    shown = called.join(serialise_calls(calls, notes), ["conv", "turn", "mid"])
    zero = [F.lit(0).cast("long").alias(n) for n in COUNTS]
    has_calls = maybe & F.expr("coalesce(size(try_variant_get(try_parse_json(text), '$.tool_calls', 'array<variant>')), 0) > 0")
    plain = rows.where(~has_calls).select("conv_id", "conv", "turn", "role", F.concat(F.lit('{"content":'), json_text("text"), F.lit(',"role":'), json_text("role"), F.lit("}")).alias("message"), *zero)
    other = F.when(F.col("other") == "{}", F.lit("")).otherwise(F.concat(F.lit(',"other":'), "other"))
    built = F.concat(F.lit('{"content":'), "content", other, F.lit(',"role":'), json_text("role"), F.lit(',"tool_calls":['), "shown", F.lit("]}"))
    messages = plain.unionByName(shown.select("conv_id", "conv", "turn", "role", built.alias("message"), *COUNTS))
    messages = messages.withColumn("record", F.floor(F.col("turn") / TURNS_PER_RECORD)).withColumn("digest", F.xxhash64("turn", "role", "message"))
    sizes = rows.select("conv", F.col("block").alias("record"), F.xxhash64("turn", "role", "text").alias("h")).distinct().groupBy("conv", "record").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > MESSAGES_PER_RECORD).select("conv", "record", F.ceil(F.col("n") / MESSAGES_PER_RECORD).alias("pieces")), "large")
    dealt = messages.join(large, ["conv", "record"], "left").withColumn("piece", F.coalesce(F.pmod("digest", F.col("pieces")), F.lit(0)))
    grouped = dealt.groupBy("conv_id", "record", "piece").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "message", *COUNTS))).alias("m"))
    sums = [F.expr(f"aggregate(m, 0L, (s, x) -> s + x.{n})").alias(n) for n in COUNTS]
    text = F.concat(F.lit("["), F.array_join(F.expr("transform(m, x -> x.message)"), ","), F.lit("]"))
    return grouped.select("conv_id", "record", "piece", F.size("m").cast("long").alias("n_messages"), *sums, text.alias("json"))
