r"""Chat formatting with a grammar round trip (operator 5, DataFrame functions only).

Grammar of a formatted conversation::

    conversation := "[chat esc=" ("0" | "1") "]\n" turn*
    turn         := "### " role ": " text "</turn>\n"

A deterministic parser cuts at ``</turn>\n``, and in each turn at ``###`` and the first ``": "``. Each conversation is rendered
as it is (``esc=0``) and parsed again; if the recovered turns differ from the source (a text holds a control string, a role
holds a colon and a blank), it is rendered with escapes (``esc=1``) and parsed again. Escaping puts a backslash before every backslash
and inside every control string, so that no control string is left, and is undone by dropping one backslash before
each character that has one. ``round_trip`` says that the recovered turns equal the source; it holds for all input.

The loss mask covers the assistant turns' texts as they stand in the formatted text (``loss_spans``: begin, end in code
points; ``loss_bytes``: the same in bytes of UTF-8, by which a span is cut out without counting characters from the start).

Plan: one shuffle on the conversation. Places of turns are running sums over its rows, at both escape levels, before its
turns are gathered, so work is linear in turns and text. A conversation is one output row, so its turns meet in one task,
as they must. All else is row-wise expressions.

Defined results: null text or role is empty; a null conv_id is a conversation of its own; null turns come first; rows of
equal turn are ordered by role and text, and repeated rows are kept; texts of any length are formatted whole; a conversation
that would not come back as it was is an error; an empty table gives no conversation; further columns of any name are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_TOP, _END, _HEAD, _COLON = "[chat esc=0]\n", "</turn>\n", "###", ": "


def escape(text: Column) -> Column:
    """Text without control strings: a backslash before each backslash and inside each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))  # leaves no three in a row, however long the run
    return F.replace(text, F.lit(_COLON), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(turns: Column, level: int) -> Column:
    """Formatted text at escape level 0 or 1 (roles and texts share the escapes)."""
    own = escape if level else (lambda c: c)
    body = F.transform(turns, lambda t: F.concat(F.lit(f"{_HEAD} "), own(t.role), F.lit(_COLON), own(t.text), F.lit(_END)))
    return F.concat(F.lit(f"[chat esc={level}]\n"), F.array_join(body, ""))


def segments(formatted: Column) -> Column:
    """The turns' raw segments, without header line and end marks."""
    body = F.substring(formatted, F.lit(len(_TOP) + 1), F.length(formatted))
    parts = F.split(body, r"\Q</turn>" + "\n" + r"\E", -1)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def _inner(segment: Column) -> Column:
    """What follows the turn's head mark, up to another head mark (of which there is none in a sound text); null without one."""
    return F.get(F.split(segment, _HEAD, -1), F.lit(1))


def _role_end(segment: Column) -> Column:
    """Characters of the raw role."""
    return F.instr(_inner(segment), _COLON) - 2


def parse(formatted: Column) -> Column:
    """Turns (role, text) that the formatted text holds; unescaped as its header says."""
    escaped = F.startswith(formatted, F.lit("[chat esc=1]"))

    def turn(segment: Column) -> Column:
        inner, end = _inner(segment), _role_end(segment)
        role, text = F.substring(inner, F.lit(2), end), F.substring(inner, end + 4, F.length(inner))
        return F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"))

    return F.transform(segments(formatted), turn)


def conversations_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, its turns in order as an array of (role, text), and ``places``, an array of each turn's role and of the
    places (begin, end, first and last byte) at which its text will stand at escape level 0 and 1."""
    empty = F.lit("")
    picked = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sized = picked.withColumn("i", F.row_number().over(order))
    sums = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = {}
    for level, own in enumerate((lambda c: c, escape)):
        for unit, length in (("c", F.length), ("b", F.octet_length)):
            head, body = length(own(F.col("role"))) + len(f"{_HEAD} {_COLON}"), length(own(F.col("text")))
            sized = sized.withColumns({f"head_{unit}{level}": head.cast("long"), f"body_{unit}{level}": body.cast("long")})
            whole = F.col(f"head_{unit}{level}") + F.col(f"body_{unit}{level}") + len(_END)
            ends[f"{unit}{level}"] = F.sum(whole).over(sums) + len(_TOP) - len(_END)  # a text's end
    placed = sized.withColumns({f"end_{k}": v for k, v in ends.items()})
    spans = [F.struct((F.col(f"end_c{x}") - F.col(f"body_c{x}")).alias("begin"), F.col(f"end_c{x}").alias("end"), (F.col(f"end_b{x}") - F.col(f"body_b{x}")).alias("first"), F.col(f"end_b{x}").alias("last")).alias(f"level{x}") for x in (0, 1)]
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "role", "text", *spans))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"), F.transform("t", lambda x: F.struct(x.role.alias("role"), x.level0.alias("level0"), x.level1.alias("level1"))).alias("places"))


def format_conversations(rows: DataFrame, assistant: str = ASSISTANT, **columns: str) -> DataFrame:
    """conv_id, formatted, recovered (turns read back), loss_spans, loss_bytes, round_trip (true, or the query fails)."""
    plain = conversations_of(rows, **columns).withColumn("plain", _render(F.col("turns"), 0))
    sound = plain.withColumn("sound", F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    out = sound.withColumn("formatted", F.when(F.col("sound"), F.col("plain")).otherwise(_render(F.col("turns"), 1)))
    out = out.withColumn("recovered", parse(F.col("formatted")))
    masked = F.filter("places", lambda p: p.role == assistant)
    at = F.transform(masked, lambda p: F.when(F.col("sound"), p.level0).otherwise(p.level1))
    span = lambda a, b: F.transform("at", lambda s: F.struct(s[a].alias("begin"), s[b].alias("end")))
    same = F.when(F.col("recovered") == F.col("turns"), F.lit(True)).otherwise(F.raise_error(F.lit("a conversation does not come back as it was")).cast("boolean"))
    return out.withColumn("at", at).select("conv_id", "formatted", "recovered", span("begin", "end").alias("loss_spans"), span("first", "last").alias("loss_bytes"), same.alias("round_trip"))


def masked_text(formatted: Column, loss_bytes: Column) -> Column:
    """The unescaped text under the loss mask."""
    escaped = F.startswith(formatted, F.lit("[chat esc=1]"))

    def cut(raw: Column) -> Column:
        texts = F.transform(loss_bytes, lambda s: F.decode(F.substring(raw, (s.begin + 1).cast("int"), (s.end - s.begin).cast("int")), "UTF-8"))
        return F.array_join(F.transform(texts, lambda t: F.when(escaped, unescape(t)).otherwise(t)), "")

    return F.transform(F.array(F.encode(formatted, "UTF-8")), cut)[0]  # encoded once: a lambda's argument is a value


def digest(rows: DataFrame) -> DataFrame:
    """What the formatted text holds: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, round_trip."""
    turns = F.array_join(F.transform("recovered", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    held = format_conversations(rows).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_bytes")))
    return held.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def adversarial(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


#: DuckDB: the same from the source rows; a conversation is escaped if any of its turns holds what the parser would cut.
SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), own as (
  select *, contains(text, '</turn>' || chr(10)) or contains(text, '###') or contains(role, '</turn>' || chr(10)) or contains(role, '###') or strpos(role || ': ' || text, ': ') <> length(role) + 1 as bad,
    replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ': ', ':\ ') as etext,
    replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ': ', ':\ ') as erole
  from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (13 + case when bool_or(bad) then sum(length(erole) + length(etext)) else sum(length(role) + length(text)) end + 14 * count(*))::bigint as formatted_chars,
  true as round_trip
from own group by conv_id
"""
