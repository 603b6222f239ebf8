"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  The rendered text is parsed again by a
deterministic parser (split at the start mark; the role ends at the first line end, the text at the end mark) and
compared with the source turns.  Where they differ, or a role or text holds the start of a control string, the conflicting
roles and texts are escaped and the conversation is rendered anew; the result is compared again, and a difference that is left raises.

Escaping puts one backslash more between ``<`` and ``|`` (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), and reading
takes one away, so it can be undone whatever the text holds; line ends in roles are escaped likewise.

Everything is DataFrame expressions.  A conversation is one row of turns, as its text is one value; conversations are
grouped by one shuffle on their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> ``conv_id, turns``: array of (role, text) in order.

    Null roles and texts are empty.  Rows are ordered by turn (null first), then role and text, so ties are defined.
    """
    parts = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(parts)), lambda t: F.struct(t["role"], t["text"]))
    return rows.groupBy("conv_id").agg(turns.cast("array<struct<role:string,text:string>>").alias("turns"))


def render(turns: Column, escaped: bool) -> Column:
    """Rendered conversation; with ``escaped``, roles and texts in which reading would find something else are escaped."""
    def one(t):
        role, text = t["role"], t["text"]
        if escaped:
            role, text = escape_role(role), escape(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def raw_turns(formatted: Column) -> Column:
    """Turns as they stand in a rendered text: array of (role, text) before unescaping."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    bodies = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(body):
        cut = F.instr(body, F.lit("\n"))
        rest = F.substr(body, cut + 1)
        return F.struct(F.substr(body, F.lit(1), cut - 1).alias("role"),
                        F.substring_index(rest, END, 1).alias("text"))

    return F.transform(bodies, one)


def parse(formatted: Column) -> Column:
    """Recovered turns of a rendered text."""
    return F.transform(raw_turns(formatted), lambda t: F.struct(unescape_role(t["role"]).alias("role"),
                                                               unescape(t["text"]).alias("text")))


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Loss mask of a rendered text: [from, to) in code points of the texts of one role, in order."""
    raw = raw_turns(formatted)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(state, t):
        a = state["at"] + F.lit(len(START)) + F.length(t["role"]) + 1
        b = a + F.length(t["text"])
        span = F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
        return F.struct((b + F.lit(len(END) + 1)).cast("int").alias("at"), F.concat(
            state["spans"], F.when(unescape_role(t["role"]) == role, span).otherwise(
                F.array().cast("array<struct<a:int,b:int>>"))).alias("spans"))

    return F.aggregate(raw, start, step, lambda state: state["spans"])


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the mask, each span unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["a"] + 1, s["b"] - s["a"]))), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> ``conv_id, formatted, escaped, n_source_turns, loss`` (mask spans).

    Conversations with a null id are one conversation; an empty table gives none.  Other columns are ignored.
    """
    conv = conversations(rows.select("conv_id", "turn", "role", "text"))
    plain = conv.withColumn("plain", render(F.col("turns"), False))
    marks = F.exists("turns", lambda t: F.contains(t["role"], F.lit("<|")) | F.contains(t["text"], F.lit("<|")))
    same = (parse(F.col("plain")) == F.col("turns")) & ~marks
    out = plain.withColumn("escaped", ~same).withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain")))
    read = F.when(F.col("escaped"), parse(F.col("formatted")) == F.col("turns")).otherwise(F.lit(True))
    out = out.withColumn("formatted", F.when(read, F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string")))
    return out.select("conv_id", "formatted", "escaped", F.size("turns").alias("n_source_turns"),
                      loss_spans(F.col("formatted")).alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """Read back from the output: turns, digests of the turns and of the text under the loss mask, and lengths."""
    turns = F.col("turns")
    out = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "masked", masked_text(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
