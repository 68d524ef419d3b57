"""Chat formatting with a grammar round trip, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What opens and closes a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The tails of control strings that no text may hold, after < or [; the heads are in HEAD.
TAILS = [r"\|im_start\|>", r"\|im_end\|>", "s>", "/s>", r"INST\]", r"/INST\]"]
HEAD = r"([<\[])"
TAIL = "(" + "|".join(TAILS) + ")"


def escape(text: Column) -> Column:
    """Put one backslash more after the first character of each control string, escaped or not."""
    return F.regexp_replace(text, HEAD + r"(\\*)" + TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: take one backslash away."""
    return F.regexp_replace(text, HEAD + r"\\(\\*)" + TAIL, "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Each backslash pair, from the left, is one backslash, and one before n is a line end."""
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns ``array<struct<role, raw, text>>`` of a formatted conversation; null where it is not one.

    Deterministic: a turn runs from an opening to the next opening, its role to the first line end, its
    text to the closing at its end; a control string anywhere else makes the whole no conversation.
    """
    pieces = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    turns = F.transform(
        parts,
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("role"),
            F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(CLOSE)).alias("raw"),
            (p.endswith(CLOSE) & (F.instr(p, "\n") > 0)).alias("closed"),
        ),
    )
    clean = lambda t: t["closed"] & ~t["raw"].rlike(HEAD + TAIL) & ~t["role"].rlike(HEAD + TAIL)
    out = F.transform(turns, lambda t: F.struct(unescape_role(t["role"]).alias("role"), t["raw"].alias("raw"), unescape(t["raw"]).alias("text")))
    return F.when(formatted.startswith(OPEN) & F.forall(turns, clean), out)


def format_chats(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, loss_spans)``, one row per conversation of ``(conv_id, turn, role, text)`` rows.

    Every turn is rendered as it is, parsed again and compared with its source; where they differ, its
    role and text are escaped. The whole conversation is then parsed once more and must give back every
    turn; one that does not (none is known) has a null ``formatted``. ``turns`` is what was read back;
    ``loss_spans`` holds, for each assistant turn, the first code point (from 0) and the length of its text in
    ``formatted``.

    Null roles and texts are empty; rows go by turn, then role, then text (null turns first), repeated rows
    stay; a null id is a conversation of its own; other columns are not read; no rows give no rows. A
    conversation is one value, so Spark's bound on a value, 2 GB, is that of its formatted text.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = render(F.col("role"), F.col("text"))
    back = parse(plain)
    same = (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == F.col("role")) & (F.get(back, F.lit(0))["text"] == F.col("text"))
    need = ~F.coalesce(same, F.lit(False))
    rows = rows.withColumn("need", need)
    rows = rows.withColumns({"r": F.when(F.col("need"), escape_role(F.col("role"))).otherwise(F.col("role")), "t": F.when(F.col("need"), escape(F.col("text"))).otherwise(F.col("text"))})
    rows = rows.withColumn("shown", render(F.col("r"), F.col("t")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumns({"k": F.row_number().over(order), "end": F.sum(F.char_length("shown")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    span = F.struct((F.col("end") - len(CLOSE) - F.char_length("t")).alias("start"), F.char_length("t").cast("long").alias("length"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "shown", "role", "text", span.alias("span")))).alias("x"))
    formatted = F.array_join(F.col("x.shown"), "")
    read = whole.select("conv_id", "x", formatted.alias("formatted")).withColumn("turns", parse(F.col("formatted")))
    source = F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    found = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    ok = F.coalesce(found == source, F.lit(False))
    spans = F.transform(F.filter("x", lambda t: t["role"] == "assistant"), lambda t: t["span"])
    return read.select("conv_id", F.when(ok, F.col("formatted")).alias("formatted"), "turns", spans.alias("loss_spans"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(t) + length(role) + 12 + 1 + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
