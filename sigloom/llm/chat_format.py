r"""Chat formatting by a grammar and its round trip; DataFrame functions only.

A conversation is rendered as turns ``<|im_start|>role\ntext<|im_end|>\n``. The parser is deterministic: turns end
at ``<|im_end|>\n``, begin with ``<|im_start|>``, the role ends at the first line end, and a role or body that
still holds ``<|`` is an error. In what it reads, ``<\|`` stands for ``<|`` (one backslash goes from any run of
them between ``<`` and ``|``), and in a role ``<|nl|>`` for a line end.

Each turn is first rendered as it is and reparsed. A turn that does not come back identical holds conflicting
content and is rendered again with its control strings escaped; the escape is reversible for every text. The
whole conversation is then reparsed and compared with its source: ``round_trip`` tells the outcome.

``loss_spans`` are the places (code points) of the assistant bodies in the rendered text.

Defined results: null roles and texts are empty strings. Rows without ``turn`` come first; equal turns are ordered
by role and text, repeated rows are turns of their own. Rows without ``conv_id`` are one conversation whose id is
null. Other columns are ignored. An empty table gives an empty result. A conversation is one string, as large as
its turns; conversations are grouped by id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_CONTROL = r"<(\\*)\|"          # what the escape adds a backslash to
_ESCAPED = r"<(\\*)\\\|"        # what the parser takes one from


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|")


def render(role: Column, text: Column) -> Column:
    """One turn. Roles and texts are given as they are to be written."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Array of ``(role, text)`` of a rendered conversation, null where a turn breaks the grammar."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        line = F.instr(body, F.lit("\n"))
        role, text = F.substring(body, F.lit(1), line - 1), F.substring(body, line + 1, F.length(body))
        role = F.regexp_replace(role, r"<\|nl\|>", "\n")
        sound = piece.startswith(START) & (line > 0) & ~F.contains(text, F.lit("<|")) & ~F.contains(role, F.lit("<|"))
        return F.when(sound, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _written_role(role: Column) -> Column:
    return F.regexp_replace(role, "\n", LINE)


def _turn_text(role: Column, text: Column) -> Column:
    """A turn's rendering: plain if it comes back identical, else escaped."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    plain = render(role, text)
    return F.when(parse(plain) == source, plain).otherwise(render(_written_role(escape(role)), escape(text)))


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, n_turns, formatted, loss_spans, round_trip)`` of ``rows(conv_id, turn, role, text)``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    written = written.withColumn("w", _turn_text(F.col("role"), F.col("text")))
    turns = written.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "w"))).alias("t"))
    formatted = turns.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["w"]), ""))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["w"])
        # The role as written ends at the first line end.
        begin = acc["at"] + F.instr(x["w"], F.lit("\n"))
        span = F.struct(begin.cast("long").alias("s"), (end - len(END) - 1).cast("long").alias("e"))
        spans = F.when(x["role"] == loss_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans"))
    spans = F.aggregate("t", none, step, lambda acc: acc["spans"])
    same = parse(F.col("formatted")) == F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return formatted.select("conv_id", F.size("t").cast("long").alias("n_turns"), "formatted", spans.alias("loss_spans"),
                            F.coalesce(same, F.lit(False)).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and masked text of rendered conversations, from the rendered text and its spans alone."""
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["s"] + 1).cast("int"), (s["e"] - s["s"]).cast("int")))), "")
    return formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_text", masked)
