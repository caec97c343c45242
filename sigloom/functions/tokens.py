"""Tokeniser (T1-T3): ordered rules, first alternative wins.

All work is built-in Spark SQL: one ``regexp_extract_all`` cuts the text into
tokens, a ``CASE`` of anchored ``rlike`` tests tags every token in rule order
(sound because a rule that fully matches a token's text would also have
matched first at its position), and ``split`` on the same pattern yields the
gaps between tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token rules in priority order (tag, pattern).  They must equal
# the reference tokeniser's rules for identical tokens.  Written in the
# common subset of Java and RE2 syntax (the opening "{" of a block comment is
# escaped for Java).
_N = r"""[^\s_.;{}()@"\\]"""
_P = rf"{_N}(?:{_N}|')*"
_U = rf"_?{_P}(?:_{_P})*_?"
RULES: list[tuple[str, str]] = [
    ("comment", r"(?:--.*(?:$|\n))|(?:\{-.*-\})"),
    ("lit_str", r'".*"'),
    ("lit_chr", r"'.'"),
    ("lit_dec", r"-?\d[_\d]*"),
    ("lit_bin", r"-?0b[01][_01]*"),
    ("lit_hex", r"-?0x[\da-fA-F][_\da-fA-F]*"),
    ("lit_frc", r"-?\d+(?:\.\d+)?(?:[eE][+-]\d+)?"),
    ("colon", r":"),
    ("arrow", r"(?:->)|(?:→)"),
    ("lambda", r"λ"),
    ("parenL", r"\("),
    ("parenR", r"\)"),
    ("curlyL", r"\{"),
    ("curlyR", r"\}"),
    ("instsL", r"(?:\{\{)|⦃"),
    ("instsR", r"(?:\}\})|⦄"),
    ("name", rf"{_U}(?:\.{_U})*"),
    ("discard", r"_"),
]

# Java flags: (?d) makes only "\n" a line terminator (as in RE2); (?U) makes
# \s and \d Unicode-aware (as in .NET).  The oracle comparison runs without
# (?U) because RE2 reads (?U) as "ungreedy".
PATTERN_PLAIN = "|".join(f"(?:{p})" for _, p in RULES)

# Every rule before ``name`` starts with one of these characters.  At a
# position whose character is not one of them, only ``name`` can match, so
# trying ``name`` first there gives the same tokens; Java otherwise tries all
# earlier alternatives at every letter.  (RE2, used by the oracle, has no
# look-ahead; the oracle keeps PATTERN_PLAIN.)
_SPECIAL_FIRST = r"""[-{"'\d:→λ(){}⦃⦄_]"""
# ``name`` without the alternative inside its loop ("'" is one of ``_N``) and
# without backtracking: what may follow a repetition is never in it, and
# nothing has to match behind a name.
_PART = rf"_?+{_N}++(?:_{_N}++)*+_?+"
_NAME = rf"{_PART}(?:\.{_PART})*+"
# No rule starts with one of these; at white space Java otherwise tries them all.
_NO_FIRST = r"[\s.;@\\]"
# Most names begin with a letter, which needs none of the slower tests.
_WORD = rf"[a-zA-Z]{_N}*+(?:_{_N}++)*+_?+(?:\.{_PART})*+"
PATTERN_FAST = f"(?!{_NO_FIRST})(?:{_WORD}|(?:(?!{_SPECIAL_FIRST}){_NAME})|{PATTERN_PLAIN})"
PATTERN = "(?d)" + PATTERN_FAST
PATTERN_UNICODE = "(?dU)" + PATTERN_FAST


def _flags(unicode: bool) -> str:
    return "(?dU)" if unicode else "(?d)"


def token_values(text: Column, unicode: bool = False) -> Column:
    """Array of token texts in order."""
    return F.regexp_extract_all(text, F.lit(_flags(unicode) + PATTERN_FAST), 0)


def tag_of(tok: Column, unicode: bool = False, rules: list[tuple[str, str]] | None = None) -> Column:
    """Tag of one token text: the first rule that matches it whole."""
    fl = _flags(unicode)
    out = None
    if rules is None:
        # fast path: a token that does not start like any earlier rule is a name
        out = F.when(~tok.rlike(f"{fl}^{_SPECIAL_FIRST}"), F.lit("name"))
    for tag, p in rules or RULES:
        cond = tok.rlike(f"{fl}^(?:{p})$")
        out = F.when(cond, F.lit(tag)) if out is None else out.when(cond, F.lit(tag))
    return out


def tokens(text: Column, unicode: bool = False) -> Column:
    """``array<struct<tag, value>>``."""
    return F.transform(token_values(text, unicode),
                       lambda t: F.struct(tag_of(t, unicode).alias("tag"), t.alias("value")))


def gaps(text: Column, unicode: bool = False) -> Column:
    """Text between tokens: element i precedes token i; the last one trails."""
    return F.split(text, _flags(unicode) + PATTERN_FAST, -1)


def _last_nl(s: Column) -> Column:
    """0-based index of the last newline in ``s`` or -1."""
    return F.when(F.instr(s, "\n") > 0, F.length(s) - F.instr(F.reverse(s), "\n")).otherwise(F.lit(-1))


def _nl_count(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


_POS_T = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("start", "line", "col")])


@F.pandas_udf(_POS_T)
def _positions(lg: pd.Series, lt: pd.Series, ng: pd.Series, nt: pd.Series,
               qg: pd.Series, qt: pd.Series) -> pd.DataFrame:
    """Running offsets inside one text (numpy per row, no shuffle).

    Inputs per row: lengths, newline counts and last-newline index (-1 if none)
    of every gap (g) and token (t); gap i precedes token i.
    """
    starts, lines, cols, none = [], [], [], np.zeros(0, np.int64)
    for a, b, c, d, e, f in zip(lg, lt, ng, nt, qg, qt):
        n = len(b)
        if n == 0:
            starts.append(none), lines.append(none), cols.append(none)
            continue
        a, c, e = np.asarray(a[:n], dtype=np.int64), np.asarray(c[:n], dtype=np.int64), np.asarray(e[:n], dtype=np.int64)
        b, d, f = np.asarray(b, dtype=np.int64), np.asarray(d, dtype=np.int64), np.asarray(f, dtype=np.int64)
        piece = a + b
        off = np.concatenate(([0], np.cumsum(piece)[:-1]))          # start of gap i
        start = off + a
        nl_before = np.concatenate(([0], np.cumsum(c + d)[:-1]))
        # absolute index of the last newline of each piece (gap, then token)
        last_piece = np.where(f >= 0, start + f, np.where(e >= 0, off + e, -1))
        prev = np.concatenate(([-1], np.maximum.accumulate(last_piece)[:-1]))
        last_before = np.where(e >= 0, off + e, prev)
        starts.append(start)
        lines.append(nl_before + c + 1)
        cols.append(start - last_before)
    return pd.DataFrame({"start": starts, "line": lines, "col": cols})


def _lens(arr: Column):
    return (F.transform(arr, lambda x: F.length(x).cast("bigint")),
            F.transform(arr, lambda x: _nl_count(x).cast("bigint")),
            F.transform(arr, lambda x: _last_nl(x).cast("bigint")))


def token_table(df: DataFrame, id_col: str, text: str, unicode: bool = False) -> DataFrame:
    """T1+T2: one row per token ``(id, pos, tag, value, gap, start_idx, line, col)``.

    Positions are real: 0-based character index, 1-based line and column.  A
    text is one row, so its running offsets are computed inside the row (no
    shuffle); tokens are then exploded.
    """
    t = df.select(id_col, gaps(F.col(text), unicode).alias("g"), token_values(F.col(text), unicode).alias("v"))
    lg, ng, qg = _lens(F.col("g"))
    lt, nt, qt = _lens(F.col("v"))
    t = t.select(id_col, "g", "v", _positions(lg, lt, ng, nt, qg, qt).alias("p"))
    z = F.arrays_zip(F.col("g").alias("gap"), F.col("v").alias("value"), F.col("p.start").alias("start_idx"),
                     F.col("p.line").alias("line"), F.col("p.col").alias("col"))
    ex = t.select(id_col, F.posexplode(z).alias("pos", "r")).where(F.col("r.value").isNotNull())
    return ex.select(id_col, "pos", tag_of(F.col("r.value"), unicode).alias("tag"), F.col("r.value").alias("value"),
                     F.col("r.gap").alias("gap"), F.col("r.start_idx").alias("start_idx"),
                     F.col("r.line").alias("line"), F.col("r.col").alias("col"))


def unmatched(df: DataFrame, id_col: str, text: str, unicode: bool = False) -> DataFrame:
    """Text between tokens that is not whitespace; the trailing gap is not reported."""
    t = df.select(id_col, gaps(F.col(text), unicode).alias("g"))
    # keep (position, gap) pairs that hold non-blank text, inside the row, before exploding
    g = F.col("g")
    kept = F.filter(F.transform(g, lambda x, i: F.struct(i.alias("pos"), x.alias("gap"))),
                    lambda p: (p["pos"] < F.size(g) - 1) & p["gap"].rlike(r"\S"))
    return t.select(id_col, F.explode(kept).alias("p")).select(id_col, "p.pos", "p.gap")
