"""Interaction-log parsing (S9): ``[prompt](tag arg "quoted arg" ...)``.

Quotes are stripped without escapes, an empty quoted argument is kept, and a
line without a tag goes to the error side carrying its source line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word ends at a space or behind its first quoted run; one character behind it is the separator.
ARG = r'([^ "]*"[^"]*"|[^ "]+).?'


def body_pattern(prompt: str | None = None) -> str:
    pre = f"(?:{re.escape(prompt)})?" if prompt else ""
    return r'^' + pre + r'\(((?:"[^"]*"|[^)"])*)'


def parse_line(line: Column, prompt: str | None = None) -> Column:
    """``struct<tag string, args array<string>>`` or NULL when the line has no tag."""
    body = F.regexp_extract(line, body_pattern(prompt), 1)
    words = F.regexp_extract_all(body, F.lit(ARG), 1)
    words = F.transform(words, lambda w: F.replace(w, F.lit('"'), F.lit("")))
    return F.when(F.size(words) > 0,
                  F.struct(F.get(words, 0).alias("tag"), F.slice(words, 2, F.size(words)).alias("args")))


def parse_log(df: DataFrame, line: str = "line", prompt: str | None = None) -> DataFrame:
    """Adds ``tag``, ``args`` and ``error`` (the source line when unparsed)."""
    p = df.withColumn("__r", parse_line(F.col(line), prompt))
    return (p.select("*", F.col("__r.tag").alias("tag"), F.col("__r.args").alias("args"),
                     F.when(F.col("__r").isNull(), F.col(line)).alias("error"))
            .drop("__r"))
