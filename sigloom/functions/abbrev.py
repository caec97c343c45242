"""Abbreviation dictionaries (S8) and their expansion in text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DictionaryError(ValueError):
    pass


def flatten_dictionary(obj) -> list[tuple[str, str]]:
    """Nested JSON object -> ``[(sequence, replacement)]``.

    A whitespace-only key gives the value of the node itself; a key ``" abc"``
    (space, then non-space characters) is the path ``a, b, c``; any other key
    uses its first character.  Two values for one sequence are an error.
    The dictionary is configuration (small); it is flattened on the driver.
    """
    if isinstance(obj, str):
        obj = json.loads(obj)
    out: dict[str, str] = {}

    def put(seq: str, val: str):
        if seq in out:
            raise DictionaryError(f"duplicate entry for sequence {seq!r}")
        out[seq] = val

    def walk(node, prefix: str):
        if isinstance(node, str):
            if prefix == "":
                raise DictionaryError("bad root element")
            put(prefix, node)
            return
        if not isinstance(node, dict):
            raise DictionaryError("unexpected value kind")
        for key, val in node.items():
            if key.strip() == "":
                if not isinstance(val, str):
                    raise DictionaryError("unexpected value kind")
                if prefix == "":
                    raise DictionaryError("bad root element")
                put(prefix, val)
            elif key.startswith(" ") and len(key) > 1 and not key[1].isspace():
                path = key[1:].split()[0] if " " in key[1:] else key[1:]
                walk(val, prefix + path)
            else:
                if len(key) != 1 and key[0].isspace():
                    raise DictionaryError(f"bad key {key!r}")
                walk(val, prefix + key[0])

    walk(obj, "")
    return sorted(out.items())


def dictionary_frame(spark: SparkSession, obj) -> DataFrame:
    schema = T.StructType([T.StructField("sequence", T.StringType(), False),
                           T.StructField("replacement", T.StringType(), False)])
    return spark.createDataFrame(flatten_dictionary(obj), schema)


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def cut_pattern(pairs: list[tuple[str, str]]) -> str:
    """``\\(?:longest-first sequences)``, runs of other text, or a lone backslash."""
    seqs = sorted({s for s, _ in pairs}, key=lambda s: (-len(s), s))
    alt = "|".join(_quote(s) for s in seqs)
    return rf"\\(?:{alt})|[^\\]+|\\" if alt else r"[^\\]+|\\"


def expand(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace the longest known sequence after every backslash.

    The dictionary is a literal map inside the expression (it is small and
    fixed), so the transform is a native per-row expression.
    """
    if not pairs:
        return text
    m = F.create_map(*[x for s, v in pairs for x in (F.lit("\\" + s), F.lit(v))])
    pieces = F.regexp_extract_all(text, F.lit(cut_pattern(pairs)), 0)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(m, p), p)), "")
