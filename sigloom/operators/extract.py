"""Definition extraction from source modules.

The reference scans each module line by line with an indentation stack.  Here
the same result is one native job over the line table:

1. D1  lines: non-blank lines with indentation, first word and the rest.
2. D2  every line's ancestors = the chain of nearest preceding lines with a
       smaller effective indentation (``where`` may share its body's column).
       For each indentation level L of a module, ``anc_L`` = last preceding
       line with level < L (a skew-safe running max); a line's ancestors are
       ``{anc_L : L <= own level}``.
3. D3/D4/D7  ancestors are joined back to their words: the scope path is the
       ordered names of ``module``/``record`` openers, the kind of a plain
       signature comes from the nearest ``data``/``field`` opener, and a plain
       signature under ``private``/``where``/``macro``/``variable`` is dropped.
4. D5/D6  ``name : type`` lines open a signature; every line below one of them
       is folded into the outermost one.

Deviations from the reference are listed in the README (V2, V11, V16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, checkpoint as _ckpt
from .scan import running

# Block keywords and the kinds they give.
SCOPE_WORDS = ("module", "record")
TRANSPARENT_WORDS = ("postulate", "interleaved", "instance")
IGNORED_WORDS = ("private", "where", "macro", "variable")
OPENER_WORDS = SCOPE_WORDS + TRANSPARENT_WORDS + IGNORED_WORDS + ("data", "field")
KINDS = ("Function", "Pattern", "DataType", "DataConstructor", "RecordType", "RecordField",
         "RecordConstructor")

SIG_RE = r"^\s*(\S+)\s+:\s*(.*)$"


def lines(modules: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(key..., n, line, ind, w, rest)`` for every non-blank line (n is 0-based)."""
    ex = modules.select(*key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "line"))
    ex = ex.withColumn("line", F.regexp_replace("line", "\r$", ""))
    ex = ex.where(F.col("line").rlike(r"\S"))
    ind = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    return ex.select(*key, "n", "line", ind.alias("ind"),
                     F.regexp_extract("line", r"^\s*(\S+)", 1).alias("w"),
                     F.regexp_extract("line", r"^\s*\S+\s*(.*)$", 1).alias("rest"))


def ancestors(ln: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``ancs`` (sorted line numbers of the ancestor chain) and ``eff``."""
    e = ln.withColumn("eff", F.col("ind") * 2 - F.when(F.col("w") == "where", 1).otherwise(0))
    lv = e.select(*key, F.col("eff").alias("lvl")).distinct()
    x = e.select(*key, "n", "eff").join(lv, key)
    a = running(x, key + ["lvl"], ["n"], {"anc": ("max", F.when(F.col("eff") < F.col("lvl"), F.col("n")))},
                exclusive=True)
    c = (a.where(F.col("lvl") <= F.col("eff")).groupBy(*key, "n")
         .agg(F.array_sort(F.array_distinct(F.array_compact(F.collect_list("anc")))).alias("ancs")))
    out = e.join(c, key + ["n"], "left").withColumn("ancs", F.coalesce("ancs", F.array().cast("array<int>")))
    # used several times downstream: materialise (reliable checkpoint) to cut lineage
    return _ckpt(out)


def _is_sig(line: Column) -> Column:
    return line.rlike(SIG_RE)


def classify(ln: DataFrame, key: list[str]) -> DataFrame:
    """D2-D7 on a line table: one row per line with its role.

    Output columns: ``key, n, line, w, rest, role, inner_path, ignored, cont_of, block_kind``
    where ``role`` is one of ``opener``, ``signature``, ``continuation``, ``other``.
    """
    ensure_checkpoint_dir(ln.sparkSession)
    a = ancestors(ln, key)
    first_module = (a.where(F.col("w") == "module").groupBy(*key).agg(F.min("n").alias("__m0")))
    a = a.join(first_module, key, "left")
    info = a.select(*key, F.col("n").alias("an"), F.col("w").alias("aw"), F.col("line").alias("al"),
                    F.col("rest").alias("arest"), F.col("__m0").alias("am0"))
    # ancestor-level facts
    ex = a.select(*key, "n", F.explode("ancs").alias("an")).join(info, key + ["an"])
    aw = F.col("aw")
    sig_anc = _is_sig(F.col("al")) & ~aw.isin(*OPENER_WORDS, "constructor", "pattern")
    scope_name = F.regexp_extract("arest", r"^(\S+)", 1)
    is_scope = aw.isin(*SCOPE_WORDS) & ~((aw == "module") & (F.col("an") == F.col("am0"))) & \
        (scope_name != "") & (scope_name != "_")
    facts = ex.groupBy(*key, "n").agg(
        F.bool_or(aw.isin(*IGNORED_WORDS)).alias("ignored"),
        F.min(F.when(sig_anc, F.col("an"))).alias("__sig_anc"),
        F.max_by(aw, F.when(aw.isin("data", "field"), F.col("an"))).alias("block_word"),
        F.array_sort(F.collect_list(F.when(is_scope, F.struct(F.col("an").alias("n"), scope_name.alias("s")))))
        .alias("__scopes"))
    out = a.join(facts, key + ["n"], "left")
    # a signature ancestor that is itself ignored does not capture continuation lines
    ign_lines = out.select(*key, F.col("n").alias("__sig_anc"), F.coalesce("ignored", F.lit(False)).alias("__sig_ign"))
    out = out.join(ign_lines, key + ["__sig_anc"], "left")
    cont = F.col("__sig_anc").isNotNull() & ~F.coalesce("__sig_ign", F.lit(False))
    path = F.array_join(F.transform(F.coalesce("__scopes", F.array()), lambda s: F.concat(s["s"], F.lit("."))), "")
    role = (F.when(cont, F.lit("continuation"))
            .when(F.col("w").isin(*OPENER_WORDS, "constructor", "pattern"), F.lit("opener"))
            .when(_is_sig(F.col("line")), F.lit("signature"))
            .otherwise(F.lit("other")))
    return _ckpt(out.select(*key, "n", "line", "ind", "w", "rest", role.alias("role"),
                            path.alias("inner_path"), F.coalesce("ignored", F.lit(False)).alias("ignored"),
                            F.when(cont, F.col("__sig_anc")).alias("cont_of"),
                            F.coalesce("block_word", F.lit("")).alias("block_word")))


def _strip_where(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+where\s*$", ""))


def definitions_from_lines(cl: DataFrame, key: list[str]) -> DataFrame:
    """Definitions ``(key..., inner_path, name, kind, type_raw, line_no)``."""
    w, rest = F.col("w"), F.col("rest")
    name2 = F.regexp_extract(rest, r"^(\S+)", 1)
    after2 = F.regexp_extract(rest, r"^\S+(.*)$", 1)
    op = cl.where(F.col("role") == "opener")
    record = op.where((w == "record") & (name2 != "")).select(
        *key, "inner_path", name2.alias("name"), F.lit("RecordType").alias("kind"),
        _strip_where(after2).alias("type_raw"), "n")
    data = op.where((w == "data") & (name2 != "")).select(
        *key, "inner_path", name2.alias("name"), F.lit("DataType").alias("kind"),
        _strip_where(after2).alias("type_raw"), "n")
    pattern = op.where((w == "pattern") & (name2 != "")).select(
        *key, "inner_path", name2.alias("name"), F.lit("Pattern").alias("kind"),
        F.trim(after2).alias("type_raw"), "n")
    ctor = op.where((w == "constructor") & (name2 != "")).select(
        *key, "inner_path", name2.alias("name"), F.lit("RecordConstructor").alias("kind"),
        F.lit(None).cast("string").alias("type_raw"), "n")
    # inline field: "field f : T" (V2: the text after the keyword decides)
    fld = op.where((w == "field") & rest.rlike(r"\S")).select(
        *key, "inner_path", name2.alias("name"), F.lit("RecordField").alias("kind"),
        F.regexp_replace(after2, r"^[\s:]*", "").alias("type_raw"), "n")
    # plain signatures with their folded continuation lines
    sig = cl.where((F.col("role") == "signature") & ~F.col("ignored"))
    kind = (F.when(F.col("block_word") == "data", F.lit("DataConstructor"))
            .when(F.col("block_word") == "field", F.lit("RecordField")).otherwise(F.lit("Function")))
    conts = (cl.where(F.col("role") == "continuation")
             .groupBy(*key, F.col("cont_of").alias("n"))
             .agg(F.array_sort(F.collect_list(F.struct("n", F.regexp_replace("line", r"^\s+", "").alias("t"))))
                  .alias("__c")))
    folded = F.array_join(F.transform(F.coalesce("__c", F.array()),
                                      lambda c: F.concat(F.lit(" "), c["t"], F.lit(" "))), "")
    sigs = (sig.join(conts, key + ["n"], "left")
            .select(*key, "inner_path", F.regexp_extract("line", SIG_RE, 1).alias("name"), kind.alias("kind"),
                    F.concat(F.lit(": "), F.regexp_extract("line", SIG_RE, 2), folded).alias("type_raw"), "n"))
    out = record.unionByName(data).unionByName(pattern).unionByName(ctor).unionByName(fld).unionByName(sigs)
    # stable, exact identity: source key and line (two definitions never share a line)
    def_id = F.concat_ws("#", *[F.col(k).cast("string") for k in key], F.col("n").cast("string"))
    return out.withColumn("def_id", def_id).withColumnRenamed("n", "line_no")


def extract_definitions(modules: DataFrame, key: list[str] | None = None, text: str = "text") -> DataFrame:
    """D1-D8 end to end: modules ``(library, module, text)`` -> definitions."""
    key = key or ["library", "module"]
    return definitions_from_lines(classify(lines(modules, key, text), key), key)


def title(name: Column, type_raw: Column) -> Column:
    """Display title ``name type``."""
    return F.concat_ws(" ", name, type_raw)


def display_path(library: Column, module: Column, inner_path: Column) -> Column:
    """``library/module.inner`` without a trailing dot."""
    return F.regexp_replace(F.concat_ws(".", module, inner_path), r"\.+$", "")


def split_results(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Successes and failures of one result table."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


DEF_KEY = ["library", "module", "inner_path", "name"]


def attach_inferred_types(defs: DataFrame, inferred: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Definitions enriched with a checker's results.

    ``inferred(key..., type_normalised, error)``, where the key is the
    definitions' ``(library, module, inner_path, name)`` if none is given; a definition without a result keeps ``type_normalised`` NULL (signatures
    then fall back to the raw type text); a failed check sets ``type_error``.
    """
    key = key or DEF_KEY
    inf = inferred.select(*key, "type_normalised", F.col("error").alias("type_error"))
    return defs.join(inf, key, "left")


def type_worklist(defs: DataFrame, inferred: DataFrame) -> DataFrame:
    """Typed definitions that have no checker result yet (anti-join)."""
    return (defs.where(F.col("type_raw").isNotNull())
            .join(inferred.select(*DEF_KEY), DEF_KEY, "left_anti"))


def progress_counts(results: DataFrame, error: str = "error", by: Sequence[str] = ("library",)) -> DataFrame:
    """A3: per library (or ``by``), definitions processed (successes and errors) and modules done."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count(F.when(F.col(error).isNull(), 1)).alias("indexed"),
        F.count(F.when(F.col(error).isNotNull(), 1)).alias("failed"),
        F.count_distinct("module").alias("modules"))
