"""Canonical signatures.

* T4-T6 renaming runs on the exploded token table (one row per token): binder
  groups are found with "next token of a kind" windows, first bindings get
  ordinals with ``dense_rank``, and the rename is an equi-join on
  ``(definition, name)``.  Windows are per definition, so a partition holds
  one signature's tokens.
* T7-T8 parsing is recursive in the reference; here every round splits all
  open segments of all definitions at once with in-row array expressions
  (strip outer brackets, insert implied arrows, split at depth-0 arrows).
  Rounds are bounded by the corpus' maximum bracket depth.
* T9 canonical form is built bottom-up: a subtree is encoded as its preorder
  sequence of nodes ``(kind, n, values, tags)`` (leaf kind 0 with n tokens,
  function kind 1 with n parts).  Lexicographic order of these encodings is the
  reference's comparator (leaf < function, then token count / arity, then
  values, children in order), so sorting children is ``array_sort``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tok
from ..session import ensure_checkpoint_dir, checkpoint as _ckpt

OPEN = ("parenL", "curlyL", "instsL")
CLOSE = ("parenR", "curlyR", "instsR")
_BIG = 2147483647

TOKEN_T = "struct<tag:string,value:string>"
NODE_T = "struct<kind:int,n:int,vals:array<string>,tags:array<string>>"


# ---------------------------------------------------------------- tokens
def token_rows(defs: DataFrame, id_col: str, text: str, unicode: bool = True) -> DataFrame:
    """``(id, pos, tag, value)``; a literal two-character ``\\n`` reads as a space."""
    t = F.replace(F.col(text), F.lit("\\n"), F.lit(" "))
    arr = tok.tokens(t, unicode)
    return (defs.select(id_col, F.posexplode(arr).alias("pos", "t"))
            .select(id_col, "pos", F.col("t.tag").alias("tag"), F.col("t.value").alias("value")))


def _cls(tag: Column) -> Column:
    return (F.when(tag.isin(*OPEN), F.lit("open")).when(tag.isin(*CLOSE), F.lit("close"))
            .otherwise(tag))


# ---------------------------------------------------------------- T4-T6
def rename_binders(k: DataFrame, id_col: str = "id") -> DataFrame:
    """Rename bound variables to ``@0, @1, ...`` and expand binder groups.

    Input/output ``(id, pos, tag, value)``; output ``pos`` is dense from 0.
    ``{A B : T}`` becomes ``{@0 : T}{@1 : T}``; every binder of a group is
    emitted once (V7); names bound after ``λ`` and before an arrow are renamed
    too (no expansion), if nothing but names stands there. What a pattern lambda
    ``λ { ... }`` holds, up to its matching brace (or the end), binds nothing.
    """
    i = id_col
    k = k.withColumn("cls", _cls(F.col("tag")))
    fwd = Window.partitionBy(i).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    curly = F.when(F.col("tag") == "curlyL", 1).when(F.col("tag") == "curlyR", -1).otherwise(0)
    upto = Window.partitionBy(i).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    w = k.select("*", F.sum(curly).over(upto).alias("cd"), F.lead("tag").over(Window.partitionBy(i).orderBy("pos")).alias("after"),
                 F.min(F.when(F.col("cls") != "name", F.struct(F.col("pos").alias("p"), F.col("cls").alias("g")))).over(fwd).alias("nn"),
                 F.min(F.when(~F.col("cls").isin("name", "discard"),
                              F.struct(F.col("pos").alias("p"), F.col("cls").alias("g")))).over(fwd).alias("nb"),
                 F.min(F.when(F.col("cls") == "close", F.col("pos"))).over(fwd).alias("cl"))
    # bracket groups: opener, >= 1 name/discard, colon; earliest opener per closer
    g = (w.where((F.col("cls") == "open") & (F.col("nb.g") == "colon") & (F.col("nb.p") > F.col("pos") + 1))
         .select(i, F.col("pos").alias("gp"), F.col("nb.p").alias("gc"), F.col("cl").alias("ge")))
    g = (g.withColumn("__r", F.row_number().over(Window.partitionBy(i, F.coalesce("ge", F.lit(-1))).orderBy("gp")))
         .where(F.col("__r") == 1).drop("__r"))
    # lambda groups: λ, >= 1 name/discard, arrow (renamed, not expanded)
    lam = (w.where((F.col("cls") == "lambda") & (F.col("nn.g") == "arrow") & (F.col("nn.p") > F.col("pos") + 1))
           .select(i, F.col("pos").alias("gp"), F.col("nn.p").alias("gc"), F.lit(None).cast("int").alias("ge")))
    # pattern lambdas: groups that open inside their braces are none
    start = w.where((F.col("cls") == "lambda") & (F.col("after") == "curlyL")).select(i, F.col("pos").alias("lp"), F.col("cd").alias("ld"))
    end = (start.join(w.where("tag = 'curlyR'").select(i, F.col("pos").alias("q"), "cd"), i, "left")
           .groupBy(i, "lp").agg(F.min(F.when((F.col("q") > F.col("lp")) & (F.col("cd") <= F.col("ld")), F.col("q"))).alias("le"))
           .select(F.col(i).alias("li"), "lp", F.coalesce("le", F.lit(_BIG)).alias("le")))
    inside = (F.col(i) == F.col("li")) & (F.col("gp") > F.col("lp")) & (F.col("gp") < F.col("le"))
    g, lam = g.join(end, inside, "left_anti"), lam.join(end, inside, "left_anti")
    closed = g.where(F.col("ge").isNotNull())
    kg = k.join(closed, (k[i] == closed[i]) & (k["pos"] >= closed["gp"]) & (k["pos"] <= closed["ge"]), "left") \
        .select(k["*"], closed["gp"], closed["gc"], closed["ge"])
    binders = (k.join(g.unionByName(lam), i)
               .where((F.col("pos") > F.col("gp")) & (F.col("pos") < F.col("gc")) & (F.col("cls") == "name"))
               .select(i, "pos", "value", "gp"))
    fb = (binders.groupBy(i, "value").agg(F.min("pos").alias("f"), F.min_by("gp", F.col("pos")).alias("fp"))
          .withColumn("o", F.dense_rank().over(Window.partitionBy(i).orderBy("f")) - 1))
    rn = kg.join(fb, [i, "value"], "left")
    renamed = ((F.col("cls") == "name") & (F.col("pos") >= F.col("f")) &
               ~((F.col("pos") > F.coalesce(F.col("gc"), F.lit(_BIG))) & (F.col("fp") == F.col("gp"))))
    rn = rn.withColumn("nv", F.when(renamed, F.concat(F.lit("@"), F.col("o").cast("string"))).otherwise(F.col("value")))
    bi = (rn.where((F.col("pos") > F.col("gp")) & (F.col("pos") < F.col("gc")) & F.col("ge").isNotNull())
          .select(i, "gp", F.col("pos").alias("b"), F.col("nv").alias("bv"), F.col("tag").alias("bt")))
    plain = rn.where(F.col("ge").isNull()).select(i, F.col("pos").alias("o1"), F.lit(0).alias("o2"),
                                                  F.col("pos").alias("o3"), F.col("tag"), F.col("nv"))
    grp = rn.where(F.col("ge").isNotNull() & ((F.col("pos") == F.col("gp")) | (F.col("pos") >= F.col("gc") - 1)))
    grp = grp.join(bi, [i, "gp"]).select(
        i, F.col("gp").alias("o1"), F.col("b").alias("o2"), F.col("pos").alias("o3"),
        F.when(F.col("pos") == F.col("gc") - 1, F.col("bt")).otherwise(F.col("tag")).alias("tag"),
        F.when(F.col("pos") == F.col("gc") - 1, F.col("bv")).otherwise(F.col("nv")).alias("nv"))
    out = plain.unionByName(grp)
    return out.select(i, (F.row_number().over(Window.partitionBy(i).orderBy("o1", "o2", "o3")) - 1).alias("pos"),
                      "tag", F.col("nv").alias("value"))


def collect_tokens(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Token rows back to one ordered array per definition (bounded by its size)."""
    return rows.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("tag", "value").alias("t")))),
                    lambda x: x["t"]).alias("toks"))


# ---------------------------------------------------------------- T7-T8
def _let(value: str, var: str, body: str) -> str:
    """SQL ``let var = value in body`` through a one-element ``transform``."""
    return f"transform(array({value}), {var} -> {body})[0]"


def _range(n: str) -> str:
    """``1..n`` (empty when n < 1; ``sequence(1, 0)`` would count down)."""
    return f"if(({n}) > 0, sequence(1, {n}), cast(array() AS array<int>))"


def _run_len(arr: str, tag: str) -> str:
    """Length of the leading run of ``tag`` in ``arr``."""
    pos = f"array_position(transform({arr}, t -> t.tag != '{tag}'), true)"
    return f"if({pos} = 0, size({arr}), {pos} - 1)"


def _depth(arr: str) -> str:
    """Parenthesis depth after each token (braces do not nest)."""
    return (f"transform({_range(f'size({arr})')}, i -> "
            f"size(filter(slice({arr}, 1, i), t -> t.tag = 'parenL')) - "
            f"size(filter(slice({arr}, 1, i), t -> t.tag = 'parenR')))")


def _slice(arr: str, start: str, length: str) -> str:
    return f"if(({length}) > 0, slice({arr}, {start}, {length}), slice({arr}, 1, 0))"


def parts_sql(col: str, strict_parity: bool = False) -> str:
    """SQL for one parse step of the token array in column ``col``.

    Result ``array<array<token>>``: trailing ``}`` dropped (with a leading
    ``{`` each), outer ``( … )`` pairs dropped (only pairs that match each
    other unless ``strict_parity``), an arrow implied between ``}`` and a
    following ``(``/``{``, then a split at arrows outside parentheses with an
    empty trailing part dropped.  One part means a leaf.
    """
    k = _run_len("reverse(__a)", "curlyR")
    m = _run_len("__a", "curlyL")
    curly = _let(col, "__a", _let(k, "__k", _let(m, "__m", _slice("__a", "least(__k, __m) + 1",
                                                                  "size(__a) - __k - least(__k, __m)"))))
    a = _run_len("__b", "parenL")
    b = _run_len("reverse(__b)", "parenR")
    if strict_parity:
        pairs = "least(__ra, __rb)"
    else:
        pairs = (f"size(filter({_range('least(__ra, __rb)')}, q -> size(__b) - 2 * q + 1 > 0 "
                 f"AND array_min(slice(__d, q, size(__b) - 2 * q + 1)) >= q))")
    paren = _let(curly, "__b", _let(a, "__ra", _let(b, "__rb", _let(_depth("__b"), "__d",
                 _let(pairs, "__q", _slice("__b", "__q + 1", "size(__b) - 2 * __q"))))))
    implied = _let(paren, "__c", "flatten(transform(" + _range("size(__c)") + ", i -> "
                   "if(i > 1 AND element_at(__c, i - 1).tag = 'curlyR' AND element_at(__c, i).tag IN ('parenL', 'curlyL'), "
                   "array(named_struct('tag', 'arrow', 'value', '->'), element_at(__c, i)), array(element_at(__c, i)))))")
    bounds = ("concat(array(0), filter(" + _range("size(__s)") + ", i -> element_at(__s, i).tag = 'arrow' "
              "AND element_at(__ds, i) = 0), array(size(__s) + 1))")
    inner = _let(_depth("__s"), "__ds", _let(bounds, "__bd",
                 "transform(sequence(2, size(__bd)), j -> " +
                 _slice("__s", "element_at(__bd, j - 1) + 1", "element_at(__bd, j) - element_at(__bd, j - 1) - 1") +
                 ")"))
    # nothing left after stripping: the reference indexes position -1 (V8)
    split = _let(implied, "__s", f"if(size(__s) = 0, cast(array() AS array<array<{TOKEN_T}>>), {inner})")
    return _let(split, "__p", "if(size(__p) > 1 AND size(element_at(__p, -1)) = 0, slice(__p, 1, size(__p) - 1), __p)")


def _leaf_node(toks: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("kind"), F.size(toks).alias("n"),
                            F.transform(toks, lambda t: t["value"]).alias("vals"),
                            F.transform(toks, lambda t: t["tag"]).alias("tags")))


def parse_canonical(sigs: DataFrame, id_col: str = "id", toks: str = "toks",
                    strict_parity: bool = False) -> DataFrame:
    """``(id, enc, top, error)``: canonical preorder encoding of every
    signature and the encodings of its top-level parts (a leaf is its own part).

    ``error`` is set (and ``enc`` NULL) when a part is empty (V8).
    """
    i = id_col
    ensure_checkpoint_dir(sigs.sparkSession)
    d = sigs.select(F.max(F.expr(f"array_max(transform({_depth(toks)}, x -> x))")).alias("d")).first()["d"]
    max_depth = int(d or 0) + 2
    seg = sigs.select(i, F.array().cast("array<int>").alias("path"), F.col(toks).alias("__in"))
    leaves, funcs = [], []
    empty_paths = None
    step_sql = parts_sql("__in", strict_parity)
    for depth in range(max_depth + 2):
        # materialise every round: keeps plans small and cuts lineage (reliable checkpoint)
        stepped = _ckpt(seg.withColumn("__parts", F.expr(step_sql)))
        bad = stepped.where(F.size("__parts") == 0).select(i)
        empty_paths = bad if empty_paths is None else empty_paths.unionByName(bad)
        leaves.append(stepped.where(F.size("__parts") == 1)
                      .select(i, "path", F.lit(depth).alias("depth"), _leaf_node(F.col("__parts")[0]).alias("enc")))
        fn = stepped.where(F.size("__parts") > 1)
        funcs.append(fn.select(i, "path", F.lit(depth).alias("depth"), F.size("__parts").alias("arity")))
        seg = fn.select(i, F.posexplode("__parts").alias("__k", "__in"), "path")             .select(i, F.concat("path", F.array("__k")).alias("path"), "__in")
    # bottom-up: a function's encoding = its node + its children's encodings, sorted
    node = F.array(F.struct(F.lit(1).alias("kind"), F.col("arity").cast("int").alias("n"),
                            F.array().cast("array<string>").alias("vals"),
                            F.array().cast("array<string>").alias("tags")))
    enc = None
    for depth in reversed(range(len(leaves))):
        cur = leaves[depth].select(i, "path", "enc", F.array("enc").alias("top"))
        if enc is not None:
            parent = enc.select(i, F.slice("path", 1, F.size("path") - 1).alias("path"), "enc")
            grouped = parent.groupBy(i, "path").agg(F.array_sort(F.collect_list("enc")).alias("__kids"))
            fenc = (funcs[depth].join(grouped, [i, "path"])
                    .select(i, "path", F.concat(node, F.flatten("__kids")).alias("enc"), F.col("__kids").alias("top")))
            cur = cur.unionByName(fenc)
        enc = cur
    root = enc.where(F.size("path") == 0).select(i, "enc", "top")
    bad = empty_paths.distinct().withColumn("error", F.lit("empty signature part"))
    return (sigs.select(i).join(root, i, "left").join(bad, i, "left")
            .select(i, F.when(F.col("error").isNull(), F.col("enc")).alias("enc"),
                    F.when(F.col("error").isNull(), F.col("top")).alias("top"), "error"))


# ---------------------------------------------------------------- columns
def signature_columns(enc: Column) -> dict[str, Column]:
    """Derived columns of SURVEY §1.3 from a canonical encoding."""
    leaves_enc = F.filter(enc, lambda e: e["kind"] == 0)
    leaves = F.transform(leaves_enc, lambda e: F.transform(F.arrays_zip(e["tags"], e["vals"]),
                                                           lambda z: F.struct(z["tags"].alias("tag"),
                                                                              z["vals"].alias("value"))))
    shape = F.array_join(F.transform(enc, lambda e: F.when(e["kind"] == 0, F.lit("E"))
                                     .otherwise(F.concat(F.lit("F"), e["n"].cast("string")))), " ")
    arity = F.when(F.get(enc, 0)["kind"] == 1, F.get(enc, 0)["n"]).otherwise(F.lit(1))
    nested = F.size(F.filter(enc, lambda e: e["kind"] == 1)) > 1
    firsts = F.transform(leaves_enc, lambda e: F.struct(F.get(e["tags"], 0).alias("tag"),
                                                        F.get(e["vals"], 0).alias("value")))
    last_comp = F.transform(leaves_enc, lambda e: F.concat(F.coalesce(F.get(e["tags"], 0), F.lit("")), F.lit(":"),
                                                           F.regexp_extract(F.coalesce(F.get(e["vals"], 0), F.lit("")),
                                                                            r"([^.]*)$", 1)))
    return {
        "shape": shape,
        "leaves": leaves,
        "parts": F.when(~nested, leaves),
        "arity": F.when(enc.isNotNull(), arity.cast("int")),
        "has_nested": nested,
        "mentions": F.array_distinct(F.flatten(F.transform(leaves_enc, lambda e: e["vals"]))),
        "exact_key": F.xxhash64(shape, firsts),
        "leaf_keys": F.array_distinct(last_comp),
    }


def build_signatures(defs: DataFrame, id_col: str, text: str, strict_parity: bool = False,
                     unicode: bool = True) -> DataFrame:
    """T1 + T4-T9: ``(id, toks, enc, signature columns..., error)`` for each definition
    with a non-NULL ``text``."""
    ensure_checkpoint_dir(defs.sparkSession)
    src = _ckpt(defs.where(F.col(text).isNotNull()).select(id_col, text))
    rows = rename_binders(token_rows(src, id_col, text, unicode), id_col)
    arrays = _ckpt(src.select(id_col).join(collect_tokens(rows, id_col), id_col, "left")
                   .select(id_col, F.coalesce("toks", F.array().cast(f"array<{TOKEN_T}>")).alias("toks")))
    canon = parse_canonical(arrays, id_col, "toks", strict_parity)
    out = arrays.join(canon, id_col)
    cols = signature_columns(F.col("enc"))
    return out.select(id_col, "toks", "enc", "top", *[c.alias(k) for k, c in cols.items()],
                      part_keys(F.col("top")).alias("part_keys"), "error")


def leaf_key(e: Column) -> Column:
    return F.concat(F.coalesce(F.get(e["tags"], 0), F.lit("")), F.lit(":"),
                    F.regexp_extract(F.coalesce(F.get(e["vals"], 0), F.lit("")), r"([^.]*)$", 1))


def part_keys(top: Column) -> Column:
    """Blocking keys for related search: the keys of the top-level leaf parts,
    or, when every part is a function, all leaf keys of the first part."""
    # an empty leaf relates to anything, so it never serves as a (necessary) blocking key
    leaf_parts = F.filter(top, lambda p: (F.get(p, 0)["kind"] == 0) & (F.get(p, 0)["n"] > 0))
    first = F.filter(F.coalesce(F.get(top, 0), F.array()), lambda e: (e["kind"] == 0) & (e["n"] > 0))
    return F.array_distinct(F.when(F.size(leaf_parts) > 0, F.transform(leaf_parts, lambda p: leaf_key(F.get(p, 0))))
                            .otherwise(F.transform(first, leaf_key)))
