"""Batch search over a definition index.

Many queries run in one job.  Each branch of the reference's disjunctive test
(name OR type) is an equi-join producing candidate ``(query_id, def_id)``
pairs; the branches are unioned and aggregated, never OR-joined.

* J3 exact name: query terms = definition name.
* J4 loose name: a query term is mentioned by the definition's signature (V1).
* J5 exact signature: equi-join on ``exact_key`` (hash of shape and first
  token of every leaf -- necessary for prefix-equal leaves), residual check of
  shape and leaves.  Signatures with an empty leaf match any leaf at that
  position, so they meet on ``shape`` alone.
* J6 related signature: equal signatures are one class on either side. All
  keys of the shorter side's part with the least summed frequency are looked
  up in the postings of the other side; candidates must share a key in every
  part and are then matched natively (signatures with functions inside
  functions inside a part by a recursive check). Empty leaves, which fit
  anything, have a branch of their own.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint as _ckpt
from pyspark.sql import types as T

from ..functions import relations as rel
from . import signature
from .extract import DEF_KEY

QUERY_DEFAULTS = {"search_names": True, "strict_names": True, "search_types": True, "strict_types": True}


def clean_query(q: Column) -> Column:
    """Trim, newlines and tabs to spaces."""
    return F.trim(F.translate(q, "\n\t", "  "))


def query_terms(q: Column) -> Column:
    """T13 + V9: the query's words, empty ones dropped."""
    return F.filter(F.split(clean_query(q), " "), lambda x: x != "")


def prepare_queries(queries: DataFrame, query_types: DataFrame | None = None) -> DataFrame:
    """Queries with their switches, name terms and (if a type is known) signature.

    ``queries(query_id, query, [search_names, strict_names, search_types, strict_types])``;
    ``query_types(query_id, type_normalised, error)`` comes from a checker.
    Without it the query text is its own type (raw, not normalised).
    """
    q = queries
    for c, v in QUERY_DEFAULTS.items():
        q = q.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in q.columns else F.lit(v))
    q = q.withColumn("terms", query_terms(F.col("query")))
    if query_types is not None:
        qt = query_types.select("query_id", "type_normalised", F.col("error").alias("type_error"))
        q = q.join(qt, "query_id", "left")
        ttext = F.when(F.col("type_error").isNull(), F.coalesce("type_normalised", clean_query(F.col("query"))))
    else:
        ttext = clean_query(F.col("query"))
    q = q.withColumn("type_text", F.when(F.col("search_types"), ttext))
    sig = signature.build_signatures(q.select("query_id", "type_text"), "query_id", "type_text")
    sig = sig.where(F.col("error").isNull()).drop("error", "toks")
    sig = sig.select("query_id", *[F.col(c).alias(f"q_{c}") for c in sig.columns if c != "query_id"])
    # one row per query: materialised so every search branch reads it, not its plan
    return _ckpt(q.join(sig, "query_id", "left"))


# ------------------------------------------------------------------ scope
def _scoped(defs: DataFrame, q: DataFrame) -> bool:
    return "places" in defs.columns and "places" in q.columns


def _places(scoped: bool) -> list[str]:
    return ["places"] if scoped else []


def _meet(q: DataFrame, defs: DataFrame, key: str, scoped: bool) -> DataFrame:
    """Join of queries and definitions on ``key`` and, with scopes, on a place they share: a definition outside a
    query's scope is never a candidate. A pair that shares several places comes several times."""
    if not scoped:
        return q.join(defs, key)
    at = lambda df: df.select(*[c for c in df.columns if c != "places"], F.explode("places").alias("__place"))
    return at(q).join(at(defs), [key, "__place"]).drop("__place")


# ------------------------------------------------------------------ names
# Terms up to this number are broadcast: definitions then meet them where they are, however often a term occurs.
BROADCAST_TERMS = 100_000


def _few(terms: DataFrame) -> DataFrame:
    """Broadcast hint if the counted terms are few; otherwise a shuffle join, whose hot terms AQE splits."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def name_hits(defs: DataFrame, q: DataFrame) -> DataFrame:
    """Definitions whose name is one of the query's terms."""
    scoped = _scoped(defs, q)
    terms = (q.where(F.col("search_names"))
             .select("query_id", *_places(scoped), F.explode("terms").alias("name")).distinct())
    hits = _meet(_few(terms), defs.select("def_id", *_places(scoped), "name"), "name", scoped).select("query_id", "def_id")
    return hits.distinct() if scoped else hits


def loose_hits(defs: DataFrame, q: DataFrame) -> DataFrame:
    """J4 (V1): definitions whose signature mentions one of the query's terms."""
    scoped = _scoped(defs, q)
    terms = (q.where(F.col("search_names") & ~F.col("strict_names"))
             .select("query_id", *_places(scoped), F.explode("terms").alias("m")).distinct())
    ments = (defs.where(F.col("mentions").isNotNull())
             .select("def_id", *_places(scoped), F.explode(F.array_distinct("mentions")).alias("m")))
    return _meet(_few(terms), ments, "m", scoped).select("query_id", "def_id").distinct()


# ------------------------------------------------------------------ types
def _has_empty_leaf(leaves: Column) -> Column:
    return F.exists(leaves, lambda l: F.size(l) == 0)


def exact_hits(defs: DataFrame, q: DataFrame) -> DataFrame:
    """Same signature (order-insensitive, prefix-compared leaves)."""
    scoped = _scoped(defs, q)
    qs = q.where(F.col("search_types") & F.col("strict_types") & F.col("q_enc").isNotNull()) \
        .select("query_id", *_places(scoped), "q_shape", "q_leaves", "q_exact_key")
    d = defs.where(F.col("enc").isNotNull()).select("def_id", *_places(scoped), "shape", "leaves", "exact_key")
    check = (F.col("q_shape") == F.col("shape")) & rel.leaves_same(F.col("q_leaves"), F.col("leaves"))

    def meet(q_side: DataFrame, d_side: DataFrame, key: str) -> DataFrame:
        return _meet(q_side.withColumn("__key", F.col(f"q_{key}")), d_side.withColumn("__key", F.col(key)), "__key",
                     scoped).where(check)

    q_empty = qs.where(_has_empty_leaf(F.col("q_leaves")))
    d_empty = d.where(_has_empty_leaf(F.col("leaves")))
    main = meet(qs.where(~_has_empty_leaf(F.col("q_leaves"))), d.where(~_has_empty_leaf(F.col("leaves"))), "exact_key")
    by_shape_q, by_shape_d = meet(q_empty, d, "shape"), meet(qs, d_empty, "shape")
    return (main.select("query_id", "def_id").unionByName(by_shape_q.select("query_id", "def_id"))
            .unionByName(by_shape_d.select("query_id", "def_id")).distinct())


def _prefixes(e: Column) -> Column:
    """Hashes of a leaf's first 1, 2, ... names (tag and last component of each), in this order."""
    names = F.transform(F.arrays_zip(e["tags"], e["vals"]),
                        lambda z: F.concat(F.coalesce(z["tags"], F.lit("")), F.lit(":"), F.regexp_extract(F.coalesce(z["vals"], F.lit("")), r"([^.]*)$", 1)))
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.xxhash64(F.array_join(F.slice(names, 1, i), "\u0001")))


def _open_keys(e: Column) -> Column:
    """Keys under which a leaf is found: each of its beginnings, and the whole."""
    own = _prefixes(e)
    return F.concat(F.transform(own, lambda h: F.xxhash64(F.lit("begins"), h)), F.array(F.xxhash64(F.lit("is"), F.element_at(own, -1))))


def _asked_keys(e: Column) -> Column:
    """Keys of the leaves that a leaf fits: those that begin with it, and those that are a shorter beginning of it."""
    own = _prefixes(e)
    shorter = F.filter(own, lambda h, i: i < F.size(own) - 1)
    return F.concat(F.array(F.xxhash64(F.lit("begins"), F.element_at(own, -1))), F.transform(shorter, lambda h: F.xxhash64(F.lit("is"), h)))


def signature_classes(df: DataFrame, id_col: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Equal signatures as one class: ``(id, cls)`` of the members, and a row for each class with what the search
    for related signatures needs; both from a stored table.

    ``open`` holds the keys under which a class is found. ``need`` are the parts that only a signature with one of
    their keys can fit: parts with keys and without an empty leaf or function inside (which fit anything). ``deep``
    tells functions inside functions inside a part. Equality is taken on a SHA-256 of the whole encoding; keys are
    64-bit hashes and only ever admit pairs, which are then checked."""
    c = lambda name: F.col(prefix + name)
    rows = df.where(c("enc").isNotNull()).select(id_col, F.sha2(F.to_json(c("enc")), 256).alias("named"), *[c(n).alias(n) for n in ("enc", "top", "arity")])
    leaves = lambda p: F.filter(p, lambda e: (e["kind"] == 0) & (e["n"] > 0))
    hollow = lambda p: F.exists(p, lambda e: e["n"] == 0)
    keys = lambda p, of: F.array_distinct(F.flatten(F.transform(leaves(p), of)))
    need = F.filter(F.transform(F.filter("top", lambda p: ~hollow(p)), lambda p: keys(p, _asked_keys)), lambda k: F.size(k) > 0)
    deep = F.exists("top", lambda p: F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda e: e["kind"] != 0))
    one = rows.groupBy("named").agg(*[F.first(n).alias(n) for n in ("enc", "top", "arity")])
    one = _ckpt(one.select(F.monotonically_increasing_id().alias("cls"), "*", need.alias("need"), keys(F.flatten("top"), _open_keys).alias("open"),
                           F.exists("top", hollow).alias("hollow"), deep.alias("deep"), _shallow_parts(F.col("top")).alias("parts")))
    return rows.select(id_col, "named").join(one.select("named", "cls"), "named").drop("named"), one.drop("named")


def postings(classes: DataFrame) -> DataFrame:
    """``(key, cls, arity)`` for every open key of a table of ``signature_classes``; a stored table."""
    return _ckpt(classes.select("cls", "arity", F.explode("open").alias("key")))


def probe_keys(classes: DataFrame, post: DataFrame) -> DataFrame:
    """``(cls, arity, key)``: all keys of the part that the fewest postings hold, by their summed frequency."""
    often = post.groupBy("key").agg(F.count("*").alias("freq"))
    parts = classes.select("cls", "arity", F.posexplode("need").alias("part", "keys"))
    cost = (parts.select("cls", "part", F.explode("keys").alias("key")).join(often, "key", "left")
            .groupBy("cls", "part").agg(F.sum(F.coalesce("freq", F.lit(0))).alias("cost")))
    best = cost.groupBy("cls").agg(F.min(F.struct("cost", "part"))["part"].alias("part"))
    return parts.join(best, ["cls", "part"]).select("cls", "arity", F.explode("keys").alias("key"))


def related_candidates(short: DataFrame, long: DataFrame, post: DataFrame, equal_arity: bool) -> DataFrame:
    """Pairs of classes ``(s, l)`` in which the parts of ``s`` may all fit parts of ``l``.

    A part with keys fits only a signature that holds one of them, so the rarest such part of ``s`` is looked up in
    ``post``, the postings of ``long``, and the other parts must share a key as well. An empty leaf or function fits anything: a long side that has one, and a
    short side in which every part has one, meet on their arities, where nearly every pair is a hit. ``equal_arity``
    tells whether a short side may have as many parts as the long one."""
    fewer = (lambda a, b: a <= b) if equal_arity else (lambda a, b: a < b)
    s = short.select(F.col("cls").alias("s"), F.col("arity").alias("n"), F.size("need").alias("probes"))
    by_key = (probe_keys(short, post).select(F.col("cls").alias("s"), F.col("arity").alias("n"), "key")
              .join(post.select("key", F.col("cls").alias("l"), F.col("arity").alias("m")), "key").where(fewer(F.col("n"), F.col("m"))))
    most = F.col("arity") if equal_arity else F.col("arity") - 1
    sizes = long.where(most >= 1).select(F.col("cls").alias("l"), "hollow", F.explode(F.sequence(F.lit(1), most)).alias("n"))
    by_size = s.join(sizes, "n").where(F.col("hollow") | (F.col("probes") == 0))
    pairs = by_key.select("s", "l").unionByName(by_size.select("s", "l")).distinct()
    # Every part that needs a key must find one, not only the rarest.
    pairs = (pairs.join(short.select(F.col("cls").alias("s"), "need"), "s")
             .join(long.select(F.col("cls").alias("l"), "hollow", "open"), "l"))
    shared = F.forall("need", lambda keys: F.arrays_overlap(keys, F.col("open")))
    return _ckpt(pairs.where(F.col("hollow") | shared).select("s", "l"))


_TREE_T = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("n", T.IntegerType()),
                                    T.StructField("vals", T.ArrayType(T.StringType())),
                                    T.StructField("tags", T.ArrayType(T.StringType()))]))


def _tree(enc, pos=0):
    """Preorder encoding -> (node, next position); node = ('E', [(tag, value)]) or ('F', [children])."""
    e = enc[pos]
    if e["kind"] == 0:
        tags = [] if e["tags"] is None else list(e["tags"])
        vals = [] if e["vals"] is None else list(e["vals"])
        return ("E", list(zip(tags, vals))), pos + 1
    kids, p = [], pos + 1
    for _ in range(e["n"]):
        k, p = _tree(enc, p)
        kids.append(k)
    return ("F", kids), p


def _same_name(a: str, b: str) -> bool:
    """Equal, one the other behind a dotted qualifier, or a differing rest before a common ``.suffix``."""
    if a == b or a.endswith("." + b) or b.endswith("." + a):
        return True
    shared = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return 0 < shared < min(len(a), len(b)) and a[-shared] == "."


def _fits(left, right) -> bool:
    """J6 on two trees: leaves pointwise; a leaf fits a function if it fits any part of it; of two functions
    the parts of the one with fewer (``right`` if equal) fit parts of the other in order, where one part may
    serve several."""
    leaf = [t[0] == "E" for t in (left, right)]
    if all(leaf):
        return all(t == u and _same_name(v, w) for (t, v), (u, w) in zip(left[1], right[1]))
    if leaf[0]:
        return any(_fits(left, part) for part in right[1])
    if leaf[1]:
        return any(_fits(part, right) for part in left[1])
    few, many = sorted((right[1], left[1]), key=len)
    place = 0
    for part in few:
        place = next((i for i in range(place, len(many)) if _fits(part, many[i])), None)
        if place is None:
            return False
    return True


@F.pandas_udf(T.BooleanType())
def related_tree_udf(d_enc: pd.Series, q_enc: pd.Series) -> pd.Series:
    """J6 recursion for nested signatures, run on candidate pairs only."""
    out = []
    for d, q in zip(d_enc, q_enc):
        if d is None or q is None:
            out.append(False)
            continue
        out.append(_fits(_tree(list(d))[0], _tree(list(q))[0]))
    return pd.Series(out, dtype=bool)


def _shallow_parts(top: Column) -> Column:
    """Parts as ``(leaf, kids)``: a leaf is its own only kid; for signatures that are not ``deep``."""
    return F.transform(top, lambda p: F.struct(
        (F.get(p, 0)["kind"] == 0).alias("leaf"),
        F.transform(F.filter(p, lambda e: e["kind"] == 0), _leaf_tokens).alias("kids")))


def _part_fits(p: Column, other: Column) -> Column:
    """J6 on two shallow parts; of two functions with as many kids, ``other`` plays the shorter."""
    some = F.exists(p["kids"], lambda x: F.exists(other["kids"], lambda y: rel.leaf_related(x, y)))
    fewer = F.size(p["kids"]) < F.size(other["kids"])
    both = F.when(fewer, rel.flat_related(p["kids"], other["kids"])).otherwise(rel.flat_related(other["kids"], p["kids"]))
    return F.when(p["leaf"] | other["leaf"], some).otherwise(both)


def related_pairs(pairs: DataFrame, short: DataFrame, long: DataFrame) -> DataFrame:
    """The candidate pairs of classes ``(s, l)`` that are related: parts are matched in order, natively up to
    functions inside the signature; only pairs with deeper functions go to the recursive check."""
    side = lambda df, name: df.select(F.col("cls").alias(name), *[F.col(c).alias(name + c) for c in ("enc", "parts", "deep")])
    both = pairs.join(side(short, "s"), "s").join(side(long, "l"), "l")
    deep = F.col("sdeep") | F.col("ldeep")
    flat = both.where(~deep).where(rel.flat_related(F.col("sparts"), F.col("lparts"), _part_fits))
    rest = both.where(deep).where(related_tree_udf(F.col("lenc"), F.col("senc")))
    return flat.select("s", "l").unionByName(rest.select("s", "l"))


def related_hits(defs: DataFrame, q: DataFrame) -> DataFrame:
    """Related signatures (shorter side's parts found in order in the longer).

    Equal signatures are one class on either side; classes meet in both directions (the query plays the shorter side
    where both have as many parts) and members are joined back at the end."""
    asked = q.where(F.col("search_types") & ~F.col("strict_types"))
    q_of, qs = signature_classes(asked, "query_id", "q_")
    d_of, ds = signature_classes(defs, "def_id")
    q_short = related_pairs(related_candidates(qs, ds, postings(ds), True), qs, ds).select(F.col("s").alias("qc"), F.col("l").alias("dc"))
    d_short = related_pairs(related_candidates(ds, qs, postings(qs), False), ds, qs).select(F.col("l").alias("qc"), F.col("s").alias("dc"))
    found = _ckpt(q_short.unionByName(d_short))
    scoped = _scoped(defs, q)
    if scoped:
        q_of = q_of.join(q.select("query_id", "places"), "query_id")
        d_of = d_of.join(defs.select("def_id", "places"), "def_id")
    asking = found.join(q_of.withColumnRenamed("cls", "qc"), "qc").drop("qc")
    return (_meet(asking, d_of.withColumnRenamed("cls", "dc"), "dc", scoped)
            .select("query_id", "def_id").distinct())


def _leaf_tokens(e: Column) -> Column:
    return F.transform(F.arrays_zip(e["tags"], e["vals"]),
                       lambda z: F.struct(z["tags"].alias("tag"), z["vals"].alias("value")))


# ------------------------------------------------------------------ J7/J8
def search(defs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Every definition once per query that it satisfies by name or by type.

    ``defs`` should be a materialised index (``read_index`` or a checkpoint),
    ``prepared`` the result of ``prepare_queries``.

    Output ``(query_id, def_id, by_name, by_type)``.  A query with names and
    types both off (or a failed type and names off) yields nothing (J8).
    """
    parts = [name_hits(defs, prepared).withColumn("n", F.lit(True)).withColumn("t", F.lit(False)),
             loose_hits(defs, prepared).withColumn("n", F.lit(True)).withColumn("t", F.lit(False)),
             exact_hits(defs, prepared).withColumn("n", F.lit(False)).withColumn("t", F.lit(True)),
             related_hits(defs, prepared).withColumn("n", F.lit(False)).withColumn("t", F.lit(True))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("query_id", "def_id").agg(F.bool_or("n").alias("by_name"), F.bool_or("t").alias("by_type"))


def index_definitions(defs: DataFrame, id_col: str = "def_id", type_col: str = "type_raw",
                      strict_parity: bool = False) -> DataFrame:
    """Definitions with their canonical signature columns (T1, T4-T9) and a
    ``sig_error`` for signatures that fail (V8).  The signature text of a plain
    signature is its raw type without the leading colon (or a checker's
    normalised type when one is joined in as ``type_normalised``).

    Every distinct signature text is parsed once and joined back to its rows, so repeated or null ids stay rows of
    their own. Rows with a failed check (``type_error``) are not indexed; ``index_errors`` reports them."""
    text = F.regexp_replace(F.col(type_col), r"^\s*:\s*", "")
    if "type_normalised" in defs.columns:
        text = F.coalesce(F.col("type_normalised"), text)
    if "type_error" in defs.columns:  # a failed check is an error, never a definition
        defs = defs.where(F.col("type_error").isNull())
    columns = [id_col, *[c for c in defs.columns if c != id_col]]
    defs = _ckpt(defs.withColumn("__sig", text))
    # the checkpoint freezes the numbers
    texts = _ckpt(defs.select("__sig").where("__sig is not null").distinct()
                  .withColumn("__text_id", F.monotonically_increasing_id()))
    sig = signature.build_signatures(texts, "__text_id", "__sig", strict_parity)
    sig = sig.withColumnRenamed("error", "sig_error").drop("toks").join(texts, "__text_id").drop("__text_id")
    return defs.join(sig, "__sig", "left").select(*columns, *[c for c in sig.columns if c != "__sig"])


def index_errors(defs: DataFrame, index: DataFrame, id_col: str = "def_id") -> DataFrame:
    """``(id, library, module, inner_path, name, stage, error)``, one row for every row that failed.

    ``defs`` is the input of ``index_definitions`` (stage ``check``: its ``type_error``) and ``index`` its result
    (stage ``signature``: ``sig_error``). Rows of ``defs`` are thus either in the index or here with stage
    ``check``; a signature that fails is here and stays in the index by name. Key columns that ``defs`` lacks are
    left out, empty tables give no rows."""
    keys = [c for c in (id_col, *DEF_KEY) if c in defs.columns]
    failed = index.where(F.col("sig_error").isNotNull()).select(*keys, F.lit("signature").alias("stage"), F.col("sig_error").alias("error"))
    if "type_error" not in defs.columns:
        return failed
    return (defs.where(F.col("type_error").isNotNull())
            .select(*keys, F.lit("check").alias("stage"), F.col("type_error").alias("error")).unionByName(failed))


def _imports(text: str, separators: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda x: x != "")


def _imported_libraries() -> Column:
    return _imports("imported_libraries", "[, \\t\\n]")


def _imported_modules() -> Column:
    return _imports("imported_modules", "\\n")


def query_scope(queries: DataFrame) -> DataFrame:
    """Libraries and modules each query imports itself.

    Libraries are split on commas, tabs, newlines and spaces, modules on
    newlines; duplicates are kept.  Queries with ``include_examined`` also
    import every row of ``examined_scope`` -- that shared list is kept as its
    own table rather than copied once per query.
    """
    libs = queries.select("query_id", F.lit("library").alias("kind"), F.explode(_imported_libraries()).alias("name"))
    mods = queries.select("query_id", F.lit("module").alias("kind"), F.explode(_imported_modules()).alias("name"))
    return libs.unionByName(mods)


def examined_scope(selected: DataFrame) -> DataFrame:
    """Libraries and modules of the current selection ``(library, module)``, in order."""
    ex = selected.select("library", "module")
    return (ex.select(F.lit("library").alias("kind"), F.col("library").alias("name")).distinct()
            .unionByName(ex.select(F.lit("module").alias("kind"), F.col("module").alias("name"))))


def scoped_queries(prepared: DataFrame) -> DataFrame:
    """Queries with the ``places`` they search: the libraries and modules they import and, with
    ``include_examined``, the examined selection, which is one place whatever its size.

    Reads the columns ``imported_libraries``, ``imported_modules`` and ``include_examined`` as far as they are there;
    null means none. A query without any place finds nothing."""
    def place(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.concat(F.lit(kind), n))

    parts = [F.array().cast("array<string>")]
    if "imported_libraries" in prepared.columns:
        parts.append(place("library:", _imported_libraries()))
    if "imported_modules" in prepared.columns:
        parts.append(place("module:", _imported_modules()))
    if "include_examined" in prepared.columns:
        parts.append(F.when(F.col("include_examined"), F.array(F.lit("examined"))).otherwise(parts[0]))
    return prepared.withColumn("places", F.array_distinct(F.concat(*parts)))


def placed_definitions(defs: DataFrame, examined: DataFrame | None = None) -> DataFrame:
    """Definitions ``(library, module, ...)`` with the ``places`` they are found in: their library, their module
    and, for modules in ``examined(library, module)``, the examined selection. ``search`` of these for
    ``scoped_queries`` stays in each query's scope. A null library or module is no place."""
    own = F.array(F.concat(F.lit("library:"), "library"), F.concat(F.lit("module:"), "module"))
    if examined is None:
        return defs.withColumn("places", F.array_compact(own))
    mark = examined.select("library", "module").distinct().withColumn("__examined", F.lit("examined"))
    return (defs.join(mark, ["library", "module"], "left")
            .withColumn("places", F.array_compact(F.concat(own, F.array("__examined")))).drop("__examined"))
