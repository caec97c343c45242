"""Queries over the supplied tables, one per operator group of the inventory.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables.  Column names match the DuckDB statements in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import abbrev, tokens
from ..operators import correlate, extract, graph, hierarchy, multiset, search, sequence, signature
from ..operators.scan import running
from ..sources import corpus, index, logs
from ..session import checkpoint
from .tables import Tables


def sig_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose baskets are the same signature (order-insensitive)."""
    t = Tables(spark, sf_dir)
    parts = multiset.basket_parts(t.lineitem, t.part)
    return (multiset.same_signature_counts(parts)
            .select(F.col("id").alias("o_orderkey"), "arity", "n_same"))


def sig_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order as a query, the number of orders related to it."""
    t = Tables(spark, sf_dir)
    parts = multiset.basket_parts(t.lineitem, t.part)
    return (multiset.related_signature_counts(parts)
            .select(F.col("id").alias("o_orderkey"), "arity", "n_related"))


def sig_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every brand and type name, the number of order signatures mentioning it."""
    t = Tables(spark, sf_dir)
    parts = multiset.basket_parts(t.lineitem, t.part)
    terms = (t.part.select(F.col("p_brand").alias("term"))
             .unionByName(t.part.select(F.col("p_type").alias("term"))))
    return multiset.mention_counts(parts, terms)


# ------------------------------------------------------------------ sequences
_EV_BY, _EV_ORDER = ["user_id"], ["ts", "event_id"]


def seq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: each user's events split at ``error`` events (delimiter dropped)."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    return sequence.segments(ev, _EV_BY, _EV_ORDER, F.col("event_type") == "error", "event_id")


def seq_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: nesting depth with ``signup`` opening and ``purchase`` closing."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    d = sequence.nesting_depth(ev, _EV_BY, _EV_ORDER, F.col("event_type") == "signup",
                               F.col("event_type") == "purchase")
    return d.select("user_id", "event_id", "depth",
                    sequence.balanced(F.col("depth")).alias("balanced"))


def seq_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2/Q3: each user's first ``purchase`` and its position."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    f = sequence.first_match(ev, _EV_BY, _EV_ORDER, F.col("event_type") == "purchase",
                             "event_id", "first_purchase")
    return f.select("user_id", F.col("first_purchase_value").alias("first_purchase_id"),
                    "first_purchase_pos")


def seq_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: length of each user's leading run of non-error events."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    return sequence.leading_run(ev, _EV_BY, _EV_ORDER, F.col("event_type") != "error", "run")


def seq_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6/Q7/Q8: (previous, current) predicate and a conjunction with nesting depth."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    d = sequence.nesting_depth(ev, _EV_BY, _EV_ORDER, F.col("event_type") == "signup",
                               F.col("event_type") == "purchase")
    p = sequence.with_previous(d, _EV_BY, _EV_ORDER, {"prev_type": F.col("event_type")})
    vp = (F.col("prev_type") == "view") & sequence.value_is("event_type", "purchase")
    return p.select("user_id", "event_id", "prev_type",
                    F.coalesce(vp, F.lit(False)).alias("view_purchase"),
                    F.coalesce(sequence.all_of(vp, F.col("depth") > 0), F.lit(False)).alias("nested_view_purchase"))


def array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2-Q4, Q9 and A5 on the embedding arrays."""
    e = F.col("embedding")
    emb = Tables(spark, sf_dir).embeddings
    return emb.select(
        "vec_id",
        F.size(e).cast("bigint").alias("n"),
        F.size(F.filter(e, lambda x: x < 0)).cast("bigint").alias("n_neg"),
        sequence.array_find_index(e, lambda x: x < 0).alias("first_neg_idx"),
        sequence.array_leading_run(e, lambda x: x >= 0).cast("bigint").alias("lead_nonneg"),
        *[F.get(F.concat(F.slice(e, 2, 3), F.array(sequence.array_from_end(e, 1))), i).alias(f"cut_{i}") for i in range(4)],
        (sequence.array_from_end(e, 1) > F.get(e, 0)).alias("last_gt_first"),
        F.exists(e, lambda x: x > 0.9).alias("any_high"),
        F.forall(e, lambda x: F.abs(x) < 1).alias("all_unit"),
        F.array_contains(F.transform(e, lambda x: x > 0), True).alias("has_pos"))


def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: words of every line flattened into one sequence per document."""
    docs = Tables(spark, sf_dir).documents
    words = F.flatten(F.transform(F.split(F.col("text"), "\n"),
                                  lambda l: F.filter(F.split(l, " "), lambda w: w != "")))
    return docs.select("doc_id", F.posexplode(words).alias("pos", "word"))


# ------------------------------------------------------------------ hierarchy
def _customer_tree(t: Tables) -> DataFrame:
    return (t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
            .join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), "c_nationkey")
            .join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey"))


def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: region > nation > customer, leaf flag ``c_acctbal > 0``, rolled up."""
    tree = _customer_tree(Tables(spark, sf_dir))
    return hierarchy.rollup_tri_state(tree, ["r_name", "n_name"], F.col("c_acctbal") > 0)


def _assignments(t: Tables) -> DataFrame:
    """Selections made on regions and nations, interleaved in time (``seq``)."""
    reg = t.region.select((F.col("r_regionkey") * 2 + 7).alias("seq"), F.array("r_name").alias("path"),
                          (F.col("r_regionkey") % 2 == 0).alias("enabled"))
    nat = (t.nation.join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
           .select(F.col("n_nationkey").alias("seq"), F.array("r_name", "n_name").alias("path"),
                   F.when(F.col("n_nationkey") % 3 == 0, F.lit(False))
                   .when(F.col("n_nationkey") % 3 == 1, F.lit(None).cast("boolean"))
                   .otherwise(F.lit(True)).alias("enabled")))
    return reg.unionByName(nat)


def propagate_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: region and nation selections pushed down to customers, latest wins."""
    t = Tables(spark, sf_dir)
    leaves = _customer_tree(t).select(
        "c_custkey", F.array("r_name", "n_name", F.col("c_custkey").cast("string")).alias("path"))
    return hierarchy.propagate_down(leaves, _assignments(t), "c_custkey")


def string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: roles of every conversation in turn order."""
    c = Tables(spark, sf_dir).conversations
    return c.groupBy("conv_id").agg(hierarchy.ordered_join(F.col("role"), F.col("turn"), ",").alias("roles"),
                                    F.count(F.lit(1)).alias("n_turns"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents processed per (lang, source): labelled = ok, unlabelled = error."""
    t = Tables(spark, sf_dir)
    lab = t.labels.select("doc_id").distinct().withColumn("ok", F.lit(True))
    d = (t.documents.select("doc_id", "lang", "source").join(lab, "doc_id", "left")
         .select("lang", "source", F.col("doc_id").alias("module"),
                 F.when(F.col("ok").isNull(), F.lit("no label")).alias("error")))
    return extract.progress_counts(d, by=["lang", "source"]).select(
        "lang", "source", F.col("processed").alias("n_done"), F.col("indexed").alias("n_ok"), F.col("failed").alias("n_error"))


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents enriched by labels; missing labels default to -1."""
    t = Tables(spark, sf_dir)
    lab = t.labels.select("doc_id", F.col("quality").alias("type_normalised"), F.col("toxic").alias("error"))
    return (extract.attach_inferred_types(t.documents.select("doc_id"), lab, ["doc_id"])
            .select("doc_id", F.coalesce("type_normalised", F.lit(-1)).alias("quality"),
                    F.coalesce("type_error", F.lit(-1)).alias("toxic"),
                    F.col("type_normalised").isNotNull().alias("labelled")))


def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents still to be labelled (anti-join)."""
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id"), "doc_id", "left_anti")


def resolve_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part, the supplier of its first line item (by order, line
    number) among suppliers with a positive balance; otherwise an error row."""
    t = Tables(spark, sf_dir)
    key = F.col("l_partkey").cast("string")
    stock = t.supplier.where(F.col("s_acctbal") > 0).select(F.format_string("%d/stock.src", "s_suppkey").alias("path"))
    shelves = t.lineitem.select(key.alias("library"), F.struct("l_orderkey", "l_linenumber").alias("ord"),
                                F.col("l_suppkey").cast("string").alias("include_dir"))
    parts = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("library"), F.lit("stock").alias("module"))
    found = corpus.resolve_files(parts, shelves, stock, ".src")
    return found.select("p_partkey", F.split_part("source_path", F.lit("/"), F.lit(1)).cast("bigint").alias("s_suppkey"),
                        F.when(F.col("source_path").isNull(), F.lit("no supplier")).alias("error"))


# ------------------------------------------------------------------ graph
def _layer_edges(t: Tables) -> DataFrame:
    def e(df, a, pa, b, pb):
        return df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("src"),
                         F.concat(F.lit(pb), F.col(b).cast("string")).alias("dst"))
    return (e(t.nation, "n_regionkey", "r", "n_nationkey", "n")
            .unionByName(e(t.customer, "c_nationkey", "n", "c_custkey", "c"))
            .unionByName(e(t.orders, "o_custkey", "c", "o_orderkey", "o"))
            .unionByName(e(t.lineitem, "l_orderkey", "o", "l_partkey", "p")))


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peel levels of region > nation > customer > order > part."""
    return graph.topological_levels(_layer_edges(Tables(spark, sf_dir)))


def graph_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph with every edge reversed (parallel edges kept)."""
    return graph.reverse(_layer_edges(Tables(spark, sf_dir)))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: nodes of the layered graph with their in- and out-degree."""
    e = _layer_edges(Tables(spark, sf_dir))
    n = graph.nodes(e)
    outd = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (n.join(outd, "node", "left").join(ind, "node", "left")
            .select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).alias("in_degree")))


# ------------------------------------------------------------------ selection
def module_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the selected modules (library = lang, module = source).

    A module is selected when one of its documents is labelled with quality 1."""
    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", F.col("lang").alias("library"), F.col("source").alias("module"))
    good = t.labels.where(F.col("quality") == 1).select("doc_id").join(docs, "doc_id").select("library", "module").distinct()
    selection = (index.catalog(docs).join(good.withColumn("enabled", F.lit(True)), ["library", "module"], "left")
                 .select("library", "module", F.coalesce("enabled", F.lit(False)).alias("enabled")))
    return index.select_modules(docs, selection).select("doc_id", F.col("library").alias("lang"),
                                                        F.col("module").alias("source"))


def scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names imported by each part (its cleaned name split on
    separators) plus the selected brand, duplicates kept."""
    p = Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("query_id"), search.clean_query(F.col("p_name")).alias("imported_libraries"),
        F.col("p_brand").alias("imported_modules"))
    return search.query_scope(p).select(
        F.col("query_id").alias("p_partkey"), "name",
        F.when(F.col("kind") == "library", F.lit("import")).otherwise(F.lit("selected")).alias("origin"))

# ------------------------------------------------------------------ text
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document with its tag and real position."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    return tokens.token_table(docs, "doc_id", "text").drop("gap").withColumn("pos", F.col("pos").cast("bigint"))


def token_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank text between tokens (the trailing gap is not reported)."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    return tokens.unmatched(docs, "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


LOG_PROMPT = "> "


def _log_lines(t: Tables) -> DataFrame:
    ev = t.events
    line = (F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("junk "), F.col("event_id").cast("string")))
            .otherwise(F.concat(F.when(F.col("event_id") % 3 == 0, F.lit(LOG_PROMPT)).otherwise(F.lit("")),
                                F.lit("("), F.col("event_type"), F.lit(' "'), F.col("props"), F.lit('" '),
                                F.col("user_id").cast("string"), F.lit(")"))))
    return ev.select("event_id", line.alias("line"))


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction-log lines built from events, parsed into tag + arguments."""
    p = logs.parse_log(_log_lines(Tables(spark, sf_dir)), "line", LOG_PROMPT)
    return p.select("event_id", "tag", "args", "error")


# Abbreviation dictionary used over the documents (nested form).
ABBREVIATIONS = {"o": {" ": "ō", "u": "ȣ"}, " th": "þ", "c": {"h": "ç"}, "a": "α",
                 "e": {" ": "ε", "e": "ē"}}


def expand_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a backslash before every o, t and c, expanded."""
    pairs = abbrev.flatten_dictionary(ABBREVIATIONS)
    docs = Tables(spark, sf_dir).documents
    marked = F.regexp_replace(F.col("text"), "([otc])", "\\\\$1")
    return docs.select("doc_id", abbrev.expand(marked, pairs).alias("expanded"))


# Pattern dictionary whose entries refer to others as (name).
PATTERNS = [("vowel", "[aeiouyàâäéèêëîïôöùûüÿœæ]"), ("cons", "[bcdfghjklmnpqrstvwxzç]"),
            ("syll", "(cons)(vowel)+"), ("word2", "(syll)(syll)"), ("closed", "(syll)(cons)")]


def expand_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expand the pattern dictionary dependents-first, then count every
    expanded pattern's matches in every document."""
    d = spark.createDataFrame(PATTERNS, "name string, body string")
    expanded = {r["name"]: r["expanded"] for r in graph.expand_dictionary(d).collect()}
    docs = Tables(spark, sf_dir).documents
    return docs.select("doc_id", *[F.size(F.regexp_extract_all(F.col("text"), F.lit(expanded[n]), 0))
                                   .cast("bigint").alias(f"n_{n}") for n, _ in PATTERNS])


def dict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 over a table: every part as a dictionary entry. Parts of even size are plain, the others refer to the part
    ``p_size`` keys before; where that is before the first part, the reference is unknown and so is all that refers
    to it."""
    p = Tables(spark, sf_dir).part
    body = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(
        F.concat("p_brand", F.lit("(p"), F.greatest(F.col("p_partkey") - F.col("p_size"), F.lit(0)).cast("string"), F.lit(")")))
    return graph.expand_dictionary(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), body.alias("body")))


def fifo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's purchases matched to the earliest pending view."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    return correlate.fifo_pairs(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view",
                                F.col("event_type") == "purchase", "event_id")


def fifo_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds that accept one response; a purchase goes to the earliest pending view or click."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    return correlate.fifo_pairs_by_kind(ev, ["user_id"], ["ts", "event_id"], "event_id", "event_type",
                                        {"view": {"purchase"}, "click": {"purchase"}})


def fifo_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds whose responses overlap; views take purchases, errors take signups, clicks take both."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    return correlate.fifo_pairs_by_kind(ev, ["user_id"], ["ts", "event_id"], "event_id", "event_type",
                                        {"view": {"purchase"}, "click": {"purchase", "signup"}, "error": {"signup"}})

# ------------------------------------------------------------------ extraction
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every document with indentation, first word
    and, for ``name : type`` lines, the declared name."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    ln = extract.lines(docs, ["doc_id"])
    return ln.select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("ind").cast("bigint").alias("ind"), "w",
                     F.when(F.col("line").rlike(extract.SIG_RE), F.regexp_extract("line", extract.SIG_RE, 1))
                     .alias("sig_name"))


def line_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines folded into islands; a line starting with an upper-case letter opens one."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    ln = extract.lines(docs, ["doc_id"])
    isl = running(ln, ["doc_id"], ["n"], {"island": ("max", F.when(F.col("line").rlike(r"^\p{Lu}"), F.col("n")))})
    isl = isl.withColumn("island", F.coalesce("island", F.lit(-1)).cast("bigint"))
    return isl.groupBy("doc_id", "island").agg(
        F.count(F.lit(1)).alias("n_lines"),
        hierarchy.ordered_join(F.col("line"), F.col("n"), " ").alias("folded"))


def _event_lines(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("event_id").cast("int").alias("n"),
                           (F.col("event_id") % 4 * 2).cast("int").alias("ind"),
                           F.col("event_type").alias("w"))


def scope_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines built from each user's events (word = event type, indentation
    2 * (event_id mod 4), in event_id order); every line's parent, depth and
    scope path of ancestor words."""
    ln = _event_lines(Tables(spark, sf_dir))
    a = extract.ancestors(ln, ["user_id"])
    words = ln.select("user_id", F.col("n").alias("an"), F.col("w").alias("aw"))
    path = (a.select("user_id", "n", F.explode("ancs").alias("an")).join(words, ["user_id", "an"])
            .groupBy("user_id", "n").agg(hierarchy.ordered_join(F.col("aw"), F.col("an"), ".").alias("path")))
    return (a.join(path, ["user_id", "n"], "left")
            .select("user_id", F.col("n").cast("bigint").alias("event_id"),
                    F.try_element_at("ancs", F.lit(-1)).cast("bigint").alias("parent_event_id"),
                    F.size("ancs").cast("bigint").alias("depth"), F.coalesce("path", F.lit("")).alias("path")))


def _kind_lines(t: Tables) -> DataFrame:
    e = F.col("event_id").cast("string")
    u = F.col("user_id").cast("string")
    line = (F.when(F.col("event_type") == "signup", F.concat(F.lit("data e"), e, F.lit(" : U"), u, F.lit(" where")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("record e"), e, F.lit(" : U"), u, F.lit(" where")))
            .when(F.col("event_type") == "view", F.concat(F.lit("pattern e"), e, F.lit(" x = U"), u))
            .when(F.col("event_type") == "click", F.concat(F.lit("constructor e"), e))
            .otherwise(F.concat(F.lit("e"), e, F.lit(" : U"), u)))
    return t.events.select("event_id", line.alias("text"))


def kind_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line modules built from events, classified by leading keyword."""
    mods = _kind_lines(Tables(spark, sf_dir))
    d = extract.extract_definitions(mods, ["event_id"], "text")
    return d.select("event_id", "kind", "name", "type_raw",
                    extract.title(F.col("name"), F.col("type_raw")).alias("title"))


def rename_binders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4/T5: ``{w1 w2 ... : p_type} -> w`` from all words of each part name and its
    last one, with bound names renamed and the binder group expanded."""
    p = Tables(spark, sf_dir).part
    w = F.split(F.trim(F.col("p_name")), " +")
    text = F.concat(F.lit("{"), F.array_join(w, " "), F.lit(" : "), F.col("p_type"), F.lit("} -> "), F.element_at(w, -1))
    src = p.select("p_partkey", text.alias("t"))
    rows = signature.rename_binders(signature.token_rows(src, "p_partkey", "t"), "p_partkey")
    arr = signature.collect_tokens(rows, "p_partkey")
    return arr.select("p_partkey", F.array_join(F.transform("toks", lambda x: x["value"]), " ").alias("renamed"))


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every part name as a query (names on, loose);
    a part is a hit when its name (last word) is the word or its signature (the
    name's words and its brand) mentions it; each part once per query."""
    p = Tables(spark, sf_dir).part
    w = F.split(F.trim(F.col("p_name")), " +")
    defs = p.select(F.col("p_partkey").alias("def_id"), F.element_at(w, -1).alias("name"),
                    F.array_distinct(F.concat(w, F.array("p_brand"))).alias("mentions"))
    words = p.select(F.explode(w).alias("term")).distinct()
    q = words.select(F.col("term").alias("query_id"), F.array("term").alias("terms"),
                     F.lit(True).alias("search_names"), F.lit(False).alias("strict_names"))
    hits = (search.name_hits(defs, q).withColumn("exact", F.lit(True))
            .unionByName(search.loose_hits(defs, q).withColumn("exact", F.lit(False))))
    return (hits.groupBy("query_id", "def_id").agg(F.bool_or("exact").alias("exact"))
            .select(F.col("query_id").alias("term"), F.col("def_id").alias("p_partkey"), "exact"))

def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search path over parts as definitions.

    A part named ``small ring`` is the definition ``ring : small -> ring -> (Brand17 -> ECONOMY)``. Queries, by their
    first letter: E asks for every such type with all parts in another order (exact), R for the first word and the
    bracket alone (related), N for a part's last word by name, L for a first word by loose name, X has names and
    types off and finds nothing.
    """
    w = F.split(F.trim(F.col("p_name")), " +")
    p = Tables(spark, sf_dir).part.select("p_partkey", w.alias("w"), F.translate("p_brand", "#", "").alias("brand"),
                                          F.col("p_type").alias("type"))
    inner = F.format_string("(%s -> %s)", "brand", "type")
    turned = F.format_string("(%s -> %s)", "type", "brand")
    defs = checkpoint(search.index_definitions(p.select(
        F.col("p_partkey").alias("def_id"), F.element_at("w", -1).alias("name"),
        F.concat_ws(" -> ", F.col("w"), inner).alias("type_raw"))))

    def asked(kind, query, names, strict_names, types, strict_types):
        return (p.select(query.alias("query")).distinct()
                .select(F.concat(F.lit(kind + ":"), "query").alias("query_id"), "query",
                        *[F.lit(v).alias(c) for c, v in zip(search.QUERY_DEFAULTS,
                                                            (names, strict_names, types, strict_types))]))

    q = (asked("E", F.concat_ws(" -> ", turned, F.reverse("w")), False, True, True, True)
         .unionByName(asked("R", F.concat_ws(" -> ", F.get("w", 0), turned), False, True, True, False))
         .unionByName(asked("N", F.element_at("w", -1), True, True, False, True))
         .unionByName(asked("L", F.get("w", 0), True, False, False, True))
         .unionByName(asked("X", F.get("w", 0), False, True, False, True)))
    return (search.search(defs, search.prepare_queries(q))
            .select("query_id", F.col("def_id").alias("p_partkey"), "by_name", "by_type"))


def search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 with J3-J8: the same search, every query within its own scope.

    A part is a definition of library ``p_type`` and module ``p_brand``, with its words as signature; modules with a
    part of size 50 are examined. Queries: E asks for the words turned round in one library (exact), R for the first
    word in one module (related), N for a name in what is examined, L for a first word by loose name in one library
    and what is examined, X imports nothing and finds nothing.
    """
    w = F.split(F.trim(F.col("p_name")), " +")
    p = Tables(spark, sf_dir).part.select("p_partkey", w.alias("w"), "p_brand", "p_type", "p_size")
    defs = search.index_definitions(p.select(
        F.col("p_partkey").alias("def_id"), F.col("p_type").alias("library"), F.col("p_brand").alias("module"),
        F.element_at("w", -1).alias("name"), F.concat_ws(" -> ", "w").alias("type_raw")))
    examined = p.where("p_size = 50").select(F.col("p_type").alias("library"), F.col("p_brand").alias("module"))
    none = F.lit(None).cast("string")

    def asked(kind, query, library, module, include_examined, *switches):
        return (p.select(query.alias("query"), library.alias("imported_libraries"), module.alias("imported_modules"))
                .distinct()
                .select(F.concat_ws(":", F.lit(kind), "imported_libraries", "imported_modules", "query").alias("query_id"),
                        "*", F.lit(include_examined).alias("include_examined"),
                        *[F.lit(v).alias(c) for c, v in zip(search.QUERY_DEFAULTS, switches)]))

    q = (asked("E", F.concat_ws(" -> ", F.reverse("w")), F.col("p_type"), none, False, False, True, True, True)
         .unionByName(asked("R", F.get("w", 0), none, F.col("p_brand"), False, False, True, True, False))
         .unionByName(asked("N", F.element_at("w", -1), none, none, True, True, True, False, True))
         .unionByName(asked("L", F.get("w", 0), F.col("p_type"), none, True, True, False, False, True))
         .unionByName(asked("X", F.element_at("w", -1), none, none, False, True, True, False, True)))
    placed = checkpoint(search.placed_definitions(defs, examined))
    return (search.search(placed, search.scoped_queries(search.prepare_queries(q)))
            .select("query_id", F.col("def_id").alias("p_partkey"), "by_name", "by_type"))


REGISTERED = ["sig_exact", "sig_related", "sig_contains",
              "seq_split", "seq_nesting", "seq_first", "seq_run", "seq_prev",
              "array_ops", "flatten",
              "tri_state", "propagate_down", "string_agg", "progress", "enrich", "worklist",
              "resolve_first", "topo_levels", "graph_reverse", "graph_nodes", "module_select",
              "scope_union", "tokenise", "token_gaps", "log_parse", "expand_abbrev", "expand_dict", "dict_errors",
              "fifo_match", "fifo_kinds", "fifo_overlap", "line_scan", "line_fold", "scope_lines", "kind_classify", "rename_binders",
              "name_lookup", "search_parts", "search_scope"]
