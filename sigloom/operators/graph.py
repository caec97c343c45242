"""Directed graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, checkpoint as _ckpt


def nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """G1: every endpoint is a node."""
    return (edges.select(F.col(src).alias("node"))
            .unionByName(edges.select(F.col(dst).alias("node"))).distinct())


def reverse(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Reversed edges (parallel edges kept); nodes are unchanged."""
    return edges.select(F.col(dst).alias(src), F.col(src).alias(dst))


# A round's frontier with at most this many names is broadcast, so that the stored edges stay where they are; a larger
# one is joined by a shuffle and never passes through the driver.
BROADCAST_NAMES = 20_000


def _side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A join side of ``rows`` counted rows: broadcast if few, else (or if not counted) always shuffled."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_NAMES else df.hint("merge")


def topological_levels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, level)`` by repeated peeling of nodes without a live in-edge.

    ``level`` is the round a node was peeled in (its longest distance from a
    source).  Nodes on a cycle or downstream of one keep ``level`` NULL (the
    reference drops them silently).  Parallel edges count once; edges with a
    null end are left out, their other end is still a node.

    Every stored edge carries the in-degree of its target.  A round follows the
    out-edges of the nodes peeled last and adds their number to the targets'
    counters; only targets reached so far and not yet full are kept between
    rounds, nodes nobody has reached are not touched.  Edges already followed
    are dropped from the store whenever they are half of it, so that all
    compactions together write at most as many rows as there are edges.  The
    peel ends with the last edge: nodes without out-edges cost no round.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    whole = F.col("s").isNotNull() & F.col("d").isNotNull()
    degree = pairs.where(whole).groupBy(F.col("d").alias("t")).agg(F.count(F.lit(1)).alias("need"))
    ends = _ckpt(pairs.join(_side(degree), F.col("d") == F.col("t"), "left").select("s", "d", "need"))
    live = ends.where(whole)
    everyone = _ckpt(ends.select(F.col("s").alias("node"), F.lit(None).cast("bigint").alias("need"))  # sources need nothing
                     .unionByName(ends.select(F.col("d").alias("node"), "need")).where("node is not null")
                     .groupBy("node").agg(F.max("need").alias("need")))
    frontier = everyone.where("need is null").select("node")
    stored, n_full, followed, level = live.count(), frontier.count(), 0, 0
    reached = None
    done = [frontier.select("node", F.lit(0).alias("level"))]
    while stored > followed:
        level += 1
        steps = live.join(_side(frontier.select(F.col("node").alias("s")), n_full), "s").select("d", "need", F.lit(1).alias("got"))
        if reached is not None:
            steps = steps.unionByName(reached)
        counters = _ckpt(steps.groupBy("d").agg(F.max("need").alias("need"), F.sum("got").alias("got")))
        full = F.col("got") == F.col("need")
        n_full, n_open, got = counters.agg(F.count_if(full), F.count_if(~full),
                                           F.coalesce(F.sum(F.when(full, F.col("got"))), F.lit(0))).first()
        if not n_full:
            break
        frontier = counters.where(full).select(F.col("d").alias("node"))
        reached = counters.where(~full) if n_open else None
        done.append(frontier.select("node", F.lit(level).alias("level")))
        followed += got
        if followed < stored <= 2 * followed:  # targets that are full need no more of their in-edges
            levels = _union(done).select(F.col("node").alias("d"))
            live = _ckpt(live.join(_side(levels), "d", "left_anti"))
            stored, followed = stored - followed, 0
    peeled = _union(done)
    if stored == followed:  # every target is full
        return peeled
    return peeled.unionByName(everyone.select("node").join(_side(peeled), "node", "left_anti")
                              .select("node", F.lit(None).cast("int").alias("level")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def references(entries: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """Edges ``(src=referenced, dst=referencing)`` of a dictionary whose bodies
    refer to other entries as ``(name)``."""
    refs = entries.select(F.col(name).alias("dst"),
                          F.explode(F.regexp_extract_all(F.col(body), F.lit(r"\(([A-Za-z_][A-Za-z0-9_]*)\)"), 1))
                          .alias("src"))
    return refs.distinct()


def expand_dictionary(entries: DataFrame, name: str = "name", body: str = "body",
                      wrap: tuple[str, str] = ("(?:", ")")) -> DataFrame:
    """Expand ``(name)`` references dependents-first.

    Returns ``(name, expanded, error)``; an entry that references an unknown
    name, that sits on a reference cycle, or that reaches such an entry through
    its references keeps ``expanded`` NULL and gets an error.
    Rounds follow the topological levels of the reference graph: the entries of
    a level hand their expansion, or their error, along their references to the
    entries that wait for it.  Entries without a level are on a cycle or refer
    to one.  No side of a join passes through the driver unless it is counted
    and small.
    """
    e = entries.select(F.col(name).alias("name"), F.col(body).alias("body"))
    refs = _ckpt(references(e, "name", "body"))
    known = _side(e.select(F.col("name").alias("src")).distinct())
    unknown = refs.join(known, "src", "left_anti").select(F.col("dst").alias("name")).distinct()
    graph_edges = _ckpt(refs.join(known, "src", "left_semi"))
    peeled = _ckpt(topological_levels(graph_edges, "src", "dst"))
    in_graph = peeled.select(F.col("node").alias("name"), "level", F.lit(True).alias("in_graph"))
    lv = (e.select("name").join(_side(in_graph), "name", "left")
          .select("name", F.when(F.col("in_graph").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level")))
    level_of = lambda node, level: peeled.select(F.col("node").alias(node), F.col("level").alias(level))
    edges = _ckpt(graph_edges.join(_side(level_of("dst", "until")), "dst").where("until is not null")
                  .join(_side(level_of("src", "since")), "src"))
    leveled = _ckpt(e.join(_side(lv.where("level is not null")), "name")
                    .join(_side(unknown.withColumn("bad", F.lit(True))), "name", "left")
                    .select("name", "body", "level", F.coalesce("bad", F.lit(False)).alias("bad")))
    empty_subs = F.array().cast("array<struct<src:string,x:string>>")
    done, waiting = [], None
    for level in sorted(r["level"] for r in leveled.select("level").distinct().collect()):
        nxt = leveled.where(F.col("level") == level).select("name", F.col("body").alias("expanded"), "bad")
        if waiting is not None:
            subs = (waiting.where(F.col("until") == level).groupBy(F.col("dst").alias("name"))
                    .agg(F.array_sort(F.collect_set(F.struct("src", "x"))).alias("subs"), F.bool_or("x_bad").alias("x_bad")))
            nxt = nxt.join(_side(subs), "name", "left").select(
                "name", F.aggregate(F.coalesce("subs", empty_subs), F.col("expanded"), _sub(wrap)).alias("expanded"),
                (F.col("bad") | F.coalesce("x_bad", F.lit(False))).alias("bad"))
        nxt = _ckpt(nxt)
        done.append(nxt)
        handed = (edges.where(F.col("since") == level)
                  .join(_side(nxt.select(F.col("name").alias("src"), F.col("expanded").alias("x"), F.col("bad").alias("x_bad"))), "src")
                  .select("src", "dst", "until", "x", "x_bad"))
        if waiting is not None:
            handed = handed.unionByName(waiting.where(F.col("until") > level))
        waiting = _ckpt(handed)
    done.append(lv.where("level is null").select("name", F.lit(None).cast("string").alias("expanded"), F.lit(True).alias("bad"))
                .distinct())
    return (e.select("name").join(_side(_union(done)), "name", "left")
            .select("name", F.when(~F.col("bad"), F.col("expanded")).alias("expanded"),
                    F.when(F.col("bad"), F.lit("unresolved reference")).alias("error")))


def _sub(wrap: tuple[str, str]):
    def f(acc: Column, s: Column) -> Column:
        return F.replace(acc, F.concat(F.lit("("), s["src"], F.lit(")")),
                         F.concat(F.lit(wrap[0]), s["x"], F.lit(wrap[1])))
    return f
