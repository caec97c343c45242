"""Exact and related signature matching for flat signatures.

A flat signature is a multiset of *parts* (leaves).  Canonical sorting of the
parts (T9) makes the reference's "same signature" test an equality of part
multisets, and its in-order "related" walk a containment test of the shorter
signature's distinct parts in the longer one (sorted order + a pointer that
does not advance after a hit).  These hold when every leaf has the same token
count and identifiers carry no dotted qualifier, which is how
``basket_parts`` builds them; general signatures go through ``search``.

A signature is identified by an order-insensitive fingerprint of two
independent 64-bit hashes of its parts -- sums, split into 32-bit halves so
they cannot overflow, or xors for a set of parts -- and matching is an
equi-join on fingerprints, never a pairwise comparison inside a group.  Only
related signatures collect parts into an array, up to ``ENUM_LIMIT`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, stored

# A signature with more distinct parts than this is not held as an array: it is
# matched through the exact shared-part join instead of the walk over subsets.
ENUM_LIMIT = 1024

# Bits of each filter of the walk: 8 to 16 for a class of signatures, within these bounds.
FILTER_BITS = (1 << 16, 1 << 27)

# Subsets that the walk extends at once, so that its memory is bounded.
WALK_ROWS = 1 << 20

# A round of related counts meets about so many pairs of classes, the first one takes at most so
# many classes, the least round is one slice; what a round shuffles goes when it ends.
ROUND_PAIRS, ROUND_CLASSES, SLICES = 1 << 27, 1 << 20, 1 << 12

# Classes that one task walks: at least, unless the tasks are as many as shuffle partitions; at most.
TASK_CLASSES = 4_000, 50_000

_MASK32 = 0xFFFFFFFF
FP = ("f1", "f2", "f3", "f4")


def _halves(h: Column) -> list[Column]:
    return [h.bitwiseAND(F.lit(_MASK32)), F.shiftrightunsigned(h, 32)]


def leaf_hashes(parts: DataFrame, leaf: str) -> DataFrame:
    """Add the four 32-bit hash pieces of a leaf value (any Spark type)."""
    h1 = F.xxhash64(F.col(leaf))
    h2 = F.xxhash64(F.lit("sigloom#2"), F.col(leaf))
    a, b = _halves(h1)
    c, d = _halves(h2)
    return parts.select("*", a.alias("f1"), b.alias("f2"), c.alias("f3"), d.alias("f4"))


def _fp_sum(prefix: str = "") -> list[Column]:
    return [F.sum(f).alias(prefix + f) for f in FP]


def basket_parts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Order baskets as flat signatures: one leaf ``[brand, type]`` per line item.

    ``(id, leaf array<struct<tag,value>>, tokens array<string>)``; the part
    table is a dimension join the planner may broadcast from its size estimate.
    """
    li = lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("pk"))
    pt = part.select(F.col("p_partkey").alias("pk"), "p_brand", "p_type")
    leaf = F.array(F.struct(F.lit("name").alias("tag"), F.col("p_brand").alias("value")),
                   F.struct(F.lit("name").alias("tag"), F.col("p_type").alias("value")))
    return (li.join(pt, "pk")
            .select("id", leaf.alias("leaf"), F.array("p_brand", "p_type").alias("tokens")))


def signature_fingerprints(parts: DataFrame, id_col: str = "id", leaf: str = "leaf") -> DataFrame:
    """``(id, arity, f1..f4)``: multiset fingerprint of each signature."""
    h = leaf_hashes(parts.select(id_col, leaf), leaf)
    return h.groupBy(id_col).agg(F.count(F.lit(1)).alias("arity"), *_fp_sum())


def same_signature_counts(parts: DataFrame, id_col: str = "id", leaf: str = "leaf") -> DataFrame:
    """J5 over a whole table: for every signature, how many signatures are the same.

    ``(id, arity, n_same)``; ``n_same`` counts the row itself.  Two shuffles of
    fingerprints (per id, then per fingerprint) and one join back; a hot
    fingerprint is pre-aggregated map-side and the join back is split by AQE.
    """
    fp = signature_fingerprints(parts, id_col, leaf)
    keys = ["arity", *FP]
    counts = fp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same"))
    return fp.join(counts, keys).select(id_col, "arity", "n_same")


def _words(bits: Column, n_bits: int) -> list[Column]:
    """Word and mask of a hash's bit in a filter of ``n_bits``."""
    bit = bits.bitwiseAND(F.lit(n_bits - 1))
    return [F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b")]


def _filters(classes: DataFrame, n_bits: int) -> np.ndarray:
    """Two filters of ``n_bits``: the first hashes of all beginnings of all sets, and the second hashes of all sets.

    A filter only saves work: what it lets through wrongly finds no partner."""
    firsts = F.transform(F.col("ps"), lambda p: p["h1"])
    begins = F.transform(F.sequence(F.lit(1), F.size("ps")), lambda i: F.aggregate(
        F.slice(firsts, F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x)))
    rows = (classes.select(F.lit(0).alias("f"), F.explode(begins).alias("h")).select("f", *_words(F.col("h"), n_bits))
            .unionByName(classes.select(F.lit(1).alias("f"), *_words(F.col("s2"), n_bits))))
    words = rows.groupBy("f", "w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros((2, n_bits // 64), dtype=np.int64)
    out[words["f"].to_numpy(), words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def _walk(batches: Iterator[pa.RecordBatch], filters: np.ndarray, n_bits: int) -> Iterator[pa.RecordBatch]:
    """Subsets of every class's set that may be the set of a class: ``(s1, s2)`` and the class's columns but ``ps``
    (its own ``s1, s2`` as ``c1, c2``).

    Sets are sorted, so every subset is reached once, over its beginnings; only
    beginnings that some set has are extended.
    """
    def has(f: int, h: np.ndarray) -> np.ndarray:
        bit = h & (n_bits - 1)
        return (filters[f][bit >> 6] >> (bit & 63)) & 1 == 1

    for batch in batches:
        ps, kept = batch.column("ps"), [x for x in batch.schema.names if x != "ps"]
        ends = ps.offsets.to_numpy().astype(np.int64)
        size, base = np.diff(ends), ends[0]
        parts = ps.flatten()
        h1, h2 = (parts.field(f).to_numpy() for f in ("h1", "h2"))
        last = ends[1:] - base
        row = np.arange(len(size))
        waiting = [(row, ends[:-1] - base, np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64))]
        while waiting:
            row, at, x1, x2 = waiting.pop()  # sets begun with (x1, x2) go on with the parts from ``at``
            left = last[row] - at
            cut = max(1, int(np.searchsorted(np.cumsum(left), WALK_ROWS, "right")))
            if cut < len(row):
                waiting.append((row[cut:], at[cut:], x1[cut:], x2[cut:]))
                row, at, x1, x2, left = row[:cut], at[:cut], x1[:cut], x2[:cut], left[:cut]
            k = np.repeat(np.arange(len(row)), left)
            part = np.arange(len(k)) - np.repeat(np.cumsum(left) - left, left) + at[k]
            x1, x2, row = x1[k] ^ h1[part], x2[k] ^ h2[part], row[k]
            begun = has(0, x1)
            x1, x2, row, part = x1[begun], x2[begun], row[begun], part[begun]
            whole = has(1, x2)
            found = batch.select(kept).take(pa.array(row[whole]))
            yield pa.RecordBatch.from_arrays([pa.array(x1[whole]), pa.array(x2[whole]), *found.columns],
                                             ["s1", "s2", *({"s1": "c1", "s2": "c2"}.get(x, x) for x in kept)])
            more = part + 1 < last[row]
            if more.any():
                waiting.append((row[more], part[more] + 1, x1[more], x2[more]))


def related_signature_counts(parts: DataFrame, id_col: str = "id", leaf: str = "leaf",
                             enum_limit: int = ENUM_LIMIT) -> DataFrame:
    """J6 over a whole table: for every signature q, how many d are related to it.

    The query plays the shorter side when ``arity(q) <= arity(d)``:
    related  <=>  distinct(q) ⊆ parts(d)   if arity(q) <= arity(d)
                  distinct(d) ⊆ parts(q)   otherwise.
    Signatures of one set of parts and one arity are a class. Every class walks
    over the subsets of its set (at most ``enum_limit`` parts) that are the set
    of a class too, along the beginnings of sets that exist, and meets those
    classes on the set's two 64-bit hashes: rows grow with related classes, not
    with 2^k. Parts are shuffled once, by signature, and signatures and classes
    are stored; classes walk in rounds of about ``ROUND_PAIRS`` met classes, so
    the disk that shuffles take does not grow with the pairs. Pairs that involve
    a larger signature are found exactly by a join on shared parts, counting
    shared parts per pair; they are rare because their number is bounded by
    rows / enum_limit.
    """
    h = leaf_hashes(parts.select(id_col, leaf), leaf).where(F.col(id_col).isNotNull())
    h = h.select(id_col, F.shiftleft("f2", 32).bitwiseOR(F.col("f1")).alias("h1"),
                 F.shiftleft("f4", 32).bitwiseOR(F.col("f3")).alias("h2"))
    # all steps below group by the signature first, so this is their only shuffle
    rows = (h.repartition(F.col(id_col)).groupBy(id_col, "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(id_col))))
    sets = stored(rows.groupBy(id_col).agg(
        F.sum("n").alias("arity"), F.max("k").alias("k"), F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= enum_limit, F.struct("h1", "h2")))).alias("ps")))
    key = ["s1", "s2", "arity"]
    shape = sets.select(id_col, "k", *key)
    # a set has one k, so the first array of a class is that of all its signatures (empty for a large set)
    classes = stored(sets.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), F.first("ps").alias("ps"))
                     .withColumn("c", F.monotonically_increasing_id()))
    small = classes.where(F.col("k") <= enum_limit)
    n_small, n_large = classes.agg(F.count_if(F.col("k") <= enum_limit), F.count_if(F.col("k") > enum_limit)).first()
    counts = _class_counts(small, n_small).groupBy("c").agg(F.sum("m").alias("m"))
    hits = (shape.join(classes.select(*key, "c").join(counts, "c"), key, "left")
            .select(id_col, "arity", F.coalesce("m", F.lit(0)).alias("n_related")))
    if not n_large:
        return hits
    return (hits.unionByName(_large_counts(rows.select(id_col, "h1", "h2"), shape, id_col, enum_limit))
            .groupBy(id_col).agg(F.max("arity").alias("arity"), F.sum("n_related").alias("n_related")))


def _class_counts(small: DataFrame, n_small: int) -> DataFrame:
    """``(c, m)``: parts of the number of signatures related to those of class ``c``, to be summed.

    ``small`` is a stored table ``(s1, s2, arity, n, ps, c)`` of ``n_small`` classes; a round takes a slice of them."""
    n_bits = min(max(1 << (8 * n_small).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    shared = small.sparkSession.sparkContext.broadcast(_filters(small, n_bits))
    place = F.pmod(F.xxhash64("c"), F.lit(SLICES))
    # q with its own set of parts, and the classes that hold it
    q = small.select("s1", "s2", F.col("arity").alias("aq"), F.col("n").alias("nq"), F.col("c").alias("cq"))
    # A: arity(d) >= arity(q) and distinct(q) is one of d's subsets; B: the longer one of such a pair as the query
    sides = F.array(F.struct(F.col("cq").alias("c"), F.col("n").alias("m")),
                    F.struct("c", F.when(F.col("aq") < F.col("arity"), F.col("nq")).alias("m")))
    sums, at, width = None, 0, max(1, SLICES * ROUND_CLASSES // max(n_small, ROUND_CLASSES))
    while at < SLICES:
        seen = Observation()
        n = n_small * width // SLICES
        tasks = max(min(shuffle_partitions(small.sparkSession), n // TASK_CLASSES[0] + 1), n // TASK_CLASSES[1])
        met = (small.where((place >= at) & (place < at + width)).select("c", "arity", "n", "ps").repartition(tasks, "c")
               .mapInArrow(lambda b: _walk(b, shared.value, n_bits), "s1 long, s2 long, c long, arity long, n long")
               .observe(seen, F.count(F.lit(1)).alias("pairs")))
        pairs = q.join(met, ["s1", "s2"]).where("aq <= arity").select(F.explode(sides).alias("x")).select("x.*")
        got = stored(pairs.where("m is not null").groupBy("c").agg(F.sum("m").alias("m")))
        sums = got if sums is None else sums.unionByName(got)
        at, width = at + width, max(1, min(8 * width, width * ROUND_PAIRS // max(1, seen.get["pairs"])))
    shared.destroy()
    return sums


def _large_counts(dl: DataFrame, shape: DataFrame, id_col: str, enum_limit: int) -> DataFrame:
    """Pairs with at least one signature of more than ``enum_limit`` distinct parts, via shared distinct parts."""
    big_ids = shape.where(F.col("k") > enum_limit).select(id_col)
    big_parts = dl.join(big_ids, id_col, "left_semi")
    lk = ["h1", "h2"]
    qp = dl.select(F.col(id_col).alias("q"), *lk)
    bp = big_parts.select(F.col(id_col).alias("d"), *lk)
    # (q any, d big) and (q big, d small) — the second via the swapped roles
    pairs_qb = qp.join(bp, lk).groupBy("q", "d").agg(F.count(F.lit(1)).alias("shared"))
    sq = shape.select(F.col(id_col).alias("q"), F.col("arity").alias("aq"), F.col("k").alias("kq"))
    sd = shape.select(F.col(id_col).alias("d"), F.col("arity").alias("ad"), F.col("k").alias("kd"))
    rel = ((F.col("aq") <= F.col("ad")) & (F.col("shared") == F.col("kq"))) | \
          ((F.col("aq") > F.col("ad")) & (F.col("shared") == F.col("kd")))
    c1 = pairs_qb.join(sq, "q").join(sd, "d").where(rel)
    pairs_bq = (bp.withColumnRenamed("d", "q").join(qp.withColumnRenamed("q", "d"), lk)
                .groupBy("q", "d").agg(F.count(F.lit(1)).alias("shared")))
    c2 = (pairs_bq.join(sq, "q").join(sd, "d")
          .where(F.col("kd") <= enum_limit).where(rel))
    return (c1.unionByName(c2).groupBy(F.col("q").alias(id_col), F.col("aq").alias("arity"))
            .agg(F.count(F.lit(1)).alias("n_related")))


def mention_counts(parts: DataFrame, terms: DataFrame, id_col: str = "id",
                   tokens: str = "tokens", term: str = "term") -> DataFrame:
    """For every query term, the number of signatures that mention it."""
    m = parts.select(id_col, F.explode(tokens).alias(term)).distinct()
    n = m.groupBy(term).agg(F.count(F.lit(1)).alias("n_sigs"))
    return (terms.select(term).distinct().join(n, term, "left")
            .select(term, F.coalesce("n_sigs", F.lit(0)).cast("bigint").alias("n_sigs")))
