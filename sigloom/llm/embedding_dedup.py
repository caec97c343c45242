"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on Gaussian directions; ``floor((a.v + b) / width)`` of ``k`` projections is
a bucket, and there are several tables of buckets. A pair at distance c falls into one cell of a projection
with probability p(c) (2-stable distribution), so the number of projections follows from the number of vectors
(to leave about ``NOISE`` unrelated vectors beside each) and the number of tables from the wanted recall of a
pair just at the threshold; closer pairs are found more often. Every pair that meets is checked with its exact
cosine in double precision; a pair that meets in several tables counts in the first of them only.

A bucket of any size is cut into blocks of ``BLOCK`` vectors and its pairs of blocks are separate cells, so no
task holds more than two blocks of one bucket. Pairs are not written out: a cell returns for each vector its
number of links and the smallest vector it reaches in the cell. Equal vectors are one vertex with a count.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and one without
label, links with nothing (``n_links`` 0, its own component, kept). Vectors of other lengths never link. A row
without ``vec_id`` links like any other but does not name a component. Repeated rows are vectors of their own
that link with each other. Other columns are ignored. An empty table gives an empty result. Vertices are told
apart by a 64-bit hash of label and components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, store

THRESHOLD, RECALL, WIDTH, NOISE, BLOCK, SEED = 0.98, 0.99, 2.0, 100, 1024, 7


def collision(distance: float, width: float) -> float:
    """Probability that two points at ``distance`` share a cell of one projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """``(projections of a table, tables)`` for ``n`` vectors."""
    near = collision(math.sqrt(2 - 2 * threshold), width)
    far = collision(1.3, width)
    k = max(2, math.ceil(math.log(max(n, 2) / NOISE) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-near ** k))


def _keys(k: int, tables: int, width: float):
    def run(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        dims = vectors.map(len)
        for dim, at in dims.groupby(dims).groups.items():
            rng = np.random.default_rng([SEED, int(dim)])
            a, b = rng.standard_normal((int(dim), tables * k)), rng.uniform(0, width, tables * k)
            x = np.stack(vectors[at].to_list()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cell = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, k)
            for row, keys in zip(at, cell.tolist()):
                out[row] = keys
        return out
    return run


def _links(pdf: pd.DataFrame, tables: int, threshold: float) -> pd.DataFrame:
    """Links of the cells in one bin; ``side`` tells the blocks of a cell apart (0 and 1, or 2 for one block)."""
    out = []
    for _, g in pdf.groupby(["bucket", "bi", "bj"], sort=False):
        if len(g) < 2:
            continue
        x = np.stack(g["embedding"].to_list()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        one = bool((g["bi"].iat[0] == g["bj"].iat[0]))
        left = np.arange(len(g)) if one else np.flatnonzero((g["block"] == g["bi"]).to_numpy())
        right = left if one else np.flatnonzero((g["block"] == g["bj"]).to_numpy())
        if not len(left) or not len(right):
            continue
        near = x[left] @ x[right].T >= threshold
        if one:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        if not len(i):
            continue
        keys, t = np.stack(g["keys"].to_list()), int(g["t"].iat[0])
        fresh = np.ones(len(i), bool)
        for earlier in range(t):
            fresh &= keys[i, earlier] != keys[j, earlier]
        copies = g["copies"].to_numpy()
        n = np.bincount(i[fresh], copies[j[fresh]], len(g)) + np.bincount(j[fresh], copies[i[fresh]], len(g))
        reach = np.arange(len(g))
        while True:  # smallest index reachable in the cell
            nxt = reach.copy()
            np.minimum.at(nxt, i, reach[j])
            np.minimum.at(nxt, j, reach[i])
            nxt = nxt[nxt]
            if (nxt == reach).all():
                break
            reach = nxt
        hit = np.flatnonzero((n > 0) | (reach != np.arange(len(g))))
        v = g["v"].to_numpy()
        out.append(pd.DataFrame({"v": v[hit], "links": n[hit].astype(np.int64), "to": v[reach[hit]]}))
    return pd.concat(out) if out else pd.DataFrame({"v": [], "links": [], "to": []}).astype("int64")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                    width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``."""
    e = F.col("embedding")
    usable = (F.col("label").isNotNull() & e.isNotNull()
              & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(e, lambda c: c != 0))
    rows = store(vectors.select("vec_id", "label", "embedding", F.when(usable, F.xxhash64("label", "embedding")).alias("v")))
    vertex = (rows.where("v is not null").groupBy("v")
              .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"),
                   F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    k, tables = plan_tables(rows.count(), threshold, recall, width)
    cells = F.pandas_udf(_keys(k, tables, width), "array<array<long>>")
    vertex = store(vertex.withColumn("c", cells("embedding")).select(
        "v", "embedding", "copies", "least",
        F.transform("c", lambda x, t: F.xxhash64(t, "label", F.size("embedding"), x)).alias("keys")))
    slots = vertex.select("v", F.posexplode("keys").alias("t", "bucket"))
    sizes = slots.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    bins = max(1, total // (2 * block))
    crowd = (slots.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("t", "bucket", "v", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
                     F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(bins))).otherwise(
                         F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))).alias("bin")))
    found = store(crowd.join(vertex.select("v", "embedding", "copies", "keys"), "v").groupBy("bin")
                  .applyInPandas(lambda p: _links(p, tables, threshold), "v long, links long, to long"))
    root = components(found.select("v", "to"), "v", "to")
    of = (vertex.select("v", "copies", "least")
          .join(found.groupBy("v").agg(F.sum("links").alias("links")), "v", "left").join(root, "v", "left")
          .select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least",
                  F.coalesce("root", "v").alias("root")))
    of = store(of)
    name = of.groupBy("root").agg(F.min("least").alias("component_id"))
    got = rows.select("vec_id", "v").join(of.join(name, "root").select("v", "n_links", "component_id"), "v", "left")
    own = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
