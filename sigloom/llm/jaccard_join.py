"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles. Two sets of sizes m and n with a Jaccard similarity of
at least t share a token among their first ``size - ceil(t * size) + 1`` tokens in any common order, so only
these prefixes are joined. Rare tokens come first: tokens are ordered by how often their hash bucket occurs
in the whole corpus (a table of fixed size; the order changes the speed, never the result).

1. Documents with the same set are one vertex (its id: a hash of the set); vertices with the same prefix and
   size are one group, and groups, not documents, are joined on prefix tokens.
2. Star round: on each token every group is compared only with one centre (three choices of centre, by token,
   so that one odd centre cannot keep a cluster apart), and a vertex with the first vertex of its group. On
   tokens whose groups still lie in several components a second star takes the group as the centre that shares
   most of its prefix: among many altered copies of one text that is the least altered. A cluster of near
   copies of any size falls into few components after work in proportion to its members.
3. Cross round: on every token whose groups still lie in several components, the groups outside its largest
   component are paired with those of other components; the pairs of groups are expanded to pairs of vertices.
   Pairs inside a component need no test: they can only confirm it.
4. Pairs of groups are cut by their sizes and by the positions of the shared token, then by the number of
   prefix tokens they share: of the two, the one whose prefix ends first has no shared token beyond those but
   in the rest behind its prefix. Each pair that is left is verified on the whole sets. Only documents in such
   pairs have their sets built.

Defined results: a null or empty text, and a text without words, has ``n_shingles`` 0 and is linked with
nothing. A null ``doc_id`` takes part like any other; ``component_id`` is the smallest non-null id of the
component (null if there is none), and rows without words carry their own ``doc_id``. Repeated rows are one
vertex and all returned. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash as th
from .common import components, row_key, settle, small, store, text_batches

TOKEN_MASK = np.uint64((1 << 48) - 1)  # tokens of the join; equal low bits can only add candidates
ORDER_BITS = 20  # 2^20 counters: 4 MB while counted, 1 MB when broadcast


def _bucket_counts(bits: int, k: int):
    def count(batches):
        table = np.zeros(1 << bits, np.int64)
        for batch in batches:
            buf, offs = th.utf8(batch.column(0))
            for i, j in th.slices(offs):
                h, at = th.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], value=th.FOLDED)
                s = th.windows(h, k)
                inside = np.ones(len(s), bool)
                for d in at[1:-1]:  # windows over the border of two texts
                    inside[max(0, d - k + 1):d] = False
                table += np.bincount((s[inside] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.astype("<i8").tobytes(), 1)], pa.binary())], ["t"])
    return count


def _add(a: bytes, b: bytes) -> bytes:
    if not a or not b:
        return a or b
    x, y = (np.frombuffer(zlib.decompress(v), "<i8") for v in (a, b))
    return zlib.compress((x + y).tobytes(), 1)


def token_classes(docs: DataFrame, k: int, bits: int = ORDER_BITS) -> np.ndarray:
    """For each hash bucket the rounded logarithm of its count over all documents; size fixed by ``bits``."""
    counted = docs.select("text").mapInArrow(_bucket_counts(bits, k), "t binary")
    total = counted.rdd.map(lambda r: bytes(r.t)).treeAggregate(b"", _add, _add, depth=3)
    table = np.frombuffer(zlib.decompress(total), "<i8") if total else np.zeros(1 << bits, np.int64)
    return np.round(4 * np.log2(table + 1)).astype(np.uint8)


def _set_id(s: np.ndarray) -> np.uint64:
    return th.mix(np.array([np.add.reduce(th.mix(s))], np.uint64) + np.uint64(len(s)))[0]


def _prefixes(classes, bits: int, k: int, num: int, den: int):
    def run(batches):
        cls = classes.value
        for batch in batches:
            ids = batch.column(0)
            buf, offs = th.utf8(batch.column(1))
            for i, j in th.slices(offs):
                h, at = th.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], value=th.FOLDED)
                n, fp, grp, pre = [], [], [], []
                for d in range(j - i):
                    s = th.shingles(h[at[d]:at[d + 1]], k)
                    size = len(s)
                    keep = size - -(-num * size // den) + 1 if size else 0
                    rank = np.argsort(cls[s >> np.uint64(64 - bits)], kind="stable")[:keep]
                    first = s[rank]
                    n.append(size)
                    fp.append(_set_id(s).view(np.int64))
                    grp.append(_set_id(np.append(first, np.uint64(size))).view(np.int64))
                    pre.append((first & TOKEN_MASK).view(np.int64))
                lens = np.cumsum([0, *map(len, pre)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(grp, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(lens, pa.int32()),
                                              pa.array(np.concatenate(pre) if pre else [], pa.int64()))],
                    ["doc_id", "n", "fp", "grp", "prefix"])
    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            buf, offs = th.utf8(batch.column(0))
            for i, j in th.slices(offs):
                h, at = th.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], value=th.FOLDED)
                sets = [th.shingles(h[at[d]:at[d + 1]], k) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_id(s).view(np.int64) for s in sets], pa.int64()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["fp", "s"])
    return run


def _linked(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), "<u8"), np.frombuffer(b[i].as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])
    return run


def _verify(pairs: DataFrame, docs: DataFrame, vertex: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs of vertices ``(a, b)`` whose whole sets are similar enough."""
    pairs = store(pairs.distinct())
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    # One long as the key (null ids hash alike): equal hashes can only add sets that no pair asks for. A null-safe
    # join has two keys, whose broadcast table would start at 64 MB of the driver's memory.
    need = small(store(vertex.join(ends, "fp").select(F.xxhash64("doc_id").alias("id")).distinct()))
    sets = store(docs.join(need, F.xxhash64(docs["doc_id"]) == need["id"], "left_semi").select("text")
                 .mapInArrow(_sets(k), "fp long, s binary").dropDuplicates(["fp"]))
    both = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b"))
    found = store(both.select("a", "b", "sa", "sb").mapInArrow(_linked(num, den), "a long, b long"))
    settle(docs.sparkSession)
    return found


def _fold(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root(v, root)`` with the further ``links(a, b)``: only the components that these join are worked on."""
    if links.isEmpty():
        return root
    top = root.toDF("v", "r")
    over = (links.join(top.toDF("a", "ra"), "a", "left").join(top.toDF("b", "rb"), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    joined = components(over).toDF("r", "r2")
    return store(root.join(joined, root["root"] == joined["r"], "left")
                 .select("v", F.coalesce("r2", "root").alias("root"))
                 .unionByName(joined.join(root, joined["r"] == root["v"], "left_anti").toDF("v", "root")))


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    ``threshold`` is the similarity as a fraction of whole numbers, so ties are exact."""
    spark, (num, den) = docs.sparkSession, threshold
    text_batches(spark)
    docs = docs.select("doc_id", "text")
    classes = spark.sparkContext.broadcast(token_classes(docs, k))
    rows = store(docs.mapInArrow(_prefixes(classes, ORDER_BITS, k, num, den),
                                 "doc_id long, n int, fp long, grp long, prefix array<long>"))
    classes.destroy()  # the rows are stored
    settle(spark)
    vertex = store(rows.where("n > 0").groupBy("fp")
                   .agg(F.min("doc_id").alias("doc_id"), F.first("grp").alias("grp"), F.first("n").alias("n")))
    group = (vertex.groupBy("grp").agg(F.min("fp").alias("lead"), F.max("fp").alias("last"),
                                       F.first("n").alias("n")))
    # Joins on two columns are merges: their broadcast tables would start at 64 MB of the driver's memory each.
    # Postings of tokens that occur in several rows, and of these, by group.
    post = rows.where("n > 0").select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    # Stored: a join of two plain shuffles lets Spark split the partition of a hot token.
    often = store(post.groupBy("token").count().where("count > 1").select("token"))
    post = store(post.join(often, "token").groupBy("token", "grp").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))

    def may_link(n1, pos1, n2, pos2):
        """Sizes are near enough, and what is left from the shared token on can hold the overlap."""
        n1, pos1, n2, pos2 = F.col(n1), F.col(pos1), F.col(n2), F.col(pos2)
        overlap = F.ceil((n1 + n2) * num / (num + den) - 1e-9)
        return (den * F.least(n1, n2) >= num * F.greatest(n1, n2)) & (F.least(n1 - pos1, n2 - pos2) >= overlap)

    def shared_enough(pairs: DataFrame, g1: str, g2: str) -> DataFrame:
        """The pairs of groups that share enough tokens of their prefixes, counted on the postings."""
        one, two = (post.select(F.col("grp").alias(g), "token", F.col("n").alias(n)) for g, n in ((g1, "n1"), (g2, "n2")))
        count = (pairs.select(g1, g2).distinct().join(one, g1).join(two.hint("merge"), [g2, "token"])
                 .groupBy(g1, g2).agg(F.count("*").alias("shared"), F.first("n1").alias("n1"), F.first("n2").alias("n2")))
        overlap = F.ceil((F.col("n1") + F.col("n2")) * num / (num + den) - 1e-9)
        rest = F.ceil(F.greatest("n1", "n2") * num / den - 1e-9) - 1  # behind the longer prefix
        return count.where(F.col("shared") + rest >= overlap).select(g1, g2)

    # Star round.
    draw = post.withColumn("h", F.xxhash64("grp", F.pmod("token", F.lit(3))))
    centre = draw.groupBy("token").agg(F.min("h").alias("h"), F.max("h").alias("h1")).where("h <> h1").select("token", "h")
    centre = draw.join(centre.hint("merge"), ["token", "h"]).select("token", *[F.col(c).alias(c + "0") for c in ("grp", "n", "pos")])
    lead = group.select("grp", "lead")
    star = post.join(centre, "token").where((F.col("grp") != F.col("grp0")) & may_link("n", "pos", "n0", "pos0"))
    star = (shared_enough(star, "grp", "grp0").join(lead, "grp")
            .join(lead.select(F.col("grp").alias("grp0"), F.col("lead").alias("lead0")), "grp0")
            .select(F.least("lead", "lead0").alias("a"), F.greatest("lead", "lead0").alias("b")))
    crowd = store(group.where("lead <> last").select("grp", "lead", "n"))
    inner = vertex.join(crowd.select("grp", "lead"), "grp").where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    tried = store(star.unionByName(inner.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    root = components(_verify(tried, docs, vertex, k, num, den))
    settle(spark)

    active = store(post.select("grp").union(crowd.select("grp")).distinct())

    def unresolved(root: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Vertices with their components, and the postings of tokens whose groups lie in several of them
        (``main``: the largest). A group of several vertices is a list of its own."""
        live = vertex.join(active, "grp").join(root.withColumnRenamed("v", "fp"), "fp", "left")
        live = store(live.select("fp", "grp", F.coalesce("root", "fp").alias("root")))
        lists = (post.select("token", "grp", "n", "pos")
                 .unionByName(crowd.select(F.col("grp").alias("token"), "grp", "n", F.lit(0).alias("pos"))))
        lists = lists.join(live.select("grp", "root").distinct(), "grp")
        split = (lists.groupBy("token", "root").count().groupBy("token")
                 .agg(F.max_by("root", "count").alias("main"), F.min("root").alias("r0"), F.max("root").alias("r1"))
                 .where("r0 <> r1").select("token", "main"))
        return live, store(lists.join(split, "token"))

    live, lists = unresolved(root)

    # Second star: on each token the group with the smallest share of prefix tokens that no other group has.
    if not lists.isEmpty():
        prefix = F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1
        alone = (post.groupBy("grp").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
                 .select("grp", F.floor((1 - F.col("shared") / prefix) * (1 << 20)).cast("long").alias("alone")))
        best = live.groupBy("grp", "root").agg(F.min("fp").alias("fp")).join(alone, "grp", "left")
        key = F.coalesce("alone", F.lit(1 << 20)) * (1 << 42) + F.pmod(F.xxhash64("grp", "root"), F.lit(1 << 42))
        draw = store(lists.join(best.withColumn("h", key).hint("merge"), ["grp", "root"]))
        centre = draw.groupBy("token").agg(F.min("h").alias("h"))
        centre = draw.join(centre.hint("merge"), ["token", "h"]).select("token", *[F.col(c).alias(c + "0") for c in ("grp", "n", "pos", "root", "fp")])
        star = (draw.join(centre, "token").where((F.col("root") != F.col("root0")) & may_link("n", "pos", "n0", "pos0"))
                .select("grp", "grp0", "fp", "fp0").distinct())
        star = star.where("grp = grp0").unionByName(
            star.join(shared_enough(star.where("grp <> grp0"), "grp", "grp0").hint("merge"), ["grp", "grp0"]).select(star.columns))
        star = star.select(F.least("fp", "fp0").alias("a"), F.greatest("fp", "fp0").alias("b"))
        star = store(star.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"))
        tried, root = tried.unionByName(star), _fold(root, _verify(star, docs, vertex, k, num, den))
        settle(spark)
        live, lists = unresolved(root)

    # Cross round, on what the stars left in several components.
    if not lists.isEmpty():
        x = lists.where("root <> main").select("token", *[F.col(c).alias(c + "x") for c in ("grp", "n", "pos", "root")])
        y = lists.select("token", *[F.col(c).alias(c + "y") for c in ("grp", "n", "pos", "root", "main")])
        cross = (x.join(y, "token")
                 .where((F.col("rootx") != F.col("rooty"))
                        & ((F.col("rooty") == F.col("mainy")) | (F.col("grpx") < F.col("grpy"))
                           | ((F.col("grpx") == F.col("grpy")) & (F.col("rootx") < F.col("rooty"))))
                        & may_link("nx", "posx", "ny", "posy"))
                 .select("grpx", "rootx", "grpy", "rooty").distinct())
        same = F.col("grpx") == F.col("grpy")
        cross = store(cross)
        cross = cross.where(same).unionByName(
            cross.join(shared_enough(cross.where(~same), "grpx", "grpy").hint("merge"), ["grpx", "grpy"]).select(cross.columns))
        m = live.select("fp", "grp", "root")
        pairs = (cross.join(m.toDF("x", "grpx", "rootx").hint("merge"), ["grpx", "rootx"])
                 .join(m.toDF("y", "grpy", "rooty").hint("merge"), ["grpy", "rooty"])
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        root = _fold(root, _verify(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), docs, vertex, k, num, den))

    of = vertex.join(root.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = store(of.select("fp", "root", "doc_id"))
    settle(spark)
    name = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (rows.join(of.select("fp", "root").join(name, "root").select("fp", "component_id"), "fp", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each component the one with the smallest ``doc_id``, once if its row is
    repeated, and every row without words or without ``doc_id``. Rows of equal ``doc_id`` go or stay together.
    Columns are those of ``docs``."""
    got = store(jaccard_components(docs, **options).select("doc_id", "component_id").where("doc_id is not null"))
    gone = small(store(got.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()))
    left = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    twice = store(got.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice")))
    if twice.isEmpty():
        return left
    twice = small(twice)
    again = left["doc_id"] == twice["twice"]
    return left.join(twice, again, "left_anti").unionByName(left.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_first_rows(docs: DataFrame, **options) -> DataFrame:
    """Like ``keep_first``, but decided row by row, also for null and repeated ids: of each component the row with
    the smallest ``doc_id`` stays (any id before a null one; of rows with that id the smallest hash), once if it is
    repeated, and every row without words, once if it is repeated. Columns are those of ``docs``."""
    keyed = docs.select("text", row_key().alias("doc_id"))
    got = store(jaccard_components(keyed, **options).where("n_shingles > 0")
                .select(F.col("doc_id").alias("key"), "component_id").distinct())
    ids = store(docs.select(row_key().alias("key"), "doc_id").distinct())
    ranked = store(got.join(ids, "key").select("key", "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "key").alias("rank")))
    first = store(ranked.groupBy("component_id").agg(F.min("rank")["key"].alias("stays")))
    gone = small(store(ranked.join(first, "component_id").where("key <> stays").select(F.col("key").alias("gone"))))
    twice = small(store(docs.groupBy(row_key().alias("twice")).count().where("count > 1").select("twice")))
    left = docs.withColumn("__key", row_key()).join(gone, F.col("__key") == F.col("gone"), "left_anti")
    again = F.col("__key") == F.col("twice")
    once = left.join(twice, again, "left_semi").dropDuplicates(["__key"])
    return left.join(twice, again, "left_anti").unionByName(once).select(docs.columns)
