import os

from pyspark.sql import functions as F

from sigloom.operators import extract, search
from sigloom.operators.correlate import fifo_pairs
from sigloom.streaming import incremental, sessions, standing


def test_incremental_index_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    (src / "A").mkdir(parents=True)
    (src / "A" / "B.src").write_text("module A.B where\nf : X -> Y\ng : Y\n")
    (src / "C.src").write_text("module C where\nh : Z\n")
    (src / "skip.txt").write_text("x : Y\n")
    out, ck = str(tmp_path / "idx"), str(tmp_path / "ck")
    listener = incremental.ProgressCollector()
    spark.streams.addListener(listener)
    q = incremental.start_indexing(spark, str(src), ".src", "lib", out, ck, max_files_per_trigger=1)
    q.awaitTermination(300)
    spark.streams.removeListener(listener)
    got = sorted((r["module"], r["name"]) for r in incremental.read_latest(spark, out).collect())
    assert got == [("A.B", "f"), ("A.B", "g"), ("C", "h")]
    assert sum(b["input_rows"] for b in listener.batches) == 2

    # Standing search over the appended index
    qs = spark.createDataFrame([(1, "h", True, True, False, True), (2, "Y -> X", False, True, True, True)],
                               "query_id long, query string, search_names boolean, strict_names boolean, "
                               "search_types boolean, strict_types boolean")
    prepared = search.prepare_queries(qs)
    hits_path = str(tmp_path / "hits")
    sq = standing.start_standing_search(spark, out, prepared, hits_path, str(tmp_path / "ck2"))
    sq.awaitTermination(300)
    hits = spark.read.parquet(hits_path).collect()
    assert sorted((r["query_id"], r["by_name"], r["by_type"]) for r in hits) == [(1, True, False), (2, False, True)]


def test_online_fifo_equals_batch(spark, tmp_path):
    rows = []
    for s in range(5):
        for t in range(30):
            k = "view" if (s + t * 7) % 3 else "buy"
            rows.append((s, t, s * 100 + t, k))
    df = spark.createDataFrame(rows, "sid int, t int, eid bigint, kind string")
    d = str(tmp_path / "ev")
    for part in range(3):  # three files, in time order
        df.where((F.col("t") >= part * 10) & (F.col("t") < part * 10 + 10)).coalesce(1) \
            .write.mode("append").parquet(d)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d)
    out = sessions.online_fifo(stream, "sid", "t", "eid", "kind", {"view": {"buy"}})
    q = out.writeStream.format("memory").queryName("fifo_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT sid, req_eid, resp_eid FROM fifo_out").collect()}
    want = {tuple(r) for r in fifo_pairs(df, ["sid"], ["t"], F.col("kind") == "view", F.col("kind") == "buy",
                                         "eid").collect()}
    assert got == want and len(got) > 0
