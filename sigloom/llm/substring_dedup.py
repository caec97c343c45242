"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of every window of ``length`` words the smallest hash among its ``seed``-word
grams. Equal windows have equal anchors, so a passage of at least ``length`` words that two documents share
gives both a common anchor, and only about two anchors per ``length - seed + 2`` words are joined.

Around an anchor that several documents hold, the match is extended to the left and to the right: each window
whose anchor it is, at every offset before and behind the seed, is matched by its own hash over all words.
Matched windows that overlap or touch are merged; the merged spans are the maximal repeats of at least
``length`` words. A window counts for a document if the smallest ``doc_id`` that has it is smaller than its own.

Both matches are aggregates with map-side combine followed by a join on the aggregated key, so a passage that
a third of all documents share is no hot task, and no pairs of its holders are formed.

Defined results: a null text has no words; a text below ``length`` words keeps all. A row without ``doc_id``
loses nothing and is no one's smaller document. Repeated rows are treated alike, each returned. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_hash as th
from .common import small, store, text_batches

LENGTH, SEED = 50, 20
# Lists of anchors are broadcast up to so many values (32 MB), else joined by a shuffle.
BROADCAST_VALUES = 4_000_000


def _anchors(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The anchor of every window of ``length`` words of one text."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    return th.sliding_min(th.windows(h, seed), length - seed + 1)


def _digest(text: memoryview | bytes) -> str:
    return hashlib.sha256(b" ".join(bytes(text).split())).hexdigest()


def _scan(length: int, seed: int):
    """Of every text: number of words, digest of all words, hash of the word sequence, its anchors."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            buf, offs = th.utf8(batch.column(1))
            for i, j in th.slices(offs):
                part, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                h, at = th.words(part, o)
                n = np.diff(at)
                whole, found = [], []
                for d in range(j - i):
                    own = h[at[d]:at[d + 1]]
                    whole.append(_whole(own))
                    found.append(np.unique(_anchors(own, length, seed)).view(np.int64))
                lens = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(n, pa.int64()), pa.array([_digest(part[o[d]:o[d + 1]]) for d in range(j - i)], pa.string()),
                     pa.array(whole, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(lens, pa.int32()),
                                              pa.array(np.concatenate(found) if found else [], pa.int64()))],
                    ["doc_id", "n_words", "sha", "whole", "anchors"])
    return run


def _whole(h: np.ndarray) -> int:
    """Hash of a text's word sequence."""
    return int(th.windows(h, len(h)).view(np.int64)[0]) if len(h) else 0


def _windows(length: int, seed: int):
    """Hashes and places of the windows whose anchor is in the row's list, if the list is of this text."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            buf, offs = th.utf8(batch.column(1))
            for i, j in th.slices(offs):
                h, at = th.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                for d in range(j - i):
                    own = h[at[d]:at[d + 1]]
                    anchor = _anchors(own, length, seed)
                    if not len(anchor) or batch.column(3)[i + d].as_py() != (whole := _whole(own)):
                        continue
                    wanted = batch.column(2)[i + d].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    place = np.flatnonzero(np.isin(anchor, wanted))
                    hashes = th.windows(own, length)[place].view(np.int64)
                    doc = np.full(len(place), ids[i + d].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes), pa.array(doc), pa.array(np.full(len(place), whole, np.int64)), pa.array(place.astype(np.int32))],
                        ["window", "doc_id", "whole", "place"])
    return run


def _cut():
    """Texts without the words of the given spans (pairs of first word, word after the last)."""
    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "whole": [], "removed": [], "kept": []}
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer().to_pybytes()
                if _whole(th.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]) != batch.column(1)[i].as_py():
                    continue  # another row with this doc_id
                words = text.split()
                kept, last, removed = [], 0, 0
                for span in batch.column(3)[i]:
                    s, e = span["s"].as_py(), span["e"].as_py()
                    kept += words[last:s]
                    removed, last = removed + e - s, e
                kept += words[last:]
                out["doc_id"].append(batch.column(0)[i].as_py())
                out["whole"].append(batch.column(1)[i].as_py())
                out["removed"].append(removed)
                out["kept"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["whole"], pa.int64()),
                 pa.array(out["removed"], pa.int64()), pa.array(out["kept"], pa.string())], list(out))
    return run


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: every row's ``(doc_id, n_words, sha, whole)``, and for documents with repeats
    ``(doc_id, whole, spans)`` with the sorted maximal repeats as ``(s, e)`` word positions.

    ``whole`` (hash of the word sequence) tells rows of equal ``doc_id`` apart. A document equal to an
    earlier one is one span at once and takes no part in the search; the earlier one has all its windows."""
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = store(docs.mapInArrow(_scan(length, seed), "doc_id long, n_words long, sha string, whole long, anchors array<long>"))
    known = rows.where("doc_id is not null")
    first = known.groupBy("whole").agg(F.min("doc_id").alias("first"))
    full = known.where(F.col("n_words") >= length).join(first, "whole")
    later = (full.where("doc_id > first").select("doc_id", "whole", "n_words").distinct()
             .select("doc_id", "whole", F.array(F.struct(F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e"))).alias("spans")))
    seeds = (full.where("doc_id = first").select("doc_id", "whole", F.explode("anchors").alias("anchor")))
    # Stored aggregates: a join of two plain shuffles lets Spark split the partition of a hot key.
    common = store(seeds.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
                   .where("d0 <> d1").select("anchor"))
    held = store(seeds.join(common, "anchor").groupBy("doc_id", "whole").agg(F.collect_set("anchor").alias("anchors")))
    held = small(held, BROADCAST_VALUES, F.size("anchors"))
    found = store(docs.join(held, "doc_id").select("doc_id", "text", "anchors", "whole")
                  .mapInArrow(_windows(length, seed), "window long, doc_id long, whole long, place int"))
    least = store(found.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                  .where("least < most").select("window", "least"))
    hit = (found.join(least, "window").where("least < doc_id")
           .groupBy("doc_id", "whole").agg(F.array_sort(F.collect_set("place")).alias("p")))
    # A span begins at a place that lies more than `length` words behind the one before it.
    begins = F.filter("p", lambda x, i: (i == 0) | (x - F.get("p", i - 1) > length))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) - x > length))
    merged = hit.select("doc_id", "whole", F.zip_with(begins, ends, lambda s, e: F.struct(
        s.alias("s"), (e + length).alias("e"))).alias("spans"))
    return rows.select("doc_id", "n_words", "sha", "whole"), store(merged.unionByName(later))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(rows, cut)``: all rows as in :func:`repeats`, and ``(doc_id, whole, removed, kept)`` for the
    documents that lose words: the number of words removed and the kept words joined by one space."""
    rows, spans = repeats(docs, length, seed)
    whole = spans.where(F.size("spans") > 0)
    cut = (docs.select("doc_id", "text").join(small(whole, BROADCAST_VALUES, 2 * F.size("spans")), "doc_id")
           .select("doc_id", "whole", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), "spans"))
    return rows, cut.mapInArrow(_cut(), "doc_id long, whole long, removed long, kept string")


def removal_report(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs(doc_id, text)``."""
    rows, cut = remove_repeats(docs, length, seed)
    digest = cut.select("doc_id", "whole", "removed", F.sha2("kept", 256).alias("kept_sha")).dropDuplicates(["doc_id", "whole"])
    return (rows.join(digest, ["doc_id", "whole"], "left")
            .select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("kept_sha", "sha").alias("kept_sha256")))
