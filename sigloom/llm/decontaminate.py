"""Benchmark decontamination: BM25 over the test items with block-max WAND, then a check of the overlap.

The inverted index holds the test items (cut into pieces of at most ``PIECE`` words), every training passage
is a query. A passage is a window of two chunks of ``PIECE`` words, a chunk apart, so each occurrence of a
piece lies whole in some passage. Scores are BM25 sums divided by the piece's own score as a query, so one
threshold holds for all pieces.

Pieces lie in blocks; of each term and block the index knows the largest share any piece gets. The WAND test
(the sum of these maxima over the passage's terms must reach the threshold) is done for all passages of a
batch and all blocks with a few numpy calls, and only blocks that pass have their postings scored. It skips
no piece at or above the threshold. Found pairs of document and item are then verified: of the question's and
of the answer's word 5-grams (all words if fewer) at least ``OVERLAP`` must occur in the document. A side of at
most 5 words is a single n-gram, which one changed word would void; with ``whole`` (the registered query and the
pipeline set it to ``WHOLE``) an item with such a side is also found if at least that share of the 5-grams of
question and answer together occurs.

Items with the same words are indexed once, as one list, and get their ids when it is found (equal 64-bit hashes
are taken as equal lists). The index is built on the driver and broadcast in parts, cut by the running size of the
lists: a part has at most ``PART_WORDS`` words and ``PART_PIECES`` pieces and one list more, so copies of an item
add nothing to it; a larger benchmark takes several scans. Documents are read whole and never shuffled, so copies and hot sources cost no more.

Words are runs of letters and digits (any non-ASCII character counts as a letter), A-Z lower-cased. Defined
results: null or empty texts and items without words match nothing; an item with only a question or only an
answer is judged by that. Repeated documents and items are all reported (an equal row once). Rows without
``doc_id`` are reported with a null id. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_hash as th
from .common import row_key, small, store, text_batches

THRESHOLD, OVERLAP, WHOLE, PIECE, BLOCK, K1, B = 0.6, 0.5, 0.5, 64, 4, 1.2, 0.75
PART_WORDS, PART_PIECES, RANGES, GRAM, CELLS, PASSED = 200_000, 16_000, 1024, 5, 4_000_000, 20_000


def _item_words(batches):
    for batch in batches:
        sides = []
        for c in (1, 2):
            h, at = th.words(*th.utf8(batch.column(c)), th.NO_WORD, th.FOLDED)
            sides.append([h[at[i]:at[i + 1]].view(np.int64) for i in range(batch.num_rows)])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.list_(pa.int64())) for s in sides)],
                                         ["item_id", "question", "answer"])


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id, question, answer)`` with word hashes; stored."""
    words = (items.select("item_id", "question", "answer")
             .mapInArrow(_item_words, "item_id long, question array<long>, answer array<long>"))
    return store(words.where("size(question) + size(answer) > 0").distinct()
                 .select("*", F.xxhash64("question", F.size("question"), "answer").alias("list"),
                         F.concat("question", "answer").alias("words")))


def _parts(words: DataFrame) -> DataFrame:
    """``(list, question, answer, words, part)``: every list of words once; stored.

    A list weighs its share of a part's words and of its pieces. Running sums are taken in two levels, over
    hash ranges and within a range."""
    lists = store(words.dropDuplicates(["list"]).select("list", "question", "answer", "words")
                  .withColumn("r", F.pmod("list", F.lit(RANGES)))
                  .withColumn("weight", F.size("words").cast("long") * PART_PIECES + F.ceil(F.size("words") / PIECE) * PART_WORDS))
    sums = lists.groupBy("r").agg(F.sum("weight").alias("n"))  # at most RANGES rows
    base = store(sums.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("base")))
    before = F.sum("weight").over(Window.partitionBy("r").orderBy("list")) - F.col("weight")
    part = F.floor((F.col("base") + before) / (PART_WORDS * PART_PIECES))
    return store(lists.join(F.broadcast(base), "r").select("list", "question", "answer", "words", part.alias("part")))


def _grams(h: np.ndarray) -> np.ndarray:
    return th.shingles(h.view(np.uint64), GRAM)


class Index:
    """Pieces of some items with normalised BM25 shares, by blocks."""

    def __init__(self, items: list, df: dict[int, int], n: int, mean: float):
        self.ids = [r["list"] for r in items]
        sides = [(np.array(r["question"], np.int64), np.array(r["answer"], np.int64)) for r in items]
        self.sides = [[_grams(s) for s in pair if len(s)] for pair in sides]
        self.width = [[min(GRAM, len(s)) for s in pair if len(s)] for pair in sides]
        whole = [np.concatenate(pair) if 0 < min(map(len, pair)) <= GRAM else np.zeros(0, np.int64) for pair in sides]
        self.whole = [(_grams(s), min(GRAM, len(s))) for s in whole]  # of items with a short side
        self.both = [[bool(len(s)) for s in pair] for pair in sides]
        pieces = []
        for i, pair in enumerate(sides):
            words = np.concatenate(pair)
            for cut in range(0, len(words), PIECE):
                terms, tf = np.unique(words[cut:cut + PIECE], return_counts=True)
                often = np.array([df[int(t)] for t in terms], float)
                share = (np.log(1 + (n - often + 0.5) / (often + 0.5)) * tf * (K1 + 1)
                         / (tf + K1 * (1 - B + B * len(words[cut:cut + PIECE]) / mean)))
                pieces.append((tuple(terms[np.argsort(-often, kind="stable")][:3]), i, terms, share / share.sum()))
        pieces.sort(key=lambda p: (p[0], p[1]))  # pieces with the same frequent words share blocks
        self.item = np.array([p[1] for p in pieces], np.int64)
        self.vocab = np.unique(np.concatenate([p[2] for p in pieces]).view(np.uint64))
        self.blocks = -(-len(pieces) // BLOCK)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.vocab >> np.uint64(44)] = True
        rows = []  # one for each block and term: the shares of the block's pieces
        for b in range(self.blocks):
            own = pieces[b * BLOCK:(b + 1) * BLOCK]
            terms = np.unique(np.concatenate([p[2] for p in own]).view(np.uint64))
            table = np.zeros((len(terms), BLOCK), np.float32)
            for c, p in enumerate(own):
                table[np.searchsorted(terms, p[2].view(np.uint64)), c] = p[3]
            rows.append((np.searchsorted(self.vocab, terms) + b * len(self.vocab), table))
        self.key, self.share = (np.concatenate(x) for x in zip(*rows))  # sorted by block and term
        block, term = self.key // len(self.vocab), self.key % len(self.vocab)
        order = np.lexsort((block, term))
        self.head_block, self.head_max = block[order], self.share.max(axis=1)[order]
        self.head_at = np.searchsorted(term[order], np.arange(len(self.vocab) + 1))

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or -1."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.filter[h >> np.uint64(44)])
        place = np.searchsorted(self.vocab, h[at])
        hit = self.vocab[np.minimum(place, len(self.vocab) - 1)] == h[at]
        out[at[hit]] = place[hit]
        return out

    def search(self, term: np.ndarray, chunk: np.ndarray, doc_of: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
        """Best score by (document, item) over passages; ``doc_of`` has each chunk's document."""
        best: dict[tuple[int, int], float] = {}
        known = term >= 0
        pairs = np.unique(chunk[known] * len(self.vocab) + term[known])
        chunk, term = pairs // len(self.vocab), pairs % len(self.vocab)
        step = max(2, CELLS // self.blocks)
        for lo in range(0, len(doc_of), step - 1):  # one chunk of overlap
            hi = min(lo + step, len(doc_of))
            a, z = np.searchsorted(chunk, (lo, hi))
            own, t = chunk[a:z] - lo, term[a:z]
            n = self.head_at[t + 1] - self.head_at[t]
            at = np.repeat(self.head_at[t] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            bound = np.bincount(np.repeat(own, n) * self.blocks + self.head_block[at], self.head_max[at],
                                (hi - lo) * self.blocks).reshape(-1, self.blocks)
            same = doc_of[lo:hi - 1] == doc_of[lo + 1:hi]
            bound[:-1] += np.where(same[:, None], bound[1:], 0)  # a passage: this chunk and the next of its text
            c, b = np.nonzero(bound >= threshold)
            for first in range(0, len(c), PASSED):
                self._score(c[first:first + PASSED], b[first:first + PASSED], own, t, np.append(same, False), doc_of[lo:hi], threshold, best)
        return best

    def _score(self, c, b, own, term, same, doc, threshold, best):
        """Score the pieces of blocks ``b`` for the passages that begin with chunks ``c``."""
        begin = np.searchsorted(own, c)
        n = np.searchsorted(own, c + 1 + same[c]) - begin
        which = np.repeat(np.arange(len(c)), n)
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = b[which] * len(self.vocab) + term[at]
        row = np.searchsorted(self.key, key)
        hit = np.flatnonzero(self.key[np.minimum(row, len(self.key) - 1)] == key)
        pair = np.unique(which[hit] * len(self.key) + row[hit])  # a term counts once
        which, row = pair // len(self.key), pair % len(self.key)
        for lane in range(BLOCK):
            score = np.bincount(which, self.share[row, lane], len(c))
            for i in np.flatnonzero(score >= threshold - 1e-6):
                found = int(doc[c[i]]), int(self.item[b[i] * BLOCK + lane])
                best[found] = max(best.get(found, 0.0), float(score[i]))

    def overlaps(self, item: int, grams) -> list[float]:
        """Shares of the question's and the answer's n-grams found; ``grams(k)`` has the document's."""
        found = iter([float(np.isin(s, grams(k)).mean()) for s, k in zip(self.sides[item], self.width[item])])
        return [next(found) if there else None for there in self.both[item]]

    def holds(self, item: int, grams, shares: list[float], overlap: float, least: float | None) -> bool:
        """Both sides reach ``overlap``, or with a short side the whole item reaches ``least``."""
        if all(x is None or x >= overlap for x in shares):
            return True
        whole, k = self.whole[item]
        return least is not None and len(whole) > 0 and float(np.isin(whole, grams(k)).mean()) >= least


def _scan(index, threshold: float, overlap: float, whole: float | None):
    def run(batches):
        ix: Index = index.value
        for batch in batches:
            ids = batch.column(0)
            buf, offs = th.utf8(batch.column(1))
            for i, j in th.slices(offs):
                h, at = th.words(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], th.NO_WORD, th.FOLDED)
                n = np.diff(at)
                chunks = -(-n // PIECE)
                base = np.cumsum(chunks) - chunks
                doc = np.repeat(np.arange(j - i), n)
                chunk = base[doc] + (np.arange(len(h)) - at[doc]) // PIECE
                rows, cache = [], {}
                for (d, item), score in ix.search(ix.terms(h), chunk, np.repeat(np.arange(j - i), chunks), threshold).items():
                    def grams(k, d=d):
                        if (d, k) not in cache:
                            cache[d, k] = np.unique(th.windows(h[at[d]:at[d + 1]], k))
                        return cache[d, k]
                    q, a = ix.overlaps(item, grams)
                    if ix.holds(item, grams, [q, a], overlap, whole):
                        rows.append((ids[i + d].as_py(), ix.ids[item], score, q, a))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.float64()] * 3])],
                    ["doc_id", "list", "score", "question_overlap", "answer_overlap"])
    return run


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               whole: float | None = None) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` of documents that hold test items.

    ``items(item_id, question, answer)``; counts for BM25 are over all pieces of all items."""
    spark = docs.sparkSession
    text_batches(spark)
    words = item_words(items)
    pieces = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PIECE)),
                                                lambda i: F.slice("words", (i * PIECE + 1).cast("int"), PIECE))).alias("w"))
    n, total = pieces.agg(F.count("*"), F.sum(F.size("w"))).first()
    empty = spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    if not n:
        return empty
    lists = _parts(words)
    names = small(store(words.select("list", "item_id")))
    df = store(pieces.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    out = None
    for p in range(lists.agg(F.max("part")).first()[0] + 1):
        own = lists.where(F.col("part") == p)
        terms = own.select(F.explode("words").alias("term")).distinct().join(df, "term")
        rows = sorted(own.select("list", "question", "answer").collect(), key=lambda r: r["list"])
        if rows:
            index = spark.sparkContext.broadcast(Index(rows, {r["term"]: r["df"] for r in terms.collect()}, n, total / n))
            found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
                _scan(index, threshold, overlap, whole), "doc_id long, list long, score double, question_overlap double, answer_overlap double")
            out = found if out is None else out.unionByName(found)
    return out.join(names, "list").select(empty.columns).distinct()


def question_and_answer(items: DataFrame) -> DataFrame:
    """Items given as one text: the last sentence is the answer, what is before it the question."""
    text = F.coalesce("text", F.lit(""))
    cut = r"(?s)^(.*[.!?])\s+([^.!?]+[.!?]*\s*)$"
    split = text.rlike(cut)
    return items.select("item_id", F.when(split, F.regexp_extract(text, cut, 1)).otherwise(text).alias("question"),
                        F.when(split, F.regexp_extract(text, cut, 2)).otherwise("").alias("answer"))


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item; rows without ``doc_id`` stay. Columns are those of ``docs``."""
    gone = store(find_leaks(docs, items, **options).select(F.col("doc_id").alias("gone")).distinct())
    gone = small(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def rows_without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Like ``without_leaks``, but decided row by row, also for null and repeated ids."""
    found = find_leaks(docs.select(row_key().alias("doc_id"), "text"), items, **options)
    gone = small(store(found.select(F.col("doc_id").alias("gone")).distinct()))
    return docs.join(gone, row_key() == gone["gone"], "left_anti")
