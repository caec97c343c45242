"""Token-id files: texts to ids with a given public tokenizer, coded with Simple-8b.

Documents are dealt by ranges of ``doc_id``, sorted, encoded, and written as Parquet files of chunks in the
shared folder; a chunk holds its documents' ids as one Simple-8b payload (see ``simple8b``) with the
documents' ids and lengths and the number of ids that precede it in its part. Parts follow each other in
``doc_id`` order. Spark's writer commits whole tasks, so a lost executor leaves no half file.

The tokenizer's splitter always begins a piece at a space that stands between two other non-space characters,
so texts are cut there and each distinct piece of a cut is encoded once (a memo of bounded size per Python
worker).

Defined results: a null or empty text is the end id alone. Rows without ``doc_id`` come first. Rows of equal
``doc_id`` follow each other in order of their text. Strings that look like special tokens are ordinary text.
Other columns are ignored. An empty table gives no chunks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from . import text_hash as th
from .common import shared_path, text_batches

CHUNK_IDS = 1 << 17  # a chunk ends with the document that reaches so many; about 350 kB coded
CHUNK_BLOCK = 1024
MEMO_PIECES = 500_000
SLICE = 4 << 20
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ["\n", ".", ","]
_LINES = r"^ ?\pL+[.,]?(\n\pL+[.,]?)*$"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def _splits_at_words(stated: dict) -> bool:
    """Whether a tokenizer's own definition lets texts be cut at single spaces and words go to its model alone:
    byte-level BPE without options, and added tokens that hold no white space and are no words."""
    model, pre = stated["model"], stated["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    apart = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip")) and not any(c.isspace() for c in t["content"])
                and any(not c.isalpha() and c not in ".," for c in t["content"]) for t in stated["added_tokens"])
    return bool(plain and level and apart and stated["normalizer"] is None and not stated.get("truncation"))


class Encoder:
    """Ids of texts, remembering the ids of pieces.

    A cut of lines that are each a word of letters with or without ``.`` or ``,`` is put together from the pieces
    word, mark and line end, and its words go through the tokenizer's BPE model alone; every other cut is one
    piece, which goes through the whole tokenizer, added tokens included. A tokenizer of another kind gets whole
    texts."""

    def __init__(self, path: str, limit: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.by_words = _splits_at_words(json.loads(self.tokenizer.to_str()))
        letters = byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")
        self.known: dict[str, int] = {}
        self.lens = self.uses = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self._places(_MARKS, self._words)

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of words by the BPE model; all their bytes are written as letters at once."""
        data = np.frombuffer("\0".join(words).encode(), np.uint8)
        spelt = self.letters[data].tobytes().decode("utf-32-le").split(chr(self.letters[0]))
        code = self.tokenizer.model.tokenize
        return [[t.id for t in code(w)] for w in spelt]

    def _whole(self, cuts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(cuts, add_special_tokens=False)]

    def _forget(self):
        """Keep the marks and what was used twice or more, if that is at most half of the limit."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        kept = np.union1d(np.arange(len(_MARKS)), kept)
        new = np.full(len(self.lens), -1)
        new[kept] = np.arange(len(kept))
        self.flat, _ = _gather(self.flat, self.lens, kept)
        self.known = {c: int(new[i]) for c, i in self.known.items() if new[i] >= 0}
        self.lens, self.uses = self.lens[kept], np.zeros(len(kept), np.int64)

    def _places(self, pieces: list[str], code) -> np.ndarray:
        """Memo places of pieces, learning those that are new with ``code``."""
        known = self.known
        new = [c for c in dict.fromkeys(pieces) if c not in known]
        if new:
            got = code(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, got), np.int64, len(got))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32)])
            self.uses = np.pad(self.uses, (0, len(new)))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _cuts(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct cuts in a row, and the number of ids of each."""
        plain = pc.match_substring_regex(cuts, _LINES).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~plain)
        rows = pc.split_pattern(cuts.filter(pa.array(plain)), "\n")
        first = rows.offsets.to_numpy()[:-1] - rows.offsets[0].as_py()
        lines = rows.flatten()
        words = pc.utf8_rtrim(lines, characters=".,").dictionary_encode()
        parts = np.full((len(lines) + len(other), 3), -1)  # line end before, word, mark behind
        parts[:len(lines), 0] = 0
        parts[first, 0] = -1
        if len(lines):
            parts[:len(lines), 1] = self._places(_strings(words.dictionary), self._words)[words.indices.to_numpy()]
        for mark in (1, 2):
            parts[np.flatnonzero(pc.ends_with(lines, _MARKS[mark]).to_numpy(zero_copy_only=False)), 2] = mark
        if len(other):
            parts[len(lines):, 1] = self._places(_strings(cuts.take(pa.array(other))), self._whole)
        start = np.concatenate([first, len(lines) + np.arange(len(other))])
        held = parts >= 0
        used = parts[held]
        self.uses += np.bincount(used, minlength=len(self.uses))
        ids, size = _gather(self.flat, self.lens, used)
        each = np.zeros(parts.shape, np.int64)
        each[held] = size
        lens = np.add.reduceat(each.sum(axis=1), start)
        order = np.empty(len(cuts), np.int64)  # back to the order of ``cuts``
        order[np.concatenate([np.flatnonzero(plain), other])] = np.arange(len(cuts))
        return _gather(ids, lens, order)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column without nulls in a row, and the number of ids of each text."""
        if not self.by_words:  # another kind of tokenizer: whole texts
            got = self._whole(texts.to_pylist())
            return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        if len(self.known) > self.limit:
            self._forget()
        lists = pc.split_pattern(texts, " ")
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        cuts, which = coded.dictionary, coded.indices.to_numpy()
        beside = ~pc.match_substring_regex(cuts, r"(?s)^[!-~].*[!-~]$").to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(beside)
        beside[odd] = [not c or c[0].isspace() or c[-1].isspace() for c in _strings(cuts.take(pa.array(odd)))]
        beside = np.flatnonzero(np.add.reduceat(beside[which], begin[:-1]))  # texts with other space next to a space
        spaced = [_spaced(t) for t in _strings(texts.take(pa.array(beside)))]
        extra = {c: i for i, c in enumerate(dict.fromkeys(chain.from_iterable(spaced)))}
        head, at = np.unique(which[begin[:-1]], return_inverse=True)
        which = which.astype(np.int32)
        which[begin[:-1]] = len(cuts) + at
        flat, lens = self._cuts(pa.concat_arrays([
            pc.binary_join_element_wise(pa.scalar(" ", cuts.type), cuts, pa.scalar("", cuts.type)),
            cuts.take(pa.array(head)), pa.array(list(extra), cuts.type)]))
        n = np.diff(begin)
        if len(beside):
            split = np.split(which, begin[1:-1])
            for i, parts in zip(beside, spaced):
                split[i] = np.fromiter(map(extra.__getitem__, parts), np.int32, len(parts)) + np.int32(len(cuts) + len(head))
            which, n = np.concatenate(split), np.array([len(x) for x in split])
        ids, size = _gather(flat, lens, which)
        return ids, np.add.reduceat(size, np.cumsum(n) - n)


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _gather(flat: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` (cut into runs of ``lens``) in a row, and the length of each."""
    size, ends = lens[which], np.cumsum(lens)
    total = np.cumsum(size)
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if n + len(flat) < 1 << 31 else np.int64
    place = np.repeat(((ends - lens)[which] - (total - size)).astype(kind), size)
    place += np.arange(n, dtype=kind)
    return flat[place], size


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker; its memo is bounded."""
    return Encoder(path)


def _spaced(text: str) -> list[str]:
    """Cuts at the spaces that stand between two other non-space characters."""
    first, *rest = _SAFE.split(text)
    return [first, *(" " + r for r in rest)]


def _write(path: str, end_id: int):
    def run(batches):
        encoder, before, part, chunk = _encoder(path), 0, None, 0
        docs, lens, ids = [], np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def row(n_docs, n_ids):
            """One chunk: the first documents that wait."""
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([docs[:n_docs]], pa.list_(pa.int64())), pa.array([lens[:n_docs]], pa.list_(pa.int64())),
                 pa.array([simple8b.encode(ids[:n_ids], CHUNK_BLOCK)], pa.binary())],
                ["part", "chunk", "before", "doc_ids", "lens", "payload"])

        for batch in batches:
            keys, texts, part = batch.column(0), batch.column(1), batch.column(2)[0].as_py() if batch.num_rows else part
            _, offs = th.utf8(texts)
            for i, j in th.slices(offs, SLICE):
                got, n = encoder.encode(texts[i:j].fill_null(""))
                ids = np.concatenate([ids, np.insert(got, np.cumsum(n), end_id)])  # the end id behind every text
                lens = np.concatenate([lens, n + 1])
                docs += keys[i:j].to_pylist()
                del got
                while len(ids) >= CHUNK_IDS:
                    stop = np.cumsum(lens)
                    n_docs = int(np.searchsorted(stop, CHUNK_IDS)) + 1
                    n_ids = int(stop[n_docs - 1])
                    yield row(n_docs, n_ids)
                    before, chunk = before + n_ids, chunk + 1
                    docs, lens, ids = docs[n_docs:], lens[n_docs:], ids[n_ids:]
        if docs:
            yield row(len(docs), len(ids))
    return run


def _read(batches):
    _encoder.cache_clear()  # a worker that wrote files needs its encoder and memo no more
    for batch in batches:
        th.give_back()
        for i in range(batch.num_rows):
            ids = simple8b.decode(batch.column(4)[i].as_py()).astype("<u4")
            lens = np.array(batch.column(3)[i].as_py(), np.int64)
            ends = np.cumsum(lens)
            crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, lens)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(2)[i].as_py(), pa.int64()), pa.array(np.full(len(lens), batch.column(0)[i].as_py()), pa.int32()),
                 pa.array(ends - lens + batch.column(1)[i].as_py(), pa.int64()), pa.array(lens), pa.array(crc, pa.int64())],
                ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> str:
    """Write the ids of all ``docs(doc_id, text)`` in ``doc_id`` order; returns the folder."""
    text_batches(docs.sparkSession)
    path = path or shared_path(docs.sparkSession, "token-ids")
    dealt = (docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
             .select("doc_id", "text", F.spark_partition_id().alias("part")))
    (dealt.mapInArrow(_write(tokenizer, end_id),
                      "part int, chunk int, before long, doc_ids array<long>, lens array<long>, payload binary")
     .write.parquet(path))
    return path


def read_ids(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files."""
    files = spark.read.parquet(path)
    parts = files.select("part", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # One row for each part, that is for each task that wrote.
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = (files.select("part", "before", "doc_ids", "lens", "payload")
            .mapInArrow(_read, "doc_id long, part int, at long, n_tokens long, ids_crc32 long"))
    return (rows.join(F.broadcast(parts), "part")
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
