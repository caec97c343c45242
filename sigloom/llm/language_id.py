"""Hierarchical language identification: family first, then one-versus-one linear support vector machines.

A text is the bag of its byte n-grams (lower-cased ASCII letters and all bytes of other characters; anything
else is a space), hashed into ``SIZE`` slots for each order and divided by their number. One set of machines
separates the language families; within a family a machine separates each pair of its languages. The winner
has the most votes, then the largest sum of margins. ``score`` is the smaller of the family's and the
language's weakest winning probability (logistic of the margin); 0 for ``und``.

A contest always has a winner, so what no learned language covers is found apart from it: a text's cover is the
mean log-probability of its ``_COVER``-grams, each taken from the learned language where it is most frequent (a
mix of learned languages is covered). A text is ``und`` if its cover lies more than ``limit`` deviations below the
usual cover of the language that won; the deviation shrinks with the text's length, so a text of a few letters is
rarely rejected. Words that hold a digit (keys, addresses, numbers) are in no language and count only in a text that has
no others. Usual cover, deviation and limit are calibrated on the learned texts, each half scored with the
tables of the other half. A language with less than two different texts has no limit.

Training is bounded: at most about ``PER_LANGUAGE`` labelled texts of each language, chosen by a hash of
``doc_id``, and of each of them its whole text, turned into at most ``SIZE`` counts for each order inside the
tasks. Prediction reads every whole text, and nothing but the text.

Defined results: ``und`` with score 0 for a null text, a text without letters, and every text if no labelled
row can be learned from; ``covered`` is false there, and where no learned language covers a text's
n-grams (it still gets the language that is nearest). With one language learned, every text gets it, with score 1. A null
``doc_id`` is not held out. Repeated rows are all returned. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_hash as th
from .common import settle, text_batches

#: Which languages belong together; a language that is not listed is a family of its own.
FAMILIES = {**dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is", "af"), "germanic"),
            **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
            **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "slavic")}
ORDERS, SIZE, PER_LANGUAGE = (2, 3, 4), 1 << 13, 300
_COVER, _LEAST, _SLACK = 3, 8.0, 1.5  # order of the cover's n-grams; least limit; limit over the calibrated 99 % point
_SCALE = 16.0  # brings the length of a typical vector of shares near 1
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)

_CHAR = np.full(256, 0x20, np.uint8)
_CHAR[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_CHAR[65:91] = np.arange(97, 123)


def has_letter(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: those whose crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _grams(buf: np.ndarray, offs: np.ndarray, orders: tuple[int, ...] = ORDERS):
    """Slots of all n-grams of a slice of texts, order by order, and the text each belongs to."""
    chars = _CHAR[buf].astype(np.uint32)
    blank = chars == 0x20
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for order in orders:
        n = len(chars) - order + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.uint32)
        for i in range(order):
            code += chars[i:n + i] * _MIX[i]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        slot = (code >> np.uint32(32 - 13)).astype(np.int64) + ORDERS.index(order) * SIZE
        whole = (text[:n] == text[order - 1:]) & ~(blank[:n] & blank[1:n + 1])
        yield slot[whole], text[:n][whole]


def _counts(batches):
    """Sparse counts of the texts, for training."""
    for batch in batches:
        lang = batch.column(0)
        buf, offs = th.utf8(batch.column(1))
        for i, j in th.slices(offs):
            rows: list[list[np.ndarray]] = [[] for _ in range(j - i)]
            for slot, text in _grams(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]):
                cut = np.searchsorted(text, np.arange(j - i + 1))
                for d in range(j - i):
                    rows[d].append(slot[cut[d]:cut[d + 1]])
            packed = [np.unique(np.concatenate(r) if r else np.zeros(0, np.int64), return_counts=True) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [lang[i:j], pa.array([p[0].astype("<i4").tobytes() for p in packed], pa.binary()),
                 pa.array([p[1].astype("<i4").tobytes() for p in packed], pa.binary())], ["lang", "slots", "counts"])


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 10.0, epochs: int = 15):
    """A linear support vector machine (squared hinge loss) by coordinate descent on the dual."""
    w, b = np.zeros(len(ORDERS) * SIZE), 0.0
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(1)
    square = np.array([x @ x + 1.0 for _, x in rows]) + 0.5 / cost
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x = rows[r]
            slope = sign[r] * (w[at] @ x + b) - 1 + alpha[r] * 0.5 / cost
            new = max(alpha[r] - slope / square[r], 0.0)
            if new != alpha[r]:
                step = (new - alpha[r]) * sign[r]
                w[at] += step * x
                b += step
                alpha[r] = new
    return w, b


def _contest(rows, names: list[str], of: list[str]):
    """Machines for all pairs of ``names``; ``of`` has the class of each row."""
    duels, weights, biases = list(combinations(range(len(names)), 2)), [], []
    of = np.array(of)
    for p, q in duels:
        pick = np.flatnonzero((of == names[p]) | (of == names[q]))
        w, b = _machine([rows[i] for i in pick], np.where(of[pick] == names[p], 1.0, -1.0))
        weights.append(w * _SCALE)
        biases.append(b)
    shape = (len(ORDERS) * SIZE, len(duels))
    return {"names": names, "duels": duels, "w": np.array(weights, np.float32).T.reshape(shape), "b": np.array(biases)}


def _log_shares(texts: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray) -> np.ndarray:
    """Of each slot the largest smoothed log-probability in any language."""
    out = np.full(SIZE, -np.log(SIZE))
    for one in sorted(set(lang)):
        own = [texts[i] for i in np.flatnonzero(lang == one)]
        n = np.bincount(np.concatenate([t[0] for t in own]), np.concatenate([t[1] for t in own]), SIZE)
        share = np.log((n + 0.5) / (n.sum() + 0.5 * SIZE))
        out = np.maximum(out, share) if one != min(lang) else share
    return out


def _cover(rows: list[tuple[np.ndarray, np.ndarray]], lang: list[str]) -> dict:
    """What ``_uncovered`` needs: the table of all texts, and of each language the usual cover, the variances
    between texts and of one n-gram, and the limit."""
    low = ORDERS.index(_COVER) * SIZE
    texts = {}
    for (slot, n), one in zip(rows, lang):  # equal texts once, or they would be in both halves
        at = (slot >= low) & (slot < low + SIZE)
        if at.any():
            texts[one, slot[at].tobytes(), n[at].tobytes()] = slot[at] - low, n[at]
    lang, texts = np.array([k[0] for k in texts], object), list(texts.values())
    half = np.zeros(len(texts), int)
    for one in set(lang):
        half[lang == one] = np.arange((lang == one).sum()) % 2
    whole = _log_shares(texts, lang)
    tables = [_log_shares([t for t, h in zip(texts, half) if h != k], lang[half != k]) for k in (0, 1)]
    cover = np.array([n @ tables[h][slot] / n.sum() for (slot, n), h in zip(texts, half)])
    # Evidence is counted in distinct n-grams, so that a phrase weighs no more for being repeated.
    size = np.array([len(slot) for slot, _ in texts])
    known = {}
    for one in sorted(set(lang)):
        own = np.flatnonzero(lang == one)
        if len(own) < 2:
            continue
        long = own[size[own] >= np.median(size[own])]
        usual = np.median(cover[long])
        between = max(0.05, 1.48 * np.median(abs(cover[long] - usual))) ** 2
        n, value = sum(texts[i][1].sum() for i in own), [(texts[i][1], whole[texts[i][0]]) for i in own]
        mean = sum(c @ v for c, v in value) / n
        within = max(1.0, sum(c @ (v - mean) ** 2 for c, v in value) / n)
        below = (usual - cover[own]) / np.sqrt(between + _COVER * within / size[own])
        known[one] = usual, between, within, max(_LEAST, _SLACK * np.quantile(below, 0.99))
    return {"table": whole, "known": known}


def _worded(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bytes of a slice of texts, blank where a word holds a digit, unless the text has a letter in no other word."""
    gap, first = th.SPACE[buf], np.zeros(len(buf) + 1, bool)
    first[offs[:-1]] = True
    word = np.cumsum(~gap & (first[:-1] | np.concatenate([[True], gap[:-1]])))
    digit = (buf >= 48) & (buf <= 57)
    if not digit.any():
        return buf
    out = np.where(np.bincount(word[digit], minlength=word[-1] + 1)[word] > 0, np.uint8(0x20), buf)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    left = np.bincount(text[_CHAR[out] != 0x20], minlength=len(offs) - 1) > 0
    return np.where(left[text], out, buf)


def _uncovered(cover: dict, langs: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts lie below the limit of the language that they were given."""
    texts, out = len(langs), np.zeros(len(langs), bool)
    total, n, seen = np.zeros(texts), np.zeros(texts), [np.zeros(0, np.int64)]
    for slot, text in _grams(_worded(buf, offs), offs, (_COVER,)):
        slot = slot - ORDERS.index(_COVER) * SIZE
        n += np.bincount(text, minlength=texts)
        total += np.bincount(text, cover["table"][slot], texts)
        seen.append(np.unique(text.astype(np.int64) * SIZE + slot))
    distinct = np.bincount(np.unique(np.concatenate(seen)) // SIZE, minlength=texts)
    for one, (usual, between, within, limit) in cover["known"].items():
        at = np.flatnonzero((langs == one) & (n > 0))
        out[at] = usual - total[at] / n[at] > limit * np.sqrt(between + _COVER * within / distinct[at])
    return out


def train(docs: DataFrame, families: dict[str, str] = FAMILIES, per_language: int = PER_LANGUAGE) -> dict:
    """Learn from ``docs(doc_id, text, lang)``; the model has a fixed size for a given set of languages."""
    text_batches(docs.sparkSession)
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter("text"))
    total = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not total:
        return {"family": None, "within": {}, "cover": None}
    share = F.create_map(*[F.lit(x) for kv in total.items() for x in (kv[0], min(1.0, per_language / kv[1]))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    got = usable.where(draw).select("lang", "text").mapInArrow(_counts, "lang string, slots binary, counts binary").collect()
    th.give_back()
    settle(docs.sparkSession)
    got.sort(key=lambda r: (r["lang"], bytes(r["slots"]), bytes(r["counts"])))
    counts = [(np.frombuffer(bytes(r["slots"]), "<i4").astype(np.int64), np.frombuffer(bytes(r["counts"]), "<i4").astype(float))
              for r in got]
    rows = [(slot, n * (_SCALE / max(1.0, n.sum()))) for slot, n in counts]
    lang = [r["lang"] for r in got]
    family = [families.get(x, x) for x in lang]
    within = {}
    for f in sorted(set(family)):
        own = [i for i, x in enumerate(family) if x == f]
        within[f] = _contest([rows[i] for i in own], sorted({lang[i] for i in own}), [lang[i] for i in own])
    model = {"family": _contest(rows, sorted(set(family)), family), "within": within,
             "cover": _cover(counts, lang)}
    del got, counts, rows
    th.give_back()  # the driver would keep the learned counts' memory to its end
    return model


def _decide(contest: dict, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner (place in ``names``) and its weakest probability, for margins ``(texts, duels)``."""
    texts, n = len(margin), len(contest["names"])
    votes, sums, worst = np.zeros((texts, n)), np.zeros((texts, n)), np.full((texts, n), np.inf)
    for d, (p, q) in enumerate(contest["duels"]):
        m = margin[:, d]
        for who, x in ((p, m), (q, -m)):
            votes[:, who] += x > 0
            sums[:, who] += x
            worst[:, who] = np.minimum(worst[:, who], x)
    best = np.lexsort((-np.arange(n) + 0 * sums, sums, votes), axis=1)[:, -1]
    return best, 1 / (1 + np.exp(-worst[np.arange(texts), best]))


def _margins(contest: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    texts, duels = len(offs) - 1, len(contest["duels"])
    out, n = np.zeros((texts, duels)), np.zeros(texts)
    if duels:
        for slot, text in _grams(buf, offs):
            n += np.bincount(text, minlength=texts)
            for d in range(duels):
                out[:, d] += np.bincount(text, contest["w"][:, d][slot], texts)
    return out / np.maximum(n, 1)[:, None] + contest["b"]


def _judge(m: dict, column: pa.Array) -> pa.StructArray:
    """Language, score and whether that language covers it, of every text of a batch, whatever letters it has."""
    buf, offs = th.utf8(column)
    langs, scores, covered = np.full(len(column), "und", object), np.zeros(len(column)), np.full(len(column), m["family"] is not None)
    for i, j in th.slices(offs, 1 << 19) if m["family"] else ():
        b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        kin, sure = _decide(m["family"], _margins(m["family"], b, o))
        for f, name in enumerate(m["family"]["names"]):
            at, own = np.flatnonzero(kin == f), m["within"][name]
            if not len(at):
                continue
            best, p = np.zeros(len(at), int), np.ones(len(at))
            if own["duels"]:
                part = np.concatenate([b[o[d]:o[d + 1]] for d in at])
                best, p = _decide(own, _margins(own, part, np.concatenate([[0], np.cumsum(np.diff(o)[at])])))
            langs[i + at], scores[i + at] = np.array(own["names"], object)[best], np.minimum(sure[at], p)
        covered[i:j] = ~_uncovered(m["cover"], langs[i:j], b, o)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(covered)], ["lang", "score", "covered"])


def judged(model: dict, docs: DataFrame) -> Column:
    """``struct<lang, score, covered>`` of the column ``text``; only the text goes to Python."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, covered boolean")
    def judge(text: pa.Array) -> pa.Array:
        return _judge(shared.value, text)

    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("covered"))
    return F.when(has_letter("text"), judge("text")).otherwise(und)


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``docs[keep]`` with ``lang_pred``, ``score`` and ``covered``; kept columns of these names give way."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "covered")]
    out = docs.select(*keep, judged(model, docs).alias("__j"))
    return out.select(*keep, F.col("__j.lang").alias("lang_pred"), F.col("__j.score").alias("score"), F.col("__j.covered").alias("covered"))


def accepted(docs: DataFrame, model: dict | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that are not rejected: a language was found and covers the text, with a score of ``least`` or more.

    A winner of three or more that lost a contest scores below 0.5; its text is still in that language, so by default
    no score rejects."""
    out = docs.withColumn("__j", judged(train(docs) if model is None else model, docs))
    return out.where(F.col("__j.covered") & (F.col("__j.score") >= least)).select(*docs.columns)
