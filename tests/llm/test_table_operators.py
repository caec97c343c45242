"""Chat format, URL filter, sharding, vectors, language ID, mixing and the pipeline on small tables."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import classes
from pyspark.sql import functions as F

import corpus_pipeline
from sigloom.llm import chat_format, embedding_dedup, language_id, mixing, sharding, url_filter

SMALL = "/root/testdata/sf0.001"

# ------------------------------------------------------------------ chat format
NASTY = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "<|", "<\\|", "<\\\\\\|x", "a<", "|im_end|>", "<<||>>",
         "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "end <", "<\\", "$1 \\1", "<|nl|>", "x" * 200000, "é\n\n<|é"]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([(r, t) for r in ("user", "assistant", "a\nb", "<|nl|>", None, "<|im_start|>x") for t in NASTY])]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "user", "z"), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert all(r.round_trip for r in got.values()) and set(got) == {1, 2, None}
    for conv in (1, 2):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv),
                       key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for *_, r, x in turns]
        assert got[conv].loss_text == "".join(x for *_, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)


def test_chat_plain_turns_stay_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <b> | c"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    (r,) = chat_format.format_chats(df).collect()
    assert r.formatted == "<|im_start|>user\na <b> | c<|im_end|>\n<|im_start|>assistant\nfine<|im_end|>\n"
    assert [(s.s, s.e) for s in r.loss_spans] == [(59, 63)] and r.formatted[59:63] == "fine"
    assert chat_format.format_chats(df.where("false")).count() == 0


# ------------------------------------------------------------------ URL filter
def url_brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, ends: s[:min([s.index(e) for e in ends if e in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host):], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and host and path.startswith(r[1])]
    best = max(fit, key=lambda r: (r[0].count("."), len(r[0]), len(r[1]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_rule_hosts_fold_like_url_hosts(spark):
    rules = spark.createDataFrame([("Äb.COM", "/", "block")], url_filter.RULES_SCHEMA)
    pages = spark.createDataFrame([(1, "http://ÄB.com/x"), (2, "http://äb.com/x")], "page_id long, url string")
    for limit in (url_filter.TRIE_RULES, 0):
        got = url_filter.judge(pages, rules, ["page_id"], trie_rules=limit).collect()
        assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow"}


def test_url_filter(spark):
    rnd = random.Random(2)
    labels, parts = ["com", "net", "example", "www", "a", "b"], ["en", "fr", "e", "x", ""]
    rules = {(".".join(rnd.choices(labels, k=rnd.randint(1, 3))), "/" * rnd.randint(0, 1) + "/".join(rnd.choices(parts, k=rnd.randint(0, 3))),
              rnd.choice(["allow", "block"])) for _ in range(60)}
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q=/fr/#x", "http://com", "http://com?x", "http://a..com/",
            "://com/", "http://É.com/en/", "http://x://com/e"]
    urls += [f"https://{'.'.join(rnd.choices(labels, k=rnd.randint(1, 4)))}/{'/'.join(rnd.choices(parts, k=rnd.randint(0, 4)))}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([*rules, (None, "/", "allow")], url_filter.RULES_SCHEMA)
    want = [(i, *url_brute(u, rules)) for i, u in enumerate(urls + urls[:5])]
    assert sorted(map(tuple, url_filter.judge(pages, table, ["page_id", "host", "rule"]).collect())) == want
    assert sorted(map(tuple, url_filter.judge(pages, table, ["page_id"], trie_rules=0).collect())) == want
    none = url_filter.judge(pages, table.where("false"), ["page_id"], default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}
    assert url_filter.judge(pages.where("false"), table, ["page_id"]).count() == 0


# ------------------------------------------------------------------ sharding
def ring_brute(keys, shards, virtual, slack):
    """Row by row: own arcs first, in ring order, then the overflow clockwise."""
    points = sharding.ring(shards, virtual)
    total = len(keys)
    room = [total // shards + (s < total % shards) + int(slack * total / shards) for s in range(shards)]
    arcs = collections.defaultdict(list)
    for k, spot in keys:
        at = next((i for i, (p, _) in enumerate(points) if p >= spot), 0)
        arcs[at].append((spot, k))
    out, over = {}, []
    for at in range(len(points)):
        for spot, k in sorted(arcs[at]):
            s = points[at][1]
            if room[s]:
                room[s] -= 1
                out[k] = s
            else:
                over.append((at, k))
    for at, k in over:
        while True:
            at = (at + 1) % len(points)
            s = points[at][1]
            if room[s]:
                room[s] -= 1
                out[k] = s
                break
    return out


@pytest.mark.parametrize("shards,slack", [(5, 0.0), (7, 0.2)])
def test_sharding_matches_ring(spark, shards, slack):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 0, F.repeat(F.lit("é"), F.col("id").cast("int") % 50)).alias("text"),
                                   F.lit(9).alias("shard"), F.lit(1).alias("size"))
    got = sharding.place(docs, shards, 8, slack, keep=["doc_id", "shard", "size"]).collect()
    spots = [(r.doc_id, r.s) for r in docs.select("doc_id", F.xxhash64(F.lit(0), "doc_id").alias("s")).collect()]
    assert {r.doc_id: r.shard for r in got} == ring_brute(spots, shards, 8, slack)
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = collections.Counter(r.shard for r in got)
    if slack == 0:
        assert max(sizes.values()) - min(sizes.values()) <= 1
    for r in got:
        text = "" if r.doc_id % 7 == 0 else "é" * (r.doc_id % 50)
        assert (r.size, r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))


def test_sharding_moves_few_and_takes_odd_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r.doc_id: r.shard for r in sharding.place(docs, 10, slack=0.3).collect()}
    b = {r.doc_id: r.shard for r in sharding.place(docs, 11, slack=0.3).collect()}
    assert sum(a[k] != b[k] for k in a) < 4000 * 0.3
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (None, None), (1, "x"), (1, "x")] * 3, "doc_id long, text string")
    rows = sharding.place(odd, 4).collect()
    assert sorted(collections.Counter(r.shard for r in rows).values()) == [3, 4, 4, 4]
    assert sharding.place(odd.where("false"), 4).count() == 0


# ------------------------------------------------------------------ vectors
def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, (base + rng.standard_normal(16) * 0.04).astype(np.float32).tolist(), label))
                i += 1
    rows += [(500, rows[0][1], 0), (501, [x * 2 for x in rows[0][1]], 0), (502, None, 0), (503, [], 0), (504, [0.0] * 16, 0),
             (505, [float("nan")] + [1.0] * 15, 0), (506, [float("inf")] + [1.0] * 15, 0), (507, [None] + [1.0] * 15, 0),
             (508, [1.0, 2.0], 1), (509, [1.0, 2.0], 1), (500, rows[0][1], 0), (None, rows[1][1], 0), (510, [1e-30] * 16, 0), (511, [1e30] * 16, 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")

    def vector(r):
        v = r[1]
        ok = v and r[2] is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
        return np.array(v, np.float32).astype(float) if ok else None
    vec = [vector(r) for r in rows]

    def linked(a, b):
        x, y = vec[a], vec[b]
        if x is None or y is None or rows[a][2] != rows[b][2] or len(x) != len(y):
            return False
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    links = [sum(linked(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    comp = classes([r[0] for r in rows], linked)
    want = sorted(((r[0], n, c if v is not None else r[0], r[0] is not None and r[0] == c) for r, n, c, v in zip(rows, links, comp, vec)), key=str)
    for block in (1024, 3):  # with small blocks every bucket is cut
        got = embedding_dedup.near_duplicates(df, recall=0.9999, block=block)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_recall_of_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9802 * x + math.sqrt(1 - 0.9802 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(2 * i, x[i].tolist(), 0) for i in range(400)] + [(2 * i + 1, y[i].tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df).where("n_links > 0").count()
    assert got >= 0.95 * 800
    k, tables = embedding_dedup.plan_tables(10**9)
    assert k > embedding_dedup.plan_tables(10**4)[0] and tables < 200


# ------------------------------------------------------------------ language ID
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    got = language_id.predict(docs.withColumn("h", language_id.held_out(F.col("doc_id"))), model, ["doc_id", "lang", "h"]).collect()
    held = [r for r in got if r.h]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and len(held) > 150
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    rows = [(i, "der die das und nicht " * 9 if i % 2 else "the of and to in that " * 9, "de" if i % 2 else "en", "s", 0.5) for i in range(40)]
    odd = [(100, None, "en", "s", 1.0), (101, "", "en", None, 1.0), (102, "123 !?", None, "s", 1.0), (None, "the of", None, "s", 1.0),
           (103, "das und " * 60000, None, "s", 1.0), (1, rows[1][1], "de", "s", 0.5)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score double")
    model = language_id.train(docs)
    got = language_id.predict(docs, model, ["doc_id", "text"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows + odd) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred == "de" and by[None].lang_pred == "en" and by[1].lang_pred == "de"
    assert language_id.accepted(docs).columns == docs.columns and language_id.accepted(docs).count() == len(rows) + 3
    empty = docs.where("false")
    assert language_id.predict(empty, language_id.train(empty), ["doc_id"]).count() == 0
    unlearned = language_id.predict(docs, language_id.train(empty), ["doc_id"]).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}
    single = language_id.predict(docs, language_id.train(docs.where("lang = 'de'")), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("de", 1.0), ("und", 0.0)}


@pytest.mark.parametrize("strange", ["en", "de", "fr", "es"])
def test_language_that_was_not_learned(spark, strange):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = docs.where(F.col("lang") != strange)
    model = language_id.train(learned)
    kept = language_id.accepted(docs, model)
    share = lambda rows: kept.where(rows).count() / docs.where(rows).count()
    assert share((F.col("lang") == strange) & (F.length("text") > 300)) <= 0.03
    assert share(F.col("lang") != strange) >= 0.99
    assert share((F.col("lang") != strange) & language_id.held_out(F.col("doc_id"))) >= 0.99
    assert language_id.predict(docs.join(kept, "doc_id", "left_anti"), model, ["doc_id"]).where("covered or lang_pred = 'und'").isEmpty()


def test_every_text_with_a_letter_gets_a_language(spark):
    """Repeated phrases are in their language and stay; junk gets the nearest language, uncovered."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    some = [" ".join(r.text.split()[:4]) for r in docs.where("lang = 'de'").orderBy("doc_id").limit(20).collect()]
    extra = [(10**6 + i, (t + " ") * 200, None) for i, t in enumerate(some)] + [(2 * 10**6, "zzzz qqqq xxxx", None), (2 * 10**6 + 1, "1 2 3", None)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs), ["doc_id", "text"]).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {d for d, r in got.items() if not any(c.isalpha() for c in r.text or "")}
    assert 2 * 10**6 + 1 in got and not got[2 * 10**6 + 1].covered
    assert all(got[10**6 + i].covered for i in range(20))


def test_letter_junk_is_no_language(spark):
    rnd = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(10**6 + i, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz    ", k=300)), None) for i in range(20)]
    junk += [(10**7, "Русский язык является одним из восточнославянских языков и национальным языком русского народа", None)]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    left = [r.doc_id for r in language_id.accepted(both).select("doc_id").collect()]
    assert max(left) < 10**6 and len(left) >= 0.998 * docs.count()


def test_texts_with_machine_made_words_stay(spark):
    # keys, addresses and numbers in a short text of a learned language took it out of the pipeline
    rnd = random.Random(2)
    parts = {"en": "the of and to in that it was for with he be on by his at not but have".split(),
             "de": "der die das und nicht ein zu den mit sich auf für ist dem im von eine als".split()}
    rows = [(i, " ".join(rnd.choices(parts[x], k=60)), x) for i in range(120) for x in ["en" if i % 2 else "de"]]
    keys = ["".join(rnd.choices("0123456789bcdfghjkqvwxz", k=40)) + "7" for _ in range(40)]
    mixed = [(1000 + i, f"the of and {k} to in {k[::-1]} that it was", None) for i, k in enumerate(keys)]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + mixed, schema)
    model = language_id.train(docs)
    assert sorted(r.doc_id for r in language_id.accepted(docs, model).collect()) == sorted(r[0] for r in rows + mixed)
    letters = [(2000 + i, "".join(c for c in k + k[::-1] + k[3:] if c.isalpha()), None) for i, k in enumerate(keys)]
    alone = [(3000 + i, f"{k}{k[::-1]}{k}", None) for i, k in enumerate(keys)]  # nothing else to go by
    assert language_id.accepted(spark.createDataFrame(letters + alone, schema), model).isEmpty()


def test_words_with_digits_are_blank_within_each_text():
    texts = ["a1 bc", "é2", "x", "", "ab\tc9d e", "7", "k3y", " 5 z"]
    buf, offs = language_id.th.utf8(pa.array(texts))
    out = language_id._worded(buf, offs).tobytes()
    cut = [out[i:j].decode() for i, j in zip(offs, offs[1:])]
    assert cut == ["   bc", "é2", "x", "", "ab\t    e", "7", "k3y", "   z"]


def test_a_winner_that_lost_a_contest_stays(spark):
    # F2: with three families a cyclic vote scores below 0.5, and the document was left out
    names, none = ["a", "b", "c"], {"duels": [], "w": np.zeros((3 * language_id.SIZE, 0), np.float32), "b": np.zeros(0)}
    model = {"family": {"names": names, "duels": [(0, 1), (0, 2), (1, 2)], "w": np.zeros((3 * language_id.SIZE, 3), np.float32),
                        "b": np.array([0.3, -0.2, 0.4])},
             "within": {x: none | {"names": [x]} for x in names}, "cover": {"table": np.zeros(language_id.SIZE), "known": {}}}
    docs = spark.createDataFrame([(1, "some text"), (2, "1 2"), (3, None)], "doc_id long, text string")
    row = language_id.predict(docs, model, ["doc_id"]).where("doc_id = 1").first()
    assert row.lang_pred == "b" and 0 < row.score < 0.5 and row.covered
    assert [r.doc_id for r in language_id.accepted(docs, model).collect()] == [1]


# ------------------------------------------------------------------ mixing
def test_exponent_meets_its_targets(spark):
    src = spark.createDataFrame([(10,), (200,), (3000,), (70,)], "tokens long")
    t = np.array([10, 200, 3000, 70]) / 3280

    def entropy(x):
        p = t ** x / (t ** x).sum()
        return -(p * np.log(p)).sum()
    x = mixing.exponent(src, 0.8, None)
    assert entropy(x) >= 0.8 * math.log(4) > entropy(x + 1e-4)
    y = mixing.exponent(src, None, 5.0)
    assert 300 ** (1 - y) <= 5 < 300 ** (1 - y + 1e-4)
    assert mixing.exponent(src, 0.8, 1.0) == 1.0 and mixing.exponent(src.limit(1), 0.5, 2.0) == 1.0


def test_mix_uses_every_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["a", "a", "a", "a", "b", "c", None]), 3) for i in range(400)]
    rows += [(400, None, "b", 3), (401, "", "", 3), (None, "x y", "c", 3), (5, "again", "a", 3), (5, "again", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    got = mixing.mix(docs, target_entropy=0.97, max_repeats=3.0, block_tokens=500, keep=["doc_id", "source", "tokens"]).collect()
    uses = collections.Counter((r.doc_id, r.source) for r in got)
    assert set(uses) == {(d, s) for d, _, s, _ in rows}
    assert max(n for (d, _), n in uses.items() if d != 5) <= 4
    weight = {r.source: r.weight for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-6
    total = sum(r.tokens for r in got)
    for s, w in weight.items():
        assert abs(sum(r.tokens for r in got if r.source == s) - w * total) <= 64
    last = max(r.block for r in got)
    for b in range(last):
        own = [r for r in got if r.block == b]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.tokens for r in own) - 500) <= 31 * len(weight)
    half = mixing.mix(docs, target_entropy=0.97, max_repeats=3.0, budget=1000).collect()
    assert abs(sum(r.tokens for r in half) - 1000) <= 31 * len(weight)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs, keep=docs.columns, layout=False).columns == docs.columns


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.store(stage(spark, seen[-1], SMALL)))
        if name != "sharding":
            assert seen[-1].columns == names
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    rows = {r.doc_id: r.text for r in docs.collect()}
    from brute import jaccard
    assert ids[1] == sorted(i for i in ids[0] if any(c.isalpha() for c in rows[i]))
    assert ids[2] == sorted(d for d, n, c in jaccard([(i, rows[i]) for i in ids[1]]) if n == 0 or d == c)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert ids[3] == [i for i in ids[2] if not any(t in rows[i] for t in items)]
    assert set(ids[4]) == set(ids[3]) and len(ids[4]) <= 1.3 * len(ids[3]) + 25
    assert ids[5] == ids[4]
    sizes = collections.Counter(r.shard for r in seen[5].collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    out = corpus_pipeline.run(spark, SMALL)
    digest = lambda df: hashlib.sha256(json.dumps(sorted(map(str, df.select("doc_id", "shard", "slot").collect()))).encode()).hexdigest()
    assert digest(out) == digest(seen[5])


def test_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
