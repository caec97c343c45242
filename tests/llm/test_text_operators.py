"""Operators on texts against brute force, with nulls, empties, long texts, repeats and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import jaccard, removal

from sigloom.llm import common, decontaminate, jaccard_join, simple8b, substring_dedup, token_files
from sigloom.llm import text_hash as th

SCHEMA = "doc_id long, text string, grp long, n int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(vocab, k=rnd.randint(60, 140))) for _ in range(6)]
    passage = " ".join(rnd.choices(vocab, k=70))
    rows = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        if i % 5 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = passage.split()[:rnd.choice([30, 55, 70])]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "One two"), (104, "ONE TWO"), (105, "one two three"),
             (5, rows[5][1]), (None, rows[7][1]), (None, None), (106, "é " * 30000 + "end"), (107, "x" * 300000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == jaccard(rows)


def test_jaccard_keep_first(spark):
    rows = corpus(3)
    docs = frame(spark, rows)
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = {d for d, n, c in jaccard(rows) if d is not None and d == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_empty_tables(spark):
    docs = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, question string, answer string")
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert substring_dedup.removal_report(docs).count() == 0
    assert decontaminate.find_leaks(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b c", None)], items.schema)
    assert decontaminate.find_leaks(docs, one).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_substring_removal(spark, seed):
    rows = corpus(seed)
    got = substring_dedup.removal_report(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == removal(rows, 50)


def test_substring_short_windows(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices("abcd", k=rnd.randint(0, 60)))) for i in range(40)] + [(3, "a b a b"), (None, "a b c d")]
    got = substring_dedup.removal_report(frame(spark, rows), length=6, seed=3).collect()
    assert sorted(map(tuple, got), key=str) == removal(rows, 6)


def test_maximal_spans(spark):
    a = " ".join(f"a{i}" for i in range(120))
    rows = [(1, a), (2, "x " + " ".join(a.split()[10:70]) + " y " + " ".join(a.split()[40:119]))]
    _, spans = substring_dedup.repeats(frame(spark, rows))
    (row,) = [r for r in spans.collect() if r.doc_id == 2]
    assert [(s.s, s.e) for s in row.spans] == [(1, 61), (62, 141)]


def leak_brute(docs, items, threshold, overlap):
    """BM25 over all pieces, without an index."""
    def words(t):
        h, at = th.words(*th.utf8(pa.array([t], pa.string())), th.NO_WORD, th.FOLDED)
        return h
    P = decontaminate.PIECE
    sides = [(i, words(q), words(a)) for i, q, a in items]
    pieces = [(i, np.concatenate([q, a])[c:c + P]) for i, q, a in sides for c in range(0, len(q) + len(a), P)]
    n, mean = len(pieces), sum(len(p) for _, p in pieces) / max(1, len(pieces))
    df = {}
    for _, p in pieces:
        for t in set(p.tolist()):
            df[t] = df.get(t, 0) + 1

    def weights(p):
        out = {}
        for t in set(p.tolist()):
            tf = int((p == t).sum())
            out[t] = np.log(1 + (n - df[t] + .5) / (df[t] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(p) / mean))
        total = sum(out.values())
        return {t: x / total for t, x in out.items()}
    found = set()
    for d, t in docs:
        h = words(t)
        for c in range(0, len(h), P):
            passage = set(h[c:c + 2 * P].tolist())
            for i, p in pieces:
                if sum(x for w, x in weights(p).items() if w in passage) >= threshold:
                    found.add((d, i))
    out = set()
    for d, t in docs:
        h = words(t)
        for i, q, a in sides:
            if (d, i) in found:
                share = [np.isin(th.shingles(s, 5), th.windows(h, min(5, len(s)))).mean() for s in (q, a) if len(s)]
                if share and all(x >= overlap for x in share):
                    out.add((d, i))
    return out


def test_find_leaks(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(rnd.choices(vocab, k=k))
    items = [(i, text(rnd.choice([12, 30, 90])), text(rnd.choice([0, 3, 20]))) for i in range(40)] + [(40, None, None), (41, "", "w1 w2 w3"), (0, None, None)]
    docs = []
    for i in range(60):
        w = text(rnd.choice([5, 100, 400])).split()
        if i % 2:
            _, q, a = rnd.choice(items[:40])
            leak = (q + " " + a).split()
            for _ in range(rnd.choice([0, 1, 3])):
                leak[rnd.randrange(len(leak))] = "zz"
            at = rnd.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in leak]
        docs.append((i, " ".join(w)))
    docs += [(90, None), (91, ""), (92, "w1 w2 w3"), (None, items[3][1] + " " + items[3][2]), (1, docs[1][1])]
    want = leak_brute(docs, items, decontaminate.THRESHOLD, decontaminate.OVERLAP)
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = decontaminate.find_leaks(frame(spark, docs), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 25
    clean = decontaminate.without_leaks(frame(spark, docs), table)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want if d is not None}


def test_leaks_with_an_edited_or_missing_short_answer(spark):
    words = lambda p, k: " ".join(f"{p}{i}" for i in range(k))
    items = [(1, words("q", 30), "x y z"), (2, words("r", 12), words("b", 4)), (3, "u v", words("s", 25)), (4, words("t", 30), words("c", 20))]
    docs = [(1, words("q", 30) + " x other z"), (2, words("q", 30)), (3, words("r", 12) + " b0 b1 no b3"), (4, words("r", 12)),
            (5, "u other " + words("s", 25)), (6, words("t", 30)), (7, "x y z " + words("f", 40)), (8, words("q", 8) + " far x y z"),
            (9, words("q", 30) + " x y z")]
    docs = [(d, f"{words('f', 20)} {t} {words('g', 20)}") for d, t in docs]
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(spark, docs), table, whole=decontaminate.WHOLE).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (9, 1)}
    assert got[2, 1].question_overlap == 1 and got[2, 1].answer_overlap == 0


def test_removal_by_row_with_null_and_repeated_ids(spark):
    import corpus_pipeline
    words = lambda p, k=40: " ".join(f"{p}{i}" for i in range(k))
    a, b = words("a"), words("b")
    rows = [(None, a), (None, a + " z"), (4, a + " y"), (4, b), (None, b), (7, b), (9, words("c")), (9, words("c")),
            (None, words("d")), (None, words("d")), (None, None), (5, ""), (6, words("e")), (6, words("f"))]
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark, rows).columns
    want = [(4, a + " y"), (4, b), (9, words("c")), (None, words("d")), (None, None), (5, ""), (6, words("e")), (6, words("f"))]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(want, key=str)
    items = spark.createDataFrame([(1, words("d"), ""), (2, words("e"), "")], "item_id long, question string, answer string")
    clean = decontaminate.rows_without_leaks(kept, items)
    want = [w for w in want if w not in [(None, words("d")), (6, words("e"))]]
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=str) == sorted(want, key=str)


def test_index_parts_agree(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(20)), "") for i in range(30)],
                                  "item_id long, question string, answer string")
    docs = frame(spark, [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(0, 30, 2)])
    monkeypatch.setattr(decontaminate, "PART_PIECES", 7)
    got = decontaminate.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(0, 30, 2)}


def test_copies_of_an_item_are_indexed_once(spark, monkeypatch):
    words = lambda i: " ".join(f"q{i}x{j}" for j in range(20))
    items = [(i, words(0), "yes it is") for i in range(60)] + [(None, words(0), "yes it is")] + [(100 + i, words(i), "") for i in range(1, 30)]
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    monkeypatch.setattr(decontaminate, "PART_PIECES", 10)
    built, build = [], decontaminate.Index.__init__
    monkeypatch.setattr(decontaminate.Index, "__init__", lambda self, rows, *a: built.append(len(rows)) or build(self, rows, *a))
    docs = frame(spark, [(1, words(0) + " yes it is"), (2, words(5)), (3, words(77))])
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table).collect()]
    assert sorted(got, key=str) == sorted([(1, i) for i in [*range(60), None]] + [(2, 105)], key=str)
    assert sum(built) == 30 and max(built) <= 11


def test_question_and_answer(spark):
    df = spark.createDataFrame([(1, "What is it? A thing."), (2, "no end"), (3, None)], "item_id long, text string")
    got = {r.item_id: (r.question, r.answer) for r in decontaminate.question_and_answer(df).collect()}
    assert got == {1: ("What is it?", "A thing."), 2: ("no end", ""), 3: ("", "")}


@pytest.mark.parametrize("n", [0, 1, 119, 120, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 45, (1 << 64) - 1])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n + 1).integers(0, top, n, dtype=np.uint64, endpoint=True)
    ids[n // 3:n // 2] = 0
    assert (simple8b.decode(simple8b.encode(ids)) == ids).all()


TEXTS = ["", None, "a  b", " a", "a ", "\n \n a b", "x\t y z", "don't 's 'll  ", " ", "é è  q <|endoftext|> z", "a\0 b",
         "word.\nNext, x.. 12a ² a²b", "one two. three,\nfour 'tis", "z" * 5000, "q w " * 20000, "a  b  c"]


def test_token_files(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    rows = [(i * 3 % 17, t) for i, t in enumerate(TEXTS)] + [(4, "same id"), (None, "no id")]
    got = token_files.read_ids(spark, token_files.write_ids(frame(spark, rows), path)).collect()
    start, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = token_files.read_ids(spark, token_files.write_ids(frame(spark, []), path))
    assert empty.count() == 0


def test_token_file_chunks_are_bounded(spark, monkeypatch):
    """A chunk ends with the document that reaches CHUNK_IDS, however many ids a batch has; nothing is lost."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "CHUNK_IDS", 100)
    texts = ["a b c", "", "d " * 60, "e " * 250] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts), pa.array([7] * 20, pa.int32())],
                                       ["doc_id", "text", "part"])
    chunks = list(token_files._write(path, 0)([batch]))
    docs, lens, before = [], [], 0
    for i, c in enumerate(chunks):
        row = c.to_pylist()[0]
        assert (row["part"], row["chunk"], row["before"]) == (7, i, before)
        assert sum(row["lens"][:-1]) < 100 and (sum(row["lens"]) >= 100 or c is chunks[-1])
        assert len(simple8b.decode(row["payload"])) == sum(row["lens"])
        docs, lens, before = docs + row["doc_ids"], lens + row["lens"], before + sum(row["lens"])
    enc = token_files.Encoder(path)
    assert docs == list(range(20)) and lens == (enc.encode(pa.array(texts))[1] + 1).tolist()
    assert token_files._encoder.cache_info().currsize == 1
    back = pa.Table.from_batches(token_files._read(
        pa.RecordBatch.from_pylist([{k: c.to_pylist()[0][k] for k in ("part", "before", "doc_ids", "lens", "payload")}], pa.schema(
            [("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("payload", pa.binary())]))
        for c in chunks))
    assert back["doc_id"].to_pylist() == docs and back["n_tokens"].to_pylist() == lens
    assert token_files._encoder.cache_info().currsize == 0  # readers hold no encoder


def test_encoder_memo_stays_bounded():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    enc = token_files.Encoder(path, limit=50)
    rnd = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rnd.choices("abcdef", k=6)) for _ in range(60))
        ids, n = enc.encode(pa.array([text, "common words here", "x  y"]))
        assert ids[:n[0]].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[n[0] + n[1]:].tolist() == enc.tokenizer.encode("x  y", add_special_tokens=False).ids
    assert len(enc.known) <= 50 + 70


def test_encoder_equals_the_tokenizer():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rnd = random.Random(5)
    signs = [*"abZ  é..,,\n\n\t1'- \u3000ßñ漢\u0301\0\r", "the", "ing", "'s", " word", "<|endoftext|>"]
    for limit in (50, 500_000):
        enc = token_files.Encoder(path, limit)
        for _ in range(60):
            texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(rnd.randint(1, 30))]
            ids, n = enc.encode(pa.array(texts))
            got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    stated = json.loads(open(path).read())
    changes = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**stated["pre_tokenizer"], "add_prefix_space": True}},
               {"added_tokens": stated["added_tokens"] + [{**stated["added_tokens"][0], "id": 50257, "content": "one two"}]}]
    texts = ["One two three", "", " a <|endoftext|>  b", "one two"]
    assert token_files.Encoder(path).by_words
    for i, change in enumerate(changes):
        other = tmp_path / f"{i}.json"
        other.write_text(json.dumps(stated | change))
        enc = token_files.Encoder(str(other))
        ids, n = enc.encode(pa.array(texts))
        assert not enc.by_words
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_joins_beyond_the_broadcast_limits(spark, monkeypatch):
    from sigloom.llm import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(substring_dedup, "BROADCAST_VALUES", -1)
    rows = corpus(4)
    assert sorted(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).collect()), key=str) == jaccard(rows)
    got = substring_dedup.removal_report(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == removal(rows, 50)


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(th, "PIECE", 16)
    texts = ["alpha beta  gamma", "", "x" * 100 + " y", "tail", " lead", "a b c d e f g h i j k l m n"]
    h, at = th.words(*th.utf8(pa.array(texts)))
    one = {w: th.words(*th.utf8(pa.array([w])))[0][0] for t in texts for w in t.split()}
    assert [h[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == [[one[w] for w in t.split()] for t in texts]
    assert len(set(one.values())) == len(one)


def test_store_settles_a_grown_heap(spark, monkeypatch):
    """A stored table is followed by a collection only when the driver's heap takes more than half of its limit."""
    calls = []
    monkeypatch.setattr(common, "settle", lambda s: calls.append(s))
    for grown in (False, True):
        monkeypatch.setattr(common, "heap_grown", lambda s: grown)
        assert common.store(spark.range(3)).count() == 3
    assert len(calls) == 1
    monkeypatch.undo()
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    total = runtime.totalMemory()
    assert not common.heap_grown(spark) or total > runtime.maxMemory() // 4


def test_store_keeps_short_plan_texts(spark):
    """While a table is written, the driver keeps no plan text beyond the limit; the session's setting is as before."""
    key, wide = "spark.sql.maxPlanStringLength", spark.range(3).selectExpr(*[f"id + {i} AS c{i}" for i in range(2000)])
    given, kept = spark.conf.get(key), spark._jsparkSession.sharedState().statusStore()
    before = kept.executionsCount()
    out = common.store(wide)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = kept.executionsList(int(before), 10)
    texts = [found.apply(i).physicalPlanDescription() for i in range(found.size())]
    assert texts and max(map(len, texts)) <= common.PLAN_TEXT
    assert out.count() == 3 and spark.conf.get(key) == given
    with common.short_plan_texts(spark):
        spark.conf.set(key, "500")
        with common.short_plan_texts(spark):
            assert spark.conf.get(key) == "500"
    assert spark.conf.get(key) == given
