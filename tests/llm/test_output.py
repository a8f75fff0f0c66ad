import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, rows_of_duck, rows_of_spark
from pyspark.sql import functions as F

from shardloom.llm.chat import OP4_SQL, Template, digests, formatted, op4_chat_formatting
from shardloom.llm.mixing import exponent, mixed, mixture, op7_mixing, word_count, write_mixed
from shardloom.llm.sharding import op6_sharding, shuffle_into_shards
from shardloom.llm.token_files import Encoder, default_tokenizer, op3_token_files, read_tokens, write_tokens


# --- token files

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def expected(rows, library):
    out, at = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t\xa0\x1c\x00ab'sé1!.,語", "<|endoftext|>"]), max_size=30).map("".join))
def test_pieces_give_the_library_ids(text):
    global _pair
    try:
        code, lib = _pair
    except NameError:
        from tokenizers import Tokenizer

        code, lib = _pair = Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    assert code.cuts
    assert code([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_texts_together_and_in_parts(library, monkeypatch):
    from shardloom.llm import token_files

    import pyarrow as pa

    texts = ["a  b", None, "plain words, here.\nNext line", "", " lead", "x \n y  <|endoftext|>", "trail ", "plain words", "\x00 mark \x00."] * 5
    ids, n = Encoder(default_tokenizer(), hold=5).encoded(pa.array(texts))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    monkeypatch.setattr(token_files, "LONG", 7)
    long = "some words  with\tspace \n and more of them" * 3
    parts = token_files._cut_long(long)
    assert len(parts) > 5 and "".join(parts) == long
    assert [i for p in parts for i in Encoder(default_tokenizer())([p])[0]] == library.encode(long, add_special_tokens=False).ids
    monkeypatch.setattr(token_files, "SLICE", 200)
    runs = list(token_files._slices(pa.array(["x" * 500, None, "y", "z"])))
    assert runs[0] == (0, 1) and [i for i, _ in runs[1:]] == [j for _, j in runs[:-1]] and runs[-1][1] == 4


def test_workers_give_the_encoder_back(library):
    """A worker that goes on to another operator does not hold the token encoder beside that one's memory."""
    import gc
    import weakref

    import pyarrow as pa

    from shardloom.llm import minhash_dedup, quality, token_files

    class Docs:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

    texts = pa.RecordBatch.from_pydict({"rid": [1, 2], "text": ["some text", "more text"], "known": [True, False]})
    facts = token_files.Facts.of(default_tokenizer())
    for run in (quality.batch_grams(Docs(), 5).run, minhash_dedup.signatures(Docs(), 5, 64, 7).run):
        held = token_files._encoder(default_tokenizer(), facts)
        assert held is token_files._encoder(default_tokenizer(), facts)  # later tasks of the same operator have it
        held = weakref.ref(held)
        assert list(run(iter([texts])))
        gc.collect()
        assert held() is None


def test_tables_of_parts_take_no_other_workers(spark, tmp_path):
    """A list of Python rows would go through a PythonRDD, whose workers and daemon stay beside those of the operator."""
    uri = f"file://{tmp_path}/t"
    write_tokens(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), uri, tokenizer=default_tokenizer(), parts=2)
    got = read_tokens(spark, uri)
    assert [r["doc_id"] for r in got.orderBy("doc_id").collect()] == [1, 2]
    assert "PythonRDD" not in got._jdf.queryExecution().toRdd().toDebugString()


def test_new_pieces_are_learned_in_turns(monkeypatch, library):
    """The library's encodings of new pieces are held for a bounded number of them; the ids are the same."""
    import pyarrow as pa

    from shardloom.llm import token_files

    text = " ".join(f"word{i}" for i in range(3_000))
    code, many = Encoder(default_tokenizer()), []
    lib = code.lib
    code.lib = type("Lib", (), {"encode_batch_fast": staticmethod(lambda x, **k: many.append(sum(t.count(" ") for t in x)) or lib.encode_batch_fast(x, **k))})
    monkeypatch.setattr(token_files, "AT_ONCE", 500, raising=False)
    ids, _ = code.encoded(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(many) <= 500


def test_op3_on_the_table(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = [tuple(r)[:4] for r in op3_token_files(spark, sf_dir).orderBy("doc_id").collect()]
    assert got == expected(rows, library)


def test_token_files_edges(spark, tmp_path, library):
    rows = [(7, "b"), (-3, None), (None, "null id"), (7, "b"), (5, ""), (9, "long " * 50_000), (8, "<|endoftext|> x")]
    df = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, part string")
    uri = f"file://{tmp_path}/t"
    index = write_tokens(df, uri, tokenizer=default_tokenizer(), parts=3)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_tokens(spark, uri).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(d, s, n, c) for s, d, n, c in got] == expected(order, library)
    assert index["dtype"] == "<u2" and sum(p["ids"] for p in index["parts"]) == sum(g[2] for g in got)
    flat = np.concatenate([np.memmap(f"{tmp_path}/t/tokens-{p['part']:05d}.bin", "<u2", "r") for p in index["parts"] if p["ids"]])
    assert len(flat) == got[-1][0] + got[-1][2]
    again = df.unionAll(df).unionAll(df.where("doc_id = 9")).sortWithinPartitions("doc_id", "text")
    write_tokens(again, f"file://{tmp_path}/r", tokenizer=default_tokenizer(), parts=3, runs=True)
    runs = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_tokens(spark, f"file://{tmp_path}/r").collect())
    more = sorted([*rows, *rows, rows[5]], key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(d, s, n, c) for s, d, n, c in runs] == expected(more, library)
    same = spark.createDataFrame([(3, "the same row")] * 4000, "doc_id long, text string").repartition(4)
    parts = write_tokens(same, f"file://{tmp_path}/s", tokenizer=default_tokenizer(), parts=4)["parts"]
    assert sum(p["docs"] for p in parts) == 4000 and max(p["docs"] for p in parts) < 2000  # one key in several parts
    write_tokens(df.limit(0), f"file://{tmp_path}/e", tokenizer=default_tokenizer())
    assert read_tokens(spark, f"file://{tmp_path}/e").count() == 0


# --- chat

def test_op4_on_the_table(spark, sf_dir):
    assert rows_of_spark(op4_chat_formatting(spark, sf_dir)) == rows_of_duck(connect(sf_dir), OP4_SQL)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"\\.[]<>/|=ab \n", *Template().controls]), max_size=12).map("".join), st.one_of(st.sampled_from(["user", "assistant", "system", ""]), st.text(alphabet="[=]/\\ax", max_size=5)))
def test_turns_read_back(text, role):
    t = Template()
    whole = "".join(s for s, _ in t.segments(role, text))
    assert t.parse(whole) == (role, text)
    assert not any(c in t.escape(text) for c in t.controls) and t.unescape(t.escape(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool[", "[=]"]), st.lists(st.sampled_from(["\\", ".", "[", "]", "<", "/", " ", "\n", "s>", "INST]", *Template().controls]), max_size=6).map("".join)), max_size=6))
def test_turns_are_found_by_their_marks(turns):
    t = Template()
    whole, at, got = "".join(s for r, x in turns for s, _ in t.segments(r, x)), 0, []
    while at < len(whole):
        role, text, at = t.next(whole, at)
        got.append((role, text))
    assert got == turns


def test_digests_do_not_need_the_rows_to_be_turns(spark):
    from pyspark.sql import Window

    rows = [(i % 3, i, ["user", "assistant", "judge"][i % 3 if i % 2 else 0], f"text {i} </s>[INST]") for i in range(30)]
    turns = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(digests(turns).select("conv_id", "n_turns", "turns_sha256", "formatted_chars").collect())
    w = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = turns.withColumn("all", F.flatten(F.collect_list("segments").over(w))).where("n = 0")  # a conversation in one row
    one = one.select("conv_id", "n", "role", "valid", "last", F.col("all").alias("segments"))
    assert sorted(digests(one).select("conv_id", "n_turns", "turns_sha256", "formatted_chars").collect()) == want and want[0]["n_turns"] == 10


def test_machine_and_edges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (3, 0, "assistant", None), (3, 1, "user", "x"), (4, 1, "assistant", "b"), (4, 0, "user", "</s>"), (None, 0, None, None), (5, 0, "user", "u"), (5, 0, "user", "u")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int")
    got = {r["conv_id"]: r for r in digests(formatted(df)).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, None: False, 5: False}
    assert got[4]["turns_sha256"] == hashlib.sha256(b"user\n</s>\nassistant\nb\n").hexdigest()
    assert got[4]["loss_sha256"] == hashlib.sha256(b"b").hexdigest() and got[4]["loss_chars"] == 1
    assert got[5]["n_turns"] == 2 and got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    losses = [s["text"] for r in formatted(df).collect() for s in r["segments"] if s["loss"]]
    assert sorted(losses) == ["", "a", "b"]
    assert digests(formatted(df.limit(0))).count() == 0


# --- sharding

def test_op6_on_the_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op6_sharding(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = [len(slots.get(s, [])) for s in range(40)]
    assert max(n) - min(n) <= 1 and len(got) == len(docs)


def test_shuffle_edges_and_order(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, None if i % 7 == 0 else "t" * (i % 90), "s") for i in range(1000)], "doc_id long, text string, shard string")
    got = shuffle_into_shards(df, f"{tmp_path}/a", 7, bucket_bytes=2_000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    n = Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n.values()) <= 1 and {(r["shard"], r["slot"]) for r in got} == {(s, k) for s in range(7) for k in range(n[s])}
    # no drift of the key along the shuffled order (a permutation test's bound)
    wide = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    rows = sorted(((r["shard"], r["slot"], r["doc_id"]) for r in shuffle_into_shards(wide, f"{tmp_path}/b", 4, bucket_bytes=5_000).collect()))
    assert abs(np.corrcoef(np.arange(4000), [r[2] for r in rows])[0, 1]) < 0.06
    assert shuffle_into_shards(df.limit(0), f"{tmp_path}/c", 3).count() == 0
    assert [tuple(r)[-2:] for r in shuffle_into_shards(df.limit(1), f"{tmp_path}/d", 3).collect()] == [(0, 0)]


def test_shuffle_deals_equal_rows_over_buckets(spark, tmp_path, monkeypatch):
    from shardloom.llm import sharding

    monkeypatch.setattr(sharding, "CHUNK", 16)
    rows = [(i, f"t{i}", i, "p", "h") for i in range(200)] + [(7, "again", 1, "p", "h")] * 300 + [(8, None, 1, None, "h")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, place long, bucket string, h string").withColumn("a.b", F.lit(1)).repartition(5)
    got = shuffle_into_shards(df, f"{tmp_path}/a", 6, bucket_bytes=400).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    n = Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n.values()) <= 1 and {(r["shard"], r["slot"]) for r in got} == {(s, k) for s in range(6) for k in range(n[s])}
    again = Counter(r["shard"] for r in got if r["text"] == "again")
    assert len(again) == 6 and max(again.values()) < 90  # a bucket of equal rows would fill shards


# --- mixing

def sources(spark):
    rows = [(i, "w " * (5 + i % 9), s) for s, n in (("a", 600), ("b", 150), ("c", 40)) for i in range(n)]
    rows += [(1000 + i, t, s) for i, (t, s) in enumerate([(None, "d"), ("", "d"), ("x y", None), ("x y", None)])]
    return spark.createDataFrame([(i, t, s, 9) for i, t, s in rows], "doc_id long, text string, source string, epoch int"), rows


def test_repetition_limit(spark):
    df, rows = sources(spark)
    out = mixed(df, max_repeat=4.0, block=64)
    got = out.collect()
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["n_tokens"]
    repeat = {s: taken[s] / words[s] for s in words if words[s]}
    assert max(repeat.values()) <= 4.0 + 1e-6 and min(repeat.values()) >= 1 - 1e-9 and repeat["a"] == pytest.approx(1)
    assert repeat[None] > repeat["c"] > repeat["b"] > repeat["a"]
    a = math.log(repeat["c"]) / math.log(words["a"] / words["c"])
    assert repeat["b"] == pytest.approx((words["a"] / words["b"]) ** a, rel=0.05)  # one exponent for all
    # every document occurs, epochs are whole but for the last
    times = Counter((r["doc_id"], r["source"], r["epoch"]) for r in got)
    assert {(i, s) for i, _, s in rows} == {(i, s) for i, s, _ in times}
    for s in ("b", "c"):
        last = max(e for _, t, e in times if t == s)
        for e in range(last):
            assert sum(n for (_, t, x), n in times.items() if t == s and x == e) == sum(t == s for _, _, t in rows)
    # any prefix of the order has the sources in proportion
    order = sorted(got, key=lambda r: r["mix_order"])
    half = Counter(r["source"] for r in order[: len(order) // 2])
    assert half["a"] / (len(order) // 2) == pytest.approx(600 / len(order), abs=0.06)


def test_budget_entropy_and_edges(spark):
    df, rows = sources(spark)
    few = mixed(df, budget=1500, max_repeat=1000.0, block=64).groupBy().sum("n_tokens").first()[0]
    assert 1500 - 4 * 15 <= few <= 1500
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    p = np.array([0.9, 0.09, 0.01])
    a = exponent(totals, target_entropy=0.9)
    w = p**a / (p**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, abs=1e-6)
    assert exponent(totals, target_entropy=2.0) == 0.0 and exponent(totals, target_entropy=0.1) == 1.0
    assert exponent(totals.limit(0)) == 1.0
    assert mixed(df.limit(0)).count() == 0
    blank = mixed(spark.createDataFrame([(1, None, "s"), (2, " ", "s")], "doc_id long, text string, source string"))
    assert sorted((r["doc_id"], r["epoch"]) for r in blank.collect()) == [(1, 0), (2, 0)]
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), (" a \n b ",)], "text string").select(word_count()).collect()] == [0, 0, 2]


def test_budget_ends_among_equal_rows(spark):
    """Of 40 equal rows only as many are taken as fit; so too for rows that differ in another column."""
    rows = [(i, "w " * 10, "a", None) for i in range(90)] + [(500, "v " * 7, "b", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(3)
    for budget in (1000, 700, 333, 41):
        got = mixed(df, budget=budget, max_repeat=1000.0).groupBy("source").agg({"n_tokens": "sum"}).collect()
        a = exponent(spark.createDataFrame([("a", 900), ("b", 280)], "source string, tokens long"), max_repeat=1000.0, budget=budget)
        w = {"a": (900 / 1180) ** a, "b": (280 / 1180) ** a}
        for s, n in got:
            share = budget * w[s] / sum(w.values())
            assert share - (10 if s == "a" else 7) - 1e-6 < n <= share + 1e-6, (budget, s, n, share)


def test_mixture_by_brute_force(spark):
    """Epochs and the partial one, source by source, from the exponent of a plain bisection."""
    df, rows = sources(spark)
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    total = sum(words.values())
    share = {s: n / total for s, n in words.items() if n}

    def repeats(a):  # the largest source once
        w = {s: p**a for s, p in share.items()}
        big = max(share, key=share.get)
        return {s: w[s] / share[s] / (w[big] / share[big]) for s in share}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if max(repeats(mid).values()) <= 3.0 else (mid, high)
    want = repeats(high)
    got = mixed(df, max_repeat=3.0, block=64).collect()
    taken, epochs = Counter(), {}
    for r in got:
        taken[r["source"]] += r["n_tokens"]
        epochs.setdefault((r["source"], r["epoch"]), []).append(r["doc_id"])
    most = Counter({s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in share})
    for s in share:
        assert want[s] * words[s] - most[s] < taken[s] <= want[s] * words[s] + 1e-3
        for e in range(int(want[s] + 1e-9)):
            assert sorted(epochs[s, e]) == sorted(i for i, _, x in rows if x == s)
        assert max(e for x, e in epochs if x == s) <= want[s]


def test_mixture_keeps_columns_of_any_name(spark, tmp_path):
    names = ["n_tokens", "epoch", "mix_order", "full", "rest", "repeat", "blocks", "block", "in", "of", "n", "rid", "row", "copies", "cut", "through", "end_in", "end_rid", "__of", "__rid", "a.b"]
    df, rows = sources(spark)
    for k, c in enumerate(names):
        df = df.drop("epoch") if not k else df
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    out = mixture(df, block=64)
    got = out.select("row.*", F.col("n_tokens").alias("t")).collect()
    assert out.select("row.*").columns == df.columns and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
    flat = mixed(df, block=64)
    assert flat.columns == [c for c in df.columns if c not in names[:3]] + names[:3] and flat.count() == len(got)
    import corpus_pipeline

    assert corpus_pipeline.mix(spark, df, None).columns == df.columns
    read = write_mixed(flat, f"file://{tmp_path}/m")
    assert sorted(r["mix_order"] for r in read.collect()) == sorted(r["mix_order"] for r in flat.select("mix_order").collect())
    order = [r["mix_order"] for r in read.collect()]
    assert sum(a > b for a, b in zip(order, order[1:], strict=False)) < 8  # files follow each other, each in order


def test_op7_keeps_every_document(spark, sf_dir):
    out = op7_mixing(spark, sf_dir)
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
