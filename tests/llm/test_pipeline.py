import brute


import corpus_pipeline
from shardloom.llm.mixing import mixed


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
        if len(seen) < 6:
            assert seen[-1].columns == columns
    n = [d.count() for d in seen]
    assert n[0] >= n[1] >= n[2] >= n[3] > 0 and n[4] >= n[3] and n[5] == n[4]
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    # near copies: of each class of the stage's input exactly the smallest stays
    rows = [(r["doc_id"], r["text"]) for r in seen[1].select("doc_id", "text").collect()]
    assert ids[2] == {i for i, (_, c) in brute.near_classes(rows, 5, 80).items() if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in seen[2].select("doc_id", "text").collect()]
    assert ids[3] == ids[2] - {d for d, _ in brute.leaks(rows, items)}
    assert ids[4] == ids[3] == ids[5]
    assert seen[4].count() == mixed(seen[3]).count()
    starts = [(r["start"], r["n_tokens"]) for r in seen[5].orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_stages_take_nulls_repeats_and_clashing_names(spark, tmp_path):
    """Each stage on null and empty texts, null keys, repeated rows and columns named like its own; then on an empty table."""
    from pyspark.sql import functions as F

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in base]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None), (9001, None, "en", None), (9002, "", None, "web"), (9003, " \n", "en", "web"), (9003, " \n", "en", "web"), (9004, "word " * 200_000, "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["n", "rid", "__rid", "__many", "kept", "epoch", "n_tokens", "component_id", "row", "of", "start", "seq", "sh", "hash"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, str(tmp_path)).cache()
        got = out.collect()
        assert out.columns == now.columns and got, name
        assert all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for r in got for c in names), name
        assert {r["text"] for r in got} <= {r["text"] for r in now.select("text").collect()}
        if name == "quality":
            assert not {9001, 9002, 9003} & {r["doc_id"] for r in got}
        else:
            assert stage(spark, docs, str(tmp_path)).where("doc_id = 9001").count() >= 1, name  # no text is no reason here
        assert stage(spark, now.limit(0), str(tmp_path)).count() == 0, name
        now = out
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.tokens(spark, now.limit(0), str(tmp_path)).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100



def test_entry_without_the_subpackage(tmp_path):
    """The rest works where the training-data parts are deleted."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    shutil.rmtree(tmp_path / "r/shardloom/llm")
    os.remove(tmp_path / "r/corpus_pipeline.py")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith(('op1_', 'pipeline')) for n in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
