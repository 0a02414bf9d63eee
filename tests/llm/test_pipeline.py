import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    import random

    rng = random.Random(3)
    en, fr = "the with other things that were made under long rivers of north".split(), "les avec une chose qui sont faites sous longs fleuves du nord".split()
    prose = lambda w, n: " ".join(rng.choice(w) + rng.choice(("", "s", "el", "an")) for _ in range(n))
    texts = [(prose(en if i % 2 else fr, 60), "en" if i % 2 else "fr") for i in range(40)]
    item, passage = prose(en, 20), prose(en, 15)
    texts += [texts[1], ("12345 6789", "en"), (prose(en, 40) + " " + item, "en"), (prose(en, 30) + " " + passage, "en"), (passage + " " + prose(en, 30), "en"), (None, "en")]
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, (t, x) in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(range(46)) - set(seen[0]) == {41, 45}
    assert set(seen[0]) - set(seen[1]) == {40}
    assert passage in seen[2][43]["text"] and passage not in seen[2][44]["text"] and set(seen[2]) == set(seen[1])
    assert set(seen[2]) - set(seen[3]) == {42}
    assert all(r["round_trip"] for r in seen[4].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[4])


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(spark, tmp_path, rows, items=()):
    spark.createDataFrame(list(rows), SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_on_nulls_repeats_and_long_texts(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(11)
    en = [f"{a}{b}" for a in "the with other things that were made under long rivers of north".split() for b in ("", "s", "el")]
    prose = lambda n: " ".join(rng.choice(en) for _ in range(n))
    base = [(i, prose(50), "en", "s", 1) for i in range(30)]
    one, two, item = prose(60), prose(60), prose(20)
    odd = [(None, one, "en", "s", 2), (None, one, "en", "s", 3), (40, two, "en", "b", 4), (40, two, "en", "a", 5), (40, prose(40), "en", "s", 6), (41, two + " end", "en", "s", 7), (42, None, "en", "s", 8), (43, "", None, None, None), (None, item, "en", "s", 9), (44, " ".join(f"{rng.choice(en)}{k}" for k in range(30_000)), "en", None, None), (44, base[3][1], "en", "s", 10)]
    docs = written(spark, tmp_path, base + odd, [(1, item), (None, None)])
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("rest", "text_key", "lang_pred", "score", "kept", "tk")])
    at = {name: f for name, f in corpus_pipeline.STAGES}
    ids = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.collect())
    named = at["language_id"](spark, docs, str(tmp_path))
    assert named.columns == corpus_pipeline.COLUMNS
    assert ids(named) == sorted((r[0] if r[0] is not None else -1, r[1]) for r in base + odd if r[1])
    lone = at["minhash_near_dedup"](spark, docs, str(tmp_path))
    assert lone.columns == corpus_pipeline.COLUMNS
    got = lone.where("doc_id is null or doc_id >= 40").collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"] or -1) for r in got) == [(-1, 2), (-1, 3), (-1, 9), (40, 5), (40, 6), (42, 8), (43, -1), (44, -1)]
    assert [r["source"] for r in got if r["doc_id"] == 40 and r["text"] == two] == ["a"]
    assert lone.where("doc_id < 40").count() == 30
    cut = at["suffix_dedup"](spark, docs, str(tmp_path))
    assert cut.columns == corpus_pipeline.COLUMNS
    after = ids(cut.where("doc_id is null or doc_id >= 40"))
    assert after[:3] == sorted([(-1, one), (-1, one), (-1, item)]) and [i for i, _ in after[3:]].count(40) == 3 and not {42, 43} & {i for i, _ in after}
    clean = at["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == corpus_pipeline.COLUMNS and clean.where("doc_id is null").count() == 2 and clean.count() == len(base + odd) - 1
    last = at["sentencepiece"](spark, docs, str(tmp_path))
    assert last.count() == len(base + odd) and last.where("not round_trip").count() == 0


def test_empty_table(spark, tmp_path):
    written(spark, tmp_path, [], [(1, "some item of the benchmark")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_only_what_the_result_reads(spark, tmp_path):
    from tidemark.llm.store import shared_dir

    folder = shared_dir(spark).removeprefix("file:").replace("//", "/")
    import os

    before = set(os.listdir(folder))
    written(spark, tmp_path, [(i, f"the rivers of the north number {i} run long and under other things {i * 7}", "en", "s", 1) for i in range(12)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 12
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and [x[2:] for x in os.listdir(f"{folder}/{new.pop()}")] == ["benchmark_decontamination"]
