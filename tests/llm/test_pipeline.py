import hashlib
import random

import pytest

import brute
from pyspark.sql import functions as F
import corpus_pipeline
from flowloom.llm import suffix_dedup
from test_operators import _around, _strings, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("sf")
    base = [prose(rng, rng.randrange(60, 120)) for _ in range(60)]
    texts = [*base, *base[:5], *[" ".join([*t.split(" "), "indeed"]) for t in base[5:9]], None, "", base[20] + " " + prose(rng, 50), base[30][:400] + " " + prose(rng, 80)]
    toxic = {k for k in range(len(texts)) if k % 6 == 1 and texts[k]}
    texts = [t.replace(" ", " vile scum wretch ", 2) if k in toxic else t for k, t in enumerate(texts)]
    item = prose(rng, 14)
    texts += ["we quote: " + item + " " + prose(rng, 60)]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), toxic


def test_each_stage_against_a_simple_version(spark, folder, tmp_path):
    path, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            assert len(set(after) ^ (set(before) - toxic)) <= 2 and set(after) <= set(before)
        elif name == "simhash_near_dedup":
            comp = brute.components({i: brute.fingerprint(r.text) for i, r in before.items()})
            assert set(after) == set(comp.values())
        elif name == "suffix_array_dedup":
            want = {i: rest.decode("utf-8", "ignore") for i, _, n, _, _, rest in brute.repeats([(i, r.text) for i, r in before.items()]) if not n or rest.split()}
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "benchmark_decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
            assert set(after) == {i for i, r in before.items() if not brute.contamination(r.text, items)[4]} and len(after) < len(before)
        else:
            assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in after.items()} == {i: brute.tokens(r.text) for i, r in before.items()}
    assert corpus_pipeline.run(spark, path).count() == len(after)
    assert hashlib and corpus_pipeline.ORACLE_SQL is None


def test_empty_table_passes_through(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_null_and_repeated_ids_and_other_columns(spark, folder):
    path, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "source", F.lit("x").alias("row"), F.lit(2).alias("score"))
    one = docs.where("doc_id in (0, 2)")
    odd = docs.union(one).union(one.select(F.lit(None).cast("long"), "text", "source", "row", "score")).union(docs.where("doc_id = 3").select(F.lit(4), "text", "source", "row", "score"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        rows = [(r.doc_id, r.text) for r in out.collect()]
        ids = [i for i, _ in rows if i is not None]
        if name == "toxicity":
            assert rows.count((0, rows[[i for i, _ in rows].index(0)][1])) == 2 and [i for i, _ in rows].count(None) == 2
        elif name == "simhash_near_dedup":
            assert len(ids) == len(set(ids)) and None not in [i for i, _ in rows]
        odd = out.withColumn("lang", F.lit("en"))
    assert corpus_pipeline.STAGES[-1][1](spark, odd, path).count() == odd.count() > 0


def test_memory_of_the_suffix_stage_with_more_documents_around_a_passage():
    import tracemalloc

    def peak(n):
        rng = random.Random(23)
        texts = next(_around(rng, n, prose(rng, 12)))
        table = _strings(texts, range(len(texts)))
        tracemalloc.start()
        suffix_dedup._compare(4)(table)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(100)
    assert peak(9000) < 2 * peak(3000)
