"""The pipeline against its stages done by hand, on documents with planted cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlens.llm import mixing, quality_crf
from sessionlens.llm.registry import ORACLES, QUERIES

from oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """documents, labels, benchmark: good prose, junk, copies, near copies, a shared passage, a leak."""
    d = tmp_path_factory.mktemp("planted")
    r = random.Random(9)
    vocab = [f"word{i}" for i in range(3000)]

    def prose(n):
        return "\n".join(" ".join(r.choice(vocab) for _ in range(12)) + "." for _ in range(n // 12))

    texts = {i: prose(240) for i in range(0, 120)}
    junk = {i: " | ".join(f"{r.choice(vocab)}###" for _ in range(80)) for i in range(200, 260)}
    texts |= junk
    texts |= {300 + i: texts[i] for i in range(10)}
    texts |= {320 + i: texts[20 + i].replace(texts[20 + i].split()[100], "edited", 1) for i in range(10)}
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts |= {340 + i: prose(120) + "\n" + passage + "\n" + prose(120) for i in range(6)}
    leak = " ".join(r.choice(vocab) for _ in range(25))
    texts |= {360: prose(120) + " " + leak + " " + prose(120)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in sorted(texts.items())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if i in junk else 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, passage, leak


def test_stages_do_their_work(spark, planted):
    d, texts, passage, leak = planted
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, d), "test")
        assert docs.columns == columns
        seen.append({x["doc_id"]: x["text"] for x in docs.collect()})
    quality, simhash, substring, clean = seen
    assert set(quality) == {i for i in texts if not 200 <= i < 260}
    assert set(simhash) == set(quality) - set(range(300, 310)) - set(range(320, 330))
    assert all(simhash[i] == texts[i] for i in simhash)
    for i in range(341, 346):
        assert passage in " ".join(texts[i].split()) and passage not in " ".join(substring[i].split())
        assert substring[i].split() == texts[i].replace(passage, "").split()
    assert substring[340] == texts[340] and set(substring) == set(simhash)
    assert leak in substring[360] and clean[360].split() == texts[360].replace(leak, "").split()
    assert {i: t for i, t in clean.items() if i != 360} == {i: t for i, t in substring.items() if i != 360}
    out = corpus_pipeline.run(spark, d)
    assert set(out.columns) == {*columns, "copy_no", "n_copies", "mix_key"}
    rates = {r["r_source"]: r["rate"] for r in mixing.rates(docs).collect()}
    assert sum(rates[s] * n for s, n in docs.groupBy("source").count().collect()) == pytest.approx(len(clean))
    got = {(r["doc_id"], r["copy_no"]): r["text"] for r in out.collect()}
    assert got and all(clean[i] == t for (i, _), t in got.items())
    assert sorted(got) == sorted((r["doc_id"], r["copy_no"]) for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], ORACLES[name]) is None


def test_quality_and_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    q = QUERIES["op5_quality_crf"](spark, sf).where("held_out").join(labels, "doc_id")
    assert q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97
    x = QUERIES["op4_language_id"](spark, sf).where("held_out and lang_pred <> 'und'").join(docs, "doc_id")
    assert x.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98


def test_threshold_of_the_stage_is_the_query_s():
    assert quality_crf.THRESHOLD == 0.7 and re.match("SimHash", corpus_pipeline.STAGES[1][0])
