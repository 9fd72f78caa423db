"""Repeated rows and very long values where the operators' own tests don't have them."""

import numpy as np
from pyspark.sql import functions as F

from framelake.llm import ann, pii, quality, revisits


def test_revisits_of_very_long_urls(spark):
    long = "http://x.org/" + "p" * 200_000 + "?" + "&".join(f"k{i}={i}" for i in range(2000))
    other = long[:-1] + "x"
    rows = [(1, long, 10, True, {"ETag": "a"}), (2, long, 20, False, {"ETag": "a"}), (3, other, 20, False, {"ETag": "a"}), (2, long, 20, False, {"ETag": "a"})]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, ts long, full boolean, headers map<string,string>"))
    assert sorted((r.record_id, r.status, r.refers_to) for r in got.collect() if r.record_id > 1) == [(2, "resolved", 1), (2, "resolved", 1), (3, "orphan", None)]


def test_nearest_of_one_row_twice(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    twice = rows + [rows[7], rows[7], rows[100]]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), exact=True).select("query_id", "rank", "vec_id", "score").collect()]
    x = dict(rows)
    for q in (0, 100, 200):  # repeated rows count once
        true = sorted((float(np.sqrt(((np.array(v) - np.array(x[q])) ** 2).sum())), i) for i, v in rows if i != q)[:10]
        assert sorted(r[1:3] for r in got if r[0] == q) == [(k + 1, i) for k, (_, i) in enumerate(true)]


def test_repeated_rows_are_judged_alike(spark):
    text = "write to ada@x.org or 10.0.0.1, or +1 (555) 010-9999"
    rows = [(1, text), (1, text), (None, text), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = pii.summary(pii.find_personal_data(df, keep=["doc_id"])).collect()
    assert len(spans) == 5 and len({(r.n_email, r.n_ip, r.n_phone, r.base_sha256) for r in spans if r.n_email}) == 1
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("a good plain sentence about things "), F.col("id"))).otherwise("buy buy $$$ !!! click").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    scored = quality.score_quality(docs.limit(40).union(docs.limit(40)).union(spark.createDataFrame([(None, "x " * 3), (None, "x " * 3)], "doc_id long, text string")), model, keep=["doc_id"])
    each = scored.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("score").alias("scores")).collect()
    assert {(r.n, r.scores) for r in each} == {(2, 1)}
