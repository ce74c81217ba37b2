import pytest
from pyspark.sql import functions as F

from quarrystone.llm.mixing import in_buckets, mixture

pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, source string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def _docs(spark):
    rows = [(k, f"Sentence number {k} of the first source. " * (1 + k % 5), "Big Source" if k % 2 else " big-source", 0) for k in range(400)]
    rows += [(1000 + k, f"A small source has text {k}. " * 3, "small", 0) for k in range(12)]
    rows += [(2000, None, "small", 0), (2001, "", "big_source", 0), (2002, "No target.", "other", 0), (2003, "No source.", None, 0)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big_source", 0.8, 1), ("small", 0.2, 3)], TARGETS)
    rows, report = mixture(_docs(spark), targets)
    by = {r.source: r for r in report.collect()}
    assert abs(by["small"].actual_share - 0.2) < 0.01 and abs(by["big_source"].actual_share - 0.8) < 0.01
    used = rows.collect()
    count = {}
    for r in used:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(n for k, n in count.items() if k < 1000) == 1 and max(count.values()) <= 3
    assert not {2000, 2001, 2002, 2003} & set(count)
    assert {s: sum(r.n_tokens for r in used if r.source == s) for s in by} == {s: r.used_tokens for s, r in by.items()}
    # Complete epochs come first: no document is used twice more than another of its source.
    small = [count.get(1000 + k, 0) for k in range(12)]
    assert max(small) - min(small) <= 1
    assert sorted((r.doc_id, r.epoch) for r in used) == sorted(set((r.doc_id, r.epoch) for r in used))


def test_given_total_and_other_seed(spark):
    targets = spark.createDataFrame([("big_source", 0.5, 2), ("small", 0.5, 2), ("none", 0.0, 1)], TARGETS)
    a, report = mixture(_docs(spark), targets, total_tokens=300, seed=1)
    b, _ = mixture(_docs(spark), targets, total_tokens=300, seed=2)
    assert abs(sum(r.used_tokens for r in report.collect()) - 300) < 60
    assert {r.doc_id for r in a.collect()} != {r.doc_id for r in b.collect()}


def test_empty(spark):
    targets = spark.createDataFrame([("x", 1.0, 2)], TARGETS)
    rows, report = mixture(_docs(spark).limit(0), targets)
    assert rows.count() == 0
    assert [(r.used_tokens, r.actual_share) for r in report.collect()] == [(0, 0.0)]


def test_buckets_are_even_for_any_weights(spark):
    """No bucket holds much more than its part, also of sources of low weights, and keys rise with buckets."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "low").when(F.col("id") % 3 == 1, "high").otherwise("mixed").alias("source"), (F.col("id") % 50 + 1).alias("n_tokens"))
    weight = F.when(F.col("source") == "low", 0.25).when(F.col("source") == "high", 1.0).otherwise(0.25 + (F.xxhash64("doc_id") % 1000 + 1000) / 2000 * 0.75)
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("key", -F.log((F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) + 0.5) / 1e6) / F.col("weight"))
    out = in_buckets(rows, 20).cache()
    assert out.count() == 60_000
    tops = out.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("source", "bucket").collect()
    for source in ("low", "high", "mixed"):
        own = [r for r in tops if r.source == source]
        assert len(own) == 20 and max(r.t for r in own) <= 1.3 * sum(r.t for r in own) / 20
        assert all(a.high <= b.low for a, b in zip(own, own[1:], strict=False))


def test_shares_epochs_and_caps_on_the_tables(spark):
    """Each source comes within half a document of its share, complete epochs precede the selection, and no document is used too often."""
    d = "/root/testdata/sf0.01"
    docs, targets = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"), spark.read.parquet(f"{d}/mix_targets.parquet")
    rows, report = mixture(docs, targets)
    uses = rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.max("epoch").alias("last"), F.first("n_tokens").alias("n")).collect()
    said = {r.source: r for r in report.collect()}
    total = sum(r.used_tokens for r in said.values())
    assert abs(sum(r.target_share for r in said.values()) - 1) < 1e-6
    for name, r in said.items():
        own = [u for u in uses if u.source == name]
        assert all(u.uses == u.last <= r.max_repeats for u in own)
        assert sum(u.uses * u.n for u in own) == r.used_tokens and max(u.uses for u in own) == r.most_uses
        assert abs(r.used_tokens / total - r.actual_share) < 1e-5
        assert abs(r.actual_share - r.target_share) <= max(u.n for u in own) / total + 1e-3, name
        counts = {u.uses for u in own}
        assert max(counts) - min(counts) <= 1 and (min(counts) == max(counts) == 1 or len(own) == r.documents or max(counts) == 1)
