"""One mixture of documents of several sources with target shares of its tokens.

Each document gets an exponential key, -ln(u) divided by its quality weight (Efraimidis and Spirakis): in the
order of keys every prefix is a weighted sample without replacement. A source's budget is spent on complete
epochs of all its documents first, the rest on the prefix of that order whose tokens come nearest to it.
Prefix sums never run over a whole source in one task: keys fall into buckets, sums of buckets are added up over
a table of bounded size, and only inside a bucket are documents summed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.tokenizing import count_tokens
from quarrystone.session import materialise

#: Buckets of keys of one source. A bucket is summed in one task: 1 / BUCKETS of a source's tokens, about, whatever the weights of its documents.
BUCKETS = 2048
#: Weights are told apart in so many steps when the keys of a source are spread over the buckets.
STEPS = 40


def source_name(column: str) -> Column:
    """Source names in one spelling: lower case, without outer blanks, `_` between words."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")


def quality_weight(text: str) -> Column:
    """A weight from 0.25 to 1: the share of letters and digits, and whether sentences end, say how much a text reads as prose."""
    t = F.col(text)
    n = F.greatest(F.length(t), F.lit(1))
    word_share = F.length(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]", "")) / n
    closed = F.when(t.rlike(r"[.!?。！？।](\s|$)"), 1.0).otherwise(0.6)
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), word_share * closed * 1.2))


def _unit(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def in_buckets(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, source, n_tokens, key, bucket)``: rows of ``(doc_id, source, n_tokens, weight, key)`` with a bucket that rises with the key.

    The key of a document of weight w is below k with the probability 1 - exp(-w k). Added up over the weights of a source, by their tokens,
    that is the share of the source below k, so that all its buckets are of about one size.
    """
    step = F.round(F.col("weight") * STEPS).cast("int")
    mass = counted.groupBy("source", step.alias("step")).agg(F.sum("n_tokens").alias("tokens"))
    # One row a source, of at most STEPS entries.
    curves = mass.groupBy("source").agg(F.sum("tokens").cast("double").alias("all"), F.collect_list(F.struct((F.col("step") / STEPS).alias("w"), F.col("tokens").cast("double").alias("t"))).alias("curve"))
    above = F.aggregate("curve", F.lit(0.0), lambda acc, x: acc + x["t"] * F.exp(-x["w"] * F.col("key"))) / F.col("all")
    bucket = F.least(F.lit(buckets - 1), F.floor((1 - above) * buckets)).cast("int")
    return counted.join(curves, "source").select("doc_id", "source", "n_tokens", "key", bucket.alias("bucket"))


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``documents`` has doc_id, text and source, ``targets`` source, target_share and max_repeats. Returns

    - ``(doc_id, source, epoch int, n_tokens)``: one row per use; epoch counts a document's uses from 1;
    - ``(source, target_share, max_repeats, available_tokens, documents, used_tokens, actual_share, most_uses)``: one row per target.

    ``total_tokens`` defaults to the largest total at which every source that has tokens can reach its share within
    max_repeats. A given total above it is honoured as far as the caps allow; the report shows the shares reached.
    A source without tokens contributes nothing and the others keep their proportions. Texts without tokens, null
    sources and sources without a target are in no mixture. Rows repeated under one doc_id are each a document. Ties of keys go by
    doc_id. An empty table gives an empty mixture and a report of zeros, and null doc_ids pass as they are.
    """
    docs = documents.select("doc_id", "text", source_name("source").alias("source"))
    goals = targets.select(
        source_name("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")
    )
    # The targets are a table of settings, one row a source; documents meet them in a join on its name.
    known = docs.join(goals.select("source"), "source", "left_semi").withColumn("weight", quality_weight("text"))
    counted = count_tokens(known, ["doc_id", "source", "weight"], vocabulary=vocabulary).filter("n_tokens > 0")
    key = -F.log(_unit(seed, "doc_id", "n_tokens")) / F.col("weight")
    counted = in_buckets(materialise(counted.select("doc_id", "source", "n_tokens", "weight", key.alias("key")), "mixture"))

    sums = counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum("documents").alias("documents"))
    plan = goals.join(by_source, "source", "left").fillna(0, ["available_tokens", "documents"])
    has = F.col("available_tokens") > 0
    everyone = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over the targets only
    plan = plan.withColumn("share", F.when(has, F.col("target_share") / F.sum(F.when(has, F.col("target_share"))).over(everyone)))
    most = F.min(F.when(has & (F.col("share") > 0), F.col("max_repeats") * F.col("available_tokens") / F.col("share"))).over(everyone)
    plan = plan.withColumn("total", F.lit(float(total_tokens)) if total_tokens is not None else most)
    plan = plan.withColumn("budget", F.when(has, F.least(F.round(F.col("share") * F.col("total")), F.col("max_repeats") * F.col("available_tokens").cast("double"))).otherwise(0.0))
    plan = plan.withColumn("epochs", F.when(has, F.floor(F.col("budget") / F.col("available_tokens"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available_tokens"))

    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows a source
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(up_to), F.lit(0))).select("source", "bucket", "before", "tokens")
    marks = before.join(plan.select("source", "epochs", "rest"), "source")
    # Only the bucket in which the rest runs out is summed document by document; the others are in or out as a whole.
    border = marks.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest")))
    inside = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_border = counted.join(border.select("source", "bucket", "before", "epochs", "rest"), ["source", "bucket"])
    at_border = at_border.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    in_rest = F.col("ahead") + F.col("n_tokens") / 2 <= F.col("rest")
    uses = F.col("epochs") + F.when(in_rest, 1).otherwise(0)
    whole = counted.join(marks.join(border, ["source", "bucket"], "left_anti"), ["source", "bucket"])
    whole_uses = F.col("epochs") + F.when((F.col("before") + F.col("tokens") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    chosen = at_border.select("doc_id", "source", "n_tokens", uses.alias("uses")).unionByName(whole.select("doc_id", "source", "n_tokens", whole_uses.alias("uses"))).filter("uses > 0")
    rows = chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))).alias("epoch"), "n_tokens")

    used = chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"), F.max("uses").cast("int").alias("most_uses"))
    report = plan.select("source", "target_share", "max_repeats", "available_tokens", "documents").join(used, "source", "left").fillna(0, ["used_tokens", "most_uses"])
    total = F.sum("used_tokens").over(everyone)
    report = report.withColumn("actual_share", F.when(total > 0, F.round(F.col("used_tokens") / total, 6)).otherwise(0.0))
    return rows, report.select("source", "target_share", "max_repeats", "available_tokens", "documents", "used_tokens", "actual_share", "most_uses")
