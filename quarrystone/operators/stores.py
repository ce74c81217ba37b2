"""Keyed stores as tables: feedback, deals and their children. Changes are rewrites that return the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts, fields of a deal in their order, and the order in which blank ones are asked for.
VERDICTS = ["correct", "wrong", "unsafe"]
FIELDS = ["metrics", "economic_buyer", "decision_criteria", "decision_process", "paper_process", "identify_pain", "champion", "competition"]
ASKED = ["identify_pain", "metrics", "economic_buyer", "champion", "competition", "decision_criteria", "decision_process", "paper_process"]


#: Values of the order of labels in one block of their numbering.
SLUG_BLOCK = 100_000


def once(rows: DataFrame, key: str = "id", late: str = "loaded_at") -> DataFrame:
    """Rows delivered again under one key made one: that of the earliest delivery."""
    columns = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(late)).alias("r"))
    return first.select(key, "r.*")


def verdict(c: Column) -> Column:
    """The verdict in its proper spelling; null where it is none of the known."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(VERDICTS), v)


def feedback_events(feedback: DataFrame) -> DataFrame:
    """Feedback once per id, with its verdict as known and its day."""
    return once(feedback).withColumn("verdict", verdict(F.col("verdict"))).withColumn("day", F.to_date("created_at"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]


def record(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """Feedback with new rows behind; a verdict that is none of the known raises ValueError, as a row is not dropped silently."""
    odd = [r.verdict for r in new.filter(~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False))).select("verdict").limit(1).collect()]
    if odd:
        raise ValueError(f"no verdict {odd[0]!r}")
    return append(feedback, new)


def cleared(rows: DataFrame) -> DataFrame:
    """The table without its rows."""
    return rows.limit(0)


#: Active days from which on a chart goes by day, and points it needs.
DAILY_FROM, CHART_POINTS = 5, 2


def chart(feedback: DataFrame) -> DataFrame:
    """``(period, correct, wrong, unsafe, by)``: verdicts by day, or by week where fewer than ``DAILY_FROM`` days had any; none where that leaves too few points."""
    days = daily(feedback)
    n = days.agg(F.count(F.lit(1)).alias("days"))
    by_day = days.select(F.col("day").alias("period"), *VERDICTS, F.lit("day").alias("by")).join(F.broadcast(n.filter(F.col("days") >= DAILY_FROM)))
    by_week = weekly(feedback).select(F.col("week").alias("period"), *VERDICTS, F.lit("week").alias("by")).join(F.broadcast(n.filter(F.col("days") < DAILY_FROM)))
    points = by_day.unionByName(by_week).drop("days")
    return points.join(F.broadcast(points.agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= CHART_POINTS))).drop("points")


def daily(feedback: DataFrame) -> DataFrame:
    """Verdicts by day; days without any are absent."""
    return feedback_events(feedback).filter("verdict is not null").groupBy("day").agg(*_counts())


def weekly(feedback: DataFrame) -> DataFrame:
    """Verdicts by week, named by the Monday that closes it; a Monday closes its own week."""
    closing = F.next_day(F.date_sub("day", 1), "MON")
    return feedback_events(feedback).filter("verdict is not null").groupBy(closing.alias("week")).agg(*_counts())


def accuracy(feedback: DataFrame) -> DataFrame:
    """One row: all verdicts, correct ones, the share in percent and the active days."""
    total = F.count("verdict")
    right = F.count_if(F.col("verdict") == "correct")
    return feedback_events(feedback).filter("verdict is not null").agg(total.alias("total"), right.alias("correct"), F.when(total == 0, 0.0).otherwise(F.round(right * 100.0 / total, 4)).alias("accuracy"), F.count_distinct("day").alias("days"))


def reports(feedback: DataFrame) -> DataFrame:
    """Feedback that says wrong or unsafe and isn't resolved."""
    return feedback_events(feedback).filter("verdict in ('wrong', 'unsafe') and coalesce(resolved, 0) = 0")


def most_reported(feedback: DataFrame) -> DataFrame:
    """The question reported most often; ties go to the latest, then to the text. A top-k report."""
    return reports(feedback).groupBy("question").agg(F.count(F.lit(1)).alias("reports"), F.max("created_at").alias("latest")).orderBy(F.desc("reports"), F.desc("latest"), "question").limit(1).select("question", "reports")


def newest(rows: DataFrame, k: int, when: str = "created_at", key: str = "id") -> DataFrame:
    """The k latest rows, ties to the higher key. A top-k report: each task keeps k rows."""
    return rows.orderBy(F.desc(when), F.desc(key)).limit(k)


def before(rows: DataFrame, cutoff: str) -> Column:
    return F.to_date("created_at") < F.lit(cutoff).cast("date")


def resolve(feedback: DataFrame, ids: list[int]) -> DataFrame:
    return feedback.withColumn("resolved", F.when(F.col("id").isin(ids), 1).otherwise(F.col("resolved")))


def delete(rows: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    return rows.filter(~F.col(key).isin(ids) | F.col(key).isNull())


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows with those of ``new`` in place of rows of the same key; missing columns are null."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The rows with new ones behind, numbered on from the highest key. ``new`` is what one call records, a few rows."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    numbered = new.withColumn("_n", F.row_number().over(Window.orderBy(*new.columns))).join(F.broadcast(top)).withColumn(key, F.col("top") + F.col("_n")).drop("top", "_n")
    return rows.unionByName(numbered, allowMissingColumns=True)


def partial_update(rows: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-blank values of ``new`` in place of the old ones; ``new`` has one row a key."""
    fresh = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return rows.join(fresh, key, "left").select(*[F.coalesce(blank(f"new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def latest_by(rows: DataFrame, key: str, when: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest row of each key, by aggregation: a key with very many rows is reduced map-side."""
    columns = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(when, tie)).alias("r")).select(key, "r.*")


def filled(fields: list[str] = FIELDS) -> Column:
    """How many of the fields are not blank."""
    out = F.lit(0)
    for f in fields:
        out = out + F.when(F.trim(F.col(f)) != "", 1).otherwise(0)
    return out


def deals_with_children(deals: DataFrame, requirements: DataFrame, aids: DataFrame) -> DataFrame:
    """Each deal with the number of its requirements and sales aids, the last one's time and its filled fields.

    Children are counted before the join, so that a deal with very many sends one row.
    """
    r = requirements.groupBy("deal_id").agg(F.count(F.lit(1)).alias("requirements"), F.max("created_at").alias("last_requirement"))
    a = aids.dropDuplicates(["id"]).groupBy("deal_id").agg(F.count(F.lit(1)).alias("sales_aids"))
    out = deals.select("id", "company", filled().alias("filled")).join(r, F.col("id") == r.deal_id, "left").drop("deal_id")
    out = out.join(a, F.col("id") == a.deal_id, "left").drop("deal_id")
    return out.select("id", "company", "filled", F.coalesce("requirements", F.lit(0)).alias("requirements"), F.to_date("last_requirement").alias("last_requirement"), F.coalesce("sales_aids", F.lit(0)).alias("sales_aids"))


def orphans(children: DataFrame, deals: DataFrame, kind: str) -> DataFrame:
    """Children whose deal is gone; those of no deal are none."""
    return children.filter("deal_id is not null").join(deals.select(F.col("id").alias("deal_id")), "deal_id", "left_anti").select(F.lit(kind).alias("kind"), "id", "deal_id").distinct()


def missing_fields(deals: DataFrame, limit: int = 3) -> DataFrame:
    """``(id, field, rank)``: blank fields of a deal in the order they are asked for. The limit is the feature."""
    order = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ASKED])
    blank = F.filter(order, lambda x: F.coalesce(F.trim(x["value"]), F.lit("")) == "")
    return deals.select("id", F.posexplode(F.slice(blank, 1, limit)).alias("at", "x")).select("id", F.col("x.field").alias("field"), (F.col("at") + 1).alias("rank"))


def numbered_children(children: DataFrame) -> DataFrame:
    """Children of each deal in the order of time: ``(deal_id, id, pos)``.

    Numbered inside blocks of one day, and over one row a block, so that no deal is gathered in one task.
    """
    base = children.filter("deal_id is not null").select("deal_id", "id", "created_at").distinct()
    bucket = F.date_trunc("day", F.col("created_at"))
    rows = base.withColumn("block", bucket)
    sizes = rows.groupBy("deal_id", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("deal_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("deal_id", "block").orderBy("created_at", "id"))
    return rows.withColumn("k", inside).join(ahead, ["deal_id", "block"]).select("deal_id", "id", (F.col("ahead") + F.col("k")).alias("pos"))


def flatten_extra(rows: DataFrame, column: str = "extra_fields") -> DataFrame:
    """``(id, key, value)`` of the JSON objects of a column; text that is none gives no row."""
    return rows.select("id", F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def unique_slugs(labels: DataFrame, label: str, order: str) -> DataFrame:
    """Adds ``slug``: the label as a key, with a suffix from the second of its kind on, by ``order``, a whole number told apart.

    Labels of one slug are numbered in blocks of their order: inside a block, and over one row a block, so that a frequent label is not gathered in one task.
    """
    from quarrystone.functions.text import slug

    made = labels.withColumn("_s", slug(F.col(label))).withColumn("_b", F.floor(F.col(order) / SLUG_BLOCK))
    sizes = made.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    n = F.row_number().over(Window.partitionBy("_s", "_b").orderBy(order)) + F.col("_ahead")
    numbered = made.join(ahead, ["_s", "_b"]).withColumn("_k", n)
    return numbered.withColumn("slug", F.when(F.col("_k") == 1, F.col("_s")).otherwise(F.concat("_s", F.lit("_"), F.col("_k").cast("string")))).select(*labels.columns, "slug")
