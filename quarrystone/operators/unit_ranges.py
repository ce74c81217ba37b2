"""Concentrations of mixed units and wordings as parts per billion, with a classifier for missing units.

Amounts are read in one Arrow stage. Ranges written without a unit go to a forest of decision trees that knows the
magnitude, the notation, the gas, the source of the row and the tolerance beside it, and is fitted on ranges that have a unit of their
own. Its scores are calibrated on others of these: they give the units a range may have and how sure the likeliest is.
Where a remark states a unit, it is held against those the forest allows; ranges that are not settled so go to review.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.concentration import PPB, Range, in_ppb, ranges, stated_unit, tolerance_with_unit
from quarrystone.session import materialise

UNITS = list(PPB)
#: Labelled rows the forest is fitted on, and those its scores are calibrated on, at most each.
TRAINING_ROWS = 10_000
CALIBRATION_ROWS = 5_000
#: From this calibrated confidence on, an assignment is converted.
CONFIDENT = 0.95
#: Share of the calibration rows whose true unit the forest must allow: it sets the lowest score of a unit that is allowed.
COVERAGE = 0.999
_AMOUNT = T.DecimalType(30, 9)
_PARSED = T.StructType(
    [
        T.StructField("known", T.ArrayType(T.StructType([T.StructField("low_ppb", T.LongType()), T.StructField("high_ppb", T.LongType())]))),
        T.StructField("bare", T.ArrayType(T.StructType([T.StructField("low", _AMOUNT), T.StructField("high", _AMOUNT)]))),
        T.StructField("unit", T.StringType()),
        T.StructField("first_low", T.DoubleType()),
        T.StructField("first_high", T.DoubleType()),
        T.StructField("stated", T.StringType()),
        T.StructField("tolerance_ppb", T.LongType()),
        T.StructField("share", _AMOUNT),
        T.StructField("tolerance_unit", T.StringType()),
        T.StructField("too_large", T.BooleanType()),
    ]
)


def _decimal(x: Fraction) -> Decimal:
    return (Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal("1.000000000"))


def _fits(r: Range, stated: str | None) -> bool:
    """Whether a range is a 64-bit number of parts per billion in its unit, in the stated one if it has none, or in any if none is stated."""
    return max(abs(r.low), abs(r.high)) * PPB[r.unit or stated or "vol"] < 2**63 - 1


def _ranges_of(text: str | None, stated: str | None = None) -> tuple[list[dict], list[dict], str | None, float | None, float | None, bool]:
    """What a text says of ranges: those with a unit and those without, the first one's unit and ends, and whether one was too large."""
    said = ranges(text)
    found = [r for r in said if _fits(r, stated)]
    known = list(dict.fromkeys(in_ppb(r) for r in found if r.unit))
    bare = list(dict.fromkeys((_decimal(r.low), _decimal(r.high)) for r in found if not r.unit))
    first = found[0] if found else None
    ends = (first.unit, float(first.low), float(first.high)) if first else (None, None, None)
    return [{"low_ppb": a, "high_ppb": b} for a, b in known], [{"low": a, "high": b} for a, b in bare], *ends, len(found) < len(said)


def _tolerance_of(text: str | None) -> tuple[int | None, Decimal | None, str | None, bool]:
    tol, share, unit = tolerance_with_unit(text)
    large = (tol or 0) >= 2**63 or (share or 0) >= 1000
    return None if (tol or 0) >= 2**63 else tol, None if share is None or share >= 1000 else _decimal(share), unit, large


def parse_amounts(rows: DataFrame, key: str, range_col: str, accuracy_col: str | None = None, remark_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``key``, the columns ``keep`` and what the texts say: see the fields of the schema. Nulls say nothing.

    ``too_large`` says that an amount does not fit a 64-bit number of parts per billion; such amounts are in no other field.
    """
    keep = keep or []
    null = F.lit(None).cast("string")
    src = rows.select(key, *keep, F.col(range_col).alias("_range"), (F.col(accuracy_col) if accuracy_col else null).alias("_accuracy"), (F.col(remark_col) if remark_col else null).alias("_remark"))
    head = [src.schema[c] for c in [key, *keep]]
    struct = lambda a, b, t: pa.list_(pa.struct([(a, t), (b, t)]))
    kinds = [struct("low_ppb", "high_ppb", pa.int64()), struct("low", "high", pa.decimal128(30, 9)), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.decimal128(30, 9), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Wordings come again: each is read once, as long as it is remembered.
        range_of, tolerance_of = lru_cache(100_000)(_ranges_of), lru_cache(50_000)(_tolerance_of)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            n = len(head)
            for text, accuracy, remark in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True):
                known, bare, unit, low, high, large = range_of(text)
                tol, share, tol_unit, tol_large = tolerance_of(accuracy)
                stated = stated_unit(remark) if bare or not known else None
                if large and stated:
                    known, bare, unit, low, high, large = range_of(text, stated)
                row = (known, bare, unit, low, high, stated, tol, share, tol_unit, large or tol_large)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], [f.name for f in head] + _PARSED.names)

    return src.mapInArrow(run, T.StructType(head + _PARSED.fields))


def _features() -> dict[str, Column]:
    """What the classifier sees of a row: magnitude, notation, category, source and the neighbouring tolerance. What a remark states is not among it."""
    high, low = F.col("first_high"), F.col("first_low")
    gas = F.lower(F.coalesce(F.col("target_gas"), F.lit("")))
    return {
        "magnitude": F.log10(F.greatest(high, F.lit(1e-6))),
        "low_magnitude": F.log10(F.greatest(low, F.lit(1e-6))),
        "from_zero": (low == 0).cast("double"),
        "whole": (high == F.floor(high)).cast("double"),
        "round_high": (high % 500 == 0).cast("double"),
        "hydrogen": gas.rlike("hydrogen|h2").cast("double"),
        "gases": F.size(F.split(gas, "[,;/|]")).cast("double"),
        "family": F.pmod(F.xxhash64(F.lower(F.coalesce(F.col("product_family"), F.lit("")))), F.lit(16)).cast("double"),
        "tolerance_magnitude": F.coalesce(F.log10(F.greatest(F.col("tolerance_ppb").cast("double"), F.lit(1e-6))), F.lit(-9.0)),
        **{f"tolerance_{u}": (F.coalesce(F.col("tolerance_unit"), F.lit("")) == u).cast("double") for u in UNITS},
    }


def predict_units(parsed: DataFrame, seed: int = 7, confident: float = CONFIDENT, coverage: float = COVERAGE) -> DataFrame:
    """``(id, stated, predicted, plausible, confidence, route)`` of the rows whose ranges have no unit; route is converted or review.

    Labels are the units written beside ranges; rows whose unit a remark states are held out. At most ``TRAINING_ROWS`` labelled rows fit the
    forest, ``CALIBRATION_ROWS`` others give the share of right assignments per bin of its score, made monotone, and the
    score that the true unit reaches in a share ``coverage`` of them: ``plausible`` has the units of such a score, the likeliest first. ``predicted`` is the
    likeliest; where a remark states a unit, it is that unit if the forest allows it, and null else. Converted are predictions a
    remark agrees with and those of a calibrated confidence of ``confident`` or more where none speaks. Amounts too large for any unit are
    in review without a prediction. Without labels of two units nothing can be learned: every unit is allowed, at confidence 0.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    features = _features()
    seen = parsed.filter(F.col("first_high").isNotNull()).withColumns(features)
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(seen)
    order = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000))
    labelled = rows.filter(F.col("unit").isNotNull() & (F.size("known") == 1)).withColumn("label", F.array_position(F.array(*map(F.lit, UNITS)), F.col("unit")).cast("double") - 1)
    small = labelled.select("id", "features", "label", order.alias("part"), F.xxhash64(F.lit(seed + 1), "id").alias("rank"))
    pick = lambda df, n: df.orderBy("rank", "id").limit(n)
    train = materialise(pick(small.filter("part < 700"), TRAINING_ROWS), "units-train")
    held = materialise(pick(small.filter("part >= 700"), CALIBRATION_ROWS), "units-held")
    null = F.lit(None).cast("string")
    large = parsed.filter("too_large").select("id", "stated", null.alias("predicted"), F.lit("").alias("plausible"), F.lit(0.0).alias("confidence"), F.lit("review").alias("route"))
    if train.select("label").distinct().count() < 2:
        untold = seen.filter("unit is null and size(bare) > 0")
        return untold.select("id", "stated", F.col("stated").alias("predicted"), F.lit(",".join(UNITS)).alias("plausible"), F.lit(0.0).alias("confidence"), F.when(F.col("stated").isNotNull(), "converted").otherwise("review").alias("route")).unionByName(large)
    model = RandomForestClassifier(numTrees=24, maxDepth=7, seed=seed, subsamplingRate=0.7, minInstancesPerNode=3).fit(train)
    scores = vector_to_array("probability")
    own = F.coalesce(F.get(scores, F.col("label").cast("int")), F.lit(0.0))
    top = F.array_max(scores)
    judged = materialise(model.transform(held).select(top.alias("top"), own.alias("own"), (F.col("prediction") == F.col("label")).cast("int").alias("right")), "units-judged")
    least = judged.agg(F.percentile("own", 1 - coverage).alias("q")).first().q
    bin_of = lambda c: F.least(F.lit(19), F.floor(c * 20)).cast("int")
    bins = {r.bin: (r.right, r.n) for r in judged.groupBy(bin_of(F.col("top")).alias("bin")).agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("n")).collect()}
    table = _monotone([bins.get(b, (0, 0)) for b in range(20)])
    calibrated = F.element_at(F.array(*map(F.lit, table)), bin_of(F.col("top")) + 1)
    lowest = F.lit(float(least) if least is not None else 0.0)
    ranked = F.array_sort(F.transform(F.array(*[F.struct((-F.coalesce(F.get("scores", F.lit(k)), F.lit(0.0))).alias("s"), F.lit(u).alias("u")) for k, u in enumerate(UNITS)]), lambda x: x))
    open_rows = model.transform(rows.filter("unit is null and size(bare) > 0")).select("id", "stated", scores.alias("scores")).withColumn("top", F.array_max("scores")).withColumn("ranked", ranked)
    allowed = F.transform(F.filter("ranked", lambda x: -x["s"] >= F.least(lowest, F.col("top"))), lambda x: x["u"])
    out = open_rows.select("id", "stated", allowed.alias("plausible"), F.round(calibrated, 4).alias("confidence"), F.col("ranked")[0]["u"].alias("likeliest"))
    agrees = F.array_contains("plausible", F.col("stated"))
    out = out.withColumn("predicted", F.when(F.col("stated").isNull(), F.col("likeliest")).when(agrees, F.col("stated")))
    sure = F.when(F.col("stated").isNull(), F.col("confidence") >= confident).otherwise(agrees)
    out = out.withColumn("route", F.when(sure, "converted").otherwise("review")).select("id", "stated", "predicted", F.array_join("plausible", ",").alias("plausible"), "confidence", "route")
    return out.unionByName(large)


def _monotone(bins: list[tuple[int, int]]) -> list[float]:
    """Shares of right ones by bin, pooled with neighbours until they rise, bins without rows taking the share below."""
    blocks: list[list[float]] = []
    for right, n in bins:
        blocks.append([right, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-9) >= blocks[-1][0] * max(blocks[-2][1], 1e-9):
            r, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r, blocks[-1][1] + n, blocks[-1][2] + k]
    return [(r + 0.5) / (n + 1) if n else 0.0 for r, n, k in blocks for _ in range(int(k))]


def requirement_concentrations(requirements: DataFrame, follow_remarks: bool = False) -> tuple[DataFrame, DataFrame]:
    """The concentrations of requirements and the assignments of missing units.

    The first table is ``(record_key, field_name, low_ppb, high_ppb)``: ranges with a unit of their own, and those to which the
    forest assigned the unit that the remark states; a tolerance has itself in both columns, a share of full scale needs the one range of its row. Ranges
    without any unit are only in the second table, for review. Those whose stated unit the forest does not allow are in review there, and in the first table
    in the stated unit if ``follow_remarks`` says so. Null, blank and wordy fields give no row; repeated rows come out each.
    """
    parsed = materialise(parse_amounts(requirements, "id", "sensing_range", "accuracy", "additional_requirements", ["target_gas", "product_family"]), "units")
    units = materialise(predict_units(parsed), "units-assigned")
    followed = units.filter("stated is not null" if follow_remarks else "stated is not null and route = 'converted'")
    by_row = followed.select(F.col("id").alias("_id"), F.col("stated").alias("assigned")).distinct()
    parsed = parsed.join(by_row, F.col("id").eqNullSafe(F.col("_id")) & (F.col("stated") == F.col("assigned")), "left")
    scale = F.create_map(*[x for u in UNITS for x in (F.lit(u), F.lit(PPB[u]).cast("decimal(12,0)"))])[F.col("assigned")]
    from_remark = F.when(
        F.col("assigned").isNotNull(),
        F.transform("bare", lambda r: F.struct(F.bround(r["low"] * scale, 0).try_cast("bigint").alias("low_ppb"), F.bround(r["high"] * scale, 0).try_cast("bigint").alias("high_ppb"))),
    )
    whole = parsed.withColumn("all_ranges", F.when(F.size("known") > 0, F.col("known")).otherwise(F.array_distinct(F.coalesce(from_remark, F.array().cast(_PARSED["known"].dataType)))))
    key = F.col("id").cast("string").alias("record_key")
    sensing = whole.select(key, F.lit("sensing_range").alias("field_name"), F.explode("all_ranges").alias("r")).select("record_key", "field_name", "r.low_ppb", "r.high_ppb")
    only = F.when(F.size("all_ranges") == 1, F.col("all_ranges")[0]["high_ppb"])
    amount = F.coalesce(F.col("tolerance_ppb"), F.bround(only.cast("decimal(20,0)") * F.col("share").cast("decimal(17,9)"), 0).try_cast("bigint"))
    accuracy = whole.select(key, F.lit("accuracy").alias("field_name"), amount.alias("low_ppb"), amount.alias("high_ppb")).filter("low_ppb is not null")
    return sensing.unionByName(accuracy), units


def product_concentrations(products: DataFrame) -> DataFrame:
    """``(record_key, field_name, low_ppb, high_ppb)`` of the options of segments whose label names a measuring range."""
    segments = products.select("product_id", F.explode("nomenclature").alias("s")).filter(F.lower("s.label").rlike(r"\b(range|full scale)\b") & ~F.lower("s.label").rlike(r"temp|humid|supply|voltage|length|pressure"))
    options = segments.select("product_id", "s.code", F.explode("s.segment_values").alias("option", "o_text"))
    keyed = options.select(F.concat_ws("/", F.col("product_id").cast("string"), "code", "option").alias("record_key"), "o_text")
    return parse_amounts(keyed, "record_key", "o_text").select("record_key", F.lit("nomenclature").alias("field_name"), F.explode("known").alias("r")).select("record_key", "field_name", "r.low_ppb", "r.high_ppb")
