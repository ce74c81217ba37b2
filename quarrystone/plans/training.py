"""Queries for packed values, units and nested records (problems 2, 4 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.nested_records import child_rows
from quarrystone.operators.packed_values import split_packed
from quarrystone.operators.unit_ranges import product_concentrations, requirement_concentrations
from quarrystone.tables import table

#: The fields that hold several values.
PACKED_FIELDS = ["comm_protocols", "certifications", "target_gas"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values of the packed fields; the options of the form are a table of settings of fixed size."""
    known: dict[str, list[str]] = {f: [] for f in PACKED_FIELDS}
    for r in table(spark, sf_dir, "form_options", "field_name", "option_text").toLocalIterator():
        if r.field_name in known and r.option_text:
            known[r.field_name].append(r.option_text)
    return split_packed(table(spark, sf_dir, "requirements"), "id", PACKED_FIELDS, known)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All concentrations in parts per billion; a unit that only a remark states counts, also where the forest doubts it."""
    required, _ = requirement_concentrations(table(spark, sf_dir, "requirements"), follow_remarks=True)
    listed = product_concentrations(table(spark, sf_dir, "products", "product_id", "nomenclature"))
    out = required.withColumn("src_table", F.lit("requirements")).unionByName(listed.withColumn("src_table", F.lit("products")))
    return out.select("src_table", "record_key", "field_name", "low_ppb", "high_ppb")


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units assigned to ranges that have none: predicted, calibrated confidence and route."""
    return requirement_concentrations(table(spark, sf_dir, "requirements"))[1]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows of the three JSON columns."""
    aids, deals = table(spark, sf_dir, "sales_aids", "id", "result"), table(spark, sf_dir, "deals", "id", "last_recommendation", "last_discovery")
    return (
        child_rows(aids, "id", "result", "sales_aids.result", "result")
        .unionByName(child_rows(deals, "id", "last_recommendation", "deals.last_recommendation", "recommendation"))
        .unionByName(child_rows(deals, "id", "last_discovery", "deals.last_discovery", "discovery"))
    )


def _nested_sql() -> str:
    """The child rows in SQL, told from the texts of JSON parts: what an element says is what is left of it without keys and blank strings."""
    blank = r"(?:\s|\p{Z}|\\[tnrf])*"
    said = lambda x: f"coalesce(regexp_matches(regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '\"(?:[^\"\\\\]|\\\\.)*\"\\s*:', '', 'g'), '\"{blank}\"', '', 'g'), '[\"0-9tf]'), false)"
    els = lambda v: f"CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN [] WHEN json_type({v}) = 'ARRAY' THEN json_extract({v}, '$[*]') ELSE [{v}] END"
    pick = lambda x, *names: f"CASE WHEN json_type({x}) = 'OBJECT' THEN CASE " + " ".join(f"WHEN list_contains(json_keys({x}), '{n}') THEN json_extract({x}, '$.{n}')" for n in names) + " END END"
    decode = "CASE WHEN json_type(j) <> 'VARCHAR' THEN j WHEN json_valid(json_extract_string(j, '$')) THEN CAST(json_extract_string(j, '$') AS JSON) END"
    lists = {"priority": ("customer_priorities", "customerPriorities", "confirmed_priorities", "confirmedPriorities"), "candidate": ("candidate_products", "candidateProducts"), "source": ("sources",)}
    simple = " UNION ALL ".join(f"SELECT src, id, '{c}' AS child, k AS pos1, 0 AS pos2, 0 AS pos3 FROM (SELECT src, id, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM (SELECT src, id, {els('v')} AS e FROM (SELECT src, id, {pick('j', *names)} AS v FROM root))) WHERE {said('x')}" for c, names in lists.items())
    rule = r"^[\s\p{Z}|:+=\-]*-[\s\p{Z}|:+=\-]*$"
    return f"""
        WITH raw AS (SELECT DISTINCT 'sales_aids.result' AS src, id, result AS t, 'result' AS form FROM sales_aids UNION SELECT 'deals.last_recommendation', id, last_recommendation, 'recommendation' FROM deals UNION SELECT 'deals.last_discovery', id, last_discovery, 'discovery' FROM deals),
        d0 AS (SELECT src, id, form, CAST(t AS JSON) AS j FROM raw WHERE id IS NOT NULL AND t IS NOT NULL AND json_valid(t)),
        d1 AS (SELECT src, id, form, {decode} AS j FROM d0), d2 AS (SELECT src, id, form, {decode} AS j FROM d1), d3 AS (SELECT src, id, form, {decode} AS j FROM d2),
        e1 AS (SELECT src, id, form, CASE WHEN json_type(j, '$.data') = 'OBJECT' THEN json_extract(j, '$.data') ELSE j END AS j FROM d3),
        e2 AS (SELECT src, id, form, CASE WHEN json_type(j, '$.attributes') = 'OBJECT' THEN json_extract(j, '$.attributes') ELSE j END AS j FROM e1),
        root AS (SELECT src, id, CASE WHEN json_type(j, '$.' || form) = 'OBJECT' THEN json_extract(j, '$.' || form) ELSE j END AS j FROM e2 WHERE json_type(j) = 'OBJECT'),
        pt AS (SELECT src, id, unnest(e) AS p, generate_subscripts(e, 1) AS i FROM (SELECT src, id, {els('v')} AS e FROM (SELECT src, id, {pick('j', 'right_to_win', 'rightToWin')} AS v FROM root))),
        qs AS (SELECT src, id, i, unnest(e) AS q, generate_subscripts(e, 1) AS k FROM (SELECT src, id, i, {els('v')} AS e FROM (SELECT src, id, i, {pick('p', 'questions')} AS v FROM pt))),
        qw AS (SELECT *, CASE WHEN json_type(q) = 'OBJECT' THEN json_extract(q, '$.text') ELSE q END AS w FROM qs),
        fu AS (SELECT src, id, i, k, unnest(e) AS f, generate_subscripts(e, 1) AS m FROM (SELECT src, id, i, k, {els('v')} AS e FROM (SELECT src, id, i, k, {pick('q', 'follow_ups', 'followUps')} AS v FROM qs))),
        an AS (SELECT src, id, unnest(map_keys(m)) AS question, unnest(map_values(m)) AS a FROM (SELECT src, id, CAST(json_extract(j, '$.answers') AS MAP(VARCHAR, JSON)) AS m FROM root WHERE json_type(j, '$.answers') = 'OBJECT')),
        places AS (SELECT src, id, json_extract_string(w, '$') AS question, min((i, k)) AS place FROM qw WHERE {said('w')} GROUP BY ALL),
        items AS (SELECT src, id, e, unnest(e) AS x, generate_subscripts(e, 1) AS k, len(list_filter(e, lambda y: json_type(y) NOT IN ('VARCHAR', 'NULL'))) = 0 AS plain FROM (SELECT src, id, {els('v')} AS e FROM (SELECT src, id, {pick('j', 'comparison')} AS v FROM root))),
        lines AS (SELECT src, id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT src, id, CASE WHEN len(e) = 1 THEN string_split(coalesce(json_extract_string(e[1], '$'), ''), chr(10)) ELSE list_transform(e, lambda y: coalesce(json_extract_string(y, '$'), '')) END AS ls FROM items WHERE plain AND k = 1)),
        ruled AS (SELECT *, regexp_matches(line, '{rule}') AS rule, min(CASE WHEN regexp_matches(line, '{rule}') THEN k END) OVER (PARTITION BY src, id) AS first FROM lines),
        kept AS (SELECT src, id, line, row_number() OVER (PARTITION BY src, id ORDER BY k) AS pos FROM ruled WHERE first IS NULL OR (k > first AND NOT rule)),
        ev AS (SELECT src, id, k, unnest(e) AS y, generate_subscripts(e, 1) AS m FROM (SELECT src, id, k, {els('v')} AS e FROM (SELECT src, id, k, {pick('x', 'evidence')} AS v FROM items WHERE NOT plain))),
        out AS ({simple}
            UNION ALL SELECT src, id, 'point', i, 0, 0 FROM pt WHERE {said('p')} UNION ALL SELECT src, id, 'question', i, k, 0 FROM qw WHERE {said('w')} UNION ALL SELECT src, id, 'follow_up', i, k, m FROM fu WHERE {said('f')}
            UNION ALL SELECT an.src, an.id, 'answer', place[1], place[2], 0 FROM an JOIN places ON places.src = an.src AND places.id = an.id AND places.question = an.question WHERE {said('a')}
            UNION ALL SELECT src, id, 'comparison_row', pos, 0, 0 FROM kept WHERE regexp_matches(line, '[^\\s\\p{{Z}}]')
            UNION ALL SELECT src, id, 'comparison_row', k, 0, 0 FROM items WHERE NOT plain AND {said("CASE WHEN json_type(x) = 'OBJECT' THEN json_merge_patch(x, '{\"evidence\": null}') ELSE x END")} UNION ALL SELECT src, id, 'evidence', k, m, 0 FROM ev WHERE {said('y')})
        SELECT DISTINCT src AS src_field, id AS record_id, child, CAST(pos1 AS BIGINT) AS pos1, CAST(pos2 AS BIGINT) AS pos2, CAST(pos3 AS BIGINT) AS pos3 FROM out"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p4_found": p4_found, "p4_units": p4_units, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _nested_sql()}
