"""Queries of catalogues, tables, replies, settings and saved results, each with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import units as unit
from quarrystone.operators import answers, cells, dispatch, naming, registry, registry_build, replies, saved, settings, stores, tables
from quarrystone.plans import generation, pipeline
from quarrystone.plans.reference import TABLE_ALIASES, TABLE_VOCABULARY, retrieval_sql
from quarrystone.sources.documents import documents, parse_files
from quarrystone.sources.docx_writer import docx_files
from quarrystone.tables import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# Catalogues: the products are written as DOCX files, read back as blocks, and made a registry again.


def _item(kind: str, text, grid=None):
    return F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), (F.lit(None).cast("array<array<string>>") if grid is None else grid).alias("grid"))


def _catalogues(products: DataFrame) -> DataFrame:
    line = lambda field: F.array_join(F.transform("nomenclature", lambda s: s[field]), "\t")
    said = lambda lead, c: _item("paragraph", F.concat(F.lit(lead), F.col(c)))
    head = F.array(_item("title", F.col("product_name")), said("Type: ", "product_type"), said("Technology: ", "technology"), said("Installation: ", "install_type"))
    code = F.when(F.size("nomenclature") > 0, F.array(_item("heading", F.lit("Product Ordering Nomenclature")), _item("paragraph", line("code")), _item("paragraph", line("label")))).otherwise(F.slice(head, 1, 0))
    choices = F.transform("nomenclature", lambda s: _item("table", F.lit(None), F.array(F.concat(F.array(F.concat(F.lit("Selectable "), s["label"])), F.transform(F.map_entries(s["segment_values"]), lambda e: F.concat(e["value"], F.lit(" ("), e["key"], F.lit(")")))))))
    return docx_files(products.select(F.concat(F.lit("/catalogues/"), "source_catalogue").alias("path"), F.concat(head, code, choices).alias("items")))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(parse_files(_catalogues(table(spark, d, "products"))))
    heads = docs.select(F.col("filename").alias("document_name"), F.posexplode(F.filter("blocks", lambda b: b["type"] == "heading")).alias("pos", "b")).select("document_name", "pos", F.col("b.text").alias("heading"))
    return registry_build.build_registry(docs, naming.assign_names(heads), TABLE_VOCABULARY)


@_add("SELECT product_name, s.code AS code, s.label AS label, unnest(map_keys(s.segment_values)) AS option_code, trim(regexp_replace(unnest(map_values(s.segment_values)), '[\\s\\p{Z}]+', ' ', 'g')) AS option_text FROM (SELECT product_name, unnest(nomenclature) AS s FROM products)")
def registry_from_documents(spark, d):
    """The ordering codes of all catalogues, out of their files."""
    return _registry(spark, d).select("product_name", F.explode("nomenclature").alias("s")).select("product_name", "s.code", "s.label", F.explode("s.segment_values").alias("option_code", "option_text"))


@_add("SELECT product_name, split_part(product_name, ' ', 1) AS family, product_type, technology, install_type, source_catalogue FROM products")
def registry_facts(spark, d):
    return _registry(spark, d).select("product_name", "family", "product_type", "technology", "install_type", "source_catalogue")


@_add("SELECT product_name, family, product_type, technology, install_type, target_gas, source_catalogue, array_to_string(list_sort(coalesce(aliases, [])), '|') AS aliases, coalesce(len(nomenclature), 0) AS segments FROM products")
def registry_load(spark, d):
    """A saved registry, read from its lines of JSON."""
    kept = [f.split()[0] for f in registry_build.RECORD.split(", ")]
    lines = table(spark, d, "products").select(F.to_json(F.struct(*[c for c in kept])).alias("value"))
    r = registry_build.parse_registry(lines)
    return r.select("product_name", "family", "product_type", "technology", "install_type", "target_gas", "source_catalogue", F.array_join(F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))), "|").alias("aliases"), F.greatest(F.size("nomenclature"), F.lit(0)).alias("segments"))


@_add("SELECT product_name, source_catalogue FROM products WHERE lower(product_name) IN (SELECT DISTINCT lower(trim(product_name)) FROM chunks WHERE product_name IS NOT NULL)")
def registry_by_name(spark, d):
    """Products that the chunks name, whatever the letter case."""
    return registry_build.by_name(table(spark, d, "products"), table(spark, d, "chunks", "product_name").filter("product_name is not null")).select("product_name", "source_catalogue")


_NOTES = "SELECT product_id, product_name, source_catalogue, s.pos AS pos, s.label AS label, unnest(map_keys(s.segment_values)) AS code, unnest(map_values(s.segment_values)) AS text FROM (SELECT product_id, product_name, source_catalogue, unnest(nomenclature) AS s FROM products)"


@_add(f"WITH o AS ({_NOTES}), l AS (SELECT product_id, product_name, source_catalogue, pos, label || ': ' || string_agg(code || ' = ' || coalesce(text, ''), '; ' ORDER BY code) AS line FROM o GROUP BY product_id, product_name, source_catalogue, pos, label) SELECT product_name, source_catalogue AS document_name, product_name || ' ordering configuration -- ' || string_agg(line, ' | ' ORDER BY pos, line) AS text FROM l GROUP BY product_id, product_name, source_catalogue")
def nomenclature_notes(spark, d):
    return answers.nomenclature_notes(table(spark, d, "products"))


@_add("SELECT product_name, f.field AS field, f.value AS value FROM products p JOIN (VALUES ('install_type', 'Portable'), ('technology', 'solid state'), ('product_type', 'Analyser')) f(field, value) ON CASE f.field WHEN 'technology' THEN contains(lower(p.technology), f.value) WHEN 'product_type' THEN p.product_type = f.value ELSE p.install_type = f.value END")
def attr_filter_union(spark, d):
    """The products that meet each of three filters."""
    products = table(spark, d, "products")
    filters = spark.createDataFrame([(1, "install_type", "Portable"), (2, "technology", "solid state"), (3, "product_type", "Analyser")], "id bigint, field string, value string")
    return filters.join(dispatch.meets(products, filters), "id").select("product_name", "field", "value")


_WORDS = "regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+')"


@_add(f"WITH q AS (SELECT DISTINCT id, {_WORDS} AS w, lower(question) AS l FROM feedback), k(term, kind) AS (VALUES ('monitor', 'area monitor'), ('analyser', 'analyser'), ('detector', 'leak detector'), ('sensor', 'leak detector')), m AS (SELECT lower(product_type) AS kind, product_name, list_distinct(regexp_extract_all(lower(product_name), '[a-z0-9]+')) AS parts, regexp_extract(lower(product_name), '[a-z0-9]+') AS brand FROM products WHERE product_type <> 'Unknown'), z AS (SELECT DISTINCT q.id, q.w, k.kind FROM q JOIN k ON contains(q.l, k.term)), x AS (SELECT z.id, z.kind, count(*) AS n, bool_or(list_has_all(z.w, m.parts)) AS whole, count(DISTINCT CASE WHEN list_contains(z.w, m.brand) THEN m.brand END) AS brands, count(*) FILTER (list_contains(z.w, m.brand)) AS within FROM z JOIN m ON m.kind = z.kind GROUP BY z.id, z.kind) SELECT DISTINCT id FROM x WHERE n >= 2 AND NOT whole AND NOT (brands = 1 AND within = 1)")
def type_ambiguous(spark, d):
    """Questions for a kind of product that several have."""
    terms = {"monitor": "Area Monitor", "analyser": "Analyser", "detector": "Leak Detector", "sensor": "Leak Detector"}
    return dispatch.type_ambiguous(table(spark, d, "feedback", "id", "question"), "id", "question", table(spark, d, "products"), terms)


@_add("SELECT id, string_agg(field || '=' || value, '; ' ORDER BY ord) AS filters FROM (SELECT DISTINCT f.id, v.ord, v.field, v.value FROM feedback f JOIN (VALUES " + ", ".join(f"({k}, '{f}', '{t}')" for k, (f, t) in enumerate((f, t) for f, ts in TABLE_VOCABULARY.items() for t in sorted(ts, key=lambda t: -len(t)))) + ") v(ord, field, value) ON contains(lower(f.question), lower(v.value))) GROUP BY id")
def question_attributes(spark, d):
    """The filters that questions name."""
    found = table(spark, d, "feedback", "id", "question").distinct().select("id", dispatch.attributes(F.col("question"), TABLE_VOCABULARY, TABLE_ALIASES).alias("f"))
    return found.filter("size(f) > 0").select("id", F.array_join(F.transform("f", lambda x: F.concat(x["field"], F.lit("="), x["value"])), "; ").alias("filters"))


# Tables in texts.

_GRID = "SELECT id, i, list_transform(string_split(line[2:-2], '|'), lambda c: trim(c, ' ')) AS cells FROM (SELECT id, trim(unnest(string_split(answer, chr(10))), ' ') AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM (SELECT DISTINCT id, answer FROM feedback WHERE answer IS NOT NULL)) WHERE regexp_matches(line, '^\\|.*\\|$') AND length(line) > 1 AND NOT regexp_matches(line, '^\\|[\\s|:\\-]*-[\\s|:\\-]*\\|$')"


@_add(f"WITH g AS ({_GRID}), r AS (SELECT id, i, cells, row_number() OVER (PARTITION BY id ORDER BY i) AS k, count(*) OVER (PARTITION BY id) AS n FROM g), h AS (SELECT id, cells AS head, n FROM r WHERE k = 1) SELECT r.id, CASE WHEN h.n = 1 THEN 'keyvalue' ELSE 'header' END AS style, CASE WHEN h.n = 1 THEN 1 ELSE h.n - 1 END AS rows, string_agg(CASE WHEN h.n = 1 THEN r.cells[1] || CASE WHEN r.cells[2] <> '' THEN ': ' || r.cells[2] ELSE '' END ELSE r.cells[1] || CASE WHEN r.cells[2] <> '' THEN ': ' || h.head[2] || ': ' || r.cells[2] ELSE '' END END, '. ' ORDER BY r.k) AS text FROM r JOIN h ON h.id = r.id WHERE h.n = 1 OR r.k > 1 GROUP BY r.id, h.n")
def table_sentences(spark, d):
    """The tables in answers: style, rows and their text."""
    rows = stores.once(table(spark, d, "feedback", "id", "answer", "loaded_at")).filter("answer is not null").select("id", cells.pipe_rows(F.col("answer")).alias("grid")).filter("size(grid) > 0")
    return tables.structured(rows, "id", "grid").select("id", "style", "rows", "text")


_PARTS = "SELECT p_size AS table_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS r, p_brand AS a, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS b FROM part"


@_add(f"WITH p AS ({_PARTS}), c AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM p WINDOW w AS (PARTITION BY table_id ORDER BY r)), g AS (SELECT table_id, r, r = 0 OR (a <> '' AND b <> '' AND length(a) <= 40 AND length(b) <= 40 AND length(regexp_replace(a, '[^0-9]', '', 'g')) < 0.4 * length(a) AND length(regexp_replace(b, '[^0-9]', '', 'g')) < 0.4 * length(b) AND (a IN (a0, b0) OR b IN (a0, b0))) AS good FROM c WHERE r <= 3) SELECT table_id, CAST(coalesce(min(r) FILTER (NOT good), count(*)) AS INTEGER) AS header_rows FROM g GROUP BY table_id")
def header_run(spark, d):
    """Header rows of tables of brands and types, one table a size."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1
    rows = table(spark, d, "part", "p_size", "p_partkey", "p_brand", "p_type").select(F.col("p_size").alias("table_id"), place.alias("row_idx"), F.col("p_brand").alias("a"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("b"))
    return cells.header_rows(rows.select("table_id", "row_idx", F.posexplode(F.array("a", "b")).alias("col_idx", "text")))


_LINES = "SELECT doc_id, i, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"
_TITLED = "regexp_matches(line, '^[A-Z][A-Za-z\\-]*( [A-Z][A-Za-z\\-]*)*$') OR (upper(line) = line AND lower(line) <> line)"
_KIND = f"CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 'heading' WHEN regexp_matches(line, '^\\|.*\\|$') THEN 'table' WHEN regexp_matches(line, '^([-*+•]|\\d+[.)])\\s') THEN 'list_item' WHEN length(line) <= 80 AND NOT regexp_matches(line, '[.,;:]$') AND ({_TITLED}) THEN 'heading' ELSE 'paragraph' END"
_BLOCKS = f"SELECT *, last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT doc_id, i, line, {_KIND} AS kind FROM ({_LINES}) WHERE line <> '')"


@_add(f"WITH b AS ({_BLOCKS}), f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR kind = 'table' OR lag(kind) OVER w = 'table' OR section IS DISTINCT FROM lag(section) OVER w THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)), u AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS unit FROM f) SELECT doc_id, CAST(unit AS BIGINT) AS unit, any_value(section) AS section, CASE WHEN bool_or(kind = 'table') THEN 'table' ELSE 'text' END AS kind, count(*) AS blocks FROM u GROUP BY doc_id, unit")
def unit_islands(spark, d):
    """Runs of lines that chunks are packed from."""
    return cells.units(cells.lines(table(spark, d, "documents", "doc_id", "text"))).withColumn("kind", F.when(F.col("kind") == "table", "table").otherwise("text"))


@_add(f"WITH k AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[0-9A-Za-z_]+'))) AS kept FROM ({_LINES}) WHERE line <> '' GROUP BY 1), r AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_]+')) AS words FROM documents) SELECT r.doc_id, r.words, CASE WHEN r.words > 0 THEN round(coalesce(k.kept, 0) / r.words::DOUBLE, 6) END AS share FROM r LEFT JOIN k ON k.doc_id = r.doc_id")
def doc_coverage(spark, d):
    """The share of a document's words that its blocks hold."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return cells.word_share(docs, cells.lines(docs))


@_add("SELECT r_regionkey AS id, 'header' AS style, count(*) AS rows, string_agg(n_name || ': Key: ' || n_nationkey || ', Region: ' || r_name, '. ' ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def grid_sentences(spark, d):
    """One table of nations a region, as text."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "r_name")))  # the nations of one region
    grid = F.concat(F.array(F.array(F.lit("Nation"), F.lit("Key"), F.lit("Region"))), F.transform("g", lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string"), x["r_name"])))
    return tables.structured(joined.groupBy("r_regionkey").agg(rows.alias("g")).select(F.col("r_regionkey").alias("id"), grid.alias("grid")), "id", "grid").select("id", "style", "rows", "text")


# Replies of models, made of the deals and read back.

_NAMES = "SELECT id, coalesce(nullif(trim(regexp_replace(company, '[:\\n|,]', ' ', 'g')), ''), 'none') AS c, coalesce(nullif(trim(regexp_replace(customer_name, '[:\\n|,]', ' ', 'g')), ''), 'none') AS n FROM deals"


def _named_deals(spark, d):
    plain = lambda c: F.coalesce(F.when(F.trim(F.regexp_replace(c, "[:\n|,]", " ")) != "", F.trim(F.regexp_replace(c, "[:\n|,]", " "))), F.lit("none"))
    return table(spark, d, "deals", "id", "company", "customer_name").select("id", plain("company").alias("c"), plain("customer_name").alias("n"))


@_add(f"SELECT id, CASE id % 3 WHEN 0 THEN 'Recommend' WHEN 1 THEN 'Trade-offs' ELSE 'Insufficient' END AS outcome, CASE WHEN id % 3 = 0 THEN c ELSE '' END AS product, CASE WHEN id % 3 = 1 THEN c || '|' || n ELSE '' END AS candidates, CASE WHEN lower(c) = lower(n) THEN c ELSE c || '|' || n END AS priorities, 'Take ' || c || '.' AS recommendation FROM ({_NAMES})")
def reply_advice(spark, d):
    """Recommendation replies."""
    outcome = F.when(F.col("id") % 3 == 0, "Recommend").when(F.col("id") % 3 == 1, "Trade-offs").otherwise("Unsure")
    text = F.concat(F.lit("Confirmed Priorities:\n- "), "c", F.lit("\n2) "), "n", F.lit("\n\nOutcome:\n"), outcome, F.lit("\n\nProduct:\n"), "c", F.lit("\nCandidate Products:\n"), "c", F.lit(", "), "n", F.lit("\n\nRecommendation:\nTake "), "c", F.lit(".\n"))
    got = replies.parse_advice(_named_deals(spark, d).select("id", text.alias("t")), "id", "t")
    return got.select("id", "outcome", "product", F.array_join("candidates", "|").alias("candidates"), F.array_join("priorities", "|").alias("priorities"), "recommendation")


@_add(f"SELECT id, c AS title, n AS framing, CASE WHEN lower(c) = lower(n) THEN 1 ELSE 2 END AS priorities, c || '/' || n AS first_row, 'For ' || n AS summary FROM ({_NAMES})")
def reply_aids(spark, d):
    """Sales aid replies with a comparison."""
    text = F.concat(F.lit("Customer Priorities:\n- "), "c", F.lit("\n- "), "n", F.lit("\nTitle:\n"), "c", F.lit("\nUse Case Framing:\n"), "n", F.lit("\nComparison:\n| A | B |\n|---|:-:|\n| "), "c", F.lit(" | "), "n", F.lit(" |\nCustomer Summary:\nFor "), "n")
    got = replies.parse_aids(_named_deals(spark, d).select("id", text.alias("t")), "id", "t")
    return got.select("id", "title", "framing", F.size("priorities").alias("priorities"), F.array_join(F.element_at("table", -1), "/").alias("first_row"), "summary")


@_add(f"SELECT id, k AS pos, CASE k WHEN 1 THEN c ELSE n END AS title, CASE k WHEN 1 THEN 'because ' || n ELSE '' END AS why, CASE k WHEN 1 THEN c || '?' ELSE '' END AS questions FROM ({_NAMES}), (VALUES (1), (2)) v(k)")
def reply_points(spark, d):
    """Discovery replies of two points."""
    text = F.concat(F.lit("Right to Win: "), "c", F.lit("\nWhy It Matters: because "), "n", F.lit("\nEvidence:\nseen\nQuestions:\n- "), "c", F.lit("?\nRight to Win:  "), "n", F.lit("\nEvidence: x"))
    return replies.parse_points(_named_deals(spark, d).select("id", text.alias("t")), "id", "t").select("id", "pos", "title", "why", F.array_join("questions", "|").alias("questions"))


@_add(f"SELECT id, 'metrics|champion' AS fields, c || '?|Who is it?' AS questions FROM ({_NAMES})")
def reply_questions(spark, d):
    """Qualification replies; a field without a question gets its own."""
    text = F.concat(F.lit("Field: metrics\nQuestion: "), "c", F.lit("?\nRationale: x\nField: other\nQuestion: y"))
    got = replies.parse_questions(_named_deals(spark, d).select("id", text.alias("t")), "id", "t", [("metrics", "How much?"), ("champion", "Who is it?")])
    return got.select("id", F.array_join("fields", "|").alias("fields"), F.array_join("questions", "|").alias("questions"))


@_add(f"SELECT id, regexp_replace(c, '\\s+', ' ', 'g') AS title, 2 AS table_rows, CASE WHEN lower(c) = lower(n) THEN 1 ELSE 2 END AS listed, 'For ' || regexp_replace(n, '\\s+', ' ', 'g') AS last FROM ({_NAMES})")
def sales_aid_docx(spark, d):
    """Sales aids written as DOCX files, and read back as blocks."""
    text = F.concat(F.lit("Customer Priorities:\n- "), "c", F.lit("\n- "), "n", F.lit("\nTitle:\n"), "c", F.lit("\nComparison:\n| A | B |\n|---|:-:|\n| "), "c", F.lit(" | "), "n", F.lit(" |\nCustomer Summary:\nFor "), "n")
    blocks = parse_files(saved.aid_files(replies.parse_aids(_named_deals(spark, d).select("id", text.alias("t")), "id", "t")))
    of = lambda kind: F.col("type") == kind
    whole = blocks.groupBy(F.regexp_extract("filename", r"(\d+)", 1).cast("bigint").alias("id")).agg(F.min_by("text", "block_index").alias("title"), F.max(F.when(of("table"), F.size("grid"))).alias("table_rows"), F.count_if(of("list_item")).alias("listed"), F.max_by("text", "block_index").alias("last"))
    return whole


# Units.


@_add("SELECT l_orderkey, l_linenumber, round(l_quantity * 100, 4) AS from_ppm_vv, round(l_quantity * 10000, 4) AS vv_ppm, round(l_quantity * 400, 4) AS lel_ppm, round(l_quantity * 4 / 100, 6) AS lel_vv FROM lineitem".replace("round(l_quantity * 100, 4) AS from_ppm_vv", "round(l_quantity / 10000, 6) AS from_ppm_vv"))
def unit_values(spark, d):
    """Amounts in one unit, in the others."""
    q = F.col("l_quantity")
    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", unit.from_ppm(q).alias("p"), unit.from_percent_vv(q).alias("v"), unit.from_percent_lel(q).alias("e"))
    return x.select("l_orderkey", "l_linenumber", F.round("p.percent_vv", 6).alias("from_ppm_vv"), F.round("v.ppm", 4).alias("vv_ppm"), F.round("e.ppm", 4).alias("lel_ppm"), F.round("e.percent_vv", 6).alias("lel_vv"))


@_add("SELECT p_partkey, '0 to ' || format('{:,}', p_size * 100) || ' ppm (0% to ' || rtrim(rtrim(printf('%.6f', p_size / 100), '0'), '.') || '% v/v)' AS said FROM part")
def range_texts(spark, d):
    """Ranges as they are said."""
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", unit.said_range(unit.from_ppm(F.lit(0)), unit.from_ppm(F.col("p_size") * 100)).alias("said"))


@_add("SELECT l_orderkey, l_linenumber, l_quantity * 400 BETWEEN 2000 AND p_size * 400 AS inside FROM lineitem JOIN part ON p_partkey = l_partkey")
def range_contains(spark, d):
    """Whether an amount is in the range of its part."""
    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(table(spark, d, "part", "p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select("l_orderkey", "l_linenumber", unit.contains(unit.from_ppm(F.lit(2000)), unit.from_percent_lel(F.col("p_size")), unit.from_percent_lel(F.col("l_quantity"))).alias("inside"))


@_add("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ppm' WHEN 1 THEN 'percent_vv' ELSE 'percent_lel' END AS target, CASE WHEN p_partkey % 3 <> 0 THEN (p_size * 100)::DOUBLE ELSE (p_size * 400)::DOUBLE END AS ppm FROM part")
def conversions(spark, d):
    """Amounts that questions ask to convert."""
    question = F.concat(F.lit("What is "), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" % LEL in ppm?"))).when(F.col("p_partkey") % 3 == 1, F.concat((F.col("p_size") * 100).cast("string"), F.lit(" ppm in percent, please?"))).otherwise(F.concat(F.format_number(F.col("p_size") * 100, 0), F.lit(" ppm into % LEL"))))
    c = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", unit.conversion(question).alias("c"))
    return c.select("p_partkey", "c.target", F.col("c.amount.ppm").alias("ppm"))


# Settings.


@_add("SELECT field_name, count(*) AS bullets, 'Options of ' || field_name AS header, string_agg(trim(option_text), '|' ORDER BY option_no) AS texts FROM form_options GROUP BY field_name")
def claims_parse(spark, d):
    """Files of bullets, written and read."""
    rows = table(spark, d, "form_options").groupBy("field_name").agg(F.array_sort(F.collect_list(F.struct("option_no", F.trim("option_text").alias("t")))).alias("o"))
    text = settings.claims_text(F.concat(F.lit("Options of "), "field_name"), F.transform("o", lambda x: x["t"]))
    c = rows.select("field_name", settings.claims(text).alias("c"))
    return c.select("field_name", F.size("c.bullets").cast("bigint").alias("bullets"), "c.header", F.array_join("c.bullets", "|").alias("texts"))


@_add("SELECT field_name AS document_name, option_no - first AS chunk_index, n AS total_chunks, 'Approved Claims: ' || trim(option_text) AS text FROM (SELECT *, min(option_no) OVER (PARTITION BY field_name) AS first, count(*) OVER (PARTITION BY field_name) AS n FROM form_options)")
def claim_chunks(spark, d):
    """One chunk a bullet."""
    rows = table(spark, d, "form_options").groupBy("field_name").agg(F.array_sort(F.collect_list(F.struct("option_no", F.trim("option_text").alias("t")))).alias("o"))
    files = rows.select("field_name", settings.claims_text(F.lit("head"), F.transform("o", lambda x: x["t"])).alias("text"))
    return settings.claim_chunks(files, "field_name", "text").select("document_name", "chunk_index", "total_chunks", "text")


_TYPES = "CASE split_part(document_name, '_', 1) WHEN 'Leaflet' THEN 'Product Catalogue' WHEN 'Guide' THEN 'Technical Guide' WHEN 'Notes' THEN 'Competitive & Internal Strategy' WHEN 'Report' THEN 'Other' END"


def _types(spark, d):
    lead = F.split_part("document_name", F.lit("_"), F.lit(1))
    kind = F.when(lead == "Leaflet", "Product Catalogue").when(lead == "Guide", "Technical Guide").when(lead == "Notes", "Competitive & Internal Strategy").when(lead == "Report", "Other")
    return table(spark, d, "chunks", "document_name").filter("document_name is not null").distinct().select("document_name", kind.alias("doc_type")).filter("doc_type is not null")


@_add(f"SELECT document_name, {_TYPES} AS doc_type, coalesce({_TYPES} NOT IN ('Competitive & Internal Strategy', 'Golden Frameworks & Sales Tactics'), true) AS searched, coalesce({_TYPES} = 'Product Catalogue', false) AS catalogue FROM (SELECT DISTINCT document_name FROM chunks WHERE document_name IS NOT NULL)")
def document_types(spark, d):
    return settings.type_of(_types(spark, d), table(spark, d, "chunks", "document_name").filter("document_name is not null"))


@_add(f"SELECT row_id FROM chunks WHERE document_name IS NULL OR coalesce({_TYPES} NOT IN ('Competitive & Internal Strategy', 'Golden Frameworks & Sales Tactics'), true)")
def searched_chunks(spark, d):
    """Chunks of documents that questions search."""
    return settings.searched(table(spark, d, "chunks", "row_id", "document_name"), _types(spark, d)).select("row_id")


@_add(f"SELECT row_id FROM chunks WHERE {_TYPES} = 'Product Catalogue'")
def catalogue_chunks(spark, d):
    return settings.catalogues(table(spark, d, "chunks", "row_id", "document_name"), _types(spark, d)).select("row_id")


_FIELDS = "SELECT product_name, s.label AS label, string_agg(DISTINCT k, ',' ORDER BY k) AS options FROM (SELECT product_id, product_name, s, unnest(map_keys(s.segment_values)) AS k FROM (SELECT product_id, product_name, unnest(nomenclature) AS s FROM products)) GROUP BY product_name, s.label"


def _fields(spark, d):
    o = registry.options(table(spark, d, "products", "product_id", "nomenclature")).join(table(spark, d, "products", "product_id", "product_name"), "product_id")
    return o.groupBy("product_name", "label").agg(F.array_join(F.array_sort(F.collect_set("option_code")), ",").alias("options"))


@_add(f"WITH f AS ({_FIELDS}), o AS (SELECT product_name, label, 'x' AS own FROM f WHERE label LIKE 'S%' UNION ALL SELECT product_name, 'Extra', 'y' FROM (SELECT DISTINCT product_name FROM f)) SELECT coalesce(f.product_name, o.product_name) AS product_name, coalesce(f.label, o.label) AS label, coalesce(o.own, f.options) AS options FROM f FULL JOIN o ON o.product_name = f.product_name AND o.label = f.label WHERE coalesce(f.label, o.label) <> 'Industry'")
def effective_fields(spark, d):
    """The fields of products with edited, added and hidden ones."""
    f = _fields(spark, d)
    own = f.filter("label like 'S%'").select("product_name", "label", F.lit("x").alias("options")).unionByName(f.select("product_name").distinct().select("product_name", F.lit("Extra").alias("label"), F.lit("y").alias("options")))
    return settings.effective_fields(f, own, f.filter("label = 'Industry'").select("product_name", "label"))


@_add(f"WITH f AS ({_FIELDS}) SELECT product_name, label FROM f WHERE label NOT LIKE 'S%' AND label <> 'Industry'")
def ordering_labels(spark, d):
    """Labels of ordering codes that are neither edited nor hidden."""
    f = _fields(spark, d)
    return settings.ordering_labels(f, f.filter("label like 'S%'"), f.filter("label = 'Industry'")).select("product_name", "label")


@_add("SELECT field_name || '_' || option_no AS key, trim(option_text) AS label, option_no % 2 = 0 AS visible FROM form_options")
def form_fields(spark, d):
    """Saved fields of the form with deleted core fields, invisible."""
    rows = table(spark, d, "form_options").select(F.concat_ws("_", "field_name", "option_no").alias("key"), F.trim("option_text").alias("label"), (F.col("option_no") % 2 == 0).alias("visible"))
    return settings.form_fields(rows.filter("visible"), rows.select("key", "label"))


@_add("SELECT product_id, s.label AS label, string_agg(k || ': ' || v, chr(10) ORDER BY k) AS text FROM (SELECT product_id, s, unnest(map_keys(s.segment_values)) AS k, unnest(map_values(s.segment_values)) AS v FROM (SELECT product_id, unnest(nomenclature) AS s FROM products)) GROUP BY product_id, s.label, s.pos")
def options_text(spark, d):
    """Options as lines of text, read back and written again."""
    o = registry.options(table(spark, d, "products", "product_id", "nomenclature"))
    lines = o.groupBy("product_id", "pos", "label").agg(F.array_join(F.array_sort(F.collect_list(F.concat("option_code", F.lit(": "), "option_text"))), "\n").alias("t"))
    return lines.select("product_id", "label", settings.options_text(settings.options_map(F.col("t"))).alias("text"))


@_add(f"SELECT product_id, code, CASE WHEN text = 'Unknown' THEN code ELSE code || ': ' || text END AS shown, CASE WHEN length(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'))) <= 12 THEN trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) ELSE rtrim(left(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')), 12)) || '...' END AS short FROM ({_NOTES})")
def option_labels(spark, d):
    o = registry.options(table(spark, d, "products", "product_id", "nomenclature"))
    return o.select("product_id", F.col("option_code").alias("code"), settings.option_label(F.col("option_code"), F.col("option_text")).alias("shown"), settings.short_option(F.col("option_text"), 12).alias("short"))


@_add("SELECT field_name AS category, string_agg(DISTINCT w, '|' ORDER BY w) AS keywords FROM (SELECT field_name, lower(trim(unnest(string_split(option_text, ',')))) AS w FROM form_options) WHERE w <> '' GROUP BY field_name")
def policy_rows(spark, d):
    """Keywords of a policy, told from one text."""
    entries = table(spark, d, "form_options").groupBy("field_name").agg(F.array_join(F.collect_list("option_text"), ", ").alias("keywords")).select(F.lit(1).alias("position"), F.col("field_name").alias("category"), "keywords", F.lit(False).alias("always_unsupported"), F.lit("").alias("note"))
    return settings.policy_rows(entries).select("category", F.array_join(F.array_sort("keywords"), "|").alias("keywords"))


# Saved results and stores.


@_add("SELECT id, q.field_key AS field_key, q.question AS question FROM (SELECT id, unnest(from_json(last_qualification, '[{\"field_key\":\"VARCHAR\",\"field_label\":\"VARCHAR\",\"question\":\"VARCHAR\",\"rationale\":\"VARCHAR\"}]')) AS q, metrics, economic_buyer, decision_criteria, decision_process, paper_process, identify_pain, champion, competition FROM deals WHERE json_valid(last_qualification) AND json_type(last_qualification) = 'ARRAY') WHERE coalesce(trim(CASE q.field_key WHEN 'metrics' THEN metrics WHEN 'economic_buyer' THEN economic_buyer WHEN 'decision_criteria' THEN decision_criteria WHEN 'decision_process' THEN decision_process WHEN 'paper_process' THEN paper_process WHEN 'identify_pain' THEN identify_pain WHEN 'champion' THEN champion WHEN 'competition' THEN competition ELSE 'x' END), '') = ''")
def saved_questions(spark, d):
    """Saved questions on fields that are still blank."""
    return saved.saved_questions(table(spark, d, "deals")).select("id", "field_key", "question")


@_add("SELECT id, company || '!' AS title FROM deals WHERE id % 2 = 0 AND company IS NOT NULL UNION ALL SELECT id, NULL FROM deals WHERE id % 2 = 1 OR company IS NULL")
def saved_results(spark, d):
    """Results saved with every second deal, and read again."""
    deals = table(spark, d, "deals", "id", "company").withColumn("last", F.lit(None).cast("string"))
    new = deals.filter("id % 2 = 0").select("id", F.struct(F.concat("company", F.lit("!")).alias("title")).alias("value"))
    kept = saved.save_json(deals, new, "last")
    return kept.select("id", F.from_json("last", "title string")["title"].alias("title"))


@_add("SELECT id, coalesce(customer_name, '') || ' — ' || coalesce(company, '') AS label FROM deals")
def deal_labels(spark, d):
    return table(spark, d, "deals", "id", "customer_name", "company").select("id", saved.label().alias("label"))


@_add("SELECT document_name, octet_length(encode(document_name || '#')) AS size_bytes FROM (SELECT DISTINCT document_name FROM chunks WHERE document_name IS NOT NULL) WHERE document_name NOT LIKE 'Notes%'")
def stored_documents(spark, d):
    """Stored documents, some replaced and some taken away."""
    names = table(spark, d, "chunks", "document_name").filter("document_name is not null").distinct()
    old = names.select("document_name", F.lit("old").cast("binary").alias("content"), F.lit(3).cast("bigint").alias("size_bytes"), F.current_timestamp().alias("uploaded_at"))
    put = saved.store_documents(old, names.select("document_name", F.encode(F.concat("document_name", F.lit("#")), "UTF-8").alias("content")))
    return saved.stored_names(put.filter("document_name not like 'Notes%'"))


@_add("WITH f AS (SELECT DISTINCT id, CAST(created_at AS DATE) AS day, lower(trim(verdict)) AS v FROM feedback WHERE lower(trim(verdict)) IN ('correct', 'wrong', 'unsafe')), g AS (SELECT day, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'wrong') AS wrong, count(*) FILTER (v = 'unsafe') AS unsafe FROM f GROUP BY day) SELECT day AS period, correct, wrong, unsafe, 'day' AS by FROM g WHERE (SELECT count(*) FROM g) >= 5")
def feedback_chart(spark, d):
    """Verdicts by day, or by week where few days had any."""
    return stores.chart(table(spark, d, "feedback"))


@_add("SELECT id, CAST(created_at AS DATE) AS day, company FROM requirements ORDER BY created_at DESC, id DESC LIMIT 100")
def requirements_list(spark, d):
    """The latest requirements; the limit is the feature."""
    return stores.newest(table(spark, d, "requirements", "id", "created_at", "company"), 100).select("id", F.to_date("created_at").alias("day"), "company")


@_add("SELECT id, CAST(created_at AS DATE) AS day, use_case FROM (SELECT DISTINCT id, created_at, use_case FROM sales_aids) ORDER BY created_at DESC, id DESC LIMIT 100")
def sales_aids_list(spark, d):
    return stores.newest(table(spark, d, "sales_aids", "id", "created_at", "use_case").distinct(), 100).select("id", F.to_date("created_at").alias("day"), "use_case")


# What stands around answers.

_MATCHES = "SELECT doc_id % 97 AS query_id, doc_id AS rank, coalesce(source, 'none') AS document_name, coalesce(title, '') AS text FROM documents"


def _matches(spark, d):
    return table(spark, d, "documents", "doc_id", "source", "title").select((F.col("doc_id") % 97).alias("query_id"), F.col("doc_id").alias("rank"), F.coalesce("source", F.lit("none")).alias("document_name"), F.coalesce("title", F.lit("")).alias("text"))


@_add(f"SELECT query_id, coalesce(string_agg(text, ' ' ORDER BY rank) FILTER (document_name <> 'sales_record'), '') AS source FROM ({_MATCHES}) GROUP BY query_id")
def guard_source_text(spark, d):
    """The texts that may support a claim."""
    return answers.guard_source_text(_matches(spark, d), "sales_record")


@_add(f"WITH m AS ({_MATCHES}) SELECT query_id, 'Question intent: unknown' || chr(10) || chr(10) || 'Approved knowledge base excerpts:' || chr(10) || string_agg('[' || rank || '] ' || document_name || ' (page ' || rank || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: q' || query_id AS message FROM m GROUP BY query_id")
def user_messages(spark, d):
    """Intent, excerpts and question as one text."""
    m = _matches(spark, d).select("*", F.lit(None).cast("string").alias("section_heading"), F.col("rank").alias("page_number"), F.lit(None).cast("int").alias("slide_number"))
    q = m.select("query_id").distinct().select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question"), F.lit("unknown").alias("intent"))
    return answers.user_message(m, q)


@_add("WITH RECURSIVE p AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type AS x FROM events), f(s, k, open, done, out) AS (SELECT s, k, CASE WHEN length(x) >= 20 THEN '' ELSE x END, 0, CASE WHEN length(x) >= 20 THEN x END FROM p WHERE k = 1 UNION ALL SELECT p.s, p.k, CASE WHEN length(f.open || p.x) >= 20 THEN '' ELSE f.open || p.x END, f.done + CASE WHEN f.out IS NULL THEN 0 ELSE 1 END, CASE WHEN length(f.open || p.x) >= 20 THEN f.open || p.x END FROM f JOIN p ON p.s = f.s AND p.k = f.k + 1), e AS (SELECT s, max(k) AS k FROM p GROUP BY s) SELECT CAST(s AS VARCHAR) AS stream_id, CAST(done AS INTEGER) AS pos, out AS text FROM f WHERE out IS NOT NULL UNION ALL SELECT CAST(f.s AS VARCHAR), CAST(f.done + CASE WHEN f.out IS NULL THEN 0 ELSE 1 END AS INTEGER), f.open FROM f JOIN e ON e.s = f.s AND e.k = f.k WHERE f.open <> ''")
def batched_pieces(spark, d):
    """Small pieces of texts passed on together."""
    return answers.batched_pieces(table(spark, d, "events", "user_id", "event_id", "event_type").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("delta")))


_FIRST = "left(trim(regexp_replace(regexp_extract(chunks.text, '(?m)^(.*?(?:[.!?](?:\\s|$)|$))', 1), '[\\s\\p{Z}]+', ' ', 'g')), 300)"


def _index(spark, d):
    return pipeline.build_index(table(spark, d, "chunks"))


def _uses(spark, d):
    return table(spark, d, "deals").filter("id % 50 = 0")  # the stated query set


@_add(f"""WITH r AS ({retrieval_sql("SELECT id, use_case AS question FROM deals WHERE id % 50 = 0 AND trim(use_case) <> ''")})
    SELECT u.id, 1 AS pos, coalesce(chunks.document_name, 'nothing') AS title, coalesce({_FIRST}, 'No excerpt.') AS why FROM (SELECT id FROM deals WHERE id % 50 = 0) u LEFT JOIN r ON r.query_id = u.id AND r.rank = 1 LEFT JOIN chunks ON chunks.row_id = r.row_id""")
def discoveries(spark, d):
    """Points of use cases, by the offline model."""
    return generation.discoveries(_index(spark, d), _uses(spark, d).select("id", "use_case")).select("id", "pos", "title", "why")


@_add()
def recommendations(spark, d):
    """Recommendations of use cases, by their saved answers."""
    deals = _uses(spark, d)
    return generation.recommendations(_index(spark, d), deals.select("id", "use_case"), saved.question_answers(deals), _types(spark, d))


@_add()
def qualifications(spark, d):
    """The next questions of deals."""
    types = _types(spark, d).unionByName(table(spark, d, "chunks", "document_name").filter("document_name like 'Datasheet%'").distinct().select("document_name", F.lit(settings.METHODS).alias("doc_type")))
    return generation.qualifications(_index(spark, d), _uses(spark, d), types)


@_add()
def sales_aids_made(spark, d):
    """Sales aids of requests, own documents beside reports."""
    others = table(spark, d, "chunks", "document_name").filter("document_name like 'Report%'").distinct()
    return generation.sales_aids(_index(spark, d), table(spark, d, "sales_aids", "id", "use_case", "compare_against").filter("id % 50 = 0").distinct(), others)


@_add("SELECT DISTINCT id, CASE WHEN answer IS NOT NULL AND NOT regexp_matches(lower(trim(answer, ' ')), '^(not requested|n/?a|none|omit(ted)?)\\s*([.:–-]|$)') AND trim(answer, ' ') <> '' THEN trim(answer, ' ') END AS wording FROM feedback")
def wordings(spark, d):
    """Customer wordings of answers, by the offline model."""
    drafts = table(spark, d, "feedback", "id", "question", "answer").distinct().withColumn("blocked", F.lit(False))
    return generation.wordings(drafts)


@_add()
def routed_answers(spark, d):
    """Questions answered by the dispatcher's rules and retrieval in their scope."""
    asked = table(spark, d, "feedback", "id", "question").filter("id % 50 = 0").distinct()  # the stated query set
    return generation.answer_questions(_index(spark, d), asked, table(spark, d, "products"), vocabulary=TABLE_VOCABULARY, aliases=TABLE_ALIASES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
