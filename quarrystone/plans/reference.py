"""Queries of the document analytics side, each with SQL for the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import units
from quarrystone.functions.text import STOPWORDS, keywords
from quarrystone.operators import cells, chunking, guard, naming, registry, stores, vectors
from quarrystone.operators import dispatch as dispatching
from quarrystone.plans import pipeline
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


_FEEDBACK = "WITH once AS (SELECT id, min(loaded_at) AS loaded_at FROM feedback GROUP BY id), f AS (SELECT DISTINCT f.id, f.created_at, f.question, f.answer, lower(trim(f.verdict)) AS verdict, f.resolved, CAST(f.created_at AS DATE) AS day FROM feedback f JOIN once o ON f.id = o.id AND f.loaded_at = o.loaded_at), k AS (SELECT * FROM f WHERE verdict IN ('correct','wrong','unsafe')) "
_COUNTS = "count(*) FILTER (verdict='correct') AS correct, count(*) FILTER (verdict='wrong') AS wrong, count(*) FILTER (verdict='unsafe') AS unsafe"


@_add(f"{_FEEDBACK} SELECT day, {_COUNTS} FROM k GROUP BY day")
def feedback_daily(spark, d):
    return stores.daily(table(spark, d, "feedback"))


@_add(f"{_FEEDBACK} SELECT CAST(day + CAST((8 - isodow(day)) % 7 AS INTEGER) AS DATE) AS week, {_COUNTS} FROM k GROUP BY 1")
def feedback_weekly(spark, d):
    return stores.weekly(table(spark, d, "feedback"))


@_add(f"{_FEEDBACK} SELECT count(*) AS total, count(*) FILTER (verdict='correct') AS correct, CASE WHEN count(*)=0 THEN 0.0 ELSE round(count(*) FILTER (verdict='correct') * 100.0 / count(*), 4)::DOUBLE END AS accuracy, count(DISTINCT day) AS days FROM k")
def feedback_accuracy(spark, d):
    return stores.accuracy(table(spark, d, "feedback"))


_OPEN = "verdict IN ('wrong','unsafe') AND coalesce(resolved,0)=0"


@_add(f"{_FEEDBACK} SELECT question, count(*) AS reports FROM k WHERE {_OPEN} GROUP BY question ORDER BY count(*) DESC, max(created_at) DESC, question LIMIT 1")
def feedback_most_reported(spark, d):
    return stores.most_reported(table(spark, d, "feedback"))


@_add(f"{_FEEDBACK} SELECT id, question, verdict FROM k WHERE {_OPEN} ORDER BY created_at DESC, id DESC LIMIT 20")
def feedback_recent(spark, d):
    return stores.newest(stores.reports(table(spark, d, "feedback")), 20).select("id", "question", "verdict")


@_add(f"{_FEEDBACK} SELECT id, question FROM f ORDER BY created_at DESC, id DESC LIMIT 50")
def feedback_list(spark, d):
    return stores.newest(stores.feedback_events(table(spark, d, "feedback")), 50).select("id", "question")


@_add(f"{_FEEDBACK} SELECT count(*) AS n FROM f WHERE day < DATE '2025-01-01'")
def feedback_count_before(spark, d):
    rows = stores.feedback_events(table(spark, d, "feedback"))
    return rows.filter(stores.before(rows, "2025-01-01")).agg(F.count(F.lit(1)).alias("n"))


@_add(f"{_FEEDBACK} SELECT id, day FROM f WHERE NOT day < DATE '2025-01-01'")
def feedback_clear_before(spark, d):
    rows = stores.feedback_events(table(spark, d, "feedback"))
    return rows.filter(~stores.before(rows, "2025-01-01")).select("id", "day")


@_add(f"{_FEEDBACK} SELECT id, CASE WHEN id IN (7, 21, 28) THEN 1 ELSE resolved END AS resolved FROM f")
def feedback_resolve(spark, d):
    return stores.resolve(stores.feedback_events(table(spark, d, "feedback")), [7, 21, 28]).select("id", "resolved")


@_add(f"{_FEEDBACK} SELECT id, verdict FROM f WHERE id NOT IN (7, 21, 28)")
def feedback_delete(spark, d):
    return stores.delete(stores.once(table(spark, d, "feedback")), [7, 21, 28]).select("id", F.lower(F.trim("verdict")).alias("verdict"))


_FILLED = " + ".join(f"CASE WHEN trim({f}) <> '' THEN 1 ELSE 0 END" for f in stores.FIELDS)


@_add(f"SELECT d.id, d.company, {_FILLED} AS filled, coalesce(r.n, 0) AS requirements, CAST(r.t AS DATE) AS last_requirement, coalesce(a.n, 0) AS sales_aids FROM deals d LEFT JOIN (SELECT deal_id, count(*) AS n, max(created_at) AS t FROM requirements GROUP BY 1) r ON d.id = r.deal_id LEFT JOIN (SELECT deal_id, count(*) AS n FROM (SELECT DISTINCT id, deal_id FROM sales_aids) GROUP BY 1) a ON d.id = a.deal_id")
def deals_with_children(spark, d):
    return stores.deals_with_children(table(spark, d, "deals"), table(spark, d, "requirements", "deal_id", "created_at"), table(spark, d, "sales_aids", "id", "deal_id"))


@_add("SELECT 'requirement' AS kind, id, deal_id FROM requirements r WHERE deal_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM deals d WHERE d.id = r.deal_id) UNION SELECT 'sales_aid', id, deal_id FROM sales_aids s WHERE deal_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM deals d WHERE d.id = s.deal_id)")
def deals_orphans(spark, d):
    deals = table(spark, d, "deals", "id")
    return stores.orphans(table(spark, d, "requirements", "id", "deal_id"), deals, "requirement").unionByName(stores.orphans(table(spark, d, "sales_aids", "id", "deal_id"), deals, "sales_aid"))


@_add("SELECT id, company FROM deals ORDER BY updated_at DESC, id DESC LIMIT 200")
def deals_list(spark, d):
    return stores.newest(table(spark, d, "deals", "id", "company", "updated_at"), 200, "updated_at").select("id", "company")


@_add("SELECT deal_id, id, row_number() OVER (PARTITION BY deal_id ORDER BY created_at, id) AS pos FROM requirements WHERE deal_id IS NOT NULL")
def requirements_for_deal(spark, d):
    return stores.numbered_children(table(spark, d, "requirements", "id", "deal_id", "created_at"))


@_add("SELECT deal_id, id, row_number() OVER (PARTITION BY deal_id ORDER BY created_at, id) AS pos FROM (SELECT DISTINCT deal_id, id, created_at FROM sales_aids) WHERE deal_id IS NOT NULL")
def sales_aids_for_deal(spark, d):
    return stores.numbered_children(table(spark, d, "sales_aids", "id", "deal_id", "created_at"))


_ASKED = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {k} AS o FROM deals WHERE coalesce(trim({f}), '') = ''" for k, f in enumerate(stores.ASKED))


@_add(f"SELECT id, field, rank FROM (SELECT id, field, row_number() OVER (PARTITION BY id ORDER BY o) AS rank FROM ({_ASKED})) WHERE rank <= 3")
def missing_fields_top3(spark, d):
    return stores.missing_fields(table(spark, d, "deals", "id", *stores.FIELDS))


@_add("WITH n AS (SELECT * FROM (SELECT deal_id, customer_name, company, row_number() OVER (PARTITION BY deal_id ORDER BY created_at DESC, id DESC) AS k FROM requirements WHERE deal_id IS NOT NULL) WHERE k = 1) SELECT d.id, coalesce(CASE WHEN trim(n.customer_name) <> '' THEN n.customer_name END, d.customer_name) AS customer_name, coalesce(CASE WHEN trim(n.company) <> '' THEN n.company END, d.company) AS company FROM deals d LEFT JOIN n ON d.id = n.deal_id")
def partial_update(spark, d):
    new = stores.latest_by(table(spark, d, "requirements", "id", "deal_id", "created_at", "customer_name", "company").withColumnRenamed("id", "req"), "deal_id", tie="req")
    return stores.partial_update(table(spark, d, "deals", "id", "customer_name", "company"), new.withColumnRenamed("deal_id", "id"), "id", ["customer_name", "company"])


@_add("SELECT id, unnest(json_keys(extra_fields)) AS key, json_extract_string(extra_fields, '$.\"' || unnest(json_keys(extra_fields)) || '\"') AS value FROM requirements WHERE extra_fields IS NOT NULL AND json_valid(extra_fields) AND json_type(extra_fields) = 'OBJECT'")
def extra_fields_flatten(spark, d):
    return stores.flatten_extra(table(spark, d, "requirements", "id", "extra_fields"))


_PLAIN = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
# A term as a whole word, told by what stands beside it: the SQL's patterns have no look around.
_INTENT = " ".join("WHEN regexp_matches(q, '(^|[^a-z0-9_])(" + "|".join(re.escape(w).replace("'", "''") for w in words) + f")(es|s)?($|[^a-z0-9_])') THEN '{k}'" for k, words in guard.INTENTS.items())


@_add(f"SELECT id, CASE {_INTENT} ELSE 'unknown' END AS intent FROM (SELECT DISTINCT id, {_PLAIN.format('question')} AS q FROM feedback)")
def intent_classify(spark, d):
    return stores.once(table(spark, d, "feedback", "id", "question", "loaded_at")).select("id", guard.intent(F.col("question")).alias("intent"))


def _hit_sql(text: str, words: list[str]) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches(regexp_replace({text}, 'non[- ]{w}(es|s)?\\b', '', 'g'), '\\b{w}(es|s)?\\b') THEN '{w}' END" for w in words)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def _claims_sql(source: str = "") -> str:
    """Claims of ``source(id, q, a, s)``, plain texts; by default those of the feedback."""
    source = source or f"SELECT DISTINCT id, {_PLAIN.format('question')} AS q, {_PLAIN.format('answer')} AS a, {_PLAIN.format('note')} AS s FROM feedback"
    def case(pick: Callable[[str, list[str], bool], str]) -> str:
        arms = [f"WHEN len({_hit_sql('q', w)}) > 0 THEN {pick(n, w, a)}" for n, w, a in guard.POLICY]
        arms += [f"WHEN len({_hit_sql('a', w)}) > 0 THEN {pick(n, w, a)}" for n, w, a in guard.POLICY]
        return "CASE " + " ".join(arms) + " END"

    both = lambda w: f"list_sort(list_distinct(list_concat({_hit_sql('q', w)}, {_hit_sql('a', w)})))"
    miss = lambda w, always: both(w) if always else f"list_filter({both(w)}, lambda x: NOT list_contains({_hit_sql('s', w)}, x))"
    inner = f"SELECT id, {case(lambda n, w, a: repr(n))} AS category, {case(lambda n, w, a: f'len({both(w)})')} AS matched, {case(lambda n, w, a: f'len({miss(w, a)})')} AS unsupported FROM ({source})"
    return f"SELECT id, category, coalesce(matched, 0) AS matched, coalesce(unsupported, 0) AS unsupported, category IS NOT NULL AND coalesce(unsupported, 0) > 0 AS blocked FROM ({inner})"


@_add(_claims_sql())
def claim_check(spark, d):
    pairs = stores.once(table(spark, d, "feedback", "id", "question", "answer", "note", "loaded_at"))
    out = guard.check_claims(pairs, "question", "answer", "note")
    return out.select("id", "category", F.size("matched").alias("matched"), F.size("unsupported").alias("unsupported"), "blocked")


@_add("SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_.+\\-]+@[a-zA-Z0-9\\-]+\\.[a-zA-Z0-9.\\-]+'), lambda e: rtrim(lower(e), '.')))) AS addresses, len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_.+\\-]+@[a-zA-Z0-9\\-]+\\.[a-zA-Z0-9.\\-]+'), lambda e: rtrim(lower(e), '.')), lambda e: NOT contains(lower(coalesce(title, '')), e)))) AS ungrounded FROM documents")
def email_grounding(spark, d):
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(guard.EMAIL), F.lit(0)), lambda e: F.rtrim(F.lower(e), F.lit("."))))
    return table(spark, d, "documents", "doc_id", "text", "title").select("doc_id", F.size(found).alias("addresses"), F.size(F.array_distinct(guard.ungrounded_addresses(F.col("text"), F.col("title")))).alias("ungrounded"))


_SIM = "SELECT q.vec_id AS query_id, b.vec_id, CAST(b.label AS VARCHAR) AS label, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) + 0.0 AS sim, q.label = b.label AS same FROM embeddings q JOIN embeddings b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank"


def _asked(spark, d):
    base = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return base, base.filter("vec_id % 50 = 0")  # the stated query set


@_add(f"SELECT query_id, vec_id, sim, rank FROM (SELECT *, {_RANK} FROM ({_SIM})) WHERE rank <= 8")
def vec_topk(spark, d):
    return vectors.top_k(*_asked(spark, d), 8).select("query_id", "vec_id", "sim", "rank")


@_add(f"SELECT query_id, vec_id, sim, rank FROM (SELECT *, {_RANK} FROM ({_SIM}) WHERE same) WHERE rank <= 8")
def vec_topk_filtered(spark, d):
    return vectors.top_k(*_asked(spark, d), 8, scope="label", mode="same").select("query_id", "vec_id", "sim", "rank")


@_add(f"SELECT query_id, vec_id, sim, rank FROM (SELECT *, {_RANK} FROM ({_SIM}) WHERE NOT same) WHERE rank <= 8")
def vec_exclude_topk(spark, d):
    return vectors.top_k(*_asked(spark, d), 8, scope="label", mode="other").select("query_id", "vec_id", "sim", "rank")


_EACH = "row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, vec_id) AS rank"


@_add(f"SELECT query_id, label, vec_id, sim FROM (SELECT *, {_EACH} FROM ({_SIM})) WHERE rank = 1")
def vec_one_per_document(spark, d):
    return vectors.top_k(*_asked(spark, d), 1, scope="label", mode="each").select("query_id", "label", "vec_id", "sim")


@_add(f"SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY rank, label) AS position FROM (SELECT *, {_EACH} FROM ({_SIM})) WHERE rank <= 10")
def vec_balanced_interleave(spark, d):
    ranked = vectors.top_k(*_asked(spark, d), 10, scope="label", mode="each")
    return vectors.interleave(ranked, "label").select("query_id", "vec_id", "label", "position")


@_add(f"SELECT query_id, max(sim) AS best, CASE WHEN max(sim) < 0.32 THEN 'none' WHEN max(sim) < 0.56 THEN 'low' ELSE 'high' END AS confidence FROM ({_SIM}) GROUP BY query_id")
def vec_confidence(spark, d):
    best = vectors.top_k(*_asked(spark, d), 1)
    return best.select("query_id", F.col("sim").alias("best"), vectors.confidence(F.col("sim")).alias("confidence"))


@_add(f"WITH s AS ({_SIM}), a AS (SELECT query_id, vec_id, 'scoped' AS part FROM (SELECT *, {_RANK} FROM s WHERE same) WHERE rank <= 6), b AS (SELECT query_id, vec_id, 'supplement' AS part FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 6) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.vec_id = b.vec_id)")
def vec_supplement_union(spark, d):
    base, asked = _asked(spark, d)
    scoped = vectors.top_k(base, asked, 6, scope="label", mode="same").select("query_id", "vec_id")
    free = vectors.top_k(base, asked, 6).select("query_id", "vec_id").join(scoped, ["query_id", "vec_id"], "left_anti")
    return scoped.withColumn("part", F.lit("scoped")).unionByName(free.withColumn("part", F.lit("supplement")))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@_add(f"SELECT id, array_to_string(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)), ' ') AS keywords FROM (SELECT DISTINCT id, question FROM feedback)")
def keywords_extract(spark, d):
    return stores.once(table(spark, d, "feedback", "id", "question", "loaded_at")).select("id", F.array_join(keywords(F.col("question")), " ").alias("keywords"))


#: A question whose keywords are looked for in texts.
_BOOSTED = ["silicone", "vapour", "leak"]
_BOOST = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in _BOOSTED)


@_add(f"SELECT row_id, hits FROM (SELECT row_id, {_BOOST} AS hits FROM chunks WHERE text IS NOT NULL) WHERE hits > 0")
def kw_boost(spark, d):
    hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in _BOOSTED), F.lit(0))
    return table(spark, d, "chunks", "row_id", "text").filter("text is not null").select("row_id", hits.alias("hits")).filter("hits > 0")


_SOUND = "text IS NOT NULL AND trim(regexp_replace(text, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g')) <> ''"


@_add(f"SELECT sha256(text) AS content, min(row_id) AS row_id, count(*) AS copies FROM chunks WHERE {_SOUND} GROUP BY 1")
def chunk_validate_dedupe(spark, d):
    rows = chunking.valid(table(spark, d, "chunks", "row_id", "text"))
    return rows.groupBy(chunking.content_id(F.col("text")).alias("content")).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies"))


@_add(f"SELECT chunk_id, row_id, document_name FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, row_id DESC) AS k FROM chunks WHERE {_SOUND}) WHERE k = 1")
def chunk_upsert_latest(spark, d):
    return chunking.upserted(table(spark, d, "chunks", "row_id", "chunk_id", "text", "document_name", "loaded_at")).select("chunk_id", "row_id", "document_name")


@_add("SELECT document_name, count(*) AS chunks, count(DISTINCT chunk_id) AS contents FROM chunks WHERE document_name IS NOT NULL GROUP BY 1")
def all_document_names(spark, d):
    return table(spark, d, "chunks", "document_name", "chunk_id").filter("document_name is not null").groupBy("document_name").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("chunk_id").alias("contents"))


@_add("SELECT count(*) AS chunks, count(DISTINCT document_name) AS documents FROM chunks")
def index_size(spark, d):
    return table(spark, d, "chunks", "document_name").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_name").alias("documents"))


@_add("SELECT row_id FROM chunks WHERE document_name IS DISTINCT FROM (SELECT min(document_name) FROM chunks)")
def index_remove_document(spark, d):
    rows = table(spark, d, "chunks", "row_id", "document_name")
    first = rows.agg(F.min("document_name").alias("gone"))
    return rows.join(F.broadcast(first), F.col("document_name") == F.col("gone"), "left_anti").select("row_id")


_TOKENS = f"WITH n AS (SELECT DISTINCT product_name FROM products WHERE product_name IS NOT NULL), t AS (SELECT DISTINCT product_name, unnest(regexp_extract_all(lower(product_name), '[a-z0-9]+')) AS token FROM n), k AS (SELECT * FROM t WHERE token NOT IN ({_STOP})), c AS (SELECT token, count(*) AS names FROM k GROUP BY 1), z AS (SELECT greatest(2, count(DISTINCT product_name) // 3) AS most FROM k)"


@_add(f"{_TOKENS} SELECT token, names, names <= most AS distinctive FROM c, z")
def token_df_distinctive(spark, d):
    return naming.token_frequency(table(spark, d, "products", "product_name"))


@_add(_TOKENS.replace("SELECT DISTINCT product_name FROM products", "SELECT DISTINCT install_type || ' ' || product_name AS product_name FROM products") + " SELECT token, names AS members FROM c, z WHERE names > most")
def token_family(spark, d):
    """Tokens that most names share, of names with the way of installation before them."""
    return naming.families(table(spark, d, "products", "product_name", "install_type").select(F.concat("install_type", F.lit(" "), "product_name").alias("product_name")))


_SAID = "SELECT DISTINCT row_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM chunks WHERE text IS NOT NULL"


@_add(f"{_TOKENS}, s AS ({_SAID}) SELECT DISTINCT s.id, k.product_name FROM s JOIN k USING (token) JOIN c USING (token), z WHERE names <= most AND length(token) >= 3")
def detect_mentions(spark, d):
    return naming.mentions(table(spark, d, "chunks", "row_id", "text"), "row_id", "text", table(spark, d, "products", "product_name"))


@_add(f"WITH s AS ({_SAID}), r AS (SELECT DISTINCT regexp_extract(lower(product_name), '([a-z0-9]+)', 1) AS token FROM products WHERE product_name IS NOT NULL) SELECT id, count(*) AS brands, count(*) >= 2 AS ambiguous FROM s JOIN r USING (token) GROUP BY id")
def ambiguous_cross_brand(spark, d):
    return naming.brands_mentioned(table(spark, d, "chunks", "row_id", "text"), "row_id", "text", table(spark, d, "products", "product_name"))


@_add()
def fuzzy_brand(spark, d):
    return naming.fuzzy_brands(table(spark, d, "chunks", "row_id", "text"), "row_id", "text", table(spark, d, "products", "product_name"))


@_add("WITH a AS (SELECT DISTINCT product_id, lower(trim(unnest(list_append(coalesce(aliases, []), product_name)))) AS alias FROM products), c AS (SELECT row_id, lower(text) AS t FROM chunks WHERE text IS NOT NULL), h AS (SELECT row_id AS id, product_id, alias FROM c JOIN a ON alias <> '' AND contains(t, alias) AND regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(alias) || '($|[^a-z0-9])')) SELECT id, product_id, alias FROM h QUALIFY row_number() OVER (PARTITION BY id, product_id ORDER BY length(alias) DESC, alias) = 1")
def alias_longest(spark, d):
    return naming.longest_alias(table(spark, d, "chunks", "row_id", "text"), "row_id", "text", table(spark, d, "products", "product_id", "product_name", "aliases"))


@_add("WITH t AS (SELECT doc_id AS id, lower(left(coalesce(text, ''), 4000)) AS t, lower(left(regexp_extract(coalesce(text, ''), 'Technology:\\s*(.+)', 1), 200)) AS line FROM documents) SELECT id, CASE WHEN contains(t, 'leak detector') THEN 'Leak Detector' WHEN contains(t, 'analyzer') THEN 'Analyzer' ELSE 'Unknown' END AS product_type, CASE WHEN contains(t, 'portable') THEN 'Portable' WHEN contains(t, 'fixed') THEN 'Fixed' ELSE 'Unknown' END AS install_type, CASE WHEN contains(line, 'solid state electrochemical') THEN 'Solid State Electrochemical' WHEN contains(line, 'cmos mems') THEN 'CMOS MEMS' WHEN contains(line, 'mems') THEN 'MEMS' WHEN contains(t, 'solid state electrochemical') THEN 'Solid State Electrochemical' WHEN contains(t, 'cmos mems') THEN 'CMOS MEMS' WHEN contains(t, 'mems') THEN 'MEMS' ELSE 'Unknown' END AS technology FROM t")
def vocab_match(spark, d):
    return registry.typed_facts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@_add("SELECT count(*) AS products, string_agg(product_name, ', ' ORDER BY product_name) AS names FROM (SELECT DISTINCT product_name FROM products WHERE lower(install_type) = 'portable' OR contains(lower(technology), 'mems'))")
def catalog_query(spark, d):
    return registry.catalog(table(spark, d, "products"), install_type="Portable", technology="MEMS")


_OPTIONS = "SELECT product_id, s.pos AS pos, s.code AS code, s.label AS label, unnest(map_keys(s.segment_values)) AS option_code, unnest(map_values(s.segment_values)) AS option_text FROM (SELECT product_id, unnest(nomenclature) AS s FROM products)"


@_add(_OPTIONS)
def nomenclature_options(spark, d):
    return registry.options(table(spark, d, "products", "product_id", "nomenclature"))


@_add(f"SELECT product_id, pos, code, label, count(*) AS options FROM ({_OPTIONS}) GROUP BY ALL HAVING count(*) >= 2")
def selectable_segments(spark, d):
    return registry.selectable(table(spark, d, "products", "product_id", "nomenclature"))


@_add(f"SELECT product_id, label, option_text FROM ({_OPTIONS}) WHERE option_code = '03'")
def decode_code(spark, d):
    return registry.decode(table(spark, d, "products", "product_id", "nomenclature"), "03")


@_add(f"SELECT product_id, code, lpad(CAST(n AS VARCHAR), 2, '0') AS option FROM (SELECT product_id, code, unnest(range(CAST(split_part(option_text, ' to ', 1) AS INTEGER), CAST(split_part(option_text, ' to ', 2) AS INTEGER) + 1)) AS n FROM ({_OPTIONS}) WHERE regexp_full_match(option_text, '\\d+ to \\d+'))")
def code_ranges(spark, d):
    o = registry.options(table(spark, d, "products", "product_id", "nomenclature"))
    return o.select("product_id", "code", F.explode(registry.code_range(F.col("option_text"))).alias("option"))


@_add("SELECT product_id, array_to_string(list_transform(list_sort(list_transform(nomenclature, lambda s: {'pos': s.pos, 'c': CASE WHEN cardinality(s.segment_values) = 1 THEN map_keys(s.segment_values)[1] ELSE rtrim(s.code, '*') END})), lambda x: x.c), '-') AS suggested FROM products WHERE len(nomenclature) > 0")
def suggested_code(spark, d):
    return registry.suggested_code(table(spark, d, "products", "product_id", "nomenclature"))


@_add("SELECT l_orderkey, l_linenumber, l_quantity * 100 AS ppm, l_quantity * 100 / 10000 AS percent_vv, l_quantity * 100 / 10000 * 100 / 4 AS percent_lel, l_quantity * 100 BETWEEN 1000 AND 3000 AS inside FROM lineitem")
def unit_convert(spark, d):
    """Amounts in all units, and whether a range has them."""
    c = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn("c", units.from_ppm(F.col("l_quantity") * 100))
    return c.select("l_orderkey", "l_linenumber", "c.ppm", "c.percent_vv", "c.percent_lel", units.contains(units.from_ppm(F.lit(1000)), units.from_percent_vv(F.lit(0.3)), F.col("c")).alias("inside"))


_LINES = "SELECT doc_id, i, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"
_TITLED = "regexp_matches(line, '^[A-Z][A-Za-z\\-]*( [A-Z][A-Za-z\\-]*)*$') OR (upper(line) = line AND lower(line) <> line)"
_KIND = f"CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 'heading' WHEN regexp_matches(line, '^\\|.*\\|$') THEN 'table' WHEN regexp_matches(line, '^([-*+•]|\\d+[.)])\\s') THEN 'list_item' WHEN length(line) <= 80 AND NOT regexp_matches(line, '[.,;:]$') AND ({_TITLED}) THEN 'heading' ELSE 'paragraph' END"
_BLOCKS = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_index, {_KIND} AS kind, line AS text FROM ({_LINES}) WHERE line <> ''"


@_add(f"SELECT doc_id, block_index, kind, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS section, md5(text) AS text_md5 FROM ({_BLOCKS})")
def running_section(spark, d):
    return cells.lines(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "block_index", "kind", "section", F.md5("text").alias("text_md5"))


@_add(f"SELECT kind, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM ({_BLOCKS}) GROUP BY kind")
def line_blocks(spark, d):
    return cells.lines(table(spark, d, "documents", "doc_id", "text")).groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("doc_id").alias("documents"))


@_add("SELECT t AS table_id, text FROM (SELECT 'nation' AS t, CAST(n_nationkey AS VARCHAR) AS text FROM nation UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'region', r_name FROM region EXCEPT ALL SELECT 'nation', CAST(r_regionkey AS VARCHAR) FROM region)")
def table_coverage(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    raw = n.select(F.lit("nation").alias("table_id"), F.explode(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("text")).unionByName(r.select(F.lit("region").alias("table_id"), F.col("r_name").alias("text")))
    return cells.coverage(raw, r.select(F.lit("nation").alias("table_id"), F.col("r_regionkey").cast("string").alias("text")))


@_add("SELECT DISTINCT id, len(list_filter(string_split(answer, chr(10)), lambda x: regexp_matches(trim(x, ' '), '^\\|.*\\|$') AND NOT regexp_matches(trim(x, ' '), '^\\|[\\s|:\\-]*\\|$'))) AS table_rows FROM feedback WHERE answer IS NOT NULL")
def pipe_tables(spark, d):
    rows = stores.once(table(spark, d, "feedback", "id", "answer", "loaded_at")).filter("answer is not null")
    return rows.select("id", F.size(cells.pipe_rows(F.col("answer"))).alias("table_rows"))


@_add("WITH x AS (SELECT DISTINCT id, answer FROM feedback WHERE answer IS NOT NULL), l AS (SELECT id, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM x), m AS (SELECT id, i, regexp_extract(line, '^\\s*(?:[-*•]|\\d+[.)])\\s+(.*\\S)\\s*$', 1) AS item FROM l), f AS (SELECT id, item, i, row_number() OVER (PARTITION BY id, lower(item) ORDER BY i) AS k FROM m WHERE item <> '') SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS pos, item FROM f WHERE k = 1")
def list_items(spark, d):
    rows = stores.once(table(spark, d, "feedback", "id", "answer", "loaded_at")).filter("answer is not null")
    return rows.select("id", F.posexplode(cells.list_items(F.col("answer"))).alias("at", "item")).select("id", (F.col("at") + 1).alias("pos"), "item")


@_add("WITH s AS (SELECT id, company, CASE WHEN x = '' THEN 'field' ELSE x END AS x FROM (SELECT id, company, trim(regexp_replace(lower(trim(company)), '[^a-z0-9]+', '_', 'g'), '_') AS x FROM deals WHERE company IS NOT NULL)) SELECT id, x || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS slug FROM s WINDOW w AS (PARTITION BY x ORDER BY id)")
def slug_unique(spark, d):
    return stores.unique_slugs(table(spark, d, "deals", "id", "company").filter("company is not null"), "company", "id").select("id", "slug")


# Lines are packed up to 50 words, longer ones cut into windows that end behind a sentence's end among ten more words, and chunks of fewer than
# ten words go in front of the next one: three recursions, over lines, windows and raw chunks.
_ENDS = "regexp_matches(w[{0}], '[.;][''\")\\]]?$')"
_PACKED = f"""
    WITH RECURSIVE l AS (SELECT doc_id, i, list_filter(regexp_split_to_array(line, '[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
    b AS (SELECT doc_id, w, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE len(w) > 0),
    g(doc_id, k, c, open) AS (SELECT doc_id, k, 1, CASE WHEN n > 50 THEN 999 ELSE n END FROM b WHERE k = 1
        UNION ALL SELECT b.doc_id, b.k, g.c + CASE WHEN b.n > 50 OR g.open + b.n > 50 THEN 1 ELSE 0 END, CASE WHEN b.n > 50 THEN 999 WHEN g.open + b.n > 50 THEN b.n ELSE g.open + b.n END FROM g JOIN b ON b.doc_id = g.doc_id AND b.k = g.k + 1),
    p AS (SELECT g.doc_id, g.c, flatten(list(b.w ORDER BY b.k)) AS w FROM g JOIN b ON b.doc_id = g.doc_id AND b.k = g.k GROUP BY g.doc_id, g.c),
    e AS (SELECT doc_id, c, w, len(w) AS n, list_filter(range(1, len(w) + 1), lambda j: {_ENDS.format("j")}) AS ends FROM p WHERE len(w) > 50),
    v(doc_id, c, s, t) AS (SELECT doc_id, c, 0, coalesce(list_min(list_filter(ends, lambda j: j > 50 AND j <= least(60, n))), 50) FROM e
        UNION ALL SELECT e.doc_id, e.c, v.t - 10, CASE WHEN v.t + 40 >= e.n THEN e.n ELSE coalesce(list_min(list_filter(e.ends, lambda j: j > v.t + 40 AND j <= least(v.t + 50, e.n))), v.t + 40) END FROM v JOIN e ON e.doc_id = v.doc_id AND e.c = v.c WHERE v.t < e.n),
    raw AS (SELECT doc_id, c, 0 AS s, w FROM p WHERE len(w) <= 50 UNION ALL SELECT v.doc_id, v.c, v.s, e.w[v.s + 1 : v.t] FROM v JOIN e ON e.doc_id = v.doc_id AND e.c = v.c),
    r AS (SELECT doc_id, w, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS k FROM raw),
    m(doc_id, k, grp, acc) AS (SELECT doc_id, k, 1, n FROM r WHERE k = 1 UNION ALL SELECT r.doc_id, r.k, m.grp + CASE WHEN m.acc >= 10 THEN 1 ELSE 0 END, CASE WHEN m.acc >= 10 THEN r.n ELSE m.acc + r.n END FROM m JOIN r ON r.doc_id = m.doc_id AND r.k = m.k + 1),
    z AS (SELECT doc_id, max(grp) AS last, max_by(acc, k) AS rest FROM m GROUP BY doc_id),
    f AS (SELECT m.doc_id, CASE WHEN m.grp = z.last AND z.rest < 10 AND z.last > 1 THEN m.grp - 1 ELSE m.grp END AS grp, flatten(list(r.w ORDER BY m.k)) AS w FROM m JOIN r ON r.doc_id = m.doc_id AND r.k = m.k JOIN z ON z.doc_id = m.doc_id GROUP BY ALL),
    t AS (SELECT f.doc_id, CAST(grp - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY f.doc_id) AS INTEGER) AS total_chunks, CASE WHEN trim(d.title) <> '' THEN d.title || ': ' ELSE '' END || array_to_string(w, ' ') AS text FROM f JOIN documents d ON d.doc_id = f.doc_id)
    SELECT doc_id, chunk_index, total_chunks, sha256(text) AS chunk_id, text FROM t"""


@_add(_PACKED)
def chunk_pack(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents", "doc_id", "text", "title"))


#: The words of the test tables' products, where they differ from the vocabularies of the registry.
TABLE_VOCABULARY = {"product_type": ["Leak Detector", "Area Monitor", "Analyser"], "install_type": ["Portable", "Fixed"], "technology": ["thermal conductivity", "catalytic bead", "solid state"]}
TABLE_ALIASES = {"TCD": "thermal conductivity", "pellistor": "catalytic bead"}


def _dispatch_sql(source: str) -> str:
    """The rules over ``source(id, question)`` in SQL, told from padded words instead of patterns with borders."""
    terms = [("technology", k, TABLE_ALIASES[k], "true") for k in sorted(TABLE_ALIASES, key=lambda k: -len(k))]
    terms += [(f, t, t, "false") for f, ts in TABLE_VOCABULARY.items() for t in sorted(ts, key=lambda t: -len(t))]
    values = ", ".join(f"({k}, '{f}', '{t.lower()}', '{v}', {w})" for k, (f, t, v, w) in enumerate(terms))
    word = "[a-z0-9_]+"
    return f"""
        WITH q AS ({source}),
        s AS (SELECT id, lower(coalesce(question, '')) AS l, regexp_replace(' ' || regexp_replace(lower(coalesce(question, '')), '[^\\p{{L}}\\p{{N}}_\\s]+', ' | ', 'g') || ' ', '\\s+', ' ', 'g') AS p FROM q),
        w AS (SELECT id, l, p,
            contains(p, ' list all ') OR regexp_matches(p, ' show (all )?((portable|fixed) ?)?products ') OR regexp_matches(p, ' what products (do you|does {word}) (offer|have|sell|make|provide|carry) ') AS enumerates,
            regexp_matches(p, ' (which|what) (products|sensors|detectors|devices|analyzers|units) ') AS which_products, regexp_matches(p, ' (tell me|know|information|info) about ') AS about,
            regexp_matches(p, ' (list|show) ') AS listing, regexp_matches(p, ' the ({word} ){{0,2}}(product|device|unit|sensor|detector|instrument|system|analyzer) ') AS the_one,
            regexp_matches(p, ' (vs|versus|compare|compared|compares|comparison|difference between) ') AS compares, regexp_matches(p, ' (our|ours|we|us|the company) ') AS own FROM s),
        v(ord, field, term, value, whole) AS (VALUES {values}),
        f AS (SELECT s.id, v.field, v.value, min(v.ord) AS ord FROM s JOIN v ON CASE WHEN v.whole THEN contains(s.p, ' ' || v.term || ' ') ELSE contains(s.l, v.term) END GROUP BY ALL),
        a AS (SELECT DISTINCT product_id, product_name, lower(trim(unnest(list_append(coalesce(aliases, []), product_name)))) AS alias FROM products),
        hit AS (SELECT s.id, a.product_id, a.product_name, a.alias FROM s JOIN a ON a.alias <> '' AND contains(s.l, a.alias) AND regexp_matches(s.l, '(^|[^a-z0-9])' || regexp_escape(a.alias) || '($|[^a-z0-9])')),
        best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY id, product_id ORDER BY length(alias) DESC, alias) = 1),
        named AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o WHERE o.id = b.id AND o.alias <> b.alias AND contains(o.alias, b.alias))),
        n AS (SELECT id, count(*) AS n FROM named GROUP BY id),
        family AS (SELECT id, alias FROM named GROUP BY id, alias HAVING count(*) > 1),
        o AS (SELECT product_id, lower(unnest(map_keys(x.segment_values))) AS code FROM (SELECT product_id, unnest(nomenclature) AS x FROM products)),
        decoded AS (SELECT DISTINCT named.id FROM named JOIN n ON n.id = named.id AND n.n = 1 JOIN o ON o.product_id = named.product_id AND o.code = regexp_extract(named.alias, ' ([^ ]+)$', 1)),
        fit AS (SELECT f.id, f.ord, p.product_name FROM f JOIN products p ON CASE f.field WHEN 'technology' THEN contains(lower(p.technology), lower(f.value)) WHEN 'product_type' THEN p.product_type = f.value ELSE p.install_type = f.value END),
        g AS (SELECT fit.id, fit.product_name FROM fit JOIN (SELECT id, min(ord) AS ord FROM f GROUP BY id) m ON m.id = fit.id AND m.ord = fit.ord),
        t AS (SELECT w.*, coalesce(n.n, 0) AS n, w.id IN (SELECT id FROM f) AS filtered, w.id IN (SELECT id FROM family) AS shared, w.id IN (SELECT id FROM decoded) AS codes, w.id IN (SELECT id FROM g) AS fits FROM w LEFT JOIN n ON n.id = w.id),
        u AS (SELECT *, enumerates OR (filtered AND (which_products OR about OR listing)) AS lists FROM t),
        r AS (SELECT id, own, filtered, CASE WHEN n = 1 AND codes THEN 'decode' WHEN n = 1 AND NOT (enumerates OR which_products) AND NOT compares THEN 'one_product' WHEN n >= 2 AND lists AND shared THEN 'family_list' WHEN n >= 2 AND NOT lists THEN 'several_products'
            WHEN lists THEN 'catalog' WHEN n = 0 AND the_one AND fits THEN 'attribute' WHEN n = 0 THEN 'whole_catalog' ELSE 'search' END AS rule FROM u),
        c AS (SELECT r.id, named.product_name FROM r JOIN named ON named.id = r.id WHERE rule IN ('decode', 'one_product', 'several_products')
            UNION SELECT r.id, named.product_name FROM r JOIN family ON family.id = r.id JOIN named ON named.id = r.id AND named.alias = family.alias WHERE rule = 'family_list'
            UNION SELECT r.id, g.product_name FROM r JOIN g ON g.id = r.id WHERE rule = 'attribute' UNION SELECT r.id, fit.product_name FROM r JOIN fit ON fit.id = r.id WHERE rule = 'catalog' AND filtered
            UNION SELECT r.id, product_name FROM r, products WHERE rule = 'whole_catalog' OR (rule = 'catalog' AND NOT filtered))
        SELECT r.id, r.rule, CASE WHEN r.rule IN ('decode', 'family_list', 'catalog') THEN 'direct' WHEN r.rule = 'search' THEN 'search' ELSE 'scoped' END AS kind, coalesce(x.names, '') AS products,
            r.rule IN ('one_product', 'several_products', 'attribute') OR (r.rule = 'whole_catalog' AND r.own) AS exclude_references FROM r LEFT JOIN (SELECT id, string_agg(product_name, ', ' ORDER BY product_name) AS names FROM c GROUP BY id) x ON x.id = r.id"""


def _dispatched(questions: DataFrame, products: DataFrame, fuzzy: bool = False) -> DataFrame:
    out = dispatching.dispatch(questions, "id", "question", products, TABLE_VOCABULARY, TABLE_ALIASES, fuzzy)
    return out.select("id", "kind", "rule", F.array_join("products", ", ").alias("products"), "exclude_references")


@_add(_dispatch_sql("SELECT DISTINCT id, question FROM feedback"))
def question_dispatch(spark, d):
    """Every question, with names as they are written."""
    return _dispatched(table(spark, d, "feedback", "id", "question"), table(spark, d, "products"))


@_add(_dispatch_sql("SELECT row_id AS id, text AS question FROM chunks"))
def text_dispatch(spark, d):
    """Texts that name products, asked as questions."""
    return _dispatched(table(spark, d, "chunks").select(F.col("row_id").alias("id"), F.col("text").alias("question")), table(spark, d, "products"))


@_add()
def question_dispatch_near(spark, d):
    """Every question, with names nearly written, and the answers given at once."""
    return dispatching.dispatch(table(spark, d, "feedback", "id", "question"), "id", "question", table(spark, d, "products"), TABLE_VOCABULARY, TABLE_ALIASES)


@_add("SELECT document_name, regexp_replace(document_name, '\\.[^.]*$', '') AS title, count(*) AS chunks, max(total_chunks) AS declared, count(DISTINCT section_heading) AS sections FROM chunks WHERE document_name IS NOT NULL GROUP BY 1, 2")
def document_titles(spark, d):
    rows = table(spark, d, "chunks", "document_name", "total_chunks", "section_heading").filter("document_name is not null")
    return rows.groupBy("document_name", F.regexp_replace("document_name", r"\.[^.]*$", "").alias("title")).agg(F.count(F.lit(1)).alias("chunks"), F.max("total_chunks").alias("declared"), F.count_distinct("section_heading").alias("sections"))


@_add("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_daily(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_HEADINGS = "SELECT DISTINCT document_name, chunk_index AS pos, section_heading AS heading FROM chunks WHERE document_name IS NOT NULL AND chunk_index IS NOT NULL"


@_add(f"WITH h AS ({_HEADINGS}), s AS (SELECT * FROM h WHERE trim(heading) <> ''), c AS (SELECT pos, heading FROM s GROUP BY 1, 2 HAVING count(DISTINCT document_name) = 1), o AS (SELECT document_name, min(pos) AS first FROM s JOIN c USING (pos, heading) GROUP BY 1), w AS (SELECT o.document_name, count(*) AS names FROM o JOIN s ON s.document_name = o.document_name AND s.pos = o.first JOIN c ON c.pos = s.pos AND c.heading = s.heading GROUP BY 1) SELECT h.document_name, coalesce(o.first, -1) AS first_own FROM (SELECT DISTINCT document_name FROM h) h LEFT JOIN o USING (document_name)")
def heading_owner(spark, d):
    said = table(spark, d, "chunks", "document_name", "chunk_index", "section_heading").filter("document_name is not null and chunk_index is not null").distinct()
    s = said.filter("trim(section_heading) <> ''")
    alone = s.groupBy("chunk_index", "section_heading").agg(F.count_distinct("document_name").alias("n")).filter("n = 1").drop("n")
    own = s.join(alone, ["chunk_index", "section_heading"], "left_semi").groupBy("document_name").agg(F.min("chunk_index").alias("first"))
    return said.select("document_name").distinct().join(own, "document_name", "left").select("document_name", F.coalesce("first", F.lit(-1)).alias("first_own"))


@_add(f"WITH h AS (SELECT DISTINCT document_name, chunk_index AS pos, section_heading AS heading FROM chunks WHERE document_name IS NOT NULL), f AS (SELECT document_name, list_filter(regexp_extract_all(lower(regexp_replace(document_name, '\\.[^.]*$', '')), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({sorted(naming.PLAIN_WORDS)}, t)) AS words FROM (SELECT DISTINCT document_name FROM h)), s AS (SELECT h.document_name, heading, row_number() OVER (PARTITION BY h.document_name ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(heading), '[a-z0-9]+')), words)) DESC, pos, heading) AS pos FROM h JOIN f ON f.document_name = h.document_name WHERE trim(heading) <> ''), c AS (SELECT pos, heading FROM s GROUP BY 1, 2 HAVING count(DISTINCT document_name) = 1), o AS (SELECT document_name, s.heading, row_number() OVER (PARTITION BY document_name ORDER BY s.pos) AS k FROM s JOIN c ON c.pos = s.pos AND c.heading = s.heading), l AS (SELECT document_name, heading, row_number() OVER (PARTITION BY document_name ORDER BY pos DESC) AS k FROM s) SELECT d.document_name, coalesce(o.heading, l.heading, regexp_replace(d.document_name, '\\.[^.]*$', '')) AS product_name FROM f d LEFT JOIN o ON o.document_name = d.document_name AND o.k = 1 LEFT JOIN l ON l.document_name = d.document_name AND l.k = 1")
def product_names(spark, d):
    return naming.assign_names(table(spark, d, "chunks").select("document_name", F.col("chunk_index").alias("pos"), F.col("section_heading").alias("heading")).filter("document_name is not null"))


@_add("WITH n AS (SELECT DISTINCT product_name, lower(trim(regexp_replace(product_name, '\\s+XX\\*?\\s*$', ''))) AS plain FROM chunks WHERE product_name IS NOT NULL) SELECT n.product_name, p.product_id FROM n LEFT JOIN (SELECT lower(product_name) AS plain, min(product_id) AS product_id FROM products GROUP BY 1) p USING (plain)")
def display_names(spark, d):
    return naming.known_products(table(spark, d, "chunks", "product_name"), table(spark, d, "products", "product_id", "product_name"))


def retrieval_sql(questions: str) -> str:
    """The ranking of ``pipeline.retrieve`` over ``questions(id, question)`` in SQL."""
    return f"""
    WITH x AS (SELECT min(row_id) AS row_id, arg_min(text, row_id) AS text, arg_min(document_name, row_id) AS document_name, arg_min(product_name, row_id) AS product_name FROM chunks WHERE {_SOUND} GROUP BY sha256(text)),
    q AS ({questions}),
    t AS (SELECT 'c' AS side, row_id AS id, text FROM x UNION ALL SELECT 'q', id, question FROM q),
    w AS (SELECT side, id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS h FROM t),
    e AS (SELECT side, id, CAST('0x' || h[1:8] AS BIGINT) % {pipeline.DIMENSIONS} AS place, sum(CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL),
    f AS (SELECT side, id, place, CAST(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY side, id)), 1e-12) AS FLOAT)::DOUBLE AS v FROM e),
    g AS (SELECT side, id, place, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY side, id)), 1e-300) AS v FROM f),
    sims AS (SELECT a.id AS query_id, b.id AS row_id, round(sum(a.v * b.v), 5) AS sim FROM g a JOIN g b ON a.place = b.place WHERE a.side = 'q' AND b.side = 'c' GROUP BY ALL),
    s AS (SELECT sims.*, x.text, x.document_name, x.product_name FROM sims JOIN x USING (row_id)),
    names AS (SELECT DISTINCT product_name FROM x WHERE product_name IS NOT NULL),
    tokens AS (SELECT DISTINCT product_name, token FROM (SELECT product_name, unnest(regexp_extract_all(lower(product_name), '[a-z0-9]+')) AS token FROM names) WHERE NOT list_contains({STOPWORDS}, token)),
    telling AS (SELECT token FROM tokens GROUP BY token HAVING count(*) <= greatest(2, (SELECT count(DISTINCT product_name) FROM tokens) // 3)),
    named AS (SELECT DISTINCT k.id, tokens.product_name FROM (SELECT id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM q) k JOIN telling USING (token) JOIN tokens USING (token) WHERE length(token) >= 3),
    n AS (SELECT id, count(*) AS names FROM named GROUP BY id),
    u AS (SELECT q.id, n.names, regexp_matches(lower(question), '\\ball\\b.{{0,20}}\\b(product|sensor|detector|device|analyzer|unit)s?\\b|\\blist\\b.{{0,20}}\\b(product|sensor|detector|device|analyzer|unit)s?\\b|\\b(product|sensor|detector|device|analyzer|unit)s?\\s+(lineup|line-up|catalog|catalogue|range|portfolio)\\b|\\bwhat\\b.{{0,10}}\\b(product|sensor|detector|device|analyzer|unit)s?\\b.{{0,15}}\\b(available|offer|have|sell|make)\\b') AS lists,
        list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda k: length(k) >= 3 AND NOT list_contains({STOPWORDS}, k)) AS words FROM q LEFT JOIN n ON n.id = q.id),
    searches AS (SELECT u.id, 'main' AS part, named.product_name AS product, CASE WHEN names = 1 THEN 8 ELSE greatest(10, 8 // names) END AS n, words FROM u JOIN named ON named.id = u.id WHERE NOT lists
        UNION ALL SELECT id, CASE WHEN names IS NULL THEN 'main' ELSE 'more' END, NULL, 8, words FROM u WHERE NOT lists),
    found AS (SELECT c.part, c.product, c.n, s.*, list_bool_or(list_transform(c.words, lambda k: contains(lower(s.text), k))) AS by_word FROM searches c JOIN s ON s.query_id = c.id AND (c.product IS NULL OR c.product = s.product_name)),
    best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id, part, product ORDER BY sim DESC, row_id) <= n),
    first AS (SELECT query_id, row_id, sim, product FROM best WHERE part = 'main'),
    extra AS (SELECT query_id, row_id, sim, product FROM found WHERE part = 'main' AND by_word AND (query_id, row_id) NOT IN (SELECT (query_id, row_id) FROM first) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) <= 3),
    scoped AS (SELECT * FROM first UNION ALL SELECT * FROM extra),
    whole AS (SELECT query_id, row_id, sim, 0 AS part, row_number() OVER (PARTITION BY query_id, product ORDER BY sim DESC, row_id) AS turn, product AS name FROM scoped
        UNION ALL SELECT query_id, row_id, sim, 1, 0, NULL FROM best WHERE part = 'more' AND (query_id, row_id) NOT IN (SELECT (query_id, row_id) FROM scoped)
        UNION ALL SELECT query_id, row_id, sim, 0, 0, document_name FROM (SELECT s.* FROM s JOIN u ON u.id = s.query_id AND u.lists QUALIFY row_number() OVER (PARTITION BY query_id, document_name ORDER BY sim DESC, row_id) = 1)),
    ranked AS (SELECT query_id, row_id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, turn, name NULLS FIRST, sim DESC, row_id) AS INTEGER) AS rank, max(sim) OVER (PARTITION BY query_id) AS top FROM whole)
    SELECT query_id, row_id, sim, rank, CASE WHEN top < 0.56 THEN 'low' ELSE 'high' END AS confidence FROM ranked WHERE top >= 0.32"""


_RETRIEVAL = retrieval_sql("SELECT DISTINCT id, question FROM feedback WHERE id % 50 = 0 AND trim(question) <> ''")


@_add(_RETRIEVAL)
def retrieve_chunks(spark, d):
    index = pipeline.build_index(table(spark, d, "chunks"))
    asked = table(spark, d, "feedback", "id", "question").filter("id % 50 = 0").distinct()  # the stated query set
    return pipeline.retrieve(index, asked)


_DRAFTS = f"""
    WITH r AS ({_RETRIEVAL}), j AS (SELECT r.*, chunks.text, chunks.document_name FROM r JOIN chunks USING (row_id)),
    g AS (SELECT query_id, any_value(confidence) AS confidence, arg_min(text, rank) AS text, arg_min(document_name, rank) AS document_name, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS sources FROM j GROUP BY query_id),
    near AS (SELECT query_id, text, document_name FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rank) = 1),
    u AS (SELECT DISTINCT id, question, regexp_matches(lower(question), '\\b(all|list)\\b.{{0,20}}\\b(product|sensor|detector|device|analyzer|unit)s?\\b|\\b(product|sensor|detector|device|analyzer|unit)s?\\s+(lineup|line-up|catalog|catalogue|range|portfolio)\\b') AS lists FROM feedback WHERE id % 50 = 0),
    t AS (SELECT u.id, u.question, coalesce(g.confidence, 'none') AS confidence, CASE WHEN lists THEN near.text ELSE g.text END AS text, CASE WHEN lists THEN near.document_name ELSE g.document_name END AS source, coalesce(g.sources, '') AS sources FROM u LEFT JOIN g ON g.query_id = u.id LEFT JOIN near ON near.query_id = u.id)
    SELECT *, CASE WHEN text IS NULL THEN '{pipeline.NO_SOURCE}' WHEN regexp_extract(text, '^(.*?[.!?])(?:\\s|$)', 1) = '' THEN text ELSE regexp_extract(text, '^(.*?[.!?])(?:\\s|$)', 1) END AS answer FROM t"""


@_add(f"""WITH d AS ({_DRAFTS}), c AS ({_claims_sql(f"SELECT id, {_PLAIN.format('question')} AS q, {_PLAIN.format('answer')} AS a, {_PLAIN.format('sources')} AS s FROM d")}),
    i AS (SELECT id, CASE {_INTENT} ELSE 'unknown' END AS intent FROM (SELECT id, {_PLAIN.format('question')} AS q FROM d))
    SELECT d.id, i.intent, d.confidence, d.source, CASE WHEN c.blocked THEN '{pipeline.BLOCKED}' ELSE d.answer END AS answer, c.category, c.blocked FROM d JOIN c ON c.id = d.id JOIN i ON i.id = d.id""")
def answers(spark, d):
    index = pipeline.build_index(table(spark, d, "chunks"))
    asked = table(spark, d, "feedback", "id", "question").filter("id % 50 = 0").distinct()  # the stated query set
    return pipeline.answer(index, asked)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

