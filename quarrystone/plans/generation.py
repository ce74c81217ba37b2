"""Generated texts for tables of requests: discoveries, recommendations, qualifications, sales aids, and answers routed by rules.

Each is retrieval, one message a request, a model, and the reading of its reply, all as one batch. A model is a function of a list of messages, passed in and run where
the rows are; the default ones quote the excerpts in the form that the readers expect, so that everything runs offline and gives the same each time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators import answers, dispatch, guard, replies, saved, settings, stores
from quarrystone.plans import pipeline
from quarrystone.plans.pipeline import NO_SOURCE, Embedder, hashed
from quarrystone.session import materialise

Model = Callable[[list[str]], list[str]]
#: Chunks of a discovery, a recommendation, a qualification and a sales aid; answers a recommendation needs.
K_DISCOVERY, K_ADVICE, K_QUALIFY, K_AID, LEAST_ANSWERS = 8, 15, 6, 12, 2
#: What to ask for a field that the model says nothing of.
DEFAULT_QUESTIONS = {f: f"What can you say of the {f.replace('_', ' ')}?" for f in stores.ASKED}


def generate(messages: DataFrame, model: Model) -> DataFrame:
    """``(id, reply)`` of messages ``(id, message)``, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(batch.column(1).to_pylist()), pa.string())], ["id", "reply"])

    return messages.select(F.col("id").cast("bigint").alias("id"), "message").mapInArrow(run, "id bigint, reply string")


def pieces(texts: DataFrame, size: int = 24) -> DataFrame:
    """``(stream_id, seq, delta, last)``: replies ``(id, reply)`` as a model sends them, piece by piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length("reply") / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring("reply", (k - 1) * size + 1, F.lit(size)))
    each = texts.select(F.col("id").cast("string").alias("stream_id"), n.alias("n"), F.posexplode(parts).alias("seq", "delta"))
    return each.select("stream_id", "seq", "delta", (F.col("seq") + 1 == F.col("n")).alias("last"))


def _excerpt(message: str) -> tuple[str, str]:
    """The name and the first sentence of a message's first excerpt."""
    m = re.search(r"^\[\d+\] (.*?)(?: \([^()\n]*\))?:\n(.*?(?:[.!?](?=\s|$)|$))", message, re.M | re.S)
    return (m[1], " ".join(m[2].split())[:300]) if m else ("nothing", "No excerpt.")


def quoted_points(messages: list[str]) -> list[str]:
    return [f"Right to Win: {n}\nWhy It Matters: {s}\nEvidence: {s}\nQuestions:\n- What does {n} have to do?\n" for n, s in map(_excerpt, messages)]


def quoted_advice(messages: list[str]) -> list[str]:
    return [f"Confirmed Priorities:\n- {s}\n\nOutcome:\nRecommend\n\nProduct:\n{n}\n\nRecommendation:\n{s}\n\nMissing Information:\nnone\n" for n, s in map(_excerpt, messages)]


def quoted_questions(messages: list[str]) -> list[str]:
    return [f"Field: {(re.search(r'^Missing: (.*?)(?:,|$)', m, re.M) or [None, 'none'])[1]}\nQuestion: {_excerpt(m)[1]}\n" for m in messages]


def quoted_aid(messages: list[str]) -> list[str]:
    return [f"Customer Priorities:\n- {s}\nTitle:\n{n}\nUse Case Framing:\n{s}\nComparison:\n| Topic | Own | Other |\n|---|---|---|\n| {n} | yes | no |\nCustomer Summary:\n{s}\n" for n, s in map(_excerpt, messages)]


def quoted_wording(messages: list[str]) -> list[str]:
    return [m.rpartition("Internal answer:\n")[2] or "n/a" for m in messages]


def _found(index: DataFrame, asked: DataFrame, k: int, embedder: Embedder, named: DataFrame | None = None) -> DataFrame:
    """The matches ``(query_id, rank, sim, confidence, document_name, product_name, text, ...)`` of questions ``(id, question)``."""
    best = pipeline.retrieve(index, asked, k, embedder, named=named)
    kept = [c for c in ("section_heading", "page_number", "slide_number") if c in index.columns]
    return materialise(best.join(index.select("row_id", "document_name", "product_name", "text", *kept), "row_id"), "matches")


def _messages(asked: DataFrame, matches: DataFrame, *parts) -> DataFrame:
    """``(id, message)``: the excerpts of a request, then its parts."""
    told = settings.context(matches).withColumnRenamed("query_id", "id")
    return asked.join(told, "id", "left").select("id", F.concat(F.lit(answers.EXCERPTS), F.coalesce("context", F.lit(answers.NO_EXCERPTS)), *parts).alias("message"))


def _guarded(rows: DataFrame, matches: DataFrame, question: str, text: str) -> DataFrame:
    """Adds category and blocked: restricted claims that the matches' texts do not bear out."""
    proof = answers.guard_source_text(matches).withColumnRenamed("query_id", "id")
    return guard.check_claims(rows.join(proof, "id", "left").withColumn("source", F.coalesce("source", F.lit(""))), question, text, "source").drop("source", "matched", "unsupported")


def _sources(matches: DataFrame) -> DataFrame:
    """``(id, sources)``: the documents of a request's matches."""
    return matches.groupBy("query_id").agg(F.array_sort(F.collect_set("document_name")).alias("sources")).withColumnRenamed("query_id", "id")


def discoveries(index: DataFrame, uses: DataFrame, model: Model = quoted_points, embedder: Embedder = hashed) -> DataFrame:
    """``(id, pos, title, why, evidence, questions, sources)``: the points of every use case ``(id, use_case)``."""
    asked = uses.select("id", F.col("use_case").alias("question"))
    matches = _found(index, asked, K_DISCOVERY, embedder)
    made = generate(_messages(asked, matches, F.lit("\n\nCustomer use case: "), F.coalesce("question", F.lit(""))), model)
    return replies.parse_points(made, "id", "reply").join(_sources(matches), "id", "left")


def recommendations(index: DataFrame, uses: DataFrame, given: DataFrame, types: DataFrame, model: Model = quoted_advice, embedder: Embedder = hashed) -> DataFrame:
    """``(id, outcome, product, priorities, recommendation, missing, category, sources)`` of use cases with answers ``given(id, question, answer)``.

    Only catalogues, by ``types(document_name, doc_type)``, may be recommended. With fewer than ``LEAST_ANSWERS`` answers that say something there is no model asked and
    the outcome is Insufficient.
    """
    said = given.filter("trim(answer) <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("question", F.trim("answer").alias("answer")))).alias("qa"))
    all_ = uses.join(said, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ready = all_.filter(F.col("n") >= LEAST_ANSWERS)
    block = F.array_join(F.transform("qa", lambda x: F.concat(F.lit("Q: "), x["question"], F.lit("\nA: "), x["answer"])), "\n")
    asked = ready.select("id", F.concat(F.coalesce("use_case", F.lit("")), F.lit(" "), F.array_join(F.transform("qa", lambda x: x["answer"]), " ")).alias("question"), F.coalesce("use_case", F.lit("")).alias("use_case"), block.alias("block"))
    matches = _found(settings.catalogues(index, types), asked.select("id", "question"), K_ADVICE, embedder)
    made = generate(_messages(asked, matches, F.lit("\n\nOriginal use case: "), "use_case", F.lit("\n\nCustomer's discovery call answers:\n"), "block"), model)
    read = _guarded(replies.parse_advice(made, "id", "reply").join(asked.select("id", "block"), "id"), matches, "block", "recommendation").join(_sources(matches), "id", "left")
    cols = ["id", "outcome", "product", "priorities", "recommendation", "missing", "category", "sources"]
    none = F.array().cast("array<string>")
    few = F.concat(F.lit(f"At least {LEAST_ANSWERS} discovery questions need an answer; "), F.col("n").cast("string"), F.lit(" have one."))
    wanting = all_.filter(F.col("n") < LEAST_ANSWERS).select("id", F.lit("Insufficient").alias("outcome"), F.lit("").alias("product"), none.alias("priorities"), F.lit("There are too few answers for a recommendation.").alias("recommendation"), few.alias("missing"), F.lit(None).cast("string").alias("category"), none.alias("sources"))
    return read.select(*cols).unionByName(wanting.select(*cols))


def qualifications(index: DataFrame, deals: DataFrame, types: DataFrame, model: Model = quoted_questions, embedder: Embedder = hashed, limit: int = 3) -> DataFrame:
    """``(id, field, question)``: the next questions of deals on their blank fields, out of the documents on methods; deals with nothing blank have none."""
    blank = stores.missing_fields(deals, limit).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "field"))).alias("f")).select("id", F.transform("f", lambda x: x["field"]).alias("fields"))
    asked = deals.select("id", "use_case").join(blank, "id").select("id", F.concat(F.array_join("fields", ", "), F.lit(" "), F.coalesce("use_case", F.lit(""))).alias("question"), "fields")
    methods = index.join(types.filter(F.col("doc_type") == settings.METHODS).select("document_name"), "document_name", "left_semi")
    matches = _found(methods, asked.select("id", "question"), K_QUALIFY, embedder)
    made = generate(_messages(asked, matches, F.lit("\n\nMissing: "), F.array_join("fields", ", ")), model)
    every = replies.parse_questions(made, "id", "reply", list(DEFAULT_QUESTIONS.items())).select("id", F.explode(F.arrays_zip("fields", "questions")).alias("x")).select("id", F.col("x.fields").alias("field"), F.col("x.questions").alias("question"))
    return every.join(blank.select("id", F.explode("fields").alias("field")), ["id", "field"]).select("id", "field", "question")


def sales_aids(index: DataFrame, uses: DataFrame, others: DataFrame, model: Model = quoted_aid, embedder: Embedder = hashed) -> DataFrame:
    """``(id, title, priorities, rows, summary, ready, category, sources)`` of use cases ``(id, use_case, compare_against)``.

    Own documents and those of ``others(document_name)`` are searched apart, each for half of the excerpts, so that neither side takes all.
    """
    against = F.trim(F.coalesce("compare_against", F.lit("")))
    asked = uses.select("id", F.when(against != "", F.concat("use_case", F.lit(" compared to "), against)).otherwise(F.col("use_case")).alias("question"), F.coalesce("use_case", F.lit("")).alias("use_case"), against.alias("against"))
    half = max(K_AID // 2, 4)
    nobody = asked.sparkSession.createDataFrame([], "id bigint, product_name string")
    own = _found(index.join(others.select("document_name").distinct(), "document_name", "left_anti"), asked.select("id", "question"), half, embedder, nobody)
    other = _found(index.join(others.select("document_name").distinct(), "document_name", "left_semi"), asked.select("id", "question"), half, embedder, nobody)
    matches = own.unionByName(other.withColumn("rank", F.col("rank") + 1000))
    line = F.when(F.col("against") != "", F.concat(F.lit("Compare with: "), "against")).otherwise(F.lit("Compare with whatever the excerpts have."))
    made = generate(_messages(asked, matches, F.lit("\n\n"), line, F.lit("\n\nCustomer use case: "), "use_case"), model)
    read = replies.parse_aids(made, "id", "reply")
    text = F.concat_ws("\n", "title", "framing", F.array_join(F.flatten("table"), "\n"), "summary")
    checked = _guarded(read.withColumn("text", text).join(asked.select("id", "use_case"), "id"), matches, "use_case", "text")
    return checked.select("id", "title", "priorities", F.greatest(F.size("table") - 1, F.lit(0)).alias("rows"), "summary", (~F.col("blocked")).alias("ready"), "category").join(_sources(matches), "id", "left")


def wordings(drafts: DataFrame, model: Model = quoted_wording) -> DataFrame:
    """``(id, wording)``: customer wordings of answers ``(id, question, answer, blocked)``; null where one is blocked or the model declines."""
    free = drafts.filter(~F.coalesce("blocked", F.lit(False)))
    made = generate(free.select("id", F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\n\nInternal answer:\n"), F.coalesce("answer", F.lit(""))).alias("message")), model)
    said = F.when(~F.lower(F.trim("reply")).rlike(r"^(?:not requested|n/?a|none|omit(?:ted)?)\s*(?:[.:\-–]|$)") & (F.trim("reply") != ""), F.trim("reply"))
    return drafts.select("id").join(made.select("id", said.alias("wording")), "id", "left")


def answer_questions(index: DataFrame, questions: DataFrame, products: DataFrame, k: int = 8, embedder: Embedder = hashed, vocabulary: dict[str, list[str]] = dispatch.VOCABULARY, aliases: dict[str, str] | None = None) -> DataFrame:
    """``(id, kind, rule, source, confidence, answer, category, blocked)``: every question by the dispatcher's rule, else by retrieval in its scope.

    Questions answered at once have their catalogues as source. Scoped ones are searched among the products of their scope, and the ordering configuration of
    these stands behind what was found; confidence is told before. An answer with an address that no source has is none.
    """
    q = questions.groupBy("id").agg(F.first("question", ignorenulls=True).alias("question"))
    routed = materialise(dispatch.dispatch(q, "id", "question", products, vocabulary, dispatch.registry.TECHNOLOGY_ALIASES if aliases is None else aliases), "routed")
    scope = routed.filter(F.col("rule").isin("one_product", "several_products", "attribute")).select("id", F.explode("products").alias("product_name"))
    open_ = q.join(routed.filter("kind <> 'direct'").select("id"), "id", "left_semi")
    matches = _found(index, open_, k, embedder, scope)
    noted = answers.with_notes(matches, scope.select(F.col("id").alias("query_id"), "product_name"), answers.nomenclature_notes(products))
    proof = answers.guard_source_text(noted).withColumnRenamed("query_id", "id")
    top = matches.groupBy("query_id").agg(F.first("confidence").alias("confidence"), F.min_by(F.struct("document_name", "text"), "rank").alias("top")).withColumnRenamed("query_id", "id")
    drafted = q.join(routed.select("id", "kind", "rule", "catalogues", F.col("answer").alias("direct")), "id").join(top, "id", "left").join(proof, "id", "left")
    reply = F.coalesce("direct", F.when(F.regexp_extract("top.text", r"^(.*?[.!?])(?:\s|$)", 1) != "", F.regexp_extract("top.text", r"^(.*?[.!?])(?:\s|$)", 1)), "top.text", F.lit(NO_SOURCE))
    drafted = drafted.withColumn("source_text", F.coalesce("source", F.col("direct"), F.lit(""))).withColumn("draft", reply)
    grounded = F.when(F.size(guard.ungrounded_addresses(F.col("draft"), F.col("source_text"))) > 0, F.lit(NO_SOURCE)).otherwise(F.col("draft"))
    kept = drafted.withColumn("draft", grounded).select("id", "kind", "rule", "question", "source_text", "draft", F.coalesce(F.array_join(F.when(F.col("kind") == "direct", F.col("catalogues")), ", "), "top.document_name").alias("source"), F.when(F.col("kind") == "direct", "high").otherwise(F.coalesce("confidence", F.lit("none"))).alias("found"))
    checked = guard.check_claims(kept, "question", "draft", "source_text")
    return checked.select("id", "kind", "rule", "source", answers.shown_confidence(F.col("found"), F.col("draft") == NO_SOURCE).alias("confidence"), F.col("draft").alias("answer"), "category", "blocked")


def save_generated(deals: DataFrame, made: DataFrame, column: str) -> DataFrame:
    """Deals with what was generated for them, as JSON of all its columns but the id; see ``saved.save_json``."""
    whole = made.groupBy("id").agg(F.collect_list(F.struct(*[c for c in made.columns if c != "id"])).alias("value"))  # the few rows of one deal
    return saved.save_json(deals, whole, column)
