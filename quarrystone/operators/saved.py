"""Results saved with deals, stored documents, and copies of whole stores. Changes return the new table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.stores import ASKED, upsert
from quarrystone.sources.docx_writer import docx_files

#: What a saved recommendation and a saved question hold.
RECOMMENDATION = "confirmed_priorities array<string>, outcome string, product string, candidate_products array<string>, recommendation string, missing_information string"
QUESTION = "field_key string, field_label string, question string, rationale string"


def save_json(deals: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """Deals with ``results(id, value)`` as JSON in a column; deals without a result keep theirs, results of no deal are left out."""
    made = results.select("id", F.to_json("value").alias("_new"))
    return deals.join(made, "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def saved(deals: DataFrame, column: str, schema: str) -> DataFrame:
    """``(id, value)`` of the deals whose column holds JSON of a form; broken and empty texts are left out."""
    return deals.select("id", F.from_json(column, schema).alias("value")).filter("value is not null")


def saved_questions(deals: DataFrame, column: str = "last_qualification") -> DataFrame:
    """``(id, pos, field_key, field_label, question, rationale)``: saved questions on fields that are still blank, in their order.

    A field answered since is asked no more, though the saved text still has it.
    """
    asked = saved(deals.select("id", column), column, f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in QUESTION.split(', '))}>>")
    blank = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f)) for f in ASKED]))
    still = deals.select("id", blank.alias("blank"))
    rows = asked.select("id", F.posexplode("value").alias("pos", "q")).join(still, "id").filter(F.array_contains("blank", F.col("q.field_key")))
    return rows.select("id", "pos", "q.field_key", "q.field_label", "q.question", "q.rationale")


def answered(answers: Column, question: str, answer: str) -> Column:
    """A map of answers with one more; the answer given last to a question stands."""
    kept = F.map_filter(F.coalesce(answers, F.create_map().cast("map<string,string>")), lambda k, _: k != F.lit(question))
    return F.map_concat(kept, F.create_map(F.lit(question), F.lit(answer)))


def question_answers(deals: DataFrame, column: str = "last_discovery") -> DataFrame:
    """``(id, question, answer)`` of the answers saved beside a discovery; blank ones are none yet."""
    found = deals.select("id", F.explode(F.from_json(F.get_json_object(column, "$.answers"), "map<string,string>")).alias("question", "answer"))
    return found.filter("trim(answer) <> ''")


def store_documents(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored documents ``(document_name, content, size_bytes, uploaded_at)`` with files ``(document_name, content)`` in place of those of the same name."""
    new = files.select("document_name", "content", F.length("content").cast("bigint").alias("size_bytes"), F.current_timestamp().alias("uploaded_at"))
    return upsert(stored, new, "document_name")


def stored_names(stored: DataFrame) -> DataFrame:
    return stored.select("document_name", F.length("content").cast("bigint").alias("size_bytes"))


def without_document(stored: DataFrame, name: str) -> DataFrame:
    return stored.filter(~F.col("document_name").eqNullSafe(F.lit(name)))


def copy_store(source: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Writes whole tables into a store, each in place of what was there, and counts them. Missing tables are no error to leave out."""
    done = {}
    spark = None
    for name, df in source.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = spark or df.sparkSession
        done[name] = spark.read.parquet(f"{folder}/{name}").count()
    return done


def without_deal(deals: DataFrame, deal_id: int) -> DataFrame:
    """The deals without one; its requirements and sales aids stay and are orphans."""
    return deals.filter(~F.col("id").eqNullSafe(F.lit(deal_id)))


def label(deal: dict[str, Column] | None = None) -> Column:
    """``customer — company`` of a deal."""
    c = deal or {"customer_name": F.col("customer_name"), "company": F.col("company")}
    return F.concat(F.coalesce(c["customer_name"], F.lit("")), F.lit(" — "), F.coalesce(c["company"], F.lit("")))


def document_bytes(stored: DataFrame, name: str) -> DataFrame:
    """The content of one stored document; no row if there is none."""
    return stored.filter(F.col("document_name").eqNullSafe(F.lit(name))).select("content")


def write_documents(stored: DataFrame, folder: str) -> DataFrame:
    """Writes every stored document as a file of a shared folder, where the rows are, and gives ``(document_name, bytes)`` of each.

    Files of the same name are overwritten, others stay. The folder is a URI that all executors reach. Rows without a name or content are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names, contents = (c.to_pylist() for c in batch.columns)
            for name, content in zip(names, contents, strict=True):
                with system.open_output_stream(f"{root}/{name.replace('/', '_')}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64())], ["document_name", "bytes"])

    return stored.filter("document_name is not null and content is not null").select("document_name", "content").mapInArrow(run, "document_name string, bytes bigint")


def aid_files(aids: DataFrame) -> DataFrame:
    """``(path, content)``: a DOCX file for each sales aid ``(id, title, priorities, framing, table, summary)``; parts that are blank are left out."""
    item = lambda kind, text, grid=None: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), (F.lit(None).cast("array<array<string>>") if grid is None else grid).alias("grid"))
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    none = F.lit(None).cast("string")
    head = F.array(F.when(said(F.col("title")), item("title", F.col("title"))), F.when(said(F.col("framing")), item("paragraph", F.col("framing"))), F.when(F.size("priorities") > 0, item("heading", F.lit("Customer Priorities"))))
    listed = F.transform(F.coalesce("priorities", F.array().cast("array<string>")), lambda p: item("list_item", p))
    tail = F.array(F.when(F.size("table") > 0, item("table", none, F.col("table"))), F.when(said(F.col("summary")), item("heading", F.lit("Summary"))), F.when(said(F.col("summary")), item("paragraph", F.col("summary"))))
    return docx_files(aids.select(F.concat(F.lit("sales_aid_"), F.col("id").cast("string"), F.lit(".docx")).alias("path"), F.array_compact(F.concat(head, listed, tail)).alias("items")))
