"""Questions answered over a table of chunks in one batch: intent, plan, retrieval, reply, guard.

Models are pluggable: the default embedding hashes words into a vector and the default reply quotes its best source, so that everything
runs offline and gives the same result each time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import keywords
from quarrystone.operators import chunking, guard, naming, vectors
from quarrystone.session import materialise

Embedder = Callable[[list[str]], np.ndarray]
#: The replies that are given without a source.
NO_SOURCE = "The approved documents do not answer this."
BLOCKED = "This statement needs a check by the compliance team."
DIMENSIONS = 96
#: Least chunks of each of several products; chunks that keywords add.
PER_PRODUCT, KEYWORD_EXTRAS = 10, 3


def hashed(texts: list[str]) -> np.ndarray:
    """Counts of words of three characters or more hashed into ``DIMENSIONS`` signed places, of length one."""
    out = np.zeros((len(texts), DIMENSIONS))
    for k, t in enumerate(texts):
        for w, n in Counter(re.findall("[a-z0-9]{3,}", (t or "").lower())).items():
            place, sign = _place(w)
            out[k, place] += sign * n
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@lru_cache(200_000)
def _place(word: str) -> tuple[int, int]:
    """The place and the sign of a word, from its MD5."""
    d = hashlib.md5(word.encode(), usedforsecurity=False).digest()
    return int.from_bytes(d[:4], "big") % DIMENSIONS, 1 if d[4] & 1 else -1


def embed(rows: DataFrame, id_col: str, text_col: str, embedder: Embedder = hashed, scope: str | None = None) -> DataFrame:
    """``(vec_id, scope, embedding)`` of a table's texts, a batch at a time; blank texts have no vector."""
    src = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"), F.col(text_col).alias("text")).filter("trim(text) <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = embedder(batch.column(2).to_pylist()).astype(np.float32)
            offsets = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], ["vec_id", "scope", "embedding"])

    return src.mapInArrow(run, "vec_id bigint, scope string, embedding array<float>")


def build_index(chunks: DataFrame, embedder: Embedder = hashed) -> DataFrame:
    """The chunks once per content with their vectors, as a written table."""
    first = chunking.first_of_content(chunks.select("row_id", "text", "document_name", "product_name"))
    vec = embed(first, "row_id", "text", embedder)
    return materialise(first.join(vec.select(F.col("vec_id").alias("row_id"), "embedding"), "row_id"), "index")


def plan(questions: DataFrame, named: DataFrame, k: int = 8, resolved: bool = False) -> DataFrame:
    """``(id, part, product_name, n)``: the searches that a question ``(id, question)`` needs; ``named`` has ``(id, product_name)``.

    A question for all products takes the best chunk of every document (``list``), unless its products are ``resolved`` by the caller. One
    named product takes the k best of it, several take max(10, k / number) of each (``main``); either is supplemented by the k best of
    all (``more``). Any other question takes the k best of all (``main``).
    """
    count = named.groupBy("id").agg(F.count(F.lit(1)).alias("names"))
    q = questions.select("id", (F.lit(False) if resolved else guard.question_flags(F.col("question"))["list_all"]).alias("list_all")).join(count, "id", "left")
    lists, other = q.filter("list_all"), q.filter("not list_all")
    out = lambda rows, part, product, n: rows.select("id", F.lit(part).alias("part"), product.cast("string").alias("product_name"), n.cast("int").alias("n"))
    each = F.when(F.col("names") == 1, F.lit(k)).otherwise(F.greatest(F.lit(PER_PRODUCT), F.floor(F.lit(k) / F.col("names"))))
    scoped = out(other.join(named, "id"), "main", F.col("product_name"), each)
    return scoped.unionByName(out(other.filter("names is null"), "main", F.lit(None), F.lit(k))).unionByName(out(other.filter("names is not null"), "more", F.lit(None), F.lit(k))).unionByName(out(lists, "list", F.lit(None), F.lit(1)))


def retrieve(index: DataFrame, questions: DataFrame, k: int = 8, embedder: Embedder = hashed, excluded: list[str] | None = None, named: DataFrame | None = None) -> DataFrame:
    """``(query_id, row_id, sim, rank, confidence)``: the chunks that answer every question as ``plan`` says; none where the best one is too far.

    To the best chunks of a question for no list come up to three others of its products that contain one of its keywords. Several products
    take turns, the supplement comes last, lists go by document. ``named`` has ``(id, product_name)``, the products of the questions;
    by default those of the index of which a question has a telling token. Excluded documents are left out of every search.
    """
    kept = index.filter(~F.col("document_name").isin(excluded)) if excluded else index
    names = materialise((naming.mentions(questions, "id", "question", index) if named is None else named.select("id", "product_name").distinct()), "named")
    # Ids of questions and chunks are of different tables: negative ones keep a question from hiding a chunk.
    vec = embed(questions.select((-F.col("id") - 1).alias("id"), "question"), "id", "question", embedder).select((-F.col("vec_id") - 1).alias("id"), "embedding")
    words = questions.select("id", keywords(F.col("question")).alias("words"))
    asked = materialise(plan(questions, names, k, named is not None).join(vec, "id").join(words, "id").withColumn("search", F.monotonically_increasing_id()), "asked")

    found = materialise(_search(kept, asked.filter("part <> 'list'")), "found")
    of = asked.select("search", F.col("id").alias("query_id"), "part", F.col("product_name").alias("product"), "n")
    best = found.join(of, "search")
    rank = F.row_number().over(Window.partitionBy("search").orderBy(F.col("sim").desc(), "row_id"))  # n of every task
    main = best.filter("not by_word").withColumn("rank", rank).filter("rank <= n")
    cols = ["query_id", "row_id", "sim", "product"]
    first = main.filter("part = 'main'").select(*cols)
    extra = best.filter("by_word").select(*cols).join(first, ["query_id", "row_id"], "left_anti")
    extra = extra.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "row_id"))).filter(F.col("k") <= KEYWORD_EXTRAS).select(*cols)
    scoped = first.unionByName(extra)
    turn = F.row_number().over(Window.partitionBy("query_id", "product").orderBy(F.col("sim").desc(), "row_id"))
    more = main.filter("part = 'more'").select(*cols).join(scoped, ["query_id", "row_id"], "left_anti")
    listed = vectors.top_k(kept.select((F.col("row_id")).alias("vec_id"), "embedding", F.col("document_name").alias("scope")), asked.filter("part = 'list'").select((-F.col("id") - 1).alias("vec_id"), F.lit(None).cast("string").alias("scope"), "embedding"), 1, scope="scope", mode="each")
    order = lambda rows, part, at, name: rows.select("query_id", "row_id", "sim", F.lit(part).alias("part"), at.cast("int").alias("turn"), name.alias("name"))
    by_document = listed.select((-F.col("query_id") - 1).alias("query_id"), F.col("vec_id").alias("row_id"), "sim", "scope")
    whole = order(scoped, 0, turn, F.col("product")).unionByName(order(more, 1, F.lit(0), F.lit(None).cast("string"))).unionByName(order(by_document, 0, F.lit(0), F.col("scope")))
    of_query = Window.partitionBy("query_id")  # the chunks of one answer
    ranked = whole.withColumn("rank", F.row_number().over(of_query.orderBy("part", "turn", "name", F.col("sim").desc(), "row_id")))
    return ranked.select("query_id", "row_id", "sim", "rank", vectors.confidence(F.max("sim").over(of_query)).alias("confidence")).filter("confidence <> 'none'")


def _search(index: DataFrame, asked: DataFrame) -> DataFrame:
    """``(search, row_id, sim, by_word)``: per task the n best chunks of every search, and the best of those that contain a keyword.

    Keywords are found inside words, too, as a text contains them. Of the chunks with a keyword, so many more are kept as the n best can take away again. A question is compared with a chunk once, however many
    of its products are searched; ``vectors.BLOCK`` questions go into one pass over the chunks.
    """
    src = index.select("row_id", "product_name", "text", "embedding").filter("embedding is not null")
    blocks: list[list[dict]] = []
    ids: set[int] = set()
    for row in asked.select("search", "id", "part", "product_name", "n", "embedding", "words").orderBy("id").toLocalIterator():
        if not blocks or (row.id not in ids and len(ids) >= vectors.BLOCK):
            blocks.append([])
            ids = set()
        ids.add(row.id)
        blocks[-1].append(row.asDict())
    out = None
    for block in blocks:
        part = src.mapInArrow(_searcher(block), "search bigint, row_id bigint, sim double, by_word boolean")
        out = part if out is None else out.unionByName(part)
    return index.sparkSession.createDataFrame([], "search bigint, row_id bigint, sim double, by_word boolean") if out is None else out


def _with_fresh(sims: np.ndarray, ids: np.ndarray, near: np.ndarray, row: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of each line of ``sims`` with those of ``near`` that are marked as fresh: as many as before, by similarity, then by id."""
    asked, n = sims.shape
    q, c = np.nonzero(fresh)
    if not len(q):
        return sims, ids
    line = np.concatenate([np.repeat(np.arange(asked), n), q])
    value, which = np.concatenate([sims.ravel(), near[q, c]]), np.concatenate([ids.ravel(), row[c]])
    order = np.lexsort((which, -value, line))
    line = line[order]
    kept = order[np.arange(len(line)) - np.searchsorted(line, np.arange(asked))[line] < n]
    return value[kept].reshape(asked, n), which[kept].reshape(asked, n)


#: Chunks that are compared at once.
SLICE = 2000


def _searcher(block: list[dict]):
    questions = {r["id"]: k for k, r in reversed(list(enumerate(block)))}
    place = {q: j for j, q in enumerate(questions)}
    matrix = np.array([block[k]["embedding"] for k in questions.values()], np.float64)
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    known = {w: j for j, w in enumerate(sorted({w for r in block if r["part"] == "main" for w in r["words"] or ()}))}
    wanted = np.zeros((len(unit), len(known)), np.float32)
    # Searches of one product and one number go together: which questions, which searches.
    groups: dict[tuple, tuple[list[int], list[int]]] = {}
    for r in block:
        if r["part"] == "main":
            wanted[place[r["id"]], [known[w] for w in r["words"] or ()]] = 1
        for by_word, n in ((False, r["n"]), (True, r["n"] + KEYWORD_EXTRAS)):
            if not by_word or (r["part"] == "main" and r["words"]):
                asked, searches = groups.setdefault((r["product_name"], by_word, n), ([], []))
                asked.append(place[r["id"]])
                searches.append(r["search"])
    plans = [(product, by_word, n, np.array(asked), np.array(searches)) for (product, by_word, n), (asked, searches) in groups.items()]
    products = {p for p, *_ in plans} - {None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        # All keywords are looked for in one pass over a text.
        words = ahocorasick.Automaton()
        for w, j in known.items():
            words.add_word(w, j)
        if known:
            words.make_automaton()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
                batch = batch.take(pa.array(order))  # by id: of equal chunks the first counts
                row = batch.column(0).to_numpy(zero_copy_only=False)
                product = np.array(batch.column(1).to_pylist(), object)
                has = np.zeros((batch.num_rows, len(known)), np.float32)
                for i, text in enumerate(batch.column(2).to_pylist()):
                    if known and (js := {j for _, j in words.iter(text.lower())}):
                        has[i, list(js)] = 1
                v = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(row), -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                sims = np.round(unit @ v.T, 5) + 0.0
                hit = wanted @ has.T > 0
                places = {p: np.flatnonzero(product == p) for p in products & set(product)}
                for g, (name, by_word, n, asked, _) in enumerate(plans):
                    own = np.arange(len(row)) if name is None else places.get(name)
                    if own is None or not len(own):
                        continue
                    near = sims[np.ix_(asked, own)]
                    if by_word:
                        near = np.where(hit[np.ix_(asked, own)], near, -np.inf)
                    if g in best and best[g][0].shape[1] == n:
                        # Once n are known, only chunks as near as the last of them are looked at.
                        fresh = near >= np.maximum(best[g][0][:, -1:], -1.0)
                        if np.count_nonzero(fresh) <= 4 * best[g][0].size:
                            best[g] = _with_fresh(*best[g], near, row[own], fresh)
                            continue
                    if near.shape[1] > n:
                        # Whole numbers that order by similarity, then by id.
                        key = np.where(np.isfinite(near), np.rint(-near * 1e5), 1e9).astype(np.int64) * SLICE + np.arange(len(own))
                        top = np.argpartition(key, n - 1, axis=1)[:, :n]
                        near, ids = np.take_along_axis(near, top, axis=1), row[own][top]
                    else:
                        ids = np.broadcast_to(row[own], near.shape)
                    if g in best:
                        near, ids = np.concatenate([best[g][0], near], axis=1), np.concatenate([best[g][1], ids], axis=1)
                    kept = np.lexsort((ids, -near), axis=1)[:, :n]
                    best[g] = np.take_along_axis(near, kept, axis=1), np.take_along_axis(ids, kept, axis=1)
        for g, (near, ids) in best.items():
            fine = np.isfinite(near)
            searches = np.broadcast_to(plans[g][4][:, None], near.shape)
            yield pa.RecordBatch.from_arrays([pa.array(searches[fine]), pa.array(ids[fine]), pa.array(near[fine]), pa.array(np.full(int(fine.sum()), plans[g][1]))], ["search", "row_id", "sim", "by_word"])

    return run


def answer(index: DataFrame, questions: DataFrame, k: int = 8, embedder: Embedder = hashed) -> DataFrame:
    """``(id, intent, confidence, source, answer, category, blocked)`` of every question ``(id, question)``."""
    found = retrieve(index, questions, k, embedder)
    texts = index.select("row_id", "text", "document_name")
    joined = found.join(texts, "row_id")
    context = joined.groupBy("query_id").agg(
        F.first("confidence").alias("confidence"), F.min_by(F.struct("document_name", "text"), F.struct("rank")).alias("first"),
        F.min_by(F.struct("document_name", "text"), F.struct(-F.col("sim"), F.col("rank"))).alias("nearest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("sources"),  # the texts of one answer
    )
    # A list goes by document, so that its first source is not its best.
    top = F.when(guard.question_flags(F.col("question"))["list_all"], F.col("nearest")).otherwise(F.col("first"))
    q = questions.join(context, F.col("id") == F.col("query_id"), "left").withColumn("top", top)
    reply = F.when(F.col("top").isNull(), F.lit(NO_SOURCE)).otherwise(F.regexp_extract("top.text", r"^(.*?[.!?])(?:\s|$)", 1))
    reply = F.when(reply == "", F.col("top.text")).otherwise(reply)
    drafted = q.select("id", "question", guard.intent(F.col("question")).alias("intent"), F.coalesce("confidence", F.lit("none")).alias("confidence"), F.col("top.document_name").alias("source"), reply.alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"))
    checked = guard.check_claims(drafted, "question", "answer", "sources")
    return checked.select("id", "intent", "confidence", "source", F.when(F.col("blocked"), F.lit(BLOCKED)).otherwise(F.col("answer")).alias("answer"), "category", "blocked")
