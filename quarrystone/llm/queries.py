"""Queries of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.mixing import mixture
from quarrystone.llm.neardup import EXPAND, groups, similar_pairs
from quarrystone.llm.pairs import broken_pairs
from quarrystone.llm.scans import repaired_pages, repaired_paragraphs, scan_defects
from quarrystone.llm.splitting import CLOSERS, FULL_WIDTH_ENDS, LINE_ENDS, SENTENCE_ENDS, SPACES, oversized_ids, split_texts
from quarrystone.llm.stuffing import shape_report, stuffed_pages
from quarrystone.llm.tokenizing import encode_ids
from quarrystone.tables import table


_CHUNK = ("row_id", "document_name", "page_number", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of the lines of scanned pages."""
    return scan_defects(table(spark, sf_dir, "chunks", *_CHUNK))


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned pages as paragraphs of whole, correct words."""
    return repaired_pages(table(spark, sf_dir, "chunks", *_CHUNK))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of scanned documents, whole over the borders of pages."""
    return repaired_paragraphs(table(spark, sf_dir, "chunks", *_CHUNK))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of similarity 0.6 or more."""
    return similar_pairs(table(spark, sf_dir, "chunks", "row_id", "text"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its class of copies, its group and its links."""
    return groups(table(spark, sf_dir, "chunks", "row_id", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of question and answer pairs."""
    return broken_pairs(table(spark, sf_dir, "feedback", "id", "question", "answer"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be cut."""
    return oversized_ids(table(spark, sf_dir, "chunks", "row_id", "text"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the chunks that had to be cut."""
    return split_texts(table(spark, sf_dir, "chunks", "row_id", "section_heading", "text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_ids(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: one row per use of a document."""
    return mixture(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return mixture(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of stuffing."""
    return stuffed_pages(table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of lines of all documents."""
    return shape_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pages, p1_paragraphs, p3_found, p3_groups, p5_found, p7_found, p7_pieces, p8_ids, p9_mixture, p9_shares, p10_found, p10_shapes)}


def oracle_sql() -> dict[str, str]:
    # Whole tables: triples of words joined on equality. Copies are one class; one of more than EXPAND stands for itself by its lowest id.
    classes = """
        w AS (SELECT row_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks WHERE text IS NOT NULL),
        k AS (SELECT row_id, w FROM w WHERE len(w) >= 40),
        c AS (SELECT w, min(row_id) AS class_id, count(*) AS copies FROM k GROUP BY w),
        m AS (SELECT k.row_id, c.class_id, c.copies FROM k JOIN c ON k.w = c.w),
        s AS (SELECT class_id AS id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM c),
        t AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.id < b.id AND a.n * 10 >= b.n * 6 AND b.n * 10 >= a.n * 6 GROUP BY ALL),
        near AS (SELECT a, b FROM p WHERE shared * 10 >= 6 * (na + nb - shared))
    """
    p3 = f"""
        WITH {classes},
        speaking AS (SELECT row_id, class_id FROM m WHERE copies <= {EXPAND} OR row_id = class_id),
        pairs AS (
            SELECT x.row_id AS u, y.row_id AS v FROM near JOIN speaking x ON x.class_id = near.a JOIN speaking y ON y.class_id = near.b
            UNION ALL SELECT x.row_id, y.row_id FROM m x JOIN m y ON x.class_id = y.class_id AND x.row_id < y.row_id WHERE x.copies <= {EXPAND}
            UNION ALL SELECT class_id, row_id FROM m WHERE copies > {EXPAND} AND row_id <> class_id)
        SELECT least(u, v) AS row_id_a, greatest(u, v) AS row_id_b FROM pairs
    """
    groups_sql = f"""
        WITH RECURSIVE {classes},
        edges AS (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near),
        reach(u, v) AS (SELECT u, u FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u),
        named AS (SELECT u, min(v) AS group_id FROM reach GROUP BY u), linked AS (SELECT u, count(*) AS links FROM edges GROUP BY u)
        SELECT m.row_id, m.class_id, coalesce(named.group_id, m.class_id) AS group_id, coalesce(linked.links, 0) AS links FROM m LEFT JOIN named ON named.u = m.class_id LEFT JOIN linked ON linked.u = m.class_id
    """
    # Cuts one after another: from each, the farthest strong boundary in reach of the piece that starts with the overlap words, else the farthest beside a blank, else as far as it goes.
    quote = lambda chars: chars.replace("'", "''")
    pieces = f"""
        WITH RECURSIVE o AS (SELECT row_id, section_heading, text, regexp_extract_all(text, '(?s).') AS cs FROM chunks WHERE length(text) > 1200),
        c AS (SELECT row_id, unnest(cs) AS ch, generate_subscripts(cs, 1) AS i FROM o),
        d AS (SELECT row_id, i, contains('{quote(SPACES)}', ch) AS sp, contains('{quote(LINE_ENDS)}', ch) AS ln, contains('{quote(CLOSERS)}', ch) AS cl, contains('{quote(SENTENCE_ENDS)}', ch) AS e0, contains('{quote(FULL_WIDTH_ENDS)}', ch) AS w0 FROM c),
        e AS (SELECT *, e0 OR (cl AND lag(e0, 1, false) OVER w) OR (cl AND lag(cl, 1, false) OVER w AND lag(e0, 2, false) OVER w) OR (cl AND lag(cl, 1, false) OVER w AND lag(cl, 2, false) OVER w AND lag(e0, 3, false) OVER w) AS ended,
            w0 OR (cl AND lag(w0, 1, false) OVER w) AS wide, lag(sp, 1, true) OVER w AS sp0, lead(sp, 1, false) OVER w AS sp1, lead(sp, 1, true) OVER w AS edge FROM d WINDOW w AS (PARTITION BY row_id ORDER BY i)),
        f AS (SELECT row_id, max(i) AS n, list(i ORDER BY i) FILTER ((ended AND sp1) OR wide OR ln) AS strong, list(i ORDER BY i) FILTER (sp OR sp1) AS weak, list(i - 1 ORDER BY i) FILTER (NOT sp AND sp0) AS heads, list(i ORDER BY i) FILTER (NOT sp AND edge) AS tails FROM e GROUP BY row_id),
        b(row_id, k, start, cut) AS (SELECT row_id, 0, 0, coalesce(list_max(list_filter(list_append(strong, n), lambda x: x <= 1200)), list_max(list_filter(weak, lambda x: x <= 1200)), 1200) FROM f
            UNION ALL SELECT row_id, k + 1, opens, coalesce(list_max(list_filter(list_append(strong, n), lambda x: x > cut AND x <= opens + 1200)), list_max(list_filter(weak, lambda x: x > cut AND x <= opens + 1200)), least(opens + 1200, n))
                FROM (SELECT f.*, b.k, b.cut, CASE WHEN greatest(len(list_filter(tails, lambda x: x <= b.cut)) - 10, len(list_filter(heads, lambda x: x < b.cut - 600))) < len(list_filter(tails, lambda x: x <= b.cut)) THEN heads[greatest(len(list_filter(tails, lambda x: x <= b.cut)) - 10, len(list_filter(heads, lambda x: x < b.cut - 600)), 0) + 1] ELSE b.cut END AS opens FROM b JOIN f ON f.row_id = b.row_id AND b.cut < f.n))
        SELECT b.row_id, CAST(k AS INTEGER) AS chunk_index, CAST(start AS BIGINT) AS start_char, CAST(cut AS BIGINT) AS end_char, section_heading, array_to_string(cs[start + 1 : cut], '') AS text FROM b JOIN o ON o.row_id = b.row_id
    """
    return {"p3_found": p3, "p3_groups": groups_sql, "p7_pieces": pieces, "p7_found": "SELECT row_id FROM chunks WHERE length(text) > 1200"}
