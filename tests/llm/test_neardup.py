import random
import re

from quarrystone.llm.neardup import groups, similar_pairs


def _texts(seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(35, 90))]
        rows.append(words)
        if k % 3 == 0:
            edited = list(words)
            for _ in range(rng.randint(1, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append(edited)
        if k % 10 == 0:
            rows.append(list(words))
    return [(k, " ".join(w) if k % 2 else "  ".join(w).upper() + "!") for k, w in enumerate(rows)]


def _exact(rows, similarity=0.6):
    sets = {}
    for k, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= 40:
            sets[k] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    rows = _texts()
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "row_id bigint, text string")).collect()}
    want = _exact(rows)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 40


def test_large_class_of_copies(spark):
    text = " ".join(f"a{k}" for k in range(50))
    edited = text.replace("a7 ", "zz ")
    rows = [(k, text) for k in range(90)] + [(200, edited), (201, None), (202, ""), (203, "short text")]
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "row_id bigint, text string"), expand=20).collect()}
    assert got == {(0, k) for k in range(1, 90)} | {(0, 200)}


def test_groups(spark):
    words = [f"a{k}" for k in range(100)]
    chain = [" ".join(words[10 * s :] + [f"b{s}_{k}" for k in range(10 * s)]) for s in range(4)]
    rows = list(enumerate(chain)) + [(10, chain[0]), (11, " ".join(f"c{k}" for k in range(60))), (12, "few")]
    got = {r.row_id: r for r in groups(spark.createDataFrame(rows, "row_id bigint, text string")).collect()}
    assert set(got) == {0, 1, 2, 3, 10, 11}
    assert got[10].class_id == 0 and got[10].group_id == got[0].group_id == 0
    assert got[11].group_id == 11 and got[11].links == 0
    linked = {a for p in _exact(rows) for a in p if a != 10}
    assert all(got[a].group_id == 0 for a in linked if got[a].links)


def test_empty(spark):
    assert similar_pairs(spark.createDataFrame([], "row_id bigint, text string")).count() == 0


def test_every_copy_can_be_written_out(spark):
    text = " ".join(f"a{k}" for k in range(50))
    rows = [(k, text) for k in range(100)] + [(200, text.replace("a7 ", "zz "))]
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "row_id bigint, text string"), expand=None).collect()}
    assert got == _exact(rows) and len(got) == 100 * 101 // 2


def test_sql_of_a_large_class(spark):
    """The SQL states the same form as the operator, also where a class has more copies than are written out."""
    import duckdb
    import pandas as pd

    from quarrystone.llm.queries import oracle_sql

    text = " ".join(f"a{k}" for k in range(50))
    rows = [(1000 - k, text) for k in range(100)] + [(5, text.replace("a7 ", "zz ")), (2000, text.replace("a9 ", "yy "))] + [(3000 + k, text.replace("a30 ", "xx ")) for k in range(3)]
    chunks = pd.DataFrame(rows, columns=["row_id", "text"])  # noqa: F841
    want = {tuple(map(int, r)) for r in duckdb.sql(oracle_sql()["p3_found"]).fetchall()}
    assert {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "row_id bigint, text string")).collect()} == want
    assert (901, 1000) in want and (999, 1000) not in want and (5, 901) in want


def test_hot_buckets_lose_no_pair(spark):
    """All texts share a key: they meet block by block, each two of them once, whatever the size of a block."""
    from pyspark.sql import functions as F

    from quarrystone.llm.neardup import candidates

    ids = spark.range(1, 61)
    keys = ids.select("id", F.lit(7).cast("bigint").alias("key")).unionByName(ids.select("id", (F.col("id") + 100).alias("key")))
    signs = ids.select("id", *[F.lit(0).cast("bigint").alias(f"s{k}") for k in range(3)])
    for block in (1, 7, 59, 60, 1000):
        got = [tuple(r) for r in candidates(keys, signs, 120, 0.6, rows_a_task=50, block=block).collect()]
        assert len(got) == len(set(got)) == 60 * 59 // 2
    far = ids.select("id", *[F.when(F.col("id") == 1, F.lit(-1)).otherwise(F.lit(0)).cast("bigint").alias(f"s{k}") for k in range(3)])
    assert all(1 not in r for r in candidates(keys, far, 120, 0.6, block=8).collect())


def test_rounds_of_groups_keep_no_tables(spark, monkeypatch):
    """A long chain of texts takes many rounds; the tables of past rounds are gone."""
    from quarrystone.llm import neardup

    live, most = set(), [0]
    write, drop = neardup.materialise, neardup.release

    def counted(df, name):
        out = write(df, name)
        if name == "label":
            live.add(id(out))
            most[0] = max(most[0], len(live))
        return out

    def gone(df):
        live.discard(id(df))
        drop(df)

    monkeypatch.setattr(neardup, "materialise", counted)
    monkeypatch.setattr(neardup, "release", gone)
    words = [f"x{k}" for k in range(60 + 8 * 24)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 60])) for k in range(24)]
    got = {r.group_id for r in neardup.groups(spark.createDataFrame(rows, "row_id bigint, text string")).collect()}
    assert got == {0} and most[0] == 2
