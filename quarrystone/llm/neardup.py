"""Near-duplicate texts by b-bit MinHash.

A text is the set of its triples of consecutive words. Texts of the same words are one class, of which only the
representative goes on. Minima of many hash functions over the triples are taken; groups of them make
band keys, and texts that share a key are candidates. Of other minima only the lowest bit is kept and packed; the bits in which
two signatures agree, corrected for chance agreement, estimate the similarity, and what is clearly too far apart never leaves the join of the
keys. An exact count on the few pairs left decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import materialise, release

#: Words of a shingle, words a text must have, and the similarity asked for.
WIDTH, LEAST_WORDS, SIMILARITY = 3, 40, 0.6
#: 56 bands of 5 minima: a pair of similarity 0.6 shares a band with probability 0.99, of 0.65 with 0.999, of 0.1 with 0.0006.
BANDS, ROWS = 56, 5
#: One-bit minima kept for the estimate, a multiple of 64.
BITS = 192
#: An estimate may lie this many standard deviations under the similarity asked for.
SLACK = 4.0
#: Classes of exact copies up to this size are written out as pairs; of larger ones each copy is paired with the representative.
EXPAND = 64
#: Keys of one task of their shuffle, about 5 MB of it, and texts of a bucket in one block.
KEYS_A_TASK, BLOCK = 500_000, 512

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts one after another, and where each text begins (one more at the end)."""
    import xxhash

    clean = pc.ascii_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[^a-z0-9]+", " "), " ")
    lists = pc.split_pattern(clean, " ")
    values, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    encoded = values.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in encoded.dictionary.to_pylist()], np.uint64)
    hashes = table[encoded.indices.to_numpy()] if len(values) else np.empty(0, np.uint64)
    # A text without words is one empty piece.
    blank = np.asarray(pc.equal(clean, "")).astype(bool)
    if blank.any():
        keep = np.ones(len(hashes), bool)
        keep[offsets[:-1][blank]] = False
        hashes = hashes[keep]
        offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) - blank)])
    return hashes, offsets


def _shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words, and where each text's begin; texts of fewer words have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    x = hashes[:n].copy()
    for k in range(1, width):
        x = _mix(x) + hashes[k : n + k]
    counts = np.maximum(0, np.diff(offsets) - width + 1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    inside = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(inside, offsets[:-1][counts > 0], 1)
    np.add.at(inside, (offsets[:-1] + counts)[counts > 0], -1)
    return _mix(x[np.cumsum(inside)[:n] > 0]), starts


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)


def _minima(shingles: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Minima of ``n`` hash functions over each text's shingles, one row a function; every text must have some."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    flip, times = _functions(n, seed)
    out = np.empty((n, len(starts) - 1), np.uint32)
    buffer = np.empty_like(x)
    for k in range(n):
        np.bitwise_xor(x, flip[k], out=buffer)
        np.multiply(buffer, times[k], out=buffer)
        np.minimum.reduceat(buffer, starts[:-1], out=out[k])
    return out


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1500, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``size`` rows and, unless a single row has more, ``most`` bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            weight = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype(np.int64) for c in part.columns if pa.types.is_string(c.type)))
            rows = max(1, int(np.searchsorted(weight, most, "right")))
            yield part.slice(0, rows)
            at += min(rows, part.num_rows)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def text_classes(rows: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """``(id, key1, key2)`` of the texts of enough words; texts of the same words in the same order share the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            hashes, offsets = _word_hashes(part.column(1))
            counts = np.diff(offsets)
            keep = counts >= least_words
            place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(offsets[:-1], counts).astype(np.uint64)
            keys = []
            for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                each = _mix(hashes ^ _mix(place * np.uint64(salt)))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
                keys.append(_signed((total[offsets[1:]] - total[offsets[:-1]])[keep]))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), *keys], ["id", "key1", "key2"])

    src = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("text is not null and id is not null")
    return src.mapInArrow(run, "id bigint, key1 bigint, key2 bigint")


def band_keys(texts: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, keys array<bigint>)``: the keys of a text's bands; the number of the band is part of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            shingles, starts = _shingles(*_word_hashes(part.column(1)), width)
            minima = _minima(shingles, starts, bands * rows, 1).astype(np.uint64)
            keys = np.empty((len(starts) - 1, bands), np.uint64)
            for b in range(bands):
                key = np.full(len(starts) - 1, b + 1, np.uint64)
                for r in range(rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ minima[b * rows + r])
                # 42 bits, as a chance meeting only costs a look at the signature; the others are zero, beside those of the row, so that they are shuffled for little.
                keys[:, b] = key & ~np.uint64((1 << 22) - 1)
            flat = pa.array(keys.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), flat)], ["id", "keys"])

    return texts.mapInArrow(run, "id bigint, keys array<bigint>")


def signatures(texts: DataFrame, width: int, bits: int = BITS) -> DataFrame:
    """``(id, s0, s1, ...)``: the lowest bits of ``bits`` minima, 64 in a number."""
    words = bits // 64
    names = ["id", *(f"s{k}" for k in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            shingles, starts = _shingles(*_word_hashes(part.column(1)), width)
            # The lowest bit of a product by an odd number is that of its factor; a bit from further up is as good as any.
            low = (_minima(shingles, starts, bits, 2) * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)
            packed = np.packbits(low.reshape(words, 64, -1), axis=1, bitorder="little")
            columns = [pa.array(np.ascontiguousarray(packed[k].T).view(np.int64).ravel()) for k in range(words)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return texts.mapInArrow(run, "id bigint, " + ", ".join(f"{n} bigint" for n in names[1:]))


def _exact(pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(a, b, similarity)`` of pairs ``(a, b, text_a, text_b)`` that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 1000):
            sets = []
            for c in (2, 3):
                shingles, starts = _shingles(*_word_hashes(part.column(c)), width)
                sets.append([np.unique(shingles[s:e]) for s, e in zip(starts, starts[1:], strict=False)])
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64)
            either = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - both
            share = both / np.maximum(either, 1)
            keep = pa.array(both >= similarity * either - 1e-9)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(share).filter(keep)], ["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a bigint, b bigint, similarity double")


def _block_pairs(buckets: DataFrame, block: int) -> DataFrame:
    """Rows ``(key, id, n, ...)`` of buckets of n texts with ``i``, ``j`` and ``own``: every two rows of a bucket meet under one pair (i, j).

    A bucket of more than ``block`` texts is parted into blocks by the hash of the id, and each row goes to every pair of blocks its own
    is in: no task holds more than two blocks of a bucket, and no pair is lost.
    """
    m = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    own = F.when(m > 1, F.pmod(F.xxhash64("id"), m)).otherwise(F.lit(0)).cast("int")
    spread = buckets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), m - 1)))
    return spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n")


def candidates(keys: DataFrame, signs: DataFrame, rows: int, similarity: float, rows_a_task: int = KEYS_A_TASK, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, smaller first: the texts that share a key of ``(id, key)`` and whose signatures ``(id, s0, ...)`` are near enough.

    The keys, ``rows`` of them, are shuffled once, into tasks of one size whatever their number. Where they lie they are counted, and most of them, those
    of one text, go no further. The texts of the others take their signature along, so that the bits are compared inside the join and only near pairs come out of it.
    """
    words = [c for c in signs.columns if c != "id"]
    spread = keys.filter("id is not null and key is not null").select("key", "id").repartition(max(1, -(-rows // rows_a_task)), "key")
    # The count looks at the ids too, and both leave out nulls, so that it reads the same shuffle as the join.
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "n")
    met = _block_pairs(spread.join(shared.hint("shuffle_hash"), "key").join(signs, "id"), block)
    met = met.repartition("key", "i", "j")
    side = lambda name: met.select("key", "i", "j", F.col("id").alias(name), F.col("own").alias(f"own_{name}"), *(F.col(w).alias(f"{name}_{w}") for w in words))
    agree = F.lit(64 * len(words))
    for w in words:
        agree = agree - F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}")))
    # Agreement is p = J + (1 - J) / 2; so much of it must be there that the estimate 2 p - 1 isn't clearly below.
    p = (1 + similarity) / 2
    least = 64 * len(words) * p - SLACK * (64 * len(words) * p * (1 - p)) ** 0.5
    near = side("a").join(side("b"), ["key", "i", "j"]).filter(F.col("a") < F.col("b")).filter((F.col("i") == F.col("j")) | (F.col("own_a") != F.col("own_b"))).filter(agree >= least)
    return near.select("a", "b").distinct()


def class_pairs(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", width: int = WIDTH, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``(id, class_id, copies)`` of every text of enough words, and ``(a, b, similarity)`` of the similar classes.

    ``class_id`` is the lowest id of the texts with the same words. No bucket is cut and no pair dropped: large buckets
    are joined block by block, and since copies are one class, they hold different texts only.
    """
    classes = materialise(text_classes(rows, id_col, text_col, least_words), "classes")
    heads = classes.groupBy("key1", "key2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    texts = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    first = texts.join(heads.select(F.col("class_id").alias("id")), "id", "left_semi")
    keys = band_keys(first, width).select(F.explode("keys").alias("key"), "id")
    # Texts are shuffled by id once: the making of keys and the look at near pairs are one job and read the same shuffle.
    near = candidates(keys, signatures(first, width), classes.count() * BANDS, similarity)
    # The columns keep their names below the joins: renamed ones would be another shuffle.
    plain = rows.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    looked = near.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    for side in "ab":
        own = plain.alias(side)
        looked = looked.join(own, F.col(f"_{side}") == F.col(f"{side}.`{id_col}`")).select("_a", "_b", *[c for c in looked.columns if c.startswith("_text")], F.col(f"{side}.`{text_col}`").alias(f"_text_{side}"))
    looked = looked.toDF("a", "b", "text_a", "text_b")
    pairs = materialise(_exact(looked.select("a", "b", "text_a", "text_b"), width, similarity).dropDuplicates(["a", "b"]), "pairs")
    members = classes.join(heads, ["key1", "key2"]).select("id", "class_id", "copies")
    return members, pairs


def similar_pairs(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", similarity: float = SIMILARITY, expand: int | None = EXPAND) -> DataFrame:
    """``(row_id_a, row_id_b)``, smaller first: the rows whose texts reach the similarity, copies included.

    Texts of fewer than ``LEAST_WORDS`` words and null texts are in no pair, rows repeated under one id pair with others once.

    Classes of up to ``expand`` exact copies are written out: each copy with each other and with those of similar classes. A class of more
    stands for itself by its representative, its lowest id: each of its other copies is paired with that one alone, and other classes with the representative
    alone, so that no link between different texts is lost and no group of copies is squared; ``groups`` has the class of every row.
    With ``expand=None`` every class is written out, however large.
    """
    members, pairs = class_pairs(rows, id_col, text_col, similarity=similarity)
    members = materialise(members, "members")
    whole = F.lit(True) if expand is None else F.col("copies") <= expand
    # The representative of a large class is its only row that meets other classes.
    speaking = members.filter(whole | (F.col("id") == F.col("class_id"))).select("id", "class_id")
    a, b = (speaking.select(F.col("id").alias(f"row_{s}"), F.col("class_id").alias(s)) for s in "ab")
    across = pairs.select("a", "b").join(a, "a").join(b, "b").select("row_a", "row_b")
    copied = members.filter(whole & (F.col("copies") > 1))
    inside = copied.select(F.col("id").alias("row_a"), "class_id").join(copied.select(F.col("id").alias("row_b"), "class_id"), "class_id").filter("row_a < row_b").select("row_a", "row_b")
    large = members.filter(~whole & (F.col("id") != F.col("class_id"))).select(F.col("class_id").alias("row_a"), F.col("id").alias("row_b"))
    out = across.unionByName(inside).unionByName(large)
    return out.select(F.least("row_a", "row_b").alias("row_id_a"), F.greatest("row_a", "row_b").alias("row_id_b")).filter("row_id_a < row_id_b")


def groups(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(row_id, class_id, group_id, links)`` of every row of enough words.

    A group is a set of classes linked by similar pairs, named by its lowest id; ``links`` counts the other classes a
    row's class is similar to. Labels run over the pairs in rounds, each a written table, until none changes; a round also
    follows the label's own label, so that long chains take logarithmically many rounds.
    """
    members, pairs = class_pairs(rows, id_col, text_col, similarity=similarity)
    edges = materialise(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialise(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "label")
    held = [label]
    while True:
        seen = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(seen, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = materialise(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old"), "label")
        label = new.select("node", "label")
        # The table of the round before is read no more: only two are ever there.
        release(held.pop())
        held.append(new)
        if new.filter("label <> old").isEmpty():
            break
    links = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    named = members.join(label.select(F.col("node").alias("class_id"), F.col("label").alias("group_id")), "class_id", "left").join(links.withColumnRenamed("a", "class_id"), "class_id", "left")
    return named.select(F.col("id").alias("row_id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
