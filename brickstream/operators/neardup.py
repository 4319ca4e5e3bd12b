"""Near-duplicates: 64-bit hashes by bands and Hamming distance, texts by Jaccard similarity of their shingles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickstream.functions.scalars import hamming
from brickstream.operators.series import shingles
from brickstream.session import written

BANDS = 8


def valid_hash(h: Column) -> Column:
    return h.rlike("^[0-9a-fA-F]{16}$")


def _spans(parts: int) -> list[tuple[int, int]]:
    """The 64 bits of a hash as ``parts`` runs of nearly equal length: (start from 1, length)."""
    out, at = [], 1
    for k in range(parts):
        length = 64 // parts + (k < 64 % parts)
        out.append((at, length))
        at += length
    return out


def near_pairs(rows: DataFrame, row_id: str, hash_column: str, bits: int, equal: int = 3) -> DataFrame:
    """``hash_a, hash_b, distance`` of different hashes (``hash_a < hash_b``) at most ``bits`` apart.

    A hash is cut into ``bits + equal`` bands.  Two hashes within ``bits`` agree in at least
    ``equal`` of them, so every choice of that many bands is a join key: no pair is lost,
    and all keys are long enough (21 bits or more for 6, 31 or more for 3) that a bucket holds few hashes.
    Runs over distinct hashes: rows that share one are found by :func:`hash_classes`.  The keys are
    joined by sorting, whatever the hashes' size: its estimate knows nothing of the keys that
    each hash is exploded to, so few MB of hashes would be broadcast as a GB of keys.
    """
    spans = _spans(bits + equal)
    keys = [F.concat(F.lit(f"{i}:"), *[F.substring("_bits", *spans[k]) for k in choice]) for i, choice in enumerate(combinations(range(len(spans)), equal))]
    half = lambda at: F.lpad(F.conv(F.substring("h", at, 8), 16, 2), 32, "0")
    hashes = rows.filter(valid_hash(F.col(hash_column))).select(F.lower(F.col(hash_column)).alias("h")).distinct().withColumn("_bits", F.concat(half(1), half(9)))
    keyed = hashes.select("h", F.explode(F.array(*keys)).alias("key")).hint("merge")
    pairs = keyed.withColumnRenamed("h", "hash_a").join(keyed.withColumnRenamed("h", "hash_b"), "key").filter("hash_a < hash_b")
    return pairs.withColumn("distance", hamming(F.col("hash_a"), F.col("hash_b"))).filter(F.col("distance") <= bits).select("hash_a", "hash_b", "distance").distinct()


def capped_pairs(rows: DataFrame, row_id: str, hash_column: str, bits: int, cap: int) -> DataFrame:
    """As :func:`near_pairs`, but without the pairs of which both hashes are crowded.

    A hash is crowded if more than ``cap`` rows (its own included) share one of its 8 bands
    of 8 bits.  Rows per band are counted from the 8 x 256 band values; which rows several
    bands share is found by the pairs that are near anyway, so no bucket is joined with itself.
    """
    valid = rows.filter(valid_hash(F.col(hash_column))).groupBy(F.lower(F.col(hash_column)).alias("h")).agg(F.count("*").alias("n"))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.substring("h", i * 2 + 1, F.lit(2)).alias("key"))))
    banded = valid.select("h", "n", band.alias("_b")).select("h", "n", "_b.band", "_b.key")
    sizes = banded.groupBy("band", "key").agg(F.sum("n").alias("_rows"))
    crowded = banded.join(sizes, ["band", "key"]).groupBy("h").agg(F.max("_rows").alias("_rows")).filter(F.col("_rows") > cap).select("h")
    close = near_pairs(rows, row_id, hash_column, bits)
    left = close.join(crowded, close["hash_a"] == crowded["h"], "left_anti")
    right = close.join(crowded, close["hash_b"] == crowded["h"], "left_anti")
    return left.union(right).distinct()


def simhash(rows: DataFrame, row_id: str, shingle_array: Column) -> DataFrame:
    """``row_id, simhash``: 64-bit SimHash of each row's set of shingles, as 16 hexadecimal digits.

    Every bit is the sign of its sum over the first 64 bits of the shingles' digests.  Rows without
    shingles give none.  The 64 sums are partial aggregates, so a very long text costs a
    few numbers per task.
    """
    hashed = rows.select(F.col(row_id).alias("_id"), F.explode_outer(shingle_array).alias("_s")).filter("_s is not null").select("_id", F.md5("_s").alias("_d"))
    word = lambda at: F.conv(F.substring("_d", at, 8), 16, 10).cast("long")
    hashed = hashed.select("_id", word(1).alias("_high"), word(9).alias("_low"))
    bit = lambda i: F.shiftrightunsigned("_high" if i > 31 else "_low", i % 32).bitwiseAND(F.lit(1).cast("long"))
    sums = hashed.groupBy("_id").agg(*[F.sum(bit(i) * 2 - 1).alias(f"_b{i}") for i in range(64)])

    def half(low: int) -> Column:
        word = F.lit(0).cast("long")
        for i in range(low, low + 32):
            word = word + F.when(F.col(f"_b{i}") >= 0, F.lit(1 << (i - low)).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.lpad(F.hex(word), 8, "0")

    return sums.select(F.col("_id").alias(row_id), F.lower(F.concat(half(32), half(0))).alias("simhash"))


def hash_classes(rows: DataFrame, row_id: str, hash_column: str) -> DataFrame:
    """``row_id, hash_class, members``: one row per row, its class of equal hashes and the class's size."""
    valid = rows.filter(valid_hash(F.col(hash_column))).select(F.col(row_id), F.lower(F.col(hash_column)).alias("hash_class"))
    return valid.join(valid.groupBy("hash_class").agg(F.count("*").alias("members")), "hash_class").select(row_id, "hash_class", "members")


def text_sets(rows: DataFrame, row_id: str, text: str, size: int) -> DataFrame:
    """``row_id, hash_class, tokens``: one row per row, its class of equal texts and its shingles' 64-bit hashes.

    Texts of ``size`` words or more are equal if their sets of shingles are, shorter ones if
    their words are, wordless ones if they are the same but for outer blanks.  Blank texts
    are the class ``blank``, nulls the class ``null``.  Only the first kind has tokens.
    """
    c = F.col(text)
    words = F.array_join(F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)), " ")
    made = rows.select(F.col(row_id), c.alias("_text"), words.alias("_words"), shingles(c, size).alias("_s"))
    digest = (
        F.when(F.col("_text").isNull(), "null")
        .when(F.size("_s") > 0, F.md5(F.array_join(F.sort_array("_s"), "\n")))
        .when(F.col("_words") != "", F.md5("_words"))
        .when(F.col("_text").rlike("(?U)^\\s*$"), "blank")
        .otherwise(F.md5(F.regexp_replace("_text", "(?U)^\\s+|\\s+$", "")))
    )
    tokens = F.when(F.size("_s") > 0, F.array_distinct(F.transform("_s", lambda s: F.xxhash64(s)))).otherwise(F.array().cast("array<bigint>"))
    return made.select(row_id, digest.alias("hash_class"), tokens.alias("tokens"))


def text_classes(rows: DataFrame, row_id: str, text: str, size: int) -> DataFrame:
    """``row_id, hash_class, members``: one row per row, whatever its text, its class (:func:`text_sets`) and the class's size."""
    classes = text_sets(rows, row_id, text, size).select(row_id, "hash_class")
    return classes.join(classes.groupBy("hash_class").agg(F.count("*").alias("members")), "hash_class").select(row_id, "hash_class", "members")


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``hash_a, hash_b, similarity`` of different classes (``hash_a < hash_b``) whose tokens reach ``threshold``.

    ``sets`` has ``hash_class, tokens``.  Prefix-filter join over distinct classes: tokens are
    ordered by rarity, and two sets that reach the threshold share one of their rarest
    ``n - ceil(threshold * n) + 1``; the similarity of all candidates is computed exactly, so
    every pair comes out.  Prefixes carry no sets, so a very long text costs its length.
    """
    # filtered after the classes are made, else the tokens would be computed a second time for the filter
    filled = sets.select(F.col("hash_class").alias("k"), "tokens").dropDuplicates(["k"]).filter(F.size("tokens") > 0)
    # written once: rarity, prefixes and the test read it
    distinct = written(filled, "shingles")
    exploded = distinct.select("k", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    shared = exploded.groupBy("t").agg(F.count("*").alias("f")).filter("f > 1")
    ordered = exploded.join(shared, "t").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    # tokens of one set only come first in the order; they fill the prefix but can't match
    alone = F.col("n") - F.size("o")
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1 - alone
    prefixes = ordered.filter(keep > 0).select("k", "n", alone.alias("_alone"), F.posexplode(F.slice("o", 1, keep)).alias("_i", "_o"))
    prefixes = prefixes.select("k", "n", (F.col("_alone") + F.col("_i")).alias("p"), F.col("_o.t").alias("t"))
    a, b = (prefixes.select(F.col("k").alias(f"hash_{x}"), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}"), "t") for x in "ab")
    na, nb = F.col("n_a"), F.col("n_b")
    need = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)
    near = (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9) & (F.least(na - F.col("p_a"), nb - F.col("p_b")) >= need)
    candidates = a.join(b, "t").filter("hash_a < hash_b").filter(near).select("hash_a", "hash_b").distinct()
    tested = candidates.join(distinct.select(F.col("k").alias("hash_a"), F.col("tokens").alias("t_a")), "hash_a").join(distinct.select(F.col("k").alias("hash_b"), F.col("tokens").alias("t_b")), "hash_b")
    both = F.size(F.array_intersect("t_a", "t_b"))
    scored = tested.select("hash_a", "hash_b", both.alias("_both"), (F.size("t_a") + F.size("t_b")).alias("_sum"))
    return scored.select("hash_a", "hash_b", (F.col("_both") / (F.col("_sum") - F.col("_both"))).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
