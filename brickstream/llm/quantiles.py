"""Problem 1: percentiles of very large numeric columns by dyadic Count-sketches.

Method: a value is encoded as an integer of ``BITS`` bits that keeps the order.  For each
binary resolution (the code without its last k bits) there is one signed sketch: ``DEPTH``
rows of ``WIDTH`` counters, each prefix hashed to one counter per row with a sign.  Only a
resolution with no more prefixes than one row has counters is kept exactly.  Sketches are
tables of counters: they are merged by addition, deletions are negative weights.  A rank
is inverted by descending from the coarsest resolution, going left or right by the
estimated count of the left half.

A sketch is linear in its values, so the part of it that comes from a group with fewer
values than it has counters travels as codes with weights (``level`` -1) and becomes
counters where it is inverted; a larger group is added up to counters before the shuffle.
Either form gives the same counters and so the same answer.

Stated error: a percentile's value is within ``ALPHA`` (relative) of a value whose rank is
within ``max(1, EPSILON * n)`` of the wanted one.  ``WIDTH`` follows from ``EPSILON``: each of
the ``BITS`` levels may add ``EPSILON / BITS`` of a row that collides, and the median of the
rows misleads only where more than half of them do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 0.01
BITS = 32
DEPTH = 7
WIDTH = 1 << math.ceil(math.log2(BITS / EPSILON))
LOWEST, HIGHEST = -746.0, 710.0  # logarithms of the smallest and the largest double
CENTRE = 1 << (BITS - 1)
SCALE = (CENTRE - 2) / (HIGHEST - LOWEST)
ALPHA = 1 / SCALE
PRIME = 2**33 - 9
PAIRS = -1  # level of codes that aren't counters yet
HASHED = BITS - WIDTH.bit_length() + 1  # levels 0 to HASHED - 1 have more prefixes than a row has counters
COUNTERS = HASHED * DEPTH * WIDTH
FEW = 100_000  # large groups that are broadcast, at most
# Parameters of the hash functions, one of each for each row.
HASH_A = (1103515245, 69069, 1664525, 22695477, 1140671485, 16807, 48271)
HASH_B = (12345, 362437, 1013904223, 907633385, 12820163, 5, 3)
SIGN_A = (1812433253, 134775813, 214013, 16843009, 1566083941, 1220703125, 65539)
SIGN_B = (7, 11, 2531011, 826366247, 1, 17, 29)


def code(value: Column) -> Column:
    """Integer of ``BITS`` bits that keeps the order of all doubles, also of infinities."""
    size = F.least(F.floor((F.ln(F.least(F.abs(value), F.lit(1.7976931348623157e308))) - LOWEST) * SCALE) + 1, F.lit(CENTRE - 1)).cast("long")
    return F.when(value == 0, F.lit(CENTRE)).when(value > 0, CENTRE + size).otherwise(CENTRE - size)


def decode(codes: np.ndarray) -> np.ndarray:
    """Middle value of each code."""
    steps = np.abs(codes - CENTRE)
    with np.errstate(over="ignore"):
        return np.where(steps == 0, 0.0, np.sign(codes - CENTRE) * np.exp((steps - 0.5) / SCALE + LOWEST))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys], F.lit(True))


def _counters(coded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters of ``keys, _code, _w``, added up before the shuffle."""
    levels = [(level, 0, 0, 0, 0, 0) for level in range(HASHED, BITS)]
    levels += [(level, row, HASH_A[row], HASH_B[row], SIGN_A[row], SIGN_B[row]) for level in range(HASHED) for row in range(DEPTH)]
    fields = ("level", "row", "a", "b", "c", "d")
    each = F.inline(F.array(*[F.struct(*[F.lit(v).cast("int" if n in ("level", "row") else "long").alias(n) for n, v in zip(fields, x, strict=True)]) for x in levels]))
    cells = coded.select(*keys, "_code", "_w", each).withColumn("_p", F.expr("shiftright(_code, level)"))
    hashed = F.col("level") < HASHED
    bucket = F.when(hashed, F.pmod((F.col("_p") + 1) * F.col("a") + F.col("b"), F.lit(PRIME)) % WIDTH).otherwise(F.col("_p"))
    sign = F.when(hashed, F.pmod((F.col("_p") + 1) * F.col("c") + F.col("d"), F.lit(PRIME)) % 2 * 2 - 1).otherwise(F.lit(1))
    return cells.groupBy(*keys, "level", "row", bucket.alias("bucket")).agg(F.sum(F.col("_w") * sign).alias("count"))


def _pairs(coded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return coded.groupBy(*keys, F.col("_code").alias("bucket")).agg(F.sum("_w").alias("count")).select(*keys, F.lit(PAIRS).alias("level"), F.lit(0).alias("row"), "bucket", "count")


def _formed(coded: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The sketch of ``keys, _code, _w``: counters of groups of more than ``limit`` rows, pairs of the others."""
    sizes = coded.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).drop("_n")
    large = sizes.limit(FEW + 1).count()
    if not large:
        return _pairs(coded, keys)
    if large <= FEW:
        sizes = F.broadcast(sizes)
    on = _same(coded, sizes, keys)
    return _counters(coded.join(sizes, on, "left_semi"), keys).unionByName(_pairs(coded.join(sizes, on, "left_anti"), keys))


def sketch(rows: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, limit: int = COUNTERS) -> DataFrame:
    """``keys, level, row, bucket, count``: the sketch of each group.

    Null and NaN are no values; null keys are a group.  ``weight`` counts each row that many
    times; negative weights delete.  Equal codes are added up before the shuffle.  Groups of
    more than ``limit`` rows come as counters (see above).
    """
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    w = F.lit(1) if weight is None else F.col(weight)
    coded = rows.filter(usable).select(*keys, code(F.col(value).cast("double")).alias("_code"), w.cast("long").alias("_w"))
    return _formed(coded, keys, limit).filter("count != 0")


def merge(sketches: Sequence[DataFrame], keys: Sequence[str], limit: int = COUNTERS) -> DataFrame:
    """Sum of sketches, e.g. of several days or files; ``keys`` may be fewer than theirs."""
    both = reduce(DataFrame.unionByName, [s.select(*keys, "level", "row", "bucket", "count") for s in sketches])
    added = both.groupBy(*keys, "level", "row", "bucket").agg(F.sum("count").alias("count")).filter("count != 0")
    pairs = added.filter(F.col("level") == PAIRS).select(*keys, F.col("bucket").alias("_code"), F.col("count").alias("_w"))
    formed = _formed(pairs, keys, limit).unionByName(added.filter(F.col("level") != PAIRS))
    return formed.groupBy(*keys, "level", "row", "bucket").agg(F.sum("count").alias("count")).filter("count != 0")


def _hash(x: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of prefixes in a row of a hashed level."""
    x = x + 1
    return (x * HASH_A[row] + HASH_B[row]) % PRIME % WIDTH, (x * SIGN_A[row] + SIGN_B[row]) % PRIME % 2 * 2 - 1


def invert(pairs: Sequence[np.ndarray], weights: Sequence[np.ndarray], counters: Sequence[np.ndarray | None], shares: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Number of values and percentiles of many groups at once.

    ``pairs`` and ``weights`` are each group's codes that aren't counters yet, ``counters`` its
    rows ``level, row, bucket, count`` or None.  All estimates are those of the counters, to
    which the codes are added level by level.
    """
    groups = len(pairs)
    owner = np.repeat(np.arange(groups), [len(p) for p in pairs])
    codes = np.concatenate([*pairs, np.zeros(0)]).astype(np.int64)
    w = np.concatenate([*weights, np.zeros(0)]).astype(np.float64)
    dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # group: counters of hashed levels, of exact levels
    for g, cells in enumerate(counters):
        if cells is not None and len(cells):
            hashed, exact = np.zeros((HASHED, DEPTH, WIDTH)), np.zeros((BITS - HASHED, WIDTH))
            low = cells[:, 0] < HASHED
            np.add.at(hashed, tuple(cells[low, :3].T), cells[low, 3])
            np.add.at(exact, (cells[~low, 0] - HASHED, cells[~low, 2]), cells[~low, 3])
            dense[g] = hashed, exact

    def estimate(level: int, prefix: np.ndarray) -> np.ndarray:
        """Count of a prefix of each group; ``prefix`` has one for each group."""
        own = codes >> level
        if level >= HASHED:
            out = np.bincount(owner, w * (own == prefix[owner]), minlength=groups)
            for g, (_, exact) in dense.items():
                out[g] += exact[level - HASHED, prefix[g]]
            return out
        rows = np.zeros((DEPTH, groups))
        for row in range(DEPTH):
            bucket, sign = hashes[row]
            at, turn = _hash(prefix, row)
            rows[row] = np.bincount(owner, w * sign * (bucket == at[owner]), minlength=groups)
            for g, (hashed, _) in dense.items():
                rows[row, g] += hashed[level, row, at[g]]
            rows[row] *= turn
        return np.median(rows, axis=0)

    top = BITS - 1
    total = estimate(top, np.zeros(groups, dtype=np.int64)) + estimate(top, np.ones(groups, dtype=np.int64))
    state = []
    for share in shares:
        rank = np.clip(np.ceil(share * total - 1e-9), 1, np.maximum(total, 1))
        state.append([rank, np.zeros(groups, dtype=np.int64), total.copy()])
    for level in range(top, -1, -1):
        if level < HASHED:
            hashes = [_hash(codes >> level, row) for row in range(DEPTH)]
        for s in state:
            rank, prefix, inside = s
            left = np.clip(estimate(level, prefix * 2), 0, inside)
            right = rank > left
            s[:] = np.where(right, rank - left, rank), prefix * 2 + right, np.where(right, inside - left, left)
    return total.astype(np.int64), np.stack([decode(s[1]) for s in state], axis=1)


def percentiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``keys, n`` and one column per share (``p50`` for 0.5) from the sketch of each group.

    What is gathered per group is bounded by the sketch's size whatever the group's rows;
    the groups of an Arrow batch are inverted together.  Groups without values give no row.
    """
    names = [f"p{round(s * 100):d}" for s in shares]

    @F.pandas_udf("n long, " + ", ".join(f"{n} double" for n in names))
    def inverted(codes: pd.Series, weights: pd.Series, cells: pd.Series) -> pd.DataFrame:
        made = [np.array([[c["level"], c["row"], c["bucket"], c["count"]] for c in g], dtype=np.int64) if len(g) else None for g in cells]
        n, found = invert(list(codes), list(weights), made, shares)
        return pd.DataFrame(found, columns=names).assign(n=n)[["n", *names]]

    pair = F.col("level") == PAIRS
    gathered = sketches.groupBy(*keys).agg(
        F.collect_list(F.when(pair, F.struct("bucket", "count"))).alias("_pairs"),
        F.collect_list(F.when(~pair, F.struct("level", "row", "bucket", "count"))).alias("_cells"),
    )
    out = gathered.withColumn("_p", inverted(F.col("_pairs.bucket"), F.col("_pairs.count"), F.col("_cells")))
    return out.filter("_p.n > 0").select(*keys, "_p.n", *[F.col(f"_p.{n}").alias(n) for n in names])
