"""Problem 9: filling fixed-capacity containers with items, shortest pack first.

Method: the histogram of item lengths (at most ``capacity`` numbers, however many items)
is packed on the driver: lengths are placed longest first, each into the open packs that
are shortest so far, as counts of packing patterns.  Patterns become ranges of ranks per
length; items get their rank within their length in parallel and look their range up.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2_048
PER_TASK = 65_536  # items of one length that are ranked together, so that no length is one task


def pack_histogram(counts: Mapping[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of each packing pattern; every length is at most ``capacity``."""
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room left: (count, (length, rest of the pattern))
    for length in sorted((n for n, c in counts.items() if n > 0 and c > 0), reverse=True):
        todo = counts[length]
        while todo:
            rooms = [room for room, packs in open_packs.items() if packs and room >= length]
            if rooms:
                room = max(rooms)  # the shortest pack has the most room
                count, pattern = open_packs[room].pop()
                used = min(count, todo)
                if count > used:
                    open_packs[room].append((count - used, pattern))
                open_packs[room - length].append((used, (length, pattern)))
                todo -= used
                continue
            each = min(capacity // length, todo)  # no open pack has room: new ones, filled with this length
            packs, pattern = todo // each, ()
            for _ in range(each):
                pattern = (length, pattern)
            open_packs[capacity - each * length].append((packs, pattern))
            todo -= packs * each
    flat = []
    for packs in open_packs.values():
        for count, pattern in packs:
            lengths = []
            while pattern:
                lengths.append(pattern[0])
                pattern = pattern[1]
            flat.append((count, tuple(lengths)))
    return sorted(flat, key=lambda x: (x[1], x[0]), reverse=True)


def rank_ranges(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list[int], list[int]]]:
    """For each length the first ranks of its ranges, and the container of each range's first rank."""
    starts: dict[int, list[int]] = defaultdict(list)
    bases: dict[int, list[int]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    container = 0
    for count, lengths in patterns:
        for length in lengths:
            starts[length].append(given[length])
            bases[length].append(container)
            given[length] += count
        container += count
    return {length: (starts[length], bases[length]) for length in starts}


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """``item, part, n_tokens, container_id``: the container of each item.

    An item larger than ``capacity`` is split into full parts and a rest, numbered from 0;
    no other item is split.  Items of size 0 or null take no room and go to container 0.
    Items of one length are ranked in sets of about ``per_task``, however many there are.
    Repeated items are placed as often as they come.  An empty table gives no row.
    """
    size_of = F.coalesce(F.col(size).cast("long"), F.lit(0))
    parts = items.select(F.col(item), size_of.alias("_size")).select(
        item, "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_size") / capacity) - 1, F.lit(0)).cast("long"))).alias("part")
    )
    parts = parts.select(item, "part", F.least(F.col("_size") - F.col("part") * capacity, F.lit(capacity)).alias("n_tokens"))
    # at most capacity rows come to the driver
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in parts.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    spreads = F.from_json(F.lit(json.dumps([-(-histogram.get(n, 1) // per_task) for n in range(capacity + 1)])), "array<bigint>")
    parts = parts.withColumn("_spread", F.pmod(F.xxhash64(item, "part"), F.get(spreads, F.col("n_tokens").cast("int"))))
    cells = parts.groupBy("n_tokens", "_spread").agg(F.count("*").alias("_n"))
    ranges = rank_ranges(pack_histogram(histogram, capacity))
    ranges[0] = ([0], [0])
    spark = items.sparkSession
    table = spark.createDataFrame([(n, s, b) for n, (s, b) in ranges.items()], "n_tokens long, _starts array<long>, _bases array<long>")
    offset = Window.partitionBy("n_tokens").orderBy("_spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_offset", F.coalesce(F.sum("_n").over(offset), F.lit(0))).drop("_n").join(table, "n_tokens")
    place = Window.partitionBy("n_tokens", "_spread").orderBy(item, "part")
    ranked = parts.withColumn("_place", F.row_number().over(place) - 1).join(offsets, ["n_tokens", "_spread"])
    rank = F.col("_offset") + F.col("_place")
    # binary search of the last range that starts at or before the rank
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.size("_starts") + 1)), F.lit(1)).cast("int"))
    span = F.struct(F.lit(0).alias("lo"), F.size("_starts").alias("hi"))

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["hi"] - s["lo"] <= 1, s).when(F.get("_starts", middle) <= F.col("_rank"), F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    found = F.aggregate(steps, span, halve, lambda s: s["lo"])
    placed = ranked.withColumn("_rank", rank).withColumn("_range", found)
    container = F.when(F.col("n_tokens") == 0, F.lit(0).cast("long")).otherwise(F.get("_bases", "_range") + F.col("_rank") - F.get("_starts", "_range"))
    return placed.select(item, F.col("part").cast("int").alias("part"), "n_tokens", container.alias("container_id"))
