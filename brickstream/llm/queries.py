"""Queries of the training-data problems tagged llm, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickstream.llm import addresses, mapping, packing, pii, quantiles, subjects, survivors, tokenize
from brickstream.session import table, written

SHARES = (0.1, 0.25, 0.5, 0.75, 0.9)
CITIES = ("дъбринград", "dabringrad", "dubringrad", "dybringrad")  # the home city of the project's data, by its spellings
PLACE = ["neighborhood", "property_type"]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of price per square metre of every neighborhood and property type."""
    return quantiles.percentiles(quantiles.sketch(table(spark, d, "listings"), PLACE, "price_per_sqm_eur"), PLACE, SHARES)


def p1_snapshot_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The same for every snapshot date."""
    keys = ["snapshot_date", *PLACE]
    return quantiles.percentiles(quantiles.sketch(table(spark, d, "listing_snapshots"), keys, "price_per_sqm_eur"), keys, SHARES)


def p1_merged_dates(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over all dates, from the added sketches of the separate dates."""
    daily = quantiles.sketch(table(spark, d, "listing_snapshots"), ["snapshot_date", *PLACE], "price_per_sqm_eur")
    return quantiles.percentiles(quantiles.merge([daily], PLACE), PLACE, SHARES)


def p1_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile lies within the stated error, judged by exact ranks of all rows."""
    rows = table(spark, d, "listings").filter("price_per_sqm_eur is not null and not isnan(price_per_sqm_eur)")
    found = p1_percentiles(spark, d)
    joined = rows.select(*PLACE, "price_per_sqm_eur").join(
        found, [rows[k].eqNullSafe(found[k]) for k in PLACE]
    ).select(found["neighborhood"], found["property_type"], "price_per_sqm_eur", "n", *[f"p{round(s * 100)}" for s in SHARES])
    checks = []
    for s in SHARES:
        estimate, v = F.col(f"p{round(s * 100)}"), F.col("price_per_sqm_eur")
        slack = F.abs(estimate) * (quantiles.ALPHA * 1.01)
        below, upto = F.count_if(v < estimate - slack), F.count_if(v <= estimate + slack)
        wanted = F.greatest(F.ceil(F.lit(s) * F.max("n") - 1e-9), F.lit(1))
        room = F.greatest(F.max("n") * quantiles.EPSILON, F.lit(1))
        checks.append((below <= wanted - 1 + room) & (upto >= wanted - room))
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return joined.groupBy(*PLACE).agg(F.count("*").alias("n"), ok.alias("within"))


def p1_by_place(spark: SparkSession, d: str) -> DataFrame:
    """The same by the place that each typed neighborhood means (problem 5); -1 is none, null is not stated."""
    listings, places = table(spark, d, "listings"), table(spark, d, "neighborhoods")
    meant = mapping.map_values(listings, "neighborhood", places, "id", "name", cities=CITIES).select(F.col("neighborhood").alias("_typed"), F.col("entry_id").alias("neighborhood_id"))
    keys = ["neighborhood_id", "property_type"]
    rows = listings.select("neighborhood", "property_type", "price_per_sqm_eur").join(meant, F.col("neighborhood") == F.col("_typed"), "left")
    return quantiles.percentiles(quantiles.sketch(rows, keys, "price_per_sqm_eur"), keys, SHARES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "listings"), "id", "description_full")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions and contact columns with typed placeholders."""
    rows = table(spark, d, "listings").select("id", "description_full", "contact_phone", "contact_email")
    return pii.redacted(rows, "description_full", contacts=("contact_phone", "contact_email"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "listings"), table(spark, d, "source_trust"))


def p3_merged(spark: SparkSession, d: str) -> DataFrame:
    """One record per property, built field by field."""
    return survivors.merged(table(spark, d, "listings"), table(spark, d, "source_trust"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_building(table(spark, d, "listings"), "id", "address", CITIES)


def p4_levels(spark: SparkSession, d: str) -> DataFrame:
    """All levels of each address, with the candidates of each level."""
    return addresses.resolve(table(spark, d, "listings"), "id", "address", CITIES)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The building of each address and its size: what the pairs of p4_found say, growing only as the rows do."""
    return addresses.building_classes(table(spark, d, "listings"), "id", "address", CITIES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = mapping.map_rows(table(spark, d, "listings"), "id", "neighborhood", table(spark, d, "neighborhoods"), "id", "name", cities=CITIES)
    return rows.withColumnRenamed("entry_id", "neighborhood_id")


def p5_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value with its entry (-1: none) and similarity."""
    return mapping.map_values(table(spark, d, "listings"), "neighborhood", table(spark, d, "neighborhoods"), "id", "name", cities=CITIES)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encoded(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: the text decoded from its ids."""
    rows = p8_ids(spark, d)
    return rows.select("doc_id", tokenize.decoded(rows, "ids").alias("text"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container of each document, sized in tokens of byte_bpe_50k."""
    documents = table(spark, d, "documents")
    ids = tokenize.encoder(documents, "text")
    # written once: the histogram and the placing both read it
    sizes = written(documents.select("doc_id", F.size(ids(F.col("text"))).alias("n_tokens")), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p9_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing holds: every document placed whole or in full parts, no container over its capacity, at most a hundredth and one container more than the tokens need."""
    documents, placed = table(spark, d, "documents"), written(p9_packing(spark, d), "placed")
    capacity = packing.CAPACITY
    each = placed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"))
    whole = each.select(F.col("doc_id").alias("_doc"), (F.col("parts") == F.greatest(F.ceil(F.col("n") / capacity), F.lit(1))).alias("_whole"))
    kept = documents.select("doc_id").join(whole, F.col("doc_id") == F.col("_doc"), "left").agg(F.count("*").alias("documents"), F.count_if(~F.coalesce("_whole", F.lit(False))).alias("not_whole"))
    loads = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    room = loads.agg(F.count_if(F.col("load") > capacity).alias("overfull"), (F.count("*") <= F.ceil(F.sum("load") / capacity) * 1.01 + 1).alias("filled"))
    one = kept.unionByName(room, allowMissingColumns=True)
    return one.agg(*[F.max(c).alias(c) for c in one.columns])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "subjects"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and share of the corpus of each subject; ``none`` are the documents without any."""
    documents = table(spark, d, "documents").select("doc_id")
    rows = documents.join(p10_found(spark, d), "doc_id", "left").withColumn("subject", F.coalesce("subject", F.lit("none")))
    total = documents.count()
    return rows.groupBy("subject").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / max(total, 1))


def p10_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves with their discriminative terms and the subject that prevails in each."""
    return subjects.leaf_table(table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "subjects"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_percentiles, p1_snapshot_percentiles, p1_merged_dates, p1_within_bound, p1_by_place, p2_found, p2_redacted, p3_found, p3_merged, p4_found, p4_levels, p4_classes, p5_found, p5_mapping,
        p8_ids, p8_decoded, p9_packing, p9_valid, p10_found, p10_composition, p10_leaves,
    )
}

_UNKNOWN = ", ".join(f"'{p}'" for p in survivors.PLACEHOLDERS)


def _known(column: str) -> str:
    return f"coalesce(lower(trim(regexp_replace({column}, '[\\s\\x{{A0}}]+', ' ', 'g'))) NOT IN ({_UNKNOWN}), false)"


_FIELDS = " + ".join([f"CAST(coalesce({c} <> 0, false) AS INT)" for c in survivors.FIELDS[:4]] + [f"CAST({_known(c)} AS INT)" for c in survivors.FIELDS[4:]])

_GROUPED = f"""
    WITH RECURSIVE l AS (SELECT *, CASE WHEN {_known("canonical_id")} THEN trim(canonical_id) END AS key, trim(source_id) AS sid, CASE WHEN {_known("duplicate_of")} THEN trim(duplicate_of) END AS dup, {_FIELDS} AS filled FROM listings),
    n AS (SELECT *, coalesce('c:' || key, 'i:' || id) AS node FROM l),
    e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM n a JOIN n b ON a.dup = b.sid WHERE a.node <> b.node),
    links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(node, other) AS (SELECT DISTINCT node, node FROM n UNION SELECT r.node, x.b FROM reach r JOIN links x ON x.a = r.other),
    g AS (SELECT node, min(other) AS grp FROM reach GROUP BY 1),
    t AS (SELECT source, min(trust_rank) AS r FROM source_trust GROUP BY 1),
    m AS (SELECT n.*, g.grp, count(*) OVER (PARTITION BY g.grp) AS members, row_number() OVER (PARTITION BY g.grp ORDER BY coalesce(t.r, 2147483648), n.filled DESC, n.last_seen DESC NULLS LAST, n.id) AS place FROM n JOIN g USING (node) LEFT JOIN t USING (source))
"""
_MERGED = [f"arg_min({c}, place) FILTER (WHERE coalesce({c} <> 0, false)) AS {c}" for c in survivors.FIELDS[:4]] + [f"arg_min({c}, place) FILTER (WHERE {_known(c)}) AS {c}" for c in survivors.FIELDS[4:]]

ORACLES: dict[str, str] = {
    "p3_found": _GROUPED + "SELECT CASE WHEN grp LIKE 'c:%' THEN substr(grp, 3) END AS canonical_id, id AS survivor_id FROM m WHERE members > 1 AND place = 1",
    "p3_merged": _GROUPED + f'SELECT grp AS "group", count(*) AS n_members, {", ".join(_MERGED)} FROM m GROUP BY 1',
    "p1_within_bound": """
        SELECT neighborhood, property_type, count(*) AS n, true AS within FROM listings
        WHERE price_per_sqm_eur IS NOT NULL AND NOT isnan(price_per_sqm_eur) GROUP BY ALL""",
    "p9_valid": "SELECT count(*) AS documents, 0 AS not_whole, 0 AS overfull, true AS filled FROM documents",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
