"""Problem 5: freely typed values mapped to the entries of a reference list.

Method: prefix-filter set-similarity join.  Each value and each entry becomes a set of
letter pairs of its spelling skeleton.  Tokens are ordered by global rarity; two sets
whose Jaccard similarity reaches ``threshold`` share a token within their rarest
``n - ceil(threshold * n) + 1`` tokens, so only those prefixes are joined.  Length and
positional filters drop candidates, Jaccard is computed exactly on the rest, the best
entry is kept.  An exact check follows: the number must be the same and the skeletons
at most a typing error apart; otherwise the value is reported as unmatched.

The join runs over distinct values, never over rows, so a value that a third of all rows
hold costs what a rare one costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickstream.llm.skeleton import damerau_close, skeleton, tidy, without_lookalikes

UNMATCHED = -1
THRESHOLD = 0.3

# Words before (or after) a place name that aren't part of it.
PLACE_WORDS = (
    "кв|квартал|жк|ж\\.? ?к|зк|р-н|район|с|село|гр|град|м|м-т|местност|в\\.? ?з|вз|вилна зона"
    "|kv|kvartal|zhk|jk|j\\.? ?k|zh\\.? ?k|r-n|rayon|s|selo|gr|grad|m|m-t|mestnost|v\\.? ?z"
)
CITY_WORDS = "гр(?:ад)?\\.? ?|gr(?:ad)?\\.? ?"
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}


NUMBERED = "(?i)^(.*?)[ .№-]*(?:(?<![0-9])([0-9]{1,3})|(?<=[ -])([IVX]{1,4}))(?: ?-? ?(?:ч|част|ch|та|ра|ва|и|ти|ви))?\\.?$"


def _with_number(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_named`` (``text`` without its closing number) and ``_number`` (its digits, '' if none)."""
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return (
        rows.withColumn("_arabic", F.regexp_replace(F.regexp_extract(text, NUMBERED, 2), "^0+(?=.)", ""))
        .withColumn("_roman", F.coalesce(F.element_at(roman, F.lower(F.regexp_extract(text, NUMBERED, 3))), F.lit("")))
        .withColumn("_number", F.concat("_arabic", "_roman"))
        .withColumn("_named", F.when(F.col("_number") != "", F.regexp_extract(text, NUMBERED, 1)).otherwise(F.col(text)))
        .drop("_arabic", "_roman")
    )


def _forms(values: DataFrame, value: str, cities: Sequence[str]) -> DataFrame:
    """``value`` with the spellings to compare: without the city, with and without a leading place word."""
    text = tidy(F.col(value))
    if cities:
        text = F.regexp_replace(text, f"(?iu)(?:^|(?<=[\\s,;-]))(?:{CITY_WORDS})?(?:{'|'.join(cities)})(?=$|[\\s,;-])", " ")
    rows = values.withColumn("_text", text)
    rows = rows.withColumn("_text", F.trim(F.regexp_replace("_text", "(?iu)^[\\s,;.:-]+|[\\s,;:-]+(?:район|квартал|rayon)?[\\s,;:-]*$", "")))
    rows = _with_number(rows, "_text").withColumn("_lower", F.lower(without_lookalikes(F.col("_named"))))
    bare = F.regexp_replace("_lower", f"(?iu)^(?:{PLACE_WORDS})(?:\\.|\\s)\\s*", "")
    letters = lambda c: skeleton(F.regexp_replace(c, "[\\s.,'’\"„“”()/_-]+", ""))
    both = F.array_distinct(F.transform(F.array(bare, F.col("_lower")), letters))
    return rows.withColumn("_form", F.explode(both)).filter(F.length("_form") > 1).select(value, "_form", "_number")


def _entry_forms(entries: DataFrame, entry_id: str, name: str) -> DataFrame:
    """Entries with their skeleton and, for names of two words, those with a shortened first word."""
    rows = _with_number(entries.withColumn("_tidy", tidy(F.col(name))), "_tidy")
    words = F.split(F.lower("_named"), " ")
    short = F.when(
        F.size(words) == 2,
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: skeleton(F.concat(F.substring(words[0], F.lit(1), k), words[1]))),
    ).otherwise(F.array().cast("array<string>"))
    full = skeleton(F.array_join(words, ""))
    forms = rows.select(
        F.col(entry_id).alias("_entry"),
        "_number",
        F.explode(F.array_distinct(F.concat(F.array(full), short))).alias("_form"),
        full.alias("_full"),
    )
    shared = Window.partitionBy("_number", "_form")
    # a shortening that two entries share names neither of them
    return (
        forms.withColumn("_owners", F.size(F.collect_set("_entry").over(shared)))
        .filter((F.col("_owners") == 1) | (F.col("_form") == F.col("_full")))
        .select("_entry", "_number", "_form", (F.col("_form") != F.col("_full")).alias("_short"))
    )


def _tokens(form: Column, number: Column) -> Column:
    """Set of letter pairs of a form with its ends marked, and its number as one token."""
    framed = F.concat(F.lit("^"), form, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(framed) - 1), lambda i: F.substring(framed, i, F.lit(2)))
    return F.array_distinct(F.concat(pairs, F.array(F.concat(F.lit("#"), number))))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows whose token sets reach a Jaccard similarity of ``threshold``.

    Both sides: ``_key`` (unique), ``_tokens`` (array of strings, a set).  Returns
    ``left_key, right_key, similarity``; every pair that reaches the threshold comes out.
    Empty sets match nothing.  The rarity table has one row per different token.
    """
    both = left.select("_tokens").unionByName(right.select("_tokens"))
    rarity = both.select(F.explode("_tokens").alias("_token")).groupBy("_token").agg(F.count("*").alias("_freq"))

    def prefixes(side: DataFrame, tag: str) -> DataFrame:
        size = F.size("_tokens")
        ordered = (
            side.select("_key", F.explode("_tokens").alias("_token"))
            .join(rarity, "_token")
            .groupBy("_key")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_freq", "_token"))), lambda x: x["_token"]).alias("_tokens"))
        )
        keep = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
        return ordered.select(
            F.col("_key").alias(f"{tag}_key"),
            F.col("_tokens").alias(f"{tag}_tokens"),
            F.posexplode(F.slice("_tokens", 1, keep)).alias(f"{tag}_pos", "_token"),
        )

    a, b = prefixes(left, "left"), prefixes(right, "right")
    na, nb = F.size("left_tokens"), F.size("right_tokens")
    need = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)
    possible = 1 + F.least(na - F.col("left_pos"), nb - F.col("right_pos")) - 1
    overlap = F.size(F.array_intersect("left_tokens", "right_tokens"))
    return (
        a.join(b, "_token")
        .filter((na >= nb * threshold) & (nb >= na * threshold) & (possible >= need))
        .withColumn("similarity", overlap / (na + nb - overlap))
        .filter(F.col("similarity") >= threshold - 1e-12)
        .groupBy("left_key", "right_key")
        .agg(F.max("similarity").alias("similarity"))
    )


def map_values(values: DataFrame, value: str, entries: DataFrame, entry_id: str, name: str, threshold: float = THRESHOLD, cities: Sequence[str] = ()) -> DataFrame:
    """Each distinct ``value`` with the entry it means: ``value, entry_id, similarity``.

    Defined results: null and blank values give no row; a value that equals a name
    exactly gives that entry with similarity 1; a value that means no entry, or two
    entries equally, gives ``UNMATCHED`` with the best similarity found (0 if none).
    An empty reference list leaves every value unmatched.  ``cities`` are spellings of the
    city whose places these are; it may stand beside a value and is no part of it.
    """
    entries = entries.select(F.col(entry_id).cast("long").alias("_id"), F.col(name).alias("_name")).filter(F.trim("_name") != "")
    distinct = values.select(F.col(value).alias("_value")).filter(F.length(tidy(F.col("_value"))) > 0).distinct()
    forms = _forms(distinct, "_value", cities)
    targets = _entry_forms(entries, "_id", "_name")
    key = F.concat_ws("\u0001", "_form", "_number")
    left = forms.select(key.alias("_key"), _tokens(F.col("_form"), F.col("_number")).alias("_tokens")).distinct()
    right = targets.select(key.alias("_key"), _tokens(F.col("_form"), F.col("_number")).alias("_tokens")).distinct()
    pairs = similarity_join(left, right, threshold)
    part = lambda c, k: F.split(c, "\u0001")[k]
    l, r = F.col("left_key"), F.col("right_key")
    fine = (part(l, 1) == part(r, 1)) & F.when(F.col("_short"), l == r).otherwise(damerau_close(part(l, 0), part(r, 0)))
    scored = (
        pairs.join(targets.withColumn("right_key", key).select("right_key", "_entry", "_short").distinct(), "right_key")
        .withColumn("_fine", fine)
        .withColumn("_edits", F.levenshtein(part(l, 0), part(r, 0)))
    )
    judged = (
        forms.withColumn("left_key", key)
        .join(scored, "left_key", "left")
        .groupBy("_value", "_entry")
        .agg(
            F.max(F.coalesce("_fine", F.lit(False))).alias("_fine"),
            F.max(F.struct(F.when(F.col("_fine"), -F.col("_edits")).alias("e"), F.coalesce("similarity", F.lit(0.0)).alias("s"))).alias("_rank"),
        )
        .groupBy("_value")
        .agg(
            F.max(F.when(F.col("_fine"), F.col("_rank"))).alias("_top"),
            F.collect_list(F.when(F.col("_fine"), F.struct(F.col("_rank").alias("rank"), F.col("_entry").alias("entry")))).alias("_all"),
            F.max(F.col("_rank.s")).alias("_best"),
        )
    )
    winners = F.filter("_all", lambda x: x["rank"] == F.col("_top"))
    return judged.select(
        F.col("_value").alias(value),
        F.when(F.size(winners) == 1, winners[0]["entry"]).otherwise(F.lit(UNMATCHED).cast("long")).alias("entry_id"),
        F.when(F.size(winners) == 1, F.col("_top.s")).otherwise(F.col("_best")).alias("similarity"),
    )


def map_rows(rows: DataFrame, row_id: str, value: str, entries: DataFrame, entry_id: str, name: str, threshold: float = THRESHOLD, cities: Sequence[str] = ()) -> DataFrame:
    """``row_id, entry_id`` of each row whose value is neither null nor blank nor exactly a name.

    Rows keep their number: repeated ids come out as often as they go in.  Other columns
    of ``rows`` are ignored, whatever their names.
    """
    typed = rows.select(F.col(row_id).alias("_row"), F.col(value).alias("_value")).filter(F.length(tidy(F.col("_value"))) > 0)
    names = entries.select(F.col(name).alias("_value")).filter(F.col("_value").isNotNull()).distinct()
    unknown = typed.join(names, "_value", "left_anti")
    mapped = map_values(unknown, "_value", entries, entry_id, name, threshold, cities)
    return unknown.join(mapped, "_value", "left").select(
        F.col("_row").alias(row_id), F.coalesce("entry_id", F.lit(UNMATCHED).cast("long")).alias("entry_id")
    )
