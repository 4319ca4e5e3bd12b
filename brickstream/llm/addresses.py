"""Problem 4: the same postal address written differently.

Method: top-down hierarchy matching.  An address is read into levels: region (city),
locality (quarter), street or complex, number with its letter, unit (entrance, floor,
flat).  Regions are linked by their sound.  Each further level is linked within the one above
it, by a dictionary that is built from all addresses: frequent spellings are names, rarer ones within one typing error (numbers
in names must agree) link to them.  Then shortened first names and bare last names link
to the full names that they fit.  A missing level inherits its candidates: an address
without a region has the home region, or without one the regions in which its street is
known; one without a locality has the localities in which its street is known.  A level
with more than one candidate stays ambiguous, with all of them listed, and names no building.

Where street names are unique in a region (``unique_streets``, as in the project's data),
a street lies in many localities and a locality parts no buildings; otherwise it does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickstream.llm.skeleton import coarse, damerau_close, let, skeleton, tidy, words_without_lookalikes
from brickstream.session import written

# Words of each level as they are written in addresses.
COMPLEX_WORDS = "комплекс|к-с|ж\\.? ?к|complex|zh\\.? ?k|j\\.? ?k"
STREET_WORDS = (
    "улица|ул|булевард|бул|площад|пл|комплекс|к-с|ж\\.? ?к|ulitsa|ulica|ul|bulevard|boulevard|blvd|bul"
    "|street|str|square|sq|ploshtad|pl|complex|zh\\.? ?k|j\\.? ?k"
)
STREET_WORDS_AFTER = "street|str|st|boulevard|blvd|square|sq"
BLOCK_WORDS = "блок|бл|block|bl"
NUMBER_WORDS = "№|no|nr|n|номер|" + BLOCK_WORDS
ENTRANCE_WORDS = "вход|вх|entrance|entr|ent|vhod|vh"
FLOOR_WORDS = "етаж|ет|floor|fl|et|etazh"
FLAT_WORDS = "апартамент|ап|apartment|apt|ap|офис|office"
LOCALITY_WORDS = "квартал|кв|район|р-н|kvartal|kv|rayon|r-n|quarter|district"
REGION_WORDS = "град|гр|grad|gr|city of"
MARGIN = 4  # a spelling counts as another's typing error if the other is this many times as frequent,
RARE = 4  # or, where it was itself written this often or more,
CLEAR_MARGIN = 20  # this many times

_NAME = "(?:\\d{1,3}-(?:ти|ви|ри|ми|та|ма|ия|th|st|nd|rd)\\s+)?[^\\d,;№()]{2,}?"
_END = "(?=$|[\\s,;.()])"
_NUM = "(\\d+)(?!\\d)(?:\\s?[-/]?\\s?([a-zа-я])(?![a-zа-я.0-9]))?"
_FROM = "(?:^|(?<=[\\s,;.(]))"
NUMBERED = f"(?U)(?:^|[\\s,;(])(?:{COMPLEX_WORDS})(?:\\.\\s*|\\s+)([^\\d,;№()]{{2,}}?\\s?\\d{{1,3}})\\s*,?\\s*(?:{BLOCK_WORDS})\\.?\\s*{_NUM}"
TYPED = f"(?U)(?:^|[\\s,;(])(?:{STREET_WORDS})(?:\\.\\s*|\\s+)({_NAME})\\s*(?:$|,\\s*$|(?:,|\\s)\\s*(?:{NUMBER_WORDS})?\\.?\\s*{_NUM}|(?:,\\s*[^\\d\\s]|;|\\())"
ENGLISH = f"(?U)(?:^|[\\s,;(])(?:(?:{NUMBER_WORDS})\\.?\\s*)?{_NUM}\\s+({_NAME})\\s+(?:{STREET_WORDS_AFTER}){_END}"
NAME_FIRST = f"(?U)^({_NAME})(?:\\s*№\\s*|\\s+(?:{NUMBER_WORDS})\\.?\\s*|\\s+){_NUM}$"
NUMBER_FIRST = f"(?U)^(?:(?:{NUMBER_WORDS})\\.?\\s*)?{_NUM}\\s+({_NAME})$"
READING = "array<struct<name:string,number:string,letter:string,typed:boolean>>"
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12"}


def _unit(words: str) -> str:
    """A unit's word with its value (group 1)."""
    return f"(?U){_FROM}(?:{words})(?:\\.\\s*|\\s+|(?=\\d))(?:№|no\\.?)?\\s*((?:\\d+|[a-zа-я])(?:-?[a-zа-я])?){_END}"


def levels(rows: DataFrame, row_id: str, address: str, cities: Sequence[str] = ()) -> DataFrame:
    """``_id, _text, region, locality, entrance, floor, flat``: the levels that are stated by their words; ``_text`` is the rest.

    ``cities`` are the spellings of the home city, of which the first is its name.  Null
    and digitless addresses give no row, as they name no building.
    """
    text = F.lower(words_without_lookalikes(tidy(F.col(address))))
    out = rows.select(F.col(row_id).alias("_id"), F.col(address).alias("_address")).filter(F.col("_address").rlike("[0-9]"))
    out = out.select("_id", F.regexp_replace(F.lower(words_without_lookalikes(tidy(F.col("_address")))), "[„“”\"«»`´]", " ").alias("_text"))
    for name, words in (("entrance", ENTRANCE_WORDS), ("floor", FLOOR_WORDS), ("flat", FLAT_WORDS)):
        out = out.withColumn(name, F.nullif(F.regexp_extract("_text", _unit(words), 1), F.lit("")))
    out = out.withColumn("_text", F.regexp_replace("_text", _unit(f"{ENTRANCE_WORDS}|{FLOOR_WORDS}|{FLAT_WORDS}"), " , "))
    region = F.lit(None).cast("string")
    if cities:
        known = "|".join(cities)
        city = f"(?U)(?:(?<=^|[\\s,;])\\d{{4}}\\s*,?\\s*)?(?:(?<=^|[\\s,;])(?:{REGION_WORDS})\\.?\\s*)?(?<=^|[\\s,;.])(?:{known}){_END}(?:[\\s,]*\\d{{4}}{_END})?"
        out = out.withColumn("_home", F.col("_text").rlike(city)).withColumn("_text", F.regexp_replace("_text", city, " , "))
        region = F.when(F.col("_home"), skeleton(F.lit(cities[0])))
    stated = lambda words: f"(?U)(?:^|(?<=[\\s,;]))(?:{words})(?:\\.\\s*|\\s+)([^,;]+?)(?=\\s*$|\\s*[,;]|\\s(?:{STREET_WORDS})[.\\s])"
    typed = f"(?U)(?:^|(?<=[\\s,;]))(?:\\d{{4}}\\s*,?\\s*)?(?:{REGION_WORDS})(?:\\.\\s*|\\s+)([^,;\\d]+?)(?=\\s*$|\\s*[,;]|\\s\\d|\\s(?:{STREET_WORDS})[.\\s])(?:\\s\\d{{4}}{_END})?"
    named = F.nullif(F.regexp_extract("_text", typed, 1), F.lit(""))
    out = out.withColumn("region", F.coalesce(region, skeleton(named))).withColumn("_text", F.regexp_replace("_text", typed, " , "))
    out = out.withColumn("locality", F.nullif(F.regexp_extract("_text", stated(LOCALITY_WORDS), 1), F.lit("")))
    out = out.withColumn("_text", F.regexp_replace(F.regexp_replace("_text", stated(LOCALITY_WORDS), " , "), "\\s+", " "))
    rest = F.trim(F.regexp_replace(F.regexp_replace("_text", "(?:\\s*,)+\\s*", ", "), "^[\\s,;.]+|[\\s,;.]+$", ""))
    return out.select("_id", rest.alias("_text"), "region", skeleton(F.col("locality")).alias("locality"), "entrance", "floor", "flat")


def _reading(name: Column, number: Column, letter: Column, typed: bool) -> Column:
    return F.struct(F.trim(name).alias("name"), number.alias("number"), letter.alias("letter"), F.lit(typed).alias("typed"))


def parse(rows: DataFrame, row_id: str, address: str, cities: Sequence[str] = ()) -> DataFrame:
    """:func:`levels` with ``readings`` (name, number, letter, typed) of street and number, and ``parts``, the parts that may be localities."""
    text = levels(rows, row_id, address, cities)
    got = lambda pattern, k: F.regexp_extract("_text", pattern, k)
    text = (
        text.withColumn("_numbered", _reading(got(NUMBERED, 1), got(NUMBERED, 2), got(NUMBERED, 3), True))
        .withColumn("_typed", _reading(got(TYPED, 1), got(TYPED, 2), got(TYPED, 3), True))
        .withColumn("_english", _reading(got(ENGLISH, 3), got(ENGLISH, 1), got(ENGLISH, 2), True))
        .withColumn("_parts", F.split("_text", "\\s*[,;]\\s*"))
    )
    ex = lambda s, pattern, k: F.regexp_extract(s, pattern, k)
    # a part that is only a number belongs to the name in the part before it
    joined = F.filter(
        F.zip_with(
            F.slice("_parts", 1, F.size("_parts") - 1),
            F.slice("_parts", 2, F.size("_parts") - 1),
            lambda a, b: F.when(b.rlike(f"(?U)^(?:(?:{NUMBER_WORDS})\\.?\\s*)?{_NUM}$"), F.concat(a, F.lit(" "), b)),
        ),
        lambda s: s.isNotNull(),
    )
    plain = F.flatten(
        F.transform(
            F.concat("_parts", joined),
            lambda s: F.array(
                _reading(ex(s, NAME_FIRST, 1), ex(s, NAME_FIRST, 2), ex(s, NAME_FIRST, 3), False),
                _reading(ex(s, NUMBER_FIRST, 3), ex(s, NUMBER_FIRST, 1), ex(s, NUMBER_FIRST, 2), False),
            ),
        )
    )
    whole = lambda c: (c["name"] != "") & (c["number"] != "")
    before_street = F.split(F.regexp_replace("_text", f"(?U)\\s(?=(?:{STREET_WORDS})[.\\s])", ", "), "\\s*[,;]\\s*")
    return text.select(
        "_id",
        F.coalesce(coarse(F.col("region")), coarse(skeleton(F.lit(cities[0] if cities else "")))).alias("region"),
        "locality",
        "entrance",
        "floor",
        "flat",
        F.when(whole(F.col("_english")), F.array("_english"))
        .when(whole(F.col("_numbered")), F.array("_numbered"))
        .when(whole(F.col("_typed")), F.array("_typed"))
        .when(F.col("_typed.name") != "", F.array().cast(READING))
        .otherwise(F.array_distinct(F.filter(plain, whole)))
        .alias("readings"),
        F.when(F.col("locality").isNull(), F.filter(before_street, lambda s: s.rlike("[a-zа-я]{3}"))).otherwise(F.array().cast("array<string>")).alias("parts"),
    )


def _name_form(name: Column) -> Column:
    """Skeletons of the first and last word of a street name; ``short`` if the first is shortened or absent.

    A closing number, also a Roman one, belongs to the last word.
    """
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    plain = lambda w: skeleton(F.replace(w, F.lit("."), F.lit("")))

    def form(words: Column) -> Column:
        end = F.when(F.size(words) > 1, F.coalesce(F.element_at(roman, F.element_at(words, -1)), F.nullif(F.regexp_extract(F.element_at(words, -1), "^[0-9]+$", 0), F.lit(""))))
        core = F.when(end.isNotNull(), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
        return let(F.struct(core.alias("k"), F.coalesce(F.concat(F.lit(" "), end), F.lit("")).alias("end")), parts)

    def parts(x: Column) -> Column:
        k = x["k"]
        first = F.element_at(k, -2)
        return F.struct(
            F.when(F.size(k) > 1, F.when(first == "y.", "ä").otherwise(plain(first))).otherwise(F.lit("")).alias("first"),
            F.concat(plain(F.element_at(k, -1)), x["end"]).alias("last"),
            F.when(F.size(k) > 1, first.endswith(".") | (F.length(first) <= 2)).otherwise(F.lit(True)).alias("short"),
        )

    spaced = F.regexp_replace(F.regexp_replace(name, "\\.", ". "), "\\s+", " ")
    return let(F.filter(F.split(spaced, " "), lambda w: F.length(w) > 0), form)


def _deletions(text: Column) -> Column:
    """``text`` and every string made by leaving out one of its letters."""
    n = F.length(text)
    out = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), F.when(n > 0, out).otherwise(F.array().cast("array<string>"))))


def _keys(fine: Column) -> Column:
    """Join keys that two names one typing error apart share, by either skeleton."""
    rough = F.transform(_deletions(coarse(fine)), lambda x: F.concat(F.lit("~"), x))
    return F.concat(_deletions(fine), rough)


def _near(a: Column, b: Column) -> Column:
    number = lambda c: F.regexp_extract(c, " ([0-9]+)$", 1)
    return (number(a) == number(b)) & (damerau_close(a, b, slack_from=99) | damerau_close(coarse(a), coarse(b), slack_from=99))


def _mistyped(rarer: Column, other: Column) -> Column:
    """Whether a spelling written ``rarer`` times may be a typing error of one written ``other`` times."""
    return other >= rarer * F.when(rarer < RARE, MARGIN).otherwise(CLEAR_MARGIN)


def name_links(names: DataFrame, above: str) -> DataFrame:
    """``above, name, n, links``: for each name the frequent names of the same ``above`` that it is a spelling of.

    ``names`` has ``above, name, n`` (how often it was written).  ``links`` are structs
    ``n, name``, most frequent first; empty if the name stands for itself.
    """
    # two romanisations of one name are one, however often each is written
    one_sound = coarse(F.col("a.name")) == coarse(F.col("b.name"))
    first = (F.col("b.n") > F.col("a.n")) | (F.col("b.name") < F.col("a.name"))
    near = names.select(above, "name", "n", F.explode(_keys(F.col("name"))).alias("key"))
    better = (
        near.alias("a")
        .join(near.alias("b"), [F.col(f"a.{above}") == F.col(f"b.{above}"), F.col("a.key") == F.col("b.key")])
        .filter((F.col("a.name") != F.col("b.name")) & (F.col("b.n") >= F.col("a.n")))
        .filter((one_sound & first) | (_mistyped(F.col("a.n"), F.col("b.n")) & _near(F.col("a.name"), F.col("b.name"))))
        .groupBy(F.col(f"a.{above}").alias(above), F.col("a.name").alias("name"))
        .agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("b.n")).alias("n"), F.col("b.name").alias("name")))), lambda x: F.struct((-x["n"]).alias("n"), x["name"].alias("name"))).alias("links"))
    )
    return names.join(better, [above, "name"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<n:bigint,name:string>>")))


def street_links(forms: DataFrame) -> DataFrame:
    """``region, first, last, short, streets, support``: the dictionary streets that each written form may mean.

    ``forms`` has ``region, first, last, short, typed, n`` (how often it was written, with a
    street word).  One street in ``streets`` is a link, more are an ambiguity; ``support`` is
    how often the best of them was written.  Shortened names link to full ones; one that
    fits none is a street of its own if it was written with a street word.
    """
    whole = F.concat_ws(" ", F.nullif("first", F.lit("")), "last")
    full = forms.filter(~F.col("short")).groupBy("region", "first", "last").agg(F.sum("n").alias("n")).withColumn("name", whole)
    linked = name_links(full.select("region", "name", "n"), "region")
    # of several more frequent names the street is clear only if one is far more frequent
    clear = (F.size("links") == 1) | ((F.size("links") > 1) & (F.get("links", F.lit(0))["n"] >= MARGIN * F.get("links", F.lit(1))["n"]))
    streets = F.when(F.size("links") == 0, F.array("name")).when(clear, F.array(F.get("links", F.lit(0))["name"])).otherwise(F.transform("links", lambda x: x["name"]))
    linked = full.select("region", "name", "first", "last").join(linked, ["region", "name"]).select(
        "region", "first", "last", "name", streets.alias("streets"), F.coalesce(F.get("links", F.lit(0))["n"], "n").alias("support"), (F.size("links") == 0).alias("head")
    )
    heads = linked.filter("head").select("region", F.col("name").alias("street"), F.col("first").alias("h_first"), F.col("last").alias("h_last"), F.col("support").alias("h_n"))
    shorts = forms.filter("short").groupBy("region", "first", "last").agg(F.sum("n").alias("n"), F.max("typed").alias("typed"))
    begins = F.col("h_first").startswith(F.col("first")) | coarse(F.col("h_first")).startswith(coarse(F.col("first")))
    fits = (
        shorts.select("region", "first", "last", F.explode(_keys(F.col("last"))).alias("key"))
        .join(heads.select("*", F.explode(_keys(F.col("h_last"))).alias("key")), ["region", "key"])
        .filter(begins & _near(F.col("last"), F.col("h_last")))
        .select("region", "first", "last", "street", "h_n", (coarse(F.col("last")) == coarse(F.col("h_last"))).alias("same"))
        .distinct()
        .groupBy("region", "first", "last")
        .agg(F.collect_list(F.struct("h_n", "street", "same")).alias("_all"))
        # an exact last name goes before a mistyped one; names rare enough to be misspelt are left out beside a frequent one
        .withColumn("_all", F.filter("_all", lambda x: x["same"] == F.array_max(F.transform("_all", lambda y: y["same"]))))
        .withColumn("support", F.array_max(F.transform("_all", lambda x: x["h_n"])))
        .withColumn("streets", F.array_sort(F.transform(F.filter("_all", lambda x: ~_mistyped(x["h_n"], F.col("support")) ), lambda x: x["street"])))
        .select("region", "first", "last", "streets", "support")
    )
    own = shorts.join(fits, ["region", "first", "last"], "left").withColumn("support", F.coalesce("support", "n"))
    own = own.filter(F.col("streets").isNotNull() | F.col("typed")).withColumn("streets", F.coalesce("streets", F.array(whole)))
    columns = ["region", "first", "last", "short", "streets", "support"]
    return linked.withColumn("short", F.lit(False)).select(*columns).unionByName(own.withColumn("short", F.lit(True)).select(*columns))


def _streets(parsed: DataFrame) -> DataFrame:
    """``_id, region, street, streets, number, letter, entrance, floor, flat`` of each address with a street and number."""
    units = ["entrance", "floor", "flat"]
    read = parsed.select("_id", "region", *units, F.explode("readings").alias("c"))
    read = read.select("_id", "region", *units, _name_form(F.col("c.name")).alias("f"), "c.number", "c.letter", "c.typed")
    read = read.select("_id", "region", *units, "f.first", "f.last", "f.short", "number", "letter", "typed").filter("last != '' and (first != '' or typed) and (length(last) > 2 or typed)")
    # written once: the dictionary and the lookup read it
    read = written(read, "readings")
    links = street_links(read.groupBy("region", "first", "last", "short").agg(F.count("*").alias("n"), F.max("typed").alias("typed")))
    reading = F.struct("support", "streets", F.regexp_replace("number", "^0+(?=.)", "").alias("number"), F.translate("letter", "abvgde", "абвгде").alias("letter"), *units, "region")
    found = read.join(links, ["region", "first", "last", "short"]).groupBy("_id").agg(F.collect_set(reading).alias("_all"))
    best = F.filter("_all", lambda x: x["support"] == F.array_max(F.transform("_all", lambda y: y["support"])))
    found = found.withColumn("_all", F.array_sort(best)).select(
        "_id", F.col("_all")[0].alias("r"), F.array_distinct(F.flatten(F.transform("_all", lambda x: x["streets"]))).alias("streets"), F.size(F.array_distinct(F.transform("_all", lambda x: F.struct(x["number"], x["letter"])))).alias("_numbers")
    )
    street = F.when((F.size("streets") == 1) & (F.col("_numbers") == 1), F.col("streets")[0])
    return found.select("_id", F.col("r.region").alias("region"), street.alias("street"), "streets", "r.number", "r.letter", *[f"r.{u}" for u in units])


def _regions(placed: DataFrame, home: bool) -> DataFrame:
    """Adds ``regions``: what an address doesn't state, it inherits from the others of its street, unless there is a home region."""
    if home:
        return placed.withColumn("regions", F.array("region"))
    where = placed.filter("street is not null and region != ''").groupBy("street").agg(F.array_sort(F.collect_set("region")).alias("_where"))
    regions = F.when(F.col("region") != "", F.array("region")).otherwise(F.coalesce("_where", F.array(F.lit(""))))
    return placed.join(where, "street", "left").withColumn("regions", regions)


def _only(candidates: str) -> Column:
    return F.when(F.size(candidates) == 1, F.col(candidates)[0])


def resolve(rows: DataFrame, row_id: str, address: str, cities: Sequence[str] = ()) -> DataFrame:
    """``row_id, region, locality, street, number, letter, entrance, floor, flat, regions, localities, streets``: one row for each address with a street and number.

    ``regions``, ``localities`` and ``streets`` list the candidates of each level; the level
    itself is null where there isn't exactly one.  An address with several readings keeps
    those of the best known street; where they still differ, the street is ambiguous.  A
    repeated id is one address with several readings.  Empty tables give no row.
    """
    # written once: every level reads it
    parsed = written(parse(rows, row_id, address, cities), "addresses")
    # localities within their region: stated ones make the dictionary, parts of the text are looked up in it
    stated = parsed.filter("locality is not null").groupBy("region", F.col("locality").alias("name")).agg(F.count("*").alias("n"))
    localities = name_links(stated, "region").select("region", F.col("name").alias("spelt"), F.coalesce(F.get("links", F.lit(0))["name"], "name").alias("place"))
    spelt = F.array_distinct(F.array_compact(F.concat(F.array("locality"), F.transform("parts", lambda s: skeleton(s)))))
    place = parsed.select("_id", "region", F.explode(spelt).alias("spelt")).join(localities, ["region", "spelt"]).groupBy("_id").agg(F.array_sort(F.collect_set("place")).alias("localities"))
    out = written(_streets(parsed).join(place, "_id", "left"), "streets")
    on_street = out.filter("street is not null and localities is not null").select("region", "street", F.explode("localities").alias("l")).groupBy("region", "street").agg(F.array_sort(F.collect_set("l")).alias("_near"))
    out = _regions(out, bool(cities)).join(on_street, ["region", "street"], "left").withColumn("localities", F.coalesce("localities", "_near", F.array().cast("array<string>")))
    columns = ["street", "number", "letter", "entrance", "floor", "flat", "regions", "localities", "streets"]
    return out.select(F.col("_id").alias(row_id), _only("regions").alias("region"), _only("localities").alias("locality"), *columns)


def buildings(rows: DataFrame, row_id: str, address: str, cities: Sequence[str] = (), unique_streets: bool = True) -> DataFrame:
    """``row_id, building``: the building of each address that names one, as its levels with a bar between; one row for each id.

    Where streets aren't unique in a region, an address with several localities names none.
    """
    if unique_streets:  # localities part nothing, so they aren't linked
        at = _regions(_streets(parse(rows, row_id, address, cities)), bool(cities)).filter("street is not null and size(regions) = 1")
        return at.select(F.col("_id").alias(row_id), F.concat_ws("|", F.col("regions")[0], "street", "number", "letter").alias("building"))
    at = resolve(rows, row_id, address, cities).filter("street is not null and region is not null and size(localities) < 2")
    return at.select(row_id, F.concat_ws("|", "region", F.coalesce("locality", F.lit("")), "street", "number", "letter").alias("building"))


def building_classes(rows: DataFrame, row_id: str, address: str, cities: Sequence[str] = (), unique_streets: bool = True) -> DataFrame:
    """``row_id, building, members``: the building of each address and how many addresses name it; grows as the rows do, not as their pairs."""
    # written once: counted and joined back
    placed = written(buildings(rows, row_id, address, cities, unique_streets), "buildings")
    return placed.join(placed.groupBy("building").agg(F.count("*").alias("members")), "building").select(row_id, "building", "members")


def same_building(rows: DataFrame, row_id: str, address: str, cities: Sequence[str] = (), unique_streets: bool = True) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b``: pairs of rows whose addresses name the same building.

    Null, blank and numberless addresses and ambiguous levels pair with nothing.  Each pair
    comes once, as each id has at most one building.
    """
    placed = written(buildings(rows, row_id, address, cities, unique_streets), "buildings")
    a, b = placed.withColumnRenamed(row_id, "id_a"), placed.withColumnRenamed(row_id, "id_b")
    return a.join(b, "building").filter("id_a < id_b").select("id_a", "id_b")
