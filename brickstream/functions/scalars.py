"""Scalar functions as column expressions; all of them stay in the JVM.

Null in, null out unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Place prefixes and suffixes that a normalised name loses, in this order.
PLACE_PREFIXES = ("гр. ", "кв. ", "ж.к. ", "жк ", "м-т ", "в.з. ", "с. ", "р-н ")
MONTHS_BG = ("януари", "февруари", "март", "април", "май", "юни", "юли", "август", "септември", "октомври", "ноември", "декември")


def number(value: Column) -> Column:
    """A double with NaN as null."""
    return F.when(~F.isnan(value), value)


def normalize_place(name: Column) -> Column:
    """Lower-case place name without its prefixes; empty and null are ``unknown``."""
    bare = reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), PLACE_PREFIXES, F.lower(F.trim(F.replace(name, F.lit("\u00a0"), F.lit(" ")))))
    bare = F.trim(F.replace(bare, F.lit("  "), F.lit(" ")))
    return F.when(F.coalesce(bare, F.lit("")) == "", "unknown").otherwise(bare)


def round_area(area: Column) -> Column:
    """Area to the nearest 5, halves to even; null, NaN and non-positive are 0."""
    return F.when(F.coalesce(number(area), F.lit(0.0)) <= 0, F.lit(0)).otherwise(F.bround(area / 5).cast("int") * 5).cast("int")


def price_band(price: Column) -> Column:
    """Price rounded to a band of about 5 % (at least 5,000), as text; ``unknown`` without a price."""
    band = F.greatest(F.lit(5000.0), F.bround(price * 0.05 / 5000) * 5000)
    return F.when(F.coalesce(number(price), F.lit(0.0)) <= 0, F.lit("unknown")).otherwise((F.bround(price / band) * band).cast("long").cast("string"))


def rooms_key(rooms: Column, property_type: Column) -> Column:
    return F.when((F.coalesce(rooms, F.lit(0)) == 0) & (property_type == "studio"), F.lit(1)).otherwise(F.coalesce(rooms, F.lit(0)))


def fingerprint(place: Column, area: Column, rooms: Column, property_type: Column, price: Column, kind: Column) -> Column:
    """Key under which listings of one property meet."""
    return F.concat_ws("_", normalize_place(place), round_area(area).cast("string"), rooms_key(rooms, property_type).cast("string"), price_band(price), F.coalesce(kind, F.lit("sale")))


def canonical_id(key: Column) -> Column:
    return F.substring(F.md5(key), 1, 16)


def lookup(value: Column, table: dict[str, int], default: int) -> Column:
    """Value of a small literal table, or ``default``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), value), F.lit(default)) if entries else F.lit(default)


def phone(raw: Column) -> Column:
    """Bulgarian number as ``+359...``; null if its digits can't be one."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    digits = (
        F.when(digits.startswith("00359"), F.substring(digits, 3, 30))
        .when(digits.startswith("359"), digits)
        .when(digits.startswith("0"), F.concat(F.lit("359"), F.substring(digits, 2, 30)))
        .when(F.length(digits).between(8, 9), F.concat(F.lit("359"), digits))
        .otherwise(digits)
    )
    return F.when(digits.startswith("359") & F.length(digits).between(11, 12), F.concat(F.lit("+"), digits))


def email(raw: Column) -> Column:
    """Trimmed lower-case address, or null if it has not the form of one."""
    text = F.lower(F.trim(raw))
    return F.when(text.rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"), text)


def localized_number(text: Column) -> Column:
    """Number with blanks or dots between thousands and a comma before decimals."""
    bare = F.regexp_replace(text, "[\\s\\u00A0€]|лв\\.?|EUR", "")
    bare = F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    return bare.try_cast("double")


def first_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).try_cast("int")


def to_eur(amount: Column, currency: Column, rate: float) -> Column:
    """Amount in euro; leva are divided by the fixed rate, other labels pass."""
    return F.when(F.lower(currency).rlike("^(лв|bgn|lev)"), amount / rate).otherwise(amount)


def per_sqm(price: Column, area: Column) -> Column:
    """Price per square metre to the cent; null without an area."""
    return F.when(number(area) > 0, F.round(number(price) / area, 2))


def decade(year: Column) -> Column:
    """``<1960``, ``>=2020``, the decade, or ``unknown`` (null and 0)."""
    return (
        F.when(F.coalesce(year, F.lit(0)) == 0, "unknown").when(year < 1960, "<1960").when(year >= 2020, ">=2020").otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))
    )


def json_text(blob: Column, path: str, limit: int = 80) -> Column:
    """Lower-case text at a path of a JSON blob; malformed or missing is ``unknown``."""
    text = F.substring(F.lower(F.trim(F.get_json_object(blob, path))), 1, limit)
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(text)


def json_list(blob: Column) -> Column:
    """Array of strings of a JSON blob; malformed gives an empty array."""
    return F.coalesce(F.from_json(blob, "array<string>"), F.array().cast("array<string>"))


def rooms_bucket(rooms: Column) -> Column:
    return F.when(rooms.isNull(), "all").when(rooms >= 4, "4+").otherwise(F.greatest(rooms, F.lit(1)).cast("string"))


def size_bucket(area: Column) -> Column:
    """Size class by the cut points 45, 60, 80, 100 and 130."""
    out = F.lit("130+")
    for cut, label in ((130, "100-130"), (100, "80-100"), (80, "60-80"), (60, "45-60"), (45, "<45")):
        out = F.when(area < cut, label).otherwise(out)
    return F.when(number(area).isNotNull(), out)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days from one time to another, never below 0."""
    return F.greatest(F.lit(0), F.timestamp_diff("DAY", earlier, later)).cast("int")


def change_pct(new: Column, old: Column, digits: int = 2) -> Column:
    """Percent change; null without an old value or with 0."""
    return F.round((new - old) / F.nullif(old, F.lit(0.0)) * 100, digits)


def direction(pct: Column, edge: float, missing: str | None = None) -> Column:
    return F.when(pct.isNull(), F.lit(missing)).when(pct > edge, "up").when(pct < -edge, "down").otherwise("stable")


def photo_count(count: Column, urls: Column, single: Column) -> Column:
    """Stored count, else length of the JSON list, else 1 or 0 by the single link."""
    return F.coalesce(count, F.json_array_length(urls), F.when(single.isNotNull(), 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 16-digit hexadecimal hashes."""
    halves = lambda h, i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    return F.bit_count(halves(a, 1).bitwiseXOR(halves(b, 1))) + F.bit_count(halves(a, 9).bitwiseXOR(halves(b, 9)))


def materially_different(place_a: Column, place_b: Column, price_a: Column, price_b: Column, share: float) -> Column:
    gap = F.abs(price_a - price_b) / F.greatest(price_a, price_b)
    return ~place_a.eqNullSafe(place_b) | F.coalesce(gap >= share, F.lit(False))


def identity(canonical: Column, source: Column, source_id: Column) -> Column:
    return F.coalesce(F.nullif(canonical, F.lit("")), F.concat(source, F.lit(":"), source_id))


def notice_date(text: Column) -> Column:
    """Date in ISO, dotted or slashed form or with a Bulgarian month name; null if none fits."""
    iso = F.regexp_extract(text, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    dotted = F.regexp_extract(text, "([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})", 1)
    named = "(?iU)([0-9]{1,2})\\s+(" + "|".join(MONTHS_BG) + ")\\s+([0-9]{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS_BG]), F.lower(F.regexp_extract(text, named, 2)))
    worded = F.concat_ws("-", F.regexp_extract(text, named, 3), month.cast("string"), F.regexp_extract(text, named, 1))
    return F.coalesce(
        F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"),
        F.try_to_date(F.nullif(F.replace(dotted, F.lit("/"), F.lit(".")), F.lit("")), "d.M.yyyy"),
        F.when(month > 0, F.try_to_date(worded, "yyyy-M-d")),
    )


def clean_url(url: Column) -> Column:
    """Link without query, fragment and closing slash."""
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")


def url_key(url: Column) -> Column:
    """Last path part if it is a slug, else a digest of the link."""
    last = F.regexp_extract(clean_url(url), "/([^/]+)$", 1)
    return F.when(last.rlike("^[A-Za-z0-9_-]{3,}$"), last).otherwise(F.substring(F.sha2(url, 256), 1, 24))


def response_state(status: Column, body: Column, gone_marks: str) -> Column:
    """``gone`` for 404, 410 or a mark in the body, ``unknown`` for other errors, else ``live``."""
    return F.when(status.isin(404, 410), "gone").when(status.isNull() | (status >= 400), "unknown").when(F.coalesce(body, F.lit("")).rlike(gone_marks), "gone").otherwise("live")


def thousands(value: Column) -> Column:
    return F.regexp_replace(F.format_number(value, 0), ",", " ")


def ago(moment: Column, now: Column) -> Column:
    d = F.timestamp_diff("DAY", moment, now)
    steps = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(d <= 0, "today").when(d == 1, "yesterday").when(d < 7, steps(d, "d ago")).when(d < 30, steps(d / 7, "w ago")).otherwise(steps(d / 30, "mo ago"))


def clip_list(values: Column, allowed: tuple[str, ...], limit: int = 12) -> Column:
    """Array without values that aren't allowed, at most ``limit`` of them; null is empty."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isin(*allowed))
    return F.slice(kept, 1, limit)


def case_number(text: Column) -> Column:
    """Number after the words for an execution case, without blanks; null if none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, "(?iU)изп\\.?\\s*дело\\s*№?\\s*([0-9][0-9 /-]*[0-9])", 1), " ", ""), F.lit(""))


def decision_number(text: Column) -> Column:
    """Number after the words for a decision or an auction; null if none."""
    return F.nullif(F.regexp_extract(text, "(?iU)(?:решение|търг)\\s*№\\s*([0-9А-Яа-я/-]+)", 1), F.lit(""))


def date_window(text: Column) -> Column:
    """Struct of ``start`` and ``end`` (the end of its day) of a span written "от d.m.y до d.m.y"."""
    part = lambda k: F.try_to_date(F.nullif(F.regexp_extract(text, "(?iU)от\\s+([0-9.]+)\\D*?\\s+до\\s+([0-9.]+[0-9])", k), F.lit("")), "d.M.yyyy").cast("timestamp_ntz")
    return F.struct(part(1).alias("start"), (part(2) + F.expr("INTERVAL 86399 SECONDS")).alias("end"))


def place_in_text(text: Column, names: list[str]) -> Column:
    """The longest of the ``names`` that stands in a text as a word; ``Unknown`` if none does."""
    import re

    ordered = sorted((n for n in names if n), key=lambda n: (-len(n), n))
    found = F.lit("Unknown")
    for n in reversed(ordered):
        found = F.when(text.rlike(f"(?iU)(?<![\\p{{L}}\\p{{N}}]){re.escape(n)}(?![\\p{{L}}\\p{{N}}])"), n).otherwise(found)
    return found


# Latin spellings of Bulgarian sounds, groups first; the letters after them one by one.
LATIN_GROUPS = (("sht", "щ"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("ja", "я"), ("ju", "ю"))
LATIN_LETTERS = "abvgdezijklmnoprstufhcyw"
CYRILLIC_LETTERS = "абвгдезижклмнопрстуфхцъв"
LATIN_NAMES = (("center", "Център"), ("lulin", "Люлин"))
JUNK_NAME = "(?iu)снимки|продава|обява|€|лв\\.|кв\\.?\\s*м"
LONGEST_NAME = 40


def cyrillic_word(latin: Column) -> Column:
    """Lower-case Latin spelling in Cyrillic; ``ts`` is one letter unless ``k`` follows."""
    text = F.regexp_replace(latin, "ts(?!k)", "ц")
    text = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), LATIN_GROUPS, text)
    return F.replace(F.replace(F.translate(text, LATIN_LETTERS, CYRILLIC_LETTERS), F.lit("x"), F.lit("кс")), F.lit("q"), F.lit("к"))


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000)))


def place_form(name: Column, city: str) -> Column:
    """A typed place without prefix and closing signs, in Cyrillic; null for empty, overlong and junk names.

    ``city`` is a Latin city name that may stand before the place.
    """
    bare = F.trim(F.regexp_replace(F.trim(F.replace(name, F.lit("\u00a0"), F.lit(" "))), "(?iu)^(?:гр|с|ж\\.?к|кв|м-т)\\.?\\s+", ""))
    bare = F.trim(F.regexp_replace(bare, "[.,;: ]+$", ""))
    inside = F.trim(F.regexp_replace(bare, f"(?i)^{city}\\s+", ""))
    latin = F.when(inside == "", bare).otherwise(inside)
    spelled = cyrillic_word(F.lower(latin))
    for word, known in reversed(LATIN_NAMES):
        rest = F.substring(latin, len(word) + 1, 1_000)
        spelled = F.when((F.lower(latin) == word) | F.lower(latin).startswith(word + " "), F.concat(F.lit(known), rest)).otherwise(spelled)
    form = F.regexp_replace(F.when(bare.rlike("[а-яА-Я]"), bare).otherwise(spelled), "\\s+", " ")
    return F.when((F.coalesce(bare, F.lit("")) != "") & (F.length(bare) <= LONGEST_NAME) & ~bare.rlike(JUNK_NAME), form)


def stepped(value: Column, steps: tuple[tuple[float, int], ...], upward: bool) -> Column:
    """Points of the first step that the value reaches (``upward``) or doesn't exceed; else 0."""
    out = F.lit(0)
    for edge, points in reversed(steps):
        out = F.when(value >= edge if upward else value <= edge, points).otherwise(out)
    return out


def motivation(changes: Column, first_price: Column, price: Column, days_since_cut: Column, days: Column, median_days: Column) -> Column:
    """How motivated a seller seems, 0 to 100, of four capped parts; what isn't known adds nothing."""
    often = F.least(F.greatest(F.coalesce(changes, F.lit(0)), F.lit(0)) * 8, F.lit(25))
    cut = F.when((first_price > 0) & price.isNotNull(), F.greatest(F.lit(0.0), (first_price - price) / first_price * 100)).otherwise(0.0)
    recent = F.when((F.coalesce(changes, F.lit(0)) > 0) & days_since_cut.isNotNull(), stepped(days_since_cut, ((7, 20), (30, 14), (60, 7)), False)).otherwise(0)
    long = F.when(median_days > 0, stepped(days / median_days, ((2, 25), (1.5, 18), (1, 10)), True)).otherwise(0)
    return F.least(F.lit(100), F.floor(often + F.least(cut * 1.5, F.lit(30)) + recent + long + 0.5)).cast("int")


def pulse(new: Column, gone: Column, ratio: Column) -> Column:
    """One sentence of the week's new and gone rows."""
    text = F.concat(F.format_number(new, 0), F.lit(" new and "), F.format_number(gone, 0), F.lit(" gone this week"))
    return F.concat(text, F.coalesce(F.concat(F.lit(", ratio "), F.format_number(ratio, 2)), F.lit("")))


def attributes_in_text(text: Column) -> list[Column]:
    """``rooms, floor, total_floors, construction, heating, year, furnishing`` that a lower-case text tells; null if none."""
    first = lambda pattern, k=1: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int")
    has = text.contains
    words = (("1-стаен|едностаен", 1), ("2-стаен|двустаен", 2), ("3-стаен|тристаен", 3), ("4-стаен|четиристаен", 4), ("многостаен", 5))
    floors = "([0-9]+)(?:-ти|-ви|-ри)?\\s*ет\\.?\\s*от\\s*([0-9]+)"
    year = first("(?:експлоатация|въведен в)\\s*([0-9]{4})\\s*г")
    ground = has("партер")
    return [
        F.coalesce(*[F.when(text.rlike(w), n) for w, n in words]).alias("rooms"),
        F.when(ground, 0).otherwise(first(floors)).alias("floor"),
        F.when(ground, first("от\\s*([0-9]+)")).otherwise(first(floors, 2)).alias("total_floors"),
        F.when(has("тухла"), "brick").when(has("панел"), "panel").when(has("епк"), "epk").alias("construction"),
        F.when(has("тец"), "central").when(has("лок") & has("отопл"), "local").when(has("газ"), "gas").when(has("електр"), "electric").alias("heating"),
        F.when(year.between(1950, 2030), year).alias("year"),
        F.when(has("необзаведен"), "unfurnished").when(has("обзаведен") & has("полу"), "partial").when(has("обзаведен"), "furnished").alias("furnishing"),
    ]


def clipped(text: Column, longest: int) -> Column:
    """Text of at most ``longest`` letters, longer ones cut with three dots at the end."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def image_link(path: Column, name: Column, prefix: str, suffix: str = ".jpg") -> Column:
    """Absolute link from the parts of a path; null without a name."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", ""), F.lit("/"), name, F.lit(suffix)))


def token_cost(fresh: Column, written: Column, cached: Column, out: Column, price_in: float, price_out: float) -> Column:
    """Price of one call in millionths of tokens: writing to a cache costs 1.25, reading from it 0.1."""
    return (fresh * price_in + written * price_in * 1.25 + cached * price_in * 0.1 + out * price_out) / 1e6


def numbers_only(text: Column) -> Column:
    """Number of a text with separators and signs around it; range signs make it null."""
    return F.when(~text.rlike("[<>≤≥]"), localized_number(text))


def backfilled_first_price(first: Column, price: Column) -> Column:
    """First price, or the current one where a table older than the column has none."""
    return F.coalesce(number(first), number(price))
