"""Problem 2: personal information inside free text, found and replaced by typed placeholders.

Method: anchor expansion.  One Aho-Corasick pass finds anchors (at-signs and the words
used for them, number openings, identifier cues, words before persons, given names, street
words, the beginnings of account numbers and words for cards);
deterministic local parsers expand each anchor to its boundaries and validate it.  Texts
go through in Arrow batches, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDERS = {"phone": "[PHONE]", "email": "[EMAIL]", "idnum": "[IDNUM]", "name": "[NAME]", "addr": "[ADDRESS]", "account": "[ACCOUNT]"}
ORDER = ("email", "account", "idnum", "phone", "addr", "name")  # of items that overlap, the one named first stays

# Anchors.
AT_SIGNS = ("@", "[at]", "(at)", "(а)", "(a)", "{at}", " at ", "(маймунка)", "[маймунка]", "маймунка", "маймунско", "кльомба", "＠")
NUMBER_STARTS = ("+", "00", "08", "02", "03", "04", "05", "06", "07", "09", "(0", "0о", "0o", "о8", "o8")
ID_CUES = ("егн", "личен номер", "л.к.", "лична карта", "за самоличност", "лнч", "id card", "personal number", "identity card", "personal no", "passport no", "паспорт №")
NAME_CUES = (
    "собственик:", "собственикът", "собственичка:", "огледите води", "оглед с", "консултант", "търсете", "съседа", "съседката", "по думи на", "принадлежи на",
    "брокер:", "брокер", "агент:", "агент", "лице за контакт", "за контакт:", "продавач:", "продавачът", "наследникът", "управител:", "domoupravitel", "домоуправител",
    "owner:", "owner is", "ask for", "led by", "belongs to", "agent:", "agent", "broker:", "contact person:", "seller:", "neighbour", "according to", "consultant",
)
# Common given names, and what family names end with.
GIVEN = (
    "александър", "ангел", "андрей", "анна", "антон", "асен", "атанас", "биляна", "бисер", "богдан", "божидар", "борис", "бояна", "валентин", "ваня", "васил", "васила", "велислава", "венелин", "вера", "веселин", "виктор", "виктория", "владимир",
    "гергана", "георги", "даниела", "деница", "десислава", "диана", "димитър", "димо", "добрин", "евгени", "екатерина", "елена", "елица", "емил", "емилия", "ефросина", "живко", "златка", "ивайло", "иван", "иванка", "илия", "ирина", "йордан", "калин", "калоян",
    "камен", "кирил", "красимир", "кристина", "лилия", "лора", "любомир", "людмила", "маргарита", "мариана", "мария", "марин", "мартин", "милен", "милена", "мирослав", "надежда", "наум", "невена", "николай", "никола", "огнян", "олга", "орлин", "павел", "пенка", "петра", "петър", "пламен",
    "радка", "радослав", "ралица", "росица", "румен", "светлана", "симеон", "снежана", "станимир", "стефан", "стефка", "стоян", "таня", "теодора", "тихомир", "тодор", "филип", "христо", "цвета", "цветан", "юлиян", "явор", "яна",
)
GIVEN_ENGLISH = ("john", "james", "robert", "michael", "william", "david", "richard", "thomas", "peter", "paul", "andrew", "mary", "jennifer", "elizabeth", "susan", "sarah", "karen", "emma", "anna", "helen")
FAMILY_END = ("ов", "ова", "ев", "ева", "ски", "ска", "цки", "цка", "ин", "ина", "ov", "ova", "ev", "eva", "ski", "ska", "sky", "in", "ina")
# Words before names that are of places and things, and words after them.
NOT_PERSONS = (
    "паметникът на", "паметник на", "паметника на", "улица", "ул.", "ул", "бул.", "бул", "булевард", "площад", "пл.", "пл", "комплекс", "комплекса", "ж.к.", "жк", "сградата", "сграда", "блок", "парк", "училище", "театър", "музей", "читалище", "болница", "стадион",
    "monument of", "monument to", "street", "str.", "blvd", "boulevard", "square", "sq.", "complex", "building", "park", "school", "ulitsa", "ul.", "bul.", "pl.", "zhk", "statue of", "името на", "named after", "на името",
)
AFTER_PLACES = re.compile(r"\s*(?:[„“”\"«»]|,?\s*(?:№|no\.?\s*)?\d|(?:street|str\.?|st\.|boulevard|blvd|square|sq\.|complex|park|school|building|monument|residences?|tower|house|hotel|резиденс|резиденция|кула)\b)", re.I)
# Cues of accounts, and the country codes that an account number may begin with.
CARD_CUES = ("карта", "card", "visa", "mastercard")
ACCOUNT_COUNTRIES = ("at", "be", "bg", "ch", "cy", "cz", "de", "dk", "ee", "es", "fi", "fr", "gb", "gr", "hr", "hu", "ie", "it", "lt", "lu", "lv", "mt", "nl", "no", "pl", "pt", "ro", "se", "si", "sk")
TITLES = ("г-н", "г-жа", "г-ца", "господин", "госпожа", "арх.", "инж.", "д-р", "адв.", "проф.", "mr.", "mr ", "ms.", "ms ", "mrs.", "mrs ", "miss ", "dr.", "dr ", "eng.", "arch.")
STREETS = (
    "улица", "ул.", "ул ", "булевард", "бул.", "бул ", "площад", "пл.", "пл ", "ulitsa", "ul.", "ul ", "bulevard", "bul.", "bul ", "boulevard", "blvd", "ploshtad", "pl.", "pl ",
    "street", "str.", "square", "sq.", "avenue",
)
COMPLEXES = ("ж.к.", "ж.к", "ж. к.", "жк.", "жк ", "комплекс ", "zhk ", "zhk.", "j.k.", "zh.k.", "complex ")
# Words before numbers that are no phone numbers.
NOT_PHONES = ("кадастрален номер", "разрешение", "оферта №", "offer", "reference", "ref", "реф.", "реф", "код", "еик", "company no.", "парцел", "дело", "sheet", "архив", "№ на обява", "булстат", "ид.", "iban", "фактура №")

_DIGIT = "(?:[0-9]|[OОoо](?![A-NP-Za-np-zА-НП-Яа-нп-я]))"  # a letter o counts where no other letter follows
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._+-]{0,62}[A-Za-z0-9_+-])?$|[A-Za-z0-9]$")
_TIGHT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
_DOT = r"(?:\s+\.\s+|\.|\s*\[dot\]\s*|\s*\(dot\)\s*|\s*\{dot\}\s*|\s+dot\s+|\s+точка\s+|\s*\[точка\]\s*|\s*\(точка\)\s*)"
_LOOSE = re.compile(rf"[A-Za-z0-9][A-Za-z0-9-]{{0,62}}(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]{{0,62}})*?{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])(?:{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9]))*", re.I)
_RUN = re.compile(rf"\(?\+?\(?{_DIGIT}(?:{_DIGIT}|[ \-./()]{{1,3}}(?={_DIGIT}))*")
_ID = re.compile(r"[\s:№#.]*(?:no\.?|№|номер|е|is)?[\s:]*(\d{6}[ -]?\d{4}|\d{10}|\d{9})(?!\d)")
_UPPER = "A-ZА-ЯЀЍ"
_LETTER = "A-Za-zА-Яа-яЀЍѐѝ"
_WORD = rf"[{_UPPER}][{_LETTER}'’]+"
_NAME = re.compile(rf"(?:[{_UPPER}][{_LETTER}]{{0,2}}\.\s?(?:[{_UPPER}]\.\s?)?|{_WORD}[ ]){_WORD}(?:-{_WORD})?(?:[ ]{_WORD}(?:-{_WORD})?){{0,2}}")
_FULL_NAME = re.compile(rf"{_WORD}(?:[ ]{_WORD}(?:-{_WORD})?){{1,2}}(?![{_LETTER}])")
_TITLE = re.compile(r"(?:\s*(?:г-н|г-жа|г-ца|господин|госпожа|арх\.|инж\.|д-р|адв\.|проф\.|mr\.?|mrs\.?|ms\.?|miss|dr\.?|eng\.?|arch\.?)(?=[\s.]))*[\s:,]*", re.I)
_QUOTES = "„“”\"«»'"
_STREET_NAME = rf"[{_QUOTES}]?\s*((?:[{_LETTER}]{{1,4}}\.\s?|[{_LETTER}][{_LETTER}-]*\s+){{0,2}}[{_LETTER}][{_LETTER}-]+)\s*[{_QUOTES}]?"
_NUMBER = rf"(?:№|No\.?|N|номер)?\s*(\d{{1,4}}(?:\s?-\s?[{_LETTER}](?![{_LETTER}])|[{_LETTER}](?![{_LETTER}])|\s[{_UPPER}](?=\s*(?:[,.;)\n]|$)))?)(?![\d{_LETTER}])"
_AFTER_STREET = re.compile(rf"\.?\s*{_STREET_NAME}\s*,?\s*{_NUMBER}")
_AFTER_COMPLEX = re.compile(rf"\.?\s*{_STREET_NAME}\s*,?\s*(?:блок|бл|block|bl)\.?\s*{_NUMBER}", re.I)
_BEFORE_STREET = re.compile(rf"(?<![{_LETTER}\d.,/-])(\d{{1,4}}[{_LETTER}]?|\d{{1,4}}-[{_LETTER}])\s+{_STREET_NAME}\s*$")
_ACCOUNT = re.compile(r"[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
_CARD = re.compile(r"\D{0,12}?((?:\d[ -]?){12,18}\d)(?!\d)")
_SEPARATORS = re.compile(r"[ \-./()]+")


def _lower(text: str) -> str:
    """Lower case that keeps every position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_MACHINES: dict[str, object] = {}  # one automaton for each process


# Latin spelling of the letters of given names.
ROMANISED = dict(zip("абвгдезийклмнопрстуфхъьц", "a b v g d e z i y k l m n o p r s t u f h a y ts".split(), strict=True)) | {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sht", "ю": "yu", "я": "ya"}


def _romanised(name: str) -> str:
    return "".join(ROMANISED[c] for c in name)


def account_number(raw: str) -> str | None:
    """International account number without blanks if its check digits hold, else None."""
    plain = re.sub(r"[ -]", "", raw).upper()
    if not 15 <= len(plain) <= 34:
        return None
    return plain if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else None


def card_number(raw: str) -> str | None:
    """Digits of a card number if they pass the Luhn test, else None."""
    digits = re.sub(r"\D", "", raw)
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return digits if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0 and len(set(digits)) > 1 else None


def _account_at(text: str, start: int) -> tuple[int, int, str] | None:
    m = _ACCOUNT.match(text, start)
    if not m:
        return None
    # the longest beginning, cut at a blank, whose check digits hold
    for end in [m.end(), *[start + b.start() for b in reversed(list(re.finditer(" ", m.group(0))))]]:
        if value := account_number(text[start:end]):
            return start, end, value
    return None


def _person_at(text: str, low: str, start: int, end: int) -> tuple[int, int, str] | None:
    """A common given name with a family name, unless the words around it name a place or thing."""
    hit = _FULL_NAME.match(text, start)
    if not hit or hit.end() <= end or not text[start].isupper():
        return None
    family = low[hit.start() : hit.end()].split()[1:]
    if low[start:end] not in GIVEN_ENGLISH and not family[-1].split("-")[-1].endswith(FAMILY_END):
        return None
    before = low[max(0, start - 24) : start].rstrip(" \t\n")
    if before.endswith(NOT_PERSONS) or before[-1:] in _QUOTES and before or AFTER_PLACES.match(text, hit.end()):
        return None
    return hit.start(), hit.end(), re.sub(r"\s+", " ", hit.group(0)).lower()


def _automaton():
    if "all" in _MACHINES:
        return _MACHINES["all"]
    import ahocorasick

    machine = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for kind, words in (("at", AT_SIGNS), ("number", NUMBER_STARTS), ("id", ID_CUES), ("person", NAME_CUES + TITLES), ("street", STREETS), ("complex", COMPLEXES), ("given", GIVEN + GIVEN_ENGLISH + tuple(map(_romanised, GIVEN))), ("account", ACCOUNT_COUNTRIES), ("card", CARD_CUES)):
        for word in words:
            kinds.setdefault(word, set()).add(kind)
    for word, of in kinds.items():
        machine.add_word(word, (len(word), tuple(of)))
    machine.make_automaton()
    _MACHINES["all"] = machine
    return machine


def _national(digits: str) -> str | None:
    """Digits of a national number without its trunk zero, if they make one."""
    digits = digits[1:] if digits.startswith("0") else digits
    if re.fullmatch(r"(?:8[789]|98|99)\d{7}", digits) or re.fullmatch(r"2\d{7}", digits) or re.fullmatch(r"[3-7]\d{7}", digits):
        return "359" + digits
    return None


def phone_digits(raw: str) -> str | None:
    """International digits of one written phone number, or None if it isn't one."""
    raw = re.sub("[OОoо]", "0", raw)
    digits = re.sub(r"\D", "", raw)
    groups = [g for g in _SEPARATORS.split(raw.strip("+( ")) if g]
    if "+" in raw[:2]:
        rest = digits
    elif digits.startswith("00"):
        rest = digits[2:]
        if raw.count(".") > 3 or len(groups[0]) > 5 and "." in raw and raw.count(".") > 2:
            return None
    elif digits.startswith("0"):
        return _national(digits)
    else:
        return None
    if rest.startswith("359"):
        return _national(rest[3:])
    if rest.startswith("1") and re.fullmatch(r"1[2-9]\d{9}", rest):
        return rest
    if "+" in raw[:2] or rest.startswith(("44", "49", "43", "33", "39", "34", "30", "40", "90")):
        code = rest[:2]
        if "(0)" in raw.replace(" ", ""):
            rest = re.sub(rf"^({code})0", r"\1", rest)
        if 10 <= len(rest) <= (12 if code == "44" else 13) and rest[2:3] != "0":
            return rest
    return None


def _phone_at(text: str, start: int) -> tuple[int, int, str] | None:
    m = _RUN.match(text, start)
    if not m:
        return None
    run = m.group(0)
    # the longest beginning of the run, cut at a separator, that is a number
    ends = [len(run)] + [s.start() for s in reversed(list(_SEPARATORS.finditer(run))) if s.start() > 5]
    for end in ends:
        if value := phone_digits(run[:end]):
            return start, start + end, value
    return None


def _email_at(text: str, start: int, end: int) -> tuple[int, int, str] | None:
    sign = text[start:end]
    tight = sign in "@＠" and not text[start - 1 : start].isspace() and not text[end : end + 1].isspace()
    left = text[:start].rstrip(" \t") if not tight else text[:start]
    local = _LOCAL.search(left, max(0, len(left) - 64))
    if not local or text[local.start() - 1 : local.start()] == "@":
        return None
    right = end if tight else end + len(text[end:]) - len(text[end:].lstrip(" \t"))
    domain = (_TIGHT if tight else _LOOSE).match(text, right)
    if tight and not domain or (tight and domain and re.match(r"\s*(?:\[dot\]|\(dot\))", text[domain.end() :])):
        domain = _LOOSE.match(text, right) or domain
    if not domain:
        return None
    host = re.sub(_DOT, ".", domain.group(0), flags=re.I).lower()
    if sign.strip().lower() == "at" and (host.split(".")[0] in ("ul", "bul", "pl", "zhk", "the", "sq", "str") or not re.fullmatch(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}", host)):
        return None
    return local.start(), domain.end(), f"{local.group(0)}@{host}".lower()


def _denied(low: str, start: int) -> bool:
    before = low[max(0, start - 24) : start].rstrip(" :№\t\n")
    return before.endswith(NOT_PHONES)


def _anchored(text: str) -> list[tuple[int, int, str, str]]:
    low, found = _lower(text), []
    word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    for last, (size, kinds) in _automaton().iter(low):
        start, end = last - size + 1, last + 1
        for kind in kinds:
            if kind == "at":
                if (hit := _email_at(text, start, end)):
                    found.append((hit[0], hit[1], "email", hit[2]))
            elif kind == "number":
                while start > 0 and low[start - 1] in "(+":
                    start -= 1
                if not (start > 0 and (word(start - 1) or low[start - 1] in "@/-." and start > 1 and low[start - 2].isdigit())) and not _denied(low, start):
                    if hit := _phone_at(text, start):
                        found.append((hit[0], hit[1], "phone", hit[2]))
            elif word(start - 1):
                continue
            elif kind == "given":
                if not word(end) and (hit := _person_at(text, low, start, end)):
                    found.append((hit[0], hit[1], "name", hit[2]))
            elif kind == "account":
                if low[end : end + 1].isdigit() and (hit := _account_at(text, start)):
                    found.append((hit[0], hit[1], "account", hit[2]))
            elif kind == "card":
                if (hit := _CARD.match(text, end)) and (value := card_number(hit.group(1))):
                    found.append((hit.start(1), hit.end(1), "account", value))
            elif kind == "id":
                if hit := _ID.match(text, end):
                    found.append((hit.start(1), hit.end(1), "idnum", re.sub(r"\D", "", hit.group(1))))
            elif kind == "person":
                if not (low[end - 1].isalnum() and word(end)):
                    at = _TITLE.match(text, end).end()
                    hit = _NAME.match(text, at)
                    if hit and not word(hit.end()):
                        found.append((hit.start(), hit.end(), "name", re.sub(r"\s+", " ", hit.group(0)).lower()))
            elif kind in ("street", "complex"):
                if low[end - 1].isalnum() and word(end):
                    continue
                hit = _AFTER_COMPLEX.match(text, end)
                if hit:
                    found.append((start, hit.end(), "addr", "бл " + re.sub(r"\s+", " ", hit.group(2)).lower()))
                    continue
                hit = _AFTER_STREET.match(text, end)
                if hit and not low[start:end].strip().startswith(("street", "str.", "square", "sq.", "blvd", "boulevard", "avenue")):
                    found.append((start, hit.end(), "addr", re.sub(r"\s+", " ", f"{hit.group(1)} {hit.group(2)}").lower()))
                    continue
                before = _BEFORE_STREET.search(text, max(0, start - 70), start)
                if before:
                    found.append((before.start(1), end, "addr", re.sub(r"\s+", " ", f"{before.group(2)} {before.group(1)}").lower()))
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, str, str]], str | None]:
    """Items of a text as ``(start, end, type, value)`` in order, and the text with placeholders."""
    if not text:
        return [], text
    kept: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for item in sorted(set(_anchored(text)), key=lambda x: (ORDER.index(x[2]), x[0], -x[1])):
        if all(item[1] <= a or item[0] >= b for a, b in taken):
            kept.append(item)
            taken.append(item[:2])
    kept.sort()
    out, at = [], 0
    for start, end, kind, _ in kept:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return kept, "".join([*out, text[at:]])


LISTED = ("phone", "email", "idnum", "name", "addr")  # kinds that :func:`found` gives; accounts are only replaced

SCANNED = T.StructType(
    [
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("pii_value", T.StringType())]))),
        T.StructField("clean", T.StringType()),
    ]
)


@F.pandas_udf(SCANNED)
def _scan_batch(texts: pd.Series) -> pd.DataFrame:
    done = [scan(t if isinstance(t, str) else None) for t in texts]
    return pd.DataFrame({"items": [[{"pii_type": k, "pii_value": v} for _, _, k, v in items] for items, _ in done], "clean": [c for _, c in done]})


def scanned(text: Column) -> Column:
    """Struct of ``items`` (type and value, in order of the text) and ``clean`` (with placeholders).

    Null stays null, with no items; texts of any length are read whole.
    """
    return _scan_batch(text)


def found(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id, pii_type, pii_value``: one row for each different item of each text."""
    hits = rows.select(F.col(row_id), scanned(F.col(text)).alias("_s")).select(row_id, F.explode(F.array_distinct("_s.items")).alias("_i"))
    # an id that comes twice shall not give an item twice
    hits = hits.filter(F.col("_i.pii_type").isin(*LISTED))
    return hits.select(row_id, "_i.pii_type", "_i.pii_value").distinct()


def redacted(rows: DataFrame, *texts: str, contacts: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with placeholders for the personal items in the columns ``texts`` and ``contacts``.

    Columns named in ``contacts`` hold nothing but contacts, so what still looks like the
    beginning of a number there, e.g. where a long entry was cut off, is covered, too.
    Other columns stay untouched.
    """
    rest = "[+(]*[0-9][0-9OОoо ()./-]{3,}"
    covered = {t: scanned(F.col(t))["clean"] for t in texts}
    return rows.withColumns(covered | {c: F.regexp_replace(scanned(F.col(c))["clean"], rest, PLACEHOLDERS["phone"]) for c in contacts})
