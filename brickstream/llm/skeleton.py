"""Spelling skeletons: one comparable form for Cyrillic and Latin spellings of a name.

A skeleton is lower-case Latin text in which the usual romanisations of one Bulgarian
name agree (``Щъркелово``, ``Shturkelovo`` and ``Shtarkelovo`` give the same string).
All functions are column expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters that look like Cyrillic ones, and the letters they stand for.
LOOKALIKE_LATIN = "aceopxyABCEHKMOPTX"
LOOKALIKE_CYRILLIC = "асеорхуАВСЕНКМОРТХ"

# Cyrillic letters and their signs in the skeleton, one for each letter, so
# that a typing error stays one edit.
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъьюя"
SIGNS = "abvgde3ziiklmnoprstafhcçşwaiüä"

# Latin spellings and their signs, longest first where one contains another.
LATIN_PAIRS = (
    ("sht", "w"),
    ("zh", "3"),
    ("ch", "ç"),
    ("sh", "ş"),
    ("ts", "c"),
    ("kh", "h"),
    ("4", "ç"),
    ("6", "ş"),
    ("ou", "a"),
    ("iu", "ü"),
    ("yu", "ü"),
    ("ju", "ü"),
    ("ya", "ä"),
    ("ia", "ä"),
    ("ja", "ä"),
    ("q", "ä"),
    ("x", "h"),
    ("j", "3"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def tidy(text: Column) -> Column:
    """Trimmed text with every kind of blank as one space; zero-width signs removed."""
    plain = F.regexp_replace(text, "[\\u200B-\\u200D\\u2060\\uFEFF\\u00AD]", "")
    return F.trim(F.regexp_replace(plain, "[\\s\\u00A0\\u2000-\\u200A\\u202F\\u3000]+", " "))


def is_cyrillic(text: Column) -> Column:
    return text.rlike("[\\u0400-\\u04FF]")


def without_lookalikes(text: Column) -> Column:
    """Latin look-alikes replaced by Cyrillic letters where the text has Cyrillic at all."""
    return F.when(is_cyrillic(text), F.translate(text, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)).otherwise(text)


def words_without_lookalikes(text: Column) -> Column:
    """As :func:`without_lookalikes`, but word by word, for texts that mix both scripts."""
    fixed = F.transform(F.split(text, " "), without_lookalikes)
    return F.array_join(fixed, " ")


def skeleton(text: Column) -> Column:
    """Skeleton of a lower-case text; signs other than letters stay as they are."""

    def latin(t: Column) -> Column:
        t = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), LATIN_PAIRS, t)
        return F.translate(F.regexp_replace(t, "([aeo])y", "$1i"), "uy", "aa")

    def cyrillic(t: Column) -> Column:
        return F.translate(t, CYRILLIC, SIGNS)

    return let(text, lambda t: F.when(is_cyrillic(t), cyrillic(t)).otherwise(latin(t)))


# Signs of the skeleton that one Latin spelling may stand for, united.
COARSE_PAIRS = (("ts", "c"), ("şt", "w"), ("ä", "ia"), ("ü", "ia"))


def coarse(fine: Column) -> Column:
    """Skeleton that unites what one Latin spelling may stand for.

    ``j`` is ``ж``, ``й`` or, with a vowel, ``я`` or ``ю``; ``ts`` is ``ц`` or ``тс``; ``sht`` is ``щ`` or ``шт``.
    """
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), COARSE_PAIRS, F.translate(fine, "3", "i"))


def damerau_close(left: Column, right: Column, slack_from: int = 7) -> Column:
    """One edit (also two swapped neighbours) apart; two edits for long strings.

    ``slack_from`` is the length of the shorter string from which two edits pass.
    """
    letters = lambda c: F.array_sort(F.split(c, ""))
    d = F.levenshtein(left, right, 2)
    swapped = (d == 2) & (F.length(left) == F.length(right)) & (letters(left) == letters(right))
    return d.between(0, 1) | swapped | ((d == 2) & (F.least(F.length(left), F.length(right)) >= slack_from))
