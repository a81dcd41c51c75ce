"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Blanks under the Unicode mode ``(?U)`` (faster than a spelled-out class), and the characters of words.
BLANK = r"[\s\x1c-\x1f]"
WORD = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def words(text: Column) -> Column:
    """Non-empty tokens between runs of blanks."""
    return F.array_remove(F.split(text, rf"(?U){BLANK}+"), "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def normalize_name(name: Column) -> Column:
    """Lower case, outer blanks off, punctuation out, inner blanks collapsed."""
    bare = F.regexp_replace(strip(F.lower(name)), rf"(?U)[^{WORD}\s\x1c-\x1f-]", "")
    return F.regexp_replace(bare, rf"(?U){BLANK}+", " ")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words of two word sets; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the size of the larger set; 0 when either is empty."""
    top = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / top
    )


def name_similarity(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """Length ratio when one normalised name contains the other, else Jaccard of their word sets."""
    la, lb = F.length(a), F.length(b)
    ratio = F.try_divide(F.least(la, lb).cast("double"), F.greatest(la, lb))
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(inside, F.coalesce(ratio, F.lit(0.0))).otherwise(jaccard(words_a, words_b))


def truncate(text: Column, limit: int, suffix: str) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit(suffix))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def snippet(text: Column) -> Column:
    return truncate(text, 900, "...")


def code_snippet(text: Column) -> Column:
    return truncate(text, 500, "\n... (truncated)")


def short_reference(text: Column) -> Column:
    """First 300 characters without outer blanks, marked when longer."""
    head = strip(F.substring(text, 1, 300))
    return F.when(F.length(text) > 300, F.concat(head, F.lit("..."))).otherwise(head)


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def contains_any(text: Column, needles: list[str]) -> Column:
    """True if any of a fixed list of strings occurs in ``text``."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def any_contains(texts: Column, needles: list[str]) -> Column:
    """True if any element of an array contains any of a fixed list of strings."""
    return F.coalesce(F.exists(texts, lambda t: contains_any(t, needles)), F.lit(False))


def is_code_line(line: Column) -> Column:
    return ~line.rlike(rf"(?U)^{BLANK}*(#|\z)")


def code_line_count(lines: Column) -> Column:
    """Lines that are neither blank nor start with ``#``; docstring lines count."""
    return F.size(F.filter(lines, is_code_line))


def list_items(expr: Column) -> Column:
    """Items between the first ``[`` and the last ``]``, split on commas, blanks off, empties out."""
    inner = F.regexp_extract(expr, r"(?s)^[^\[]*\[(.*)\][^\]]*$", 1)
    items = F.transform(F.split(inner, ","), strip)
    return F.filter(items, lambda t: t != "")


def one_decimal(x: Column) -> Column:
    """A non-negative double as text with one decimal, ties to even on its exact binary value.

    Printing rounds by the shortest decimal form instead, which turns 31.25 into 31.3. The double is split
    so that its distance from the nearest rounding border is computed without error.
    """
    tenths = F.floor(x * 10)
    high = F.floor(x * F.lit(float(1 << 20))) / F.lit(float(1 << 20))
    above = (high * 20 - (tenths * 2 + 1)) + (x - high) * 20
    rounded = tenths + F.when((above > 0) | ((above == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """``x.y%``; null for an empty whole."""
    return F.concat(one_decimal(F.try_divide(part.cast("double"), whole) * 100), F.lit("%"))


def last_part(path: Column, sep: str = "/") -> Column:
    return F.substring_index(path, sep, -1)


def module_stem(path: Column) -> Column:
    """Last path part with every ``.py`` removed."""
    return F.replace(last_part(path), F.lit(".py"), F.lit(""))


def name_aliases(name: Column) -> Column:
    """Spellings under which an inferred function name may be looked up, sorted.

    The name itself and, for each of the separators ``.``, ``::`` and ``:`` it holds, its last part and
    its last two parts joined by a dot.
    """
    bare = F.trim(name)
    forms = [bare]
    for sep, keep_empty in ((".", True), ("::", False), (":", False)):
        parts = F.split(bare, r"\." if sep == "." else sep)
        if not keep_empty:
            parts = F.filter(parts, lambda p: p != "")
        held = F.contains(bare, F.lit(sep))
        forms.append(F.when(held, F.try_element_at(parts, F.lit(-1))))
        forms.append(F.when(held & (F.size(parts) >= 2), F.array_join(F.slice(parts, -2, 2), ".")))
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != ""))))
