"""Functions over label documents stored as JSON text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three label fields of the combination filter and the combinations it lets through.
COMBINATION_FIELDS = ("is_integration_test", "is_self_contained", "is_test_executed_against_deployed_services")
TARGET_COMBINATIONS = ((True, False, True), (True, True, True), (True, True, False))


def json_path(label_json: Column | str, path: str) -> Column:
    """Value at a dotted path as text; null when a step is missing or the text is not JSON."""
    return F.get_json_object(label_json, "$." + path)


def promote(label_json: Column | str, fields: Sequence[str]) -> list[Column]:
    """Top-level label fields as text columns of the same names."""
    return [json_path(label_json, f).alias(f) for f in fields if f]


def bucket_confidence(value: Column) -> Column:
    """low below 0.6, mid below 0.85, else high; null for null or non-numeric text."""
    x = value.try_cast("double")
    return F.when(x < 0.6, "low").when(x < 0.85, "mid").when(x.isNotNull(), "high")


def matches_combination(
    label_json: Column | str, combinations: Sequence[tuple[bool, ...]] = TARGET_COMBINATIONS
) -> Column:
    """True if the label's three flags are one of ``combinations``; missing flags never match."""
    flags = [json_path(label_json, f) for f in COMBINATION_FIELDS]
    cases = [
        reduce(lambda x, y: x & y, [flag == ("true" if want else "false") for flag, want in zip(flags, combo)])
        for combo in combinations
    ]
    return F.coalesce(reduce(lambda x, y: x | y, cases), F.lit(False))


def meets_any(label: Column | str, conditions: Sequence[tuple[str, object]]) -> Column:
    """OR over ``(field, value)`` equalities of typed values; ``None`` matches an absent or null field.

    Text equals text only. Numbers and booleans compare by value, as 1, 1.0 and true are equal.
    """
    parsed = F.try_parse_json(F.col(label) if isinstance(label, str) else label)
    tests = []
    for field, want in conditions:
        have = F.try_variant_get(parsed, "$['" + field.replace("'", "\\'") + "']", "variant")
        kind = F.schema_of_variant(have)
        if want is None:
            tests.append(have.isNull() | (kind == "VOID"))
        elif isinstance(want, str):
            tests.append((kind == "STRING") & (F.try_variant_get(have, "$", "string") == want))
        else:
            number = F.when(kind == "BOOLEAN", F.try_variant_get(have, "$", "boolean").cast("double")).when(
                kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(have, "$", "double")
            )
            tests.append(number == float(want))
    return reduce(lambda x, y: x | y, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


# Per-field transforms applied before agreement is measured.
FIELD_TRANSFORMS = {"confidence_score": bucket_confidence}
