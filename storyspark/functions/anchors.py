"""Anchor extraction as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed

# Case-insensitive with Unicode classes and Unicode case folding.
REGEX_FLAGS = "(?iuU)"

# Neighbouring matches that can fall inside one context window. Every match has at least three
# characters, so seven of them already cover a 20-character window.
_NEIGHBOURS = fixed.EVIDENCE_CONTEXT_CHARS // 3 + 1


# In a run without whitespace only the match from its beginning counts: where that fails, all later beginnings fail too, and it
# ends at the run's last ``.pdf``. So no run is searched again from each of its characters.
# ``PL`` looks at one character, which has no other case forms than these two, before it tries each name.
_BEFORE = {"PDF": r"(?<!\S)", "PL": r"(?=[Pp])"}


def patterns(extra_types: bool = False) -> dict[str, str]:
    """Anchor type to pattern, in extraction order."""
    listed = {**fixed.ANCHOR_PATTERNS, **(fixed.EXTRA_ANCHOR_PATTERNS if extra_types else {})}
    return {name: _BEFORE.get(name, "") + pattern for name, pattern in listed.items()}


def _only_if_possible(text: Column, anchor_type: str, found: Column, empty: Column) -> Column:
    """Skip the regular expression for texts that lack a character every match must contain."""
    required = fixed.ANCHOR_REQUIRED_CHARS.get(anchor_type)
    if not required:
        return F.coalesce(found, empty)
    possible = reduce(lambda a, b: a & b, [F.contains(text, F.lit(c)) for c in required])
    return F.when(possible, found).otherwise(empty)


def matches(text: Column, anchor_type: str, extra_types: bool = False) -> Column:
    """All whole matches of one type, left to right, as ``array<string>``."""
    pattern = F.lit(REGEX_FLAGS + patterns(extra_types)[anchor_type])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return _only_if_possible(text, anchor_type, found, F.array().cast("array<string>"))


def anchor_array(text: Column, extra_types: bool = False) -> Column:
    """``array<struct<anchor_type, anchor_value>>`` in type order, then text order."""

    def of_type(anchor_type: str) -> Column:
        return F.transform(
            matches(text, anchor_type, extra_types),
            lambda value: F.struct(F.lit(anchor_type).alias("anchor_type"), value.alias("anchor_value")),
        )

    return F.concat(*[of_type(t) for t in patterns(extra_types)])


def _with_context(text: Column, anchor_type: str, pattern: str) -> Column:
    """Matches of one type with the characters around them.

    ``split`` gives the text between matches. Only the last and first characters of those pieces can
    reach a context window, so the pieces are cut down before neighbours are glued together.
    """
    size = fixed.EVIDENCE_CONTEXT_CHARS
    regex = REGEX_FLAGS + pattern
    gaps = F.split(text, regex, -1)
    # One struct, computed once per text: what the rows below read of it are fields, not expressions over the text.
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"),
        F.transform(gaps, lambda gap: F.struct(F.left(gap, F.lit(size)).alias("head"), F.right(gap, F.lit(size)).alias("tail"))).alias("gaps"),
    )

    def rows(part: Column) -> Column:
        found, ends = part["found"], part["gaps"]

        def row(value: Column, i: Column) -> Column:
            first = F.greatest(i - _NEIGHBOURS, F.lit(0))
            before = F.transform(
                F.slice(found, first + 1, i - first), lambda match, j: F.concat(F.get(ends, first + j)["tail"], match)
            )
            after = F.transform(
                F.slice(found, i + 2, F.lit(_NEIGHBOURS)), lambda match, j: F.concat(match, F.get(ends, i + j + 2)["head"])
            )
            left = F.right(F.concat(F.array_join(before, ""), F.get(ends, i)["tail"]), F.lit(size))
            right = F.left(F.concat(F.get(ends, i + 1)["head"], F.array_join(after, "")), F.lit(size))
            return F.struct(
                F.lit(anchor_type).alias("anchor_type"),
                value.alias("anchor_value"),
                F.concat(left, value, right).alias("evidence_ptr"),
            )

        return F.transform(found, row)

    empty = F.array().cast("array<struct<anchor_type:string,anchor_value:string,evidence_ptr:string>>")
    return _only_if_possible(text, anchor_type, F.get(F.transform(F.array(parts), rows), 0), empty)


def anchor_array_with_context(text: Column, extra_types: bool = False) -> Column:
    """Like :func:`anchor_array`, with up to 20 characters of text on both sides of each match."""
    return F.concat(*[_with_context(text, t, p) for t, p in patterns(extra_types).items()])


def anchor_weight(anchor_type: Column) -> Column:
    """Evidence weight of one anchor; a type without a weight counts 0.1."""
    weight = F.lit(fixed.OTHER_ANCHOR_WEIGHT)
    for name, value in fixed.ANCHOR_WEIGHTS.items():
        weight = F.when(anchor_type == name, F.lit(value)).otherwise(weight)
    return weight


def evidence_score(weight_sum: Column) -> Column:
    """Capped score of a summed weight. Rounding first makes the sum independent of row order."""
    return F.least(F.round(F.coalesce(weight_sum, F.lit(0.0)), 6), F.lit(fixed.EVIDENCE_SCORE_CAP))
