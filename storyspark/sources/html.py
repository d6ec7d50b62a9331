"""Main text of HTML pages as a chain of native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.text import non_empty

DROPPED_BLOCKS = ("script", "style", "noscript", "template", "head", "nav", "header", "footer", "aside")
LINE_TAGS = (
    "p|div|br|hr|ul|ol|li|dl|dt|dd|h[1-6]|table|thead|tbody|tfoot|tr|td|th|section|article|main|blockquote|pre|"
    "figure|figcaption|form"
)
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "copy": "©",
    "middot": "·",
    "ordm": "º",
    "ordf": "ª",
    "deg": "°",
    "sect": "§",
    "laquo": "«",
    "raquo": "»",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "hellip": "…",
    "euro": "€",
}
# Named accented letters follow one rule: base letter + accent name.
_ACCENTS = {
    "acute": ("aeiouAEIOU", "áéíóúÁÉÍÓÚ"),
    "grave": ("aA", "àÀ"),
    "circ": ("aeoAEO", "âêôÂÊÔ"),
    "tilde": ("aonAON", "ãõñÃÕÑ"),
    "uml": ("aouAOU", "äöüÄÖÜ"),
    "cedil": ("cC", "çÇ"),
}
ENTITIES = {
    **NAMED_ENTITIES,
    **{
        letter + accent: accented
        for accent, (letters, accents) in _ACCENTS.items()
        for letter, accented in zip(letters, accents)
    },
}


def unescape(text: Column) -> Column:
    """Replace named and numeric character references once; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def numeric(name: Column) -> Column:
        digits = F.regexp_extract(name, r"^#0*([0-9]{1,7})$", 1)
        hexed = F.regexp_extract(name, r"^#[xX]0*([0-9a-fA-F]{1,6})$", 1)
        code = F.when(digits != "", F.conv(digits, 10, 16)).when(hexed != "", hexed)
        return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^(#?[A-Za-z0-9]+);", 1)
        char = F.coalesce(F.try_element_at(names, name), F.when(name.startswith("#"), numeric(name)))
        rest = F.substr(part, F.length(name) + 2)
        return F.when(i == 0, part).otherwise(
            F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part))
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&", -1), piece), "")).otherwise(
        text
    )


def _let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` computed once, however often ``build`` uses it."""
    return F.get(F.transform(F.array(value), build), 0)


def _without_blocks(text: Column, opener: str, closer: str, stray: str = "") -> Column:
    """Text without what lies between each opener and the next closer, a space in its place.

    The text is split at the closers, and each piece is cut at its first opener: one pass, however many blocks stay open. A closer
    without opener is replaced by ``stray``.
    """

    def cut(pieces: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            halves = F.split(part, opener, 2)
            closed = F.when(F.size(halves) > 1, F.concat(F.get(halves, 0), F.lit(" "))).otherwise(F.concat(part, F.lit(stray)))
            return F.when(i == F.size(pieces) - 1, part).otherwise(closed)

        return F.array_join(F.transform(pieces, piece), "")

    return _let(F.split(text, closer, -1), cut)


def _insides(text: Column, tag: str) -> Column:
    """What is inside each block of a tag, top to bottom, as an array."""

    def cut(pieces: Column) -> Column:
        opened = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda part: F.get(F.split(part, rf"(?i)<{tag}\b[^<>]*>", 2), 1))
        return F.filter(opened, lambda inner: inner.isNotNull())

    return _let(F.split(text, rf"(?i)</{tag}\s*>", -1), cut)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Replace the ``html`` column by the readable text of the page, which may be empty.

    Comments and page furniture are dropped. All articles of the page are its text, else all main blocks, else the body. Block
    tags become line breaks and table cells of a row are joined by " | ". Each step is a column of its own, so that Spark computes it once
    although the next step reads it more than once, and takes time in proportion to the page: no pattern repeats a group or runs past the next tag.
    """
    steps = pages.withColumn("_body", _without_blocks(F.col(html), "<!--", "-->", "-->"))
    for tag in DROPPED_BLOCKS:
        steps = steps.withColumn("_body", _without_blocks(F.col("_body"), rf"(?i)<{tag}\b", rf"(?i)</{tag}\s*>"))
    steps = steps.withColumn("_articles", F.array_join(_insides(F.col("_body"), "article"), "\n"))
    steps = steps.withColumn("_main", F.array_join(_insides(F.col("_body"), "main"), "\n"))
    inner = F.coalesce(non_empty(F.col("_articles")), non_empty(F.col("_main")), F.col("_body"))
    cells = F.regexp_replace(inner, r"(?i)</t[dh]\s*>\s*<t[dh]\b[^<>]*>", " | ")
    lines = F.regexp_replace(cells, rf"(?i)</?(?:{LINE_TAGS})\b[^<>]*>", "\n")
    tidy = F.regexp_replace(F.regexp_replace(unescape(F.col("_bare")), r"[ \t\r\f]+", " "), r"[ \n]*\n[ \n]*", "\n")
    steps = steps.withColumn("_bare", F.regexp_replace(lines, r"<[^<>]*>", "")).withColumn(name, F.regexp_replace(F.regexp_replace(tidy, r"^\s+", ""), r"\s+$", ""))
    return steps.drop(html, "_body", "_articles", "_main", "_bare")


def page_items(pages: DataFrame) -> DataFrame:
    """One item per page with text: ``page_id, url, title, text``; pages without text are dropped."""
    texts = with_main_text(pages.select("page_id", "url", "html"))
    # ``explode`` instead of a filter: a filter would move below the steps and compute them all again.
    some = F.filter(F.array("text"), lambda t: t != "")
    return texts.select("page_id", "url", F.lit(None).cast("string").alias("title"), F.explode(some).alias("text"))
