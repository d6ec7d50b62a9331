"""Text normalisation, tokens and fingerprints as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64
_LANES = 0x0000000100000001  # two 32-bit counters packed in one long


def normalize_text(value: Column) -> Column:
    """Null to empty, lower case, whitespace runs to one space, no outer whitespace. Accents stay."""
    # A single space, as most gaps are, stays as it is.
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s(?:(?<! )\s*|\s+)", " ")))


def fold_accents(value: Column) -> Column:
    """Lower-case Latin letters without their accents."""
    return F.translate(value, "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def non_empty(value: Column) -> Column:
    """Null when the text is empty, so that ``coalesce`` skips both."""
    return F.nullif(value, F.lit(""))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, or the empty string."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-case word tokens in text order; characters other than letters, digits and ``_`` vanish."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(words, r"(?U)\s+"), lambda token: token != "")


def token_hash(token: Column) -> Column:
    """Low 64 bits of the token's MD5 as a signed long."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 17, 16), 16, -10).cast("bigint")


def simhash_counters(hash_value: Column) -> list[Column]:
    """Aggregates that count set bits per position; bits i and i+32 share one packed sum."""
    return [
        F.sum(F.shiftright(hash_value, i).bitwiseAND(F.lit(_LANES))).alias(f"lane_{i}")
        for i in range(HASH_BITS // 2)
    ]


def simhash_from_counters(token_count: Column) -> Column:
    """Fold the packed counters: a bit is set when more than half of the tokens have it."""

    def bit(count: Column, position: int) -> Column:
        mask = 1 << position
        signed = mask - (1 << HASH_BITS) if position == HASH_BITS - 1 else mask
        return F.when(count * 2 > token_count, F.lit(signed).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    half = HASH_BITS // 2
    low = [bit(F.col(f"lane_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i) for i in range(half)]
    high = [bit(F.shiftright(F.col(f"lane_{i}"), half), i + half) for i in range(half)]
    return reduce(lambda a, b: a.bitwiseOR(b), low + high)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - hamming(a, b) / F.lit(float(HASH_BITS))


def jaccard(tokens_a: Column, tokens_b: Column) -> Column:
    """Token-set Jaccard; 0 when either side has no tokens."""
    shared = F.size(F.array_intersect(tokens_a, tokens_b))
    union = F.size(F.array_union(tokens_a, tokens_b))
    return F.when((F.size(tokens_a) == 0) | (F.size(tokens_b) == 0), F.lit(0.0)).otherwise(shared / union)


def table_text(table: Column) -> Column:
    """``array<array<string>>`` cells to marked text; empty cells and all-empty rows are dropped."""
    filled = F.transform(table, lambda row: F.filter(row, lambda cell: F.coalesce(cell, F.lit("")) != ""))
    lines = F.transform(F.filter(filled, lambda row: F.size(row) > 0), lambda row: F.array_join(row, " | "))
    return F.when(
        F.size(table) > 0, F.concat(F.lit("\n[TABLE]\n"), F.array_join(lines, "\n"), F.lit("\n[/TABLE]\n"))
    )


def cron_is_valid(cron: Column) -> Column:
    """Five whitespace-separated fields; null and empty pass."""
    fields = F.filter(F.split(cron, r"(?U)\s+"), lambda field: field != "")
    return cron.isNull() | (cron == "") | (F.size(fields) == 5)
