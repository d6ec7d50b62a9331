"""Source classes, media groups and editorial lanes as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.functions.text import fold_accents, normalize_text, url_host

KNOWN_LANES = tuple(fixed.LANE_KEYWORDS) + fixed.EXTRA_KNOWN_LANES


def _let(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once, however often ``build`` uses it."""
    return F.get(F.transform(F.array(value), build), 0)


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _is_under(name: Column, suffixes: tuple[str, ...]) -> Column:
    return F.exists(_words(suffixes), lambda s: (name == s) | F.endswith(name, F.concat(F.lit("."), s)))


def host_matches_any(host: Column, suffixes: tuple[str, ...]) -> Column:
    """The host equals a suffix or is a subdomain of one."""
    return _let(normalize_text(host), lambda name: (name != "") & _is_under(name, suffixes))


def source_class(source_name: Column, source_url: Column, current_class: Column | None = None) -> Column:
    """Explicit class, else host lists, else name tokens, else ``other``."""
    explicit = normalize_text(current_class if current_class is not None else F.lit(""))
    label = normalize_text(
        F.concat(F.coalesce(source_name, F.lit("")), F.lit(" "), F.coalesce(source_url, F.lit("")))
    )

    def by_host(host: Column) -> Column:
        found = [F.when(_is_under(host, s), F.lit(name)) for name, s in fixed.CLASS_HOST_SUFFIXES.items()]
        return F.coalesce(*found)

    def by_token(text: Column) -> Column:
        found = [
            F.when(F.exists(_words(words), lambda w: F.contains(text, w)), F.lit(name))
            for name, words in fixed.CLASS_NAME_TOKENS.items()
        ]
        return F.coalesce(*found)

    return F.coalesce(
        F.when(explicit.isin(*fixed.SOURCE_CLASSES), explicit),
        _let(url_host(source_url), by_host),
        _let(label, by_token),
        F.lit(fixed.OTHER_SOURCE_CLASS),
    )


def media_group(host: Column) -> Column:
    """Media group of a host, or null. The longest matching suffix wins."""
    by_length = sorted(
        ((suffix, group) for group, suffixes in fixed.MEDIA_GROUP_HOST_SUFFIXES.items() for suffix in suffixes),
        key=lambda pair: -len(pair[0]),
    )
    return _let(
        normalize_text(host),
        lambda name: F.coalesce(*[F.when(_is_under(name, (s,)), F.lit(group)) for s, group in by_length]),
    )


def is_mainstream(group: Column) -> Column:
    return F.coalesce(group.isin(*fixed.MAINSTREAM_MEDIA_GROUPS), F.lit(False))


def _known_lane(value: Column | None) -> Column:
    name = F.replace(normalize_text(value), F.lit(" "), F.lit("_")) if value is not None else F.lit(None)
    return F.when(name.isin(*KNOWN_LANES), name)


#: Letters from common to rare; all others count as rarest. Only the speed of a search depends on it.
_LETTERS = " eaoisrntdulcmhpgvbfqyxzjkw"
_SELDOM, _RARE = _LETTERS.index("l"), _LETTERS.index("p")


def _ending(word: str) -> str | None:
    """The word from its rarest letter on, if that leaves two characters after a rare letter, or three after a less rare one."""
    ranks = [_LETTERS.index(c) if c in _LETTERS else len(_LETTERS) for c in word]
    places = [i for i, rank in enumerate(ranks) if len(word) - i >= (2 if rank >= _RARE else 3) and rank >= _SELDOM]
    return word[max(places, key=lambda i: (len(word) - i >= 3, ranks[i], -i)) :] if places else None


def _longest_of(words: Sequence[str]) -> str:
    """Pattern of the longest of ``words`` that begins at a place; words with the same beginning share it."""
    heads: dict[str, list[str]] = {}
    for word in sorted(filter(None, words)):
        heads.setdefault(word[0], []).append(word[1:])
    if not heads:
        return ""
    body = "|".join(re.escape(head) + _longest_of(tails) for head, tails in heads.items())
    return f"(?:{body})" + ("?" if "" in words else "")


def words_in(text: Column, words: Sequence[str]) -> Column:
    """Those of ``words`` that ``text`` contains, some perhaps twice.

    One pass over the text stops at letters that are rare in most texts and looks for the words' endings from there on. Only words whose ending is found are sought
    in the text, and the few that have no rare letter.
    """
    endings = {word: ending for word in words if (ending := _ending(word))}
    starts = "".join(sorted({ending[0] for ending in endings.values()}))
    # Of endings at one place the longest is found; it stands for those that it begins with.
    listed = F.array(
        *[
            F.struct(F.lit(ending).alias("ending"), _words([w for w, other in endings.items() if ending.startswith(other)]).alias("words"))
            for ending in sorted(set(endings.values()))
        ]
    )
    pattern = F.lit(f"(?=[{starts}])(?=({_longest_of(list(endings.values()))}))")

    def sought(t: Column, some: Column) -> Column:
        return F.filter(some, lambda word: F.contains(t, word))

    def found(t: Column) -> Column:
        def by_ending(seen: Column) -> Column:
            possible = F.filter(listed, lambda item: F.array_contains(seen, item["ending"]))
            return F.flatten(F.transform(possible, lambda item: sought(t, item["words"])))

        others = _words([word for word in words if word not in endings])
        return F.concat(_let(F.array_distinct(F.regexp_extract_all(t, pattern, F.lit(1))), by_ending), sought(t, others))

    return _let(text, found)


def keyword_lane(text: Column) -> Column:
    """Lane with most keyword hits in normalised text, or null without any hit.

    Ties go to the higher priority, then to the lane listed first.
    """
    lanes = F.array(
        *[
            F.struct(
                F.lit(fixed.LANE_PRIORITIES.get(lane, fixed.OTHER_LANE_PRIORITY)).alias("priority"),
                F.lit(-order).alias("order"),
                F.lit(lane).alias("lane"),
                _words(words).alias("words"),
            )
            for order, (lane, words) in enumerate(fixed.LANE_KEYWORDS.items())
        ]
    )

    def best(found: Column) -> Column:
        return F.array_max(
            F.transform(
                lanes,
                lambda lane: F.struct(
                    F.size(F.filter(lane["words"], lambda word: F.array_contains(found, word))).alias("hits"),
                    lane["priority"],
                    lane["order"],
                    lane["lane"],
                ),
            )
        )

    found = words_in(text, [word for words in fixed.LANE_KEYWORDS.values() for word in words])
    return _let(_let(found, best), lambda top: F.when(top["hits"] > 0, top["lane"]))


def editorial_lane(
    *,
    explicit_lane: Column | None = None,
    editoria: Column | None = None,
    topic: Column | None = None,
    title: Column | None = None,
    snippet: Column | None = None,
    source_scope: Column | None = None,
    without_accents: bool = False,
) -> Column:
    """Explicit lane, else keyword hits, else topic, editoria, scope, else ``geral``."""
    explicit = normalize_text(explicit_lane if explicit_lane is not None else F.lit(""))
    empty = F.lit("")
    text = normalize_text(
        F.concat(
            F.coalesce(title, empty) if title is not None else empty,
            F.lit(" "),
            F.coalesce(snippet, empty) if snippet is not None else empty,
        )
    )
    if without_accents:
        text = fold_accents(text)
    scope = normalize_text(source_scope if source_scope is not None else empty)
    by_scope = F.when(scope.isin(*fixed.POLITICS_SCOPES), F.lit("politica")).when(
        scope == fixed.WORLD_SCOPE, F.lit("internacional")
    )
    return F.coalesce(
        F.when(explicit.isin(*KNOWN_LANES), explicit),
        keyword_lane(text),
        _known_lane(topic),
        _known_lane(editoria),
        by_scope,
        F.lit(fixed.DEFAULT_LANE),
    )
