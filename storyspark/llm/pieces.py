"""Texts cut into short pieces that a byte-level BPE treats apart from each other, so that results can be kept.

The pre-tokenizer of such a vocabulary starts a new token at a space between two characters that are no white space,
at a line end between two such characters, and at a full stop or comma behind a letter or digit. A piece is what lies
between two such places. Most pieces of a corpus are repeated words, so a bounded dictionary answers most of them.

A key stands for a literal piece of text: the key itself behind a space, or, if the key starts with a line end or with
one of the two marks for a full stop and a comma, the text that the key spells.
"""

from __future__ import annotations

import re
from collections.abc import Callable

STOP, COMMA = "\x03", "\x02"
#: Cut texts only at places where the rule above surely holds; all other texts take :data:`_SPACE`.
_ODD = re.compile("[^\\S \n]|[ \n][ \n]|[\x02\x03]|(?<![0-9A-Za-zÀ-ÖØ-öø-ɏ])[.,]")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def keys(text: str) -> tuple[str | None, list[str]]:
    """``(head, keys)`` of a text that isn't empty; the head, if any, stands in front as it is.

    Without a head the first key starts with a line end that the text doesn't have.
    """
    if _ODD.search(f"\n{text}\n"):
        if STOP in text or COMMA in text:
            return text, []
        head, *rest = _SPACE.split(text)
        return head, rest
    marked = text.replace("\n", " \n").replace(".", " \x03").replace(",", " \x02")
    return None, f"\n{marked}".split(" ")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, 256 and up for the rest."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def literal(key: str) -> str:
    first = key[:1]
    if first == "\n":
        return key
    if first == STOP:
        return f".{key[1:]}"
    if first == COMMA:
        return f",{key[1:]}"
    return f" {key}"


class Answers(dict):
    """``key -> answer``, made on demand and forgotten all at once when ``limit`` is reached."""

    def __init__(self, answer: Callable[[str], object], limit: int) -> None:
        super().__init__()
        self.answer, self.limit = answer, limit

    def __missing__(self, key: str) -> object:
        if len(self) >= self.limit:
            self.clear()
        self[key] = found = self.answer(key)
        return found
