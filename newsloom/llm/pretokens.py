"""Cutting texts into pre-tokens in two steps, so that the slow pattern sees each distinct chunk once.

Patterns of byte-level vocabularies never match across the end of a run of non-blank characters, nor
between blanks but for one space before a run. So a text can first be cut into such runs, each with the
space before it, and runs of blanks, by a pattern without Unicode classes; the pre-tokens of a chunk do
not depend on its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

# The characters with the Unicode property White_Space.
BLANKS = "\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_CHUNK = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
_SPACE_BLANK = re.compile(f" [{BLANKS}]")
BLOCK_CHARS = 1 << 20


def chunks(text: str) -> list[str]:
    if "\0" in text or text[-1:] == " " or _SPACE_BLANK.search(text):
        return _CHUNK.findall(text)
    found = text.replace(" ", "\0 ").split("\0")
    return found if found[0] else found[1:]


def finder(pattern: str):
    """The function that lists the pre-tokens of a chunk."""
    return regex.compile(pattern).findall


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in blocks of about BLOCK_CHARS characters; a longer text is a block of its own."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block
