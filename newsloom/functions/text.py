"""Text expressions whose results agree with Python's ``str`` methods."""

from __future__ import annotations

import html
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import apply, bind, quoted

# The 29 characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Inside a character class. Single Latin-1 characters share one bit set in java.util.regex, and the
# intersection is decided by its first range for ordinary letters: half the time of a flat union.
_WIDE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CONTROL = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\x{1680}-\x{3000}&&[" + _WIDE + "]]"
WS = "[ " + _CONTROL + "]"
_WS_BUT_SPACE = "[" + _CONTROL + "]"


def strip(text: Column) -> Column:
    """``str.strip()``."""
    return F.trim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """``' '.join(text.split())``.

    Odd white space becomes a space first, then runs shrink: single spaces, by far the most common
    case, are never rewritten.
    """
    spaced = F.regexp_replace(text, _WS_BUT_SPACE, " ")
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def sentence_count(text: Column) -> Column:
    """Number of pieces between full stops that are not blank: one match per such piece."""
    return F.regexp_count(text, F.lit("[^. " + _CONTROL + "][^.]*"))


def or_empty(text: Column) -> Column:
    """A missing key reads as the empty string."""
    return F.coalesce(text, F.lit(""))


def preview(text: Column, width: int) -> Column:
    """``text[:width]``, counted in code points."""
    return F.substring(text, 1, width)


# --- character references -------------------------------------------------------------------

# Named references that web pages use most, and those they use often; no value has an ampersand.
_FIRST = ("nbsp", "quot", "lt", "gt", "copy", "middot")
_SECOND = ("reg", "mdash", "ndash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo", "bull", "eacute",
           "egrave", "euro", "trade")
_NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
_WITHOUT_SEMICOLON = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
# Numbers 128..159 mean the windows-1252 characters; the standard library knows which.
_C1 = {str(n): html.unescape(f"&#{n};") for n in range(128, 160)}
# Code points that a numeric reference may not produce: html.unescape drops these.
_DROPPED = [n for n in [*range(1, 32), 127] if not html.unescape(f"&#{n};")]


def _look_up(entries: dict[str, str], name: str) -> str:
    """Value of a name in a fixed table, NULL if it is not there. The table is one literal text:
    rare lookups do not pay for a map in every plan."""
    table = quoted("\x01" + "".join(f"{key}\x02{value}\x01" for key, value in entries.items()))
    after = f"substring_index({table}, concat('\x01', {name}, '\x02'), -1)"
    return bind(f"substring_index({after}, '\x01', 1)", "v", "CASE WHEN v <> '' THEN v END")


def _code_point(digits: str, number_base: int) -> str:
    """The character of a numeric reference. More than eight significant digits are no code point."""
    number = bind(f"ltrim('0', {digits})", "d", "CASE WHEN length(d) > 8 THEN -1 ELSE "
                  f"CAST(conv(concat('0', d), {number_base}, 10) AS BIGINT) END")
    return bind(number, "n", f"""CASE
      WHEN n BETWEEN 128 AND 159 THEN coalesce({_look_up(_C1, "CAST(n AS STRING)")}, '')
      WHEN n IN ({", ".join(map(str, _DROPPED))}) OR n BETWEEN 64976 AND 65007
        OR (n BETWEEN 65534 AND 1114111 AND pmod(n, 65536) >= 65534) THEN ''
      WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111
        THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')
      ELSE '\ufffd' END""")


@lru_cache
def _decode_piece() -> str:
    """SQL over ``p``, which is what follows an ampersand, up to the next one."""
    decimal, hexadecimal = quoted("^#([0-9]+);?"), quoted("^#[xX]([0-9a-fA-F]+);?")
    full = quoted("^([A-Za-z][A-Za-z0-9]*);")
    bare = quoted("^(" + "|".join(_WITHOUT_SEMICOLON) + ")")

    def named(pattern: str, entries: dict[str, str]) -> str:
        return bind(f"regexp_extract(p, {pattern}, 1)", "name", f"CASE WHEN name <> '' THEN "
                    f"concat({_look_up(entries, 'name')}, regexp_replace(p, {pattern}, '')) END")

    def numeric(pattern: str, number_base: int) -> str:
        character = _code_point(f"regexp_extract(p, {pattern}, 1)", number_base)
        return f"WHEN rlike(p, {pattern}) THEN concat({character}, regexp_replace(p, {pattern}, ''))"

    legacy = {name: html5[name] for name in _WITHOUT_SEMICOLON}
    return f"""CASE WHEN startswith(p, 'amp;') THEN concat('&', substr(p, 5))
      {numeric(decimal, 10)} {numeric(hexadecimal, 16)}
      ELSE coalesce({named(full, _NAMED)}, {named(bare, legacy)}, concat('&', p)) END"""


def sql_decoded(value: str) -> str:
    """``html.unescape`` as SQL text.

    Texts whose references are all common ones take a chain of plain replacements, ``&amp;`` last so
    that nothing is decoded twice; the rest is decoded reference by reference.
    """
    def chain(text: str, names: tuple[str, ...]) -> str:
        for name in names:
            text = f"replace({text}, '&{name};', {quoted(_NAMED[name])})"
        return text

    def unless_settled(text: str, otherwise: str) -> str:
        return f"""CASE WHEN contains(replace({text}, '&amp;', ''), '&') THEN {otherwise}
          ELSE replace({text}, '&amp;', '&') END"""

    general = ("array_join(transform(split(t, '&', -1), "
               f"(p, i) -> CASE WHEN i = 0 THEN p ELSE {_decode_piece()} END), '')")
    second = bind(chain("c", _SECOND), "d", unless_settled("d", general))
    first = bind(chain("t", _FIRST), "c", unless_settled("c", second))
    return bind(value, "t", f"CASE WHEN NOT contains(t, '&') THEN t ELSE {first} END")


def decode_entities(text: Column) -> Column:
    """``html.unescape(text)``."""
    return apply(text, f"x -> {sql_decoded('x')}")
