"""HTML field access by native expressions.

Elements are cut out with matching nesting of equal tag names; an element that is never closed runs
to the end of the page. Comments, scripts, styles and templates carry no text and no links.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import apply, bind, quoted
from newsloom.functions.text import collapse, decode_entities, sql_decoded, strip

# Patterns start with one literal character, which is what the regex engine looks for first.
NOISE = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)"
    r"|template\b.*?(?:</template\s*>|\z))"
)
# Possessive groups: the regex engine runs them as loops, where other groups would recurse once for each
# attribute and overflow the stack on a tag that has thousands.
_ATTRIBUTES = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
TAG = rf"<[/!?A-Za-z](?:{_ATTRIBUTES}>|[^>]*>)"
MARK = "\x01"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr")


def without_noise(html: Column) -> Column:
    """The page with text-free parts replaced by an empty tag, so that they still part text nodes."""
    return F.regexp_replace(html, NOISE, "<!>")


def open_tag(name: str, condition: str = "") -> str:
    """Pattern of an opening tag; ``condition`` is a pattern from one of the functions below."""
    return rf"(?i:<{name}(?=[\s/>]){condition}{_ATTRIBUTES}>)"


def _up_to(name: str) -> str:
    """Pattern for what stands before the value of a tag's first attribute ``name``. Names and quoted values
    are passed over as a whole, so neither ``data-name`` nor a mention within a value is taken for it."""
    return rf"""(?:(?!{name}\s*=)(?:[^>"'\s/]++|[\s/]|"[^"]*+"|'[^']*+'))*+{name}\s*=\s*"""


def has_value(name: str, value: str) -> str:
    """The attribute ``name`` has exactly ``value``."""
    return rf"""{_up_to(name)}(?:"{value}"|'{value}'|{value}(?=[\s/>]))"""


def class_contains(part: str) -> str:
    return rf"""{_up_to("class")}(?:"[^"]*{part}[^"]*"|'[^']*{part}[^']*'|[^\s"'>]*{part})"""


def class_token(token: str) -> str:
    word = rf"(?<![^\s\"']){token}(?![^\s\"'])"
    return rf"""{_up_to("class")}(?:"[^"]*{word}[^"]*"|'[^']*{word}[^']*'|{token}(?=[\s>]))"""


def _sql_attribute(tag: str, name: str) -> str:
    pattern = quoted(rf"""(?is)^</?[a-z][^\s/>]*+{_up_to(name)}(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
    value = ", ".join(f"regexp_extract({tag}, {pattern}, {i})" for i in (1, 2, 3))
    return sql_decoded(f"concat({value})")


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute of an opening tag, '' if absent."""
    return apply(tag, f"x -> {_sql_attribute('x', name)}")


def has_attribute(tag: Column, name: str) -> Column:
    return F.rlike(tag, F.lit(rf"(?is)^<[a-z][^\s/>]*+{_up_to(name)}"))


def _sql_balanced(rest: str, name: str) -> str:
    """Usually the text up to the first closing tag; with nested tags of the same name, the pieces
    before the closing tag of depth one, where each piece starts at such a tag."""
    opens, closes = quoted(rf"(?i)^<{name}[\s/>]"), quoted(rf"(?i)^</{name}[\s/>]")
    single = quoted(rf"(?i)^<{name}{_ATTRIBUTES}(?<=/)>")
    change = (f"CASE WHEN rlike(piece, {closes}) THEN -1 "
              f"WHEN rlike(piece, {opens}) AND NOT rlike(piece, {single}) THEN 1 ELSE 0 END")
    deeper = bind(f"acc.depth + {change}", "depth", "named_struct('depth', depth, 'taken', "
                  "acc.taken + CASE WHEN depth > 0 THEN 1 ELSE 0 END)")
    taken = (f"aggregate(pieces, named_struct('depth', 1, 'taken', 0), "
             f"(acc, piece) -> CASE WHEN acc.depth > 0 THEN {deeper} ELSE acc END, acc -> acc.taken)")
    edge = quoted(rf"(?i)(?=</?{name}[\s/>])")
    nested = bind(f"split(r, {edge}, -1)", "pieces", f"array_join(slice(pieces, 1, {taken}), '')")
    first_close = quoted(rf"(?i)</{name}[\s/>]")
    return bind(rest, "r", bind(
        f"element_at(split(r, {first_close}, 2), 1)", "plain",
        f"CASE WHEN rlike(plain, {quoted(rf'(?i)<{name}[\s/>]')}) THEN {nested} ELSE plain END"))


def balanced(rest: Column, name: str) -> Column:
    """What lies between an opening tag ``name`` (already cut off) and its closing tag."""
    return apply(rest, f"x -> {_sql_balanced('x', name)}")


def element(html: Column, name: str, condition: str = "") -> Column:
    """Inner HTML of the first matching element; NULL when the page has none."""
    inner = _sql_balanced("element_at(halves, 2)", name)
    return apply(F.split(html, open_tag(name, condition), 2),
                 f"halves -> CASE WHEN size(halves) > 1 THEN {inner} END")


def first_tag(html: Column, name: str, condition: str = "") -> Column:
    """The first matching opening tag itself, '' when there is none."""
    return F.regexp_extract(html, open_tag(name, condition), 0)


def node_text(inner: Column, separator: str) -> Column:
    """Text nodes of a noise-free part, each stripped, joined by ``separator``; empty nodes vanish."""
    marked = decode_entities(F.regexp_replace(inner, TAG, MARK))
    nodes = F.transform(F.split(marked, MARK, -1), strip)
    return F.array_join(F.filter(nodes, lambda n: n != ""), separator)


_BLOCKS = ("address|article|aside|blockquote|dd|details|div|dl|dt|fieldset|figcaption|figure|footer"
           "|form|h[1-6]|header|hr|li|main|nav|ol|pre|section|table|tr|ul")


def inner_text(inner: Column) -> Column:
    """Rendered text of a noise-free part: white space collapsed, line breaks at block edges, a blank
    line around paragraphs. Style sheets are not applied."""
    flat = F.regexp_replace(F.regexp_replace(inner, r"[\t\r\n\f]", " "), "  +", " ")
    text = F.regexp_replace(flat, r"(?i)<br\s*/?>", "\x02")
    text = F.regexp_replace(text, r"(?i)</?p(?:\s[^>]*)?>", "\x03")
    text = F.regexp_replace(text, rf"(?i)</?(?:{_BLOCKS})(?:\s[^>]*)?>", "\x01")
    text = decode_entities(F.regexp_replace(text, TAG, ""))
    text = F.regexp_replace(text, " ?\x01[ \x01]*", "\x01")
    text = F.regexp_replace(text, " ?\x01?\x03[ \x01\x03]*", "\n\n")
    text = F.replace(text, F.lit("\x01"), F.lit("\n"))
    text = F.regexp_replace(text, " ?\x02 ?", "\n")
    return strip(F.regexp_replace(text, "  +", " "))


def clean_text(text: Column) -> Column:
    """Tags removed, white space collapsed, stripped."""
    return collapse(decode_entities(F.regexp_replace(without_noise(text), TAG, "")))


def tags(html: Column) -> Column:
    """All tags of a page in order."""
    return F.regexp_extract_all(without_noise(html), F.lit(TAG), 0)
