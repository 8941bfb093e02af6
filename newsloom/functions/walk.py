"""One ordered list of a page's tags, from which links, their parents and their cards are read.

A walk keeps the stack of open elements; closing a tag closes everything opened since. A tag whose quotes do
not close opens nothing and is no link. Walks go in blocks of tags, so that what was found so far is copied
once for each block and not once for each tag: a page costs little more than the number of its tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions.binding import apply, bind, quoted

BLOCK = 256
_VOID = ", ".join(quoted(v) for v in H.VOID)
# A whole opening tag, and a whole link.
_WHOLE = quoted(rf"(?s)\A<[A-Za-z]{H._ATTRIBUTES}>\z")
_LINK = quoted(rf"(?is)\A<a\s{H._ATTRIBUTES}>\z")
_NAME = r"lower(regexp_extract(x, '^</?([A-Za-z][^\\s/>]*)', 1))"

# How many elements a closing tag ends: all down to the last open one of its name, none if there is none.
_ENDS = ("CASE WHEN NOT t.closing THEN 0 WHEN try_element_at(acc.open, -1).name = t.name THEN 1 "
         "ELSE int(array_position(reverse(transform(acc.open, o -> o.name)), t.name)) END")


def _in_blocks(tokens: str, start: str, step: str, lists: tuple[str, ...], others: tuple[str, ...]) -> str:
    """SQL of a fold over ``tokens`` from state ``start``; ``lists`` only grow and start anew in each block, ``others``
    are handed on. ``step`` maps ``acc, t`` to the next state."""
    blocks = (f"transform(sequence(0, int((size({tokens}) - 1) div {BLOCK})), "
              f"n -> slice({tokens}, n * {BLOCK} + 1, {BLOCK}))")
    fresh = ", ".join([f"'{o}', whole.{o}" for o in others] + [f"'{name}', slice(whole.{name}, 1, 0)" for name in lists])
    joined = ", ".join([f"'{o}', part.{o}" for o in others] + [f"'{name}', concat(whole.{name}, part.{name})" for name in lists])
    inner = bind(f"aggregate(block, named_struct({fresh}), (acc, t) -> {step})", "part", f"named_struct({joined})")
    return f"aggregate({blocks}, {start}, (whole, block) -> {inner})"


def _is_link(token: str) -> str:
    return f"rlike({token}, {_LINK})"


_HOLDERS_START = """named_struct('open', CAST(array() AS ARRAY<STRUCT<name: STRING, tag: STRING>>),
  'held', CAST(array() AS ARRAY<STRING>))"""
_HOLDERS_STEP = bind(_ENDS, "ends", """named_struct(
  'open', CASE WHEN t.closing THEN slice(acc.open, 1, size(acc.open) - ends)
    WHEN t.opens THEN concat(acc.open, array(named_struct('name', t.name, 'tag', t.tag))) ELSE acc.open END,
  'held', CASE WHEN t.link THEN concat(acc.held, array(coalesce(try_element_at(acc.open, -1).tag, ''))) ELSE acc.held END)""")
_PLAIN = (f"named_struct('tag', x, 'name', {_NAME}, 'closing', startswith(x, '</'), "
          f"'opens', NOT endswith(x, '/>') AND {_NAME} NOT IN ('', {_VOID}) AND rlike(x, {_WHOLE}), 'link', {_is_link('x')})")


def links(html: Column, holders: Column | None = None) -> Column:
    """The links of a page in order, ``tag, heading, holder``: the tag itself, whether a second or third heading comes
    before the link's end, and the tag of the element that holds it, '' if there is none. Parents are looked
    for where ``holders`` holds, and left out (NULL) elsewhere."""
    marks = (f"array_join(transform(tokens, x -> CASE WHEN {_is_link('x')} THEN 'a' "
             r"WHEN rlike(x, '(?i)^</a[\\s/>]') THEN '/' WHEN rlike(x, '(?i)^<h[23][\\s/>]') THEN 'h' ELSE '' END), '')")
    heads = bind(f"split({marks}, 'a', -1)", "pieces", "transform(slice(pieces, 2, size(pieces) - 1), p -> startswith(p, 'h'))")
    walked = _in_blocks("parsed", _HOLDERS_START, _HOLDERS_STEP, ("held",), ("open",)) + ".held"
    held = bind(f"transform(tokens, x -> {_PLAIN})", "parsed", walked)
    found = f"filter(tokens, x -> {_is_link('x')})"
    zipped = bind(found, "tags", bind(heads, "heads", bind(
        f"CASE WHEN page.wanted THEN {held} END", "held",
        "transform(tags, (x, i) -> named_struct('tag', x, 'heading', heads[i], 'holder', held[i]))")))
    page = F.struct(H.tags(html).alias("tokens"), (F.lit(False) if holders is None else holders).alias("wanted"))
    return apply(page, f"page -> {bind('page.tokens', 'tokens', zipped)}")


# --- cards ----------------------------------------------------------------------------------

_CARDS_START = """named_struct('open', CAST(array() AS ARRAY<STRUCT<name: STRING, card: INT, first: INT, info: INT, start: INT>>),
  'i', 0, 'cards', 0, 'infos', 0, 'listed', CAST(array() AS ARRAY<STRUCT<tag: STRING, card: INT>>),
  'firsts', CAST(array() AS ARRAY<STRUCT<card: INT, first: INT>>),
  'spans', CAST(array() AS ARRAY<STRUCT<info: INT, start: INT, end: INT>>))"""
# An information element belongs to every open card that has none yet: it is their first one in the page's order.
_GIVEN = ("CASE WHEN t.info THEN transform(acc.open, o -> named_struct('name', o.name, 'card', o.card, "
          "'first', if(o.card >= 0 AND o.first < 0, acc.infos, o.first), 'info', o.info, 'start', o.start)) ELSE acc.open END")
_OWN = ("named_struct('name', t.name, 'card', if(t.card, acc.cards, -1), 'first', -1, "
        "'info', if(t.info, acc.infos, -1), 'start', acc.i)")


def _ended(gone: str, at: str, base: str) -> tuple[str, str]:
    """The lists ``firsts`` and ``spans`` of a state with the elements of ``gone`` that end at a tag."""
    firsts = (f"concat({base}.firsts, transform(filter({gone}, o -> o.card >= 0), "
              "o -> named_struct('card', o.card, 'first', o.first)))")
    spans = (f"concat({base}.spans, transform(filter({gone}, o -> o.info >= 0), "
             f"o -> named_struct('info', o.info, 'start', o.start, 'end', {at})))")
    return firsts, spans


_FIRSTS, _SPANS = _ended("gone", "acc.i", "acc")
_NEAREST = "if(t.card, acc.cards, coalesce(try_element_at(filter(given, o -> o.card >= 0), -1).card, -1))"
_CARDS_STEP = bind(_ENDS, "ends", bind(_GIVEN, "given", bind(
    "CASE WHEN t.closing THEN slice(given, size(given) - ends + 1, ends) WHEN t.opens THEN slice(given, 1, 0) "
    f"WHEN t.card OR t.info THEN array({_OWN}) ELSE slice(given, 1, 0) END", "gone", f"""named_struct(
  'open', CASE WHEN t.closing THEN slice(given, 1, size(given) - ends)
    WHEN t.opens THEN concat(given, array({_OWN})) ELSE given END,
  'i', acc.i + 1, 'cards', acc.cards + int(t.card), 'infos', acc.infos + int(t.info),
  'listed', if(t.link, concat(acc.listed, array(named_struct('tag', t.tag, 'card', {_NEAREST}))), acc.listed),
  'firsts', if(size(gone) = 0, acc.firsts, {_FIRSTS}), 'spans', if(size(gone) = 0, acc.spans, {_SPANS}))""")))


def _has_token(name: str, token: str) -> str:
    pattern = quoted(rf"(?is)\A<[a-z][^\s/>]*+{H.class_token(token)}")
    return f"({name}.whole AND contains({name}.tag, {quoted(token)}) AND rlike({name}.tag, {pattern}))"


def cards(tokens: Column, card: str, info: str, link: str) -> Column:
    """Where a page's cards and their information are, from its tags: ``listed`` has the tag of each link of class
    ``link`` and the number of its nearest enclosing card, -1 for none; ``firsts`` the number of the first element of
    class ``info`` within each card; ``spans`` between which tags each such element lies. Numbers are places in order."""
    basic = (f"named_struct('tag', x, 'name', {_NAME}, 'closing', startswith(x, '</'), 'whole', rlike(x, {_WHOLE}))")
    parsed = ("transform(tokens, x -> " + bind(basic, "b", "named_struct('tag', b.tag, 'name', b.name, 'closing', b.closing, "
              f"'opens', b.whole AND NOT endswith(b.tag, '/>') AND b.name NOT IN ('', {_VOID}), "
              f"'card', {_has_token('b', card)}, 'info', {_has_token('b', info)}, "
              f"'link', b.name = 'a' AND {_has_token('b', link)})") + ")")
    walked = _in_blocks("parsed", _CARDS_START, _CARDS_STEP, ("listed", "firsts", "spans"), ("open", "i", "cards", "infos"))
    firsts, spans = _ended("w.open", "w.i", "w")
    ended = bind(walked, "w", f"named_struct('listed', w.listed, 'firsts', array_sort({firsts}), 'spans', array_sort({spans}))")
    return apply(tokens, f"tokens -> {bind(parsed, 'parsed', ended)}")


def between(tokens: Column, texts: Column, start: Column, end: Column) -> Column:
    """The page between two of its tags, from the lists of tags and of the texts before, between and after them."""
    pieces = F.transform(F.sequence(start, F.greatest(start, end - 1)), lambda j: F.concat(
        F.when(j == start, "").otherwise(F.get(tokens, j)), F.get(texts, j + 1)))
    return F.when(end > start, F.array_join(pieces, "")).otherwise("")
