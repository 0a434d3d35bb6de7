"""Expressions that read captured pages: junk test, JSON-LD, element lookup.

Pages stay in their row from markup to posting: blocks and elements are arrays folded
inside the row, so extraction needs no shuffle and keeps no state between rows.

Attribute values may stand in double, single or no quotes.  Limits of reading markup by pattern:
an attribute value holding ``>`` ends its tag early.  Elements of the same name nested in each
other are balanced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import rules
from vacantia.functions.text import (
    clean_text, decode_entities, html_to_text, let, sql_text, tags_to_nothing, tags_to_spaces,
)
from vacantia.functions.urls import any_of, by_board

LD_BLOCK = (r"""(?is)<script\b[^>]*\stype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)"""
            r"""</script\s*>""")
LD_FIELDS = ("title", "date_posted", "employment_type", "company", "city", "region", "country",
             "description")


def is_junk(html: Column, board: Column | None = None) -> Column:
    """Missing, too short once stripped, or holding a marker of its board."""
    inner = rules.MIN_PAGE_CHARS - 2
    long_enough = html.rlike(rf"(?Us)[^\s\x1c-\x1f].{{{inner},}}[^\s\x1c-\x1f]")

    def marked(low: Column) -> Column:
        def hit(markers) -> Column:
            return any_of(low.contains(m) for m in markers)

        if board is None:
            return hit(rules.BACKFILL_JUNK_MARKERS)
        return by_board(board, rules.JUNK_MARKERS, hit, False)

    clean = long_enough & ~F.coalesce(let(F.lower(html), marked), F.lit(False))
    return ~F.coalesce(clean, F.lit(False))


# --- JSON-LD -----------------------------------------------------------------

def _text_at(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def posting_nodes(html: Column) -> Column:
    """JobPosting nodes of the page's JSON-LD blocks, in page order.

    A block is an object or an array; an array counts for its first JobPosting.  Broken
    blocks and other types are skipped.
    """
    def pick(block: Column) -> Column:
        parsed = F.try_parse_json(block)
        return let(parsed, lambda v: F.get(F.filter(
            F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
            lambda n: _text_at(n, "$['@type']") == "JobPosting"), F.lit(0)))

    blocks = F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1))
    return F.filter(F.transform(blocks, pick), lambda n: n.isNotNull())


def _is_object(node: Column, path: str) -> Column:
    """Missing counts as an empty object; a text, number or list does not."""
    kind = F.schema_of_variant(F.try_variant_get(node, path, "variant"))
    return kind.isNull() | kind.startswith("OBJECT")


def _address(node: Column, part: str) -> Column:
    return F.coalesce(_text_at(node, f"$.jobLocation[0].address.{part}"),
                      _text_at(node, f"$.jobLocation.address.{part}"))


def jsonld_fields(html: Column, country: Column) -> Column:
    """Struct of posting fields after reading blocks up to the first titled posting.

    Blocks without a title leave their fields behind for the page selectors to complete,
    as does the default ``country``.
    """
    empty = F.lit("")
    start = F.struct(*[(country if f == "country" else empty).alias(f) for f in LD_FIELDS])

    def step(acc: Column, node: Column) -> Column:
        description = _text_at(node, "$.description")
        org = _is_object(node, "$.hiringOrganization")
        new = F.struct(
            clean_text(_text_at(node, "$.title")).alias("title"),
            clean_text(_text_at(node, "$.datePosted")).alias("date_posted"),
            clean_text(_text_at(node, "$.employmentType")).alias("employment_type"),
            F.when(org, clean_text(_text_at(node, "$.hiringOrganization.name")))
            .otherwise(acc["company"]).alias("company"),
            clean_text(_address(node, "addressLocality")).alias("city"),
            clean_text(_address(node, "addressRegion")).alias("region"),
            clean_text(_address(node, "addressCountry")).alias("country"),
            F.when(F.coalesce(description, empty) != "", html_to_text(description))
            .otherwise(acc["description"]).alias("description"),
        )
        return F.when(acc["title"] != "", acc).otherwise(new)

    return F.aggregate(posting_nodes(html), start, step)


def jsonld_description(html: Column) -> Column:
    """Text of the first JSON-LD posting that has a description, else ''."""
    raw = F.filter(F.transform(posting_nodes(html), lambda n: _text_at(n, "$.description")),
                   lambda d: d.isNotNull() & (d != ""))
    return html_to_text(F.get(raw, F.lit(0)))


# --- elements -------------------------------------------------------------------

def open_tag_pattern(tag: str, attribute: str, value: str) -> str:
    """Pattern of an element's opening tag.  The attribute's last character tells the test:
    ``~`` search ignoring case, ``*`` contains, ``^`` a class starting so, else equality."""
    if not attribute:
        return rf"(?i)<{tag}\b[^>]*>"
    kind = attribute[-1] if attribute[-1] in "~*^" else "="
    name = attribute.rstrip("~*^")
    if kind == "~":
        value = value.replace(".", "[^\"'>]")
    bare = r"""[^\s"'>=<`]*"""
    body = {
        "=": rf"""(?:["']{value}["']|{value}(?=[\s/>]))""",
        "~": rf"""(?:["'][^"'>]*(?i:{value})[^"'>]*["']|{bare}(?i:{value}){bare}(?=[\s>]))""",
        "*": rf"""(?:["'][^"'>]*{value}[^"'>]*["']|{bare}{value}{bare}(?=[\s>]))""",
        "^": rf"""(?:(?:["']|["'][^"'>]*\s)(?i:{value})[^"'>]*["']|(?i:{value}){bare}(?=[\s>]))""",
    }[kind]
    return rf"<(?i:{tag})\b[^>]*\s(?i:{name})\s*=\s*{body}[^>]*>"


def _balanced(rest: Column, tag: Column) -> Column:
    """Markup after an opening tag up to the closing tag that matches it, or to the end."""
    def delta(part: Column, index: Column) -> Column:
        starts = F.rlike(part, F.concat(F.lit("(?i)^</?"), tag, F.lit(r"\b")))
        step = F.when(part.startswith("</"), -1).otherwise(1)
        return F.when((index > 0) | starts, step).otherwise(0)

    def step(acc: Column, change: Column) -> Column:
        inside = acc["depth"] + change > 0
        return F.when(acc["depth"] <= 0, acc).otherwise(F.struct(
            (acc["depth"] + change).alias("depth"),
            (acc["kept"] + F.when(inside, 1).otherwise(0)).alias("kept")))

    def inner(parts: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))
        kept = F.aggregate(F.transform(parts, delta), start, step)["kept"]
        return F.array_join(F.slice(parts, F.lit(1), kept), "")

    return let(F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)"))), inner)


def first_element(html: Column, tag: Column, pattern: Column) -> Column:
    """Struct (opening tag, inner markup) of the first element found, else null.

    Most elements end at the first closing tag of their name; then one pattern cuts them out
    and the rest of the page is not copied.  Nested and unclosed ones are balanced.
    """
    def after_opening(markup: Column, opening: Column) -> Column:
        return F.substring(markup, F.length(opening) + 1, F.length(markup))

    def balanced_from(position: Column) -> Column:
        tail = F.substring(html, position, F.length(html))
        return F.when(position > 0, let(tail, lambda t: let(_opening(t), lambda opening: F.struct(
            opening.alias("opening"), _balanced(after_opening(t, opening), tag).alias("inner")))))

    def cut(found: Column) -> Column:
        return let(_opening(found), lambda opening: let(
            F.regexp_replace(after_opening(found, opening), "</[^<]*$", ""),
            lambda head: F.when(~F.rlike(head, F.concat(F.lit("(?i)<"), tag, F.lit(r"\b"))), F.struct(
                opening.alias("opening"), head.alias("inner")))))

    closing = F.when(tag == "meta", F.lit("")).otherwise(F.concat(F.lit("(?s:.*?)</(?i:"), tag, F.lit(r")\b")))
    quick = F.call_function("regexp_extract", html, F.concat(pattern, closing), F.lit(0))
    return F.coalesce(
        let(quick, lambda found: F.when(found != "", cut(found))),
        let(F.regexp_instr(html, pattern), balanced_from))


def _opening(markup: Column) -> Column:
    return F.regexp_extract(markup, "^<[^>]*>", 0)


def _attribute(opening: Column, name: str) -> Column:
    """An attribute's value, in double, single or no quotes; '' without it."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>=<`]+))"""
    return decode_entities(F.concat(*[F.regexp_extract(opening, pattern, i) for i in (1, 2, 3)]))


def _must_hold(attribute: str, value: str) -> list[list[str]]:
    """Lower-case texts the opening tags must hold for a selector to fit: one of each list."""
    if not attribute:
        return []
    words = [re.split(r"[.]", part)[0].lower() for part in value.split("|")]
    return [[attribute.rstrip("~*^").lower()], words]


def _selectors_sql(selectors) -> str:
    def texts(listed: list[str]) -> str:
        return "array(" + ", ".join(map(sql_text, listed)) + ")"

    def one(tag: str, attribute: str, value: str) -> str:
        needs = ", ".join(texts(words) for words in _must_hold(attribute, value))
        needs = f"array({needs})" if needs else "cast(array() AS array<array<string>>)"
        return (f"struct({sql_text(tag)} AS tag, {sql_text(open_tag_pattern(tag, attribute, value))} AS pattern, "
                f"{needs} AS needs)")

    return "array(" + ", ".join(one(*selector) for selector in selectors) + ")"


def opening_tags(html: Column) -> Column:
    """The page's opening tags alone, lower-cased."""
    return F.lower(F.array_join(F.regexp_extract_all(html, F.lit("<[a-zA-Z][^>]*>"), F.lit(0)), ""))


def first_text(html: Column, low: Column, selectors: Column, read, accept) -> Column:
    """Try selectors in order and stop at the first whose text is accepted, else null.

    ``low`` holds the page's opening tags: a selector whose words are in none of them is passed
    over without running its pattern, which would read the whole page.
    """
    def step(acc: Column, selector: Column) -> Column:
        possible = F.forall(selector["needs"], lambda words: F.exists(words, lambda w: low.contains(w)))
        element = first_element(html, selector["tag"], selector["pattern"])
        text = let(element, lambda e: F.when(e.isNotNull(), read(e)))
        return F.when(acc.isNotNull(), acc).when(possible, let(text, lambda t: F.when(accept(t), t)))

    return F.aggregate(selectors, F.lit(None).cast("string"), step)


def _long_text(element: Column) -> Column:
    return tags_to_spaces(element["inner"])


# Fields read by selectors, in the order of the array that holds them.
FIELDS = ("title", "company", "location", "region", "date_posted", "employment_type", "description",
          "main")
_NO_LIMIT = 2**31 - 1


def _field_sql(board: str, field: str) -> str:
    """How a board reads a field: the way to take the text, its limit and the selectors."""
    if field in ("description", "main"):
        way = "long"
    elif field == "title" or board in rules.TEXT_ONLY.get(field, ()):
        way = "short"
    else:
        way = "date" if field == "date_posted" else "content"
    longest = rules.TOO_LONG.get(field, {}).get(board, _NO_LIMIT)
    selectors = rules.SELECTORS[board].get(field, ())
    listed = _selectors_sql(selectors) if selectors else f"slice({_selectors_sql((('h1', '', ''),))}, 1, 0)"
    return f"struct('{way}' AS way, {longest} AS longest, {listed} AS selectors)"


def selector_fields(html: Column, board: Column) -> Column:
    """Texts of ``FIELDS`` by the board's selectors on noise-free markup; null where none fits.

    The selectors are one constant map from board to fields, so all boards share one plan.
    """
    table = F.expr("map(" + ", ".join(
        f"'{b}', array(" + ", ".join(_field_sql(b, f) for f in FIELDS) + ")"
        for b in rules.SELECTORS) + ")")

    def read(field: Column, low: Column) -> Column:
        def text(element: Column) -> Column:
            content = F.nullif(clean_text(_attribute(element["opening"], "content")), F.lit(""))
            moment = F.nullif(clean_text(_attribute(element["opening"], "datetime")), F.lit(""))
            way = field["way"]
            return F.when(way == "long", _long_text(element)).otherwise(F.coalesce(
                F.when(way == "date", moment), F.when(way != "short", content),
                tags_to_nothing(element["inner"])))

        # Of a long text the first element present is taken, even when it is empty.
        return first_text(html, low, field["selectors"], text, lambda t: F.when(
            field["way"] == "long", t.isNotNull()).otherwise(
            (F.length(t) > 0) & (F.length(t) < field["longest"])))

    return let(opening_tags(html), lambda low: F.transform(
        F.try_element_at(table, board), lambda field: read(field, low)))


# --- descriptions for the backfill ---------------------------------------------------

def _without(markup: Column, unwanted: str) -> Column:
    """Markup without elements whose class holds one of the unwanted words."""
    void = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
            "track", "wbr")
    bad = rf"""(?is)^<[a-z][^>]*\sclass\s*=\s*["'][^"'>]*(?:{unwanted})"""
    start = F.struct(F.lit("").alias("skip"), F.lit(0).alias("depth"), F.lit(0).alias("at"),
                         F.lit(0).alias("from"), F.array().cast("array<struct<b:int,e:int>>").alias("runs"))

    def step(acc: Column, token: Column) -> Column:
        """Only places are carried: where the token begins, where the dropped run began, and the
        dropped runs.  A run is added when its element closes."""
        name = F.lower(F.regexp_extract(token, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        after = acc["at"] + F.length(token)
        change = F.when(name != acc["skip"], 0).when(token.startswith("</"), -1).otherwise(1)
        depth = acc["depth"] + change

        def state(skip, depth, begin, runs):
            return F.struct(skip.alias("skip"), depth.alias("depth"), after.alias("at"), begin.alias("from"), runs.alias("runs"))

        def run(begin):
            return F.concat(acc["runs"], F.array(F.struct(begin.alias("b"), after.alias("e"))))

        nothing, zero = F.lit(""), F.lit(0)
        inside = F.when(depth > 0, state(acc["skip"], depth, acc["from"], acc["runs"])).otherwise(
            state(nothing, zero, zero, run(acc["from"])))
        entered = F.when(name.isin(*void), state(nothing, zero, zero, run(acc["at"]))).otherwise(
            state(name, F.lit(1), acc["at"], acc["runs"]))
        outside = state(nothing, zero, zero, acc["runs"])
        return F.when(acc["depth"] > 0, inside).when(token.rlike(bad), entered).otherwise(outside)

    def kept(markup: Column, end: Column) -> Column:
        """What lies between the dropped runs; an element left open drops the rest."""
        length = F.length(markup)
        runs = F.when(end["depth"] > 0, F.concat(end["runs"], F.array(
            F.struct(end["from"].alias("b"), length.alias("e"))))).otherwise(end["runs"])
        begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["e"]))
        ends = F.concat(F.transform(runs, lambda r: r["b"]), F.array(length))
        return F.array_join(F.zip_with(begins, ends, lambda b, e: F.substring(markup, b + 1, e - b)), "")

    tokens = F.regexp_extract_all(markup, F.lit(r"(?s)</?[a-zA-Z!?][^>]*>|[^<]+|<"), F.lit(0))
    cleaned = let(F.aggregate(tokens, start, step), lambda end: kept(markup, end))
    return F.when(markup.rlike(rf"(?i){unwanted}"), cleaned).otherwise(markup)


def page_description(html: Column, noise_free: Column) -> Column:
    """Description of a stored page: JSON-LD, then the content block, rich-text blocks and
    four selectors, each of which must exceed 200 characters; '' when none does."""
    def long_enough(text: Column) -> Column:
        return F.when(F.length(text) > rules.BACKFILL_MIN_CHARS, text)

    tag, attr, value = rules.BACKFILL_CONTAINER
    container = let(
        first_element(noise_free, F.lit(tag), F.lit(open_tag_pattern(tag, attr, value))),
        lambda e: F.when(e.isNotNull(),
                         tags_to_spaces(_without(e["inner"], rules.BACKFILL_UNWANTED))))
    tag, attr, value = rules.BACKFILL_BLOCKS
    opening = open_tag_pattern(tag, attr, value)
    pieces = F.split(noise_free, f"(?={opening})")
    blocks = F.array_join(F.transform(
        F.filter(pieces, lambda p: p.rlike("^" + opening)),
        lambda p: tags_to_spaces(_balanced(F.regexp_replace(p, "^<[^>]*>", ""), F.lit("div")))), " ")
    by_selector = let(opening_tags(noise_free), lambda low: first_text(
        noise_free, low, F.expr(_selectors_sql(rules.BACKFILL_SELECTORS)), _long_text,
        lambda t: F.length(t) > rules.BACKFILL_MIN_CHARS))
    return F.coalesce(
        F.nullif(jsonld_description(html), F.lit("")), long_enough(container),
        long_enough(clean_text(blocks)), by_selector, F.lit(""))
