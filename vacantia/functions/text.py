"""Text clean-up, location, date and file-name expressions.  All are plain Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import rules

# White space as the collectors see it: Unicode white space and the four separators
# U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{SPACE}+|{SPACE}+$"
# What is not yet a single space; single spaces are the most frequent and stay untouched.
_UNEVEN = rf"(?U)[\x1c-\x1f[\s&&[^ ]]]{SPACE}*| {SPACE}+"

# Named character references: the public table of the HTML standard, as the standard library has
# it, as one text of entries ``\x01&name;\x02character`` (a map literal of that size would weigh
# on every plan).
ENTITIES = "".join(f"\x01&{name}\x02{char}" for name, char in sorted(html5.items())
                   if name.endswith(";") and name != "amp;") + "\x01"
NOISE = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>"
TAG = r"</?[a-zA-Z!?][^>]*>"
# An attribute value that holds < or >, as far as a quick look can tell.
MARKS_IN_VALUE = r"""=\s*(?:"[^"<>]*+[<>]|'[^'<>]*+[<>])"""
# Markup piece by piece from the left: what begins first decides what a < or > inside it means.  A
# quote opens a value only behind an equals sign; one that is never closed is an ordinary character.
_INSIDE = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>"""
PIECES = (rf"(?is)<!--.*?-->|<(script|style|template)\b{_INSIDE}.*?</\1\s*>|</?[a-z!?]{_INSIDE}|[^<]++|<")
VALUES = r"""(?s)=\s*"[^"]*"|=\s*'[^']*'|[^=]++|="""
# Possessive, so that long runs of tags are matched in a loop and not by recursion.
PIECE_GAP = rf"(?U){SPACE}*+(?:{TAG}{SPACE}*+)++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(*columns: Column) -> Column:
    """Columns computed once, whatever is filtered later.

    A filter on a computed column is pushed below its projection and computes it again; it
    is not pushed below a generator.  Use as the only generator of a ``select``.
    """
    return F.inline_outer(F.array(F.struct(*columns)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def clean_text(text: Column) -> Column:
    """Runs of white space become one space, edges are cut, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " "))


def is_blank(text: Column) -> Column:
    """Null or white space only; stops at the first other character."""
    return ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def _decode_numeric(text: Column) -> Column:
    """``&#65;`` and ``&#x41;`` become the character."""

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));?", 1)
        hexed = F.regexp_extract(part, r"^&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));?", 2)
        point = F.when(digits != "", F.conv(digits, 10, 16)).otherwise(hexed)
        rest = F.regexp_replace(part, r"^&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", "")
        number = F.conv(point, 16, 10).cast("bigint")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")
        return F.when(point == "", part).when(valid, F.concat(char, rest)).otherwise(
            F.concat(F.lit("�"), rest))

    return F.when(
        text.contains("&#"), F.array_join(F.transform(F.split(text, "(?=&#)"), one), "")
    ).otherwise(text)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def decode_entities(text: Column) -> Column:
    """Character references become characters; only those a text holds are looked up."""
    def character(name: Column) -> Column:
        entry, table = F.concat(F.lit("\x01"), name, F.lit("\x02")), F.lit(ENTITIES)
        after = F.call_function("substring_index", table, entry, F.lit(-1))
        return F.when(table.contains(entry), F.substring_index(after, "\x01", 1)).otherwise(name)

    def decode(given: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(given, F.lit("&(?!amp;)[a-zA-Z][a-zA-Z0-9]*;"), F.lit(0)))
        named = F.aggregate(found, given, lambda acc, name: F.replace(acc, name, character(name)))
        decoded = let(named, lambda t: F.replace(_decode_numeric(t), F.lit("&amp;"), F.lit("&")))
        return F.when(given.contains("&"), decoded).otherwise(given)

    return let(text, decode)


def drop_noise(html: Column) -> Column:
    """Without comments, scripts, styles and templates; in the tags that are left every < and >
    inside a value is written as a character reference, so that a tag ends at its first >."""
    return F.when(html.rlike(MARKS_IN_VALUE), _piece_by_piece(html)).otherwise(F.regexp_replace(html, NOISE, " "))


def _piece_by_piece(html: Column) -> Column:
    def sheltered(tag: Column) -> Column:
        values = F.transform(F.regexp_extract_all(tag, F.lit(VALUES), F.lit(0)), lambda v: F.when(
            v.rlike("(?s)^=.*[<>]"), F.replace(F.replace(v, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))).otherwise(v))
        return F.array_join(values, "")

    def cleaned(piece: Column) -> Column:
        return (F.when(piece.rlike(r"(?i)^<(?:!--|(?:script|style|template)\b)") & piece.rlike(r"(?is)(?:-->|</(?:script|style|template)\s*>)$"), " ")
                .when(piece.rlike(r"(?s)^</?[a-zA-Z!?].*[<>].*>$"), sheltered(piece)).otherwise(piece))

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(PIECES), F.lit(0)), cleaned), "")


def tags_to_spaces(markup: Column) -> Column:
    """Text of noise-free markup, pieces parted by a space."""
    return clean_text(decode_entities(F.regexp_replace(markup, TAG, " ")))


def tags_to_nothing(markup: Column) -> Column:
    """Text of noise-free markup, each piece stripped and the pieces run together."""
    spaced = F.replace(markup, F.lit("&nbsp;"), F.lit("\u00a0"))
    joined = F.regexp_replace(spaced, PIECE_GAP, "")
    return clean_text(decode_entities(joined))


def tags_to_pieces(markup: Column) -> Column:
    """Text of noise-free markup, each piece stripped and the pieces joined by a space."""
    spaced = F.replace(markup, F.lit("&nbsp;"), F.lit("\u00a0"))
    return strip(decode_entities(
        F.regexp_replace(spaced, PIECE_GAP, " ")))


def html_to_text(html: Column) -> Column:
    return tags_to_spaces(drop_noise(F.coalesce(html, F.lit(""))))


def split_location(text: Column) -> dict[str, Column]:
    """City is the first comma part, region the second, country the last of several."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    several = F.size(parts) > 1
    return {
        "city": clean_text(F.get(parts, F.lit(0))),
        "region": F.when(several, clean_text(F.get(parts, F.lit(1)))).otherwise(F.lit("")),
        "country": F.when(several, clean_text(F.element_at(parts, -1))).otherwise(F.lit("")),
    }


# Date layouts by the look of the text; text of no such look is no date.  The look is tested
# first because a failing parse costs far more than a pattern.
DATE_LAYOUTS = (
    (r"^\d{4}(-.*)?$", None),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
)


def parse_date(text: Column) -> Column:
    """Lenient time stamp (session time zone UTC); text that is no date gives null."""
    trimmed = strip(text)
    out = F
    for look, layout in DATE_LAYOUTS:
        read = F.try_to_timestamp(trimmed, F.lit(layout)) if layout else F.try_to_timestamp(trimmed)
        out = out.when(trimmed.rlike(look), read)
    return out


def year_month(date_posted: Column, capture: Column) -> Column:
    """Month of the posting date, else of the capture."""
    return F.date_format(F.coalesce(parse_date(date_posted), parse_date(capture)), "yyyy-MM")


def year_of_month(month: Column) -> Column:
    """Year of ``yyyy-MM``; anything else gives null, so that the row can be dropped."""
    return F.substring(month, 1, 4).try_cast("int")


def slug_of_file(name: Column) -> Column:
    for suffix in rules.SLUG_SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    return name


def source_of_file(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# A list of texts as Python writes it.  Neighbouring literals are one text.
_LITERAL = r"""(?:'(?:[^'\\\r\n]++|\\(?s:.))*+'|"(?:[^"\\\r\n]++|\\(?s:.))*+")"""
_ITEM = rf"(?:{_LITERAL}(?:\s*+{_LITERAL})*+|None)"
_LIST = rf"^\s*+\[\s*+(?:{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+(?:,\s*+)?+)?+\]\s*+$"
_ESCAPE = r"(?s)\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)|[^\\]++"
# Not a character: a number beyond the last, half a pair, or an escape cut short.
_NO_TEXT = (r"(?s)(?<!\\)(?:\\\\)*+\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N|u[dD][89a-fA-F]"
            r"|U0000[dD][89a-fA-F]|U(?!00(?:0|10)))")
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "a": "\x07", "b": "\b", "f": "\f", "v": "\x0b", "\\": "\\", "'": "'", '"': '"', "\n": ""}


def _unescaped(body: Column) -> Column:
    def one(part: Column) -> Column:
        second = F.substring(part, 2, 1)
        octal = F.conv(F.substring(part, 2, 3), 8, 16)
        point = F.when(second.isin("x", "u", "U"), F.substring(part, 3, 8)).otherwise(octal)
        char = F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")
        named = part
        for letter, value in _LETTERS.items():
            named = F.when(part == "\\" + letter, F.lit(value)).otherwise(named)
        return F.when(~part.startswith("\\"), part).when(second.rlike("^[xuU0-7]"), char).otherwise(named)

    parts = F.regexp_extract_all(body, F.lit(_ESCAPE), F.lit(0))
    return F.when(body.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(body)


def parse_list(text: Column) -> Column:
    """``['a', "b's", None]`` as written by list columns in CSV becomes an array of texts.

    Escapes, both quotes, neighbouring literals and a comma at the end are read as Python reads
    them, also with line breaks between items; None becomes null.  Anything that is not a list of
    texts, literals with a prefix among them, gives null.
    """
    def item(found: Column) -> Column:
        literals = F.regexp_extract_all(found, F.lit(_LITERAL), F.lit(0))
        texts = F.transform(literals, lambda x: _unescaped(F.substring(x, F.lit(2), F.length(x) - 2)))
        return F.when(found != "None", F.array_join(texts, ""))

    items = F.transform(F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0)), item)
    return F.when(text.rlike(_LIST) & ~text.rlike(_NO_TEXT), items)


# --- choice of columns by name; runs on the schema only ---

def description_column(columns: Sequence[str], loose: bool = True) -> str | None:
    """First column whose name holds ``description`` (loose) or is a known name."""
    if loose:
        return next((c for c in columns if "description" in c.lower()), None)
    return next((c for c in columns if c.lower() in rules.DESCRIPTION_NAMES), None)


def date_column(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if "date" in c.lower() or c.lower() == "timestamp"), None)


def label_column(columns: Sequence[str]) -> str:
    return next((c for c in ("label", "true_label") if c in columns), None) or columns[2]
