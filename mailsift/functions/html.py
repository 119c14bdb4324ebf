"""Visible text of an HTML mail body, with JVM-side expressions only."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions.text import fill_blank, let, squash_ws

# The inside of a tag up to its `>`: a quoted attribute value may itself hold `>`, a quote
# that nothing closes is a plain character. Possessive, so long attributes (embedded
# images) neither backtrack nor recurse; and since any tag ends at some later `>`, no text
# is gone through again for the next one.
_TAG_END = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>])?)*+>"""

# Everything that is not text, found in one left-to-right pass, so that a tag inside
# a comment or a script is never taken for markup of its own.
MARKUP = "(?is)<(?:%s)" % "|".join(
    [
        r"!--.*?-->",
        rf"script(?:[\s/]{_TAG_END}|>).*?(?:</script\s*+>|\z)",
        rf"style(?:[\s/]{_TAG_END}|>).*?(?:</style\s*+>|\z)",
        rf"template(?:[\s/]{_TAG_END}|>).*?(?:</template\s*+>|\z)",
        rf"r[tp](?:[\s/]{_TAG_END}|>)[^<]*+",
        rf"/?[a-z]{_TAG_END}",
        r"[!?][^>]*+>",
        r"/[^a-z>][^>]*+>",
    ]
)

# Elements that hold no phrasing content alone, so that inside a reading aid their end tag
# belongs to something outside of it, if they were not opened there.
_BLOCKS = (
    "address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|html|li|main|nav|ol|p|"
    "pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
_HIDING = "template|ruby|r[tp]"
_MAY_HIDE = r"(?i)<(?:template|r[tp])[\s/>]"

# As MARKUP, but templates and reading aids are tags like any other; the first group has the
# name of those that the fold below follows, with its slash.
_FOLLOWED = "(?is)<(?:%s)" % "|".join(
    [
        r"!--.*?-->",
        rf"script(?:[\s/]{_TAG_END}|>).*?(?:</script\s*+>|\z)",
        rf"style(?:[\s/]{_TAG_END}|>).*?(?:</style\s*+>|\z)",
        rf"(?:{_HIDING}|{_BLOCKS})\s*+/>",
        rf"(/?(?:{_HIDING}|{_BLOCKS}))(?=[\s/>]){_TAG_END}",
        rf"/?[a-z]{_TAG_END}",
        r"[!?][^>]*+>",
        r"/[^a-z>][^>]*+>",
    ]
)
# Noncharacters around the name of a tag that is followed.
_TAG, _NAMED = "\ufdd2", "\ufdd3"
#: Tags in one step of the outer fold, and open elements that are told apart.
_CHUNK, _DEEPEST = 256, 1000

# Noncharacters that stand in for markup openings which are never closed.
_OPEN, _DASHES = "\ufdd0", "\ufdd1"

# Names that make up nearly all references in mail; any other takes the general way.
FREQUENT = ("nbsp", "lt", "gt", "quot", "apos", "copy", "reg", "middot", "bull", "hellip",
            "ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "amp")
_OTHER_REFERENCE = "&(?!(?:%s);)[#a-zA-Z]" % "|".join(FREQUENT)


def _literal_map(table: dict) -> Column:
    """A constant map, handed over as one string and folded by the optimizer."""
    pairs = "\x01".join(f"{key}\x02{value}" for key, value in table.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def _named() -> dict[str, str]:
    return {name.rstrip(";"): chars for name, chars in html5.items()}


def _windows_1252() -> dict[int, str]:
    pairs = ((code, bytes([code]).decode("cp1252", "ignore")) for code in range(128, 160))
    return {code: char for code, char in pairs if char}


def char_of(code: Column) -> Column:
    """The character with this code point; U+FFFD where there is none."""

    def units(c: Column, digits: int) -> Column:
        return F.unhex(F.lpad(F.hex(c), digits, "0"))

    above = code - 0x10000
    pair = F.concat(
        units(F.shiftright(above, 10) + 0xD800, 4), units(above.bitwiseAND(0x3FF) + 0xDC00, 4)
    )
    return (
        F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | code.isNull(), "\ufffd")
        .when(code < 0x10000, F.decode(units(code, 4), "UTF-16BE"))
        .otherwise(F.decode(pair, "UTF-16BE"))
    )


def _numeric(digits: Column) -> Column:
    """Character for the digits of a numeric reference (``x`` first when hexadecimal)."""
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    # Eight digits or more, leading zeros aside, lie beyond the last code point.
    number = F.regexp_replace(digits, "^[xX]?0*(?=.)", "")
    value = F.when(is_hex, F.conv(number, 16, 10)).otherwise(F.conv(number, 10, 10))
    code = F.when(F.length(number) < 8, value).cast("int")
    return let(
        code, lambda n: F.coalesce(F.try_element_at(_literal_map(_windows_1252()), n.cast("string")), char_of(n))
    )


def _decode_piece(piece: Column) -> Column:
    """Decode the reference at the start of a piece of text that followed an ``&``."""

    def rest(length: Column) -> Column:
        """What follows the reference and its semicolon."""
        end = F.when(F.substring(piece, length + 1, F.lit(1)) == ";", 2).otherwise(1)
        return F.substring(piece, length + end, F.length(piece))

    def decoded(token: Column) -> Column:
        named = F.coalesce(
            F.try_element_at(_literal_map(_named()), token), F.concat(F.lit("&"), token)
        )
        number = _numeric(F.substring(token, F.lit(2), F.length(token)))
        return F.concat(
            F.when(F.startswith(token, F.lit("#")), number).otherwise(named),
            rest(F.length(token)),
        )

    return let(
        F.regexp_extract(piece, "^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*)", 0),
        lambda token: F.when(token != "", decoded(token)).otherwise(F.concat(F.lit("&"), piece)),
    )


def _decode_all(c: Column) -> Column:
    """General way: cut the text at every ``&`` and decode what follows each cut."""

    def joined(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decode_piece)
        return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))

    return let(F.split(c, "&"), joined)


def _decode_frequent(c: Column) -> Column:
    """Plain replacements, ``&amp;`` last, so that what it uncovers stays as it is."""
    for name in FREQUENT:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(html5[f"{name};"]))
    return c


def decode_entities(c: Column) -> Column:
    """Replace character references, each exactly once, so ``&amp;lt;`` becomes ``&lt;``."""
    return let(
        c,
        lambda t: F.when(~F.contains(t, F.lit("&")), t)
        .when(t.rlike(_OTHER_REFERENCE), _decode_all(t))
        .otherwise(_decode_frequent(t)),
    )


def _shelter(c: Column) -> Column:
    """Hide ``<`` after the last ``>`` and ``<!--`` after the last ``-->``.

    Neither can open anything that matches, yet each would make the matcher look through
    the rest of the text: quadratic time on hostile or plain text with many of them.
    """

    def in_tail(t: Column, end: str, old: str, new: str) -> Column:
        tail = F.substring_index(t, end, -1)
        head = F.left(t, F.length(t) - F.length(tail))
        return F.concat(head, F.replace(tail, F.lit(old), F.lit(new)))

    return let(
        in_tail(c, "-->", "<!--", f"<!{_DASHES}"), lambda t: in_tail(t, ">", "<", _OPEN)
    )


def _uncover(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(_DASHES), F.lit("--")), F.lit(_OPEN), F.lit("<"))


def _follow(state: Column, piece: Column) -> Column:
    """The state after a tag and the text behind it.

    ``templates`` counts open templates; ``open`` has a letter for each open ruby (R),
    reading aid (A), and block inside an aid (B). An aid ends at its end tag, at the next
    aid of the same ruby, at the end of the ruby, and at the end of a block around it; a
    template only at its own end tag. Text is seen where neither is open.
    """
    templates, opened = state["templates"], state["open"]
    tag = F.lower(F.substring_index(piece, _NAMED, 1))
    behind = F.substring(piece, F.length(tag) + 2, F.length(piece))

    def pushed(letter: str) -> Column:
        return F.when(F.length(opened) < _DEEPEST, F.concat(opened, F.lit(letter))).otherwise(opened)

    def cut(letter: str) -> Column:
        """Without the innermost such element and all that is inside it."""
        return F.regexp_replace(opened, f"{letter}[^{letter}]*$", "")

    in_aid = F.contains(opened, F.lit("A"))
    now_open = (
        F.when((tag == "") | (templates > 0) | tag.endswith("template"), opened)
        .when(tag == "ruby", pushed("R"))
        .when(tag == "/ruby", cut("R"))
        .when(tag.isin("rt", "rp"), F.when(opened.endswith("A"), opened).otherwise(pushed("A")))
        .when(tag.isin("/rt", "/rp"), cut("A"))
        .when(~F.startswith(tag, F.lit("/")), F.when(in_aid, pushed("B")).otherwise(opened))
        .when(F.contains(opened, F.lit("B")), cut("B"))
        .otherwise("")
    )
    now_templates = (
        F.when(tag == "template", templates + 1)
        .when(tag == "/template", F.greatest(templates - 1, F.lit(0)))
        .otherwise(templates)
    )
    after = F.struct(now_templates.alias("templates"), now_open.alias("open"))

    def seen(s: Column) -> Column:
        visible = (s["templates"] == 0) & ~F.contains(s["open"], F.lit("A"))
        text = F.when(visible, F.concat(F.lit(" "), behind)).otherwise(" ")
        return F.struct(s["templates"], s["open"], F.concat(state["texts"], F.array(text)).alias("texts"))

    return let(after, seen)


def _followed(t: Column) -> Column:
    """Text outside of templates and reading aids, however they are nested.

    Tags are folded in chunks, since a fold that gathers texts copies what it has so far
    at every step.
    """
    start = F.struct(F.lit(0).alias("templates"), F.lit("").alias("open"), F.array().cast("array<string>").alias("texts"))

    def chunk(state: Column, pieces: Column) -> Column:
        empty = F.struct(state["templates"], state["open"], F.array().cast("array<string>").alias("texts"))
        return let(
            F.aggregate(pieces, empty, _follow),
            lambda s: F.struct(
                s["templates"],
                s["open"],
                F.concat(state["texts"], F.array(F.array_join(s["texts"], ""))).alias("texts"),
            ),
        )

    def folded(pieces: Column) -> Column:
        tags = F.size(pieces) - 1
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(tags - 1, F.lit(0)) / _CHUNK).cast("int")),
            lambda i: F.slice(pieces, i * _CHUNK + 2, F.lit(_CHUNK)),
        )
        texts = F.aggregate(chunks, start, chunk, lambda s: F.array_join(s["texts"], ""))
        return F.concat(F.element_at(pieces, 1), texts)

    return let(F.split(F.regexp_replace(t, _FOLLOWED, f"{_TAG}$1{_NAMED}"), _TAG), folded)


def without_markup(c: Column) -> Column:
    """Every piece of markup becomes a blank."""

    def blanked(t: Column) -> Column:
        # Few mails have such elements; the others are done with in one pass.
        nested = t.rlike(_MAY_HIDE) & ~F.contains(t, F.lit(_TAG)) & ~F.contains(t, F.lit(_NAMED))
        return F.when(nested, _followed(t)).otherwise(F.regexp_replace(t, MARKUP, " "))

    unclosed = F.contains(F.substring_index(c, ">", -1), F.lit("<")) | F.contains(
        F.substring_index(c, "-->", -1), F.lit("<!--")
    )
    clash = F.contains(c, F.lit(_OPEN)) | F.contains(c, F.lit(_DASHES))
    return F.when(unclosed & ~clash, _uncover(blanked(_shelter(c)))).otherwise(blanked(c))


def html_to_text(c: Column) -> Column:
    """Text nodes joined by a blank; without comments, declarations, scripts, styles,
    templates, and the reading aids of ruby text, with all that is inside them.
    """
    return squash_ws(decode_entities(let(fill_blank(c), without_markup)))
