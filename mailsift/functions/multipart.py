"""Text of multipart mail and of quoted-printable bodies, as JVM-side column expressions.

Only well-formed mail is read here; for all other mail the result is null, and the standard
parser has to read it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift.functions import mime
from mailsift.functions.text import let

# Patterns use `d`, so that `^` and `$` know no line end but "\n". A fold is a line end
# followed by a blank.
_FOLD = r"(?:\n?[ \t])*+"
_WORD = r"[0-9A-Za-z!#$%&*+.^_`{|}~'-]+"
_VALUE = r'(?:"[^"\\\n]*"|[^\s;"\\<>]+)'
_TYPE = rf"(?imd)^Content-Type:{_FOLD}({_WORD}/{_WORD})((?:{_FOLD};{_FOLD}[0-9A-Za-z-]+={_VALUE})*+)[ \t]*+;?[ \t]*+$(?!\n[ \t])"
_BOUNDARY = rf"(?is);{_FOLD}boundary=({_VALUE})"
_HAS_TYPE, _HAS_TRANSFER = r"(?imd)^Content-Type:", r"(?imd)^Content-Transfer-Encoding:"
_TRANSFER = r"(?imd)^Content-Transfer-Encoding:[ \t]*+(7bit|8bit|binary|base64|quoted-printable)$(?!\n[ \t])"
#: Anything that may be an inner boundary of this mail, whatever it stands in. Names spelled
#: in other letters are not found, and then the mail is not whole without them.
_NAMED, _NAMING = rf"[Bb]oundary=({_VALUE})", "oundary="
#: Every equals sign begins an escape or ends a line.
_WHOLE_QUOTED = r"\A(?:[^=]|=[0-9A-Fa-f]{2}|=\r?\n|=\z)*+\z"
#: Mail with more boundary lines, or names for them, goes to the standard parser.
MOST_BOUNDARIES, MOST_NAMES = 1000, 100
_UNKNOWN = "�"
#: Put in front of lines that may be boundaries; mail that holds it goes to the parser.
_MARK = "\x00"


def _without_unknown(decoded: Column, source: Column) -> Column:
    """Decoded text without the marks that stand for bad bytes; null if such marks were sent."""
    sent = F.contains(source, F.lit(_UNKNOWN)) | source.rlike("(?i)=EF(?:=\r?\n)*+=BF(?:=\r?\n)*+=BD")
    return F.when(~sent, F.replace(decoded, F.lit(_UNKNOWN), F.lit("")))


def quoted_printable_text(body: Column) -> Column:
    """A quoted-printable body as UTF-8 text, bad bytes dropped; null unless well-formed.

    Soft line ends go first, so a character may be split over lines. Escapes are spelled
    as percent escapes, whose runs are decoded as bytes before they become text.
    """
    joined = F.regexp_replace(body, r"=(?:\r?\n|\z)", "")
    spelled = F.replace(F.replace(joined, F.lit("%"), F.lit("=25")), F.lit("+"), F.lit("=2B"))
    decoded = F.url_decode(F.replace(spelled, F.lit("="), F.lit("%")))
    return F.when(body.rlike(_WHOLE_QUOTED), _without_unknown(decoded, body))


def quoted_body(header: Column, body: Column) -> Column:
    """The decoded body of quoted-printable mail; null for any other."""
    only = F.lower(F.regexp_extract(header, _TRANSFER, 1)) == "quoted-printable"
    once = F.regexp_count(header, F.lit(_HAS_TRANSFER)) == 1
    return F.when(only & once, quoted_printable_text(body))


def _base64_text(body: Column) -> Column:
    def decoded(letters: Column) -> Column:
        text = F.try_to_binary(letters, F.lit("base64")).cast("string")
        return F.when(letters.rlike(mime.WHOLE_BASE64), let(text, lambda t: F.when(F.is_valid_utf8(t), t)))

    joined = F.replace(F.replace(body, F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))
    return let(joined, decoded)


def _plain_text(body: Column, from_bytes: bool) -> Column:
    """Text of a part without an encoding.

    Read from a string rather than from bytes, the standard parser takes the characters of
    a part for bytes, as long as they are Latin-1.
    """
    if from_bytes:
        return body
    bytes_ = F.encode(F.when(body.rlike(r"\A[\x00-\xff]*+\z"), body), "ISO-8859-1").cast("string")
    narrow = let(bytes_, lambda t: F.when(~F.contains(t, F.lit(_UNKNOWN)), F.replace(F.make_valid_utf8(t), F.lit(_UNKNOWN), F.lit(""))))
    return F.when(body.rlike(r"\A[\x00-\x7f]*+\z"), body).otherwise(narrow)


def _unquoted(value: Column) -> Column:
    return F.rtrim(F.regexp_replace(value, r'\A"|"\z', ""), F.lit(" \t"))


def _content_type(head: Column) -> Column:
    """Lower-case type of a header block; "text/plain" if there is none, null if it is odd."""
    named = F.regexp_count(head, F.lit(_HAS_TYPE))
    found = F.lower(F.regexp_extract(head, _TYPE, 1))
    return F.when(named == 0, "text/plain").when((named == 1) & (found != ""), found)


def _boundary(head: Column) -> Column:
    return _unquoted(F.regexp_extract(F.regexp_extract(head, _TYPE, 2), _BOUNDARY, 1))


def _without_return(body: Column) -> Column:
    """A body without the carriage return of the line end that belongs to the next boundary."""
    return let(
        body, lambda b: F.when(F.endswith(b, F.lit("\r")), F.substring(b, F.lit(1), F.length(b) - 1)).otherwise(b)
    )


def _part(segment: Column, from_bytes: bool) -> Column:
    """What a boundary line, with all up to the next one, says: ``line, kind, inner, text``.

    ``kind`` is close, plain (with its ``text``), multi (with its ``inner`` boundary), other,
    or bad.
    """
    end = F.locate("\n", segment, 2)
    line = F.rtrim(F.substring(segment, F.lit(4), F.when(end > 0, end).otherwise(F.length(segment) + 1) - 4), F.lit(" \t\r"))
    rest, begins = mime.from_char(segment, end + 1), end > 0

    def opened(rest: Column) -> Column:
        def with_body(head: Column, body: Column) -> Column:
            transfers = F.regexp_count(head, F.lit(_HAS_TRANSFER))
            transfer = F.lower(F.regexp_extract(head, _TRANSFER, 1))

            def decoded(body: Column) -> Column:
                ascii_only = F.lit(True) if from_bytes else body.rlike(r"\A[\x00-\x7f]*+\z")
                return (
                    F.when((transfers == 0) | transfer.isin("7bit", "8bit", "binary"), _plain_text(body, from_bytes))
                    .when((transfer == "base64") & ascii_only, _base64_text(body))
                    .when((transfer == "quoted-printable") & ascii_only, quoted_printable_text(body))
                )

            def by_type(kind: Column) -> Column:
                return let(
                    F.when(kind.isNull() | kind.startswith("message/") | (kind == "multipart/digest"), "bad")
                    .when(kind.startswith("multipart/"), "multi")
                    .when(kind == "text/plain", F.when(transfers <= 1, "plain").otherwise("bad"))
                    .otherwise("other"),
                    lambda name: _said(
                        name, F.when(name == "multi", _boundary(head)), F.when(name == "plain", let(body, decoded))
                    ),
                )

            return let(_content_type(head), by_type)

        def headed(cut: Column) -> Column:
            # The line end of an empty line may belong to the boundary line that comes next.
            ended = mime.opens_empty(rest) | (cut > 0) | (rest == "") | F.endswith(rest, F.lit("\n"))
            block = F.when(ended, mime.header_block(rest, cut))
            whole = let(block, lambda h: F.when(h.rlike(mime.HEADER_BLOCK) & ~F.contains(h, F.lit("\r")), h))
            return let(
                whole,
                lambda h: F.when(h.isNull(), _said(F.lit("bad"))).otherwise(with_body(h, mime.body_raw(rest, cut))),
            )

        return let(mime.cut_at(rest), headed)

    said = F.when(F.endswith(line, F.lit("--")), _said(F.lit("close"))).when(begins, let(_without_return(rest), opened)).otherwise(
        _said(F.lit("bad"))
    )
    return let(said, lambda s: F.struct(line.alias("line"), s["kind"].alias("kind"), s["inner"].alias("inner"), s["text"].alias("text")))


def _said(kind: Column, inner: Column | None = None, text: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        kind.cast("string").alias("kind"),
        (null if inner is None else inner).alias("inner"),
        (null if text is None else text).alias("text"),
    )


def _walk(parts: Column, outer: Column) -> Column:
    """Follow the parts with a stack of open boundaries: ``stack, fresh, ok, used``.

    ``fresh``: the innermost multipart has had no part yet. ``used`` counts the parts up to
    the one that closes the outermost; what comes then is no longer mail.
    """
    start = F.struct(
        F.array(outer).alias("stack"), F.lit(True).alias("fresh"), F.lit(True).alias("ok"), F.lit(0).alias("used")
    )

    def step(state: Column, part: Column) -> Column:
        stack = state["stack"]
        top = F.element_at(stack, -1)
        closes = part["line"] == F.concat(top, F.lit("--"))
        opens = part["line"] == top
        inner = part["inner"]
        usable = (
            (F.length(inner) > 0) & ~F.endswith(inner, F.lit("--")) & ~F.startswith(inner, F.lit("<"))
            & ~F.array_contains(stack, inner)
        )
        left = (part["kind"] == "plain") & part["text"].isNotNull() | (part["kind"] == "other")

        def state_of(stack, fresh, ok):
            return F.struct(
                stack.alias("stack"), fresh.alias("fresh"), ok.alias("ok"), (state["used"] + 1).alias("used")
            )

        yes, no = F.lit(True), F.lit(False)
        return (
            F.when(~state["ok"] | (F.size(stack) == 0), state)
            .when(closes, state_of(F.slice(stack, F.lit(1), F.size(stack) - 1), no, ~state["fresh"]))
            .when(opens & (part["kind"] == "multi") & usable, state_of(F.array_append(stack, inner), yes, yes))
            .when(opens & left, state_of(stack, no, yes))
            .otherwise(state_of(stack, no, no))
        )

    return F.aggregate(parts, start, step)


def multipart_text(header: Column, body: Column, from_bytes: bool) -> Column:
    """Texts of all ``text/plain`` parts of a multipart mail, one after another.

    Boundary lines cut the body into segments; a fold over these keeps a stack of open
    boundaries, so parts may be nested to any depth. Null for mail that is not multipart,
    and for any that is not put together as it should be: that is for the standard parser.
    """
    multi = F.coalesce(_content_type(header).startswith("multipart/"), F.lit(False)) & ~header.rlike(
        r"(?imd)^Content-Type:[ \t]*+(?:\n[ \t]++)*+multipart/digest"
    )
    outer = _boundary(header)
    lone_return = F.contains(F.replace(body, F.lit("\r\n"), F.lit("")), F.lit("\r"))
    sound = (
        (F.length(outer) > 0) & ~F.endswith(outer, F.lit("--")) & ~F.startswith(outer, F.lit("<"))
        & ~F.contains(body, F.lit(_MARK)) & ~lone_return
    )

    def told(outer: Column) -> Column:
        named = F.transform(F.regexp_extract_all(body, F.lit(_NAMED), F.lit(1)), _unquoted)
        inner = F.when(F.contains(body, F.lit(_NAMING)), named).otherwise(F.array().cast("array<string>"))
        names = F.filter(F.array_distinct(F.array_append(inner, outer)), lambda n: n != "")

        def marked(text: Column, name: Column) -> Column:
            line = F.concat(F.lit("\n--"), name)
            return F.replace(text, line, F.concat(F.lit(_MARK), line))

        def segments_at(names: Column) -> Column:
            # A line in front, so that there is always something before the first boundary
            # line. Names that begin alike mark a line twice.
            lines = F.aggregate(F.slice(names, 1, MOST_NAMES), F.concat(F.lit("-\n"), body), marked)
            return F.filter(F.split(lines, _MARK), lambda s: s != "")

        def of(parts: Column) -> Column:
            def text(state: Column) -> Column:
                plain = F.filter(F.slice(parts, F.lit(1), state["used"]), lambda p: p["kind"] == "plain")
                whole = state["ok"] & (F.size(state["stack"]) == 0)
                return F.when(whole, F.array_join(F.transform(plain, lambda p: p["text"]), ""))

            return let(_walk(parts, outer), text)

        def cut(segments: Column) -> Column:
            # Nothing but the preamble stands before the first boundary line.
            inside = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
            few = F.size(segments) <= MOST_BOUNDARIES
            return F.when(few, let(F.transform(inside, lambda s: _part(s, from_bytes)), of))

        def split_at(names: Column) -> Column:
            return F.when(F.size(names) <= MOST_NAMES, let(segments_at(names), cut))

        return let(names, split_at)

    return F.when(multi, let(outer, lambda o: F.when(sound, told(o))))
