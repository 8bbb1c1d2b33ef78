"""Text rules as column expressions.

White space is Unicode white space throughout, and every limit counts UTF-8
bytes unless a function says code points.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Drop white space at both ends; NULL becomes the empty string.

    Looking at the first and last character first spares the many texts that need
    no trimming the much slower trim over a set of characters.
    """
    c = F.coalesce(_col(c), F.lit(""))
    spaces = [ord(s) for s in WHITE_SPACE]
    loose = F.ascii(c).isin(spaces) | F.ascii(F.right(c, F.lit(1))).isin(spaces)
    return F.when(loose, F.btrim(c, F.lit(WHITE_SPACE))).otherwise(c)


def is_blank(c: Column | str) -> Column:
    return trim_space(c) == ""


def byte_len(c: Column | str) -> Column:
    return F.octet_length(_col(c)).cast("long")


def cut_bytes(c: Column | str, n: int) -> Column:
    """At most ``n`` bytes of ``c``, never ending inside a character.

    The bytes after the cut tell how far back the last whole character ends: bytes that
    continue a character have their two leading bits 10, and there are three at most.
    """
    c = _col(c)
    # what is cut off starts inside a character as long as it starts with a continuing byte
    inside = lambda k: F.hex(F.substring(c.cast("binary"), n - k + 1, 1)).rlike("^[89AB]")
    back = F.lit(min(3, n))
    for k in range(min(3, n) - 1, -1, -1):
        back = F.when(~inside(k), F.lit(k)).otherwise(back)
    cut = F.substring(c.cast("binary"), F.lit(1), F.lit(n) - back).cast("string")
    return F.when(F.octet_length(c) <= n, c).otherwise(cut)


def clip(c: Column | str, n: int) -> Column:
    """Trim, then cut to ``n`` bytes.

    An array of one element holds the trimmed text, so that it is made once and generated
    code stays small however many columns are clipped.
    """
    return F.element_at(F.transform(F.array(trim_space(c)), lambda t: cut_bytes(t, n)), 1)


def strip_bom(c: Column | str) -> Column:
    """Without one leading byte-order mark."""
    c = _col(c)
    return F.when(c.startswith("\ufeff"), F.substr(c, F.lit(2))).otherwise(c)


def coherent(c: Column | str, least: int = 16, share: float = 0.85) -> Column:
    """Is this text fit to be kept as an exact read?

    At least ``least`` code points after trimming, of which ``share`` must be
    printable. What is not printable: the controls other than tab and newline,
    and the replacement character.
    """
    t = trim_space(c)
    bad = F.regexp_count(t, F.lit("[\\x00-\\x08\\x0B-\\x1F\\x{FFFD}]"))
    return (F.length(t) >= least) & ((F.length(t) - bad) / F.nullif(F.length(t), F.lit(0)) >= share)


def squeeze_blank_lines(c: Column | str) -> Column:
    """Right-trim every line and keep at most one empty line in a row."""
    lines = F.transform(
        F.split(F.coalesce(_col(c), F.lit("")), "\n"),
        lambda line: F.when(is_blank(line), F.lit("")).otherwise(F.rtrim(line, F.lit(" \t\r"))),
    )
    return trim_space(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def paragraphs(c: Column | str, delimiter: str = "\n\n") -> Column:
    """The trimmed, non-empty pieces between delimiters, in reading order."""
    pieces = F.split(F.coalesce(_col(c), F.lit("")), "\\Q" + delimiter + "\\E")
    return F.filter(F.transform(pieces, trim_space), lambda p: p != "")


def lower_case(c: Column | str) -> Column:
    """Each character in lower case by itself, as far as letters ``a-z`` come of it.

    Spark's own ``lower`` makes two of ``İ``, an i and a combining dot that ends the word.
    """
    return F.lower(F.replace(_col(c), F.lit("İ"), F.lit("i")))


def words(c: Column | str, least: int = 3) -> Column:
    """Distinct lower-case ASCII words of ``least`` characters or more."""
    parts = F.split(lower_case(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= least))


def query_terms(c: Column | str) -> Column:
    """The words of a question worth matching."""
    return words(c, 3)


def score(paragraph: Column, terms: Column) -> Column:
    """How many terms occur in the paragraph, as substrings. For small inputs."""
    lower = lower_case(paragraph)
    return F.size(F.filter(terms, lambda t: F.contains(lower, t)))


# Fixed value: what tells a page of a proxy from a plain message.
PROXY_PAGE = r"(?i)^<|<!doctype|<html|<head|<body|cloudflare|error code\s*\d"


def error_kind(c: Column | str) -> Column:
    """What an error body is: ``empty``, a ``proxy`` page, or a plain ``message``."""
    t = trim_space(c)
    markup = t.rlike(PROXY_PAGE)
    return F.when(t == "", "empty").when(markup, "proxy").otherwise("message")


def error_message(c: Column | str, empty: str, proxy: str) -> Column:
    """A text fit to be shown: the message itself, or a stand-in for the other kinds."""
    kind = error_kind(c)
    return F.when(kind == "empty", empty).when(kind == "proxy", proxy).otherwise(trim_space(c))


def display_path(title: Column | str) -> Column:
    """The name a context part is shown under."""
    return F.coalesce(F.nullif(trim_space(title), F.lit("")), F.lit("document"))


def image_path(title: Column | str, page: Column | str) -> Column:
    """The name of one image of a document, with its page when known."""
    page = _col(page)
    where = F.when(page > 0, F.concat(F.lit(" (image on page "), page.cast("string"), F.lit(")")))
    return F.concat(display_path(title), F.coalesce(where, F.lit(" (image)")), F.lit(".jpg"))
