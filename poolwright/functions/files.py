"""Upload rules as column expressions: kind by leading bytes, names, media types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from poolwright.functions.text import _col, cut_bytes, trim_space

HEAD_BYTES = 512

# Leading bytes (as Latin-1 patterns) and the type they imply.
SIGNATURES = [
    ("image/png", "^\\x89PNG\\r\\n\\x1A\\n"),
    ("image/jpeg", "^\\xFF\\xD8\\xFF"),
    ("image/gif", "^GIF8[79]a"),
    ("image/webp", "(?s)^RIFF....WEBPVP"),
    ("application/pdf", "^%PDF-"),
    ("application/zip", "^PK\\x03\\x04"),
    ("application/x-gzip", "^\\x1F\\x8B\\x08"),
    ("application/x-rar-compressed", "^Rar!\\x1A\\x07"),
    ("application/ogg", "^OggS\\x00"),
    ("application/postscript", "^%!PS-Adobe-"),
    ("image/bmp", "^BM"),
]
ACCEPTED = ("image/png", "image/jpeg", "image/gif", "image/webp", "application/pdf")
# Markup openings that make a file text, and bytes that make it binary.
MARKUP = (
    "(?i)^[\\t\\n\\x0C\\r ]*<(!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE"
    "|TITLE|B|BODY|BR|P|!--)[ >]|^[\\t\\n\\x0C\\r ]*<\\?xml"
)
MARKS = "^(\\xEF\\xBB\\xBF|\\xFE\\xFF|\\xFF\\xFE)"
BINARY = "[\\x00-\\x08\\x0B\\x0E-\\x1A\\x1C-\\x1F]"
# File endings of media types.
ENDINGS = {
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "application/pdf": ".pdf",
}


def _latin(data: Column) -> Column:
    """The leading bytes, one character each, so that patterns see bytes."""
    return F.decode(F.substring(data, 1, HEAD_BYTES), "ISO-8859-1")


def sniffed_type(data: Column | str) -> Column:
    """The media type the leading bytes imply."""
    head = _latin(_col(data))
    out = F.when(head.rlike(MARKUP), "text/html")
    for mime, pattern in SIGNATURES:
        out = out.when(head.rlike(pattern), mime)
    out = out.when(head.rlike(MARKS), "text/plain")
    return out.when(head.rlike(BINARY), "application/octet-stream").otherwise("text/plain")


def looks_like_text(data: Column | str) -> Column:
    """Valid UTF-8 without a NUL byte, judged on the leading bytes."""
    head = F.substring(_col(data), 1, HEAD_BYTES)
    return (
        (F.octet_length(head) > 0)
        & F.is_valid_utf8(head.cast("string"))
        & ~F.contains(_latin(_col(data)), F.lit("\x00"))
    )


def text_type(name: Column | str) -> Column:
    """The media type of a text file, by its ending."""
    ending = F.lower(F.regexp_extract(_col(name), "(\\.[^./]*)$", 1))
    return (
        F.when(ending.isin(".md", ".markdown"), "text/markdown")
        .when(ending == ".csv", "text/csv")
        .otherwise("text/plain; charset=utf-8")
    )


def upload_kind(name: Column | str, data: Column | str) -> Column:
    """``struct(mime, reason)``: an accepted type, or why the file is refused."""
    sniff = sniffed_type(data)
    mime = F.when(sniff.isin(*ACCEPTED), sniff).when(
        sniff.startswith("text/") | looks_like_text(data), text_type(name)
    )
    # The pieces of the sentence.
    reason = F.concat(
        F.lit("files of type "),
        sniff,
        F.lit(" can't be read as room knowledge — upload an image, PDF, or text document"),
    )
    return F.struct(
        F.coalesce(mime, F.lit("")).alias("mime"),
        F.when(mime.isNull(), reason).otherwise("").alias("reason"),
    )


def clean_name(name: Column | str, most: int = 120) -> Column:
    """A bare, bounded file name: no folders, no control characters."""
    base = F.regexp_extract(
        F.regexp_replace(trim_space(name), "/+$", ""), "([^/]*)$", 1
    )
    base = F.when((base == "") | (base == "."), "file").otherwise(base)
    return cut_bytes(F.regexp_replace(base, "[\\x00-\\x1F\\x7F]", ""), most)


def ending_for(mime: Column | str) -> Column:
    """The file ending of a media type, or the empty string."""
    mime = _col(mime)
    out = F.lit("")
    for m, e in ENDINGS.items():
        out = F.when(mime == m, e).otherwise(out)
    return out


def with_ending(name: Column | str, mime: Column | str) -> Column:
    """``name`` with the ending of its media type, added only when missing."""
    name, ending = _col(name), ending_for(mime)
    return F.when(F.lower(name).endswith(ending), name).otherwise(F.concat(name, ending))
