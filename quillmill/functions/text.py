"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line end that text files know; a final line end starts no new line.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
MAX_TITLE = 120


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


def lines(c: Column) -> Column:
    """Lines of a text; the empty text has none."""
    parts = F.split(c, LINE_END, -1)
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(c: Column) -> Column:
    """Outer white space of any script removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def first_line(c: Column, most: int = MAX_TITLE) -> Column:
    """The first visible line, stripped and cut; '' if there is none."""
    seen = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return F.coalesce(F.left(F.try_element_at(seen, F.lit(1)), F.lit(most)), F.lit(""))


def short(c: Column, most: int) -> Column:
    """Collapsed text, cut with an ellipsis."""
    s = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.left(s, F.lit(most)), r"(?U)\s+$", ""), F.lit("…")))


def stem(path: Column) -> Column:
    """File name without folders and last suffix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def link_targets(c: Column) -> Column:
    """Destinations of Markdown links, percent-decoded; what cannot be decoded stays."""
    raw = F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\(([^)]*)\)"), F.lit(1))
    return F.transform(raw, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t))


def encode_target(c: Column) -> Column:
    """Percent-encode what breaks a Markdown link target."""
    for char, code in (("%", "%25"), (" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"), ("#", "%23"), ("?", "%3F"), ("`", "%60"), ('"', "%22"), ("[", "%5B"), ("]", "%5D")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def escape_display(c: Column) -> Column:
    for char in ("\\", "[", "]"):
        c = F.replace(c, F.lit(char), F.lit("\\" + char))
    return c
