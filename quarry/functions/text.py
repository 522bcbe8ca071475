"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.params import DELIMITER_PATTERN, TOKEN_PATTERN

# Section titles rewritten by fmt_sections.
SECTION_TITLES = ("Question:", "Answer:", "Context:")


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens of the whole text (ARRAY<STRING>)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def delimiter_tokens(text: Column, lower: bool = True) -> Column:
    """Tokens of the whole text (ARRAY<STRING>) as the delimiter classes cut it: white space separates; every punctuation
    mark, ASCII symbol and CJK ideograph, those outside the basic plane included, is a token of its own; what lies between
    is a token. NULL stays NULL, a text without tokens gives an empty array."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(DELIMITER_PATTERN), 0)


#: Ways to cut a text into tokens, by the name the jobs and the vocabulary build take.
TOKENIZERS = {"whitespace": tokens, "delimiter": delimiter_tokens}


def fmt_duration(seconds: Column) -> Column:
    """Seconds -> ``HH:MM:SS.mmm``; milliseconds truncated, hours may exceed two digits."""
    s = seconds.cast("double")
    hours = F.floor(s / 3600)
    rem = s - hours * 3600
    minutes = F.floor(rem / 60)
    rem = rem - minutes * 60
    secs = F.floor(rem)
    millis = F.floor((rem - secs) * 1000)
    return F.format_string("%02d:%02d:%02d.%03d", hours.cast("long"), minutes.cast("long"),
                           secs.cast("long"), millis.cast("long"))


def fmt_sections(text: Column, titles=SECTION_TITLES) -> Column:
    """Put each section title on its own paragraph: newlines directly after a title
    are dropped, then the title is preceded by a blank line and followed by one newline."""
    out = text
    for t in titles:
        lit = t.replace("\\", "\\\\")
        out = F.regexp_replace(out, F.lit(_re_escape(t) + "\n+"), F.lit(lit))
        out = F.replace(out, F.lit(t), F.lit("\n\n" + t + "\n"))
    return out


def _re_escape(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)


def strip_ws(text: Column) -> Column:
    """Remove leading and trailing whitespace (space, tab, newline, CR, FF, VT)."""
    return F.regexp_replace(text, F.lit(r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"), F.lit(""))
