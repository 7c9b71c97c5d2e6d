"""Text expressions: accent folding, title case, slugs, masks and cell clean-up."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from examlake.fixed_values import ACCENTED, UNACCENTED

WHITESPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def fold(c: Column) -> Column:
    """Upper-case and drop accents, for accent-insensitive comparison."""
    return F.translate(F.upper(c), ACCENTED, UNACCENTED)


def fold_text(value: str | None) -> str:
    """The same for a query parameter; parameters are also trimmed."""
    if not value:
        return ""
    return value.translate(str.maketrans(ACCENTED, UNACCENTED)).upper().strip()


def title_case(c: Column) -> Column:
    """Capital after every non-letter ("d'oeste" -> "D'Oeste"); ``initcap`` only looks at spaces."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def slug(c: Column) -> Column:
    plain = F.translate(c, ACCENTED + "Ññ", UNACCENTED + "Nn")
    return F.regexp_replace(plain, r"[^a-zA-Z0-9]+", "_")


def slug_text(value: str) -> str:
    plain = value.translate(str.maketrans(ACCENTED + "Ññ", UNACCENTED + "Nn"))
    out = []
    for ch in plain:
        if ch.isascii() and ch.isalnum():
            out.append(ch)
        elif not out or out[-1] != "_":
            out.append("_")
    return "".join(out)


def mask(c: Column, method: str = "partial") -> Column:
    """Hide a value: ``partial`` keeps two characters at each end, ``hash`` a short digest.

    Missing-looking text becomes empty and values up to four characters are hidden whole.
    """
    text = c.cast("string")
    size = F.length(text)
    if method == "partial":
        hidden = F.concat(
            F.substring(text, 1, 2), F.repeat(F.lit("*"), size - 4), F.right(text, F.lit(2))
        )
    elif method == "hash":
        hidden = F.substring(F.sha2(text, 256), 1, 16)
    else:
        hidden = F.repeat(F.lit("*"), size)
    missing = text.isNull() | F.lower(text).isin("", "nan", "none")
    return F.when(missing, F.lit("")).when(size <= 4, F.repeat(F.lit("*"), size)).otherwise(hidden)


def clean_cell(c: Column) -> Column:
    """Collapse control whitespace, blank cells made only of ``] + | " [``, trim."""
    flat = F.regexp_replace(c, r"[\n\r\t]+", " ")
    return strip(F.regexp_replace(flat, r'^[\]+|"\[]+$', ""))


def one_decimal(c: Column) -> Column:
    """Text with one decimal; null stays null."""
    return F.when(c.isNotNull(), F.format_string("%.1f", c))
