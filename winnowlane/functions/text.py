"""Text made safe for paths, names and spreadsheets. Native expressions; null stays null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that some file systems keep for devices, and units of size.
DEVICE = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
_SPACES = r"(?U)\s+"


def path_segment(s: Column) -> Column:
    """One safe path segment: separators and controls become hyphens, at most 80 characters, never empty."""
    x = F.regexp_replace(F.coalesce(s.cast("string"), F.lit("")), r'[/\\:*?"<>|\x00-\x1F]', "-")
    x = F.trim(F.regexp_replace(x, _SPACES, " "))
    x = F.regexp_replace(x, r"^\.+", "")
    x = F.regexp_replace(F.left(x, F.lit(80)), r"[. ]+$", "")
    return F.when(x.rlike(DEVICE), F.concat(x, F.lit("_"))).when(x == "", F.lit("_")).otherwise(x)


def file_safe(s: Column) -> Column:
    """Runs of unsafe characters and white space become one underscore, no dot or space at the end, never empty."""
    x = F.regexp_replace(F.regexp_replace(s, r'(?U)[/\\:*?"<>|\x00-\x1F\s]+', "_"), r"[. ]+$", "")
    return F.when(x == "", F.lit("_")).otherwise(x)


def slug(s: Column) -> Column:
    """Lower case, runs outside a-z and 0-9 become underscores, none at the ends, at most 48 characters."""
    x = F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "_")
    return F.left(F.regexp_replace(x, r"^_+|_+$", ""), F.lit(48))


def output_name(name: Column, ordinal: Column | None = None, label: Column | None = None) -> Column:
    """[ordinal]_[slug]_name; parts that are null or empty are left out, and the original name stays as it is."""
    parts = [ordinal if ordinal is not None else F.lit(None).cast("string"), F.nullif(slug(label), F.lit("")) if label is not None else F.lit(None).cast("string"), name]
    return F.concat_ws("_", *parts)


def tag_name(s: Column) -> Column:
    """A tag's name: slashes and controls become spaces, single spaces, trimmed, at most 32 characters; null becomes empty."""
    x = F.regexp_replace(F.coalesce(s, F.lit("")), r"[\x00-\x1F/\\]", " ")
    return F.left(F.trim(F.regexp_replace(x, _SPACES, " ")), F.lit(32))


def clean_text(s: Column) -> Column:
    """Metadata text without controls and replacement marks, trimmed, at most 96 characters; null if nothing is left."""
    x = F.trim(F.regexp_replace(F.regexp_replace(s, "[\\x00-\\x1F\\x7F�]", ""), _SPACES, " "))
    return F.nullif(F.left(x, F.lit(96)), F.lit(""))


def formula_guard(s: Column) -> Column:
    """An apostrophe before text that a spreadsheet would read as a formula; null becomes empty."""
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(F.coalesce(s, F.lit("")))


def csv_field(s: Column) -> Column:
    """A guarded field, quoted where it holds a quote, comma or line break."""
    g = formula_guard(s)
    return F.when(g.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(g, '"', '""'), F.lit('"'))).otherwise(g)


def csv_number(x: Column) -> Column:
    """A number's text; empty where it is null or not finite."""
    d = x.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit("")).otherwise(x.cast("string"))


def number_text(x: Column) -> Column:
    """A number without a fraction that is zero: 50, 6.8."""
    d = x.cast("double")
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))


def natural_key(s: Column) -> Column:
    """A sort key under which img2 precedes img10: runs of digits, however long, are preceded by their length.

    Digits and all else are compared by code point in lower case; locale rules are not. Texts that differ
    in leading zeros or case only have equal keys.
    """
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def extension(name: Column) -> Column:
    """Lower-case letters and digits after the last dot; empty without any."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def ordinal(rank: Column, total: Column) -> Column:
    """Rank padded with zeros to the width of the total, two digits at least."""
    return F.lpad(rank.cast("string"), F.greatest(F.lit(2), F.length(total.cast("string"))), F.lit("0"))


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(x + 0.5)


def bytes_text(n: Column) -> Column:
    """Size in the largest unit of 1 or more, up to TB: one decimal below ten, none from there; 0 B of nothing or null."""
    out = F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("0 B")).when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for k in range(1, len(SIZE_UNITS)):
        x = n.cast("double") / 1024.0**k
        shown = F.concat(F.when(x < 10, F.format_string("%.1f", x)).otherwise(F.format_string("%.0f", x)), F.lit(f" {SIZE_UNITS[k]}"))
        out = out.when(x < 1024, shown) if k < len(SIZE_UNITS) - 1 else out.otherwise(shown)
    return out


def percent_text(part: Column, whole: Column) -> Column:
    """Whole per cent; 0% of nothing."""
    return F.concat(F.when(whole > 0, round_half_up(100.0 * part / whole)).otherwise(F.lit(0)).cast("long").cast("string"), F.lit("%"))


def duration_text(milliseconds: Column) -> Column:
    """Seconds below a minute, else minutes and seconds, however many."""
    s = round_half_up(milliseconds / 1000.0).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
