"""What a record says about when, where and with what it was made. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowlane.functions.text import number_text, round_half_up

# Inclusive upper bounds of the focal bands, in millimetres of the 35 mm format, and what is shown.
FOCAL_BANDS = ((23.5, "Ultra-wide (under 24mm)"), (35.5, "Wide (24-35mm)"), (70.5, "Normal (36-70mm)"), (135.5, "Short tele (71-135mm)"))
FOCAL_LAST = "Tele (over 135mm)"
#: A side longer than so many times the other makes a record upright or lying.
SQUARE = 1.02
EARTH_KM = 6371.0088
FIRST_YEAR, LAST_YEAR = 1970, 2200
# What is shown where a record lacks a category's value.
MISSING = {"year": "No date", "month": "No date", "day": "No date", "event": "No date", "location": "No location", "camera": "Unknown camera", "lens": "Unknown lens", "focal": "Unknown focal length", "orientation": "Unknown shape", "format": "Other format"}
MISSING_ELSE = "Unknown"
#: The same as a pattern of a path segment.
MISSING_SEGMENT = r"(^|/)(No date|No location|Unknown [^/]*|Other format)(/|$)"


def iso_time(raw: Column) -> Column:
    """YYYY:MM:DD hh:mm:ss of metadata as ISO text without zone; null if a part is out of range.

    Years before FIRST_YEAR are those of clocks never set. Day 31 is let through for any month, and second
    60; try_when() gives null for those.
    """
    at = r"^([0-9]{4})[:\-]([0-9]{2})[:\-]([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})"
    y, mo, d, h, mi, s = (F.regexp_extract(raw, at, i) for i in range(1, 7))
    number = lambda x: F.nullif(x, F.lit("")).cast("int")
    ok = raw.rlike(at) & number(y).between(FIRST_YEAR, LAST_YEAR) & number(mo).between(1, 12) & number(d).between(1, 31) & (number(h) <= 23) & (number(mi) <= 59) & (number(s) <= 60)
    return F.when(ok, F.concat(y, F.lit("-"), mo, F.lit("-"), d, F.lit("T"), h, F.lit(":"), mi, F.lit(":"), s))


def try_when(iso: Column) -> Column:
    """Naive time of ISO text; null where there is no such day or second."""
    return F.try_to_timestamp(F.regexp_replace(iso, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def year_of(iso: Column) -> Column:
    return F.left(iso, F.lit(4))


def month_of(iso: Column) -> Column:
    return F.left(iso, F.lit(7))


def day_of(iso: Column) -> Column:
    return F.left(iso, F.lit(10))


def camera_label(make: Column, model: Column) -> Column:
    """Make and model, without saying the make twice; null if neither is there."""
    mk, mo = F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))
    stutter = F.startswith(F.lower(mo), F.lower(F.get(F.split(mk, r"\s+"), F.lit(0))))
    return F.when(mk.isNull(), mo).when(mo.isNull(), mk).when(stutter, mo).otherwise(F.concat_ws(" ", mk, mo))


def focal_band(fl35: Column, fl: Column) -> Column:
    """Band of the 35 mm equivalent, of the real focal length where that is not written; null if not positive."""
    x = F.when(F.coalesce(fl35, F.lit(0.0)) != 0, fl35).otherwise(fl)
    out = F.when(~F.coalesce(x > 0, F.lit(False)), F.lit(None).cast("string"))
    for top, name in FOCAL_BANDS:
        out = out.when(x <= top, F.lit(name))
    return out.otherwise(F.lit(FOCAL_LAST))


def _sides(w: Column, h: Column, quarter_turns: Column | None) -> tuple[Column, Column]:
    turned = F.coalesce(F.pmod(quarter_turns, F.lit(2)) == 1, F.lit(False)) if quarter_turns is not None else F.lit(False)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def orientation(w: Column, h: Column, quarter_turns: Column | None = None) -> Column:
    """Landscape, Portrait or Square as shown; a quarter turn swaps the sides. Null without a size.

    A side must be longer than SQUARE times the other, which is the shorter then.
    """
    a, b = _sides(w, h, quarter_turns)
    return F.when((a > 0) & (b > 0), F.when(a > b * SQUARE, F.lit("Landscape")).when(b > a * SQUARE, F.lit("Portrait")).otherwise(F.lit("Square")))


def strict_orientation(w: Column, h: Column) -> Column:
    """landscape, portrait or square by plain comparison, as rates count them; null without a size."""
    return F.when((w > 0) & (h > 0), F.when(w > h, F.lit("landscape")).when(h > w, F.lit("portrait")).otherwise(F.lit("square")))


def format_label(kind: Column) -> Column:
    """A format's name in capitals; null where it is not supported."""
    return F.when(~kind.isin("unknown", "unsupported", ""), F.upper(kind))


def compose_turns(r1: Column, f1: Column, r2: Column, f2: Column) -> Column:
    """Orientation (quarter turns, mirrored) first and then another, as one struct r, f."""
    r = F.pmod(F.when(f2, r2 - r1).otherwise(r2 + r1), F.lit(4)).cast("int")
    return F.struct(r.alias("r"), (f1 != f2).alias("f"))


def written_place(city: Column, sublocation: Column, state: Column, country: Column) -> Column:
    """The nearest named place and its country; empty text counts as missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    near, land = F.coalesce(some(city), some(sublocation), some(state)), some(country)
    return F.when(near.isNull(), land).when(land.isNull() | (near == land), near).otherwise(F.concat_ws(", ", near, land))


def has_position(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def position_label(lat: Column, lon: Column) -> Column:
    """Near 35.01N 135.77E."""
    side = lambda x, up, down: F.when(x >= 0, F.lit(up)).otherwise(F.lit(down))
    lat, lon = lat.cast("double"), lon.cast("double")
    return F.when(has_position(lat, lon), F.concat(F.lit("Near "), F.format_string("%.2f", F.abs(lat)), side(lat, "N", "S"), F.lit(" "), F.format_string("%.2f", F.abs(lon)), side(lon, "E", "W")))


def place_key(lat: Column, lon: Column) -> Column:
    """The key that a given name hangs on: a centre to about 100 m."""
    return F.when(has_position(lat, lon), F.format_string("loc:%.3f,%.3f", lat.cast("double"), lon.cast("double")))


def parse_place_key(key: Column) -> Column:
    """Struct lat, lon of a place key; null if it is none."""
    at = r"^loc:(-?[0-9.]+),(-?[0-9.]+)$"
    part = lambda i: F.nullif(F.regexp_extract(key, at, i), F.lit("")).try_cast("double")
    return F.when(key.rlike(at), F.struct(part(1).alias("lat"), part(2).alias("lon")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def exposure_text(fl35: Column, fl: Column, f: Column, seconds: Column, iso: Column) -> Column:
    """Focal length (the 35 mm equivalent first), aperture, shutter and sensitivity, those that are there.

    From 0.3 s on the shutter is said in seconds, below as one part of so many.
    """
    there = lambda x: F.coalesce(x, F.lit(0.0)) != 0
    tenths = lambda x: number_text(round_half_up(x * 10) / 10.0)
    length = F.when(there(fl35), F.concat(number_text(round_half_up(fl35)), F.lit("mm equiv."))).when(there(fl), F.concat(tenths(fl), F.lit("mm")))
    shutter = F.when(seconds >= 0.3, F.concat(tenths(seconds), F.lit("s"))).when(there(seconds), F.concat(F.lit("1/"), number_text(round_half_up(1 / seconds)), F.lit("s")))
    return F.concat_ws("  ", length, F.when(there(f), F.concat(F.lit("f/"), number_text(f))), shutter, F.when(there(iso), F.concat(F.lit("ISO "), number_text(iso))))


def missing_label(category: str) -> str:
    return MISSING.get(category, MISSING_ELSE)


def info_rows(rows: DataFrame, key: str = "id") -> DataFrame:
    """key, ord, label and value of what is known of each record, absent fields left out.

    ``rows`` may hold: read (whether metadata were read), taken (ISO), taken_from, tz, make, model, lens, fl35, fl, f,
    exposure, iso, city, sublocation, state, country, lat, lon. A record not read, and one without any, has one line that says so.
    """
    have = set(rows.columns)
    c = lambda n, t="string": F.col(n).cast(t) if n in have else F.lit(None).cast(t)
    some = lambda x: F.nullif(x, F.lit(""))
    taken = F.when(c("taken").isNotNull(), F.concat(F.regexp_replace(c("taken"), "T", " "), F.coalesce(F.concat(F.lit(" "), some(c("tz"))), F.lit("")), F.when(c("taken_from") == "modified", F.lit(" (edit time)")).otherwise(F.lit(""))))
    lat, lon = c("lat", "double"), c("lon", "double")
    lines = [
        ("Taken", taken), ("Camera", camera_label(c("make"), c("model"))), ("Lens", some(c("lens"))),
        ("Settings", some(exposure_text(*(c(n, "double") for n in ("fl35", "fl", "f", "exposure", "iso"))))), ("Place", written_place(*(c(n) for n in ("city", "sublocation", "state", "country")))),
        ("GPS", F.when(has_position(lat, lon), F.format_string("%.5f, %.5f", lat, lon))),
    ]
    every = F.filter(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(lines)]), lambda x: x["value"].isNotNull())
    one = lambda text: F.array(F.struct(F.lit(0).alias("ord"), F.lit("Metadata").alias("label"), F.lit(text).alias("value")))
    was_read = F.coalesce(c("read", "boolean"), F.lit("read" not in have))
    shown = F.when(~was_read, one("not read")).when(F.size(every) == 0, one("none in this file")).otherwise(every)
    return rows.select(key, F.explode(shown).alias("r")).select(key, "r.*")
