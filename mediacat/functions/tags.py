"""Camera tags to catalogue columns.

Works on a tag table with one row per file. The first source uses the names
``gps_lat``/``gps_lon`` (degrees, minutes, seconds), ``gps_lat_ref``/``gps_lon_ref``,
``dt_original``, ``dt_create``, ``dt_modify``, ``make``, ``model``, ``f_number``,
``exposure``, ``iso``, ``focal_length``, ``exif_width``, ``image_width``,
``decoder_width`` and the same for heights. A second source, used where the first one
has nothing, is ``alt_dt_original``, ``alt_dt_create``, ``alt_dt_modify``, ``alt_lat``
and ``alt_lon`` (decimal degrees). Absent columns count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c "


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _set(x: Column) -> Column:
    """Zero and empty text mean 'not recorded'."""
    return F.when(x != 0, x)


def decimal_degrees(parts: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and a hemisphere letter to signed degrees."""
    d, m, s = (F.try_element_at(parts, F.lit(i)).cast("double") for i in (1, 2, 3))
    value = d + m / 60 + s / 3600
    ok = (F.size(parts) >= 3) & _finite(d) & _finite(m) & _finite(s)
    sign = F.when(ref.isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(ok, value * sign)


def plain_number(x: Column) -> Column:
    """Decimal text without a trailing '.0'."""
    x = x.cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def shutter_speed(seconds: Column) -> Column:
    """'2s' from one second up, else '1/250s'."""
    t = _set(seconds.cast("double"))
    return F.when(t >= 1, F.concat(plain_number(t), F.lit("s"))).when(
        t.isNotNull(), F.concat(F.lit("1/"), F.round(1 / t).cast("bigint").cast("string"), F.lit("s"))
    )


def camera_name(make: Column, model: Column) -> Column:
    both = F.concat(F.coalesce(make, F.lit("")), F.lit(" "), F.coalesce(model, F.lit("")))
    name = F.btrim(both, F.lit(WHITESPACE))
    return F.when(name != "", name)


def normalize_tags(tags: DataFrame, key: str = "id") -> DataFrame:
    """One row of catalogue columns per row of the tag table."""
    have = set(tags.columns)

    def tag(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    def first(names, kind):
        return F.coalesce(*[tag(n, kind) for n in names])

    def extent(axis):
        return F.coalesce(*[_set(tag(f"{src}_{axis}", "int")) for src in ("exif", "image")], tag(f"decoder_{axis}", "int"))

    lat = decimal_degrees(tag("gps_lat", "array<double>"), tag("gps_lat_ref", "string"))
    lon = decimal_degrees(tag("gps_lon", "array<double>"), tag("gps_lon_ref", "string"))
    alt_lat, alt_lon = tag("alt_lat", "double"), tag("alt_lon", "double")
    use_alt = lat.isNull() & lon.isNull() & alt_lat.isNotNull() & alt_lon.isNotNull()
    aperture, focal = _set(tag("f_number", "double")), _set(tag("focal_length", "double"))
    dates = [p + n for p in ("", "alt_") for n in ("dt_original", "dt_create", "dt_modify")]
    return tags.select(
        key,
        first(dates, "timestamp_ntz").alias("taken_at"),
        F.when(use_alt, alt_lat).otherwise(lat).alias("latitude"),
        F.when(use_alt, alt_lon).otherwise(lon).alias("longitude"),
        extent("width").alias("width"),
        extent("height").alias("height"),
        camera_name(tag("make", "string"), tag("model", "string")).alias("camera"),
        F.concat(F.lit("f/"), plain_number(aperture)).alias("aperture"),
        shutter_speed(tag("exposure", "double")).alias("shutter_speed"),
        _set(tag("iso", "int")).alias("iso"),
        F.concat(plain_number(focal), F.lit("mm")).alias("focal_length"),
    )
