"""How much a copy is worth keeping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a file name that mark a derived copy.
DERIVED_NAME_WORDS = ("copy", "副本", "edited", "修改", "截图")


# Score of a location, of each doubling of size, of a million pixels and of
# a name without those words.
LOCATION_SCORE, DOUBLING_SCORE, MEGAPIXEL_SCORE, CLEAN_NAME_SCORE = 100.0, 10.0, 1.0, 10.0


def has_location() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def keep_score() -> Column:
    """100 for a location, ten per doubling of size, one per megapixel, 10 for a clean name."""
    size = F.greatest(F.lit(1), F.coalesce(F.col("file_size"), F.lit(0))).cast("double")
    pixels = F.coalesce(F.col("width"), F.lit(0)).cast("double") * F.coalesce(F.col("height"), F.lit(0))
    derived = F.lower(F.coalesce(F.col("filename"), F.lit(""))).rlike("|".join(DERIVED_NAME_WORDS))
    return (
        F.when(has_location(), LOCATION_SCORE).otherwise(0.0)
        + F.log2(size) * DOUBLING_SCORE
        + pixels / 1e6 * MEGAPIXEL_SCORE
        + F.when(derived, 0.0).otherwise(CLEAN_NAME_SCORE)
    )
