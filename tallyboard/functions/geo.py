"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value.
EARTH_RADIUS_KM = 6371.0


def located(lat: Column, long: Column) -> Column:
    """Half the latitude and longitude and the latitude's cosine; null if one is missing.

    Worked out once per place, so that a distance needs no more than two sines.
    """
    place = F.struct(
        (F.radians(lat) / 2).alias("lat"), (F.radians(long) / 2).alias("long"), F.cos(F.radians(lat)).alias("cos")
    )
    return F.when(lat.isNotNull() & long.isNotNull(), place)


def half_angle(a: Column, b: Column) -> Column:
    """Half the angle between two located places, neither of them null."""
    chord = F.pow(F.sin(b["lat"] - a["lat"]), 2) + a["cos"] * b["cos"] * F.pow(
        F.sin(b["long"] - a["long"]), 2
    )
    return F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def haversine_km(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    """Kilometres between two points in degrees; null if a coordinate is missing."""
    a, b = located(lat1, long1), located(lat2, long2)
    return F.when(a.isNotNull() & b.isNotNull(), 2 * EARTH_RADIUS_KM * half_angle(a, b))
