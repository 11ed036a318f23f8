"""Distance, border and route expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371

# Countries counted as inside the customs union.
EU_COUNTRIES = "AT BE BG CZ DE DK ES FI FR GR HU IE IT NL PL PT RO SE SK".split()

# Speed in km/h and cost per km of each transport mode; ships need at least 200 km.
MODES = {"ROAD": (60, 0.50), "SEA": (25, 0.15), "AIR": (800, 3.00)}
SEA_FROM_KM = 200
AIR_ROUTE_FROM_KM = 1000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def customs_days(origin: Column, target: Column) -> Column:
    """One day when the trip crosses the border between GB and the customs union."""
    crosses = ((origin == "GB") & target.isin(EU_COUNTRIES)) | (origin.isin(EU_COUNTRIES) & (target == "GB"))
    return F.when(crosses, 1).otherwise(0)


def route_code(origin: Column, target: Column) -> Column:
    return F.concat(F.lit("R"), F.substring(origin, 1, 2), F.substring(target, 1, 2))
