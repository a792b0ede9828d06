"""Column functions for distances, latencies and addresses; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
#: Kilometres that light in fibre can go away and back within a millisecond.
KM_PER_MS = 100.0
#: Uncertainty of a target without any measurement: half the circumference.
MAX_REGION_KM = 20037.0
CENTRE_PULL = 0.001
EXPECTED_INFLATION = 1.5
#: Utility of the first measurement of a target.
UNMEASURED_UTILITY = 1_000_000.0


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def max_radius_km(rtt: Column) -> Column:
    return rtt * F.lit(KM_PER_MS)


def min_possible_rtt(distance_km: Column) -> Column:
    return distance_km / F.lit(KM_PER_MS)


def expected_rtt(distance_km: Column) -> Column:
    """Model of the RTT over a distance: the bound times an inflation."""
    return distance_km * F.lit(EXPECTED_INFLATION) / F.lit(KM_PER_MS)


def slash24(address: Column) -> Column:
    """The /24 of a dotted IPv4 address, as text: its first three parts and .0."""
    return F.concat(F.substring_index(address, ".", 3), F.lit(".0"))


def is_ipv6(address: Column) -> Column:
    return F.contains(address, F.lit(":"))


def penalty(distance_km: Column, radius_km: Column) -> Column:
    """One constraint's part of the objective: squared excess outside, a gentle pull inside."""
    over = distance_km - radius_km
    return F.when(over > 0, over * over).otherwise(distance_km * F.lit(CENTRE_PULL))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))
