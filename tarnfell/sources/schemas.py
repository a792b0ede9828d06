"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

SNAPSHOT_RECORD = _fields(
    ("id", _L), ("address_v4", _S), ("address_v6", _S), ("prefix_v4", _S), ("prefix_v6", _S), ("country_code", _S),
    ("latitude", _D), ("longitude", _D), ("asn_v4", _L), ("asn_v6", _L), ("status_name", _S),
)
#: The column that each field of a snapshot record becomes.
PROBE_NAMES = {"id": "prb_id", "country_code": "country", "status_name": "status"}
#: Variants tell a field that is missing (no value) from one that is null (a variant null) in one parse.
_V = T.VariantType()
PING = _fields(("prb_id", _L), ("src_addr", _V), ("dst_addr", _V), ("min", _V), ("_corrupt_record", _S))
PROBES_DAILY = _fields(("pos", _L), *((PROBE_NAMES.get(f.name, f.name), f.dataType) for f in SNAPSHOT_RECORD.fields), ("snapshot_date", T.DateType()))
HOURLY = _fields(("src", _S), ("dst", _S), ("rtts", T.ArrayType(_D)), ("dump_hour", T.TimestampType()))
LOCATIONS = _fields(("addr", _S), ("lat", _D), ("lon", _D))
EDGES = _fields(("src", _S), ("dst", _S), ("rtt", _D))
PICKS = _fields(("strategy", _S), ("seq", _L), ("src", _S), ("dst", _S), ("rtt", _D))
TRACE = _fields(("ping_num", _L), ("target", _S), ("src", _S), ("expected_util", _D), ("actual_util", _D), ("error", _D), ("predicted_rtt", _D), ("actual_rtt", _D))
