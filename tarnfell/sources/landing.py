"""Driver-side helpers around the landing directory: fetch, tidy, and results keyed by configuration."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

TRIES, BACKOFF_S, TIMEOUT_S = 3, 5.0, 120.0


def _open(url: str):
    return urllib.request.urlopen(url, timeout=TIMEOUT_S)


def fetch(url: str, to: str, parsed: str | None = None, opener: Callable = _open, sleep: Callable = time.sleep) -> bool:
    """Fetches url to a local path unless it, or what was parsed from it, is there; True if it is there now.

    The file appears whole or not at all.  A 404 ends the attempts, other HTTP errors are tried
    again at once, anything else after a pause that grows with each attempt.
    """
    if parsed and os.path.exists(parsed) or os.path.exists(to) and os.path.getsize(to):
        return True
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    for attempt in range(TRIES):
        handle, part = tempfile.mkstemp(dir=os.path.dirname(to) or ".")
        try:
            with os.fdopen(handle, "wb") as out, opener(url) as source:
                while chunk := source.read(1 << 20):
                    out.write(chunk)
            os.replace(part, to)
            return True
        except urllib.error.HTTPError as why:
            if why.code == 404:
                return False
        except OSError:
            sleep(BACKOFF_S * (attempt + 1))
        finally:
            if os.path.exists(part):
                os.remove(part)
    return False


def tidy(raw: str, parsed: str) -> bool:
    """Deletes a raw file once what was parsed from it exists."""
    if os.path.exists(parsed) and os.path.exists(raw):
        os.remove(raw)
        return True
    return False


def config_key(**config: Any) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint(*frames: DataFrame) -> list[list]:
    """Rows, and the sum of their hashes, of each frame: what a result depends on, in one pass each."""
    out = []
    for df in frames:
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
        out.append([sorted(df.dtypes), *map(str, df.agg(F.count("*"), F.sum(hashed)).first())])
    return out


def cached(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame], data: tuple[DataFrame, ...] = (), **config: Any) -> DataFrame:
    """make()'s rows as Parquet under a key of the whole configuration and of the data; read back if they are there."""
    path = f"{root}/{name}-{config_key(data=fingerprint(*data), **config)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
