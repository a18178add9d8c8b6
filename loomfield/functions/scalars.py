"""Column functions: safe ratios, clocks, rounding, odds, distances, names."""

from __future__ import annotations

import difflib
import math
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def clock_seconds(x) -> Column:
    """``mm:ss`` or ``h:mm:ss`` in seconds; anything else is null."""
    part = F.split(x, ":")
    n = lambda k: F.try_element_at(part, F.lit(k)).try_cast("int")
    return F.when(F.size(part) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(F.size(part) == 2, n(1) * 60 + n(2))


def half_point(x) -> Column:
    """To the nearest half, ties to even."""
    return F.bround(x * 2, 0) / 2


def band(x, width: int) -> Column:
    return (F.floor(x / width) * width).cast("int")


def american_odds(p) -> Column:
    return F.when(p <= 0.5, F.try_divide(F.lit(100.0), p) - 100).otherwise(-F.try_divide(100 * p, 1 - p))


def logistic(d, scale: float) -> Column:
    return 1 / (1 + F.exp(-d / scale))


def haversine_miles(lat1, lon1, lat2, lon2, radius: float = 3958.8) -> Column:
    rad = lambda x: x * math.pi / 180
    a = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def tiered_yards(x) -> Column:
    """Losses weigh 1.2, the first four 1, the next six a half; at most seven."""
    return F.when(x < 0, 1.2 * x).when(x <= 4, x).when(x <= 10, 4 + 0.5 * (x - 4)).otherwise(7.0)


def season_of(day, first_month: int = 8) -> Column:
    return F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)


def name_letters(x) -> Column:
    """Lower-case letters a to z alone; accents of Latin letters go."""
    return F.regexp_replace(F.translate(F.lower(x), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), "[^a-z]", "")


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def letters_only(name: Column) -> Column:
    """A name in lower case without accents, only a to z: decomposed to base letters and marks, the marks dropped."""

    def run(names: pd.Series) -> pd.Series:
        plain = pc.utf8_normalize(pa.array(names.to_list(), pa.string()), form="NFKD")
        return pd.Series(pc.replace_substring_regex(pc.utf8_lower(plain), "[^a-z]+", "").to_pylist(), dtype=object)

    return F.pandas_udf(run, "string")(name)


def closest_by_ratio(known: list[str], cutoff: float = 0.6):
    """A function of a column: the known word closest by matching blocks, null under ``cutoff``. For a handful of known words and
    distinct inputs."""

    def run(words: pd.Series) -> pd.Series:
        found = {w: (difflib.get_close_matches(w, known, 1, cutoff) or [None])[0] for w in set(words.dropna())}
        return pd.Series([found.get(w) for w in words.to_list()], dtype=object)

    return F.pandas_udf(run, "string")
