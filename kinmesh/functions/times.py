"""Mixed timestamp texts: told apart by shape, read to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmesh.functions.text import is_missing, trim

# Shapes and how they are read.  A year of two digits is 1969-2068.
SHAPES = {
    "epoch_ms": r"^\d{13}$",
    "iso": r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$",
    "local": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "day_first": r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}$",
    "slashes": r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$",
    "month_first": r"^\d{2}-\d{2}-\d{2} \d{2}:\d{2}$",
}


def format_of(x: Column) -> Column:
    """The label of the shape, other or missing."""
    t, out = trim(x), F.lit("other")
    for name, shape in reversed(SHAPES.items()):
        out = F.when(t.rlike(shape), name).otherwise(out)
    return F.when(is_missing(x), "missing").otherwise(out)


def parse(x: Column) -> Column:
    """UTC as a timestamp without zone; local text is five and a half hours ahead; null for any other shape or an impossible date."""
    t = trim(x)
    of = lambda name, value: F.when(t.rlike(SHAPES[name]), value)
    plain = lambda f, y=t: F.try_to_timestamp(y, F.lit(f)).cast("timestamp_ntz")
    year = F.substring(t, 7, 2)
    full = F.concat(F.substring(t, 1, 6), F.when(year >= "69", "19").otherwise("20"), F.substring(t, 7, 99))
    zoned = F.to_utc_timestamp(F.try_to_timestamp(t), F.current_timezone()).cast("timestamp_ntz")
    return F.when(
        ~is_missing(x),
        F.coalesce(
            of("epoch_ms", F.to_utc_timestamp(F.timestamp_millis(t.try_cast("bigint")), F.current_timezone()).cast("timestamp_ntz")),
            of("iso", zoned),
            of("local", plain("yyyy-MM-dd HH:mm:ss") - F.expr("INTERVAL 330 MINUTES")),
            of("day_first", plain("dd-MM-yyyy HH:mm:ss")),
            of("slashes", plain("yyyy/MM/dd HH:mm:ss")),
            of("month_first", plain("MM-dd-yyyy HH:mm", full)),
        ),
    )
