"""The five declared sources of a folder as one table of records, ready for observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.sources.identity_view import RID_STEP
from kinmesh.sources.readers import flat, read_source

#: Raw field -> concept of each source.
FIELDS = {source: dict(m["fields"]) for source, m in config.SOURCES.items()}
#: The source whose e-mails are verified.
VERIFIED = "source = 'social_logins'"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """rid, source, record_ordinal, source_record_id and every mapped raw field as text (null where a source lacks it).  rid is the
    place of the source times RID_STEP and the ordinal: the global order without a global sort."""
    parts = [flat(read_source(spark, folder, source), source).withColumn("rid", F.lit(place * RID_STEP) + F.col("record_ordinal")) for place, source in enumerate(config.SOURCES)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
