"""Access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: [time] "METHOD target version" status bytes "referer" "user agent"
LINE = r'^\[([^\]]*)\] "(\S+) (\S+) ([^"]*)" (\d{3}) (\d+) "([^"]*)" "([^"]*)"$'


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Adds time (text), method, target, version, status, bytes, referer and agent to ``value``; a
    referer or agent of '-' is null, and all are null for a line of another shape."""
    part = lambda i: F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
    absent = lambda i: F.nullif(part(i), F.lit("-"))
    return lines.select("*", part(1).alias("time"), part(2).alias("method"), part(3).alias("target"), part(4).alias("version"), part(5).try_cast("int").alias("status"), part(6).try_cast("long").alias("bytes"), absent(7).alias("referer"), absent(8).alias("agent"))
