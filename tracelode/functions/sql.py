"""SQL access: views over the sources and the functions to ask with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Name, parameters, result type, body.
FUNCTIONS = (
    (
        "ip_num", "ip STRING", "BIGINT",
        "cast(split(ip, '[.]')[0] as bigint) * 16777216 + cast(split(ip, '[.]')[1] as bigint) * 65536 "
        "+ cast(split(ip, '[.]')[2] as bigint) * 256 + cast(split(ip, '[.]')[3] as bigint)",
    ),
    ("is_syn", "flags BIGINT", "BOOLEAN", "(flags & 2) <> 0 and (flags & 16) = 0"),
    ("proto_name", "code STRING", "STRING", "case code when '6' then 'tcp' when '17' then 'udp' end"),
    (
        "zone", "ip STRING", "STRING",
        "case when ip like '10.%' or ip like '192.168.%' or ip rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]' "
        "then 'internal' else 'external' end",
    ),
    ("utc_iso", "us BIGINT", "STRING", "date_format(timestamp_micros(us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"),
)


def register_functions(spark: SparkSession) -> None:
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")


def register_views(sources: Mapping[str, DataFrame]) -> None:
    for name, df in sources.items():
        df.createOrReplaceTempView(name)
