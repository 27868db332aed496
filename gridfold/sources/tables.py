"""S4/S5/S6 + M1 sink: the fact table and the landing log as catalog tables.

The fact table is Parquet, partitioned by ``batch_key``. Replacing batches is
a dynamic partition overwrite (only partitions with new rows are rewritten)
followed by dropping the partitions of replaced keys that got no new rows.
Open-source Parquet tables have no DELETE, and an overwrite with an empty
frame removes nothing, hence the explicit drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.schema import FACT_COLUMNS, FACT_SCHEMA, LANDING_SCHEMA

FACT_TABLE = "period_facts"
LANDING_TABLE = "landing_log"


def _ddl(schema: T.StructType, skip: tuple[str, ...] = ()) -> str:
    cols = []
    for f in schema.fields:
        if f.name in skip:
            continue
        comment = (f.metadata or {}).get("comment", "").replace("'", "\\'")
        cols.append(f"  `{f.name}` {f.dataType.simpleString().upper()} COMMENT '{comment}'")
    return ",\n".join(cols)


def ensure_tables(spark: SparkSession, database: str = "default", facts: str = FACT_TABLE,
                  landing: str = LANDING_TABLE) -> tuple[str, str]:
    """Create the database and both tables when absent (safe to re-run)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    fq_landing = f"`{database}`.`{landing}`"
    fq_facts = f"`{database}`.`{facts}`"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {fq_landing} (\n{_ddl(LANDING_SCHEMA)}\n) USING parquet "
        "COMMENT 'One row per landed workbook'"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {fq_facts} (\n{_ddl(FACT_SCHEMA)}\n) USING parquet "
        "PARTITIONED BY (batch_key) "
        "COMMENT 'Period facts: sheet headers parsed by pattern, then unpivoted'"
    )
    return fq_facts, fq_landing


def ensure_fact_table(spark: SparkSession, table: str, location: str | None = None) -> str:
    """S6 for one fact table (optionally at an explicit location)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (\n{_ddl(FACT_SCHEMA)}\n) USING parquet "
        f"PARTITIONED BY (batch_key){loc} COMMENT 'Period facts'"
    )
    return table


def read_facts(spark: SparkSession, table: str) -> DataFrame:
    """The fact table through the catalog (string batch_key, never inferred)."""
    return spark.table(table).select(*FACT_COLUMNS)


def append_landings(log_rows: DataFrame, table: str) -> None:
    """S7 sink: append landing-log records (by column name)."""
    log_rows.select(*[f.name for f in LANDING_SCHEMA.fields]).write.insertInto(table)


def _conform(df: DataFrame) -> DataFrame:
    """Fact columns in table order with the table's types (match by name)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA.fields])


def _quote(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Input partitions above which the rows are clustered by batch_key before the
# write (below it, files per batch are bounded by this number anyway).
REBALANCE_MIN_PARTITIONS = 256
DROP_CHUNK = 500  # partitions per ALTER TABLE ... DROP statement


def write_batches(spark: SparkSession, table: str, incoming: DataFrame, drop_keys: list[str] = (),
                  rebalance: bool | None = None) -> int:
    """Replace batches by ``incoming``; other batches untouched.

    Partitions that receive rows are overwritten (dynamic partition
    overwrite); ``drop_keys`` are replaced keys that receive no row (a valid
    file whose rows were all dropped), and their partitions are dropped. The
    list is bounded by the number of files in the run. Returns the number of
    rows written, counted during the write itself.

    With ``rebalance`` the rows are clustered by batch_key before the write
    (a REBALANCE shuffle: AQE coalesces small batches and splits a hot one),
    so each partition gets a few well-sized files instead of one small file
    per batch per task. ``None`` decides by the input's partition count.
    """
    obs = Observation("rows_written")
    rows = _conform(incoming).observe(obs, F.count(F.lit(1)).alias("n"))
    if rebalance is None:
        rebalance = incoming.rdd.getNumPartitions() > REBALANCE_MIN_PARTITIONS
    if rebalance:
        rows = rows.hint("rebalance", "batch_key")
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)
    keys = list(drop_keys)
    for i in range(0, len(keys), DROP_CHUNK):  # metadata only, many partitions per statement
        specs = ", ".join(f"PARTITION (batch_key = {_quote(k)})" for k in keys[i:i + DROP_CHUNK])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    return int(obs.get.get("n", 0) or 0)
