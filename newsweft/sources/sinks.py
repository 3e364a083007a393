"""Sinks: payloads offloaded as compressed lines, the archive's files, and change-only synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.operators.archive import changed_files

BATCH_ROWS = 2000


def offload_payloads(rows: DataFrame, path: str, run: str, payload: str = "payload", key: str = "payload_s3_key") -> DataFrame:
    """Write the payloads that have no key yet as gzipped JSON lines, at most BATCH_ROWS an object, and return all rows with those keys.

    Every run has a folder of its own, so no run touches an earlier one's objects; a run that is repeated under its
    name writes the same objects again. A payload is only blanked, and its key only stamped, when the object that
    was read back holds just that payload; the others stay for the next run, and so does a null payload. Rows that
    have a key stay as they are. Ids tell rows apart.
    """
    folder = f"{path.rstrip('/')}/run={run}"
    bucket = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 2)
    todo = rows.filter(F.col(key).isNull() & F.col(payload).isNotNull()).select(F.col("id").cast("string").alias("id"), F.col(payload).alias("payload"), bucket.alias("bucket"))
    todo.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").option("compression", "gzip").option("maxRecordsPerFile", BATCH_ROWS).json(folder)
    back = rows.sparkSession.read.schema("id string, payload string, bucket string").json(folder)
    held = back.select(F.col("id").alias("__id"), F.sha2("payload", 256).alias("__hash"), F.col("bucket").alias("__bucket")).dropDuplicates(["__id"])
    met = rows.join(held, rows["id"].cast("string") == F.col("__id"), "left")
    done = F.col(key).isNull() & (F.col("__hash") == F.sha2(F.col(payload), 256))
    stamped = met.withColumns({key: F.when(done, F.concat(F.lit(f"{folder}/bucket="), "__bucket")).otherwise(F.col(key)), payload: F.when(done, F.lit(None)).otherwise(F.col(payload))})
    return stamped.select(*rows.columns)


def write_shards(lines: DataFrame, path: str) -> None:
    """Article lines (month, document_id, line) as one folder for each month, sorted by id within its files."""
    lines.repartition("month", F.substring("document_id", 1, 2)).sortWithinPartitions("month", "document_id").write.mode("overwrite").partitionBy("month").text(path)


def sync_plan(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """What a change-only sync does, by path."""
    return changed_files(desired, existing)
