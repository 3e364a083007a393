"""The company universe file: read with a declared schema, checked by rules, never repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS, MOST_BYTES, VERSION = 100_000, 64 << 20, "company-universe.v2"

COMPANY = (
    "struct<source_company_id:string,company_key:string,name:string,aliases:array<string>,ownership_status:string,lifecycle_status:string,"
    "listings:array<struct<ticker:string,exchange:string,is_primary:boolean,metadata:map<string,string>>>,market_cap:bigint,country:string,ipo_year:int,sector:string,industry:string,"
    "identifiers:map<string,string>,homepage_url:string,investor_relations_url:string,newsroom_url:string,blog_url:string,hints:array<string>,metadata:map<string,string>>"
)
SCHEMA = f"schema_version string, source struct<name:string,revision:string,generated_at:string,metadata:map<string,string>>, companies array<{COMPANY}>, _corrupt_record string"


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """One row for each company of the one file at ``path``, with the source's name, the file's SHA-256 and its size."""
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("input_sha256"), F.col("length").alias("input_bytes"))
    rows = whole.select("schema_version", F.col("source.name").alias("source_name"), F.posexplode("companies").alias("row_number", "c"))
    return rows.select("schema_version", "source_name", "row_number", "c.*").join(F.broadcast(digest))


def violations(rows: DataFrame) -> DataFrame:
    """(rule, row_number, company_key) for each rule that a row breaks; an import needs this to be empty."""
    key = F.col("company_key")
    primary = F.size(F.filter(F.coalesce("listings", F.array()), lambda x: F.coalesce(x["is_primary"], F.lit(False))))
    broken = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("schema_version") == VERSION, F.lit(False)), "schema_version"),
            F.when(F.col("input_bytes") > MOST_BYTES, "too_large"),
            F.when(F.col("row_number") >= MOST_ROWS, "too_many_rows"),
            F.when(~F.coalesce(key.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "company_key"),
            F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "name"),
            F.when(F.trim(F.coalesce("source_company_id", F.lit(""))) == "", "source_company_id"),
            F.when(F.col("market_cap") < 0, "market_cap"),
            F.when(~F.col("ipo_year").between(1600, 2200), "ipo_year"),
            F.when(primary > 1, "primary_listings"),
            F.when(F.exists(F.coalesce("listings", F.array()), lambda x: x["ticker"] != F.upper(x["ticker"])), "ticker_case"),
            F.when(F.size(F.array_distinct(F.coalesce("aliases", F.array()))) < F.size(F.coalesce("aliases", F.array())), "aliases"),
        )
    )
    single = rows.select(F.explode(broken).alias("rule"), "row_number", "company_key")
    twice = [
        rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("row_number")).filter("n > 1").select(F.lit(f"duplicate_{c}").alias("rule"), "row_number", F.col(c).alias("company_key"))
        for c in ("company_key", "source_company_id")
    ]
    return single.unionByName(twice[0]).unionByName(twice[1])
