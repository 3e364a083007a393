"""The relations of the news pipeline as DataFrames, derived from the tables of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.plans.dialect import AS_OF, SPARK, relations

TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


class Relations:
    """``Relations(spark, folder).feed_items`` and so on; a relation is only planned when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            known = relations(SPARK)
            if name in known:
                made[name] = self.sql(known[name])
            elif name in TABLES:
                made[name] = self.table(name)
            else:
                raise AttributeError(name)
        return made[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL in which names of relations and tables after FROM and JOIN stand for their DataFrames."""
        known = [*relations(SPARK), *TABLES]
        used = {n for n in known if n not in frames and re.search(rf"\b(?:from|join)\s+{n}\b", text, re.I)}
        named = {**{n: getattr(self, n) for n in used}, **frames}
        text = text.replace("{", "{{").replace("}", "}}")
        for n in named:
            text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text, flags=re.I)
            text = re.sub(rf"\{{{n}\}}(?=\s+(?:where|join|left|on|group|order|union|limit|\)|$|cross|inner)|\s*$|\s*\))", rf"{{{n}}} as {n}", text, flags=re.I)
        return self.spark.sql(text, **named)

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")
