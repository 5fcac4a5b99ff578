"""Tables of items in buckets of a hash of tenant and item, so that a few items are read without the others.

A bucket is a folder: the buckets of the items asked for, at most as many numbers as there are buckets, become a filter on the
partition column, and all other folders are never opened. Big buckets are written by several tasks into several files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wareproof.sources.records import Catalog

BUCKETS = 256
BUCKET = "item_bucket"
FEATURES = ("items", "variants", "memberships")


def item_bucket(tenant: Column | str, item: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tenant, item), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class ItemTables:
    """The feature tables of a catalog, and any other tables by item, below one folder that all executors share.

    A table that is written again gets a new folder, so what was read of it before stays readable; ``folders`` names the present ones."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    schemas: dict[str, StructType] = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)

    def write(self, name: str, df: DataFrame, item: str = "product_id") -> None:
        rows = df.withColumn(BUCKET, item_bucket("tenant", item, self.buckets))
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        self.schemas[name], self.folders[name] = rows.schema, folder

    def store(self, catalog: Catalog) -> ItemTables:
        for name in FEATURES:
            self.write(name, getattr(catalog, name), "id" if name == "items" else "product_id")
        return self

    def numbers(self, ids: DataFrame) -> list[int]:
        """The buckets of the given items (tenant, product_id): at most ``buckets`` numbers."""
        found = ids.select(item_bucket("tenant", "product_id", self.buckets).alias("n")).distinct()
        return sorted(r.n for r in found.collect())

    def read(self, name: str, numbers: list[int] | None = None) -> DataFrame:
        """A table, or its given buckets."""
        df = self.spark.read.schema(self.schemas[name]).parquet(self.folders[name])
        if numbers is not None:
            df = df.filter(F.col(BUCKET).isin(numbers))
        return df.drop(BUCKET)

    def catalog(self, numbers: list[int] | None = None) -> Catalog:
        return Catalog(*(self.read(name, numbers) for name in FEATURES))
