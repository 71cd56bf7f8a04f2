"""Items, tags, cells and regions derived from the star-schema tables.

Coordinates are integer centidegrees. ``PRELUDE`` states the same views as SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import token

SUPPLIERS, PARTS = 10_000_000, 20_000_000

PRELUDE = """
item_kvs AS (SELECT c_custkey AS item_id, 'segment' AS k, c_mktsegment AS v FROM customer
  UNION ALL SELECT c_custkey, 'name', c_name FROM customer
  UNION ALL SELECT 10000000+s_suppkey, 'name', s_name FROM supplier
  UNION ALL SELECT 20000000+p_partkey, 'name', p_name FROM part
  UNION ALL SELECT 20000000+p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT 20000000+p_partkey, 'type', p_type FROM part),
item_cells AS (SELECT c_custkey AS item_id, CAST(c_nationkey AS BIGINT) AS cell_id FROM customer
  UNION SELECT 10000000+s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier
  UNION SELECT 20000000+l_partkey, CAST(s_nationkey AS BIGINT) FROM lineitem JOIN supplier ON l_suppkey=s_suppkey),
cell_parents AS (SELECT CAST(n_nationkey AS BIGINT) AS cell_id, CAST(n_regionkey AS BIGINT) AS region_id FROM nation
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(100+n_nationkey AS BIGINT) FROM nation),
region_kvs AS (SELECT CAST(r_regionkey AS BIGINT) AS region_id, 'region' AS k, r_name AS v FROM region
  UNION ALL SELECT CAST(100+n_nationkey AS BIGINT), 'nation', n_name FROM nation),
items AS (SELECT item_id, (item_id*7919)%17000-8500 AS lat_min, (item_id*7919)%17000-8500+(item_id*31)%50 AS lat_max,
  (item_id*104729)%35000-17500 AS lon_min, (item_id*104729)%35000-17500+(item_id*17)%80 AS lon_max
  FROM (SELECT DISTINCT item_id FROM item_cells) t),
item_tokens AS (SELECT item_id, lower(concat('@',k,':',v)) AS token FROM item_kvs
  UNION SELECT ic.item_id, lower(concat('@',r.k,':',r.v)) FROM item_cells ic
  JOIN cell_parents cp ON cp.cell_id=ic.cell_id JOIN region_kvs r ON r.region_id=cp.region_id)
"""


@dataclass(frozen=True)
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def item_kvs(self) -> DataFrame:
        def tags(table: str, key: str, offset: int, columns: dict[str, str]) -> DataFrame:
            each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in columns.items())))
            return self.table(table).select((F.lit(offset) + F.col(key)).cast("long").alias("item_id"), each.alias("kv")).select("item_id", "kv.k", "kv.v")

        parts = tags("part", "p_partkey", PARTS, {"name": "p_name", "brand": "p_brand", "type": "p_type"})
        return tags("customer", "c_custkey", 0, {"segment": "c_mktsegment", "name": "c_name"}).unionByName(tags("supplier", "s_suppkey", SUPPLIERS, {"name": "s_name"})).unionByName(parts)

    @cached_property
    def item_cells(self) -> DataFrame:
        cell = lambda c: F.col(c).cast("long").alias("cell_id")
        customers = self.table("customer").select(F.col("c_custkey").alias("item_id"), cell("c_nationkey"))
        suppliers = self.table("supplier")
        parts = self.table("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select((F.lit(PARTS) + F.col("l_partkey")).alias("item_id"), cell("s_nationkey"))
        return customers.unionByName(suppliers.select((F.lit(SUPPLIERS) + F.col("s_suppkey")).alias("item_id"), cell("s_nationkey"))).unionByName(parts).distinct()

    @cached_property
    def cell_parents(self) -> DataFrame:
        cell = F.col("n_nationkey").cast("long")
        regions = F.explode(F.array(F.col("n_regionkey").cast("long"), 100 + cell))
        return self.table("nation").select(cell.alias("cell_id"), regions.alias("region_id"))

    @cached_property
    def region_kvs(self) -> DataFrame:
        regions = self.table("region").select(F.col("r_regionkey").cast("long").alias("region_id"), F.lit("region").alias("k"), F.col("r_name").alias("v"))
        return regions.unionByName(self.table("nation").select((100 + F.col("n_nationkey")).cast("long").alias("region_id"), F.lit("nation").alias("k"), F.col("n_name").alias("v")))

    @cached_property
    def items(self) -> DataFrame:
        i = F.col("item_id")
        lat, lon = (i * 7919) % 17000 - 8500, (i * 104729) % 35000 - 17500
        return self.item_cells.select("item_id").distinct().select("item_id", lat.alias("lat_min"), (lat + (i * 31) % 50).alias("lat_max"), lon.alias("lon_min"), (lon + (i * 17) % 80).alias("lon_max"))

    @cached_property
    def item_tokens(self) -> DataFrame:
        from ..operators.build import inherited_tokens

        return inherited_tokens(self.item_kvs, self.item_cells, self.cell_parents, self.region_kvs)

    @cached_property
    def cells(self) -> DataFrame:
        """Cells with the smallest rectangle around their items."""
        from ..operators.spatial import bounding_boxes

        return bounding_boxes(self.item_cells.join(self.items, "item_id"), "cell_id")


__all__ = ["PRELUDE", "Fixtures", "token"]
