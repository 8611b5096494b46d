"""Repairs of an imported graph: what may be written, what a completion must prove, and how it is applied.

Tables of a store are folders of immutable versions; a version is written beside the others, and the store's head, a small
table of its own, is written last and names the version of each table. A reader that has a head keeps a consistent
store, an interrupted repair leaves the head as it was, and the versions before are the backup.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables that a repair may write; the graph's own stay as imported.
REPAIRABLE = ("member_bounds", "metadata")
ROW_CHANGES = ("insert", "update", "delete")
SHAPE_CHANGES = ("create", "drop", "alter")


def allowed(action: Column, table: Column) -> Column:
    """Whether a repair may do ``action`` to ``table``: rows change in repairable tables only, shapes never."""
    return F.when(action.isin(*ROW_CHANGES), table.isin(*REPAIRABLE)).otherwise(~action.isin(*SHAPE_CHANGES))


class Store:
    """Versioned tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def create(self, tables: dict[str, DataFrame]) -> str:
        """The first head of a store of ``tables``."""
        return self._commit({}, tables)

    def _commit(self, kept: dict[str, str], new: dict[str, DataFrame]) -> str:
        versions = dict(kept)
        for name, df in new.items():
            versions[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(versions[name])
        head = f"{self.root}/head/{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(versions.items()), "name string, path string").coalesce(1).write.parquet(head)
        return head

    def versions(self, head: str) -> dict[str, str]:
        return {r["name"]: r["path"] for r in self.spark.read.parquet(head).collect()}

    def table(self, head: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.versions(head)[name])

    def repair(self, head: str, new: dict[str, DataFrame]) -> str:
        """A new head with versions of repairable tables; anything else is refused before a byte is written."""
        refused = sorted(set(new) - set(REPAIRABLE))
        if refused:
            raise PermissionError(f"a repair may not write {refused}")
        return self._commit(self.versions(head), new)


def content(rows: DataFrame) -> str:
    """A digest of a table's rows in any order: their number and two sums over row hashes."""
    h = F.xxhash64(*rows.columns)
    got = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("s")).select(F.sha2(F.concat_ws("/", "n", "x", "s"), 256).alias("d"))
    return got.first()["d"]


def proof_checks(proof: dict[str, str], report: DataFrame, extract: DataFrame, unresolved: DataFrame, identity: str, snapshot: str) -> DataFrame:
    """(check, ok) of a completion: ``report`` (id, complete) of its roots and ``extract`` are those that the proof names, made from
    this import and snapshot, its roots are the relations (id) left unresolved, and each is complete outside the support."""
    spark = report.sparkSession
    same = [("extract", content(extract) == proof["extract"]), ("identity", identity == proof["identity"]), ("report", content(report) == proof["report"]), ("snapshot", snapshot == proof["snapshot"])]
    ids = report.select("id").distinct().withColumn("r", F.lit(1)).join(unresolved.select("id").distinct().withColumn("u", F.lit(1)), "id", "full")
    roots = ids.agg((F.count(F.when(F.col("r").isNull() | F.col("u").isNull(), 1)) == 0).alias("ok")).select(F.lit("roots").alias("check"), "ok")
    whole = report.agg((F.count(F.when(~F.coalesce("complete", F.lit(False)), 1)) == 0).alias("ok")).select(F.lit("complete").alias("check"), "ok")
    return spark.createDataFrame(same, "check string, ok boolean").union(roots).union(whole)
