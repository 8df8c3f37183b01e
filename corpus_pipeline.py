"""A training corpus from ``documents`` in five stages, each written and read back before the next.

Toxic documents go; one document of each group of near copies stays; documents contaminated
with benchmark text go; sources are mixed to their target weights, rows repeated as often as
they are taken; and the mix is dealt into shards. A stage works on all rows that the one
before kept, and changes no column of them, whatever columns there are beside ``doc_id``,
``text`` and ``source``. The last adds ``shard`` and ``slot``; columns of these names give way.

Nulls, empty tables and repeated rows are as each operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.llm import decontaminate, mixing, sharding, simhash, toxicity
from factorlab.session import scratch_path

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sharding.shard(docs, SHARDS)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.select(*kept, "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("contamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", deal_shards)]

#: Fingerprints, votes of neighbours and seeded shuffles have no DuckDB counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, through tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
