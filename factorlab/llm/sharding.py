"""Random shards by a two-pass external shuffle, with DataFrame functions only.

First pass: every row is scattered by a seeded hash of its id and text into one of enough
buckets that each fits in a task's memory. Second pass: each bucket is put in a fixed order,
shuffled by Spark's seeded ``shuffle`` (a Fisher-Yates shuffle of an array), and numbered on
from the buckets before it. The numbers cut into equal runs are the shards, so a bucket's
rows go to one shard, or to two where a run ends, and can be written where they are. A task
takes few buckets, one after another in their order, so there are never more tasks than Spark can plan.

The counts of two shards are at most one apart, whatever the data looks like. The result
depends on the rows and the seed alone, not on files, partitions or retries.
Null ids and texts hash as such. Rows with the same id and text share a bucket only as long as it
can hold them: where a bucket overflows, its large groups are counted by equal rows and cut into
runs of ``RUN_PARTS`` to a bucket, which are scattered by all their columns and their number. A run is
one row with a count until it is in its bucket. Rows that are equal throughout are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlab.session import cut

BUCKET_BYTES = 8 << 20
#: The second pass has a task for each of this many buckets; beyond that, a task takes buckets of about ``TASK_BYTES`` in turn.
TASKS = 4096
TASK_BYTES = 256 << 20
RUN = 4096
#: Groups of equal id and text above one over this of a bucket are cut where a bucket holds twice its bytes.
RUN_PARTS = 8
SEED = 17


def size_bytes(text_col: str = "text"):
    """UTF-8 bytes of the text (null: none) plus the 8 bytes of its id."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 8


def shard(docs: DataFrame, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
          id_col: str = "doc_id", text_col: str = "text", carry: list | None = None) -> DataFrame:
    """``(row, shard, slot)``: each row of ``docs`` as a struct, its shard and its place there.

    ``carry`` names what the struct holds instead of the whole row; slots start at 0 without gaps.
    """
    total = docs.agg(F.sum(size_bytes(text_col)).alias("bytes"), F.count("*").alias("rows")).first()
    rows = total["rows"]
    size = total["bytes"] or 0
    buckets = max(shards, -(-size // bucket_bytes))
    tasks = min(buckets, max(TASKS, -(-size // TASK_BYTES)))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    hashed = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
              for f in docs.schema.fields]
    packed = docs.select(key.alias("key"), F.pmod(key, F.lit(buckets)).cast("bigint").alias("bucket"),
                         F.xxhash64(F.lit(seed + 1), *hashed).alias("mix"), size_bytes(text_col).alias("size"),
                         F.struct(*(carry or ["*"])).alias("row"))
    counts = cut(packed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    packed, split = _split(packed, counts.where(F.col("bytes") > 2 * bucket_bytes), buckets, bucket_bytes, seed)
    starts = _starts(packed.groupBy("bucket").agg(F.sum("times").alias("n")) if split else counts.drop("bytes"))
    # Spark seeds a task's shuffles by its number and goes on from bucket to bucket: their order is fixed too
    placed = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    if split:
        placed = placed.select("bucket", "mix", "row", F.explode(F.sequence(F.lit(1), "times")).alias("nth"))
    piles = placed.groupBy("bucket").agg(F.collect_list(F.struct("mix", "row")).alias("pile"))
    dealt = F.shuffle(F.array_sort("pile", lambda x, y: F.when(x["mix"] < y["mix"], -1)
                                   .when(x["mix"] > y["mix"], 1).otherwise(0)), F.lit(seed))
    # shuffled before the join, which may run on other tasks, as adaptive execution finds best
    number = (piles.select("bucket", dealt.alias("dealt")).join(starts, "bucket")
              .select("start", F.posexplode("dealt").alias("at", "x"))
              .select((F.col("start") + F.col("at")).alias("number"), F.col("x.row").alias("row")))
    place = F.expr(f"cast(((number + 1) * {shards} - 1) div {max(rows, 1)}L as int)")
    first = F.expr(f"(shard * {rows}L) div {shards}")
    return number.withColumn("shard", place).select("row", "shard", (F.col("number") - first).alias("slot"))


def _split(packed: DataFrame, full: DataFrame, buckets: int, bucket_bytes: int, seed: int) -> tuple[DataFrame, bool]:
    """``packed`` with large groups of the ``full`` buckets as runs of ``times`` equal rows, if there are any."""
    rows = packed.select("bucket", "mix", "row")
    if full.isEmpty():
        return rows, False
    part = max(1, bucket_bytes // RUN_PARTS)
    # there are at most RUN_PARTS of them to a bucket
    large = cut(packed.join(F.broadcast(full.select("bucket")), "bucket").groupBy("key")
                .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
                .where((F.col("n") > 1) & (F.col("bytes") > part)).select("key"))
    if large.isEmpty():
        return rows, False
    most = F.greatest(F.lit(1), F.expr(f"{part} div size")).cast("bigint")
    runs = (packed.join(F.broadcast(large), "key").groupBy("key", "mix", "size", "row").agg(F.count("*").alias("n"))
            .withColumn("most", most)
            .withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div most")))))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "key", "mix", "run"), F.lit(buckets)).cast("bigint")
    cut_up = runs.select(bucket.alias("bucket"), "mix", "row",
                         F.least("most", F.col("n") - F.col("run") * F.col("most")).cast("int").alias("times"))
    others = packed.join(F.broadcast(large), "key", "left_anti").select("bucket", "mix", "row", F.lit(1).alias("times"))
    return others.unionByName(cut_up), True


def _starts(counts: DataFrame) -> DataFrame:
    """How many rows the buckets before each hold: runs of buckets first, then within a run."""
    runs = counts.withColumn("run", F.expr(f"bucket div {RUN}"))
    up = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    heads = (runs.groupBy("run").agg(F.sum("n").alias("n"))
             .select("run", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("head")))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (runs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(heads, "run")
            .select("bucket", (F.col("head") + F.col("inside")).alias("start")))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = SEED) -> None:
    """The rows of ``docs`` as Parquet below ``path``, a folder for each shard, in slot order.

    No shuffle follows the second pass: a bucket is written by the task that dealt it out.
    The slot is kept beside the row, since a shard is the concatenation of its buckets' files.
    """
    (shard(docs, shards, seed).sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
