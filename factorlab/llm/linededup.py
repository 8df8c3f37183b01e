"""Line deduplication that can be taken back: exact reference counts behind sharded cuckoo filters.

A state is three tables in the shared folder. ``refs`` names the keys of every document,
``counts`` has for every key the number of documents that hold it, and ``filters`` a cuckoo
filter for every shard of keys, of those that at least ``least`` documents hold. Inserting
documents adds to the counts, deleting them subtracts, and only keys that pass the threshold
one way or the other enter or leave a filter. When shards would get too large there are twice
as many, and the filters are built anew from the counts. States are never changed in place: each step
writes a new one, so a failed step leaves the old one whole.

To deduplicate, the references are held against the filters where they lie; what passes is
counted exactly, document by document, so false alarms cost a little time and change nothing.
A key's lines stay in the largest doc_id that holds it. Counts are combined before every
shuffle, so a line that a third of all documents hold is a few rows to each task.

A document is a doc_id: repeated rows are one document, whose rows are all treated alike. Rows without an id are
not counted and keep all lines. Null and empty texts are one empty line. No other column is read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.llm.common import add_columns, values
from factorlab.llm.cuckoo import CuckooFilter
from factorlab.session import scratch_path

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Shards of the filters: so many at least, and twice as many whenever one would hold more than ``SHARD_KEYS`` keys.
SHARDS = 64
SHARD_KEYS = 100_000
#: Filters up to this size go to every task; beyond it the references are joined with the counts instead.
FILTER_BYTES = 64 << 20
_STRIP = " \t\n\v\f\r"
_FOLD = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> bytes | None:
    """16 bytes that name the stripped, lower-cased line; None if it is shorter than 40 code points."""
    key = line.strip(_STRIP)
    if len(key) < LEAST_CHARS:
        return None
    return hashlib.blake2b(key.translate(_FOLD).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _halves(keys) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _references(batches):
    for batch in batches:
        ids, keys, counts = [], [], []
        for doc, text in zip(values(batch.column(0)), values(batch.column(1))):
            held = Counter(map(line_key, (text or "").split("\n")))
            held.pop(None, None)
            ids += [doc] * len(held)
            keys += held.keys()
            counts += held.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())],
                                         names=["doc_id", "key", "n_lines"])


@dataclass(frozen=True)
class State:
    """Where the tables lie, and how they were made."""
    refs: tuple[str, ...] = ()
    gone: str | None = None
    counts: str | None = None
    filters: str | None = None
    least: int = LEAST_DOCS
    shards: int = SHARDS

    def references(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(*self.refs)
        return rows.join(spark.read.parquet(self.gone), "doc_id", "left_anti") if self.gone else rows


def _written(df: DataFrame, tag: str) -> str:
    path = scratch_path(df.sparkSession, f"lines-{tag}")
    df.write.parquet(path)
    return path


def insert(state: State, docs: DataFrame) -> State:
    """The state with further documents, none of whose ids it holds yet."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    path = _written(rows.mapInArrow(_references, "doc_id bigint, key binary, n_lines bigint"), "refs")
    added = docs.sparkSession.read.parquet(path)
    return _counted(replace(state, refs=state.refs + (path,)), added, 1)


def delete(state: State, ids: DataFrame) -> State:
    """The state without the documents that ``ids(doc_id)`` names, as if they had never been inserted."""
    spark = ids.sparkSession
    named = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    lost = state.references(spark).join(named, "doc_id", "left_semi")
    counted = _counted(state, lost, -1)
    kept = _written(state.references(spark).join(named, "doc_id", "left_anti"), "refs")
    return replace(counted, refs=(kept,), gone=None)


def _counted(state: State, refs: DataFrame, sign: int) -> State:
    """The state with counts and filters changed by ``refs``, ``sign`` times."""
    spark = refs.sparkSession
    change = refs.select("key", F.lit(0).cast("bigint").alias("was"), F.lit(sign).cast("bigint").alias("n"))
    if state.counts:
        change = change.unionByName(spark.read.parquet(state.counts).select("key", F.col("n").alias("was"), "n"))
    summed = change.groupBy("key").agg(F.sum("was").alias("was"), F.sum("n").alias("n"))
    both = _written(summed.where("n > 0 or was > 0"), "counts")
    counts = spark.read.parquet(both)
    crossed = counts.where(f"(n >= {state.least}) <> (was >= {state.least})")
    shards = _enough_shards(state.shards, counts.where(F.col("n") >= state.least).count())
    if shards > state.shards:  # all keys are dealt anew
        state = replace(state, shards=shards, filters=None)
        crossed = counts.where(F.col("n") >= state.least)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    moves = crossed.select(shard.alias("shard"), "key", (F.col("n") >= state.least).alias("enters"))
    old = (spark.read.parquet(state.filters) if state.filters
           else spark.createDataFrame([], "shard int, filter binary, keys array<binary>"))
    filters = (old.groupBy("shard").cogroup(moves.groupBy("shard"))
               .applyInPandas(_moved, "shard int, filter binary, keys array<binary>"))
    return replace(state, counts=both, filters=_written(filters, "filters"))


def _enough_shards(shards: int, keys: int) -> int:
    while keys > shards * SHARD_KEYS:
        shards *= 2
    return shards


def _moved(old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after keys have entered and left; built anew from its keys when it is full."""
    shard = int((moves if len(moves) else old)["shard"].iloc[0])
    keys = set(old["keys"].iloc[0]) if len(old) else set()
    held = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter(1)
    leave = [bytes(k) for k, e in zip(moves["key"], moves["enters"]) if not e]
    enter = [bytes(k) for k, e in zip(moves["key"], moves["enters"]) if e]
    keys = ({bytes(k) for k in keys} - set(leave)) | set(enter)
    whole = True
    if leave:
        for h, x in zip(*_halves(leave)):
            held.delete(h, x)
    if enter:
        whole = len(keys) <= 0.9 * held.table.size and all([held.insert(h, x) for h, x in zip(*_halves(enter))])
    if not whole:
        held = CuckooFilter.build(*_halves(sorted(keys)))
    return pd.DataFrame({"shard": [shard], "filter": [held.dump()], "keys": [sorted(keys)]})


def _passing(state: State, refs: DataFrame, limit: int) -> DataFrame:
    """The references whose keys may be held by ``state.least`` documents or more."""
    spark = refs.sparkSession
    filters = spark.read.parquet(state.filters).select("shard", "filter")
    total = filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    if total > limit:
        often = spark.read.parquet(state.counts).where(F.col("n") >= state.least).select("key")
        return refs.join(often, "key", "left_semi")
    shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})
    with_shard = refs.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(state.shards)).cast("int"))

    def passing(columns):
        held = {s: CuckooFilter.load(f) for s, f in shared.value.items()}
        shard = np.array(columns[1])
        if not len(shard):
            return [pa.array([], pa.bool_())]
        high, low = _halves(values(columns[0]))
        out = np.zeros(len(shard), bool)
        for s, f in held.items():
            at = np.flatnonzero(shard == s)
            if len(at):
                out[at] = f.contains(high[at], low[at])
        return [pa.array(out)]

    return add_columns(with_shard, ["key", "shard"], "passes boolean", passing).where("passes").drop("passes", "shard")


def repeated_lines(state: State, spark: SparkSession, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``(doc_id, drops)``: the keys whose lines each document loses."""
    held = _passing(state, state.references(spark), filter_bytes).select("key", "doc_id").distinct()
    path = _written(held, "often")
    held = spark.read.parquet(path)
    often = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= state.least)
    return (held.join(often, "key").where("doc_id <> keeper")
            .groupBy("doc_id").agg(F.collect_list("key").alias("drops")))


def dedup(docs: DataFrame, state: State, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` with ``kept`` (the text without repeated lines), ``n_lines`` and ``n_dropped``."""

    def rewritten(columns):
        kept, lines, dropped = [], [], []
        for text, drops in zip(values(columns[0]), values(columns[1])):
            text = text or ""
            parts = text.split("\n")
            if drops:
                lost = set(drops)
                stay = [p for p in parts if line_key(p) not in lost]
                text = "\n".join(stay)
            kept.append(text)
            lines.append(len(parts))
            dropped.append(len(parts) - (len(stay) if drops else len(parts)))
        return [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]

    drops = repeated_lines(state, docs.sparkSession, filter_bytes).withColumnRenamed("doc_id", "dropping_id")
    base = docs.drop("drops", "dropping_id")
    joined = base.join(drops, base.doc_id == drops.dropping_id, "left").drop("dropping_id")
    return add_columns(joined, ["text", "drops"], "kept string, n_lines bigint, n_dropped bigint", rewritten).drop("drops")
