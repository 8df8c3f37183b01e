"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits. It is cut into segments; two fingerprints that differ in at most
``radius`` bits agree, up to a small Hamming ball, in one segment. So every fingerprint looks
up the balls around its own segments in a table of all segments, and the whole distance is
verified in the join itself. Only different fingerprints take part: copies meet in a count
before, however many there are.

Documents without words have fingerprint zero and link like any other. Rows without an id
get a fingerprint and a class, but no class is named after them. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import SPACE_TABLE, add_columns, byte_words, values
from factorlab.llm.components import star_components
from factorlab.session import cut

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
_CHUNK = 1 << 15


def _shingles(words: list[bytes], size: int):
    if len(words) <= size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(size))))


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set if more than half the shingle hashes set it."""
    hashes = map(xxhash.xxh64_intdigest, _shingles(byte_words(text, SPACE_TABLE), size), iter(lambda: SEED, None))
    ones, total = np.zeros(BITS, np.int64), 0
    while True:
        part = np.fromiter(islice(hashes, _CHUNK), dtype=">u8")
        if not len(part):
            break
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _fingerprint(columns: list[pa.Array]) -> list[pa.Array]:
    return [pa.array([simhash(t) for t in values(columns[0])], pa.int64())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return add_columns(rows, ["text"], "fp bigint", _fingerprint).select("doc_id", "fp")


def plan_segments(count: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """``(first bit, width, radius)`` of each segment, for ``count`` different fingerprints.

    With m segments, distance ``radius`` leaves at most ``radius // m`` differing bits in one
    of the first ``radius % m + 1`` segments, or one less in one of the others. Fewer, wider
    segments have larger balls to enumerate but hold fewer strangers; the number of segments
    with the least rows to shuffle and candidates to verify is taken. All give the same links.
    """
    best, cost = [], float("inf")
    for m in range(1, radius + 2):
        plan, first = [], 0
        for j in range(m):
            width = BITS // m + (j < BITS % m)
            reach = radius // m if j <= radius % m else radius // m - 1
            plan.append((first, width, reach))
            first += width
        plan = [(f, w, r) for f, w, r in plan if r >= 0]
        balls = [len(_ball(w, r)) for _, w, r in plan]
        rows = count * (sum(balls) + len(plan))
        strangers = sum(count * count * b / 2 ** w for b, (_, w, _) in zip(balls, plan))
        if rows + strangers / 20 < cost:
            best, cost = plan, rows + strangers / 20
    return best


def _ball(width: int, reach: int) -> list[tuple[int, ...]]:
    return [c for r in range(reach + 1) for c in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def hamming_links(fps: DataFrame, radius: int = RADIUS, plan: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """``(a, b)`` with a < b for different values ``fp`` at most ``radius`` bits apart.

    A pair may come once for each segment that both share. ``fps`` has one row per value.
    """
    plan = plan or plan_segments(fps.count(), radius)
    probes, homes = [], []
    for j, (first, width, reach) in enumerate(plan):
        mask = _signed(((1 << width) - 1) << first)
        homes.append(F.struct(F.lit(j).alias("seg"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
        flips = [_signed(sum(1 << (first + i) for i in c)) for c in _ball(width, reach)]
        probes.append((j, mask, flips))
    index = fps.select(F.col("fp").alias("b"), F.explode(F.array(*homes)).alias("s")) \
        .select("b", "s.seg", "s.key")
    looked = None
    for j, mask, flips in probes:
        part = fps.select(F.col("fp").alias("a"), F.lit(j).alias("seg"),
                          F.explode(F.lit(np.array(flips, dtype=np.int64))).alias("flip")) \
            .select("a", "seg", F.col("a").bitwiseAND(F.lit(mask)).bitwiseXOR(F.col("flip")).alias("key"))
        looked = part if looked is None else looked.unionByName(part)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return (looked.join(index, (looked.seg == index.seg) & (looked.key == index.key) & near)
            .select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: the class of every row, named by its smallest id."""
    rows = cut(fingerprints(docs, id_col, text_col))
    values_ = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = star_components(hamming_links(values_.select("fp"), radius))
    named = (values_.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(names, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, rows without one coming last.

    Among rows that share this id the one of the least hash of id and text stays, and of rows
    equal in both any one. Classes are of fingerprints, so rows without an id, repeated rows and
    different texts under one id are all judged by their own text.
    """
    place = F.struct(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"),
                     F.xxhash64(id_col, text_col).alias("mix"), F.xxhash64(F.lit(SEED), text_col).alias("mix2"))
    packed = docs.select(place.alias("place"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    rows = cut(add_columns(packed.select("place", "text"), ["text"], "fp bigint", _fingerprint).select("place", "fp"))
    first = cut(rows.groupBy("fp").agg(F.min("place").alias("place")))
    roots = star_components(hamming_links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    keepers = (first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
               .agg(F.min("place").alias("place")).select("place"))
    # rows equal in id and text become one in the tasks that read them, before they are shuffled
    return packed.groupBy("place").agg(F.first("row").alias("row")).join(keepers, "place", "left_semi").select("row.*")
