"""Benchmark decontamination by winnowing.

Any span of 13 words that a document shares with an item holds 6 runs of 8 words, and both
sides keep the run whose hash is least in such a window; so at least one kept run is common.
The kept runs of the items are joined with those of the documents, and every hit is extended
word by word, up to the 5 words on either side that a span around it can reach. The union of
the spans of at least 13 words is therefore exact: each shared window is found, and hash
collisions are not. An item of fewer words is a single run of its own length.

The items' side is cut into pieces of bounded length, overlapping by 12 words, and the pieces
are dealt into blocks of about ``BLOCK_BYTES``. One block at a time is sent to the tasks, and its
hits are written before the next is: more items make more passes over the documents, never a
larger broadcast or a longer chain of workers. With one block nothing is written or shuffled.

Null texts and texts without words are never hit; items without words hit nothing; items without an id
hit words but are not listed. Repeated items count once, repeated documents each for themselves.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import WORD_TABLE, add_columns, byte_words, values
from factorlab.session import cut, scratch_path

SPAN = 13
RUN = 8
_REACH = SPAN - RUN
PIECE_WORDS = 4096
BLOCK_BYTES = 8 << 20
#: A document is contaminated if it is hit and at least one in this many of its words is.
DILUTION = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _pieces(batches):
    for batch in batches:
        ids, pieces = [], []
        for item, text in zip(values(batch.column(0)), values(batch.column(1))):
            words = byte_words(text, WORD_TABLE)
            for start in range(0, max(len(words) - SPAN + 1, min(len(words), 1)), PIECE_WORDS):
                ids.append(item)
                pieces.append(b" ".join(words[start:start + PIECE_WORDS + SPAN - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.binary())], names=["item", "piece"])


def _run_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    n = len(ids) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    for j in range(length):
        total = total * _BASE + ids[j:j + n].astype(np.uint64)
    return total ^ (total >> np.uint64(31))


def _winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash (the last of equal ones) in every window of ``width`` hashes."""
    if width == 1:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.unique(np.arange(len(windows)) + width - 1 - windows[:, ::-1].argmin(axis=1))


def build_block(pieces: list[tuple[str | None, bytes]]) -> dict:
    """What the tasks need of a block: word numbers, the words of all pieces, and kept runs by length."""
    vocabulary: dict[bytes, int] = {}
    tokens, names, bounds = [np.full(_REACH, -2)], [], []
    at = _REACH
    for item, piece in pieces:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in piece.split(b" ")])
        tokens += [ids, np.full(_REACH, -2)]
        names.append(item)
        bounds.append((at, len(ids)))
        at += len(ids) + _REACH
    tokens = np.concatenate(tokens)
    runs: dict[int, tuple[list, list, list]] = {}
    for i, (start, n) in enumerate(bounds):
        span = min(n, SPAN)
        run = RUN if n >= SPAN else n
        hashes = _run_hashes(tokens[start:start + n], run)
        kept = _winnowed(hashes, span - run + 1)
        into = runs.setdefault(span, ([], [], []))
        for part, x in zip(into, (hashes[kept], kept + start, np.full(len(kept), i))):
            part.append(x)
    tables = {}
    for span, parts in runs.items():
        hashes, where, piece = (np.concatenate(p) for p in parts)
        order = np.argsort(hashes, kind="stable")
        tables[span] = (hashes[order], where[order], piece[order])
    return {"vocabulary": vocabulary, "tokens": tokens, "names": names, "tables": tables}


def find(words: list[bytes], block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and pieces of all spans that ``words`` share with the block."""
    get = block["vocabulary"].get
    ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
    known = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
    starts, lengths = known[::2], np.diff(known)[::2]
    padded = np.concatenate([np.full(_REACH, -1), ids, np.full(SPAN, -1)])
    found = []
    for span, (hashes, where, piece) in block["tables"].items():
        run = RUN if span == SPAN else span
        for start, length in zip(starts[lengths >= span].tolist(), lengths[lengths >= span].tolist()):
            own = _run_hashes(ids[start:start + length], run)
            kept = _winnowed(own, span - run + 1)
            low, high = np.searchsorted(hashes, own[kept], "left"), np.searchsorted(hashes, own[kept], "right")
            count = high - low
            if not count.any():
                continue
            p = np.repeat(kept + start, count)
            e = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            q = where[e]
            same = lambda j: padded[p + j + _REACH] == block["tokens"][q + j]
            left, right, open_ = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.ones(len(p), bool)
            for j in range(run):
                open_ &= same(j)
            verified = open_.copy()
            if span == SPAN:
                for j in range(1, _REACH + 1):
                    open_ = open_ & same(-j)
                    left += open_
                open_ = verified.copy()
                for j in range(run, SPAN):
                    open_ = open_ & same(j)
                    right += open_
            good = verified & (left + run + right >= span)
            found.append((p[good] - left[good], p[good] + run + right[good], piece[e[good]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _merged(spans) -> list[dict]:
    """Disjoint spans in order, of any that overlap or touch."""
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["start"] + out[-1]["n"]:
            out[-1]["n"] = max(out[-1]["n"], end - out[-1]["start"])
        else:
            out.append({"start": start, "n": end - start})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))


def _block_by_block(docs: DataFrame, blocks: int, judged) -> DataFrame:
    """What all blocks hit: rows get numbers, each block's hits are written before the next is sent, then they are united."""
    spark = docs.sparkSession
    row = "_row"
    while row in docs.columns:
        row += "_"
    path = scratch_path(spark, "numbered")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows, found = spark.read.parquet(path), []
    for b in range(blocks):
        hits = judged(rows.select(row, "text"), b).drop("text")
        out = scratch_path(spark, "hits")
        # the first block's table has every row, with its number of words
        (hits.where((F.size("items") > 0) | (F.size("spans") > 0)) if b else hits).write.parquet(out)
        found.append(spark.read.parquet(out))
    together = reduce(DataFrame.unionByName, found).groupBy(row).agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.max("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merged(columns):
        return [pa.array([_merged((s["start"], s["start"] + s["n"]) for s in row_) for row_ in values(columns[0])], _SPANS)]

    together = add_columns(together, ["spans"], "spans array<struct<start:bigint,n:bigint>>", merged)
    kept = [c for c in rows.columns if c.lower() not in ("spans", "items", "n_words")]
    return rows.select(*kept).join(together, row).drop(row)


def flag(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` (first word and length), ``items`` and ``contaminated``."""
    spark = docs.sparkSession
    pieces = cut(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
                 .mapInArrow(_pieces, "item string, piece binary").distinct())
    total = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)))
    schema = "spans array<struct<start:bigint,n:bigint>>, items array<string>, n_words bigint"

    def judged(rows: DataFrame, block: int) -> DataFrame:
        """``rows`` with what the items of one block hit."""
        pieces_ = [(r["item"], bytes(r["piece"])) for r in numbered.where(F.col("block") == block).collect()]
        shared = spark.sparkContext.broadcast(build_block(pieces_))

        def hits(columns):
            spans, names, sizes = [], [], []
            for text in values(columns[0]):
                words = byte_words(text, WORD_TABLE)
                start, end, piece = find(words, shared.value)
                spans.append(_merged(zip(start.tolist(), end.tolist())))
                names.append(sorted({shared.value["names"][i] for i in np.unique(piece).tolist()} - {None}))
                sizes.append(len(words))
            return [pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string())), pa.array(sizes, pa.int64())]

        return add_columns(rows, ["text"], schema, hits)

    done = judged(docs, 0) if blocks == 1 else _block_by_block(docs, blocks, judged)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    return (done.withColumn("n_hit", hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (DILUTION * F.col("n_hit") >= F.col("n_words"))))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they were."""
    packed = docs.select("text", F.struct("*").alias("row"))
    return flag(packed, items).where(~F.col("contaminated")).select("row.*")
