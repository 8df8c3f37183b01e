"""Alignment of two tokenizers' tokens on the same bytes, by interval coalescing.

A text gets a leading blank, as the second tokenizer adds one itself. Every token covers an
interval of the text's bytes. All intervals of both sides are sorted by their starts; a group
ends where the next start reaches the running maximum of the ends, so its tokens cover the
same bytes on both sides and no smaller cut does. Within a group every A token is linked with
every B token; links of one pair of ids are counted, never listed one by one.

``count`` of a pair of ids is the number of documents that hold it linked, over the whole
table. Counts are combined in each task before they are shuffled; ``score`` looks them up in a
broadcast table if its checked size allows and otherwise in a shuffled join around hot pairs.

A text is encoded whole, in words cut before a blank between two characters that are none, where
neither tokenizer can join anything; a task encodes each different word once and keeps its tokens
in a table of bounded size. Memory does not grow with a text that has blanks. Null and empty
texts, and texts that one tokenizer does not give back byte by byte, have no tokens: zeros and
empty groups. Repeated rows are rows like others. Columns with names of the results give way to
them, others pass through.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import add_columns
from factorlab.operators.skew import lookup_join
from factorlab.session import scratch_path, shuffle_partitions

TOKENIZERS = "/opt/tokenizers"
#: Characters that are aligned together.
BATCH_CHARS = 1 << 20
#: Characters of the words whose tokens a task keeps; beyond it the table is begun anew.
WORD_CHARS = 1 << 21
#: Links that are spread out at once.
_EXPAND = 1 << 22
#: Pairs that may be broadcast, 17 bytes each.
BROADCAST_PAIRS = 4_000_000
#: A single blank; the second tokenizer writes blanks as U+2581 and joins runs of them.
_CUT = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")
#: What stands before an id: at a text's start, beside its like, before the first of B, before a group.
_MARKS = (b"", b",", b"|", b";")
_LOADED: dict = {}


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies spell a byte as the character of its code if that is printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level BPE of the ``tokenizers`` library; ``data`` is its JSON file."""

    data: bytes

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.data.decode("utf-8"))
        made.encode_special_tokens = True
        code = _byte_alphabet()
        spelled = [b""] * (max(made.get_vocab().values()) + 1)
        for token, at in made.get_vocab().items():
            known = all(c in code for c in token)
            spelled[at] = bytes(code[c] for c in token) if known else token.encode("utf-8")
        return lambda pieces: [e.ids for e in made.encode_batch_fast(pieces, add_special_tokens=False)], spelled


@dataclass(frozen=True)
class SentencePiece:
    """A sentencepiece model that adds a blank in front; ``data`` is its model file."""

    data: bytes

    def load(self):
        from sentencepiece import SentencePieceProcessor

        made = SentencePieceProcessor(model_proto=self.data)

        def spell(at: int) -> bytes:
            piece = made.id_to_piece(at)
            return bytes([int(piece[3:5], 16)]) if made.is_byte(at) else piece.replace("▁", " ").encode("utf-8")

        # a piece starts with the blank that the model adds
        return (lambda pieces: made.encode([p[1:] for p in pieces], num_threads=1),
                [spell(i) for i in range(made.get_piece_size())])


def read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def tokenizers(folder: str = TOKENIZERS) -> tuple[ByteLevel, SentencePiece]:
    """The byte-level BPE (A) and the sentencepiece model (B) of ``folder``, read on the driver."""
    return ByteLevel(read(f"{folder}/byte_bpe_50k.json")), SentencePiece(read(f"{folder}/piece_bpe_32k.model"))


def _loaded(tokenizer):
    """One instance for each task."""
    key = (type(tokenizer).__name__, hashlib.sha1(tokenizer.data).digest())
    if key not in _LOADED:
        encode, spelled = tokenizer.load()
        _LOADED[key] = encode, spelled, np.array([len(s) for s in spelled], np.int64)
    return _LOADED[key]


def _words(a, b) -> _Words:
    """One table of words for each task and pair of tokenizers."""
    key = ("words", a, b)
    if key not in _LOADED:
        _LOADED[key] = _Words(a, b)
    return _LOADED[key]


def _names(count: int) -> np.ndarray:
    """Each id as decimal digits after each of the marks, by mark and id."""
    if count not in _LOADED:
        _LOADED[count] = np.array([mark + str(i).encode() for mark in _MARKS for i in range(count)], dtype=object)
    return _LOADED[count]


def pieces_of(text: str, size: int = 0) -> list[str]:
    """``text`` with a leading blank, cut before single blanks: all of them, or so that no piece is below ``size``."""
    if not size:
        return [" " + word for word in _CUT.split(text)]
    whole, pieces, start = " " + text, [], 0
    while len(whole) - start > size:
        found = _CUT.search(whole, start + size)
        if not found:
            break
        pieces.append(whole[start:found.start()])
        start = found.start()
    return [*pieces, whole[start:]]


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of A's and of B's tokens, whose ends ascend and both reach the same last byte."""
    starts = np.concatenate([[0], a_ends[:-1], [0], b_ends[:-1]])
    ends = np.concatenate([a_ends, b_ends])
    side = np.repeat([0, 1], [len(a_ends), len(b_ends)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    groups = np.empty(len(order), np.int64)
    groups[order] = np.concatenate([[0], np.cumsum(starts[order][1:] >= reach[:-1])])
    return groups[:len(a_ends)], groups[len(a_ends):]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ``keys`` in order, and the sums of their ``times``."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


def _pair_counts(a_group, a_ids, b_group, b_ids, text_of_group, wide: int, deep: int):
    """``(text, pair)`` as one key each, ascending, and how many links of the pair the text has.

    Equal ids of a group are counted before they meet the other side, and what meets is spread
    out in bounded slices, so a group of any size costs no more than its different pairs.
    """
    a_keys, a_times = _summed(a_group * wide + a_ids, np.ones(len(a_ids), np.int64))
    b_keys, b_times = _summed(b_group * deep + b_ids, np.ones(len(b_ids), np.int64))
    a_group, a_ids, b_group, b_ids = a_keys // wide, a_keys % wide, b_keys // deep, b_keys % deep
    b_first = np.searchsorted(b_group, a_group)
    many = np.searchsorted(b_group, a_group, side="right") - b_first
    upto = np.cumsum(many)
    keys, times, at = [], [], 0
    while at < len(a_ids):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _EXPAND, side="right")))
        n = many[at:stop]
        mine = np.repeat(np.arange(at, stop), n)
        other = np.repeat(b_first[at:stop] - np.cumsum(n) + n, n) + np.arange(len(mine))
        found = _summed(text_of_group[a_group[mine]] * (wide * deep) + a_ids[mine] * deep + b_ids[other],
                        a_times[mine] * b_times[other])
        keys.append(found[0])
        times.append(found[1])
        at = stop
    if len(keys) == 1:
        return keys[0], times[0]
    return _summed(np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(times or [np.zeros(0, np.int64)]))


class _Words:
    """Different words, each with the blank before it, and their tokens on both sides."""

    def __init__(self, a, b):
        self.sides = _loaded(a), _loaded(b)
        self.begin()

    def begin(self) -> None:
        self.at, self.size = {}, 0
        self.ids, self.ends = (array("i"), array("i")), (array("q", [0]), array("q", [0]))
        self.spoiled: set[int] = set()  # words that a side does not give back

    def places(self, words: list[str]) -> np.ndarray:
        """Where each word stands in the table; new ones are encoded."""
        if self.size > WORD_CHARS:
            self.begin()
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            for w in new:
                self.at[w] = len(self.at)
            self.size += sum(map(len, new))
            whole = [w.encode("utf-8", "surrogatepass") for w in new]
            for (encode, spelled, _), ids, ends in zip(self.sides, self.ids, self.ends):
                for w, text, made in zip(new, whole, encode(new)):
                    ids.extend(made)
                    ends.append(len(ids))
                    if b"".join(map(spelled.__getitem__, made)) != text:
                        self.spoiled.add(self.at[w])
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def tokens(self, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of the words at ``places``, in a row, and how many each word has."""
        made = []
        for ids, ends in zip(self.ids, self.ends):
            ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
            first, many = ends[places], ends[places + 1] - ends[places]
            upto = np.cumsum(many)
            made.append((ids[np.repeat(first - upto + many, many) + np.arange(int(many.sum()))], many))
        return made


class _Batch:
    """Rows of one Arrow batch, aligned in bounded runs of texts."""

    def __init__(self, a, b, spelled: bool):
        self.words = _words(a, b)
        self.a, self.b = self.words.sides
        self.wide, self.deep = len(self.a[1]), len(self.b[1])
        self.named, self.spelled = _names(max(self.wide, self.deep)), spelled
        self.kind = pa.int32() if self.wide * self.deep < 1 << 31 else pa.int64()

    def run(self, texts) -> list[pa.Array]:
        rows, held, size = [], [], 0
        for text in texts:
            text = text.as_py()
            held.append(text)
            size += len(text or "")
            if size >= BATCH_CHARS:
                rows.append(self.align(held))
                held, size = [], 0
        if held:
            rows.append(self.align(held))
        if not rows:
            rows.append(self.align([]))
        return [pa.concat_arrays([r[k] for r in rows]) for k in range(len(rows[0]))]

    def encoded(self, texts: list[str | None]):
        """``(flat, numbers)`` of both sides: ids of all texts in a row, and how many each text has.

        None for a text that either side does not give back.
        """
        words, bounds = [], [0]
        for text in texts:
            words.extend(pieces_of(text) if text else ())
            bounds.append(len(words))
        places, bounds = self.words.places(words), np.array(bounds)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        if self.words.spoiled:
            keep = np.ones(len(texts), bool)
            for i in np.unique(owner[np.isin(places, list(self.words.spoiled))]).tolist():
                whole = (" " + texts[i]).encode("utf-8", "surrogatepass")
                made = self.words.tokens(places[bounds[i]:bounds[i + 1]])
                keep[i] = all(b"".join(map(side[1].__getitem__, ids.tolist())) == whole
                              for side, (ids, _) in zip((self.a, self.b), made))
            places, owner = places[keep[owner]], owner[keep[owner]]
        made = self.words.tokens(places)
        numbers = []
        for _, many in made:
            upto = np.concatenate([[0], np.cumsum(many)])
            numbers.append(np.diff(upto[np.searchsorted(owner, np.arange(len(texts) + 1))]))
        return [ids for ids, _ in made], numbers

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        count = len(texts)
        flat, numbers = self.encoded(texts)
        if len(flat[0]):
            ends = [np.cumsum(side[2][ids]) for side, ids in zip((self.a, self.b), flat)]
            a_group, b_group = coalesce(*ends)
        else:
            a_group = b_group = np.zeros(0, np.int64)
        total = int(a_group[-1]) + 1 if len(a_group) else 0
        text_of_group = np.zeros(total, np.int64)
        text_of_group[a_group] = np.repeat(np.arange(count), numbers[0])
        links = np.bincount(a_group, minlength=total) * np.bincount(b_group, minlength=total)
        n_links = np.zeros(count, np.int64)
        np.add.at(n_links, text_of_group, links)
        keys, times = _pair_counts(a_group, flat[0], b_group, flat[1], text_of_group, self.wide, self.deep)
        text, pair = np.divmod(keys, self.wide * self.deep)
        bounds = pa.array(np.searchsorted(text, np.arange(count + 1)), pa.int32())
        return [pa.array(numbers[0]), pa.array(numbers[1]), pa.array(np.bincount(text_of_group, minlength=count)),
                pa.array(n_links), pa.array(self.names(flat, (a_group, b_group), numbers), pa.string()),
                pa.ListArray.from_arrays(bounds, pa.array(pair, pa.int64()).cast(self.kind)),
                pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64()))]

    def names(self, flat, groups, numbers) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``, or their SHA-256."""
        group = np.concatenate(groups)
        side = np.repeat([0, 1], [len(flat[0]), len(flat[1])])
        order = np.argsort(2 * group + side, kind="stable")
        ids, group, side = np.concatenate(flat)[order], group[order], side[order]
        mark = np.ones(len(ids), np.int64)
        if len(ids):
            mark[1:][side[1:] != side[:-1]] = 2
            mark[1:][group[1:] != group[:-1]] = 3
        bounds = np.concatenate([[0], np.cumsum(numbers[0] + numbers[1])])
        mark[bounds[:-1][numbers[0] > 0]] = 0
        words = self.named[mark * (len(self.named) // len(_MARKS)) + ids].tolist()
        made = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            line = b"".join(words[lo:hi])
            made.append(line.decode() if self.spelled else hashlib.sha256(line).hexdigest() if line else "")
        return made


@dataclass(frozen=True)
class Alignment:
    """``rows``: the documents with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``pairs`` and ``times``.

    ``pairs`` are ids of A times ``deep`` plus ids of B, ascending; ``times`` how many links of each.
    """

    rows: DataFrame
    deep: int

    def counts(self) -> DataFrame:
        """``(pair, a, b, docs, best)`` of every linked pair of ids; ``best``: none of its A id is in more documents."""
        seen = self.rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
        seen = seen.select("pair", F.expr(f"cast(pair div {self.deep} as int)").alias("a"),
                           (F.col("pair") % self.deep).cast("int").alias("b"), "docs")
        path = scratch_path(seen.sparkSession, "pairs")
        seen.write.parquet(path)
        seen = seen.sparkSession.read.parquet(path)
        most = seen.groupBy("a").agg(F.max("docs").alias("most"))
        return seen.join(most, "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a, b, text_col: str = "text", spelled: bool = False) -> Alignment:
    """Encode and align every text once; the result is a written table. ``spelled`` keeps the groups, else their SHA-256."""
    spark = docs.sparkSession
    deep, wide = len(b.load()[1]), len(a.load()[1])
    kinds, shared = (type(a), type(b)), spark.sparkContext.broadcast((a.data, b.data))

    def aligned(columns: list[pa.Array]) -> list[pa.Array]:
        return _Batch(*(kind(data) for kind, data in zip(kinds, shared.value)), spelled).run(columns[0])

    pair = "int" if wide * deep < 1 << 31 else "bigint"
    rows = add_columns(docs, [text_col], "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                       f"pairs array<{pair}>, times array<bigint>", aligned)
    if text_col in rows.columns:
        rows = rows.drop(text_col)
    path = scratch_path(spark, "aligned")
    rows.write.parquet(path)
    return Alignment(spark.read.parquet(path), deep)


def score(alignment: Alignment, most: int = BROADCAST_PAIRS) -> DataFrame:
    """The aligned rows with ``n_best`` (links whose count is their A id's highest) and ``count_sum`` over all links."""
    counts = alignment.counts()
    spark = counts.sparkSession
    path = scratch_path(spark, "counts")
    counts.write.parquet(path)
    counts = spark.read.parquet(path)
    if counts.count() > most:
        return _score_joined(alignment, counts)
    table = counts.select("pair", "docs", "best").orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "docs", "best")))

    def looked(columns: list[pa.Array]) -> list[pa.Array]:
        pair, docs, best = shared.value
        sums = []
        bounds = columns[0].offsets.to_numpy()
        at = np.searchsorted(pair, columns[0].values.to_numpy()[bounds[0]:bounds[-1]])
        first = columns[1].offsets.to_numpy()
        times = columns[1].values.to_numpy()[first[0]:first[-1]]
        for value in (times * best[at], times * docs[at]):
            upto = np.concatenate([[0], np.cumsum(value)])
            sums.append(pa.array(np.diff(upto[bounds - bounds[0]]), pa.int64()))
        return sums

    return add_columns(alignment.rows, ["pairs", "times"], "n_best bigint, count_sum bigint", looked).drop("pairs", "times")


def _score_joined(alignment: Alignment, counts: DataFrame) -> DataFrame:
    """The same by a join: pairs that many documents hold are broadcast, the others shuffled."""
    rows = alignment.rows.withColumn("_row", F.monotonically_increasing_id())
    path = scratch_path(counts.sparkSession, "numbered")
    rows.write.parquet(path)
    rows = counts.sparkSession.read.parquet(path)
    limit = max(10_000, rows.count() // (8 * shuffle_partitions(counts.sparkSession)))
    hot = counts.where(F.col("docs") > limit).select(F.col("pair").alias("id"), F.lit(1).alias("pieces"))
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(
        "_row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    found = lookup_join(links, "pair", counts.select("pair", "docs", "best"), hot, few=hot.count() <= BROADCAST_PAIRS)
    sums = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    kept = rows.drop("pairs", "times", "n_best", "count_sum")
    return kept.join(sums, "_row", "left").fillna(0, ["n_best", "count_sum"]).drop("_row")
