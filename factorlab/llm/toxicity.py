"""Toxicity by the nearest labelled examples in TF-IDF space.

The space has every word of the examples. Some terms (words and their beginnings of 4 to 6
bytes) are telling: the labels of a bounded sample of documents depend on them (log-likelihood
ratio). They only weigh more: if a text has telling and other terms, the telling ones make
``TELLING`` of its squared length, so no word is left out and copies have a cosine of one.
Copies would make any of their words look telling, so in choosing terms a document counts in
inverse proportion to how many share one of its min-hash keys. Document frequencies come from
all documents.

The k nearest examples are found in a block-max inverted index. Examples that are alike stand
side by side, in blocks of ``BLOCK``; for every term and block that has it the index keeps the
term's largest weight there. The sum of these maxima, weighed like the text, bounds every
cosine of a block. The blocks of the highest bounds are compared first, and then only those
whose bounds reach the k-th cosine so far, so the k found are exact. Terms that many examples
have are kept as whole rows, not as postings. The examples travel as
compressed counts, and every task makes its own index of them. A neighbour's vote grows with
its cosine without much of a bound, so that a copy outweighs all others, and a monotone curve,
fitted to votes on the sample with each example left out, turns votes into a rate of label 1.

Texts that share no term with any example, empty and null ones too, all have the same vote:
what is known of such examples. Without labels every score is 0. Rows are scored one by one, so
repeated ones score alike. The index holds at most ``EXAMPLES`` examples, with all their words,
and is all that is broadcast; everything else is counted over all rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import add_columns, byte_table, values
from factorlab.session import cut

#: How many labelled rows are learned from, at most: those with the smallest hashes of their ids.
EXAMPLES = 3_000
#: The chance that any term passes of which labels are independent.
CHANCE = 0.05
#: What telling terms make of the squared length of a text that has others too.
TELLING = 0.9
NEIGHBOURS = 10
#: Examples of a block, and how many blocks are compared before any is left out.
BLOCK = 64
FIRST_BLOCKS = 4
#: Terms that at least one in this many examples has, the commonest at most, are kept as whole rows, and multiplied with
#: the vectors of so many texts at once.
DENSE_SHARE, DENSE_TERMS = 8, 256
TOGETHER = 64
#: What bounds and cosines may differ by from rounding.
_SLACK = 1e-9
#: The commonest terms, by which examples are put side by side.
_COMMON = 256
THRESHOLD = 0.7
_PRIOR = 0.1
#: A copy votes with one over this.
_NEARLY = 0.01
_STEPS = 100
_KEYS = 4
_PREFIXES = (4, 5, 6)
_LETTERS = byte_table(bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)))
_MARKS = re.compile("[ -¿ -⁯　-〿]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8: runs of letters, and of any other signs beyond ASCII."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def terms_of(word: bytes) -> list[bytes]:
    return [word] + [word[:n] + b"*" for n in _PREFIXES if len(word) > n]


def held_out(id_col: str = "doc_id"):
    """Rows whose label is never learned: CRC-32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    terms: dict[bytes, int] = field(default_factory=dict)
    gate: set[bytes] = field(default_factory=set)
    spelled: bytes = b""
    words: dict[bytes, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # cells of a term
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of a cell
    top: np.ndarray = field(default_factory=lambda: np.zeros(0))  # largest weight in a cell
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings of a cell
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    posted: np.ndarray = field(default_factory=lambda: np.zeros(0))
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of a term's whole row, or -1
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.linspace(0, 1, _STEPS + 1))

    def state(self) -> bytes:
        """What cannot be made again: terms, counts and what was learned of them."""
        names = ("terms", "gate", "spelled", "idf", "ids", "toxic", "ends", "times", "prior", "curve")
        return zlib.compress(pickle.dumps({n: getattr(self, n) for n in names} | {"at": np.diff(self.at, prepend=np.int32(0))}), 1)

    @staticmethod
    def of(state: bytes) -> Model:
        self = Model(**pickle.loads(zlib.decompress(state)))
        self.at = np.cumsum(self.at, dtype=np.int32)
        self.words = {w: len(self.terms) + i for i, w in enumerate(self.spelled.split())}
        if len(self.at):
            owner = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
            w = (1 + np.log(self.times)) * self.idf[self.at]
            telling = self.at < len(self.terms)
            squares = [np.bincount(owner, w * w * mask, len(self.ids)) for mask in (telling, ~telling)]
            both = (squares[0] > 0) & (squares[1] > 0)
            for mask, square, share in zip((telling, ~telling), squares, (TELLING, 1 - TELLING)):
                scale = np.sqrt(np.where(both, share, 1.0) / np.where(square > 0, square, 1.0))
                w[mask] *= scale[owner[mask]]
            self._post(owner, w)
        return self

    def counts(self, text: str | None) -> dict[int, int]:
        """Occurrences of the model's terms, telling (``terms``) or not (``words``), in the whole text."""
        found: dict[int, int] = {}
        gate, terms, words = self.gate, self.terms, self.words
        for word, n in Counter(words_of(text)).items():
            at = words.get(word)
            if at is not None:
                found[at] = n
            if word[:4] in gate:
                for term in terms_of(word):
                    at = terms.get(term)
                    if at is not None:
                        found[at] = found.get(at, 0) + n
        return found

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights, of length one: (1 + log tf) idf, telling terms weighed up to ``TELLING``."""
        at = np.fromiter(counts, np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))
        order = np.argsort(at)
        at = at[order]
        w = (1 + np.log(n[order])) * self.idf[at]
        split = int(np.searchsorted(at, len(self.terms)))
        both = 0 < split < len(at)
        for part, share in ((w[:split], TELLING), (w[split:], 1 - TELLING)):
            if len(part):
                part *= np.sqrt((share if both else 1.0) / np.sum(part * part))
        return at, w

    def index(self, ids: np.ndarray, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The block-max index of examples ``(terms, weights)``, which should stand beside their like."""
        self.ids, self.toxic = ids, toxic
        lengths = np.array([len(v[0]) for v in vectors], np.int64)
        self.at = np.concatenate([v[0] for v in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32)
        weights = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        self._post(np.repeat(np.arange(len(ids)), lengths), weights)

    def _post(self, owner: np.ndarray, weights: np.ndarray) -> None:
        """Postings by term and example; a cell is the postings of a term in a block. Common terms are whole rows instead."""
        order = np.argsort(self.at, kind="stable")
        term, owners, posted = self.at[order], owner[order].astype(np.int64), weights[order]
        block = owners // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block = block[new]
        self.top = np.maximum.reduceat(posted, new) if len(new) else np.zeros(0)
        self.starts = np.searchsorted(term[new], np.arange(len(self.idf) + 1))
        often = np.bincount(term, minlength=len(self.idf))
        common = np.argsort(-often, kind="stable")[:DENSE_TERMS]
        common = common[often[common] * DENSE_SHARE >= max(len(self.ids), 1)]
        self.row = np.full(len(self.idf), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(self.ids)))
        whole = self.row[term] >= 0
        self.dense[self.row[term[whole]], owners[whole]] = posted[whole]
        self.owners, self.posted = owners[~whole], posted[~whole]
        sizes = np.diff(np.append(new, len(term))) * (self.row[term[new]] < 0)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _cosines(self, cells: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """What the postings in ``cells`` add to the cosine of every example."""
        first = self.first[cells]
        many = self.first[cells + 1] - first
        places = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.bincount(self.owners[places], np.repeat(asked, many) * self.posted[places], len(self.ids))

    def nearest(self, at: np.ndarray, w: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The exact ``NEIGHBOURS`` examples of highest cosine (ties: the least id), and the cosines."""
        return next(self.all_nearest([(at, w)], [leave]))

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], leave: list[int] | None = None):
        """:meth:`nearest` of each of ``vectors``, in their order."""
        for start in range(0, len(vectors), TOGETHER):
            some = vectors[start:start + TOGETHER]
            asked = np.zeros((len(some), len(self.dense)))
            for line, (at, w) in zip(asked, some):
                row = self.row[at] if len(self.ids) else np.zeros(0, np.int64)
                line[row[row >= 0]] = w[row >= 0] if len(row) else 0
            common = asked @ self.dense
            for i, (at, w) in enumerate(some):
                yield self._nearest(at, w, common[i], leave[start + i] if leave else -1)

    def _nearest(self, at, w, common, leave):
        if not len(at) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        first = self.starts[at]
        many = self.starts[at + 1] - first
        cells = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        asked, block = np.repeat(w, many), self.block[cells]
        count = -(-len(self.ids) // BLOCK)
        bound = np.bincount(block, asked * self.top[cells], count)
        found = np.zeros(len(self.ids))

        def compare(blocks):
            near = blocks[block]
            found[:] += self._cosines(cells[near], asked[near]) + common * np.repeat(blocks, BLOCK)[:len(found)]
            if leave >= 0:
                found[leave] = 0
        soon = np.zeros(count, bool)
        soon[np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if count > FIRST_BLOCKS else slice(None)] = True
        compare(soon)
        k = min(NEIGHBOURS, len(found))
        late = ~soon & (bound > 0) & (bound >= np.partition(found, -k)[-k] - _SLACK)
        if late.any():
            compare(late)
        hit = np.flatnonzero((found > 0) & (found >= np.partition(found, -k)[-k] - 2 * _SLACK))
        keep = np.lexsort((self.ids[hit], -np.round(found[hit], 9)))[:NEIGHBOURS]
        return hit[keep], found[hit[keep]]

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        strength = cosines / (1 - np.minimum(cosines, 1) + _NEARLY)
        return float((strength @ self.toxic[best] + _PRIOR * self.prior) / (strength.sum() + _PRIOR))

    def calibrated(self, vote: float) -> float:
        return float(self.curve[int(round(vote * _STEPS))])


def _different(column: pa.Array):
    """The different texts of a batch one at a time, null last, and which of them each row has: copies are common."""
    coded = column.dictionary_encode()
    none = len(coded.dictionary)
    return chain(values(coded.dictionary), [None]), coded.indices.fill_null(none).to_numpy().tolist()


def labelled(labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """At most ``examples`` of the labels that may be learned, as ``(doc_id, toxic)``."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    return (rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))


def _sketches(batches):
    """Min-hash keys of each text's runs of three words; near copies share most of them."""
    factors = np.random.default_rng(1).integers(1, 1 << 63, _KEYS, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        keys = []
        for text in values(batch.column(1)):
            h = pd.util.hash_array(np.array(words_of(text) or [b""], dtype=object))
            runs = h if len(h) < 3 else (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]
            keys.append([int((runs * f).min()) >> 1 for f in factors])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "keys"])


def _term_counts(batches):
    """What each task's examples add to the counts of their terms, by label."""
    tally: dict[bytes, list[float]] = {}
    for batch in batches:
        for text, toxic, weight in zip(values(batch.column(0)), values(batch.column(1)), values(batch.column(2))):
            for term in {t for word in set(words_of(text)) for t in terms_of(word)}:
                tally.setdefault(term, [0.0, 0.0])[toxic] += weight
    for start in range(0, len(tally), 10_000):
        part = list(tally)[start:start + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.binary()), pa.array([tally[t][0] for t in part]), pa.array([tally[t][1] for t in part])],
            names=["term", "clean", "toxic"])


def _vocabulary(batches):
    """Each task's different words."""
    words = {w for batch in batches for text in values(batch.column(0)) for w in words_of(text)}
    rest = list(words)
    for start in range(0, len(rest), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(rest[start:start + 50_000], pa.binary())], names=["word"])


def least_ratio(tests: int) -> float:
    """The log-likelihood ratio that one of ``tests`` independent terms passes with ``CHANCE``.

    A tail expansion of the chi-square distribution with one degree of freedom.
    """
    x = 2 * np.log(max(tests, 1) / CHANCE)
    return float(x - np.log(x) - np.log(np.pi / 2))


def telling_terms(sample: DataFrame) -> list[bytes]:
    """The terms of ``sample(doc_id, text, toxic)`` on which label 1 depends most, copies counted as one."""
    sketches = sample.select("doc_id", "text").mapInArrow(_sketches, "doc_id bigint, keys array<bigint>")
    keys = cut(sketches.select("doc_id", F.posexplode("keys").alias("nth", "key")))
    shared = keys.groupBy("nth", "key").agg(F.count("*").alias("n"))
    weights = (keys.join(shared, ["nth", "key"]).groupBy("doc_id").agg((1 / F.max("n")).alias("weight")))
    weighed = cut(sample.join(weights, "doc_id").select("doc_id", "text", "toxic", "weight"))
    total = weighed.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()
    whole = {r["toxic"]: r["w"] for r in total}
    n0, n1 = whole.get(0, 0.0), whole.get(1, 0.0)
    if not n1:
        return []
    counts = cut(weighed.select("text", "toxic", "weight")
                 .mapInArrow(_term_counts, "term binary, clean double, toxic double")
                 .groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where("t >= 2"))
    rate = n1 / (n0 + n1)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n = F.col("c") + F.col("t")
    ratio = 2 * (part(F.col("t"), n * rate) + part(F.col("c"), n * (1 - rate)))
    chosen = (counts.where(F.col("t") > n * rate).withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio(counts.count()))
              .select("term").collect())
    return sorted(bytes(r["term"]) for r in chosen)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Learn from the labels that are not held out; corpus counts come from all of ``docs``."""
    spark = docs.sparkSession
    named = labelled(labels, examples)
    sample = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
                 .join(F.broadcast(named), "doc_id").dropDuplicates(["doc_id"]))
    model = Model()
    model.terms = {t: i for i, t in enumerate(telling_terms(sample))}
    model.gate = {t[:4] for t in model.terms}
    seen = sample.select("text").mapInArrow(_vocabulary, "word binary").distinct().toArrow().column("word")
    spelled = sorted(w for w in values(seen) if w not in model.terms)
    size = len(model.terms) + len(spelled)
    model.spelled = b" ".join(spelled)
    del seen, spelled
    bare = spark.sparkContext.broadcast(model.state())

    def frequencies(batches):
        seen, total, bare_model = np.zeros(size + 1, np.int64), 0, Model.of(bare.value)
        for batch in batches:
            texts, which = _different(batch.column(0))
            for text, times in zip(texts, np.bincount(which).tolist()):
                counts = bare_model.counts(text)
                seen[np.fromiter(counts, np.int64, len(counts))] += times
                total += times
        seen[size] = total
        some = np.nonzero(seen)[0]
        for start in range(0, len(some), 50_000):
            part = some[start:start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seen[part], pa.int64())], names=["term", "n"])

    found = (docs.select("text").mapInArrow(frequencies, "term bigint, n bigint")
             .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    df = np.zeros(size + 1)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    model.idf = np.log((1 + df[size]) / (1 + df[:size])) + 1

    def vectors(batches):
        bare_model = Model.of(bare.value)
        for batch in batches:
            counts = [dict(sorted(bare_model.counts(t).items())) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([np.fromiter(c, np.int32, len(c)).tobytes() for c in counts], pa.binary()),
                 pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in counts], pa.binary())],
                names=["doc_id", "toxic", "at", "n"])

    held = cut(sample.select("doc_id", "text", F.col("toxic").cast("bigint").alias("toxic"))
               .mapInArrow(vectors, "doc_id bigint, toxic bigint, at binary, n binary"))
    bland = held.where(F.length("at") == 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    model.prior = bland["t"] / bland["n"] if bland["n"] else 0.0
    bare.destroy()
    rows = held.where(F.length("at") > 0).toArrow().sort_by("doc_id")
    rows = rows.take(pa.array(_side_by_side([np.frombuffer(x, np.int32) for x in values(rows.column("at"))], model.idf)))
    model.ids, model.toxic = rows.column("doc_id").to_numpy().astype(np.int64), rows.column("toxic").to_numpy().astype(float)
    model.at, model.times = (np.frombuffer(b"".join(values(rows.column(c))), np.int32) for c in ("at", "n"))
    model.ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in values(rows.column("at"))])]).astype(np.int64)
    del rows
    _calibrate(model, held, bland)
    return model


def _side_by_side(terms: list[np.ndarray], idf: np.ndarray, rounds: int = 5) -> np.ndarray:
    """An order of the (bounded) examples in which alike ones are near: spherical k-means over their commonest terms."""
    count = len(terms)
    if count <= BLOCK:
        return np.arange(count)
    at, owner = np.concatenate(terms), np.repeat(np.arange(count), [len(t) for t in terms])
    column = np.full(len(idf), -1)
    column[np.argsort(-np.bincount(at, minlength=len(idf)), kind="stable")[:_COMMON]] = np.arange(min(_COMMON, len(idf)))
    place = column[at]
    x = np.zeros((count, _COMMON), np.float32)
    x[owner[place >= 0], place[place >= 0]] = idf[at[place >= 0]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[np.linspace(0, count - 1, -(-count // BLOCK)).astype(int)]
    for _ in range(rounds):
        group = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return np.argsort(group, kind="stable")


def _unpacked(at: bytes, n: bytes) -> dict[int, int]:
    return dict(zip(np.frombuffer(at, np.int32).tolist(), np.frombuffer(n, np.int32).tolist()))


def _calibrate(model: Model, held: DataFrame, bland) -> None:
    """A monotone curve from votes to the rate of label 1, each example judged by the others."""
    shared = held.sparkSession.sparkContext.broadcast(model.state())

    def votes(batches):
        m = Model.of(shared.value)
        place = {int(i): at for at, i in enumerate(m.ids)}
        for batch in batches:
            asked = [m.vector(_unpacked(at, n)) for at, n in zip(values(batch.column(2)), values(batch.column(3)))]
            leave = [place[i] for i in values(batch.column(0))]
            out = [int(round(m.vote(*near) * _STEPS)) for near in m.all_nearest(asked, leave)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), batch.column(1)], names=["step", "toxic"])

    steps = (held.where(F.length("at") > 0).repartition(held.sparkSession.sparkContext.defaultParallelism)
             .mapInArrow(votes, "step bigint, toxic bigint").groupBy("step")
             .agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect())
    shared.destroy()
    n, t = np.zeros(_STEPS + 1), np.zeros(_STEPS + 1)
    for r in steps:
        n[r["step"]], t[r["step"]] = r["n"], r["t"]
    if bland["n"]:
        n[int(round(model.prior * _STEPS))] += bland["n"]
        t[int(round(model.prior * _STEPS))] += bland["t"]
    pools: list[list[float]] = []  # rate, weight, steps
    for i in range(_STEPS + 1):
        # where no example voted, the vote itself counts as one
        pools.append([(t[i] + i / _STEPS) / (n[i] + 1), n[i] + 1, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            rate, weight, count = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + rate * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += count
    model.curve = np.concatenate([np.full(int(c), r) for r, _, c in pools]).clip(0, 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``evidence`` (ids of the examples that voted, nearest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    made: list[Model] = []  # one for each task

    def judged(columns):
        if not made:
            made.append(Model.of(shared.value))
        m, judged_, held = made[0], [], []

        def flush():
            for best, cosines in m.all_nearest(held):
                judged_.append((m.calibrated(m.vote(best, cosines)), m.ids[best].tolist()))
            held.clear()
        texts, which = _different(columns[0])
        for text in texts:
            held.append(m.vector(m.counts(text)))
            if len(held) == TOGETHER:
                flush()
        flush()
        scores, proof = [judged_[i][0] for i in which], [judged_[i][1] for i in which]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                pa.array(proof, pa.list_(pa.int64()))]

    return add_columns(docs, ["text"], "score double, predicted int, evidence array<bigint>", judged)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with their columns as they were."""
    packed = docs.select("text", F.struct("*").alias("row"))
    return score(packed, fit(docs, labels)).where("predicted = 0").select("row.*")
