"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as one blank; runs of 1 to 3 of these codes
are hashed into ``BUCKETS``. Counts by language are summed in Spark over a bounded sample of
labelled documents (``PER_LANGUAGE`` of each, chosen by a hash of the id) and become one matrix
of log-probabilities, of a size that the number of languages sets. It is broadcast, and texts
of any length are scored with it piece by piece in numpy.

Null texts and texts without a letter are ``und`` with score 0; so is everything if nothing
was learned. Rows without a language are not learned from; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import add_columns, values

#: How many labelled documents of a language are learned from, about: those with the least hashes.
PER_LANGUAGE = 4000
BUCKETS = 1 << 16
ORDERS = 3
UNKNOWN = "und"
_PIECE = 1 << 18
_SMOOTHING = 0.5
_MIX = np.uint32(0x9E3779B1)
_PARTS = 1_000_000


def _codes_table() -> np.ndarray:
    """Codes below 0x3000: lower-case letters as they are, 0 for what is no letter."""
    lower = [chr(c).lower() if chr(c).isalpha() else "\0" for c in range(0x3000)]
    return np.array([ord(x) if len(x) == 1 else ord(x[0]) for x in lower], dtype=np.uint32)


def _grams(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams with a letter, for pieces of the text; no n-gram is lost between them."""
    for start in range(0, len(text), _PIECE):
        raw = np.frombuffer(text[start:start + _PIECE + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(raw < len(table), table[np.minimum(raw, len(table) - 1)], raw)
        more = start + _PIECE < len(text)
        codes = codes if more else np.concatenate([codes, np.zeros(ORDERS - 1, np.uint32)])
        codes = codes if start else np.concatenate([np.zeros(ORDERS - 1, np.uint32), codes])
        n = len(codes) - ORDERS + 1
        hashed, lettered, out = np.zeros(n, np.uint32), np.zeros(n, bool), []
        for order in range(ORDERS):
            part = codes[order:order + n]
            hashed = (hashed ^ part) * _MIX + np.uint32(order)
            lettered = lettered | (part != 0)
            out.append((hashed ^ (hashed >> np.uint32(15)))[lettered] % np.uint32(BUCKETS))
        yield np.concatenate(out)


def held_out(id_col: str = "doc_id"):
    """Rows whose language is never learned: CRC-32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Languages, their log-priors, and log-probabilities by bucket and language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(rows)
    if not langs:
        return {"langs": [], "prior": np.zeros(0), "logp": np.zeros((BUCKETS, 0), np.float32)}
    parts = F.create_map(*[F.lit(x) for lang in langs
                           for x in (lang, min(_PARTS, -(-_PARTS * per_language // rows[lang])))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(_PARTS)) < parts[F.col("lang")])

    def count(batches):
        table, sums = _codes_table(), {}
        for batch in batches:
            for lang, text in zip(values(batch.column(0)), values(batch.column(1))):
                into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for grams in _grams(text, table):
                    into += np.bincount(grams, minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
                                             names=["lang", "bucket", "n"])

    counts = (sample.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
              .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")))
    seen = np.zeros((BUCKETS, len(langs)))
    for r in counts.toLocalIterator():  # one row for a language, of at most BUCKETS cells
        cells = np.array([(c["bucket"], c["n"]) for c in r["cells"]], dtype=np.int64)
        seen[cells[:, 0], langs.index(r["lang"])] = cells[:, 1]
    logp = np.log(seen + _SMOOTHING) - np.log(seen.sum(axis=0) + _SMOOTHING * BUCKETS)
    shares = np.array([rows[x] for x in langs], float)
    return {"langs": langs, "prior": np.log(shares / shares.sum()), "logp": logp.astype(np.float32)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and its probability, ``score``.

    N-grams of several orders tell the same thing as often as there are orders, so their sum is
    divided by that number before it is turned into a probability.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(columns):
        m, table, langs, scores = shared.value, _codes_table(), [], []
        for text in values(columns[0]):
            if not text or not m["langs"] or not any(map(str.isalpha, text)):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = m["prior"].copy()
            for grams in _grams(text, table):
                total += m["logp"][grams].sum(axis=0, dtype=np.float64) / ORDERS
            odds = np.exp(total - total.max())
            langs.append(m["langs"][int(odds.argmax())])
            scores.append(float(odds.max() / odds.sum()))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(docs, ["text"], "lang_pred string, score double", judged)
