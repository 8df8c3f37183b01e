"""SimHash near duplicates, line deduplication and their parts against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factorlab.llm import linededup, simhash
from factorlab.llm.components import star_components
from factorlab.llm.cuckoo import CuckooFilter
from workload.check import difference, duck

SMALL = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c.lower() if c.isascii() else c for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps):
    """{id: class} by comparing all pairs."""
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in fps}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Two Words", "a b c d", "A b\tc  d e", "é É ß x y z", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.simhash(text) & (1 << 64) - 1 == slow_fingerprint(text)


@pytest.mark.parametrize("count", [1, 1000, 10 ** 6, 10 ** 9, 10 ** 11])
def test_every_pair_in_reach_shares_a_segment(count):
    plan = simhash.plan_segments(count)
    rng = random.Random(count)
    for _ in range(3000):
        flips = rng.sample(range(64), rng.randint(0, 4))
        assert any(sum(f <= x < f + w for x in flips) <= r for f, w, r in plan)


@pytest.mark.parametrize("segments", [1, 2, 3, 4])
def test_links_equal_all_pairs(spark, segments):
    if segments == 1:
        plan = [(0, 64, 2)]
        radius = 2
    else:
        radius = 4
        plan = {2: [(0, 32, 2), (32, 32, 1)], 3: [(0, 22, 1), (22, 21, 1), (43, 21, 0)],
                4: [(0, 16, 1), (16, 16, 0), (32, 16, 0), (48, 16, 0)]}[segments]
    rng = random.Random(segments)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {tuple(r) for r in simhash.hamming_links(fps, radius, plan).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert got == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    edges += [(200, x) for x in range(201, 260)] + [(7, 7), (None, 3), (160, 100)]
    got = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got.get(start, start) == min(seen)


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = slow_classes({i: slow_fingerprint(t) for i, t in texts.items()})
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_awkward_rows(spark, awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    classes = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert classes[0] == classes[1] == 0 and classes[2] == classes[3] == classes[5] == 2
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    # the row without an id and without a text is a copy of the empty documents
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 2, 4, 6, 7]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["A text without an id, but with words in it."]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    a, b = ("one text of several plain words that tells a tale of rivers and of stones " * 2).strip(), "quite another matter " * 9
    frame = spark.createDataFrame([(2, a, "x"), (5, b, "y"), (5, a, "z"), (None, a, "w")], "doc_id bigint, text string, place string")
    assert sorted((r["doc_id"], r["text"], r["place"]) for r in simhash.keep_one(frame).collect()) == [(2, a, "x"), (5, b, "y")]
    frame = spark.createDataFrame([(9, a, 1)] + [(None, a, i) for i in range(5)] + [(None, b, 7), (None, b, 7)], "doc_id bigint, text string, fp int")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and sorted((r["doc_id"] or -1, r["text"], r["fp"]) for r in kept.collect()) == [(-1, b, 7), (9, a, 1)]


def line_result(df):
    return {r["doc_id"]: (r["kept"], r["n_lines"], r["n_dropped"]) for r in df.collect()}


def line_docs(spark, seed=1, n=40):
    rng = random.Random(seed)
    pool = [f"This is common line number {i} with enough code points" for i in range(12)] + ["short", "", "Ünïcode " * 6]
    return spark.createDataFrame([(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool).swapcase()
                                                if rng.random() < .5 else rng.choice(pool) for _ in range(rng.randint(0, 6))))
                                  for i in range(n)], "doc_id bigint, text string")


def slow_lines(rows, least=5):
    def key(line):
        k = "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))
        return k if len(k) >= 40 else None
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(doc)
    often = {k: max(v) for k, v in holders.items() if len(v) >= least}
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if often.get(key(x), doc) == doc]
        out[doc] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


@pytest.mark.parametrize("filter_bytes", [linededup.FILTER_BYTES, 0])
def test_lines_equal_brute_force_with_and_without_filters(spark, filter_bytes):
    docs = line_docs(spark)
    state = linededup.insert(linededup.State(shards=3), docs)
    got = line_result(linededup.dedup(docs, state, filter_bytes))
    assert got == slow_lines([tuple(r) for r in docs.collect()])
    assert any(v[2] for v in got.values())


def test_insertions_in_parts_and_deletions_are_exact(spark):
    docs = line_docs(spark, 2, 60)
    state = linededup.State(shards=3)
    for part in range(3):
        state = linededup.insert(state, docs.where(F.col("doc_id") % 3 == part))
    rows = [tuple(r) for r in docs.collect()]
    assert line_result(linededup.dedup(docs, state)) == slow_lines(rows)
    state = linededup.delete(state, docs.where("doc_id >= 12").select("doc_id"))
    left = docs.where("doc_id < 12")
    assert line_result(linededup.dedup(left, state)) == slow_lines([r for r in rows if r[0] < 12])
    state = linededup.insert(state, docs.where("doc_id >= 12"))
    assert line_result(linededup.dedup(docs, state)) == slow_lines(rows)


def test_shards_of_filters_grow_with_their_keys(spark, monkeypatch):
    docs = line_docs(spark, 3, 60)
    rows = [tuple(r) for r in docs.collect()]
    monkeypatch.setattr(linededup, "SHARD_KEYS", 2)
    first = linededup.insert(linededup.State(shards=1), docs.where("doc_id < 12"))
    state = linededup.insert(first, docs.where("doc_id >= 12"))
    assert state.shards > first.shards >= 1
    filters = spark.read.parquet(state.filters)
    often = spark.read.parquet(state.counts).where(f"n >= {state.least}")
    assert sorted(k for r in filters.collect() for k in r["keys"]) == sorted(r["key"] for r in often.collect())
    assert line_result(linededup.dedup(docs, state)) == slow_lines(rows)
    state = linededup.delete(state, docs.where("doc_id >= 12").select("doc_id"))
    assert line_result(linededup.dedup(docs.where("doc_id < 12"), state)) == slow_lines([r for r in rows if r[0] < 12])


def test_awkward_lines(spark, awkward, nothing):
    state = linededup.insert(linededup.State(), awkward)
    out = linededup.dedup(awkward, state)
    assert out.count() == awkward.count() and {"n_lines", "n_dropped", "kept"} <= set(out.columns)
    assert [r["n_lines"] for r in out.where("doc_id in (2, 3)").collect()] == [1, 1]
    assert out.where("doc_id = 5").first()["n_lines"] == 3
    state = linededup.insert(linededup.State(), nothing)
    assert linededup.dedup(nothing, state).count() == 0


def test_line_query_equals_sql(spark):
    from factorlab.llm.queries import ORACLE, QUERIES
    got = QUERIES["op5_line_dedup"](spark, SMALL).toPandas()
    assert difference(got, duck(SMALL).execute(ORACLE["op5_line_dedup"]).df()) is None


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, (4000, 2), dtype=np.uint64)
    held = CuckooFilter.build(keys[:2000, 0], keys[:2000, 1])
    assert held.contains(keys[:2000, 0], keys[:2000, 1]).all() and held.count == 2000
    assert held.contains(keys[2000:, 0], keys[2000:, 1]).sum() < 20
    assert all(held.delete(h, x) for h, x in keys[:1000])
    again = CuckooFilter.load(held.dump())
    assert again.contains(keys[1000:2000, 0], keys[1000:2000, 1]).all() and again.count == 1000
    assert again.contains(keys[:1000, 0], keys[:1000, 1]).sum() < 20
    assert not CuckooFilter(1).contains(keys[:5, 0], keys[:5, 1]).any()
