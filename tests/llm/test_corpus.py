"""Sharding, mixing, decontamination and the pipeline."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorlab.llm import decontaminate, mixing, sharding
from factorlab.llm.queries import ORACLE, QUERIES
from tests.llm.test_dedup import slow_classes, slow_fingerprint
from workload.check import difference, duck

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_decontamination", "op7_mixing"])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, duck(SMALL).execute(ORACLE[name]).df()) is None


def test_shards_hold_every_row_once(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op1_sharding"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    places = {}
    for r in rows:
        places.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(v) for v in places.values()]
    assert set(places) == set(range(24)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_shards_depend_on_rows_and_seed_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")

    def places(frame, seed=sharding.SEED, **options):
        return {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(frame, 5, seed, **options).collect()}
    first = places(docs, bucket_bytes=20_000)
    assert first == places(docs.repartition(7).orderBy("text"), bucket_bytes=20_000)
    assert first != places(docs, 18, bucket_bytes=20_000)
    order = [i for i, _ in sorted(first.items(), key=lambda x: x[1])]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 15  # neighbours are not left together


def test_shards_are_the_same_from_any_partitions(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text")
    monkeypatch.setattr(sharding, "TASKS", 3)

    def places(frame):
        rows = sharding.shard(frame, 5, bucket_bytes=128).collect()
        return {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    seen, width = places(docs.repartition(7)), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        assert seen == places(docs.orderBy(F.desc("doc_id")).repartition(2, "text"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert sorted(seen.values()) == [(s, n) for s in range(5) for n in range(80)]


def test_written_shards(spark, awkward, tmp_path):
    sharding.write_shards(awkward.drop("shard", "slot"), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 3 and back.count() == awkward.count()


def test_copies_spread_over_buckets(spark):
    """A third of the rows is one row, another sixth one text without an id in rows that differ elsewhere."""
    docs = spark.range(600).selectExpr(
        "case when id < 300 then null else id end as doc_id", "case when id < 300 then 'the same text' else 'text ' || id end as text",
        "case when id < 200 then 0 else id end as other", "map('k', case when id < 200 then 0 else id end) as m")

    def ordered(frame):
        rows = sharding.shard(frame, 5, bucket_bytes=400).collect()
        return [(r["row"]["doc_id"], r["row"]["other"], r["row"]["m"]["k"]) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    first = ordered(docs)
    assert first == ordered(docs.repartition(7).orderBy("text"))
    assert Counter(first) == Counter((r["doc_id"], r["other"], r["m"]["k"]) for r in docs.collect())
    # a bucket holds about 20 rows; in one bucket the 300 would stand together
    longest = max(len(list(run)) for _, run in itertools.groupby(first, key=lambda x: x[0] is None))
    assert longest < 60


def test_awkward_shards(awkward, nothing):
    rows = sharding.shard(awkward, 4).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2, 3, 3, 3]
    assert rows[0]["row"].asDict().keys() == set(awkward.columns)
    assert sharding.shard(nothing, 4).count() == 0


def slow_targets(sizes):
    """Targets by dealing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-6 and open_:
        share, left = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}, 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    sources = {"a": 300, "b": 5, None: 40, "é": 80, "z": 1, "B": 120}
    docs = [(s, "w " * rng.choice([1, 3, 8, 40])) for s, n in sources.items() for _ in range(n)]
    rows = [(i, t, s) for i, (s, t) in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(frame, carry=["doc_id", "source"]).collect()
    again = mixing.mix(frame.repartition(5), carry=["doc_id", "source"]).collect()
    assert sorted(out) == sorted(again) and len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target, taken = slow_targets(sizes), Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["row"]["source"]]) and r["source_size"] == sizes[r["row"]["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["row"]["source"]] += r["size"] * r["copies"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in sizes)
    assert mixing.mixed(frame).count() == sum(r["copies"] for r in out)


def test_inclusion_is_fair(spark):
    frame = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text",
                                         "case when id < 1000 then 'a' else 'b' end as source")
    out = mixing.mix(frame, weights=(1,), share=0.5, carry=["doc_id", "source"])
    for r in out.groupBy("row.source", (F.col("row.doc_id") % 5).alias("d")).agg(F.avg("copies").alias("x")).collect():
        assert r["x"] == pytest.approx({"a": 1.0, "b": 1 / 3}[r["source"]], abs=0.09)


def test_awkward_mix(awkward, nothing):
    out = mixing.mix(awkward).collect()
    assert len(out) == awkward.count() and all(0 <= r["copies"] <= 2 for r in out)
    assert mixing.mixed(awkward).columns == awkward.columns
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def slow_hits(words, items):
    """Hit positions and item ids by comparing every place with every window."""
    hit, ids = set(), set()
    for item, other in items:
        n = min(13, len(other))
        for q in range(len(other) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p:p + n] == other[q:q + n]:
                    hit |= set(range(p, p + n))
                    ids.add(item)
    return hit, ids


def test_hits_equal_brute_force_over_few_words(spark, monkeypatch):
    """Three words only: windows repeat and overlap in every way; items come in several blocks and pieces."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 9)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    rng = random.Random(8)

    def some(n):
        return [rng.choice("AAb") + rng.choice(["", "", "é"]) for _ in range(n)]
    items = [(i, some(rng.choice([1, 4, 12, 13, 14, 30]))) for i in range(1, 14)]
    docs = []
    for i in range(60):
        words = some(rng.randint(0, 25))
        if rng.random() < .6:
            words += rng.choice(items)[1][:rng.randint(1, 30)] + some(3)
        docs.append((i, words))
    items = [(i, w if i % 3 else w + ["unheard"] * 4) for i, w in items if len(w) > 3]
    frame = spark.createDataFrame([(i, " .,-".join(w)) for i, w in docs], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, "\n".join(w)) for i, w in items], "item_id bigint, text string")
    want = {i: slow_hits([w.lower() for w in ws], [(k, [w.lower() for w in o]) for k, o in items]) for i, ws in docs}
    got = {r["doc_id"]: r for r in decontaminate.flag(frame, bench).collect()}
    for i, ws in docs:
        spans = {x for s in got[i]["spans"] for x in range(s["start"], s["start"] + s["n"])}
        assert spans == want[i][0] and got[i]["n_hit"] == len(spans) and got[i]["n_words"] == len(ws)
        assert got[i]["items"] == sorted(map(str, want[i][1]))
        assert got[i]["contaminated"] == (0 < len(ws) <= 20 * len(spans))
    assert any(w[0] for w in want.values())


def test_awkward_contamination(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "again"), (None, "same text"), (2, None), (3, ""), (1, "again")], "item_id bigint, text string")
    out = decontaminate.flag(awkward, bench)
    assert out.where("doc_id = 0").first()["n_hit"] == 3 and out.where("doc_id = 0").first()["items"] == ["1"]
    assert out.where("n_words = 0").where("contaminated").count() == 0
    assert decontaminate.clean(awkward, bench).columns == awkward.columns
    assert decontaminate.flag(awkward, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.flag(nothing, bench).count() == 0
    items = hashlib.sha256(b"").hexdigest()
    assert QUERIES["op2_decontamination"](spark, SMALL).where("n_items = 0").first()["items_sha256"] == items


@pytest.mark.parametrize("sizes", [(4,), (4, 7, 0)])
def test_tied_rows_are_counted_out(spark, sizes):
    """Two of five rows have no id, some share one: all of these draw one u."""
    rows = [(None if i % 5 < 2 else 7 if i % 25 == 3 else i, " ".join(["w"] * sizes[i % len(sizes)]), "a") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    total = sum(len(r[1].split()) for r in rows)
    for seed in range(6):
        out = mixing.mix(frame, weights=(1,), share=0.5, seed=f"s{seed}", carry=["doc_id"]).collect()
        assert len(out) == 1000 and all(r["copies"] in (0, 1) for r in out)
        assert abs(sum(r["size"] * r["copies"] for r in out) - total / 2) <= max(sizes) / 2


def plain_contaminated(text, items):
    """The contract's rule, window by window."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    hit = set()
    for n, windows in items.items():
        for p in range(len(words) - n + 1):
            if " ".join(words[p:p + n]) in windows:
                hit |= set(range(p, p + n))
    return 0 < len(words) <= 20 * len(hit)


UPPER = {c: c + 32 for c in range(65, 91)}


def test_every_stage_equals_a_plain_version_on_its_own_input(spark, tmp_path, monkeypatch):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("rank", F.lit("kept")).withColumn("row", F.col("doc_id") * 2)
    docs, seen = base, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == base.columns + (["shard", "slot"] if name == "sharding" else [])
        seen[name] = ({r["doc_id"]: r for r in docs.collect()}, out.collect())
        docs = out
    for before, after in seen.values():
        assert all(tuple(r)[:len(base.columns)] == tuple(before[r["doc_id"]])[:len(base.columns)] for r in after)

    before, after = seen["toxicity"]
    judged = {r["doc_id"]: r["predicted"] for r in QUERIES["op9_toxicity"](spark, SMALL).collect()}
    assert {r["doc_id"] for r in after} == {i for i in before if not judged[i]}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(toxic[i] for i in before.keys() - {r["doc_id"] for r in after} if i in toxic)

    before, after = seen["near_copies"]
    classes = slow_classes({i: slow_fingerprint(r["text"]) for i, r in before.items()})
    assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))

    before, after = seen["contamination"]
    items = {}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(UPPER))
        n = min(13, len(words))
        for p in range(len(words) - n + 1) if n else ():
            items.setdefault(n, set()).add(" ".join(words[p:p + n]))
    assert {r["doc_id"] for r in after} == {i for i, r in before.items() if not plain_contaminated(r["text"], items)}

    before, after = seen["mixing"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/contamination/*.parquet'")
    times = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLE['op7_mixing']}) WHERE size > 0").fetchall()}
    counts = Counter(r["doc_id"] for r in after)
    assert {i: counts.get(i, 0) for i in times} == times and set(counts) <= set(before)

    _, after = seen["sharding"]
    assert Counter(r["doc_id"] for r in after) == counts
    shards = Counter(r["shard"] for r in after)
    assert set(shards) <= set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in after) == [(s, k) for s in sorted(shards) for k in range(shards[s])]


def test_pipeline_runs_all_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"}
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2


def test_stages_take_awkward_tables(spark, awkward, nothing, tmp_path):
    some = [(0, 0, 0), (1, 1, None), (2, 0, 1), (4, 1, 1), (7, None, 0), (None, 1, 1), (4, 1, 1)]
    spark.createDataFrame(some, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns[:5] == frame.columns[:5] and set(frame.columns) <= set(out.columns)
            assert (out.count() > 0) == (frame is awkward)
