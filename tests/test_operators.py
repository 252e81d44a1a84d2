"""Operators of the key-value engine on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from stratakv.functions import sketch
from stratakv.functions.cache import LRUCache
from stratakv.model import UNBOUNDED, Bound, NoCompact, Options, Simple, key_range, require_keys, signed_order
from stratakv.operators import blocks, compact, query, resolve, segment


def run_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def numbered(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("seq"), F.format_string("key_%05d", "id").alias("key"), F.format_string("value_%05d", "id").alias("value"))


@pytest.mark.parametrize(
    "low,high,first,last",
    [(Bound.included, Bound.included, 10, 100), (Bound.included, Bound.excluded, 10, 99), (Bound.included, None, 10, 999), (Bound.excluded, Bound.included, 11, 100), (Bound.excluded, Bound.excluded, 11, 99), (Bound.excluded, None, 11, 999), (None, Bound.included, 0, 100), (None, Bound.excluded, 0, 99), (None, None, 0, 999)],
)
def test_nine_scans_end_where_they_should(spark, low, high, first, last):
    lower = low("key_00010") if low else UNBOUNDED
    upper = high("key_00100") if high else UNBOUNDED
    got = rows(query.scan(numbered(spark), lower, upper))
    assert got == [(f"key_{i:05d}", f"value_{i:05d}") for i in range(first, last + 1)]


def test_a_range_the_wrong_way_is_refused():
    with pytest.raises(ValueError):
        key_range(Bound.included("b"), Bound.included("a"))


def test_key_bounds_reach_the_scan_and_tombstones_stay_above(spark, tmp_path):
    numbered(spark).write.parquet(str(tmp_path / "log"))
    df = query.scan(spark.read.parquet(str(tmp_path / "log")), Bound.included("key_00010"), Bound.excluded("key_00020"), ordered=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,key_00010)" in plan and "LessThan(key,key_00020)" in plan


def test_get_sees_newest_and_hides_deleted(spark):
    log = spark.createDataFrame([(1, "1", "1"), (2, "2", "2"), (3, "3", "3"), (4, "1", ""), (5, "2", ""), (6, "3", "3"), (7, "4", "4"), (8, "1", "11"), (9, "3", "33")], "seq long, key string, value string")
    assert [rows(query.get(log, k)) for k in "12345"] == [[("1", "11")], [], [("3", "33")], [("4", "4")], []]
    keys = spark.createDataFrame([("1",), ("2",), ("4",), ("4",), ("9",)], "key string")
    for few in (True, False, None):
        assert sorted(rows(query.multi_get(log, keys, few=few))) == [("1", "11"), ("4", "4")]
    assert [r.seq for r in query.history(log, "1").collect()] == [8, 4, 1]
    assert rows(query.scan(query.delete(log, spark.createDataFrame([(10, "0")], "seq long, key string")))) == [("1", "11"), ("3", "33"), ("4", "4")]


def test_kway_merge_later_run_wins(spark):
    a = run_of(spark, [("a", "1.1"), ("b", "2.1"), ("c", "3.1")])
    b = run_of(spark, [("a", "1.2"), ("b", "2.2"), ("c", "3.2"), ("d", "4.2")])
    c = run_of(spark, [("b", "2.3"), ("c", "3.3"), ("d", "4.3")])
    empty = run_of(spark, [])
    assert sorted(rows(resolve.kway_merge([a, b, c]))) == [("a", "1.2"), ("b", "2.3"), ("c", "3.3"), ("d", "4.3")]
    assert rows(resolve.kway_merge([empty, empty, empty])) == []
    assert sorted(rows(resolve.kway_merge([empty, a, empty]))) == sorted(rows(a))
    with pytest.raises(ValueError):
        resolve.kway_merge([])


def test_two_way_merge_first_wins(spark):
    a = run_of(spark, [("a", "1.1"), ("b", "2.1"), ("c", "3.1")])
    b = run_of(spark, [("a", "1.2"), ("b", "2.2"), ("c", "3.2"), ("d", "4.2")])
    assert sorted(rows(resolve.two_way_merge(a, b))) == [("a", "1.1"), ("b", "2.1"), ("c", "3.1"), ("d", "4.2")]
    assert sorted(rows(resolve.two_way_merge(b, a))) == [("a", "1.2"), ("b", "2.2"), ("c", "3.2"), ("d", "4.2")]
    assert rows(resolve.two_way_merge(run_of(spark, []), run_of(spark, []))) == []


def test_disjoint_runs(spark):
    schema = "run_id int, pos int, first_key string, last_key string"
    assert resolve.apart(spark.createDataFrame([(7, 0, "a", "c"), (3, 1, "d", "f")], schema))
    assert not resolve.apart(spark.createDataFrame([(7, 0, "a", "d"), (3, 1, "d", "f")], schema))
    assert sorted(rows(resolve.concat([run_of(spark, [("a", "1")]), run_of(spark, [("b", "2")])]).filter("key >= 'a'"))) == [("a", "1"), ("b", "2")]


def test_freeze_counts_overwrites_and_keeps_the_crossing_entry(spark):
    log = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate([("1", "1"), ("2", "2"), ("3", "3"), ("1", "11"), ("2", "22"), ("3", "33"), ("1", "")])], "seq long, key string, value string")
    got = [r.segment_id for r in segment.freeze(log, 6).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2]
    sizes = {r.segment_id: r.bytes for r in segment.segments(segment.freeze(log, 6)).collect()}
    assert sizes == {0: 6, 1: 6, 2: 4}
    assert rows(segment.freeze(log.limit(0), 6)) == []


def test_folds_against_plain_loops():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(60))]
        t = rng.randrange(1, 90)
        seg, held, want = 0, 0, []
        for s in sizes:
            if held >= t:
                seg, held = seg + 1, 0
            held += s
            want.append(seg)
        assert segment.frozen_ids(np.array(sizes, dtype=int), t).tolist() == want
        block, held, want = 0, 0, []
        for s in sizes:
            if held and held + s + 2 > t:
                block, held = block + 1, 0
            held += s
            want.append(block)
        assert blocks.packed_blocks(np.array(sizes, dtype=int), t).tolist() == want


@pytest.mark.parametrize("threshold", [1, 7, 90, 2000, 10**6])
def test_chunks_of_a_log_freeze_as_the_whole(spark, threshold):
    import numpy as np

    rng = random.Random(threshold)
    seqs = sorted(rng.sample(range(-300, 3000), 1200))
    sizes = [rng.choice([1, 5, 5, 40]) for _ in seqs]
    log = spark.createDataFrame([(i, "k", "v" * (n - 1)) for i, n in zip(seqs, sizes)], "seq long, key string, value string")
    want = list(zip(seqs, sizes, segment.frozen_ids(np.array(sizes), threshold).tolist()))
    for bits, batch in ((3, "10000"), (7, "3"), (None, "10000")):  # a table of a chunk comes in parts, too
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert sorted(tuple(r) for r in segment.freeze(log.repartition(5), threshold, bits).collect()) == want


def test_flush_states(spark):
    segments = spark.createDataFrame([(i, 1) for i in range(5)], "segment_id long, n int")
    got = {r.segment_id: r.state for r in segment.flushable(segments, 2).collect()}
    assert got == {4: "mutable", 3: "immutable", 2: "flushable", 1: "flushable", 0: "flushable"}


def test_blocks(spark):
    pairs = [(1, f"key_{i * 5:03d}", f"value_{i:010d}") for i in range(100)]
    run = spark.createDataFrame(pairs, "run_id int, key string, value string")
    packed = blocks.pack(run, 10_000)
    assert {r.block_idx for r in packed.collect()} == {0}
    size = sum(len(k) + len(v) for _, k, v in pairs)
    assert run.groupBy("run_id").agg(blocks.encoded_size().alias("b")).first().b == size + 6 * 100 + 2
    assert blocks.block_index(blocks.pack(run, 128)).count() > 1
    for i in (0, 7, 99):
        for offset in range(1 if i == 99 else 5):
            want = (i if offset == 0 else i + 1) * 5
            assert blocks.seek(run, f"key_{i * 5 + offset:03d}").first().key == f"key_{want:03d}"
    assert rows(blocks.seek(run, "zzz")) == []
    assert rows(blocks.find_block(blocks.block_index(blocks.pack(run, 128)), "a")) == [(1, 0)]
    first = blocks.pack(spark.createDataFrame([(1, "1", "1" * 100), (1, "2", "22")], "run_id int, key string, value string"), 16)
    assert [r.block_idx for r in first.orderBy("key").collect()] == [0, 1]


def test_checksums(spark):
    run = run_of(spark, [("a", "1"), ("b", "")])
    marked = blocks.with_checksum(run)
    assert sorted(rows(blocks.verified(marked))) == [("a", "1"), ("b", "")]
    with pytest.raises(Exception, match="checksum"):
        blocks.verified(marked.withColumn("value", F.lit("x"))).collect()


def test_keys_and_values_are_required(spark):
    assert require_keys(run_of(spark, [("a", "")])).count() == 1
    for bad in ([("", "1")], [(None, "1")], [("a", None)]):
        with pytest.raises(Exception, match="empty or null"):
            require_keys(run_of(spark, bad)).collect()


def test_signed_order(spark):
    rng = random.Random(3)
    keys = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))) for _ in range(300)] + [b"\x80", b"\x01", b"a", b"ab"]
    got = [bytes(r[0]) for r in spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").orderBy(signed_order()).collect()]
    assert got == sorted(keys, key=lambda k: [b - 256 if b > 127 else b for b in k])


def test_compaction_picks():
    strategy = Simple(200, 2, 3)
    levels = lambda *n: compact.Levels(list(range(n[0])), {k: list(range(100 * k, 100 * k + n[k])) for k in (1, 2, 3)})
    assert compact.pick(levels(0, 0, 0, 0), strategy) is None
    assert compact.pick(levels(1, 0, 0, 0), strategy) is None
    assert compact.pick(levels(2, 0, 0, 0), strategy) == compact.Task(None, (0, 1), 1, (), False)
    assert compact.pick(levels(2, 4, 8, 16), strategy) is None
    assert compact.pick(levels(0, 1, 2, 3), strategy) == compact.Task(2, (200, 201), 3, (300, 301, 302), True)
    assert compact.pick(levels(9, 0, 0, 0), NoCompact()) is None
    task = compact.pick(levels(2, 3, 0, 0), strategy)
    assert compact.Task.decode(task.encode()) == task
    after, gone = compact.apply_result(compact.Levels([0, 1, 77], levels(2, 3, 0, 0).below), task, [500])
    assert after.level0 == [77] and after.below == {1: [500], 2: [], 3: []} and gone == [0, 1, 100, 101, 102]
    assert compact.flush_to_level0(strategy)
    with pytest.raises(ValueError):
        Options(strategy="leveled")


def test_compaction_keeps_tombstones_above_the_bottom(spark):
    newer, older, lower = run_of(spark, [("a", ""), ("b", "2")]), run_of(spark, [("a", "1"), ("c", "3")]), run_of(spark, [("a", "0"), ("d", "4")])
    assert sorted(rows(compact.merge([older, newer], [lower], True, False))) == [("a", ""), ("b", "2"), ("c", "3"), ("d", "4")]
    assert sorted(rows(compact.merge([older, newer], [lower], True, True))) == [("b", "2"), ("c", "3"), ("d", "4")]
    assert compact.rolled(run_of(spark, []), 100)[1] == 0
    ranged, n = compact.rolled(numbered(spark, 100).select("key", "value"), 500)
    assert n == 4 and ranged.count() == 100


def test_murmur_and_bloom(spark):
    known = {"tom": -1036885128094956045, "jack": 6379880703990657075, "alice": 8965236124002675106, "bob": 5504877994387931730, "john": 4609595599819426582, "peter": -4693286521081719413, "key_00010": -4092982263829080139}
    df = spark.createDataFrame([(k,) for k in known] + [(None,)], "key string").select("key", sketch.hash64("key").alias("h"), sketch.hash32("key").alias("g"))
    got = {r.key: r.h for r in df.collect()}
    assert got == {**known, None: None}
    assert [(sketch.total_bits(n), sketch.hash_count(n)) for n in (1, 5, 100, 1000)] == [(7, 5), (36, 5), (729, 5), (7298, 5)]
    own = sketch.BloomFilter(5)
    for k in ("tom", "jack", "alice", "bob", "john"):
        own.add(k.encode())
    again = sketch.BloomFilter.decode(own.encode())
    for f in (own, again):
        assert f.contains(b"tom") and not f.contains(b"peter")
    with pytest.raises(ValueError):
        sketch.BloomFilter.decode(own.encode()[:-1] + b"\0\0")
    keys = spark.createDataFrame([(1, k) for k in ("tom", "jack", "alice", "bob", "john")], "run_id int, key string")
    built = sketch.build(keys)
    bits = built.first()
    assert {b for b in range(own.m) if own.bits[b >> 3] >> (b & 7) & 1} == set(bits.bits) and (bits.m, bits.k) == (own.m, own.k)
    asked = spark.createDataFrame([(1, "tom"), (1, "peter")], "run_id int, key string")
    assert {r.key: r.maybe for r in sketch.probe(built, asked).collect()} == {"tom": True, "peter": False}


def test_lru():
    cache = LRUCache(32)
    for i in (1, 2, 3):
        cache.put(f"key{i}", f"value{i}", 10)
    assert cache.get("key1") == "value1"
    cache.put("key4", "value4", 10)
    assert cache.get("key2") is None and cache.get("key1") == "value1" and cache.get("key4") == "value4"
    cache.put("key1", "other", 10)
    assert cache.get("key1") == "value1"
    cache.put("big", "x", 33)
    assert cache.get("big") is None
