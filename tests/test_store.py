"""The store against a plain dictionary, through freezes, flushes, compactions and reopenings."""

import random

import pytest

from stratakv.model import Bound, NoCompact, Options, Simple
from stratakv.operators.compact import Levels, Task, apply_result
from stratakv.sources.store import TRACK, KVStore, replay, replayed
from stratakv.streaming import ingest


def put(spark, store, pairs):
    store.put(spark.createDataFrame([(i, bytearray(k), bytearray(v)) for i, (k, v) in enumerate(pairs)], "ord long, key binary, value binary"))


def scanned(store, *bounds):
    return {bytes(r.key): bytes(r.value) for r in store.scan(*bounds).collect()}


def test_puts_deletes_and_reads(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"))
    assert store.get(b"0") is None and scanned(store) == {}
    put(spark, store, [(b"1", b"1"), (b"2", b"2"), (b"3", b"3"), (b"3", b"33")])
    assert [store.get(k) for k in (b"1", b"2", b"3")] == [b"1", b"2", b"33"]
    store.delete(spark.createDataFrame([(bytearray(b"1"),), (bytearray(b"0"),)], "key binary"))
    assert store.get(b"1") is None and store.get(b"0") is None
    put(spark, store, [(b"2", b"")])
    assert store.get(b"2") is None and scanned(store) == {b"3": b"33"}
    with pytest.raises(Exception):
        put(spark, store, [(b"", b"1")])
    assert scanned(store) == {b"3": b"33"}
    with pytest.raises(RuntimeError):
        store.force_flush()


def test_versions_across_segments_runs_and_levels(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), Options(strategy=Simple(200, 2, 2)))
    put(spark, store, [(b"a", b"1"), (b"m", b"old"), (b"z", b"1")])
    store.force_freeze()
    put(spark, store, [(b"m", b"mid"), (b"z", b"")])
    store.force_freeze()
    assert scanned(store) == {b"a": b"1", b"m": b"mid"}
    assert [store.force_flush(), store.force_flush()] == store.now.levels.level0
    put(spark, store, [(b"m", b"new")])
    assert store.get(b"m") == b"new"
    before = scanned(store)
    store.compact()
    assert store.dump()["L0"] == [] and len(store.dump()["L1"]) == 1 and scanned(store) == before
    # a run from a to z holds nothing between n and y
    assert scanned(store, Bound.included(b"n"), Bound.included(b"y")) == {}
    store.full_compaction()
    assert scanned(store) == before and store.dump()["L1"] == [] and len(store.dump()["L2"]) == 1
    assert store.catalog().filter("level = 2").first().n == 2  # deleted z is gone for good
    again = KVStore.open(spark, str(tmp_path / "s"), store.options)
    assert scanned(again) == before and again.dump() == store.dump()


def test_shallower_level_wins_and_lost_rows_are_found(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), Options(strategy=Simple(200, 1, 2)))
    for value, times in ((b"deep", 2), (b"shallow", 1)):
        put(spark, store, [(b"k", value), (b"q" + value, value)])
        store.force_freeze()
        store.force_flush()
        for level in range(times):
            ids = store.now.levels.level0 if level == 0 else store.now.levels.below[1]
            store.compact(Task(level or None, tuple(ids), level + 1, tuple(store.now.levels.below[level + 1]), level + 1 == 2))
    assert {k: len(v) for k, v in store.dump().items() if k.startswith("L")} == {"L0": 0, "L1": 1, "L2": 1}
    assert store.get(b"k") == b"shallow" and scanned(store, Bound.included(b"a"))[b"qdeep"] == b"deep"


def test_bottom_compaction_of_tombstones_leaves_no_run(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), Options(strategy=Simple(200, 1, 1)))
    put(spark, store, [(b"a", b"")])
    store.force_freeze()
    store.force_flush()
    assert store.compact() == []
    assert store.dump()["L0"] == [] and store.dump()["L1"] == [] and scanned(store) == {}
    assert scanned(KVStore.open(spark, str(tmp_path / "s"), store.options)) == {}
    assert replay(store.now.tracks)[1].level0 == []


def test_freezes_by_size_and_flushes_by_number(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), Options(run_size=50, memtable_limit=2, strategy=NoCompact()))
    for i in range(4):
        put(spark, store, [(b"%05d" % (10 * i + j), b"x" * 10) for j in range(5)])
    assert len(store.dump()["imm"]) == 4
    store.maintain()
    assert len(store.dump()["imm"]) == 1 and len(store.dump()["L0"]) == 3
    assert len(scanned(store)) == 20 and store.compact() is None
    store.force_freeze()  # an empty segment makes no run
    store.maintain()
    assert len(store.dump()["L0"]) == 4
    live, levels, _ = replay(store.now.tracks)
    assert live == [*store.now.immutable, store.now.memtable] and levels.level0 == store.now.levels.level0


def test_large_keys_and_values_and_rolled_runs(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), Options(run_size=40_000, strategy=Simple(200, 1, 2)))
    put(spark, store, [(b"k" * 300 + b"%d" % i, b"v" * 40_000) for i in range(4)] + [(b"\xff\x80", b"high")])
    store.maintain()
    store.force_flush()
    store.compact()
    assert len(store.dump()["L1"]) > 1
    assert store.get(b"\xff\x80") == b"high" and store.get(b"k" * 300 + b"2") == b"v" * 40_000
    assert len(scanned(store)) == 5


def test_two_writers_cannot_both_commit(spark, tmp_path):
    first = KVStore.open(spark, str(tmp_path / "s"))
    second = KVStore.open(spark, str(tmp_path / "s"))
    put(spark, first, [(b"a", b"1")])
    with pytest.raises(RuntimeError, match="another writer"):
        put(spark, second, [(b"b", b"1")])


def test_against_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    store, model = KVStore.open(spark, str(tmp_path / "s"), Options(strategy=Simple(200, 2, 2))), {}
    for step in range(14):
        action = rng.choice(["put", "put", "delete", "freeze", "maintain", "open"])
        if action in ("put", "delete"):
            pairs = [(b"k%02d" % rng.randrange(30), b"" if action == "delete" else b"v%d" % step) for _ in range(8)]
            put(spark, store, pairs)
            for k, v in pairs:
                model.pop(k, None) if not v else model.__setitem__(k, v)
        elif action == "freeze":
            store.force_freeze()
        elif action == "maintain":
            store.maintain()
        else:
            store = KVStore.open(spark, str(tmp_path / "s"), store.options)
        low, high = sorted(rng.sample(range(30), 2))
        low, high = b"k%02d" % low, b"k%02d" % high
        assert scanned(store, Bound.excluded(low), Bound.included(high)) == {k: v for k, v in model.items() if low < k <= high}
    assert scanned(store) == model


def test_a_stream_is_put_once(spark, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    source.mkdir()
    store = KVStore.open(spark, str(tmp_path / "s"))
    for i in range(3):
        (source / f"{i}.json").write_text(f'{{"key": "a{i}", "value": "{i}"}}\n{{"key": "b", "value": "{i}"}}\n')
        stream = spark.readStream.schema("key string, value string").json(str(source))
        ingest.start(stream, store, checkpoint, availableNow=True).awaitTermination(60)
    assert scanned(store) == {b"a0": b"0", b"a1": b"1", b"a2": b"2", b"b": b"2"}
    batch = store.now.next_batch
    store.put(spark.createDataFrame([("c", "1")], "key string, value string"), source=checkpoint, source_batch=0)
    assert store.now.next_batch == batch


def test_older_versions_and_frames_made_before(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), Options(strategy=Simple(200, 2, 2), keep_versions=6))
    put(spark, store, [(b"a", b"1"), (b"b", b"1")])
    store.force_freeze()
    store.force_flush()
    before, version = store.scan(), store.now.version
    put(spark, store, [(b"a", b"2"), (b"b", b"")])
    store.force_freeze()
    store.force_flush()
    store.compact()
    assert scanned(store) == {b"a": b"2"}
    assert {bytes(r.key): bytes(r.value) for r in before.collect()} == {b"a": b"1", b"b": b"1"}
    old = KVStore.open(spark, store.path, store.options, version)
    assert scanned(old) == {b"a": b"1", b"b": b"1"} and old.get(b"b") == b"1"
    with pytest.raises(RuntimeError, match="reading only"):
        old.force_freeze()
    for _ in range(8):
        store.force_freeze()
    assert len(store.versions()) == 7 and version not in store.versions()
    with pytest.raises(ValueError, match="isn't kept"):
        KVStore.open(spark, store.path, store.options, version)
    assert scanned(store) == {b"a": b"2"}
    assert len(list((tmp_path / "s" / "runs").iterdir())) == len(list((tmp_path / "s" / "filters").iterdir()))


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    first, second = (KVStore.open(spark, str(tmp_path / "s")) for _ in range(2))
    put(spark, first, [(b"a", b"1")])
    state = second.now.encode()
    for act in (second.force_freeze, lambda: put(spark, second, [(b"b", b"1")])):
        with pytest.raises(RuntimeError, match="another writer"):
            act()
        assert second.now.encode() == state


def test_tracks_are_filed_once(spark, tmp_path, monkeypatch):
    from stratakv.sources import store as module

    monkeypatch.setattr(module, "TRACKS", 3)
    store = KVStore.open(spark, str(tmp_path / "s"))
    for _ in range(8):
        store.force_freeze()
    assert len(store.now.tracks) == 9 and store.now.filed == 9
    assert KVStore.open(spark, store.path).now.tracks == store.now.tracks
    assert replay(store.now.tracks)[0] == [*store.now.immutable, store.now.memtable]


def test_wrong_checksums_fail(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"))
    put(spark, store, [(b"a", b"1"), (b"b", b"2")])
    path = store.now.segment_paths[0][0]
    spark.createDataFrame([(1, 0, bytearray(b"a"), bytearray(b"1"), 12345)], "batch long, ord long, key binary, value binary, crc long").write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="checksum mismatch"):
        store.scan().collect()


def test_filters_prune_runs_of_any_size(spark, tmp_path):
    from pyspark.sql import functions as F

    store = KVStore.open(spark, str(tmp_path / "s"), Options(run_size=1 << 40, strategy=NoCompact()))
    for k in range(2):  # even and odd numbers: ranges overlap wholly
        store.put(spark.range(500_000).select(F.format_string("k%07d", F.col("id") * 2 + k).alias("key"), F.lit("v").alias("value"), F.col("id").alias("ord")))
        store.force_freeze()
        store.force_flush()
    even, odd = store.now.levels.level0
    keys = [b"k%07d" % i for i in range(400_000, 400_060)]
    for i, key in enumerate(keys):
        assert [even, odd][i % 2] in store.holding(key, [even, odd])
    assert sum(len(store.holding(key, [even, odd])) for key in keys[:30]) <= 40
    assert store.get(keys[1]) == b"v" and store.get(b"k9") is None
    assert len(store.log(Bound.included(keys[0]), Bound.included(keys[0]), keys[0]).inputFiles()) <= 2


def test_replay_takes_time_by_the_tracks_alone():
    class Counted(int):
        asked = 0
        __hash__ = int.__hash__

        def __eq__(self, other):
            Counted.asked += 1
            return int(self) == int(other)

    n = 2000
    tracks = [{"type": "create", "id": Counted(i)} for i in range(n)]
    tracks += [{"type": "flush", "id": Counted(i), "run": i} for i in reversed(range(1, n))]
    live, levels, most = replay(tracks)
    assert live == [0] and levels.level0 == list(reversed(range(1, n))) and most == n - 1
    assert Counted.asked < 10 * n


def test_tracks_replayed_in_a_plan_as_in_the_driver(spark):
    rng = random.Random(3)
    for _ in range(6):
        tracks, levels, waiting, ids = [], Levels([], {1: [], 2: [], 3: []}), [], iter(range(10**6))
        for _ in range(rng.randrange(60)):
            act = rng.choice(["create", "create", "flush", "flush", "compact"])
            if act == "create":
                waiting.append(next(ids))
                tracks.append({"type": "create", "id": waiting[-1]})
            elif act == "flush" and waiting:
                run = None if rng.random() < 0.2 else next(ids)
                levels.level0 += [] if run is None else [run]
                tracks.append({"type": "flush", "id": waiting.pop(rng.randrange(len(waiting))), "run": run})
            elif act == "compact":
                k = rng.randrange(3)
                upper = levels.below[k] if k else levels.level0[: rng.randrange(len(levels.level0) + 1)]
                task = Task(k or None, tuple(upper), k + 1, tuple(levels.below[k + 1]), k == 2)
                outputs = [next(ids) for _ in range(rng.randrange(3))]
                levels, _ = apply_result(levels, task, outputs)
                tracks.append({"type": "compact", "task": task.encode(), "outputs": outputs})
        live, after, _ = replay(tracks)
        want = [(i, "memtable") for i in live] + [(i, f"level{k}") for k, v in [(0, after.level0), *after.below.items()] for i in v]
        rows = [(i, t["type"], t.get("id"), t.get("run"), t.get("task"), t.get("outputs")) for i, t in enumerate(tracks)]
        assert sorted(tuple(r) for r in replayed(spark.createDataFrame(rows, TRACK)).collect()) == sorted(want)
    with pytest.raises(Exception, match="unknown track"):
        replayed(spark.createDataFrame([(0, "other", 1, None, None, None)], TRACK)).collect()


def test_a_run_is_written_in_slices(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from stratakv.sources import store as module

    monkeypatch.setattr(module, "SLICE", 100_000, raising=False)
    store, model = KVStore.open(spark, str(tmp_path / "s"), Options(run_size=1 << 40, strategy=Simple(200, 2, 2))), {}
    for k in range(2):
        store.put(spark.range(9000).select(F.format_string("k%05d", F.col("id") * 2 % 9001 + k).alias("key"), F.format_string("v%d", F.lit(k)).alias("value"), F.col("id").alias("ord")))
        model |= {b"k%05d" % (i * 2 % 9001 + k): b"v%d" % k for i in range(9000)}
        store.force_freeze()
        store.force_flush()
    least, most = min(model), max(model)

    def checked(level):
        runs = store.dump()[level]
        for run in runs:
            at = store.now.runs[run]
            counts = [spark.read.parquet(p).count() for p in at["paths"]]
            assert len(counts) >= 9 and max(counts) <= 3000 and sum(counts) == at["n"]
            ends = [x for _, _, first, last in at["slices"] for x in (first, last)]
            assert ends == sorted(ends) and ends[0] == at["first"] and ends[-1] == at["last"]
        for key in (least, b"k04000", b"k04501", most):
            assert store.get(key) == model[key] and len(store.log(key=key).inputFiles()) <= len(runs)
        assert store.get(b"a") is None and store.get(b"k04000x") is None
        assert scanned(store) == model
        low, high = Bound.excluded(b"k02000"), Bound.included(b"k02100")
        assert scanned(store, low, high) == {k: v for k, v in model.items() if b"k02000" < k <= b"k02100"}
        assert len(store.log(low, high).inputFiles()) <= 2 * len(runs)
        return len(runs)

    assert checked("L0") == 2
    store.compact()
    assert store.dump()["L0"] == [] and checked("L1") == 1
    store = KVStore.open(spark, store.path, store.options)
    assert checked("L1") == 1
    store.full_compaction()
    assert checked("L2") == 1


def test_compaction_into_several_runs_of_several_slices(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from stratakv.sources import store as module

    monkeypatch.setattr(module, "SLICE", 100_000, raising=False)
    store = KVStore.open(spark, str(tmp_path / "s"), Options(run_size=30_000, strategy=Simple(200, 1, 1)))
    store.put(spark.range(9000).select(F.format_string("k%05d", "id").alias("key"), F.lit("v").alias("value"), F.col("id").alias("ord")))
    store.maintain()
    store.force_flush()
    store.compact()
    runs = [store.now.runs[i] for i in store.dump()["L1"]]
    assert len(runs) == 3 and all(len(r["paths"]) == 4 for r in runs) and sum(r["n"] for r in runs) == 9000
    assert all(a["last"] < b["first"] for a, b in zip(runs, runs[1:])) and len(scanned(store)) == 9000


def test_runs_of_manifests_before_slices(spark, tmp_path):
    store = KVStore.open(spark, str(tmp_path / "s"), Options(strategy=Simple(200, 2, 2)))
    for value in (b"1", b"2"):
        put(spark, store, [(b"a", value), (b"b" + value, value)])
        store.force_freeze()
        store.force_flush()
    now = store.now.draft()
    for run in now.runs.values():
        run["part"] = run.pop("slices")[0][0]
    store._commit(now)
    again = KVStore.open(spark, store.path, store.options)
    assert again.get(b"a") == b"2" and again.get(b"b1") == b"1" and again.get(b"c") is None
    again.compact()
    assert scanned(again) == {b"a": b"2", b"b1": b"1", b"b2": b"2"}
