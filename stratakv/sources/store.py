"""A store on a shared file system: a durable log of segments, sorted Parquet runs in levels, and a manifest.

Layout under the root: `log/segment=<id>/` holds the entries of a segment as they were put, each with its checksum;
`runs/<name>/part=<k>/` is a slice of a sorted run, likewise, and `filters/<name>/` the Bloom filters of the slices written
with it. A run is as many slices, apart and in key order, as keep each within what a task should hold, so it may be of any size;
`manifest/<version>.json` is a whole snapshot of the store but for its older tracks, which lie in `tracks/` and are
written once. A commit writes the next version under another name and renames it, so readers see either snapshot, and
only then does the store in memory change. Files that a commit lets go of stay for `keep_versions` more commits, so that
DataFrames made before it still run and older versions can be opened. One writer at a time.

Recency of an entry is (batch, ord): the number of its put, and its place in it. Runs keep it, so that every read is one
newest-wins resolution over whatever holds the key. Checksums are verified wherever entries are read; a wrong one fails
the job.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.functions import sketch
from stratakv.model import LOG, UNBOUNDED, Bound, Options, is_tombstone, key_range, require_keys
from stratakv.operators import compact
from stratakv.operators.blocks import verified, with_checksum
from stratakv.operators.compact import Levels, Task
from stratakv.operators.resolve import newest_rows

STORED = f"{LOG}, crc long"
TRACKS = 100  # tracks of a file
SLICE, ENTRY = 64 << 20, 100  # bytes of a slice, about; what a task holds for an entry besides its key and value
TRACK = "place long, type string, id long, run long, task string, outputs array<long>"
TASK = "upper_level long, upper_ids array<long>, lower_level long, lower_ids array<long>, is_bottom boolean"


@dataclass
class Snapshot:
    """What a manifest version says."""

    version: int = 0
    next_id: int = 1
    next_batch: int = 1
    memtable: int = 0
    segment_bytes: dict[int, int] = field(default_factory=lambda: {0: 0})
    segment_paths: dict[int, list[str]] = field(default_factory=dict)
    immutable: list[int] = field(default_factory=list)
    levels: Levels = field(default_factory=Levels)
    runs: dict[int, dict] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    retired: list[list] = field(default_factory=list)
    tracks: list[dict] = field(default_factory=list)
    filed: int = 0

    def encode(self) -> str:
        x = {k: v for k, v in self.__dict__.items() if k != "levels"}
        return json.dumps(x | {"level0": self.levels.level0, "below": self.levels.below, "tracks": self.tracks[self.filed :]})

    @staticmethod
    def decode(text: str) -> Snapshot:
        x = json.loads(text)
        ints = lambda d: {int(k): v for k, v in d.items()}
        levels = Levels(x.pop("level0"), ints(x.pop("below")))
        return Snapshot(**x | {"levels": levels} | {k: ints(x[k]) for k in ("runs", "segment_bytes", "segment_paths")})

    def draft(self) -> Snapshot:
        """A copy that an operation may change before it commits."""
        return Snapshot(**{k: list(v) if k == "tracks" else copy.deepcopy(v) for k, v in self.__dict__.items()})


def replay(tracks: list[dict]) -> tuple[list[int], Levels, int]:
    """Segments that are not flushed, levels, and the largest id, from the tracks alone, in order."""
    created, levels, most = {}, Levels(), 0
    for t in tracks:
        if t["type"] == "create":
            created[t["id"]] = True
            most = max(most, t["id"])
        elif t["type"] == "flush":
            del created[t["id"]]
            if t.get("run") is not None:
                levels.level0.append(t["run"])
                most = max(most, t["run"])
        elif t["type"] == "compact":
            levels, _ = compact.apply_result(levels, Task.decode(t["task"]), t["outputs"])
            most = max([most, *t["outputs"]])
        else:
            raise ValueError(f"unknown track {t['type']}")
    return list(created), levels, most


def replayed(tracks: DataFrame) -> DataFrame:
    """id, kind of the same segments ("memtable") and runs ("level0", "level1", ...), from tracks that are too many for the
    driver. tracks: TRACK, place being a track's place in the order. Ids are given once, so what a flush or a compaction
    takes away is gone wherever it stands; of each level below 0 the last compaction into or out of it says what it holds."""
    of = lambda kind: tracks.filter(F.col("type") == kind)
    wrong = F.raise_error(F.concat(F.lit("unknown track "), F.coalesce("type", F.lit("null")))).cast("boolean")
    unknown = tracks.filter(F.when(F.col("type").isin("create", "flush", "compact"), False).otherwise(wrong)).select("id", F.col("type").alias("kind"))
    tasks = of("compact").withColumn("task", F.from_json("task", TASK))
    segments = of("create").select("id").join(of("flush").select("id"), "id", "left_anti")
    taken = tasks.filter("task.upper_level IS NULL").select(F.explode("task.upper_ids").alias("id"))
    level0 = of("flush").filter("run IS NOT NULL").select(F.col("run").alias("id")).join(taken, "id", "left_anti")
    into = tasks.select(F.col("task.lower_level").alias("level"), "place", "outputs")
    out_of = tasks.filter("task.upper_level IS NOT NULL").select(F.col("task.upper_level").alias("level"), "place", F.array().cast("array<long>").alias("outputs"))
    below = into.unionByName(out_of).groupBy("level").agg(F.max_by("outputs", "place").alias("ids"))
    below = below.select(F.explode("ids").alias("id"), F.concat(F.lit("level"), F.col("level").cast("string")).alias("kind"))
    return segments.withColumn("kind", F.lit("memtable")).unionByName(level0.withColumn("kind", F.lit("level0"))).unionByName(below).unionByName(unknown)


class KVStore:
    def __init__(self, spark: SparkSession, path: str, options: Options, now: Snapshot):
        self.spark, self.path, self.options, self.now = spark, path.rstrip("/"), options, now

    # files

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _list(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _write(self, path: str, text: str, again: bool = False) -> None:
        """The whole file or none of it; fails if it is there, or if `again` writes over it."""
        fs, at = self._fs(path)
        _, draft = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if again and fs.exists(at):
            fs.delete(at, False)
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made {path}")

    @staticmethod
    def _read(spark: SparkSession, path: str) -> str:
        return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())

    # life

    @staticmethod
    def open(spark: SparkSession, path: str, options: Options = Options(), version: int | None = None) -> KVStore:
        """A new store, or the last committed state of one; segments that were not flushed are still in the log. With a
        version, a store as of that commit, for reading."""
        store = KVStore(spark, path, options, Snapshot(levels=Levels.empty(options.strategy), tracks=[{"type": "create", "id": 0}]))
        versions = store.versions()
        if version is not None and version not in versions:
            raise ValueError(f"version {version} isn't kept")
        store.read_only = version is not None
        if versions:
            store.now = Snapshot.decode(store._read(spark, f"{store.path}/manifest/{version or versions[-1]:020d}.json"))
            filed = [t for i in range(0, store.now.filed, TRACKS) for t in json.loads(store._read(spark, f"{store.path}/tracks/{i:020d}.json"))]
            store.now.tracks = filed + store.now.tracks
            for level in range(1, getattr(options.strategy, "max_levels", 0) + 1):
                store.now.levels.below.setdefault(level, [])
        else:
            store._commit(store.now.draft())
        return store

    def versions(self) -> list[int]:
        """Versions that can be opened."""
        return sorted(int(n[:-5]) for n in self._list(f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit())

    def _commit(self, now: Snapshot, gone: list[str] = ()) -> None:
        """Makes `now` the store's state, on disk first."""
        if getattr(self, "read_only", False):
            raise RuntimeError("an older version is open for reading only")
        now.version = self.now.version + 1
        oldest = now.version - self.options.keep_versions
        now.retired += [[now.version, p] for p in gone]
        due = [p for v, p in now.retired if v <= oldest]
        now.retired = [x for x in now.retired if x[0] > oldest]
        while len(now.tracks) - now.filed >= TRACKS:
            self._write(f"{self.path}/tracks/{now.filed:020d}.json", json.dumps(now.tracks[now.filed : now.filed + TRACKS]), True)
            now.filed += TRACKS
        self._write(f"{self.path}/manifest/{now.version:020d}.json", now.encode())
        self.now = now
        for path in due:
            self._delete(path)
        if oldest > 1:
            self._delete(f"{self.path}/manifest/{oldest - 1:020d}.json")

    def close(self) -> None:
        """Nothing to do: every put is in the log."""

    # writes

    def put(self, entries: DataFrame, source: str | None = None, source_batch: int | None = None) -> None:
        """Upserts key and value of a DataFrame; of equal keys that of the largest ord wins, if there is such a column,
        else any. With a source, a batch number at or below its last is left out."""
        if source is not None and source_batch <= self.now.sources.get(source, -1):
            return
        now = self.now.draft()
        order = F.col("ord").cast("long") if "ord" in entries.columns else F.monotonically_increasing_id()
        batch = entries.select(F.lit(now.next_batch).cast("long").alias("batch"), order.alias("ord"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        path = f"{self.path}/log/segment={now.memtable}/batch-{now.next_batch}-{uuid.uuid4().hex}"
        with_checksum(require_keys(batch)).write.parquet(path)
        size = self.spark.read.schema(STORED).parquet(path).agg(F.sum(F.octet_length("key") + F.octet_length("value"))).first()[0] or 0
        now.segment_bytes[now.memtable] += int(size)
        now.segment_paths.setdefault(now.memtable, []).append(path)
        now.next_batch += 1
        if source is not None:
            now.sources[source] = source_batch
        if now.segment_bytes[now.memtable] >= self.options.run_size:
            self._freeze(now)
        self._commit(now)

    def delete(self, keys: DataFrame) -> None:
        """Tombstones for the keys, present or not."""
        self.put(keys.select("key", F.lit(b"").alias("value")))

    @staticmethod
    def _freeze(now: Snapshot) -> None:
        now.immutable.append(now.memtable)
        now.memtable, now.next_id = now.next_id, now.next_id + 1
        now.segment_bytes[now.memtable] = 0
        now.tracks.append({"type": "create", "id": now.memtable})

    def force_freeze(self) -> None:
        now = self.now.draft()
        self._freeze(now)
        self._commit(now)

    def _entries(self, paths: list[str], where: Column | None = None) -> DataFrame:
        """batch, ord, key, value of files, with their checksums verified."""
        stored = self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)
        return verified(stored if where is None else stored.filter(where))

    def _save_runs(self, now: Snapshot, entries: DataFrame, parts: int, n: int, size: int) -> list[int]:
        """Sorted runs of ranges of keys, `parts` at most, written once; ids of those that hold something, in key order.
        n and size are the entries and bytes that these are at most: they say how many slices a run has. What the manifest
        says of runs comes from one grouped aggregate, a row a slice."""
        name = uuid.uuid4().hex
        path, filters = f"{self.path}/runs/{name}", f"{self.path}/filters/{name}"
        slices = max(1, -(-(size + ENTRY * n) // (SLICE * parts)))
        own = with_checksum(entries)
        own = own.repartitionByRange(parts * slices, "key") if parts * slices > 1 else own.coalesce(1)
        own.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "key").write.partitionBy("part").option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        saved = self.spark.read.schema(f"{STORED}, part int").parquet(path)
        stats = saved.groupBy("part").agg(F.count("*").alias("n"), F.hex(F.min("key")).alias("first"), F.hex(F.max("key")).alias("last"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes")).orderBy("part").collect()
        if not stats:
            self._delete(path)
            return []
        ids = []
        for _, group in groupby(stats, lambda x: x["part"] // slices):
            held = list(group)
            ids.append(now.next_id)
            now.next_id += 1
            now.runs[ids[-1]] = {
                "paths": [f"{path}/part={x['part']}" for x in held],
                "n": sum(x["n"] for x in held),
                "first": held[0]["first"],
                "last": held[-1]["last"],
                "bytes": sum(int(x["bytes"]) for x in held),
                "filter": filters,
                "slices": [[x["part"], x["n"], x["first"], x["last"]] for x in held],
            }
        dealt = min(len(stats), max(self.spark.sparkContext.defaultParallelism, -(-(size + ENTRY * n) // SLICE)))
        sketch.filter_pieces(saved.select("part", "key").repartitionByRange(dealt, "part")).write.parquet(filters)
        return ids

    def force_flush(self) -> int | None:
        """The oldest immutable segment as a run of level 0; raises if there is none. An empty segment makes no run."""
        if not self.now.immutable:
            raise RuntimeError("no immutable segment to flush")
        now = self.now.draft()
        segment = now.immutable.pop(0)
        gone = now.segment_paths.pop(segment, [])
        n = self.spark.read.schema(STORED).parquet(*gone).count() if gone else 0
        made = self._save_runs(now, newest_rows(self._entries(gone)), 1, n, now.segment_bytes[segment]) if gone else []
        run = made[0] if made else None
        del now.segment_bytes[segment]
        now.levels.level0 += made
        now.tracks.append({"type": "flush", "id": segment, "run": run})
        self._commit(now, gone)
        return run

    def compact(self, task: Task | None = None) -> list[int] | None:
        """One task, the strategy's pick by default; the runs it made, or None if there was nothing to do."""
        task = task or compact.pick(self.now.levels, self.options.strategy)
        if task is None:
            return None
        now = self.now.draft()
        ids = [*task.upper_ids, *task.lower_ids]
        merged = compact.merge_entries(self._entries(self._paths(ids)), task.is_bottom)
        n, size = (sum(now.runs[i][k] for i in ids) for k in ("n", "bytes"))  # what is merged away makes the runs somewhat smaller
        outputs = self._save_runs(now, merged, max(1, -(-size // self.options.run_size)), n, size)
        now.levels, old = compact.apply_result(now.levels, task, outputs)
        now.tracks.append({"type": "compact", "task": task.encode(), "outputs": outputs})
        dropped = [now.runs.pop(i) for i in old]
        self._commit(now, self._folders(now, dropped))
        return outputs

    @staticmethod
    def _folders(now: Snapshot, dropped: list[dict]) -> list[str]:
        """What goes with runs: a folder and its filters with the last of its runs, else the runs' own parts."""
        held = {r["filter"] for r in now.runs.values()}
        parts = [p for r in dropped if r["filter"] in held for p in r["paths"]]
        return parts + sorted({x for r in dropped if r["filter"] not in held for x in (r["filter"], r["paths"][0].rsplit("/part=", 1)[0])})

    def full_compaction(self) -> None:
        """All runs as one level, the lowest; deleted keys go."""
        ids = self.now.levels.all_ids()
        if ids and self.now.levels.below:
            bottom = max(self.now.levels.below)
            for level in range(bottom):
                upper = self.now.levels.below[level] if level else self.now.levels.level0
                lower = self.now.levels.below[level + 1]
                if upper:
                    self.compact(Task(level or None, tuple(upper), level + 1, tuple(lower), level + 1 == bottom))

    def maintain(self) -> None:
        """What the background timers would do: flush while too many segments wait, compact while the strategy says so."""
        while len(self.now.immutable) >= self.options.memtable_limit:
            self.force_flush()
        while self.compact() is not None:
            pass

    # reads

    @staticmethod
    def _slices(run: dict) -> list[list]:
        """part, n, first, last of a run's slices, in the order of its paths; older manifests have runs of one."""
        return run["slices"] if "slices" in run else [[run["part"], run["n"], run["first"], run["last"]]]

    @staticmethod
    def _meets(first: str, last: str, lower: Bound, upper: Bound) -> bool:
        """Whether keys from first to last can be in a range."""
        first, last = bytes.fromhex(first), bytes.fromhex(last)
        below = upper.kind != "unbounded" and (upper.value < first or upper.kind == "excluded" and upper.value == first)
        above = lower.kind != "unbounded" and (lower.value > last or lower.kind == "excluded" and lower.value == last)
        return not below and not above

    def _paths(self, ids: list[int], lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> list[str]:
        """Slices of the runs whose keys can be in a range."""
        return [p for i in ids for p, (_, _, first, last) in zip(self.now.runs[i]["paths"], self._slices(self.now.runs[i])) if self._meets(first, last, lower, upper)]

    def overlapping(self, lower: Bound, upper: Bound) -> list[int]:
        """Runs whose keys can be in a range, by their first and last keys."""
        return [i for i in self.now.levels.all_ids() if self._meets(self.now.runs[i]["first"], self.now.runs[i]["last"], lower, upper)]

    def holding(self, key: bytes, ids: list[int]) -> list[int]:
        """Those of the runs whose Bloom filters may hold the key. Only a run's slice around the key is asked, and of its
        filter only the pieces with the key's bits are read."""
        own = Bound.included(key)
        around = {i: (part, n) for i in ids for part, n, first, last in self._slices(self.now.runs[i]) if self._meets(first, last, own, own)}
        if not around:
            return []
        asked = {i: sketch.pieces_of(key, n) for i, (_, n) in around.items()}
        pieces = sorted({p for bits in asked.values() for p, _ in bits})
        parts = sorted({part for part, _ in around.values()})
        folders = sorted({self.now.runs[i]["filter"] for i in around})
        rows = self.spark.read.schema(sketch.PIECE_ROWS).parquet(*folders).filter(F.col("part").isin(parts) & F.col("piece").isin(pieces)).select("part", "piece", "bits", F.input_file_name().alias("file")).collect()
        found = {(next(f for f in folders if f.rsplit("/", 1)[1] in r["file"]), r["part"], r["piece"]): r["bits"] for r in rows}
        run = lambda i: (self.now.runs[i]["filter"], around[i][0])
        return [i for i in around if all(found[(*run(i), p)][b >> 3] >> (b & 7) & 1 for p, b in asked[i])]

    def log(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, key: bytes | None = None) -> DataFrame:
        """batch, ord, key, value of everything in a range of keys, or of one key; only files that can hold some are read."""
        ids, where = self.overlapping(lower, upper), key_range(lower, upper)
        if key is not None:
            ids, where = self.holding(key, ids), F.col("key") == F.lit(key)
            lower = upper = Bound.included(key)
        paths = [p for s in [*self.now.immutable, self.now.memtable] for p in self.now.segment_paths.get(s, [])]
        return self._entries([*paths, *self._paths(ids, lower, upper)], where)

    def get(self, key: bytes) -> bytes | None:
        own = Bound.included(key)
        rows = newest_rows(self.log(own, own, key)).filter(~is_tombstone()).collect()
        return bytes(rows[0]["value"]) if rows else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Live entries of the keys of a DataFrame; runs beyond the least and the largest of them aren't read."""
        wanted = keys.select(F.col("key").cast("binary")).distinct()
        least, most = wanted.agg(F.min("key"), F.max("key")).first()
        ends = (UNBOUNDED, UNBOUNDED) if least is None else (Bound.included(bytes(least)), Bound.included(bytes(most)))
        found = newest_rows(self.log(*ends).join(wanted, "key", "left_semi"))
        return found.filter(~is_tombstone()).select("key", "value")

    def scan(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, limit: int | None = None) -> DataFrame:
        """Live entries in key order. The DataFrame reads the files of this moment's snapshot."""
        out = newest_rows(self.log(lower, upper)).filter(~is_tombstone()).select("key", "value").orderBy("key")
        return out if limit is None else out.limit(limit)

    def catalog(self) -> DataFrame:
        """run_id, tier, level, pos, first_key, last_key, n, bytes."""
        levels = self.now.levels
        rows = [(i, "run", level, pos, bytearray.fromhex(r["first"]), bytearray.fromhex(r["last"]), r["n"], r["bytes"]) for level, ids in [(0, levels.level0), *sorted(levels.below.items())] for pos, i in enumerate(ids) for r in [self.now.runs[i]]]
        return self.spark.createDataFrame(rows, "run_id int, tier string, level int, pos int, first_key binary, last_key binary, n long, bytes long")

    def dump(self) -> dict[str, list[int]]:
        return {"mem": [self.now.memtable], "imm": list(self.now.immutable), "L0": list(self.now.levels.level0)} | {f"L{k}": list(v) for k, v in sorted(self.now.levels.below.items())}
