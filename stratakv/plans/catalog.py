"""Registered queries of the key-value engine and their DuckDB counterparts, over two logs: events (K) and orders (O).

Each query goes through the operators; the SQL states the same result on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.functions import sketch
from stratakv.functions.cache import cache_hits, reuse
from stratakv.model import UNBOUNDED, Bound, Options, Simple, events_log, orders_log
from stratakv.operators import blocks, compact, query, resolve, segment
from stratakv.plans import hash_sql
from stratakv.sources import scratch
from stratakv.sources.store import TRACK, KVStore, replayed

RUN = 1000  # entries of a run that the queries cut the log into
THRESHOLD, BLOCK, LIMIT = 1024, 256, 2
LOW, HIGH = "user_00010_01", "user_00099_03"  # keys that are there at every size

K = """k AS MATERIALIZED (
  SELECT event_id AS seq, printf('user_%05d_%02d', user_id, event_id % 7) AS key,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || props END AS value
  FROM events
)"""
R = """r AS MATERIALIZED (SELECT seq // 1000 AS run_id, key, arg_max(value, seq) AS value FROM k GROUP BY 1, 2)"""
RUNS = """c AS MATERIALIZED (
  SELECT run_id, min(key) AS first_key, max(key) AS last_key, count(*) AS n, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes
  FROM r GROUP BY run_id
)"""
LIVE = "SELECT key, arg_max(value, seq) AS value FROM {log} {where} GROUP BY key HAVING strlen(arg_max(value, seq)) > 0"
PACK = f"""s AS MATERIALIZED (
  SELECT run_id, key, strlen(key) + strlen(value) + 6 AS cost, row_number() OVER (PARTITION BY run_id ORDER BY key) AS i FROM r
),
p(run_id, i, key, cost, block_idx, entry_idx, held) AS (
  SELECT run_id, i, key, cost, CAST(0 AS BIGINT), CAST(0 AS BIGINT), cost FROM s WHERE i = 1
  UNION ALL
  SELECT s.run_id, s.i, s.key, s.cost, CASE WHEN held + s.cost + 2 > {BLOCK} THEN block_idx + 1 ELSE block_idx END,
    CASE WHEN held + s.cost + 2 > {BLOCK} THEN 0 ELSE entry_idx + 1 END, CASE WHEN held + s.cost + 2 > {BLOCK} THEN s.cost ELSE held + s.cost END
  FROM p JOIN s ON s.run_id = p.run_id AND s.i = p.i + 1
)"""
FREEZE = f"""s AS MATERIALIZED (SELECT seq, strlen(key) + strlen(value) AS size, row_number() OVER (ORDER BY seq) AS i FROM k),
f(i, seq, size, segment_id, held) AS (
  SELECT i, seq, size, CAST(0 AS BIGINT), size FROM s WHERE i = 1
  UNION ALL
  SELECT s.i, s.seq, s.size, CASE WHEN held >= {THRESHOLD} THEN segment_id + 1 ELSE segment_id END,
    CASE WHEN held >= {THRESHOLD} THEN s.size ELSE held + s.size END
  FROM f JOIN s ON s.i = f.i + 1
)"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query_of(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, key, value: the events log cut into runs of RUN entries, each resolved."""
    log = events_log(spark, sf_dir).withColumn("run_id", F.expr(f"seq div {RUN}"))
    return log.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"))


def run_catalog(runs_of: DataFrame) -> DataFrame:
    size = F.sum(F.octet_length("key") + F.octet_length("value"))
    return runs_of.groupBy("run_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"), size.alias("bytes"))


# reads

_HIT = "user_00042_00"


def _some_key(spark: SparkSession, sf_dir: str, deleted: bool) -> str | None:
    """The least key that is live, or that is deleted."""
    gone = F.octet_length("value") == 0
    return resolve.newest(events_log(spark, sf_dir)).filter(gone if deleted else ~gone).agg(F.min("key")).first()[0]


@query_of("get_hit", f"WITH {K}, l AS ({LIVE.format(log='k', where='')}) SELECT key, value FROM l WHERE key = (SELECT min(key) FROM l)")
def get_hit(spark, sf_dir):
    return query.get(events_log(spark, sf_dir), _some_key(spark, sf_dir, False))


@query_of("get_miss", f"WITH {K} {LIVE.format(log='k', where=chr(10) + '''WHERE key = 'user_99999_99' ''')}")
def get_miss(spark, sf_dir):
    return query.get(events_log(spark, sf_dir), "user_99999_99")


@query_of("get_deleted", f"WITH {K}, d AS (SELECT key FROM k GROUP BY key HAVING strlen(arg_max(value, seq)) = 0) {LIVE.format(log='k', where='WHERE key = (SELECT min(key) FROM d)')}")
def get_deleted(spark, sf_dir):
    return query.get(events_log(spark, sf_dir), _some_key(spark, sf_dir, True))


@query_of("multi_get", f"WITH {K} {LIVE.format(log='k', where='''WHERE key IN (SELECT printf('user_%05d_%02d', i, i % 7) FROM range(1000) AS t(i))''')}")
def multi_get(spark, sf_dir):
    keys = spark.range(1000).select(F.format_string("user_%05d_%02d", "id", F.col("id") % 7).alias("key"))
    return query.multi_get(events_log(spark, sf_dir), keys, few=True)


@query_of("multi_get_orders", "SELECT printf('order_%08d', o_orderkey) AS key, arg_max(o_orderstatus || ':' || o_orderpriority, o_orderkey) AS value FROM orders WHERE o_orderkey % 15 = 0 GROUP BY 1")
def multi_get_orders(spark, sf_dir):
    log = orders_log(spark, sf_dir)
    return query.multi_get(log, log.filter("seq % 15 = 0"), few=False)


_ENDS = {"i": (Bound.included, ">=", "<="), "e": (Bound.excluded, ">", "<"), "u": (lambda _: UNBOUNDED, None, None)}
for _a, (_lower, _from, _) in _ENDS.items():
    for _b, (_upper, _, _to) in _ENDS.items():
        _where = " AND ".join([*([f"key {_from} '{LOW}'"] if _from else []), *([f"key {_to} '{HIGH}'"] if _to else [])])
        query_of(f"scan_{_a}{_b}", f"WITH {K} " + LIVE.format(log="k", where=f"WHERE {_where}" if _where else ""))(lambda spark, sf_dir, lower=_lower, upper=_upper: query.scan(events_log(spark, sf_dir), lower(LOW), upper(HIGH)))


@query_of("scan_limit", f"WITH {K} {LIVE.format(log='k', where='')} ORDER BY key LIMIT 100")
def scan_limit(spark, sf_dir):
    return query.scan(events_log(spark, sf_dir), limit=100)


@query_of("history", f"WITH {K} SELECT seq, key, value FROM k WHERE key = (SELECT min(key) FROM k WHERE value <> '')")
def history(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return query.history(log, log.filter("value <> ''").agg(F.min("key")).first()[0])


@query_of("delete_absent", f"WITH {K} {LIVE.format(log='k', where='')}")
def delete_absent(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return query.scan(query.delete(log, spark.range(5).select((F.col("id") + 10**12).alias("seq"), F.format_string("absent_%d", "id").alias("key"))), ordered=False)


@query_of("put_overwrite", f"WITH {K}, n AS (SELECT * FROM k UNION ALL SELECT seq + 1000000000000, key, 'new' FROM k WHERE seq % 10 = 0) {LIVE.format(log='n', where='')}")
def put_overwrite(spark, sf_dir):
    log = events_log(spark, sf_dir)
    newer = log.filter("seq % 10 = 0").select((F.col("seq") + 10**12).alias("seq"), "key", F.lit("new").alias("value"))
    return query.scan(query.put(log, newer), ordered=False)


@query_of("raw_versions", f"WITH {K} SELECT key, arg_max(value, seq) AS value FROM k GROUP BY key")
def raw_versions(spark, sf_dir):
    return resolve.newest(events_log(spark, sf_dir))


@query_of("raw_versions_by_rank", f"WITH {K} SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM k GROUP BY key")
def raw_versions_by_rank(spark, sf_dir):
    return resolve.newest_by_rank(events_log(spark, sf_dir))


@query_of("tombstones", f"WITH {K} SELECT key FROM k GROUP BY key HAVING strlen(arg_max(value, seq)) = 0")
def tombstones(spark, sf_dir):
    return resolve.newest(events_log(spark, sf_dir)).filter(F.octet_length("value") == 0).select("key")


# merges


@query_of("kway_merge", f"WITH {K}, {R} SELECT key, arg_max(value, run_id) AS value FROM r GROUP BY key")
def kway_merge(spark, sf_dir):
    """All runs, however many, in one pass: a run's place in the order is a column."""
    return resolve.newest(runs(spark, sf_dir), "run_id")


_AB = "a AS (SELECT key, arg_max(value, seq) AS value FROM k WHERE seq % 3 = 0 GROUP BY key), b AS (SELECT key, arg_max(value, seq) AS value FROM k WHERE seq % 3 <> 0 GROUP BY key)"


@query_of("two_way_merge", f"WITH {K}, {_AB} SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)")
def two_way_merge(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.two_way_merge(resolve.newest(log.filter("seq % 3 = 0")), resolve.newest(log.filter("seq % 3 <> 0")))


@query_of("concat_disjoint", f"WITH {K} SELECT key, arg_max(value, seq) AS value FROM k GROUP BY key")
def concat_disjoint(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.concat([resolve.newest(log.filter(F.col("key") < HIGH)), resolve.newest(log.filter(F.col("key") >= HIGH))])


@query_of("concat_seek", f"WITH {K} SELECT key, arg_max(value, seq) AS value FROM k WHERE key >= '{LOW}' GROUP BY key")
def concat_seek(spark, sf_dir):
    return concat_disjoint(spark, sf_dir).filter(F.col("key") >= LOW)


@query_of("disjoint_check", f"WITH {K}, {R}, {RUNS} SELECT run_id, first_key <= last_key AND coalesce(lag(last_key) OVER (ORDER BY run_id) < first_key, true) AS ok FROM c")
def disjoint_check(spark, sf_dir):
    return resolve.disjoint_check(run_catalog(runs(spark, sf_dir)).withColumn("pos", F.col("run_id")))


# segments and blocks


def _frozen(spark, sf_dir):
    return segment.freeze(events_log(spark, sf_dir), THRESHOLD)


@query_of("freeze_segments", f"WITH RECURSIVE {K}, {FREEZE} SELECT seq, size, segment_id FROM f")
def freeze_segments(spark, sf_dir):
    return _frozen(spark, sf_dir)


@query_of("segment_sizes", f"WITH RECURSIVE {K}, {FREEZE} SELECT segment_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM f GROUP BY segment_id")
def segment_sizes(spark, sf_dir):
    return segment.segments(_frozen(spark, sf_dir))


@query_of(
    "flushable_segments",
    f"""WITH RECURSIVE {K}, {FREEZE}, g AS (SELECT segment_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM f GROUP BY segment_id)
SELECT *, CASE WHEN segment_id = max(segment_id) OVER () THEN 'mutable' WHEN segment_id > max(segment_id) OVER () - {LIMIT} THEN 'immutable' ELSE 'flushable' END AS state FROM g""",
)
def flushable_segments(spark, sf_dir):
    return segment.flushable(segment.segments(_frozen(spark, sf_dir)), LIMIT)


@query_of("memtable_sizes", f"WITH {K} SELECT seq // 1000 AS run_id, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM k GROUP BY 1")
def memtable_sizes(spark, sf_dir):
    return segment.entry_size(events_log(spark, sf_dir)).groupBy(F.expr(f"seq div {RUN}").alias("run_id")).agg(F.sum("size").alias("bytes"))


@query_of("run_catalog", f"WITH {K}, {R}, {RUNS} SELECT * FROM c")
def run_catalog_query(spark, sf_dir):
    return run_catalog(runs(spark, sf_dir))


@query_of("run_prune_range", f"WITH {K}, {R}, {RUNS} SELECT run_id FROM c WHERE first_key < '{HIGH}' AND last_key > '{LOW}'")
def run_prune_range(spark, sf_dir):
    return run_catalog(runs(spark, sf_dir)).filter((F.col("first_key") < HIGH) & (F.col("last_key") > LOW)).select("run_id")


@query_of("run_prune_point", f"WITH {K}, {R}, {RUNS} SELECT run_id FROM c WHERE '{_HIT}' BETWEEN first_key AND last_key")
def run_prune_point(spark, sf_dir):
    return run_catalog(runs(spark, sf_dir)).filter(F.lit(_HIT).between(F.col("first_key"), F.col("last_key"))).select("run_id")


def _packed(spark, sf_dir):
    return blocks.pack(runs(spark, sf_dir), BLOCK)


@query_of("block_pack", f"WITH RECURSIVE {K}, {R}, {PACK} SELECT run_id, key, cost, block_idx, entry_idx FROM p")
def block_pack(spark, sf_dir):
    return _packed(spark, sf_dir)


_INDEX = "SELECT run_id, block_idx, min(key) AS first_key, max(key) AS last_key, count(*) AS n, CAST(sum(cost) AS BIGINT) + 2 AS encoded_bytes FROM p GROUP BY run_id, block_idx"


@query_of("block_index", f"WITH RECURSIVE {K}, {R}, {PACK} {_INDEX}")
def block_index(spark, sf_dir):
    return blocks.block_index(_packed(spark, sf_dir))


@query_of("block_find", f"WITH RECURSIVE {K}, {R}, {PACK}, x AS ({_INDEX}) SELECT run_id, coalesce(max(block_idx) FILTER (WHERE first_key <= '{_HIT}'), 0) AS block_idx FROM x GROUP BY run_id")
def block_find(spark, sf_dir):
    return blocks.find_block(blocks.block_index(_packed(spark, sf_dir)), _HIT)


@query_of("block_seek", f"WITH {K}, {R} SELECT run_id, min(key) AS key, arg_min(value, key) AS value FROM r WHERE key >= '{_HIT}' GROUP BY run_id")
def block_seek(spark, sf_dir):
    return blocks.seek(runs(spark, sf_dir), _HIT)


@query_of("block_sizes", f"WITH {K}, {R} SELECT run_id, CAST(sum(strlen(key) + strlen(value) + 6) + 2 AS BIGINT) AS encoded_bytes FROM r GROUP BY run_id")
def block_sizes(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("run_id").agg(blocks.encoded_size().alias("encoded_bytes"))


@query_of("block_checksums", f"WITH {K}, {R}, {hash_sql.CRC} SELECT run_id, key, {hash_sql.crc32('(key || value)')} AS crc FROM r, crc")
def block_checksums(spark, sf_dir):
    return blocks.with_checksum(runs(spark, sf_dir)).select("run_id", "key", "crc")


# compaction


def _levels(spark, sf_dir) -> compact.Levels:
    """Runs of the events log dealt over levels: the newest half in level 0, the rest in level 1."""
    ids = sorted(r[0] for r in runs(spark, sf_dir).select("run_id").distinct().collect())
    half = len(ids) // 2
    return compact.Levels(ids[half:], {1: ids[:half], 2: [], 3: []})


_SIZES = "sizes(level, n) AS (SELECT 0, count(*) FILTER (WHERE run_id > h) FROM c, half UNION ALL SELECT 1, count(*) FILTER (WHERE run_id <= h) FROM c, half UNION ALL SELECT 2, 0 UNION ALL SELECT 3, 0)"
_HALF = "half AS (SELECT coalesce(max(run_id), -1) AS h FROM (SELECT run_id, row_number() OVER (ORDER BY run_id) AS i, count(*) OVER () AS n FROM c) WHERE i <= n // 2)"


@query_of(
    "compact_pick",
    f"""WITH {K}, {R}, {RUNS}, {_HALF}, {_SIZES},
steps AS (SELECT level, n, lead(n) OVER (ORDER BY level) AS below FROM sizes)
SELECT CAST(level AS BIGINT) AS upper_level, CAST(level + 1 AS BIGINT) AS lower_level, n AS upper_files, below AS lower_files, level + 1 = 3 AS is_bottom
FROM steps WHERE level < 3 AND n > 0 AND (level > 0 OR n >= 2) AND 100.0 * below / n < 200 ORDER BY level LIMIT 1""",
)
def compact_pick(spark, sf_dir):
    task = compact.pick(_levels(spark, sf_dir), Simple(200, 2, 3))
    rows = [(task.upper_level or 0, task.lower_level, len(task.upper_ids), len(task.lower_ids), task.is_bottom)] if task else []
    return spark.createDataFrame(rows, "upper_level long, lower_level long, upper_files long, lower_files long, is_bottom boolean")


@query_of(
    "compact_apply",
    f"""WITH {K}, {R}, {RUNS}, {_HALF}
SELECT CAST(1 AS BIGINT) AS level, 1000 + i AS run_id FROM range(3) AS t(i)
UNION ALL SELECT 0, max(run_id) + 1 FROM c""",
)
def compact_apply(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    task = compact.Task(None, tuple(levels.level0), 1, tuple(levels.below[1]), False)
    meanwhile = compact.Levels([*levels.level0, max(levels.all_ids()) + 1], levels.below)
    after, _ = compact.apply_result(meanwhile, task, [1000, 1001, 1002])
    rows = [(0, i) for i in after.level0] + [(k, i) for k, ids in after.below.items() for i in ids]
    return spark.createDataFrame(rows, "level long, run_id long")


@query_of("compact_l0_l1", f"WITH {K}, {R}, {RUNS}, {_HALF} SELECT key, arg_max(value, run_id) AS value FROM r GROUP BY key")
def compact_l0_l1(spark, sf_dir):
    """Both levels in one pass, as the store does it: the later run wins, whichever level it is in."""
    return compact.merge_entries(runs(spark, sf_dir), False, ("run_id",)).select("key", "value")


@query_of("compact_mid", f"WITH {K}, {_AB} SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)")
def compact_mid(spark, sf_dir):
    log = events_log(spark, sf_dir)
    upper, lower = resolve.newest(log.filter("seq % 3 = 0")), resolve.newest(log.filter("seq % 3 <> 0"))
    return compact.merge([upper], [lower], False, False)


@query_of("compact_bottom", f"WITH {K}, {_AB} SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)) WHERE strlen(value) > 0")
def compact_bottom(spark, sf_dir):
    log = events_log(spark, sf_dir)
    upper, lower = resolve.newest(log.filter("seq % 3 = 0")), resolve.newest(log.filter("seq % 3 <> 0"))
    return compact.merge([upper], [lower], False, True)


@query_of("compact_scan", f"WITH {K} {LIVE.format(log='k', where='')}")
def compact_scan(spark, sf_dir):
    """A scan after compaction to the bottom is the scan before it."""
    return compact.merge([resolve.newest(events_log(spark, sf_dir))], [], False, True)


@query_of("level_dump", f"WITH {K}, {R}, {RUNS}, {_HALF} SELECT CAST(run_id <= h AS BIGINT) AS level, string_agg(CAST(run_id AS VARCHAR), ',' ORDER BY run_id) AS runs FROM c, half GROUP BY 1")
def level_dump(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    rows = [(k, i, p) for k, ids in [(0, levels.level0), *levels.below.items()] for p, i in enumerate(ids)]
    dealt = spark.createDataFrame(rows, "level long, run_id long, pos int")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "run_id"))), lambda x: x["run_id"].cast("string"))
    return dealt.groupBy("level").agg(F.array_join(listed, ",").alias("runs"))


# recovery

_TRACKS = f"""g AS (SELECT DISTINCT segment_id AS id FROM f),
made AS (SELECT id FROM g), flushed AS (SELECT id FROM g WHERE id < (SELECT max(id) FROM g) - {LIMIT})"""


@query_of(
    "manifest_replay",
    f"""WITH RECURSIVE {K}, {FREEZE}, {_TRACKS}
SELECT id, 'memtable' AS kind FROM made WHERE id NOT IN (SELECT id FROM flushed)
UNION ALL SELECT id, 'level0' FROM flushed WHERE id NOT IN (SELECT id FROM flushed ORDER BY id LIMIT 3)
UNION ALL SELECT CAST(1000000 AS BIGINT), 'level1'""",
)
def manifest_replay(spark, sf_dir):
    """Tracks of the log's segments, a row or two each, written and replayed in plans; the driver sees four numbers."""
    path = scratch.folder(spark, "segments")
    _frozen(spark, sf_dir).select(F.col("segment_id").alias("id")).distinct().write.parquet(path)
    made = spark.read.schema("id long").parquet(path)
    last = made.agg(F.max("id")).first()[0]
    gone = made.filter(F.col("id") < F.lit(None if last is None else last - LIMIT).cast("long"))
    first = [r.id for r in gone.orderBy("id").limit(3).collect()]
    track = lambda df, place, kind, run: df.select(place.alias("place"), F.lit(kind).alias("type"), "id", run.cast("long").alias("run"), F.lit(None).cast("string").alias("task"), F.lit(None).cast("array<long>").alias("outputs"))
    merged = (1 << 62, "compact", None, None, compact.Task(None, tuple(first), 1, (), False).encode(), [1_000_000])
    tracks = track(made, F.col("id"), "create", F.lit(None)).unionByName(track(gone, F.col("id") + (1 << 61), "flush", F.col("id")))
    return replayed(tracks.unionByName(spark.createDataFrame([merged], TRACK)))


@query_of("wal_replay", f"WITH {K} SELECT key, arg_max(value, seq) AS value FROM k GROUP BY key")
def wal_replay(spark, sf_dir):
    """A log written with its checksums by one store and read, verified and resolved by the next to open it."""
    store = _store(spark)
    store.put(events_log(spark, sf_dir).withColumnRenamed("seq", "ord"))
    again = KVStore.open(spark, store.path, store.options)
    return _texts(resolve.newest_rows(again.log()))


# the store


def _store(spark: SparkSession, **options) -> KVStore:
    return KVStore.open(spark, scratch.folder(spark, "store"), Options(**{"run_size": 1 << 30, "strategy": Simple(200, 2, 2)} | options))


def _texts(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _batch(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """A third of the events log. Later puts win, whatever the entries' numbers."""
    return events_log(spark, sf_dir).filter(F.col("seq") % 3 == k).withColumnRenamed("seq", "ord")


def _flushed(spark: SparkSession, sf_dir: str, batches: int = 3, **options) -> KVStore:
    """A store with a run of level 0 for each batch."""
    store = _store(spark, **options)
    for k in range(batches):
        store.put(_batch(spark, sf_dir, k))
        store.force_freeze()
        store.force_flush()
    return store


_PUT_ORDER = "CAST(seq % 3 AS HUGEINT) * 1000000000000000 + seq"
P = f"p AS MATERIALIZED (SELECT seq % 3 AS batch, {_PUT_ORDER} AS place, key, value FROM k)"
_LIVE_PUTS = "SELECT key, arg_max(value, place) AS value FROM p {where} GROUP BY key HAVING strlen(arg_max(value, place)) > 0"
_THOUSAND = "WHERE key IN (SELECT printf('user_%05d_%02d', i, i % 7) FROM range(1000) AS t(i))"
_LAST = f"l AS MATERIALIZED ({_LIVE_PUTS.format(where='')})"


@query_of("store_put_get", f"WITH {K}, {P} {_LIVE_PUTS.format(where=_THOUSAND)}")
def store_put_get(spark, sf_dir):
    store = _store(spark)
    for k in range(3):
        store.put(_batch(spark, sf_dir, k))
    return _texts(store.multi_get(spark.range(1000).select(F.format_string("user_%05d_%02d", "id", F.col("id") % 7).alias("key"))))


@query_of("store_get", f"WITH {K}, {P}, {_LAST} SELECT key, value FROM l WHERE key = (SELECT min(key) FROM l) UNION ALL SELECT 'absent', NULL")
def store_get(spark, sf_dir):
    """Single gets past three runs' filters: a live key, and one that isn't there."""
    store = _flushed(spark, sf_dir)
    key = bytes(store.scan(limit=1).first()["key"])
    rows = [(k.decode(), None if v is None else v.decode()) for k, v in ((key, store.get(key)), (b"absent", store.get(b"absent")))]
    return spark.createDataFrame(rows, "key string, value string")


@query_of("store_delete", f"WITH {K}, {P}, {_LAST} SELECT key, value FROM l WHERE key NOT IN (SELECT key FROM k WHERE seq % 10 = 0)")
def store_delete(spark, sf_dir):
    store = _flushed(spark, sf_dir)
    store.delete(events_log(spark, sf_dir).filter("seq % 10 = 0").select("key").distinct().unionByName(spark.range(5).select(F.format_string("absent_%d", "id").alias("key"))))
    return _texts(store.scan())


@query_of("store_flush_scan", f"WITH {K}, {P} {_LIVE_PUTS.format(where=f"WHERE key >= '{LOW}' AND key < '{HIGH}'")}")
def store_flush_scan(spark, sf_dir):
    return _texts(_flushed(spark, sf_dir).scan(Bound.included(LOW.encode()), Bound.excluded(HIGH.encode())))


@query_of("store_compact_scan", f"WITH {K}, {P}, {_LAST} SELECT * FROM l")
def store_compact_scan(spark, sf_dir):
    """Two batches compacted into several runs of level 1, a third above them in level 0."""
    store = _flushed(spark, sf_dir, 2, run_size=64 << 10, memtable_limit=1)
    store.compact()
    store.put(_batch(spark, sf_dir, 2))
    store.maintain()
    return _texts(store.scan())


@query_of("store_full_compaction", f"WITH {K}, {P}, {_LAST} SELECT 2 AS level, count(*) AS n, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes, min(key) AS first_key, max(key) AS last_key FROM l")
def store_full_compaction(spark, sf_dir):
    """All levels as the last one, without deleted keys."""
    store = _flushed(spark, sf_dir)
    store.full_compaction()
    return store.catalog().groupBy("level").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first_key").cast("string").alias("first_key"), F.max("last_key").cast("string").alias("last_key"))


@query_of("store_reopen", f"WITH {K}, {P}, {_LAST} SELECT * FROM l")
def store_reopen(spark, sf_dir):
    """Two flushed batches and one that is only in the log, opened again."""
    store = _flushed(spark, sf_dir, 2)
    store.put(_batch(spark, sf_dir, 2))
    return _texts(KVStore.open(spark, store.path, store.options).scan())


@query_of("store_snapshot", f"WITH {K}, {P} {_LIVE_PUTS.format(where='WHERE batch < 2')}")
def store_snapshot(spark, sf_dir):
    """What two batches left, read after a third and a compaction."""
    store = _flushed(spark, sf_dir, 2)
    version = store.now.version
    store.put(_batch(spark, sf_dir, 2))
    store.compact()
    return _texts(KVStore.open(spark, store.path, store.options, version).scan())


@query_of(
    "store_prune",
    f"""WITH {K}, {P}, w AS (SELECT batch, key, arg_max(value, place) AS value FROM p GROUP BY 1, 2)
SELECT batch AS pos, min(key) AS first_key, max(key) AS last_key, count(*) AS n, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes,
  min(key) < '{HIGH}' AND max(key) >= '{LOW}' AS in_range, max(key) > 'user_00990_00' AS behind FROM w GROUP BY batch""",
)
def store_prune(spark, sf_dir):
    """Runs with what the store keeps of them, and whether it would read them for two ranges."""
    store = _flushed(spark, sf_dir)
    ranges = {"in_range": (Bound.included(LOW.encode()), Bound.excluded(HIGH.encode())), "behind": (Bound.excluded(b"user_00990_00"), UNBOUNDED)}
    out = store.catalog()
    for name, bounds in ranges.items():
        out = out.withColumn(name, F.col("run_id").isin(store.overlapping(*bounds)))
    return out.select(F.col("pos").cast("long").alias("pos"), F.col("first_key").cast("string").alias("first_key"), F.col("last_key").cast("string").alias("last_key"), "n", "bytes", *ranges)


@query_of("store_dump", "SELECT * FROM (VALUES ('mem', 1), ('imm', 1), ('L0', 0), ('L1', 0), ('L2', 1)) t(tier, n)")
def store_dump(spark, sf_dir):
    """Tiers after three batches, of which maintenance flushes two at a limit of two and compacts them as far as it goes."""
    store = _store(spark, memtable_limit=2)
    for k in range(3):
        store.put(_batch(spark, sf_dir, k))
        store.force_freeze()
    store.maintain()
    return spark.createDataFrame([(tier, len(ids)) for tier, ids in store.dump().items()], "tier string, n int")


# hashes, filters, cache


@query_of(
    "bloom_params",
    f"""WITH {K}, {R}, {RUNS}, m AS (SELECT run_id, n, CAST(floor(-n * ln(0.03) / pow(ln(2), 2)) AS BIGINT) AS m FROM c)
SELECT run_id, n, m, greatest(1, CAST(round((m // n) * ln(2)) AS BIGINT)) AS k FROM m""",
)
def bloom_params(spark, sf_dir):
    n = F.col("n")
    return run_catalog(runs(spark, sf_dir)).select("run_id", "n", sketch.total_bits_column(n).alias("m"), sketch.hash_count_column(n).alias("k"))


_POSITIONS = "list_transform(range(1, k + 1), lambda i: list_transform([(h % 4294967296 + CAST(i AS UHUGEINT) * (h // 4294967296)) % 4294967296], lambda x: CASE WHEN x < 2147483648 THEN CAST(x AS BIGINT) ELSE 4294967295 - CAST(x AS BIGINT) END)[1] % m)"


@query_of(
    "bloom_probe",
    f"""WITH {K}, {R}, {RUNS}, m AS (SELECT run_id, n, CAST(floor(-n * ln(0.03) / pow(ln(2), 2)) AS BIGINT) AS m FROM c),
f AS MATERIALIZED (SELECT run_id, m, greatest(1, CAST(round((m // n) * ln(2)) AS BIGINT)) AS k FROM m),
h AS MATERIALIZED (SELECT run_id, key, {hash_sql.murmur64("key")} AS h FROM r),
held AS MATERIALIZED (SELECT DISTINCT run_id, unnest({_POSITIONS}) AS bit FROM h JOIN f USING (run_id)),
asked AS MATERIALIZED (SELECT run_id, key, unnest({_POSITIONS}) AS bit FROM (SELECT run_id + 1 AS run_id, key, h FROM h) JOIN f USING (run_id))
SELECT run_id, key, bool_and(held.bit IS NOT NULL) AS maybe FROM asked LEFT JOIN held USING (run_id, bit) GROUP BY run_id, key""",
)
def bloom_probe(spark, sf_dir):
    """Every run's keys asked of the run after it."""
    every = runs(spark, sf_dir).select("run_id", "key")
    return sketch.probe(sketch.build(every), every.withColumn("run_id", F.col("run_id") + 1))


@query_of("bloom_members", f"WITH {K}, {R} SELECT run_id, key, true AS maybe FROM r")
def bloom_members(spark, sf_dir):
    """No filter misses a key of its own run."""
    every = runs(spark, sf_dir).select("run_id", "key")
    return sketch.probe(sketch.build(every), every)


@query_of("murmur64", f"WITH {K} SELECT seq, {hash_sql.signed(hash_sql.murmur64('key'), 64)} AS hash FROM k")
def murmur64(spark, sf_dir):
    return events_log(spark, sf_dir).select("seq", sketch.hash64("key").alias("hash"))


@query_of("murmur32", f"WITH {K} SELECT seq, {hash_sql.signed(hash_sql.murmur32('key'), 32)} AS hash FROM k")
def murmur32(spark, sf_dir):
    return events_log(spark, sf_dir).select("seq", sketch.hash32("key").alias("hash"))


@query_of("block_reuse", f"WITH {K} SELECT seq, seq // 1000 AS run_id, CAST(substr(key, 6, 5) AS BIGINT) // 8 AS block, seq - lag(seq) OVER (PARTITION BY seq // 1000, CAST(substr(key, 6, 5) AS BIGINT) // 8 ORDER BY seq) AS gap FROM k")
def block_reuse(spark, sf_dir):
    """Reads of a trace with the time since the block was last read: what a cache lives on."""
    block = F.expr("cast(substr(key, 6, 5) as bigint) div 8")
    return reuse(events_log(spark, sf_dir).select("seq", F.expr(f"seq div {RUN}").alias("run_id"), block.alias("block")))


CACHE_BLOCKS = 64


@query_of(
    "lru_hits",
    f"""WITH {K}, t AS MATERIALIZED (SELECT seq, seq // 1000 AS run_id, CAST(substr(key, 6, 5) AS BIGINT) // 8 AS block FROM k),
b AS MATERIALIZED (SELECT *, lag(seq) OVER (PARTITION BY run_id, block ORDER BY seq) AS before FROM t),
d AS (SELECT b.seq, count(DISTINCT x.block) AS others FROM b JOIN t x ON x.run_id = b.run_id AND x.seq > b.before AND x.seq < b.seq GROUP BY b.seq)
SELECT b.seq, b.run_id, b.block, before IS NOT NULL AND coalesce(others, 0) < {CACHE_BLOCKS} AS hit FROM b LEFT JOIN d USING (seq)""",
)
def lru_hits(spark, sf_dir):
    """Reads of each run's blocks through a cache of its own: hits are blocks with few others read since."""
    block = F.expr("cast(substr(key, 6, 5) as bigint) div 8")
    return cache_hits(events_log(spark, sf_dir).select("seq", F.expr(f"seq div {RUN}").alias("run_id"), block.alias("block")), CACHE_BLOCKS)


@query_of("signed_scan", f"WITH {K} {LIVE.format(log='k', where='')} ORDER BY key")
def signed_scan(spark, sf_dir):
    """The whole scan; ASCII keys sort alike by signed and by unsigned bytes."""
    return query.scan(events_log(spark, sf_dir), signed=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
