"""Queries over the driver's tables, each with SQL of the same result.

Keys and values are shown as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .functions.lines import parse_line
from .operators import history, merge, policies
from .plans import compaction
from .schema import type_name
from .scratch import new_path
from .sources.files import PendingFile, publish
from .sources.workload import generate
from .streaming.upsert import current, upsert

LOW, MID, HIGH = 500, 5_000, 1_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log: users are keys, events versions."""
    kind = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 7).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 6, "0")).cast("binary").alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        kind.alias("value_type"),
        F.coalesce(F.col("props"), F.lit("")).cast("binary").alias("value"),
        (F.col("event_id") % 4).cast("int").alias("source_id"),
    )


EVENTS = """entries AS (
  SELECT 'user' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_key, event_id + 1 AS seq,
         CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 7 WHEN 'purchase' THEN 2 ELSE 1 END AS value_type,
         coalesce(props, '') AS value, CAST(event_id % 4 AS INTEGER) AS source_id
  FROM events)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are keys, orders versions; a finished order is a deletion."""
    return _table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").cast("binary").alias("user_key"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("value_type"),
        F.col("o_orderpriority").cast("binary").alias("value"),
        F.lit(0).alias("source_id"),
    )


ORDERS = """entries AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS user_key, o_orderkey AS seq,
         CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS value_type, o_orderpriority AS value, 0 AS source_id
  FROM orders)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are keys, turns versions with long values."""
    return _table(spark, sf_dir, "conversations").select(
        F.lpad(F.col("conv_id").cast("string"), 9, "0").cast("binary").alias("user_key"),
        F.col("turn").alias("seq"),
        F.lit(1).alias("value_type"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("value"),
        F.lit(0).alias("source_id"),
    )


CONVERSATIONS = """entries AS (
  SELECT lpad(CAST(conv_id AS VARCHAR), 9, '0') AS user_key, turn AS seq, 1 AS value_type, coalesce(text, '') AS value, 0 AS source_id
  FROM conversations)"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats (key, sequence, type): the value decides."""
    value = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").cast("binary").alias("user_key"), F.col("l_linenumber").cast("long").alias("seq"), F.lit(1).alias("value_type"), value.cast("binary").alias("value"), F.lit(0).alias("source_id")
    )


LINE_ITEMS = """entries AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS user_key, CAST(l_linenumber AS BIGINT) AS seq, 1 AS value_type,
         concat_ws('|', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag, l_linestatus) AS value, 0 AS source_id
  FROM lineitem)"""


def shown(df: DataFrame) -> DataFrame:
    """Binary columns as strings, types as bigint."""
    return df.select(*(F.col(c).cast("string").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes))


def _entries(df: DataFrame) -> DataFrame:
    return shown(df.select("user_key", "seq", "value_type", "value"))


def _compact(source, policy) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _entries(compaction.compact(source(spark, d), policy, ordered=False))


def _sharded(shards: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _entries(compaction.compact_sharded(events(spark, d), shards))


class AtSnapshot:
    """The snapshot rule as a state machine, for the policy that Python decides."""

    def __init__(self, snapshot: int = MID) -> None:
        self.snapshot, self.done = snapshot, False

    def decide(self, seq: int, value_type: int, is_first: bool) -> bool:
        seen = seq <= self.snapshot and not self.done
        self.done |= seen
        return is_first or seen


def _written(spark: SparkSession, entries: DataFrame, files: int = 3, **options) -> str:
    path = new_path(spark, "sst")
    compaction.write_sst(entries, path, files, **options)
    return path


def sst_roundtrip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(compaction.read_sst(spark, _written(spark, events(spark, sf_dir))))


def sst_roundtrip_long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(compaction.read_sst(spark, _written(spark, conversations(spark, sf_dir), checksumType="XXH64")))


def sst_compact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files of entries, compacted by the offline job, read again."""
    entries = events(spark, sf_dir)
    inputs = [_written(spark, entries.where(F.col("source_id") == i), 1) for i in range(4)]
    out = new_path(spark, "sst")
    compaction.compact_files(spark, inputs, out, files=2)
    return _entries(compaction.read_sst(spark, out))


def sst_ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "sst")
    compaction.compact_files(spark, [_written(spark, events(spark, sf_dir))], out, for_ingest=True)
    return _entries(compaction.read_sst(spark, out))


def sst_pushdown_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, events(spark, sf_dir))
    return _entries(compaction.read_sst(spark, path, userKeyFrom=b"user000010".hex(), userKeyTo=b"user000020".hex()))


def sst_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one file: whether blocks follow each other without a gap from its first byte, and add up to what the properties say; the last separator."""
    path = _written(spark, events(spark, sf_dir), 1)
    blocks = compaction.read_sst(spark, path, view="blocks")
    ends = blocks.select("file_path", (F.col("block_no") + 1).alias("block_no"), (F.col("offset") + F.col("size") + 5).alias("before"))
    blocks = blocks.join(ends, ["file_path", "block_no"], "left").withColumn("before", F.coalesce("before", F.lit(0)))  # a window would put a file's blocks into one task
    data = compaction.read_sst(spark, path, view="properties").where("name = 'rocksdb.data.size'").select("file_path", F.col("number").cast("long").alias("data_size"))
    whole = blocks.groupBy("file_path").agg((F.count("*") > 1).alias("several"), F.bool_and(F.col("before") == F.col("offset")).alias("gapless"), F.sum(F.col("size") + 5).alias("bytes"), F.max_by(F.struct("last_user_key", "last_seq", "last_type"), "block_no").alias("last"))
    return shown(whole.join(data, "file_path").select("several", "gapless", (F.col("bytes") == F.col("data_size")).alias("adds_up"), "last.last_user_key", "last.last_seq", "last.last_type"))


def sst_append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the log, the second appended to the folder of the first."""
    path, entries = new_path(spark, "sst"), events(spark, sf_dir)
    for half in (0, 1):
        compaction.write_sst(entries.where(F.col("seq") % 2 == half), path, 2, "append")
    return _entries(compaction.read_sst(spark, path))


def sst_compressed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the log in each form of compression that is read."""
    entries = events(spark, sf_dir)
    paths = [_written(spark, entries.where(F.col("source_id") == i), 1, compression=kind) for i, kind in enumerate(("snappy", "lz4", "lz4hc", "zstd"))]
    return _entries(compaction.read_sst(spark, *paths))


def sst_crc32c_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with CRC32C sums, restart points far apart and an index of changes of size."""
    return _entries(compaction.read_sst(spark, _written(spark, conversations(spark, sf_dir), 1, checksumType="CRC32C", restartInterval=3, indexInterval=8)))


def sst_path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that a text file names, blank lines among them."""
    entries = events(spark, sf_dir)
    paths = [_written(spark, entries.where(F.col("source_id") % 2 == i), 1) for i in (0, 1)]
    folder = new_path(spark, "lists")
    file = PendingFile(folder, "inputs.txt")
    file.write("\n\n  ".join([*paths, ""]).encode())
    publish(*file.close())
    return _entries(compaction.read_sst(spark, pathList=f"{folder}/inputs.txt"))


def sst_ingest_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two properties that mark a file for ingestion."""
    out = new_path(spark, "sst")
    compaction.compact_files(spark, [_written(spark, events(spark, sf_dir))], out, for_ingest=True, files=1)
    stamps = compaction.read_sst(spark, out, view="properties").where("name like '%external_sst_file%'")
    return stamps.select("name", F.col("number").cast("long").alias("number"))


def generated_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every generated change log."""
    made = generate(spark, 5, 400)
    by_key = made.groupBy("user_key").agg(F.count("*").alias("versions"), F.max("seq").alias("newest"), F.count_if(keys.is_tombstone()).alias("deleted"), F.max("source_id").alias("source"))
    return by_key.agg(F.count("*").alias("keys"), (F.max("versions") <= 3).alias("versions_bounded"), F.bool_and(F.col("versions") == F.col("newest")).alias("sequences_fall"), (F.max("deleted") <= 1).alias("newest_alone_deleted"), (F.max("source") < 5).alias("sources_bounded"))


def streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream in four batches, newer versions in earlier ones, kept up to date."""
    folder, log = new_path(spark, "upsert"), new_path(spark, "log")
    for i in range(4):
        events(spark, sf_dir).where(F.col("source_id") == 3 - i).coalesce(1).write.mode("append").parquet(log)
    changes = spark.readStream.schema(spark.read.parquet(log).schema).option("maxFilesPerTrigger", 1).parquet(log)
    upsert(changes, f"{folder}/state", checkpoint=f"{folder}/checkpoint", buckets=8).start().awaitTermination()
    return _entries(current(changes, f"{folder}/state"))


def sst_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the files' properties, as statistics of the entries."""
    path = _written(spark, events(spark, sf_dir))
    by_name = compaction.read_sst(spark, path, view="properties").groupBy().pivot("name", ["rocksdb.num.entries", "rocksdb.raw.key.size", "rocksdb.raw.value.size"]).agg(F.sum("number"))
    return by_name.select(*(F.col(f"`{p}`").cast("long").alias(n) for p, n in (("rocksdb.num.entries", "entries"), ("rocksdb.raw.key.size", "raw_key_size"), ("rocksdb.raw.value.size", "raw_value_size"))))


def sst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, events(spark, sf_dir))
    files = compaction.read_sst(spark, path, view="files")
    return files.groupBy("magic", "format_version", "checksum_type").agg(F.max("context_checksum").alias("context_checksum"))


def sst_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, events(spark, sf_dir), 1)
    return compaction.read_sst(spark, path, view="meta").select("name", (F.col("offset") > 0).alias("found"))


def shard_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge.shard_boundaries(events(spark, sf_dir), 4))


def exact_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = compaction.compact_sharded(events(spark, sf_dir), 4, exact=True)
    return kept.groupBy(F.col("shard").cast("int").alias("shard")).agg(F.count("*").alias("entries"), F.min(F.col("user_key")).cast("string").alias("first_key"))


def internal_key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal keys made and taken apart by column functions."""
    key = keys.internal_key(F.col("user_key"), F.col("seq"), F.col("value_type"))
    made = events(spark, sf_dir).select(key.alias("k")).where(keys.is_well_formed(F.col("k")))
    return shown(made.select(keys.user_key(F.col("k")).alias("user_key"), keys.sequence(F.col("k")).alias("seq"), keys.value_type(F.col("k")).alias("value_type"), F.lower(F.hex("k")).alias("internal_key")))


def _rank(*order) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: shown(merge.numbered(events(spark, d), *(f() for f in order)).select("user_key", "seq", F.col("place").cast("long").alias("place")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "merge_passthrough": lambda s, d: shown(merge.merge(*(events(s, d).where(F.col("source_id") == i) for i in range(4)))),
    "compact_bottommost": _compact(events, policies.Bottommost()),
    "compact_snapshot_low": _compact(events, policies.SnapshotAware(LOW)),
    "compact_snapshot_mid": _compact(events, policies.SnapshotAware(MID)),
    "compact_snapshot_high": _compact(events, policies.SnapshotAware(HIGH)),
    "compact_snapshots": _compact(events, policies.Snapshots((LOW, MID))),
    "compact_passthrough": _compact(events, policies.Passthrough()),
    "compact_naive_argmax": lambda s, d: shown(policies.newest_by_aggregate(events(s, d))),
    "compact_where_policy": _compact(events, policies.Where(lambda rank: (rank <= 2) & ~keys.is_tombstone())),
    "compact_ingest": lambda s, d: _entries(compaction.compact(events(s, d), ordered=False).withColumn("seq", F.lit(0).cast("long"))),
    "compact_orders": _compact(orders, policies.Bottommost()),
    "compact_orders_snapshot": _compact(orders, policies.SnapshotAware(MID)),
    "compact_conversations": _compact(conversations, policies.Bottommost()),
    "compact_ties": _compact(line_items, policies.Bottommost()),
    "compact_sharded_1": _sharded(1),
    "compact_sharded_4": _sharded(4),
    "compact_sharded_7": _sharded(7),
    "exact_shards": exact_shards,
    "applyinpandas_policy": _compact(events, policies.Stateful(AtSnapshot)),
    "tombstones": lambda s, d: _entries(policies.tombstones(events(s, d))),
    "visible_values": lambda s, d: _entries(policies.visible_values(events(s, d))),
    "type_names": lambda s, d: events(s, d).groupBy(type_name(F.col("value_type")).alias("type_name")).agg(F.count("*").alias("entries")),
    "version_stats": lambda s, d: shown(history.version_stats(events(s, d))),
    "run_stats": lambda s, d: history.run_stats(events(s, d)),
    "source_sizes": lambda s, d: merge.source_sizes(events(s, d)),
    "largest_source": lambda s, d: merge.largest_source(events(s, d)),
    "shard_boundaries": shard_boundaries,
    "lower_bound": lambda s, d: merge.lower_bound(events(s, d), b"user000075"),
    "internal_order_rank": _rank(),
    "bytewise_order_rank": _rank(lambda: keys.bytewise_order()[0]),
    "internal_key_codec": internal_key_codec,
    "as_of_read": lambda s, d: _entries(history.as_of(events(s, d), MID)),
    "key_history": lambda s, d: _entries(history.history(events(s, d), b"user000042")),
    "snapshot_diff": lambda s, d: shown(history.diff(events(s, d), LOW, MID)),
    "sst_roundtrip_scan": sst_roundtrip_scan,
    "sst_roundtrip_long_values": sst_roundtrip_long_values,
    "sst_compact_roundtrip": sst_compact_roundtrip,
    "sst_ingest_roundtrip": sst_ingest_roundtrip,
    "sst_pushdown_range": sst_pushdown_range,
    "sst_properties": sst_properties,
    "sst_files": sst_files,
    "sst_meta": sst_meta,
    "sst_blocks": sst_blocks,
    "sst_append_roundtrip": sst_append_roundtrip,
    "sst_compressed_roundtrip": sst_compressed_roundtrip,
    "sst_crc32c_roundtrip": sst_crc32c_roundtrip,
    "sst_path_list": sst_path_list,
    "sst_ingest_stamps": sst_ingest_stamps,
    "generated_workload": generated_workload,
    "streaming_upsert": streaming_upsert,
    "dump_lines": lambda s, d: compaction.dump(events(s, d)),
    "parse_dump_lines": lambda s, d: shown(compaction.dump(events(s, d)).select(parse_line(F.col("line")).alias("e")).select("e.user_key", "e.value")),
}

_COLUMNS = "user_key, seq, value_type, value"


def _newest(groups: str, condition: str = "rn = 1", where: str = "true", ties: str = "") -> str:
    return f"SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY seq DESC, value_type DESC{ties}) rn FROM entries WHERE {where}) WHERE {condition}"


_LIVE = "rn = 1 AND value_type NOT IN (0, 7)"
_BOTTOMMOST = _newest("user_key", _LIVE)
_AS_OF = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) rn FROM entries WHERE seq <= {}) WHERE rn = 1 AND value_type NOT IN (0, 7)"
_BOUNDS = """largest AS (SELECT source_id FROM entries GROUP BY source_id ORDER BY count(*) DESC, source_id DESC LIMIT 1),
ranked AS (SELECT user_key, row_number() OVER (ORDER BY user_key, seq DESC, value_type DESC) - 1 AS place, count(*) OVER () AS n FROM entries WHERE source_id = (SELECT source_id FROM largest)),
bounds AS (SELECT b AS boundary_no, user_key FROM range(1, 4) t(b), ranked WHERE place = b * n // 4)"""
_KEY = "lower(hex(user_key)) || printf('%02x', value_type)" + "".join(f" || printf('%02x', (seq >> {8 * i}) & 255)" for i in range(7))


def _over(view: str, sql: str, more: str = "") -> str:
    return f"WITH {view}{', ' + more if more else ''} {sql}"


ORACLE_SQL: dict[str, str] = {
    "merge_passthrough": _over(EVENTS, "SELECT * FROM entries"),
    "compact_bottommost": _over(EVENTS, _BOTTOMMOST),
    "compact_snapshot_low": _over(EVENTS, _newest(f"user_key, (seq <= {LOW})")),
    "compact_snapshot_mid": _over(EVENTS, _newest(f"user_key, (seq <= {MID})")),
    "compact_snapshot_high": _over(EVENTS, _newest(f"user_key, (seq <= {HIGH})")),
    "compact_snapshots": _over(EVENTS, _newest(f"user_key, (seq <= {LOW}), (seq <= {MID})")),
    "compact_passthrough": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries"),
    "compact_naive_argmax": _over(EVENTS, "SELECT user_key, v AS value FROM (SELECT user_key, arg_max(value, seq) AS v, arg_max(value_type, seq) AS t FROM entries GROUP BY user_key) WHERE t NOT IN (0, 7)"),
    "compact_where_policy": _over(EVENTS, _newest("user_key", "rn <= 2 AND value_type NOT IN (0, 7)")),
    "compact_ingest": _over(EVENTS, f"SELECT user_key, CAST(0 AS BIGINT) AS seq, value_type, value FROM ({_BOTTOMMOST})"),
    "compact_orders": _over(ORDERS, _BOTTOMMOST),
    "compact_orders_snapshot": _over(ORDERS, _newest(f"user_key, (seq <= {MID})")),
    "compact_conversations": _over(CONVERSATIONS, _BOTTOMMOST),
    "compact_ties": _over(LINE_ITEMS, _newest("user_key", _LIVE, ties=", value")),
    "compact_sharded_1": _over(EVENTS, _BOTTOMMOST),
    "compact_sharded_4": _over(EVENTS, _BOTTOMMOST),
    "compact_sharded_7": _over(EVENTS, _BOTTOMMOST),
    "exact_shards": _over(EVENTS, f"SELECT CAST((SELECT count(*) FROM bounds b WHERE b.user_key <= k.user_key) AS INTEGER) AS shard, count(*) AS entries, min(user_key) AS first_key FROM ({_BOTTOMMOST}) k GROUP BY 1", _BOUNDS),
    "applyinpandas_policy": _over(EVENTS, _newest(f"user_key, (seq <= {MID})")),
    "tombstones": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries WHERE value_type IN (0, 7)"),
    "visible_values": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries WHERE value_type = 1"),
    "type_names": _over(EVENTS, "SELECT CASE value_type WHEN 0 THEN 'Deletion' WHEN 1 THEN 'Value' WHEN 2 THEN 'Merge' ELSE 'SingleDeletion' END AS type_name, count(*) AS entries FROM entries GROUP BY 1"),
    "version_stats": _over(EVENTS, "SELECT user_key, count(*) AS versions, CAST(sum(CASE WHEN value_type IN (0, 7) THEN 1 ELSE 0 END) AS BIGINT) AS tombstones, max(seq) AS newest_seq, min(seq) AS oldest_seq, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM entries GROUP BY 1"),
    "run_stats": _over(EVENTS, "SELECT count(*) AS entries, CAST(sum(strlen(user_key) + 8) AS BIGINT) AS raw_key_size, CAST(sum(strlen(value)) AS BIGINT) AS raw_value_size FROM entries"),
    "source_sizes": _over(EVENTS, "SELECT source_id, count(*) AS entries FROM entries GROUP BY 1"),
    "largest_source": _over(EVENTS, "SELECT source_id, count(*) AS entries FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1"),
    "shard_boundaries": _over(EVENTS, "SELECT * FROM bounds", _BOUNDS),
    "lower_bound": _over(EVENTS, "SELECT source_id, CAST(sum(CASE WHEN user_key < 'user000075' THEN 1 ELSE 0 END) AS BIGINT) AS place FROM entries GROUP BY 1"),
    "internal_order_rank": _over(EVENTS, "SELECT user_key, seq, row_number() OVER (ORDER BY user_key, seq DESC, value_type DESC) - 1 AS place FROM entries"),
    "bytewise_order_rank": _over(EVENTS, f"SELECT user_key, seq, row_number() OVER (ORDER BY {_KEY}) - 1 AS place FROM entries"),
    "internal_key_codec": _over(EVENTS, f"SELECT user_key, seq, value_type, {_KEY} AS internal_key FROM entries"),
    "as_of_read": _over(EVENTS, f"SELECT {_COLUMNS} FROM ({_AS_OF.format(MID)})"),
    "key_history": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries WHERE user_key = 'user000042'"),
    "snapshot_diff": _over(
        EVENTS,
        f"SELECT coalesce(o.user_key, n.user_key) AS user_key, CASE WHEN o.seq IS NULL THEN 'added' WHEN n.seq IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS old_value, n.value AS new_value "
        f"FROM ({_AS_OF.format(LOW)}) o FULL JOIN ({_AS_OF.format(MID)}) n ON o.user_key = n.user_key WHERE o.seq IS DISTINCT FROM n.seq",
    ),
    "sst_roundtrip_scan": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries"),
    "sst_roundtrip_long_values": _over(CONVERSATIONS, f"SELECT {_COLUMNS} FROM entries"),
    "sst_compact_roundtrip": _over(EVENTS, _BOTTOMMOST),
    "sst_ingest_roundtrip": _over(EVENTS, f"SELECT user_key, CAST(0 AS BIGINT) AS seq, value_type, value FROM ({_BOTTOMMOST})"),
    "sst_pushdown_range": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries WHERE user_key BETWEEN 'user000010' AND 'user000020'"),
    "sst_properties": _over(EVENTS, "SELECT count(*) AS entries, CAST(sum(strlen(user_key) + 8) AS BIGINT) AS raw_key_size, CAST(sum(strlen(value)) AS BIGINT) AS raw_value_size FROM entries"),
    "sst_files": "SELECT '0x88e241b785f4cff7' AS magic, 7 AS format_version, 'XXH3' AS checksum_type, CAST(1 AS BIGINT) AS context_checksum",
    "sst_blocks": _over(EVENTS, "SELECT true AS several, true AS gapless, true AS adds_up, user_key AS last_user_key, seq AS last_seq, value_type AS last_type FROM entries ORDER BY user_key DESC, seq, value_type LIMIT 1"),
    "sst_append_roundtrip": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries"),
    "sst_compressed_roundtrip": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries"),
    "sst_crc32c_roundtrip": _over(CONVERSATIONS, f"SELECT {_COLUMNS} FROM entries"),
    "sst_path_list": _over(EVENTS, f"SELECT {_COLUMNS} FROM entries"),
    "sst_ingest_stamps": "SELECT * FROM (VALUES ('rocksdb.external_sst_file.version', CAST(2 AS BIGINT)), ('rocksdb.external_sst_file.global_seqno', CAST(0 AS BIGINT))) t(name, number)",
    "generated_workload": "SELECT CAST(400 AS BIGINT) AS keys, true AS versions_bounded, true AS sequences_fall, true AS newest_alone_deleted, true AS sources_bounded",
    "streaming_upsert": _over(EVENTS, _newest("user_key")),
    "sst_meta": "SELECT unnest(['rocksdb.index', 'rocksdb.properties']) AS name, true AS found",
    "dump_lines": _over(EVENTS, "SELECT user_key || ' ==> ' || value AS line FROM entries"),
    "parse_dump_lines": _over(EVENTS, "SELECT user_key, value FROM entries"),
}
