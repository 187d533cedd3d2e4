"""Queries of the point store's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import u64
from tideline.functions.u64 import to_signed
from tideline.operators import points as P
from tideline.plans.mutable import MutableStore, folded
from tideline.plans.routing import Index
from tideline.plans.store import PointStore, is_namespace
from tideline.registry import query, table
from tideline.sources import wire

# Addresses and times of the reads below.
ADDRESSES = (5473609170707715884, -5571291129980868804, 368, 434)
EXTENDED_ADDRESSES = tuple(a | 1 for a in ADDRESSES)
START, BOUNDARY, END = 1741000000000000000, 1741132800000000000, 1741500000000000000
KEYS = (293852600471826261, 293852600471826260, -1780756119666538875, 368)
ROLLOVER_BYTES = 24


def _words(addresses: tuple[int, ...]) -> list[int]:
    return [a % (1 << 64) for a in addresses]


def _u(x: str) -> str:
    """SQL of a word as a number."""
    return f"(CASE WHEN {x} < 0 THEN {x}::HUGEINT + 18446744073709551616 ELSE {x}::HUGEINT END)"


def _located(name: str, kind: str, parity: int) -> str:
    """SQL of a table's points of a kind with epoch and bucket."""
    return f"""
    SELECT p.*, i.epoch, CAST(({_u('p.address')} - {_u('p.address')} % 2) % i.n AS BIGINT) AS bucket
    FROM {name} p JOIN (
      SELECT epoch, n, lead(epoch) OVER (ORDER BY epoch) AS next, row_number() OVER (ORDER BY epoch) = 1 AS first
      FROM (SELECT epoch, arg_max(n_buckets, entry_seq) AS n FROM store_index WHERE kind = '{kind}' GROUP BY epoch)) i
    ON ({_u('p.time')} > i.epoch OR (i.first AND {_u('p.time')} = i.epoch)) AND (i.next IS NULL OR {_u('p.time')} <= i.next)
    WHERE (p.address & 1) = {parity}"""


def _first(columns: str, name: str, where: str) -> str:
    """SQL of the first written of each (address, time)."""
    return f"""SELECT address, time, {columns} FROM (
      SELECT *, row_number() OVER (PARTITION BY address, time ORDER BY seq) AS r FROM {name}
      WHERE address IS NOT NULL AND time IS NOT NULL AND {where}) WHERE r = 1"""


def _index(spark: SparkSession, sf: str, kind: str) -> Index:
    return Index.of_table(table(spark, sf, "store_index"), kind)


@query(_first("payload", "simple_points", f"address IN {ADDRESSES} AND time BETWEEN {START} AND {END}"))
def read_simple_range(spark: SparkSession, sf: str) -> DataFrame:
    return P.read(table(spark, sf, "simple_points"), START, END, _words(ADDRESSES))


@query(_first("payload", "simple_points", f"address IN {ADDRESSES} AND time BETWEEN {BOUNDARY} AND {END}"))
def read_boundary_start(spark: SparkSession, sf: str) -> DataFrame:
    """A read that starts on an epoch, through the routed partitions."""
    index = _index(spark, sf, "simple")
    return P.read(index.located(table(spark, sf, "simple_points")), BOUNDARY, END, _words(ADDRESSES), index=index)


@query(_first("payload", "simple_points", "(address & 1) = 0"))
def read_simple_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_written(P.of_kind(table(spark, sf, "simple_points"), False))


@query(_first("hex(payload) AS payload", "extended_points", f"address IN {EXTENDED_ADDRESSES} AND time BETWEEN {START} AND {END}"))
def read_extended_range(spark: SparkSession, sf: str) -> DataFrame:
    found = P.read(table(spark, sf, "extended_points"), START, END, _words(EXTENDED_ADDRESSES), extended=True)
    return found.withColumn("payload", F.hex("payload"))


@query("SELECT address, time, payload FROM simple_points WHERE false")
def read_empty_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return P.read(table(spark, sf, "simple_points"), 0, (1 << 64) - 1, [])


@query(f"SELECT seq, address, time, epoch, bucket FROM ({_located('simple_points', 'simple', 0)})")
def locate_points(spark: SparkSession, sf: str) -> DataFrame:
    points = P.of_kind(table(spark, sf, "simple_points"), False)
    return _index(spark, sf, "simple").located(points).select("seq", "address", "time", "epoch", "bucket")


_EPOCHS = f"""
SELECT epoch, n AS n_buckets FROM (
  SELECT epoch, arg_max(n_buckets, entry_seq) AS n FROM store_index WHERE kind = 'simple' GROUP BY epoch)
WHERE epoch < {END} AND epoch >= (SELECT max(epoch) FROM store_index WHERE kind = 'simple' AND epoch < {START})"""


@query(_EPOCHS)
def range_epochs(spark: SparkSession, sf: str) -> DataFrame:
    found = _index(spark, sf, "simple").in_range(START, END)
    return spark.createDataFrame([(to_signed(e), n) for e, n in found], "epoch long, n_buckets long")


@query(f"""
SELECT DISTINCT epoch, CAST(({_u('a')} - {_u('a')} % 2) % n_buckets AS BIGINT) AS bucket
FROM ({_EPOCHS}) CROSS JOIN (SELECT unnest({list(ADDRESSES)}) AS a)""")
def target_objects(spark: SparkSession, sf: str) -> DataFrame:
    found = _index(spark, sf, "simple").targets(START, END, _words(ADDRESSES))
    return spark.createDataFrame([(to_signed(e), b) for e, buckets in found for b in buckets], "epoch long, bucket long")


_SIZES = f"""
WITH s AS ({_located('simple_points', 'simple', 0)}), e AS ({_located('extended_points', 'extended', 1)})
SELECT 'simple' AS kind, epoch, bucket, count(*) AS n, CAST(24 * count(*) AS BIGINT) AS bytes
FROM (SELECT epoch, bucket FROM s UNION ALL SELECT epoch, bucket FROM e) GROUP BY epoch, bucket
UNION ALL
SELECT 'extended' AS kind, epoch, bucket, count(*) AS n, CAST(sum(8 + coalesce(octet_length(payload), 0)) AS BIGINT) AS bytes
FROM e GROUP BY epoch, bucket"""


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    both = (table(spark, sf, t) for t in ("simple_points", "extended_points"))
    return P.bucket_sizes(*both, _index(spark, sf, "simple"), _index(spark, sf, "extended"))


@query(_SIZES)
def bucket_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(spark, sf)


@query(f"""
SELECT epoch, bucket, bytes FROM ({_SIZES}) WHERE kind = 'simple' AND bytes > {ROLLOVER_BYTES}
AND epoch = (SELECT max(epoch) FROM store_index WHERE kind = 'simple')""")
def rollover_candidates(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf, "simple")
    sizes = _sizes(spark, sf).filter(F.col("kind") == "simple")
    return P.rollover_candidates(sizes, index, ROLLOVER_BYTES).select("epoch", "bucket", "bytes")


@query(f"""
SELECT seq, epoch, bucket, CAST(sum(8 + coalesce(octet_length(payload), 0)) OVER (PARTITION BY epoch, bucket ORDER BY seq)
       - 8 - coalesce(octet_length(payload), 0) AS BIGINT) AS off
FROM ({_located('extended_points', 'extended', 1)})""")
def extended_offsets(spark: SparkSession, sf: str) -> DataFrame:
    located = P.with_offsets(table(spark, sf, "extended_points"), _index(spark, sf, "extended"))
    return located.select("seq", "epoch", "bucket", "off")


@query("SELECT seq, hex(payload) AS payload FROM extended_points WHERE address IS NOT NULL AND time IS NOT NULL AND (address & 1) = 1")
def pointer_deref(spark: SparkSession, sf: str) -> DataFrame:
    """Pointers joined to the heap by object and offset."""
    located = P.with_offsets(table(spark, sf, "extended_points"), _index(spark, sf, "extended"))
    pointers, heap = located.select("seq", "epoch", "bucket", "off"), located.select("epoch", "bucket", "off", F.hex("payload").alias("payload"))
    return pointers.join(heap, ["epoch", "bucket", "off"]).select("seq", "payload")


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    simple, extended = (table(spark, sf, t).select("address", "time") for t in ("simple_points", "extended_points"))
    return simple.unionAll(extended)


_MIXED = "(SELECT address, time FROM simple_points UNION ALL SELECT address, time FROM extended_points)"


def _back(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x} - 18446744073709551616 ELSE {x} END AS BIGINT)"


@query(f"""
SELECT {_back('s')} AS latest_simple, {_back('e')} AS latest_extended FROM (
  SELECT coalesce(max({_u('time')}), 0) AS s, coalesce(max({_u('time')}) FILTER ((address & 1) = 1), 0) AS e
  FROM {_MIXED} WHERE address IS NOT NULL AND time IS NOT NULL)""")
def latest_times(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_times(_mixed(spark, sf))


@query(f"SELECT (address & 1) = 1 AS extended, count(*) AS n FROM {_MIXED} WHERE address IS NOT NULL GROUP BY 1")
def split_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_kinds(_mixed(spark, sf))


_LATEST = f"""
SELECT address, version, value FROM (
  SELECT address | 1 AS address, version, hex(value) AS value,
         row_number() OVER (PARTITION BY address | 1 ORDER BY {_u('version')} DESC, seq) AS r
  FROM mutable_entries WHERE address IS NOT NULL AND version IS NOT NULL)
WHERE r = 1"""


@query(_LATEST)
def mutable_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_per_key(table(spark, sf, "mutable_entries")).withColumn("value", F.hex("value"))


@query(f"SELECT k AS key, value FROM ({_LATEST}) JOIN (SELECT unnest({list(KEYS)}) AS k) ON address = k | 1")
def mutable_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Values of keys, of which two each are the same."""
    keys = spark.createDataFrame([(k, k | 1) for k in KEYS], "key long, address long")
    entries = table(spark, sf, "mutable_entries")
    # The filter on the raw address goes to the scan.
    own = entries.filter(F.col("address").isin(*{a for k in KEYS for a in (k | 1, k & ~1)}))
    return P.latest_per_key(own).join(keys, "address").select("key", F.hex("value").alias("value"))


@query("""
SELECT address | 1 AS address, count(*) - 1 AS version, hex(max(value)) AS value
FROM mutable_entries WHERE address IS NOT NULL AND value IS NOT NULL GROUP BY address | 1""")
def mutable_insert_with_max(spark: SparkSession, sf: str) -> DataFrame:
    return folded(table(spark, sf, "mutable_entries"), F.max).withColumn("value", F.hex("value"))


@query("""
SELECT address, time, payload, NULL AS data FROM simple_points WHERE address IS NOT NULL AND time IS NOT NULL AND payload IS NOT NULL
UNION ALL
SELECT address, time, NULL AS payload, coalesce(hex(payload), '') AS data FROM extended_points WHERE address IS NOT NULL AND time IS NOT NULL""")
def wire_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables to wire form and back."""
    blobs = [wire.blobs(table(spark, sf, t)) for t in ("simple_points", "extended_points")]
    decoded = wire.decode(blobs[0].unionAll(blobs[1]).withColumn("batch_id", F.lit(0).cast("long")))
    return decoded.select("address", "time", "payload", F.hex("data").alias("data"))


# Reads of the newest points, sizes of asked objects, pairs of objects.


@query(f"""
SELECT address, time, seq, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY {_u('time')} DESC, seq) AS r FROM simple_points
  WHERE address IS NOT NULL AND time IS NOT NULL) WHERE r <= 3""")
def newest_points(spark: SparkSession, sf: str) -> DataFrame:
    """The three newest points of every address."""
    return P.newest(table(spark, sf, "simple_points").select("address", "time", "seq"), 3)


_ASKED = f"""
SELECT kind, epoch, CAST(({_u('a')} - {_u('a')} % 2) % n AS BIGINT) AS bucket FROM (
  SELECT kind, epoch, arg_max(n_buckets, entry_seq) AS n FROM store_index GROUP BY kind, epoch) CROSS JOIN (SELECT unnest({list(ADDRESSES)}) AS a) GROUP BY ALL"""


@query(f"SELECT kind, epoch, bucket, coalesce(bytes, 0) AS bytes FROM ({_ASKED}) LEFT JOIN ({_SIZES}) USING (kind, epoch, bucket)")
def object_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the objects of some addresses in all epochs, 0 of those that do not exist."""
    asked = []
    for kind in ("simple", "extended"):
        for epoch, buckets in _index(spark, sf, kind).targets(0, (1 << 64) - 1, _words(ADDRESSES)):
            asked += [(kind, to_signed(epoch), b) for b in buckets]
    return P.sizes_at(_sizes(spark, sf), spark.createDataFrame(asked, "kind string, epoch long, bucket long"))


@query(f"""
SELECT epoch, bucket, s.bytes AS simple_bytes, e.bytes AS extended_bytes
FROM (FROM ({_SIZES}) WHERE kind = 'simple') s JOIN (FROM ({_SIZES}) WHERE kind = 'extended') e USING (epoch, bucket)""")
def object_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.object_pairs(_sizes(spark, sf))


@query("""
SELECT kind, epoch, arg_max(n_buckets, entry_seq) AS n_buckets FROM store_index GROUP BY kind, epoch
UNION ALL SELECT 'entry' AS kind, 1775606400000000000 AS epoch, 7 AS n_buckets""")
def index_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Both indexes and a single entry through their binary form."""
    rows = []
    for kind in ("simple", "extended"):
        rows += [(kind, to_signed(e), n) for e, n in Index.from_bytes(_index(spark, sf, kind).to_bytes() + b"cut").entries]
    (entry,) = Index.from_bytes(Index.of([(1775606400000000000, 7)]).to_bytes()).entries
    return spark.createDataFrame([*rows, ("entry", *entry)], "kind string, epoch long, n_buckets long")


@query("""
SELECT origin, coalesce(origin <> '' AND NOT contains(origin, '_') AND NOT contains(origin, '/') AND NOT starts_with(origin, '.'), false) AS valid, count(*) AS batches
FROM batches GROUP BY origin""")
def namespace_names(spark: SparkSession, sf: str) -> DataFrame:
    """Origins of batches and whether each may name a namespace."""
    return table(spark, sf, "batches").groupBy("origin", is_namespace(F.col("origin")).alias("valid")).agg(F.count("*").alias("batches"))


# Mixed batches in wire form.


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return wire.batch_blobs(table(spark, sf, "simple_points"), table(spark, sf, "extended_points"))


#: SQL of all records of both tables, which have no null but, of extended points, a null payload.
_RECORDS = """
(SELECT address, time, seq, payload, NULL AS data FROM simple_points WHERE address IS NOT NULL AND time IS NOT NULL AND payload IS NOT NULL AND seq IS NOT NULL
 UNION ALL SELECT address, time, seq, NULL, coalesce(payload, ''::BLOB) FROM extended_points WHERE address IS NOT NULL AND time IS NOT NULL AND seq IS NOT NULL)"""


@query(f"""
SELECT address, time, payload, hex(data) AS data, seq >> 32 AS batch_id, row_number() OVER (PARTITION BY seq >> 32 ORDER BY seq) - 1 AS position FROM {_RECORDS}""")
def wire_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Records of batches that hold points of both kinds, with their batch and position in it."""
    found = wire.decode(_batches(spark, sf)).withColumn("data", F.hex("data"))
    return found.withColumn("batch_id", F.shiftright("seq", 32)).withColumn("position", F.col("seq").bitwiseAND(F.lit((1 << 32) - 1))).drop("seq")


@query(_SIZES.replace("simple_points", "(FROM simple_points WHERE payload IS NOT NULL)"))
def group_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed batches decoded, located and added up by object."""
    found = wire.decode(_batches(spark, sf))
    return P.bucket_sizes(wire.simple_points(found), wire.extended_points(found), _index(spark, sf, "simple"), _index(spark, sf, "extended"))


def _mixed_store(spark: SparkSession, sf: str) -> PointStore:
    store = PointStore.temporary(spark, threshold=ROLLOVER)
    store.register("mixed", 6, 5)
    store.write_blobs("mixed", _batches(spark, sf))
    return store


@query(f"""
SELECT address, time, CAST(payload AS VARCHAR) AS payload FROM ({_first('payload', '(FROM simple_points WHERE payload IS NOT NULL)', '(address & 1) = 0')})
UNION ALL SELECT address, time, coalesce(hex(payload), '') FROM ({_first('payload', 'extended_points', '(address & 1) = 1')})""")
def store_write_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """All batches written to a store as blobs in one write, and the first written of every point read back."""
    store, found = _mixed_store(spark, sf), []
    for kind in ("simple", "extended"):
        addresses = table(spark, sf, f"{kind}_points").select("address")
        read = store.read_simple if kind == "simple" else store.read_extended
        rows = read("mixed", 0, (1 << 64) - 1, addresses)
        found.append(rows.withColumn("payload", F.col("payload").cast("string") if kind == "simple" else F.hex("payload")))
    return found[0].unionByName(found[1])


# A store whose epochs roll over: each kind is written in two parts, by time.

#: Bytes of an object beyond which the stores of these queries begin an epoch.
ROLLOVER = 1 << 14
_E, _L = f"{_u('time')} < {BOUNDARY}", f"{_u('time')} >= {BOUNDARY}"
#: SQL of the store after its four writes: places, index, sizes.
_STORE = f"""
s AS (SELECT *, {_u('time')} AS t, ({_u('address')} - {_u('address')} % 2) % 4 AS b FROM simple_points WHERE address IS NOT NULL AND time IS NOT NULL AND (address & 1) = 0),
x AS (SELECT *, {_u('time')} AS t, ({_u('address')} - {_u('address')} % 2) % 3 AS b, 8 + coalesce(octet_length(payload), 0) AS size
      FROM extended_points WHERE address IS NOT NULL AND time IS NOT NULL AND (address & 1) = 1),
e1 AS (SELECT max(t) AS epoch FROM s WHERE {_E} AND (SELECT max(n) FROM (SELECT 24 * count(*) AS n FROM s WHERE {_E} GROUP BY b)) > {ROLLOVER}),
sp AS (SELECT s.*, CASE WHEN t > epoch THEN epoch ELSE 0 END AS e FROM s, e1),
newest AS (SELECT coalesce(epoch, 0) AS epoch FROM e1),
touched AS (SELECT DISTINCT sp.b FROM sp, newest WHERE sp.e = newest.epoch AND {_L}),
e2 AS (SELECT max(t) AS epoch FROM s WHERE (SELECT max(n) FROM (
         SELECT 24 * count(*) AS n FROM sp, newest WHERE sp.e = newest.epoch AND b IN (FROM touched) GROUP BY b)) > {ROLLOVER}),
x2 AS (SELECT max(t) AS epoch FROM x WHERE (SELECT max(n) FROM (
         SELECT sum(size) AS n FROM x WHERE {_E} AND b IN (SELECT b FROM x WHERE {_L}) GROUP BY b)) > {ROLLOVER})"""


def _rolling_store(spark: SparkSession, sf: str) -> PointStore:
    store = PointStore.temporary(spark)
    store.register("points", 4, 3, threshold=ROLLOVER)
    for name in ("simple", "extended"):
        points = table(spark, sf, f"{name}_points")
        early = u64.between(F.col("time"), 0, BOUNDARY - 1)
        for part in (early, ~early):
            store.write("points", **{name: points.filter(part)})
    return store


@query(f"""WITH {_STORE}
SELECT 'simple' AS kind, {_back('epoch')} AS epoch, 4 AS n_buckets FROM (SELECT 0::HUGEINT AS epoch UNION FROM e1 UNION FROM e2) WHERE epoch IS NOT NULL
UNION ALL SELECT 'extended', {_back('epoch')}, 3 FROM (SELECT 0::HUGEINT AS epoch UNION FROM x2) WHERE epoch IS NOT NULL""")
def store_rollover(spark: SparkSession, sf: str) -> DataFrame:
    """The indexes of a registered namespace after writes that made its objects too large."""
    store = _rolling_store(spark, sf)
    rows = [(k, to_signed(e), n) for k in ("simple", "extended") for e, n in store.index("points", k).entries]
    return spark.createDataFrame(rows, "kind string, epoch long, n_buckets long")


@query(f"""WITH {_STORE}
SELECT 'simple' AS kind, {_back('e')} AS epoch, CAST(b AS BIGINT) AS bucket, count(*) AS n, CAST(24 * count(*) AS BIGINT) AS bytes
FROM (SELECT e::HUGEINT AS e, b FROM sp UNION ALL SELECT 0::HUGEINT, b FROM x WHERE {_E} UNION ALL
      SELECT CASE WHEN t > epoch THEN epoch ELSE 0 END, b FROM x, x2 WHERE {_L}) GROUP BY e, b
UNION ALL
SELECT 'extended', {_back('e')}, CAST(b AS BIGINT), count(*), CAST(sum(size) AS BIGINT)
FROM (SELECT CASE WHEN t > epoch THEN epoch ELSE 0 END AS e, b, size FROM x, x2) GROUP BY e, b""")
def describe_store(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of a store whose epochs rolled over."""
    return _rolling_store(spark, sf).describe("points")


@query(f"""
SELECT {_back('s')} AS latest_simple, {_back('e')} AS latest_extended FROM (
  SELECT greatest((SELECT coalesce(max({_u('time')}), 0) FROM simple_points WHERE address IS NOT NULL AND (address & 1) = 0), e) AS s, e
  FROM (SELECT coalesce(max({_u('time')}), 0) AS e FROM extended_points WHERE address IS NOT NULL AND (address & 1) = 1))""")
def store_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest times as the commits of four writes carry them on."""
    latest = _rolling_store(spark, sf).latest("points")
    return spark.createDataFrame([tuple(to_signed(latest[k]) for k in ("simple", "extended"))], "latest_simple long, latest_extended long")


@query(_first("payload", "simple_points", f"(address & 1) = 0 AND address IN {ADDRESSES}").replace("ORDER BY seq", f"ORDER BY {_L}, seq"))
def store_read_simple(spark: SparkSession, sf: str) -> DataFrame:
    """All simple points written to a store, and some addresses read back over all times and epochs."""
    return _rolling_store(spark, sf).read_simple("points", 0, (1 << 64) - 1, _words(ADDRESSES))


@query(_first("hex(payload) AS payload", "extended_points", f"address IN {EXTENDED_ADDRESSES} AND {_u('time')} BETWEEN {START} AND {END}"))
def store_read_extended(spark: SparkSession, sf: str) -> DataFrame:
    found = _rolling_store(spark, sf).read_extended("points", START, END, _words(EXTENDED_ADDRESSES))
    return found.withColumn("payload", F.hex("payload"))


@query("""
SELECT address, time, payload, seq, 1 + (CASE WHEN """ + _E + """ THEN 0 ELSE 1 END) AS version FROM simple_points
WHERE address IS NOT NULL AND time IS NOT NULL AND (address & 1) = 0""")
def store_points(spark: SparkSession, sf: str) -> DataFrame:
    """All points of a store as written, after its batches were merged into one."""
    store = _rolling_store(spark, sf)
    store.compact("points")
    return store.points("points").select("address", "time", "payload", "seq", "version")


@query(f"""WITH {_STORE},
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, time ORDER BY seq) AS r FROM sp WHERE address IN {ADDRESSES} AND t BETWEEN {START} AND {END}) WHERE r = 1 AND payload IS NOT NULL),
asked AS (SELECT b, min(i) AS i FROM (SELECT unnest(range({len(ADDRESSES)})) AS i, unnest([{', '.join(f'({w} - {w} % 2) % 4' for w in _words(ADDRESSES))}]) AS b) GROUP BY b)
SELECT e_rank AS epoch_place, b_rank AS bucket_place, row_number() OVER (PARTITION BY e_rank, b_rank ORDER BY t, {_u('address')}) AS position, address, time, payload
FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY e) AS INT) AS e_rank, CAST(dense_rank() OVER (ORDER BY i) AS INT) AS b_rank FROM first JOIN asked USING (b))""")
def store_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of a read: objects by epoch and by the first address that names them, points by time and address."""
    found = _rolling_store(spark, sf).located_chunks("points", START, END, _words(ADDRESSES))
    # Places are counted among chunks that have points; there are at most as many as objects.
    places = found.select("e", "b").distinct().collect()
    order = {k: {v: i + 1 for i, v in enumerate(sorted({r[k] for r in places}))} for k in ("e", "b")}
    known = spark.createDataFrame([(r.e, r.b, order["e"][r.e], order["b"][r.b]) for r in places], "e int, b int, epoch_place int, bucket_place int")
    at = Window.partitionBy("e", "b").orderBy(u64.order_key(F.col("time")), u64.order_key(F.col("address")))
    rows = found.withColumn("position", F.row_number().over(at)).join(F.broadcast(known), ["e", "b"])
    return rows.select("epoch_place", "bucket_place", "position", "address", "time", "payload")


# The store of keys.


def _keys(spark: SparkSession, sf: str) -> MutableStore:
    """All entries inserted in order of seq, then some keys set and merged one by one."""
    keys = MutableStore(PointStore.temporary(spark), "keys")
    keys.insert_many(table(spark, sf, "mutable_entries"))
    for k in _words(KEYS):
        keys.insert(k, b"set")
        keys.insert_with(lambda new, old: old + new, k, b"+")
    return keys


#: SQL of the same; two of KEYS each may be one key.
_SET = f"(SELECT k | 1 AS address, count(*) AS times FROM (SELECT unnest({list(KEYS)}) AS k) GROUP BY 1)"
_KEYS = f"""
SELECT address, coalesce(n, 0) + 2 * coalesce(times, 0) - 1 AS version, CASE WHEN times IS NULL THEN value ELSE hex('set+'::BLOB) END AS value
FROM (SELECT address | 1 AS address, count(*) AS n, hex(arg_max(value, seq)) AS value FROM mutable_entries WHERE address IS NOT NULL AND value IS NOT NULL GROUP BY 1)
FULL JOIN {_SET} USING (address)"""


@query(_KEYS)
def mutable_store_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).enumerate().withColumn("value", F.hex("value"))


@query(f"SELECT k AS key, value FROM (SELECT unnest({[*KEYS, 2, -2]}) AS k) LEFT JOIN ({_KEYS}) ON address = k | 1")
def mutable_store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Keys looked up one by one, two of them without a value."""
    keys = _keys(spark, sf)
    found = [(k, keys.lookup(k % (1 << 64))) for k in (*KEYS, 2, -2)]
    return spark.createDataFrame([(k, v.hex().upper() if v is not None else None) for k, v in found], "key long, value string")
