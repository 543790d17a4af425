"""The store's operators as queries over the driver tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import keys as K
from tidelog.functions.glob import matches, to_regex
from tidelog.operators import alerts, compaction, consensus, fold, metrics, reads, views, writes
from tidelog.schema import PUT
from tidelog.sources import adapters, wire

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOG = """log AS (SELECT 'user:' || user_id AS key, event_id + 1 AS seq, (CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)::TINYINT AS kind,
  CASE WHEN event_type <> 'error' THEN props END AS value, event_id // 7 AS batch_id, (event_id % 7)::INT AS batch_pos FROM events)"""
NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC) AS rn FROM log) WHERE rn = 1)"
CUR = f"{LOG}, {NEWEST}, cur AS (SELECT key, seq, value FROM newest WHERE kind = 1)"
COMMANDS = """c0 AS (SELECT event_id + 1 AS seq, 'user:' || user_id AS key, CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'SETXX' WHEN event_type = 'view' THEN 'SET'
  WHEN event_type = 'signup' THEN 'SETNX' WHEN event_type = 'click' THEN 'APPEND' WHEN event_type = 'purchase' THEN 'GETSET' ELSE 'DEL' END AS cmd, event_id FROM events),
c AS (SELECT seq, key, cmd, CASE WHEN cmd <> 'DEL' THEN 'e' || event_id END AS arg FROM c0)"""
EXISTENCE = """ex AS (SELECT *, CASE WHEN cmd = 'SETNX' THEN NOT present_before WHEN cmd = 'SETXX' THEN present_before ELSE true END AS applies FROM (
  SELECT *, coalesce(last_value(CASE WHEN cmd IN ('SET', 'SETNX', 'GETSET', 'APPEND', 'INCRBY') THEN true WHEN cmd = 'DEL' THEN false END IGNORE NULLS)
    OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS present_before FROM c))"""
SEGMENTS = f"""{EXISTENCE}, seg AS (SELECT *, sum(CASE WHEN cmd IN ('SET', 'SETNX', 'SETXX', 'GETSET', 'DEL') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS segment FROM ex WHERE applies)"""
COUNTERS = """c AS (SELECT event_id + 1 AS seq, 'cnt:' || user_id AS key, CASE event_type WHEN 'purchase' THEN 'INCRBY' WHEN 'signup' THEN 'SET' ELSE 'DEL' END AS cmd,
  CASE event_type WHEN 'purchase' THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) WHEN 'signup' THEN CASE WHEN event_id % 11 = 0 THEN 'none' ELSE '100' END END AS arg
  FROM events WHERE event_type IN ('purchase', 'signup', 'error'))"""
ORDERS = "log AS (SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderkey AS seq, 1 AS kind, o_orderstatus AS value FROM orders)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _events(spark, d) -> DataFrame:
    return adapters.read(spark, d, "events")


def _log(spark, d) -> DataFrame:
    return adapters.op_log(_events(spark, d))


def _orders(spark, d) -> DataFrame:
    return adapters.keyspace(adapters.read(spark, d, "orders"), "order", "o_orderkey", "o_orderstatus")


def _commands(spark, d) -> DataFrame:
    return adapters.command_log(_events(spark, d))


def _wanted(spark, d) -> DataFrame:
    """One asked-for key a customer, some twice, some absent."""
    c = adapters.read(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("bigint").alias("pos"), F.concat(F.lit("user:"), (F.col("c_custkey") * 7 % 400).cast("string")).alias("key"))


WANTED = "wanted AS (SELECT c_custkey::BIGINT AS pos, 'user:' || (c_custkey * 7 % 400) AS key FROM customer)"


# Views and reads


@query("current_view", f"WITH {CUR} SELECT key, seq, value FROM cur")
def _(spark, d):
    return views.current(_log(spark, d))


@query("as_of_snapshot", f"WITH {LOG.replace('FROM events', 'FROM events WHERE event_id + 1 <= 5000')}, {NEWEST} SELECT key, seq, value FROM newest WHERE kind = 1")
def _(spark, d):
    return views.as_of(_log(spark, d), 5000)


@query("version_history", f"WITH {LOG} SELECT key, seq, kind, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC, kind DESC)::BIGINT AS age FROM log")
def _(spark, d):
    age = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind"))).cast("bigint")
    return views.history(_log(spark, d)).select("key", "seq", "kind", "value", age.alias("age"))


@query("as_of_probes", f"""WITH {LOG}, {WANTED}, p AS (SELECT pos, key, (pos * 37 % 9000)::BIGINT AS snapshot FROM wanted)
SELECT p.pos, p.key, p.snapshot, CASE WHEN l.kind = 1 THEN l.value END AS value FROM p LEFT JOIN log l ON l.key = p.key
  AND l.seq = (SELECT max(seq) FROM log x WHERE x.key = p.key AND x.seq <= p.snapshot)""")
def _(spark, d):
    return views.as_of_many(_wanted(spark, d).withColumn("snapshot", F.col("pos") * 37 % 9000), _log(spark, d)).select("pos", "key", "snapshot", "value")


@query("point_get", f"WITH {CUR} SELECT key, value FROM cur WHERE key = 'user:42'")
def _(spark, d):
    return reads.get(_log(spark, d), "user:42")


@query("point_get_snapshot", f"WITH {LOG.replace('FROM events', 'FROM events WHERE event_id + 1 <= 3000')}, {NEWEST} SELECT key, value FROM newest WHERE kind = 1 AND key = 'user:17'")
def _(spark, d):
    return reads.get(_log(spark, d), "user:17", 3000)


@query("range_scan", f"WITH {ORDERS} SELECT key, value FROM log WHERE key >= 'order:000000000100' AND key < 'order:000000002000'")
def _(spark, d):
    return reads.scan(_orders(spark, d), "order:000000000100", "order:000000002000")


@query("range_scan_snapshot", f"WITH {LOG.replace('FROM events', 'FROM events WHERE event_id + 1 <= 4000')}, {NEWEST} SELECT key, value FROM newest WHERE kind = 1 AND key >= 'user:1' AND key < 'user:2'")
def _(spark, d):
    return reads.scan(_log(spark, d), "user:1", "user:2", snapshot=4000)


@query("full_scan", f"WITH {ORDERS} SELECT key, value, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS pos FROM log")
def _(spark, d):
    return reads.ranked(views.current(_orders(spark, d)).select("key", "value"), "key").select("key", "value", F.col("rank").alias("pos"))


@query("prefix_scan", f"WITH {CUR} SELECT key, value FROM cur WHERE starts_with(key, 'user:1')")
def _(spark, d):
    return reads.scan_prefix(_log(spark, d), "user:1")


@query("prefix_bound", "SELECT p_partkey, upper(hex(encode(p_brand))) AS prefix, upper(hex(encode(left(p_brand, length(p_brand) - 1) || chr(unicode(right(p_brand, 1)) + 1)))) AS bound FROM part")
def _(spark, d):
    part = adapters.read(spark, d, "part")
    brands = [r[0] for r in part.select("p_brand").distinct().collect()]  # brands are a handful
    bound = F.create_map(*[F.lit(x) for b in brands for x in (b, K.prefix_upper_bound(b.encode()).hex().upper())])
    return part.select("p_partkey", F.hex(F.encode("p_brand", "UTF-8")).alias("prefix"), bound[F.col("p_brand")].alias("bound"))


@query("keys_glob", f"WITH {CUR} SELECT key FROM cur WHERE regexp_full_match(key, 'user:1.*')")
def _(spark, d):
    return reads.keys(_log(spark, d), "user:1*")


@query("keys_class_glob", f"WITH {CUR} SELECT key FROM cur WHERE regexp_full_match(key, 'user:[1-3][^0-4].*')")
def _(spark, d):
    return reads.keys(_log(spark, d), "user:[3-1][^0-4]*")


@query("url_glob", "SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'http.*example\\.[cn].*', 's')")
def _(spark, d):
    p = adapters.read(spark, d, "pages")
    return p.where(matches(F.col("url"), "http*example.[cn]*")).select("page_id", "url")


@query("part_glob", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '.*[a-f].') AND starts_with(p_type, 'S')")
def _(spark, d):
    p = adapters.read(spark, d, "part")
    return p.where(matches(F.col("p_name"), "*[a-f]?") & matches(F.col("p_type"), "S*")).select("p_partkey")


@query("scan_pages", f"WITH {CUR}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM cur) SELECT (n // 37)::BIGINT AS page, (n % 37)::BIGINT AS pos, key FROM r")
def _(spark, d):
    return reads.pages(views.current(_log(spark, d)), 37)


@query("scan_match_page", f"WITH {CUR}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM cur WHERE key LIKE 'user:_5%') SELECT (n // 2)::BIGINT AS page, (n % 2)::BIGINT AS pos, key FROM r")
def _(spark, d):
    return reads.pages(views.current(_log(spark, d)), 2, "user:?5*")


@query("scan_page_after", f"WITH {CUR} SELECT key FROM cur WHERE key > 'user:12' ORDER BY key LIMIT 10")
def _(spark, d):
    live = views.current(_log(spark, d))
    return live.where(F.col("key") > "user:12").select("key").orderBy("key").limit(10)


@query("scan_limit", f"WITH {ORDERS} SELECT key, value FROM log WHERE key >= 'order:000000000500' ORDER BY key LIMIT 25")
def _(spark, d):
    return reads.scan(_orders(spark, d), "order:000000000500", limit=25)


@query("mget_positional", f"WITH {CUR}, {WANTED} SELECT pos, w.key, value FROM wanted w LEFT JOIN cur ON cur.key = w.key")
def _(spark, d):
    return reads.mget(_log(spark, d), _wanted(spark, d))


@query("exists_multiset", f"WITH {CUR}, {WANTED} SELECT count(*)::BIGINT AS n FROM wanted WHERE key IN (SELECT key FROM cur)")
def _(spark, d):
    return reads.exists(_log(spark, d), _wanted(spark, d))


@query("del_counts", f"WITH {CUR}, {WANTED} SELECT (SELECT count(*) FROM wanted WHERE key IN (SELECT key FROM cur))::BIGINT AS replied, (SELECT count(*) FROM wanted)::BIGINT AS tombstones, (SELECT count(*) FROM cur WHERE key NOT IN (SELECT key FROM wanted))::BIGINT AS left_over")
def _(spark, d):
    log = _log(spark, d)
    n, ops = reads.deletions(log, _wanted(spark, d), 10_000_000)
    after = views.current(log.select("key", "seq", "kind", "value").unionByName(ops)).agg(F.count("*"))
    return n.select(F.col("n").alias("replied"), ops.agg(F.count("*")).scalar().alias("tombstones"), after.scalar().alias("left_over"))


@query("strlen_bytes", f"WITH {CUR}, {WANTED} SELECT pos, w.key, coalesce(strlen(value), 0)::BIGINT AS n_bytes FROM wanted w LEFT JOIN cur ON cur.key = w.key")
def _(spark, d):
    return reads.strlen(_log(spark, d), _wanted(spark, d))


@query("type_of", f"WITH {CUR}, {WANTED} SELECT pos, w.key, CASE WHEN cur.key IS NULL THEN 'none' ELSE 'string' END AS type FROM wanted w LEFT JOIN cur ON cur.key = w.key")
def _(spark, d):
    return reads.types(_log(spark, d), _wanted(spark, d))


@query("dbsize_exact", f"WITH {CUR} SELECT count(*)::BIGINT AS n FROM cur")
def _(spark, d):
    return reads.dbsize(_log(spark, d))


@query("dbsize_upper_bound", "SELECT count(*)::BIGINT AS n FROM events")
def _(spark, d):
    return reads.dbsize_bound(_log(spark, d))


@query("size_limits", "SELECT doc_id, (strlen(text) BETWEEN 1 AND 65536) AS valid_key, (strlen(text) <= 67108864) AS valid_value FROM documents")
def _(spark, d):
    t = adapters.read(spark, d, "documents")
    return t.select("doc_id", K.valid_sizes(F.col("text"), F.lit("")).alias("valid_key"), (F.octet_length("text") <= 67108864).alias("valid_value"))


# Folds


@query("setnx_outcomes", f"WITH {COMMANDS}, {EXISTENCE} SELECT seq, key, applies::BIGINT AS reply FROM ex WHERE cmd = 'SETNX'")
def _(spark, d):
    return fold.setnx_replies(_commands(spark, d))


@query("set_xx_outcomes", f"WITH {COMMANDS}, {EXISTENCE} SELECT seq, key, CASE WHEN applies THEN 'OK' END AS reply FROM ex WHERE cmd = 'SETXX'")
def _(spark, d):
    return fold.set_xx_replies(_commands(spark, d))


@query("getset_previous", f"""WITH {COMMANDS.replace('SELECT seq, key, cmd, CASE', 'SELECT seq, key, cmd, CASE').replace('FROM c0)', "FROM c0 WHERE cmd <> 'APPEND')")}, {EXISTENCE},
s AS (SELECT seq, key, cmd, lag(arg) OVER (PARTITION BY key ORDER BY seq) AS reply FROM ex WHERE applies) SELECT seq, key, reply FROM s WHERE cmd = 'GETSET'""")
def _(spark, d):
    return fold.previous_values(_commands(spark, d))


@query("append_lengths", f"""WITH {COMMANDS}, {SEGMENTS}, l AS (SELECT *, sum(CASE WHEN cmd = 'DEL' THEN 0 ELSE strlen(arg) END) OVER (PARTITION BY key, segment ORDER BY seq) AS n FROM seg)
SELECT seq, key, n::BIGINT AS reply FROM l WHERE cmd = 'APPEND'""")
def _(spark, d):
    return fold.append_replies(_commands(spark, d))


@query("command_fold", f"""WITH {COMMANDS}, {SEGMENTS}, last AS (SELECT key, max(segment) AS segment FROM seg GROUP BY key)
SELECT key, string_agg(arg, '' ORDER BY seq) AS value FROM seg JOIN last USING (key, segment) GROUP BY key HAVING count(arg) > 0""")
def _(spark, d):
    return fold.fold(_commands(spark, d))


@query("counter_values", f"""WITH {COUNTERS}, {SEGMENTS},
t AS (SELECT *, max(CASE WHEN cmd = 'SET' AND arg = 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY key, segment) AS bad,
  sum(CASE WHEN cmd = 'DEL' THEN 0 ELSE coalesce(try_cast(arg AS BIGINT), 0) END) OVER (PARTITION BY key, segment ORDER BY seq) AS total FROM seg)
SELECT seq, key, CASE WHEN bad = 0 THEN total::BIGINT END AS reply, CASE WHEN bad = 1 THEN 'ERR value is not an integer or out of range' END AS error FROM t WHERE cmd = 'INCRBY'""")
def _(spark, d):
    return fold.counter_replies(adapters.counter_log(_events(spark, d)))


@query("counter_fold", f"""WITH {COUNTERS}, {SEGMENTS}, last AS (SELECT key, max(segment) AS segment FROM seg GROUP BY key),
t AS (SELECT key, max(CASE WHEN cmd = 'SET' AND arg = 'none' THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN cmd <> 'DEL' THEN try_cast(arg AS BIGINT) END) AS total, count(arg) AS n
  FROM seg JOIN last USING (key, segment) GROUP BY key)
SELECT key, CASE WHEN bad = 1 THEN 'none' ELSE CAST(total::BIGINT AS VARCHAR) END AS value FROM t WHERE n > 0""")
def _(spark, d):
    return fold.fold(adapters.counter_log(_events(spark, d)))


@query("counter_overflow", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 9223372036854775807 - l_partkey::HUGEINT + l_suppkey * 20 > 9223372036854775807
  ELSE false END AS overflows FROM lineitem""")
def _(spark, d):
    t = adapters.read(spark, d, "lineitem")
    start = F.lit((1 << 63) - 1) - F.col("l_partkey")
    return t.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 3 == 0, F.try_add(start, F.col("l_suppkey") * 20).isNull()).otherwise(False).alias("overflows"))


@query("parse_integers", "SELECT event_id, try_cast(props AS BIGINT) AS whole, CASE WHEN regexp_full_match(trim(left(props, 3)), '[+-]?[0-9]+') THEN try_cast(trim(left(props, 3)) AS BIGINT) END AS start FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", K.parse_integer(F.col("props")).alias("whole"), K.parse_integer(F.substring("props", 1, 3)).alias("start"))


@query("mset_last_wins", f"WITH {LOG} SELECT batch_id, key, arg_max(seq, batch_pos) AS seq, arg_max(kind, batch_pos) AS kind FROM log GROUP BY batch_id, key")
def _(spark, d):
    return writes.last_of_batch(_log(spark, d)).select("batch_id", "key", "seq", "kind")


@query("flushdb_tombstones", f"WITH {CUR} SELECT key, (row_number() OVER (ORDER BY key) + 999999)::BIGINT AS seq, 0::TINYINT AS kind FROM cur")
def _(spark, d):
    return writes.flush_tombstones(_log(spark, d), 1_000_000).select("key", "seq", "kind")


# Writes and maintenance


@query("batch_complete_only", f"WITH {LOG} SELECT key, seq, batch_id FROM log WHERE batch_id IN (SELECT batch_id FROM log GROUP BY batch_id HAVING count(*) = 7)")
def _(spark, d):
    return writes.complete_batches(_log(spark, d)).select("key", "seq", "batch_id")


@query("sequence_assignment", "SELECT l_orderkey AS batch_id, l_linenumber::BIGINT AS batch_pos, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) + 500)::BIGINT AS seq, l_partkey FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)")
def _(spark, d):
    t = adapters.read(spark, d, "lineitem")
    one = t.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    ops = one.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").cast("bigint").alias("batch_pos"), "x.l_partkey")
    return writes.sequenced(ops, 500).select("batch_id", "batch_pos", "seq", "l_partkey")


@query("group_commits", f"""WITH {LOG}, b AS (SELECT batch_id, row_number() OVER (ORDER BY batch_id) - 1 AS r FROM (SELECT DISTINCT batch_id FROM log)),
g AS (SELECT r // 1024 AS slot, count(*) AS batches FROM b GROUP BY 1) SELECT slot::BIGINT AS slot, batches::BIGINT AS batches FROM g""")
def _(spark, d):
    rows = writes.group_commit(_log(spark, d))
    return rows.groupBy(F.col("commit_id.__slot").cast("bigint").alias("slot")).agg(F.countDistinct("batch_id").alias("batches"))


@query("op_counters", f"WITH {LOG} SELECT count(*) FILTER (kind <> 0)::BIGINT AS writes, count(*) FILTER (kind = 0)::BIGINT AS deletes FROM log")
def _(spark, d):
    return writes.op_counts(_log(spark, d))


RETAIN = f"""{LOG}, m AS (SELECT *, CASE WHEN seq > 6000 THEN true ELSE row_number() OVER (PARTITION BY key, seq > 6000 ORDER BY seq DESC) = 1 AND kind = 1 END AS keep FROM log)"""


@query("compaction_retained", f"WITH {RETAIN} SELECT key, seq, kind, value FROM m WHERE keep")
def _(spark, d):
    return compaction.retained(_log(spark, d), 6000).select("key", "seq", "kind", "value")


@query("compaction_reclaimed", f"WITH {RETAIN} SELECT count(*)::BIGINT AS versions, coalesce(sum(strlen(key) + coalesce(strlen(value), 0)), 0)::BIGINT AS bytes FROM m WHERE NOT keep")
def _(spark, d):
    gone = compaction.marked(_log(spark, d), 6000).where("NOT keep")
    return gone.agg(F.count("*").alias("versions"), F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("bigint").alias("bytes"))


@query("tombstones_droppable", f"WITH {CUR} SELECT key, seq FROM newest WHERE kind = 0 AND seq <= 9990 AND key NOT IN (SELECT key FROM log WHERE seq > 9990) AND NOT (key BETWEEN 'user:3' AND 'user:5')")
def _(spark, d):
    deeper = spark.createDataFrame([("user:3", "user:5")], "min_key string, max_key string")
    return compaction.droppable_tombstones(_log(spark, d), 9990, deeper)


@query("oldest_visible", "SELECT least(min(event_id) + 100, max(event_id) + 1)::BIGINT AS seq FROM events")
def _(spark, d):
    log = _log(spark, d)
    return compaction.oldest_visible(log.agg((F.min("seq") + 99).alias("seq")), log)


MANIFEST_SQL = """tables AS (SELECT (p_size % 4)::INT AS level, 't' || p_partkey AS file, p_partkey AS file_number, (p_retailprice * 1000)::BIGINT AS file_size,
  lpad(CAST(p_partkey * 7 % 5000 AS VARCHAR), 6, '0') AS min_key, lpad(CAST(p_partkey * 7 % 5000 + p_size * 3 AS VARCHAR), 6, '0') AS max_key, p_size::BIGINT AS entry_count FROM part)"""


def _manifest(spark, d) -> DataFrame:
    pad = lambda c: F.lpad(c.cast("bigint").cast("string"), 6, "0")
    low = F.col("p_partkey") * 7 % 5000
    t = adapters.read(spark, d, "part")
    return t.select((F.col("p_size") % 4).cast("int").alias("level"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_partkey").alias("file_number"), F.round(F.col("p_retailprice") * 1000).cast("bigint").alias("file_size"), pad(low).alias("min_key"), pad(low + F.col("p_size") * 3).alias("max_key"), F.col("p_size").cast("bigint").alias("entry_count"))


@query("level_sizes", f"WITH {MANIFEST_SQL} SELECT level, count(*)::BIGINT AS tables, sum(file_size)::BIGINT AS bytes, sum(entry_count)::BIGINT AS entries, min(min_key) AS min_key, max(max_key) AS max_key FROM tables GROUP BY level")
def _(spark, d):
    return compaction.level_sizes(_manifest(spark, d))


@query("level_scores", f"WITH {MANIFEST_SQL} SELECT level, round(CASE WHEN level = 0 THEN count(*) / 4 ELSE sum(file_size) / (1000000 * pow(10, level - 1)) END, 6) AS score FROM tables GROUP BY level")
def _(spark, d):
    return compaction.level_scores(_manifest(spark, d), base=1_000_000).select("level", F.round("score", 6).alias("score"))


@query("level_pick", f"""WITH {MANIFEST_SQL}, s AS (SELECT level, CASE WHEN level = 0 THEN count(*) / 4 ELSE sum(file_size) / (1000000 * pow(10, level - 1)) END AS score FROM tables GROUP BY level)
SELECT level, round(score, 6) AS score FROM s WHERE score >= 1 ORDER BY s.score DESC, level LIMIT 1""")
def _(spark, d):
    return compaction.pick_level(_manifest(spark, d), base=1_000_000).select("level", F.round("score", 6).alias("score"))


@query("level_targets", "SELECT n_nationkey + 1 AS level, CASE WHEN n_nationkey < 12 THEN CAST(16777216 * CAST(power(10, n_nationkey) AS HUGEINT) AS VARCHAR) ELSE '9223372036854775807' END AS target FROM nation")
def _(spark, d):
    n = adapters.read(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("level"))
    return compaction.level_targets(n).select("level", F.col("target").cast("string").alias("target"))


@query("overlap_tables", f"WITH {MANIFEST_SQL} SELECT level, file FROM tables WHERE max_key >= '001000' AND min_key < '001500'")
def _(spark, d):
    return compaction.overlapping(_manifest(spark, d), "001000", "001500").select("level", "file")


@query("tables_for_key", f"WITH {MANIFEST_SQL} SELECT level, file FROM tables WHERE '002345' BETWEEN min_key AND max_key")
def _(spark, d):
    return compaction.may_contain(_manifest(spark, d), "002345").select("level", "file")


@query("compaction_inputs", f"""WITH {MANIFEST_SQL}, s AS (SELECT * FROM tables WHERE level = 1 ORDER BY file_number LIMIT 1)
SELECT 'source' AS role, level, file FROM s UNION ALL SELECT 'target', t.level, t.file FROM tables t, s WHERE t.level = 2 AND t.min_key <= s.max_key AND t.max_key >= s.min_key""")
def _(spark, d):
    return compaction.job_inputs(_manifest(spark, d), 1).select("role", "level", "file")


@query("search_order", f"""WITH {MANIFEST_SQL} SELECT file, (row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN -file_number END, CASE WHEN level > 0 THEN min_key END, file_number))::BIGINT AS place FROM tables""")
def _(spark, d):
    order = Window.partitionBy("level").orderBy(F.when(F.col("level") == 0, -F.col("file_number")), F.when(F.col("level") > 0, F.col("min_key")), "file_number")
    return compaction.search_order(_manifest(spark, d)).select("file", F.row_number().over(order).cast("bigint").alias("place"))


@query("orphan_files", f"WITH {MANIFEST_SQL} SELECT 't' || s_suppkey * 5 AS file FROM supplier WHERE 't' || s_suppkey * 5 NOT IN (SELECT file FROM tables WHERE level < 2)")
def _(spark, d):
    files = adapters.read(spark, d, "supplier").select(F.concat(F.lit("t"), (F.col("s_suppkey") * 5).cast("string")).alias("file"))
    return compaction.orphans(files, _manifest(spark, d).where("level < 2"))


@query("obsolete_files", f"""WITH {MANIFEST_SQL}, f AS (SELECT 't' || s_suppkey AS file, CASE WHEN s_nationkey % 2 = 0 THEN 'log' ELSE 'table' END AS sort, s_suppkey AS number FROM supplier)
SELECT file, sort FROM f WHERE (sort = 'table' AND file NOT IN (SELECT file FROM tables WHERE level = 3)) OR (sort = 'log' AND number < 20)""")
def _(spark, d):
    s = adapters.read(spark, d, "supplier")
    files = s.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("file"), F.when(F.col("s_nationkey") % 2 == 0, "log").otherwise("table").alias("sort"), F.col("s_suppkey").alias("number"))
    return compaction.obsolete(files, _manifest(spark, d).where("level = 3"), 20).select("file", "sort")


@query("newest_backup", "SELECT 'data.' || max(s_suppkey) AS file FROM supplier")
def _(spark, d):
    return compaction.newest_backup(adapters.read(spark, d, "supplier").select(F.concat(F.lit("data."), F.col("s_suppkey").cast("string")).alias("file")))


@query("live_bytes", f"WITH {CUR} SELECT sum(strlen(key) + strlen(value))::BIGINT AS live_bytes FROM cur")
def _(spark, d):
    return compaction.live_bytes(views.current(_log(spark, d)))


@query("stale_ratio", f"""WITH {CUR}, x AS (SELECT (SELECT sum(strlen(key) + strlen(value)) FROM cur) AS live, (SELECT sum(strlen(key) + coalesce(strlen(value), 0)) FROM log) AS data)
SELECT round(greatest(0, least(1, 1 - live / data)), 9) AS stale_ratio, (data >= 1000 AND 1 - live / data >= 0.5) AS compact FROM x""")
def _(spark, d):
    log = _log(spark, d)
    data = log.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))))
    stats = compaction.live_bytes(views.current(log)).withColumn("data_bytes", data.scalar())
    return compaction.should_compact(stats, minimum=1000).select(F.round(compaction.stale_ratio("live_bytes", "data_bytes"), 9).alias("stale_ratio"), "compact")


# Statistics


@query("hit_ratio", f"WITH {CUR}, {WANTED} SELECT count(value)::BIGINT AS hits, (count(*) - count(value))::BIGINT AS misses, round(count(value) / count(*), 9) AS rate FROM wanted w LEFT JOIN cur ON cur.key = w.key")
def _(spark, d):
    got = reads.mget(_log(spark, d), _wanted(spark, d)).agg(F.count("value").alias("hits"), F.count_if(F.col("value").isNull()).alias("misses"))
    return got.select("hits", "misses", F.round(metrics.ratio(F.col("hits"), F.col("misses")), 9).alias("rate"))


@query("latency_histogram", "SELECT event_type, le, count(*) FILTER (le IS NULL OR value / 100 <= le)::BIGINT AS n FROM events, (SELECT unnest([0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, NULL]::DOUBLE[]) AS le) GROUP BY event_type, le")
def _(spark, d):
    return metrics.histogram(_events(spark, d).withColumn("s", F.col("value") / 100), "s", ["event_type"])


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p99_9, count(value)::BIGINT AS n FROM events GROUP BY event_type")
def _(spark, d):
    return metrics.percentiles(_events(spark, d), "value", ["event_type"]).drop("mean")


@query("pooled_percentiles", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, count(value)::BIGINT AS n FROM events WHERE event_type IN ('view', 'click')")
def _(spark, d):
    e = _events(spark, d).select("event_type", "value")
    return metrics.pooled([e.where("event_type = 'view'"), e.where("event_type = 'click'")], "value", at=(0.5, 0.99)).drop("mean")


@query("mean_latency", "SELECT event_type, CAST(floor(sum(CAST(round(value * 1000) AS BIGINT)) / count(*)) AS BIGINT) AS mean_ticks, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def _(spark, d):
    return metrics.mean_ticks(_events(spark, d).withColumn("ticks", F.round(F.col("value") * 1000).cast("bigint")), "ticks", ["event_type"])


@query("throughput", "SELECT event_type, count(*)::BIGINT AS n, (max(event_id) - min(event_id))::DOUBLE AS seconds, round(coalesce(count(*) / nullif(max(event_id) - min(event_id), 0), 0), 9) AS per_second FROM events GROUP BY event_type")
def _(spark, d):
    """An operation a second is issued."""
    return metrics.throughput(_events(spark, d).withColumn("at", F.timestamp_seconds("event_id")), "at", ["event_type"]).withColumn("per_second", F.round("per_second", 9))


@query("engine_winner", """WITH a AS (SELECT event_type, quantile_disc(value, 0.5) FILTER (user_id % 2 = 0) AS x, quantile_disc(value, 0.5) FILTER (user_id % 2 = 1) AS y FROM events GROUP BY event_type)
SELECT event_type, CASE WHEN x < y THEN 'bitcask' WHEN x > y THEN 'lsm' ELSE 'tie' END AS winner,
  round(CASE WHEN greatest(x, y) = 0 THEN 0 WHEN least(x, y) = 0 THEN 'Infinity'::DOUBLE ELSE greatest(x, y) / least(x, y) END, 9) AS ratio FROM a""")
def _(spark, d):
    half = lambda k: F.when(F.col("user_id") % 2 == k, F.col("value"))
    e = _events(spark, d).select("event_type", half(0).alias("x"), half(1).alias("y"))
    a = e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("x"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y)").alias("y"))
    return a.select("event_type", metrics.winner(F.col("x"), F.col("y"), True).alias("winner"), F.round(metrics.advantage(F.col("x"), F.col("y")), 9).alias("ratio"))


@query("bloom_theory", "SELECT n_nationkey + 1 AS bits, greatest(1, least(30, floor(0.69 * (n_nationkey + 1))))::INT AS hashes, round(pow(1 - exp(-greatest(1, least(30, floor(0.69 * (n_nationkey + 1)))) / (n_nationkey + 1)), greatest(1, least(30, floor(0.69 * (n_nationkey + 1))))), 9) AS rate FROM nation")
def _(spark, d):
    n = adapters.read(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("bits"))
    hashes = F.greatest(F.lit(1), F.least(F.lit(30), F.floor(F.col("bits") * 0.69))).cast("int")
    return n.select("bits", hashes.alias("hashes"), F.round(metrics.bloom_expected(F.col("bits"), hashes), 9).alias("rate"))


@query("bloom_measured", "SELECT count(*)::BIGINT AS probes, true AS as_expected FROM orders")
def _(spark, d):
    """Even order keys are stored, odd ones probed: the measured rate is the expected one, give or take."""
    keys = adapters.read(spark, d, "orders").select(F.format_string("key:%012d", F.col("o_orderkey").cast("bigint") * 2).alias("key"))
    n = keys.count()
    words = metrics.bloom_filter(keys, "key", n, 10)
    probes = adapters.read(spark, d, "orders").select(F.format_string("key:%012d", F.col("o_orderkey").cast("bigint") * 2 + 1).alias("key"), F.lit(False).alias("present"))
    measured = metrics.false_positives(metrics.bloom_probe(probes, "key", words, n, 10))
    expected = metrics.expected_rate(10)
    slack = 5 / max(1, n)
    near = F.col("rate").between(0.5 * expected - slack, 1.5 * expected + slack)
    return measured.select((F.col("false_positives") + F.col("negatives")).alias("probes"), near.alias("as_expected"))


@query("bloom_no_false_negatives", "SELECT count(*)::BIGINT AS stored, 0::BIGINT AS missed FROM customer")
def _(spark, d):
    keys = adapters.read(spark, d, "customer").select(F.col("c_name").alias("key"))
    n = keys.count()
    got = metrics.bloom_probe(keys, "key", metrics.bloom_filter(keys, "key", n, 10), n, 10)
    return got.agg(F.count("*").alias("stored"), F.count_if(~F.col("maybe")).alias("missed"))


@query("humanised_sizes", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN printf('%.0f B', strlen(text)::DOUBLE) WHEN strlen(text) < 1048576 THEN printf('%.1f KiB', round(strlen(text) / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MiB', round(strlen(text) / 1048576.0::DOUBLE, 1)) END AS size FROM documents")
def _(spark, d):
    return adapters.read(spark, d, "documents").select("doc_id", K.humanised(F.octet_length("text")).alias("size"))


@query("deterministic_payload", "SELECT s_suppkey, left('key:' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || '|' || repeat('abcdefghijklmnopqrstuvwxyz', 5), 64) AS value FROM supplier")
def _(spark, d):
    s = adapters.read(spark, d, "supplier")
    return s.select("s_suppkey", K.payload(F.format_string("key:%012d", F.col("s_suppkey").cast("bigint")), 64).alias("value"))


@query("load_generator", "SELECT 'key:' || lpad(CAST(i AS VARCHAR), 12, '0') AS key, i + 1 AS seq FROM range(1000) t(i)")
def _(spark, d):
    return adapters.load_ops(spark, 1000, 32).select("key", "seq")


@query("churn_current", "SELECT 'key:' || lpad(CAST(i AS VARCHAR), 12, '0') AS key, (i + 1 + 200 * 9)::BIGINT AS seq FROM range(200) t(i)")
def _(spark, d):
    return views.current(adapters.churn_ops(spark, 200, 10, 64)).select("key", "seq")


@query("batch_sweep", "SELECT s.size::INT AS size, count(DISTINCT event_id // s.size)::BIGINT AS batches FROM events, (SELECT unnest([1, 10, 100, 1000]) AS size) s GROUP BY s.size")
def _(spark, d):
    log = _log(spark, d).select("key", "seq")
    out = [adapters.batch_sweep(log, n).agg(F.lit(n).alias("size"), F.countDistinct("batch_id").alias("batches")) for n in (1, 10, 100, 1000)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("record_checksums", """WITH RECURSIVE step AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc32 FROM b, tbl""")
def _(spark, d):
    """CRC-32 of each document's bytes, as records carry it."""
    return adapters.read(spark, d, "documents").select("doc_id", F.crc32(K.to_bytes(F.col("text"))).alias("crc32"))


@query("utf8_sizes", "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_points FROM documents")
def _(spark, d):
    return adapters.read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.length("text").cast("bigint").alias("n_points"))


@query("inline_requests", "SELECT conv_id, turn, len(list_filter(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t]+'), lambda x: x <> ''))::BIGINT AS n_args FROM conversations")
def _(spark, d):
    c = adapters.read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(wire.inline_arguments(F.col("text"))).cast("bigint").alias("n_args"))


@query("bulk_replies", "SELECT s_suppkey, '$' || strlen(s_name) || chr(13) || chr(10) || s_name || chr(13) || chr(10) AS reply FROM supplier")
def _(spark, d):
    return adapters.read(spark, d, "supplier").select("s_suppkey", wire.bulk(F.col("s_name")).alias("reply"))


@query("exposition", "SELECT event_type, 'tidelog_events{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def _(spark, d):
    e = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("value"))
    stats = e.select("event_type", F.lit("events").alias("name"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value")
    return metrics.exposition(stats).select(F.regexp_extract("line", 'type="([^"]*)"', 1).alias("event_type"), "line")


@query("info_section", "SELECT 'stats' AS section, event_type AS field, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY event_type")
def _(spark, d):
    rows = _events(spark, d).groupBy("event_type").agg(F.count("*").cast("string").alias("value")).select(F.lit("stats").alias("section"), F.col("event_type").alias("field"), "value")
    other = rows.select(F.lit("server").alias("section"), "field", "value")
    return metrics.info_rows(rows.unionByName(other), ["STATS"])


@query("command_gate", """SELECT event_id + 1 AS seq, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'ERR wrong number of arguments for ''get'' command' WHEN 'error' THEN 'ERR unknown command ''BAD'', with 1 arg(s)'
  WHEN 'signup' THEN CASE WHEN user_id % 2 = 1 THEN 'NOAUTH Authentication required.' END ELSE NULL END AS error FROM events""")
def _(spark, d):
    from tidelog.plans.facade import command_specs, gate

    kind = F.col("event_type")
    argv = F.when(kind == "view", F.array(F.lit("GET"), F.lit("k"))).when(kind == "click", F.array(F.lit("GET"))).when(kind == "error", F.array(F.lit("BAD"), F.lit("x"))).when(kind == "signup", F.array(F.lit("set"), F.lit("k"), F.lit("v"))).otherwise(F.array(F.lit("PING")))
    logged_in = ~((kind == "signup") & (F.col("user_id") % 2 == 1))
    commands = _events(spark, d).select((F.col("event_id") + 1).alias("seq"), argv.alias("argv"), logged_in.alias("logged_in"))
    return gate(commands, command_specs(spark)).select("seq", "error")


# Replication

PROGRESS = "p AS (SELECT event_type AS cluster, 'n' || user_id % 5 AS node, greatest(max(event_id - user_id * 3), 0)::BIGINT AS match_index FROM events GROUP BY 1, 2)"


def _progress(spark, d) -> DataFrame:
    return adapters.sample_progress(_events(spark, d))


def _committed(spark, d, outgoing: list[str]) -> DataFrame:
    at = _progress(spark, d).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("node", "match_index"))).alias("m"))
    names = lambda x: F.array(*[F.lit(n) for n in x]) if x else F.array().cast("array<string>")
    return at.select("cluster", consensus.commit_index(F.col("m"), names(["n0", "n1", "n2"]), names(outgoing)).alias("commit_index"))


@query("commit_index", f"WITH {PROGRESS} SELECT cluster, list_sort(list(match_index), 'DESC')[2] AS commit_index FROM p WHERE node IN ('n0', 'n1', 'n2') GROUP BY cluster")
def _(spark, d):
    return _committed(spark, d, [])


@query("joint_commit_index", f"""WITH {PROGRESS} SELECT cluster, least(list_sort(list(match_index) FILTER (node IN ('n0', 'n1', 'n2')), 'DESC')[2],
  list_sort(list(match_index) FILTER (node IN ('n2', 'n3', 'n4')), 'DESC')[2]) AS commit_index FROM p GROUP BY cluster""")
def _(spark, d):
    return _committed(spark, d, ["n2", "n3", "n4"])


@query("committed_current_term", f"""WITH {PROGRESS}, h AS (SELECT cluster, list_sort(list(match_index), 'DESC')[2] AS i FROM p WHERE node IN ('n0', 'n1', 'n2') GROUP BY cluster)
SELECT cluster, CASE WHEN i // 500 + 1 = 19 THEN greatest(i, 100) ELSE 100 END::BIGINT AS commit_index FROM h""")
def _(spark, d):
    p = _progress(spark, d)
    clusters = p.select("cluster").distinct()
    configs = clusters.select("cluster", F.array(F.lit("n0"), F.lit("n1"), F.lit("n2")).alias("voters"), F.array().cast("array<string>").alias("outgoing"))
    log = p.select("cluster", F.col("match_index").alias("index")).distinct().withColumn("term", (F.floor(F.col("index") / 500) + 1).cast("bigint"))
    terms = clusters.select("cluster", F.lit(19).cast("bigint").alias("term"), F.lit(100).cast("bigint").alias("commit_index"))
    return consensus.committed(p, configs, log, terms)


@query("quorum_sizes", "SELECT n_nationkey, ((n_nationkey + 1) // 2 + 1)::INT AS quorum FROM nation")
def _(spark, d):
    return adapters.read(spark, d, "nation").select("n_nationkey", consensus.quorum_size(F.sequence(F.lit(0), F.col("n_nationkey"))).alias("quorum"))


@query("quorum_subsets", """WITH s AS (SELECT i AS subset, list_filter(['a', 'b', 'c', 'd', 'e'], lambda x, k: (i >> (k - 1)) & 1 = 1) AS granted FROM range(32) t(i))
SELECT subset::BIGINT AS subset, len(list_intersect(granted, ['a', 'b', 'c'])) >= 2 AND len(granted) >= 3 AS quorum FROM s""")
def _(spark, d):
    every = F.array(*[F.lit(x) for x in "abcde"])
    granted = F.filter(every, lambda x, k: F.pmod(F.floor(F.col("subset") / F.pow(F.lit(2), k)), F.lit(2)) == 1)
    return spark.range(32).withColumnRenamed("id", "subset").select("subset", consensus.has_quorum(granted, every, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("quorum"))


@query("replication_lag", f"WITH {PROGRESS}, l AS (SELECT cluster, max(match_index) - 50 AS last FROM p GROUP BY cluster) SELECT cluster, node, greatest(0, last - match_index)::BIGINT AS lag FROM p JOIN l USING (cluster)")
def _(spark, d):
    p = _progress(spark, d)
    return consensus.replication_lag(p, p.groupBy("cluster").agg((F.max("match_index") - 50).alias("last_index")))


@query("needs_snapshot", f"WITH {PROGRESS}, s AS (SELECT cluster, min(match_index) + 20 AS snap FROM p GROUP BY cluster) SELECT cluster, node, match_index + 1 <= snap AS needs_snapshot FROM p JOIN s USING (cluster)")
def _(spark, d):
    p = _progress(spark, d)
    return consensus.needs_snapshot(p.withColumn("next_index", F.col("match_index") + 1), p.groupBy("cluster").agg((F.min("match_index") + 20).alias("snapshot_index")))


def _raft(spark, d) -> DataFrame:
    return adapters.sample_raft_log(_events(spark, d))


@query("log_matching_violations", "SELECT event_id + 1 AS index, event_id // 500 + 1 AS term FROM events WHERE event_id % 997 = 13 AND event_id <= (SELECT max(event_id) - 20 FROM events)")
def _(spark, d):
    return consensus.log_matching_violations(_raft(spark, d))


@query("log_match_probes", """WITH e AS (SELECT event_id + 1 AS index, event_id // 500 + 1 AS term FROM events), q AS (SELECT c_custkey::BIGINT AS index, (c_custkey // 400 + 1)::BIGINT AS term FROM customer)
SELECT q.index, q.term, CASE WHEN q.index = 0 THEN true WHEN q.index = 100 THEN q.term = 1 WHEN q.index < 100 THEN false ELSE coalesce(e.term = q.term, false) END AS matches FROM q LEFT JOIN e ON e.index = q.index""")
def _(spark, d):
    probes = adapters.read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("index"), (F.floor(F.col("c_custkey") / 400) + 1).cast("bigint").alias("term"))
    return consensus.log_matches(probes, _raft(spark, d).where("node = 'n0'"), 100, 1)


@query("follower_append", """WITH e AS (SELECT event_id + 1 AS index, event_id // 500 + 1 AS term FROM events),
i AS (SELECT index, CASE WHEN index <= 1500 THEN term ELSE term + 1 END AS term FROM e WHERE index > 900 AND index <= (SELECT max(index) - 20 FROM e)),
cut AS (SELECT min(e.index) AS cut FROM e JOIN i USING (index) WHERE e.term <> i.term)
SELECT index, term FROM e, cut WHERE cut IS NULL OR index < cut UNION ALL SELECT index, term FROM i, cut WHERE index >= cut""")
def _(spark, d):
    """The leader resends from entry 901 to a follower whose entries have other terms from 1501 on."""
    log = _raft(spark, d).select("node", "index", "term")
    incoming = log.where("node = 'n2' AND index > 900").select("index", F.when(F.col("index") <= 1500, F.col("term")).otherwise(F.col("term") + 1).alias("term"))
    return consensus.follower_append(log.where("node = 'n0'").select("index", "term"), incoming, 0)


@query("append_gaps", """WITH e AS (SELECT event_id + 1 AS index FROM events WHERE event_type <> 'error')
SELECT index FROM e WHERE index - 1 NOT IN (SELECT index FROM e) AND index > (SELECT min(index) FROM e)""")
def _(spark, d):
    """A log that lost its error events."""
    return consensus.append_gaps(_events(spark, d).where("event_type <> 'error'").select((F.col("event_id") + 1).alias("index")))


CONFIGS = "g AS (SELECT event_id + 1 AS index, ['n' || event_id % 5, 'n' || (event_id + 1) % 5, 'n' || (event_id + 2) % 5] AS voters, CASE WHEN event_id % 2 = 0 THEN ['n' || (event_id + 3) % 5] ELSE [] END AS outgoing, ['n' || (event_id * 2) % 5] AS learners FROM events WHERE event_id % 333 = 0 AND event_id % 500 <> 0)"


def _configs(spark, d) -> DataFrame:
    """A configuration from each entry of kind 2 of the replicated log."""
    name = lambda c: F.concat(F.lit("n"), F.pmod(c, F.lit(5)).cast("string"))
    e = F.col("index") - 1
    rows = _raft(spark, d).where("node = 'n0' AND entry_kind = 2")
    return rows.select("index", F.array(name(e), name(e + 1), name(e + 2)).alias("voters"), F.when(e % 2 == 0, F.array(name(e + 3))).otherwise(F.array().cast("array<string>")).alias("outgoing"), F.array(name(e * 2)).alias("learners"))


@query("latest_config", f"WITH {CONFIGS} SELECT index, array_to_string(voters, ',') AS voters FROM g WHERE index <= 7000 ORDER BY index DESC LIMIT 1")
def _(spark, d):
    got = consensus.latest_config(_raft(spark, d).where("node = 'n0'"), _configs(spark, d), 7000)
    return got.select("index", F.array_join("voters", ",").alias("voters"))


@query("config_members", f"WITH {CONFIGS} SELECT DISTINCT index, unnest(list_concat(list_concat(voters, outgoing), learners)) AS node FROM g")
def _(spark, d):
    return consensus.members(_configs(spark, d))


@query("invalid_configs", f"WITH {CONFIGS} SELECT index FROM g WHERE len(list_intersect(voters, learners)) > 0")
def _(spark, d):
    return consensus.invalid_configs(_configs(spark, d)).select("index")


@query("joint_complete", f"WITH {CONFIGS} SELECT index FROM g WHERE len(outgoing) > 0 AND index <= 5000")
def _(spark, d):
    return consensus.joint_complete(_configs(spark, d), 5000).select("index")


@query("may_campaign", f"WITH {CONFIGS} SELECT index, list_contains(list_concat(voters, outgoing), 'n3') AS may_campaign FROM g")
def _(spark, d):
    return consensus.may_campaign(_configs(spark, d), "n3")


@query("departed_peers", f"WITH {CONFIGS} SELECT index, len(list_filter(outgoing, lambda x: NOT list_contains(voters, x)))::BIGINT AS gone FROM g")
def _(spark, d):
    return _configs(spark, d).select("index", F.size(consensus.departed(F.col("outgoing"), F.col("voters"))).cast("bigint").alias("gone"))


@query("up_to_date_candidates", "SELECT event_id, (event_id // 500 + 1 > 10) OR (event_id // 500 + 1 = 10 AND user_id >= 50) AS granted FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", consensus.up_to_date(F.floor(F.col("event_id") / 500) + 1, F.col("user_id"), F.lit(10), F.lit(50)).alias("granted"))


@query("vote_decisions", """WITH r AS (SELECT 'v' || user_id % 7 AS voter, event_id AS seq, 'n' || event_id % 5 AS candidate, (event_id // 50 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END)::BIGINT AS term, value > 10 AS fresh FROM events),
a AS (SELECT *, term = max(term) OVER (PARTITION BY voter ORDER BY seq) AS cur FROM r),
f AS (SELECT *, first_value(CASE WHEN cur AND fresh THEN candidate END IGNORE NULLS) OVER (PARTITION BY voter, term ORDER BY seq ROWS UNBOUNDED PRECEDING) AS first FROM a)
SELECT voter, seq, coalesce(cur AND fresh AND first = candidate, false) AS granted FROM f""")
def _(spark, d):
    e = _events(spark, d)
    term = (F.floor(F.col("event_id") / 50) - F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).cast("bigint")
    requests = e.select(F.concat(F.lit("v"), (F.col("user_id") % 7).cast("string")).alias("voter"), F.col("event_id").alias("seq"), F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")).alias("candidate"), term.alias("term"), (F.col("value") > 10).alias("fresh"))
    return consensus.vote_decisions(requests)


@query("pre_votes", "SELECT event_id AS seq, (event_id // 50 >= 20) AND event_type <> 'error' AND value > 10 AS granted FROM events")
def _(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 50).alias("term"), F.lit(20).alias("own_term"), (F.col("event_type") == "error").alias("leader_alive"), (F.col("value") > 10).alias("fresh"))
    return consensus.pre_vote(e)


@query("snapshot_chunk_errors", """WITH c AS (SELECT user_id AS transfer, event_id AS seq, (event_id % 4) * 100 AS offset, 100 AS length FROM events),
l AS (SELECT *, lag("offset" + length) OVER (PARTITION BY transfer ORDER BY seq) AS e FROM c) SELECT transfer, seq, "offset" FROM l WHERE "offset" <> 0 AND coalesce(e, 0) <> "offset" """)
def _(spark, d):
    return consensus.chunk_errors(_events(spark, d).select(F.col("user_id").alias("transfer"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 * 100).alias("offset"), F.lit(100).alias("length")))


@query("snapshot_replace_deletes", f"WITH {CUR} SELECT key FROM cur WHERE key NOT IN (SELECT key FROM cur WHERE key LIKE 'user:1%')")
def _(spark, d):
    log = _log(spark, d).select("key", "seq", "kind", "value")
    image = views.current(log).where(F.col("key").startswith("user:1")).select("key", "value")
    return consensus.replace_by_snapshot(log, image, 1_000_000).where("kind = 0").select("key")


@query("snapshot_replaced_state", f"WITH {CUR} SELECT key, value FROM cur WHERE key LIKE 'user:1%'")
def _(spark, d):
    log = _log(spark, d).select("key", "seq", "kind", "value")
    image = views.current(log).where(F.col("key").startswith("user:1")).select("key", "value")
    return views.current(log.unionByName(consensus.replace_by_snapshot(log, image, 1_000_000))).select("key", "value")


@query("apply_prefix", "SELECT event_id + 1 AS index, event_id // 500 + 1 AS term FROM events WHERE event_id + 1 > 1000 AND event_id + 1 <= 2500")
def _(spark, d):
    return consensus.applied_prefix(_raft(spark, d).where("node = 'n0'"), 1000, 2500).select("index", "term")


@query("log_after_snapshot", "SELECT count(*)::BIGINT AS entries, (count(*) >= 3000) AS snapshot_due FROM events WHERE event_id + 1 > 4000")
def _(spark, d):
    kept = consensus.discard_prefix(_raft(spark, d).where("node = 'n0'"), 4000).agg(F.count("*").alias("log_entries"), F.lit(0).alias("log_bytes"))
    return consensus.snapshot_due(kept, entries=3000).select(F.col("log_entries").alias("entries"), "snapshot_due")


@query("lossy_network", """SELECT node, count(*)::BIGINT AS n FROM (SELECT 'n' || k AS node, event_id + 1 AS idx, event_id // 500 + 1 AS term FROM events, range(3) r(k)
  WHERE event_id <= (SELECT max(event_id) FROM events) - 10 * k) WHERE ('0x' || md5(concat_ws('|', node, idx, term, '3'))[1:8])::BIGINT >= 1073741824 GROUP BY node""")
def _(spark, d):
    """Entries that get through a network losing a quarter of them, by node."""
    return adapters.lossy(_raft(spark, d).select("node", "index", "term"), 0.25, 3).groupBy("node").agg(F.count("*").alias("n"))


@query("partitioned_network", """WITH m AS (SELECT 'n' || user_id % 5 AS source, 'n' || event_id % 5 AS target, event_id FROM events)
SELECT source, target, count(*)::BIGINT AS n FROM m WHERE ('0x' || md5(concat_ws('|', source, target, event_id, '9'))[1:8])::BIGINT >= 429496729
  AND source <> 'n4' AND target <> 'n4' AND (source IN ('n0', 'n1')) = (target IN ('n0', 'n1')) GROUP BY source, target""")
def _(spark, d):
    """Messages between five nodes when a tenth is lost, n4 is isolated, and n0 and n1 are cut off from n2 and n3."""
    e = _events(spark, d)
    m = e.select(F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")).alias("target"), "event_id")
    return adapters.lossy(m, 0.1, 9, ("n4",), (("n0", "n1"), ("n2", "n3"))).groupBy("source", "target").agg(F.count("*").alias("n"))


# Windows over metrics

METRICS = "m AS (SELECT event_id, ts, 'n' || user_id % 3 AS node, sum(1) OVER (PARTITION BY user_id % 3 ORDER BY event_id) % 50 AS v FROM events)"


def _counter(spark, d) -> DataFrame:
    """A counter a node that restarts after 50 events."""
    e = _events(spark, d).withColumn("node", F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")))
    n = F.row_number().over(Window.partitionBy("node").orderBy("event_id")) % 50
    return e.select(F.timestamp_seconds(F.col("event_id") * 60).alias("ts"), "node", F.lit("elections").alias("name"), F.create_map(F.lit("k"), F.lit("v")).alias("labels"), n.cast("double").alias("value"))


COUNTER = "m AS (SELECT event_id * 60 AS t, 'n' || user_id % 3 AS node, (row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) % 50)::DOUBLE AS v FROM events)"
INCREASE = f"""{COUNTER}, s AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS step FROM m WINDOW w AS (PARTITION BY node ORDER BY t)),
i AS (SELECT node, t, sum(step) OVER r - first_value(step) OVER r AS inc FROM s WINDOW r AS (PARTITION BY node ORDER BY t RANGE BETWEEN 600 PRECEDING AND CURRENT ROW))"""


@query("counter_increase", f"WITH {INCREASE} SELECT node, t::BIGINT AS t, inc AS increase FROM i")
def _(spark, d):
    return alerts.increase(_counter(spark, d), "elections", 600).select("node", F.col("ts").cast("bigint").alias("t"), "increase")


@query("alert_hold", f"""WITH {INCREASE}, b AS (SELECT node, t, inc > 3 AS is_on, max(CASE WHEN NOT (inc > 3) THEN t END) OVER (PARTITION BY node ORDER BY t) AS broken FROM i),
h AS (SELECT *, min(CASE WHEN is_on THEN t END) OVER (PARTITION BY node, broken) AS since FROM b) SELECT node, t::BIGINT AS t FROM h WHERE is_on AND t - since >= 600""")
def _(spark, d):
    rows = alerts.increase(_counter(spark, d), "elections", 600)
    return alerts.held(rows, F.col("increase") > 3, 600).select("node", F.col("ts").cast("bigint").alias("t"))


@query("metric_slope", f"WITH {COUNTER}, r AS (SELECT node, t, regr_slope(v, t) OVER (PARTITION BY node ORDER BY t RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS slope FROM m) SELECT node, t::BIGINT AS t, round(slope, 6) + 0.0 AS slope FROM r WHERE slope IS NOT NULL AND isfinite(slope)")
def _(spark, d):
    got = alerts.slope(_counter(spark, d), "elections", 900).where("slope IS NOT NULL AND NOT isnan(slope)")
    return got.select("node", F.col("ts").cast("bigint").alias("t"), (F.round("slope", 6) + 0.0).alias("slope"))


@query("sliding_rates", """WITH m AS (SELECT (event_id * 60)::BIGINT AS t, 'n' || user_id % 3 AS node FROM events), w AS (SELECT (t - t % 600 - k * 300 + CASE WHEN t % 600 >= 300 THEN 300 ELSE 0 END) AS start, node FROM m, range(2) r(k))
SELECT start::BIGINT AS start, node, count(*)::BIGINT AS n FROM w GROUP BY 1, 2""")
def _(spark, d):
    from tidelog.streaming.state import windowed_rates

    got = windowed_rates(_counter(spark, d), "10 minutes", "5 minutes")
    return got.select(F.col("window.start").cast("bigint").alias("start"), "node", "n")


# Streams


@query("stream_current_state", f"WITH {CUR} SELECT key, seq, value FROM cur")
def _(spark, d):
    """The log as a file stream, its newest versions kept in streaming state; equals the batch view."""
    from uuid import uuid4

    from tidelog.shared import shared_dir
    from tidelog.streaming import state

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    name = f"newest_{uuid4().hex}"
    out = f"{shared_dir(spark)}/{name}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    stream = state.newest_versions(adapters.op_log(events).select("key", "seq", "kind", "value")).writeStream.outputMode("complete").foreachBatch(put)
    stream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table").where(F.col("kind") == PUT).select("key", "seq", "value")


@query("tail_latency", """WITH b AS (SELECT event_id // 25 * 60 AS t, user_id % 3 AS node, event_type, le, count(*) FILTER (value / 100 <= le) AS n
  FROM events, (SELECT unnest([0.5, 2.0, 5.0, 10.0, 'Infinity'::DOUBLE]) AS le) GROUP BY ALL),
c AS (SELECT t, node, event_type, le, sum(n) OVER (PARTITION BY node, event_type, le ORDER BY t) AS v FROM b),
i AS (SELECT t, le, v - first_value(v) OVER (PARTITION BY node, event_type, le ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS d FROM c),
s AS (SELECT t, le, sum(d) AS n FROM i GROUP BY t, le),
r AS (SELECT t, le, n, 0.99 * max(n) OVER (PARTITION BY t) AS want, lag(le, 1, 0) OVER o AS low, lag(n, 1, 0) OVER o AS under FROM s WINDOW o AS (PARTITION BY t ORDER BY le)),
q AS (SELECT t, first(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * coalesce((want - under) / nullif(n - under, 0), 0) END ORDER BY le) AS x FROM r WHERE n >= want AND want > 0 GROUP BY t)
SELECT t::BIGINT AS t, round(x, 9) AS quantile FROM q""")
def _(spark, d):
    """The latency rule's figure: growth of each series' buckets over five minutes, summed over nodes by bound, then the quantile."""
    bounds = (0.5, 2.0, 5.0, 10.0)
    e = _events(spark, d).select(F.floor(F.col("event_id") / 25).alias("m"), (F.col("user_id") % 3).cast("string").alias("node"), "event_type", (F.col("value") / 100).alias("x"))
    counts = e.groupBy("m", "node", "event_type").agg(*[F.count_if(F.col("x") <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("b4"))
    pairs = F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, "+Inf"])])).alias("p")
    rows = counts.select("m", "node", "event_type", pairs).select("m", "node", F.create_map(F.lit("le"), F.col("p.le"), F.lit("type"), F.col("event_type")).alias("labels"), "p.n")
    series = Window.partitionBy("node", F.col("labels")["le"], F.col("labels")["type"]).orderBy("m")
    scraped = rows.select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), "node", F.lit("seconds_bucket").alias("name"), "labels", F.sum("n").over(series).cast("double").alias("value"))
    return alerts.quantile(scraped, "seconds_bucket", 0.99, 300).select(F.unix_seconds("ts").alias("t"), F.round("quantile", 9).alias("quantile"))


@query("glob_regexes", r"""SELECT * FROM (VALUES ('user:*', '(?s)\Auser\x{3a}.*\z'), ('k[a-c]', '(?s)\Ak[a-c]\z'), ('k?', '(?s)\Ak.\z'), ('[^x]*', '(?s)\A[^x].*\z'),
  ('a\*b', '(?s)\Aa\x{2a}b\z'), ('[]', '(?s)\A(?!)\z'), ('[^]', '(?s)\A.\z'), ('[z-a]x', '(?s)\A[a-z]x\z')) t(pattern, regex)""")
def _(spark, d):
    """Patterns and the regular expressions they become."""
    patterns = ["user:*", "k[a-c]", "k?", "[^x]*", "a\\*b", "[]", "[^]", "[z-a]x"]
    return spark.createDataFrame([(p, to_regex(p)) for p in patterns], "pattern string, regex string")


@query("config_pairs", "SELECT * FROM (VALUES ('maxmemory', '0'), ('maxmemory-policy', 'noeviction')) t(name, value)")
def _(spark, d):
    """CONFIG GET max*."""
    from tidelog.plans.facade import config_pairs

    return config_pairs(spark, d, "max*")


@query("config_all", "SELECT * FROM (VALUES ('maxmemory', '0'), ('maxmemory-policy', 'noeviction'), ('appendonly', 'yes'), ('save', ''), ('databases', '1'), ('engine', 'lsm'), ('sync-policy', 'interval'), ('dir', '/data')) t(name, value)")
def _(spark, d):
    from tidelog.plans.facade import config_pairs

    return config_pairs(spark, "/data")
