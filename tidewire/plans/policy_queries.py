"""Pushes, readers, registries and operations over the event and order tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import policy
from ..sources import readers, state
from .articles import LEDGER, ledger, table
from .registry import query

NOW = datetime(2024, 1, 20, 21, 10)
L = "WITH " + LEDGER
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(L + " SELECT count(*) AS n FROM led WHERE user_id = 3 AND kind = 'view' AND created_at >= TIMESTAMP '2024-01-10'")
def agg11_pushes_since(spark, sf_dir):
    return policy.pushes_since(ledger(spark, sf_dir), user_id=3, kind="view", since=datetime(2024, 1, 10))


@query(L + f" SELECT user_id, kind, arg_max(id, (created_at, id)) AS id, {STAMP.format('max(created_at)')} AS created_at FROM led GROUP BY 1, 2")
def agg12_last_push(spark, sf_dir):
    return policy.last_push(ledger(spark, sf_dir)).withColumn("created_at", _stamp("created_at"))


@query(L + " SELECT user_id, CAST(timezone('America/New_York', timezone('UTC', created_at)) AS DATE)::VARCHAR AS day, count(*) AS n FROM led GROUP BY 1, 2")
def stm11_local_day_counts(spark, sf_dir):
    day = policy.local_day(F.col("created_at"), "America/New_York").cast("string")
    return ledger(spark, sf_dir).groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT user_id, event_id, ts, epoch(ts) AS s, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, n, event_id, CASE WHEN true THEN s END AS last, d AS day, 1 AS used, true AS ok FROM p WHERE n = 1
UNION ALL SELECT p.user_id, p.n, p.event_id,
 CASE WHEN p.s - r.last >= 21600 AND (CASE WHEN r.day = p.d THEN r.used ELSE 0 END) < 2 THEN p.s ELSE r.last END,
 CASE WHEN p.s - r.last >= 21600 AND (CASE WHEN r.day = p.d THEN r.used ELSE 0 END) < 2 THEN p.d ELSE r.day END,
 CASE WHEN p.s - r.last >= 21600 AND (CASE WHEN r.day = p.d THEN r.used ELSE 0 END) < 2 THEN CASE WHEN r.day = p.d THEN r.used ELSE 0 END + 1 ELSE r.used END,
 p.s - r.last >= 21600 AND (CASE WHEN r.day = p.d THEN r.used ELSE 0 END) < 2
 FROM r JOIN p ON p.user_id = r.user_id AND p.n = r.n + 1)
SELECT user_id, event_id FROM r WHERE ok""")
def gte03_gte04_paced_pushes(spark, sf_dir):
    buys = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return policy.paced(buys, cooldown_minutes=360, per_day=2).select("user_id", "event_id")


@query("WITH m AS (SELECT event_id, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM events) SELECT event_id, m >= 1380 OR m < 420 AS quiet, CASE WHEN (420 - m + 1440) % 1440 = 0 THEN CAST(24 AS DOUBLE) ELSE ((420 - m + 1440) % 1440) / CAST(60 AS DOUBLE) END AS opens_in FROM m")
def dt03_quiet_hours(spark, sf_dir):
    m = policy.minute_of_day(F.col("ts"), "UTC")
    begin, end = policy.clock_minutes(F.lit("23:00")), policy.clock_minutes(F.lit("07:00"))
    return table(spark, sf_dir, "events").select("event_id", policy.in_quiet_hours(m, begin, end).alias("quiet"), policy.hours_until(m, end).alias("opens_in"))


@query("SELECT event_id, strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%m-%d %H:%M') AS local_time, strftime(timezone('UTC', timezone('Asia/Tokyo', date_trunc('day', timezone('Asia/Tokyo', timezone('UTC', ts))))), '%Y-%m-%d %H:%M:%S') AS day_start FROM events")
def dt02_local_day_start(spark, sf_dir):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), F.col("ts"))
    start = F.convert_timezone(F.lit("Asia/Tokyo"), F.lit("UTC"), F.date_trunc("day", local).cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(local, "MM-dd HH:mm").alias("local_time"), _stamp(start).alias("day_start"))


@query(L + """, r AS (SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Shanghai' ELSE 'America/New_York' END AS zone, CASE c_custkey % 4 WHEN 0 THEN '21:00' WHEN 1 THEN '05:00' WHEN 2 THEN '25:99' ELSE '16:00' END AS c FROM customer),
x AS (SELECT *, timezone(zone, timezone('UTC', TIMESTAMP '2024-01-20 21:10:00')) AS t, CASE c WHEN '25:99' THEN NULL ELSE CAST(substr(c, 1, 2) AS INTEGER) * 60 + CAST(substr(c, 4, 2) AS INTEGER) END AS due FROM r),
h AS (SELECT DISTINCT x.user_id FROM x JOIN led ON led.user_id = x.user_id AND kind = 'view' AND CAST(timezone(zone, timezone('UTC', created_at)) AS DATE) = CAST(t AS DATE))
SELECT x.user_id, CASE WHEN due IS NULL THEN 'bad time' WHEN hour(t) * 60 + minute(t) < due THEN 'not yet' WHEN h.user_id IS NOT NULL THEN 'sent today' WHEN hour(t) * 60 + minute(t) > due + 45 THEN 'closed' ELSE 'due' END AS state FROM x LEFT JOIN h ON x.user_id = h.user_id""")
def dt05_digest_due(spark, sf_dir):
    readers_ = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Shanghai' ELSE 'America/New_York' END").alias("zone"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN '21:00' WHEN 1 THEN '05:00' WHEN 2 THEN '25:99' ELSE '16:00' END").alias("c"),
    )
    return policy.digest_state(readers_, ledger(spark, sf_dir), now=NOW, kind="view", clock="c").select("user_id", "state")


@query("WITH m AS (SELECT event_id, user_id, ts, event_type <> 'error' AND event_type <> 'click' AS ok FROM events), i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT event_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i")
def win05_snk04_failure_streaks(spark, sf_dir):
    ok = ~F.col("event_type").isin("error", "click")
    return policy.streaks(table(spark, sf_dir, "events"), ok=ok).select("event_id", "streak")


@query("WITH l AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1), n AS (SELECT e.* FROM events e JOIN l USING (user_id) WHERE ts >= newest - INTERVAL 24 HOUR), a AS (SELECT user_id, date_sub('second', min(ts), max(ts)) / CAST(3600 AS DOUBLE) AS span_hours, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM n GROUP BY 1) SELECT user_id, span_hours, CASE WHEN span_hours >= 1 THEN l - f END AS delta FROM a")
def win04_trend(spark, sf_dir):
    return policy.trend(table(spark, sf_dir, "events"), key="user_id", ts="ts", value="value").select("user_id", "span_hours", "delta")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, sum(event_id % 50) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 60")
def stm06_daily_budget(spark, sf_dir):
    q = table(spark, sf_dir, "events").withColumn("cost", F.col("event_id") % 50).withColumn("slot", F.concat_ws("/", "user_id", F.to_date("ts")))
    return policy.within_budget(q, cost="cost", order=[F.col("ts"), F.col("event_id")], budget=60, key="slot").select("event_id", "user_id")


@query("WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1 AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 2 = 0)) SELECT doc_id FROM a WHERE k = 1")
def snk01_insert_if_absent(spark, sf_dir):
    """Even ids are stored; odd ones come in."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha1("text").alias("url_hash"))
    new = state.insert_new(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), keys=("url_hash",))
    return new.select(F.col("id").alias("doc_id"))


@query("WITH o AS (SELECT o_custkey AS k, count(*) AS heat FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), s AS (SELECT o_custkey AS k, count(*) AS heat FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o.k, CAST(greatest(o.heat, coalesce(s.heat, o.heat)) AS BIGINT) AS heat, greatest(o.heat, coalesce(s.heat, o.heat)) <> o.heat OR s.k IS NOT NULL AS touched FROM o LEFT JOIN s ON o.k = s.k")
def snk02_merge_sightings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("url_hash")).agg(F.count("*").alias("heat"))
    stored, seen = side("O").withColumn("content", F.lit("")), side("F").withColumn("content", F.lit("x"))
    return state.merge_sightings(stored, seen).select(F.col("url_hash").alias("k"), "heat", "touched")


@query("WITH o AS (SELECT s_suppkey AS k, s_nationkey AS nat, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0), n AS (SELECT s_suppkey AS k, s_nationkey AS nat, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 4 <> 0) SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, n.k IS NOT NULL AS enabled, CAST(CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND o.name <> n.name THEN 1 ELSE 0 END AS INTEGER) AS changed, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'kept' END AS state FROM o FULL JOIN n ON o.k = n.k")
def snk03_jn10_sync_registry(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nat"), F.col("s_name").alias("name"), F.lit(True).alias("enabled"))
    new = s.filter("k % 4 <> 0").withColumn("name", F.when(F.col("k") % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return state.sync_registry(s.filter("k % 5 <> 0"), new, "k", ["nat", "name"]).select("k", "name", "enabled", "changed", "state")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS is_sent FROM orders")
def snk05_mark_sent(spark, sf_dir):
    sent = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "orders").join(sent, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("is_sent"))


@query("SELECT event_id, least(greatest(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 7 END, 1800), 30), 21600) AS seconds FROM events")
def src13_cooldown(spark, sf_dir):
    after = F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 7)
    return table(spark, sf_dir, "events").select("event_id", state.cooldown_seconds(after).alias("seconds"))


@query("SELECT l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen FROM lineitem GROUP BY 1")
def src21_first_seen(spark, sf_dir):
    h = state.first_seen(table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate")
    return h.select("l_partkey", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@query("WITH n AS (SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS BIGINT) AS size FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 400), s AS (SELECT o_orderkey, sum(size) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS t FROM n) SELECT o_orderkey FROM s WHERE t <= 8000000")
def src11_evict(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"), F.round("o_totalprice").cast("long").alias("size"))
    return state.evict(c, at="at", size="size", most_rows=400, most_bytes=8_000_000).select(F.col("key").alias("o_orderkey"))


@query("SELECT DISTINCT c_custkey AS user_id, lower(v) AS value FROM (SELECT c_custkey, unnest([c_mktsegment, upper(c_mktsegment), '  ', c_name]) AS v FROM customer) WHERE trim(v) <> ''")
def usr02_set_interests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    items = c.select(F.col("c_custkey").alias("user_id"), F.lit("topic").alias("type"), F.explode(F.array("c_mktsegment", F.upper("c_mktsegment"), F.lit("  "), "c_name")).alias("value"))
    stored = c.select(F.col("c_custkey").alias("user_id"), F.lit("topic").alias("type"), F.col("c_name").alias("value"))
    return state.set_interests(stored, items).select("user_id", F.lower("value").alias("value"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsn01_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, sum(event_id % 10) AS heat FROM events GROUP BY 1, 2")
def stm10_hourly_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 10).alias("heat"))
    return e.select("user_id", _stamp("w.start").alias("hour"), "n", "heat")


@query("WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n FROM s GROUP BY user_id, s")
def stm12_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", _stamp("w.start").alias("begin"), "n")


@query("SELECT user_id, max(value) AS heat, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1")
def stm13_late_heat(spark, sf_dir):
    """The stream of events as one finished run of micro-batches."""
    from ..streaming.ingest import running_heat

    return running_heat(spark, f"{sf_dir}/events.parquet").select("user_id", "heat", _stamp("last").alias("last"))


@query("SELECT conv_id, turn, role, octet_length(encode(text)) <= 64 AS fits FROM conversations")
def api07_payload_guard(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.octet_length("text") <= 64).alias("fits"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def api06_last_context(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("SELECT p_partkey FROM part WHERE p_size <= 25 AND p_retailprice >= 910 AND NOT contains(lower(p_name), 'rod')")
def src15_open_models(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("pricing", F.create_map(F.lit("a"), F.greatest(F.col("p_size") - 25, F.lit(0)), F.lit("b"), F.when(F.col("p_retailprice") < 910, 1).otherwise(0)))
    return readers.all_free(p, "pricing").filter("NOT contains(lower(p_name), 'rod')").select("p_partkey")


@query("SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def gte08_allowlisted_best(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.groupBy("o_orderstatus").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.count("*").alias("n"))


