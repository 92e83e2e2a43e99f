"""Scans, filters, joins, set operations, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query as adhoc
from ..operators.dedup import distinct_keys
from ..operators.quality import tail
from ..operators.relational import coverage, date_bounds, dimension, first_by_priority, high_water, new_findings, overlapping, relevant_markets, still_open, uncovered
from ..sources.hive import dnf
from .registry import E, Tables, money, query


@query("group_count_avg", "SELECT event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_value FROM events GROUP BY 1")
def group_count_avg(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(money("value") / F.count("*"), 6).alias("avg_value"))


@query("adhoc_sql", "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def adhoc_sql(t: Tables):
    """Ad-hoc SQL over a registered view."""
    t.orders.createOrReplaceTempView("orders")
    return adhoc(t.spark, "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")


@query("view_scan_filter_limit", "SELECT event_id, event_type, value FROM events WHERE value > 50 ORDER BY value DESC, event_id LIMIT 20")
def view_scan_filter_limit(t: Tables):
    return t.events.where("value > 50").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("partition_pruned_scan", "SELECT event_id, user_id, value FROM events WHERE (event_type IN ('click', 'view') AND value >= 90) OR (event_type = 'purchase' AND user_id < 10)")
def partition_pruned_scan(t: Tables):
    """A filter in disjunctive normal form."""
    return t.events.where(dnf([[("event_type", "in", ["click", "view"]), ("value", ">=", 90)], [("event_type", "=", "purchase"), ("user_id", "<", 10)]])).select("event_id", "user_id", "value")


@query(
    "fact_dim_join_topk",
    "SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def fact_dim_join_topk(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "c_name", "n_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("dimension_lookup", "SELECT r_name, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dimension_lookup(t: Tables):
    joined = t.supplier.join(dimension(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(dimension(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), money("s_acctbal").alias("balance"))


@query("left_join_unknown", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_unknown(t: Tables):
    """Rows with their dimension where it is known."""
    labels = t.labels.select(F.col("doc_id").alias("l"), "quality")
    return t.documents.select("doc_id").join(labels, F.col("doc_id") == F.col("l"), "left").select("doc_id", "quality", F.col("l").isNotNull().alias("labelled"))


@query("semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(t: Tables):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("full_outer_join", "SELECT coalesce(a.d, b.d) AS d, a.n AS orders_n, b.n AS lines_n FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) b ON a.d = b.d")
def full_outer_join(t: Tables):
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("orders_n"))
    b = t.lineitem.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("lines_n"))
    return a.join(b, "d", "full")


@query("cross_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def cross_theta_join(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("lateral_topk", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) WHERE c_nationkey < 5")
def lateral_topk(t: Tables):
    """The two largest orders of each customer, as a lateral join in SQL."""
    t.customer.createOrReplaceTempView("customer")
    t.orders.createOrReplaceTempView("orders")
    return adhoc(t.spark, "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) WHERE c_nationkey < 5")


_MARKETS = "SELECT CAST(o_orderkey AS VARCHAR) AS market_id, o_orderpriority AS crypto, o_orderstatus AS timeframe, epoch(o_orderdate)::BIGINT AS start_ts, epoch(o_orderdate)::BIGINT + 86400 * (1 + o_orderkey % 9) AS end_ts, CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate)::BIGINT + 43200 ELSE 0 END AS closed_ts FROM orders"


def markets(t: Tables):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select(F.col("o_orderkey").cast("string").alias("market_id"), F.col("o_orderpriority").alias("crypto"), F.col("o_orderstatus").alias("timeframe"), start.alias("start_ts"), (start + 86400 * (1 + F.col("o_orderkey") % 9)).alias("end_ts"), F.when(F.col("o_orderkey") % 3 == 0, start + 43200).otherwise(F.lit(0)).cast("bigint").alias("closed_ts"))


_CUT = 852076800  # 1997-01-01


@query("market_relevance", f"WITH m AS ({_MARKETS}) SELECT market_id, crypto, timeframe FROM m WHERE crypto IN ('1-URGENT', '2-HIGH') AND timeframe = 'F' AND coalesce(nullif(closed_ts, 0), end_ts) >= {_CUT - 100000000}")
def market_relevance(t: Tables):
    return relevant_markets(markets(t), _CUT - 100000000, market_id=[], crypto=["1-URGENT", "2-HIGH"], timeframe=["F"]).select("market_id", "crypto", "timeframe")


@query("interval_overlap", f"WITH m AS ({_MARKETS}) SELECT market_id FROM m WHERE end_ts >= {_CUT} AND start_ts < {_CUT + 864000}")
def interval_overlap(t: Tables):
    return overlapping(markets(t), "start_ts", "end_ts", _CUT, _CUT + 864000).select("market_id")


@query("date_bounds", f"WITH m AS ({_MARKETS}) SELECT market_id, start_ts FROM m WHERE to_timestamp(start_ts) AT TIME ZONE 'UTC' >= TIMESTAMP '1996-03-01' AND to_timestamp(start_ts) AT TIME ZONE 'UTC' < TIMESTAMP '1996-04-02'")
def bounds(t: Tables):
    return markets(t).where(date_bounds("start_ts", "1996-03-01", "1996-04-01")).select("market_id", "start_ts")


@query("still_open", f"WITH m AS ({_MARKETS}) SELECT market_id FROM m WHERE end_ts >= {_CUT}")
def open_markets(t: Tables):
    return still_open(markets(t), _CUT).select("market_id")


@query("high_water_mark", f"WITH m AS ({_MARKETS}) SELECT max(coalesce(nullif(closed_ts, 0), least(end_ts, {_CUT}))) AS high_water FROM m")
def mark(t: Tables):
    return high_water(markets(t), _CUT)


@query(
    "coverage_anti_join",
    f"WITH m AS ({_MARKETS}), c AS (SELECT o_orderpriority AS crypto, epoch(min(o_orderdate))::BIGINT + 9000000 AS low_ts, epoch(max(o_orderdate))::BIGINT - 9000000 AS high_ts FROM orders GROUP BY 1) SELECT market_id FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE m.crypto = c.crypto AND start_ts >= low_ts AND end_ts <= high_ts)",
)
def coverage_anti_join(t: Tables):
    covered = coverage(markets(t), "crypto", "start_ts").select("crypto", (F.col("low_ts") + 9000000).alias("low_ts"), (F.col("high_ts") - 9000000).alias("high_ts"))
    return uncovered(markets(t), covered).select("market_id")


@query("new_findings", "SELECT user_id, event_type, count(*) AS n FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 95) GROUP BY 1, 2")
def findings(t: Tables):
    now = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return new_findings(now, t.events.where("value > 95").select("user_id", "event_type").distinct(), ["user_id", "event_type"])


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name FROM supplier")
def union_by_name(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("union_distinct", f"{E} SELECT ms FROM e WHERE event_type = 'click' UNION SELECT ms FROM e WHERE event_type = 'view'")
def union_distinct(t: Tables):
    return t.e.where("event_type = 'click'").select("ms").union(t.e.where("event_type = 'view'").select("ms")).distinct()


@query("except_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("intersect_keys", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def intersect_keys(t: Tables):
    return t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("k")).intersect(t.lineitem.where("l_discount > 0.08").select("l_partkey"))


@query("distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def keys(t: Tables):
    return distinct_keys(t.lineitem, ["l_suppkey", "l_returnflag"])


@query("first_by_priority", "SELECT c_custkey AS id, 'many' AS origin FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def priority(t: Tables):
    """Two listings with shared ids; the first listing's row counts."""
    first = t.orders.select(F.col("o_custkey").alias("id")).distinct().withColumn("origin", F.lit("many"))
    second = t.customer.select(F.col("c_custkey").alias("id"), F.lit("none").alias("origin"))
    return first_by_priority([first, second], "id")


@query("rollup_cube_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube_sets(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("bigint").alias("g"), F.count("*").alias("n"))


@query("filtered_aggregates", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity > 25) AS large FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def filtered_aggregates(t: Tables):
    out = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 25).alias("large"))
    return out.where("n > 10").drop("n")


@query("tail_rows", f"{E} SELECT event_id, ms FROM e ORDER BY ms DESC, event_id DESC LIMIT 10")
def tail_rows(t: Tables):
    return tail(t.e.select("event_id", "ms"), ["ms", "event_id"], 10)
