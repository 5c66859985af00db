"""Capabilities of the engine beside the reference's own operators: star-schema and event queries."""

from lexforge.plans.dialect import Dialect, plan


@plan("engine")
def pricing_summary(d: Dialect) -> str:
    return """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@plan("engine")
def shipping_priority(d: Dialect) -> str:
    return """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 20"""


@plan("engine")
def nation_revenue(d: Dialect) -> str:
    return """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"""


@plan("engine")
def revenue_cube(d: Dialect) -> str:
    return "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)".replace("grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2", "CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2")


@plan("engine")
def top_orders_by_customer(d: Dialect) -> str:
    return "SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) x WHERE place <= 3"


@plan("engine")
def hourly_events(d: Dialect) -> str:
    return "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type"


@plan("engine")
def user_sessions(d: Dialect) -> str:
    """Events of a user up to 30 minutes apart."""
    gap = d.of("unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id))", "epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))")
    return f"""WITH gaps AS (SELECT *, {gap} AS gap FROM events), marks AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM marks GROUP BY user_id, session"""


@plan("engine")
def event_before_purchase(d: Dialect) -> str:
    """As-of join: each user's last other event before an event of the first type by name."""
    return f"""WITH t AS (SELECT min(event_type) AS first_type FROM events), x AS (SELECT e.*, max(CASE WHEN event_type <> first_type THEN {d.of('struct(ts, event_id)', "{'ts': ts, 'event_id': event_id}")} END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, first_type FROM events e CROSS JOIN t)
SELECT event_id, seen.event_id AS before_id FROM x WHERE event_type = first_type"""
