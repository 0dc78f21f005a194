"""Scalar functions."""

from __future__ import annotations

from tidemill.plans.registry import dialect


def register() -> None:
    dialect(
        "fn_null",
        "SELECT n_nationkey, coalesce(nullif(n_nationkey, 3), -1) AS c, ifnull(nullif(n_name, 'NATION_4'), 'none') AS i, iif(n_nationkey > 10, 'hi', 'lo') AS f, greatest(n_nationkey, n_regionkey, 2) AS g, least(n_nationkey, NULL, 2) AS l FROM nation",
        "SELECT n_nationkey, coalesce(nullif(n_nationkey, 3), -1)::BIGINT AS c, ifnull(nullif(n_name, 'NATION_4'), 'none') AS i, CASE WHEN n_nationkey > 10 THEN 'hi' ELSE 'lo' END AS f, greatest(n_nationkey, n_regionkey, 2)::BIGINT AS g, least(n_nationkey, 2)::BIGINT AS l FROM nation",
    )
    dialect(
        "fn_string",
        "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, reverse(c_name) AS rev, replace(c_name, '#', '-') AS rep, instr(c_name, '#') AS pos, strpos(c_name, 'zz') AS none, repeat('ab', 3) AS ab, concat(c_name, NULL, '!') AS cat FROM customer",
        "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, reverse(c_name) AS rev, replace(c_name, '#', '-') AS rep, instr(c_name, '#') AS pos, 0::BIGINT AS none, repeat('ab', 3) AS ab, concat(c_name, NULL, '!') AS cat FROM customer",
    )
    dialect("fn_trim", "SELECT trim('  ' || n_name || ' ') AS t, ltrim('  ' || n_name) AS l, rtrim(n_name || '   ') AS r, btrim(' ' || n_name) AS b FROM nation", "SELECT n_name AS t, n_name AS l, n_name AS r, n_name AS b FROM nation")
    dialect("fn_substr_edges", "SELECT c_custkey, substr(c_name, 3, 4) AS a, substr(c_name, -3) AS b, substr(c_name, 0, 2) AS c, substr(c_name, 10) AS d FROM customer", "SELECT c_custkey, substr(c_name, 3, 4) AS a, right(c_name, 3) AS b, left(c_name, 1) AS c, substr(c_name, 10) AS d FROM customer")
    dialect("fn_pad_side", "SELECT n_nationkey, lpad(n_nationkey, 4, '0') AS lp, rpad(n_name, 12, '.') AS rp, lpad(n_name, 3) AS cut, left(n_name, 3) AS l, right(n_name, 2) AS r, left(n_name, -3) AS ln, right(n_name, -4) AS rn FROM nation", "SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 4, '0') AS lp, rpad(n_name, 12, '.') AS rp, left(n_name, 3) AS cut, left(n_name, 3) AS l, right(n_name, 2) AS r, left(n_name, -3) AS ln, right(n_name, -4) AS rn FROM nation")
    dialect(
        "fn_math",
        "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, sign(c_acctbal) AS s, round(sqrt(abs(c_acctbal)), 6) AS q, power(c_custkey % 10, 2) AS p, mod(c_custkey, 7) AS m, mod(c_custkey, 0) AS mz, round(exp(c_custkey % 5), 6) AS e, round(pi(), 6) AS pi FROM customer",
        "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::DOUBLE AS c, floor(c_acctbal)::DOUBLE AS f, trunc(c_acctbal)::DOUBLE AS t, sign(c_acctbal)::BIGINT AS s, round(sqrt(abs(c_acctbal)), 6) AS q, power(c_custkey % 10, 2)::DOUBLE AS p, c_custkey % 7 AS m, NULL::BIGINT AS mz, round(exp(c_custkey % 5), 6) AS e, round(pi(), 6) AS pi FROM customer",
    )
    dialect("fn_round", "SELECT c_custkey, round(c_acctbal) AS r, round(c_acctbal, 1) AS r1, round(2.6) AS up, round(-2.5) AS away FROM customer", "SELECT c_custkey, round(c_acctbal)::BIGINT AS r, round(c_acctbal, 1) AS r1, 3::BIGINT AS up, (-3)::BIGINT AS away FROM customer")
    dialect("fn_log", "SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log(p_retailprice), 6) AS lg, round(log10(p_size + 1), 6) AS l10 FROM part", "SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(log10(p_retailprice), 6) AS lg, round(log10(p_size + 1), 6) AS l10 FROM part")
    dialect(
        "fn_date_parts",
        "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(dow FROM o_orderdate) AS w, extract(doy FROM o_orderdate) AS j, extract(quarter FROM o_orderdate) AS q, extract(epoch FROM o_orderdate) AS e FROM orders",
        "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(dow FROM o_orderdate) AS w, extract(doy FROM o_orderdate) AS j, extract(quarter FROM o_orderdate) AS q, epoch(o_orderdate)::BIGINT AS e FROM orders",
    )
    dialect(
        "fn_date_time",
        "SELECT event_id, date(ts) AS d, time(ts) AS t, datetime(ts) AS dt, unixepoch(ts) AS e, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi, extract(second FROM ts) AS s FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, floor(epoch(ts))::BIGINT AS e, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events",
    )
    dialect("fn_date_trunc", "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('week', ts) AS w, date_trunc('quarter', ts) AS q FROM events", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, strftime(date_trunc('week', ts), '%Y-%m-%d 00:00:00') AS w, strftime(date_trunc('quarter', ts), '%Y-%m-%d 00:00:00') AS q FROM events")
    dialect("fn_date_text", "SELECT date('2021-07-04T12:30:45Z') AS d, datetime(86400) AS e, datetime('2021-07-04 12:30:45+02:00') AS o, date('nope') AS n, time('2021-07-04 01:02:03.9') AS t", "SELECT '2021-07-04' AS d, '1970-01-02 00:00:00' AS e, '2021-07-04 12:30:45' AS o, NULL::VARCHAR AS n, '01:02:03' AS t")
    dialect("fn_strftime", "SELECT event_id, strftime('%Y/%m/%d %H-%M-%S %j %w %%', ts) AS f FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S %j %w %%') AS f FROM events")
    dialect("fn_json_get", "SELECT event_id, props ->> 'k' AS k, (props -> 'k')::int AS n, json_extract(props, '$.k') AS x, props ->> 'none' AS no FROM events", "SELECT event_id, props ->> 'k' AS k, (props ->> 'k')::BIGINT AS n, props ->> 'k' AS x, NULL::VARCHAR AS no FROM events")
    dialect("fn_json_path", "SELECT n_nationkey, json_build_array(n_name, n_nationkey) -> 0 AS a, json_build_array(n_name, n_nationkey) ->> -1 AS z FROM nation", "SELECT n_nationkey, '\"' || n_name || '\"' AS a, n_nationkey::VARCHAR AS z FROM nation")
    dialect("fn_json_build", "SELECT n_nationkey, json_build_object('name', n_name, 'key', n_nationkey, 'none', NULL) AS o, json_array(n_name, 1, NULL) AS a, to_json(n_name) AS j FROM nation", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"key\":' || n_nationkey || ',\"none\":null}' AS o, '[\"' || n_name || '\",1,null]' AS a, '\"' || n_name || '\"' AS j FROM nation")
    dialect("fn_hex", "SELECT n_nationkey, hex(n_name) AS h, hex(n_nationkey) AS k FROM nation", "SELECT n_nationkey, hex(n_name) AS h, hex(n_nationkey::VARCHAR) AS k FROM nation")
    dialect("fn_typeof", "SELECT n_nationkey, typeof(n_name) AS t, typeof(n_nationkey) AS i, typeof(1.5) AS r, typeof(nullif(n_nationkey, 3)) AS n FROM nation", "SELECT n_nationkey, 'text' AS t, 'integer' AS i, 'real' AS r, CASE WHEN n_nationkey = 3 THEN 'null' ELSE 'integer' END AS n FROM nation")
    dialect("fn_random_uuid", "SELECT count(*) AS n, count(DISTINCT u) AS distinct_ids, min(length(u)) AS len, max(substr(u, 15, 1)) AS version, sum(iif(r >= 0 AND r < 1, 0, 1)) AS outside FROM (SELECT gen_random_uuid() AS u, random() AS r FROM customer) t", "SELECT count(*) AS n, count(*) AS distinct_ids, 36::BIGINT AS len, '4' AS version, 0::BIGINT AS outside FROM customer")
    dialect("fn_session", "SELECT auth.role() AS role, auth.uid() AS uid, auth.claim('org') AS org", "SELECT 'anon' AS role, NULL::VARCHAR AS uid, NULL::VARCHAR AS org")
