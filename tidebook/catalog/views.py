"""SQL views equal to the bindings, for the oracle side."""
from tidebook.catalog.registry import view

_EV = """SELECT event_id AS id, ts AS sold_date, user_id, event_type AS category,
  CAST(round(value * 100) AS BIGINT) AS unit_price, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""
view("ev", _EV)
view("tr", """SELECT id, category || '-' || CAST(user_id % 8 AS VARCHAR) AS item_id, category, sold_date, unit_price,
  CAST(1 + k % 10 AS INTEGER) AS qty, 0 AS reinforce, user_id, k FROM ev""")
view("t5", """SELECT id, category AS item_id, category, sold_date, unit_price,
  CAST(1 + k % 10 AS INTEGER) AS qty, 0 AS reinforce, user_id, k FROM ev""")
view("params", "SELECT TIMESTAMP '2024-01-30 12:00:00' AS as_of")
for _n, _t in (("it", "tr"), ("it5", "t5")):
    view(_n, f"""SELECT item_id, category, true AS tracked, 3600 AS poll_interval_sec, min(sold_date) AS added_at
      FROM {_t} GROUP BY ALL""")
for _n, _t in (("c1", "tr"), ("c5", "t5")):
    view(_n, f"""SELECT item_id, category, date_trunc('hour', sold_date) AS hour, arg_min(unit_price, (sold_date, id)) AS o,
      max(unit_price) AS h, min(unit_price) AS l, arg_max(unit_price, (sold_date, id)) AS c,
      sum(unit_price * qty) AS gold, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n FROM {_t} GROUP BY 1, 2, 3""")
for _n, _t in (("sn", "tr"), ("sn5", "t5")):
    view(f"br_{_n}", f"""SELECT id, item_id, category, date_trunc('hour', sold_date) AS batch, sold_date AS seen_at, unit_price, qty,
      CASE WHEN category = 'error' THEN CASE WHEN k % 2 = 0 THEN 0 ELSE 3 END END AS upgrade,
      CASE WHEN category = 'error' THEN 3 END AS upgrade_max FROM {_t}""")
    view(_n, f"""SELECT item_id, category, upgrade, upgrade_max, max(id) AS id, max(seen_at) AS captured_at,
      min(unit_price) AS min_unit_price,
      list_sort(list(unit_price))[CAST(least(floor(count(*) * 0.1), count(*) - 1) AS INTEGER) + 1] AS p10,
      list_sort(list(unit_price))[CAST(least(floor(count(*) * 0.25), count(*) - 1) AS INTEGER) + 1] AS p25,
      list_sort(list(unit_price))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS INTEGER) + 1] AS median,
      count(*) AS listing_count, CAST(sum(qty) AS BIGINT) AS total_qty
      FROM br_{_n} GROUP BY item_id, category, batch, upgrade, upgrade_max""")
view("lr", """SELECT category || ':' || CAST(user_id AS VARCHAR) AS auction_no, item_id, category,
  date_trunc('day', sold_date) AS batch, sold_date AS observed_at, id, unit_price, k AS cur_count,
  CASE WHEN k % 3 <> 0 THEN k + 1 END AS reg_count,
  date_trunc('day', sold_date) + to_days(CAST(1 + k % 5 AS INTEGER)) AS expire_date,
  CASE WHEN category = 'error' THEN CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 END END AS upgrade,
  CASE WHEN category = 'error' AND user_id % 4 < 3 THEN 3 END AS upgrade_max FROM tr""")
view("ru", """SELECT item_id, category, date_trunc('hour', sold_date) AS hour, min(sold_date) AS started_at,
  max(sold_date) AS finished_at, CAST(count(*) AS INTEGER) AS sold_rows, CAST(sum(qty) AS INTEGER) AS listing_rows,
  count(*) >= 3 AS saturated,
  CASE WHEN category = 'error' AND hour(date_trunc('hour', sold_date)) % 4 = 0 THEN 'timeout' END AS error
  FROM tr GROUP BY item_id, category, date_trunc('hour', sold_date)""")
view("src", """SELECT *, 'A' AS source, 0 AS source_rank FROM tr WHERE day(sold_date) <= 12
  UNION ALL SELECT *, 'B', 1 FROM tr WHERE day(sold_date) >= 10 AND id % 2 = 0
  UNION ALL SELECT *, 'C', 2 FROM tr WHERE day(sold_date) >= 10 AND id % 2 = 1""")
view("srcsn", """SELECT *, 'A' AS source, 0 AS source_rank FROM sn WHERE day(captured_at) <= 12
  UNION ALL SELECT *, 'B', 1 FROM sn WHERE day(captured_at) >= 10
  UNION ALL SELECT *, 'C', 2 FROM sn WHERE day(captured_at) >= 18""")
view("own", """SELECT item_id, source, valid_from, valid_to FROM it, (VALUES
  ('A', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-11'), ('B', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-20'),
  ('C', TIMESTAMP '2024-01-20', NULL)) e(source, valid_from, valid_to)""")
view("cal", """SELECT id, 'notice ' || CAST(id AS VARCHAR) AS name, category AS type, sold_date - INTERVAL 1 DAY AS announced_at,
  sold_date AS starts_at, sold_date + INTERVAL 3 DAY AS ends_at,
  CASE k % 3 WHEN 1 THEN [item_id] WHEN 2 THEN CASE WHEN item_id = category || '-0' THEN [item_id] ELSE [item_id, category || '-0'] END END AS related FROM tr""")
view("chk", """SELECT id, substr('ABC', CAST(user_id % 3 AS INTEGER) + 1, 1) AS source, sold_date AS checked_at,
  CASE WHEN k <> 50 THEN k / 2 END AS gap_min, CASE WHEN k <> 75 THEN CASE WHEN k % 10 = 0 THEN k % 4 ELSE 0 END END AS stale_items FROM tr""")
view("epo", """SELECT * FROM (VALUES ('A', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-20'), ('B', TIMESTAMP '2024-01-11', NULL),
  ('C', TIMESTAMP '2024-01-20', NULL)) e(source, valid_from, valid_to)""")
view("sob", """SELECT date_trunc('hour', sold_date) AS scan_id, item_id, min(unit_price) FILTER (k % 3 <> 0) AS min_price,
  count(*) FILTER (k % 3 <> 0) AS listing_count,
  CASE WHEN min(k) = 0 THEN 'failed' WHEN count(*) FILTER (k % 3 <> 0) > 0 THEN 'observed' ELSE 'empty' END AS status FROM tr GROUP BY 1, 2""")
view("ta", "SELECT * FROM tr WHERE sold_date <= TIMESTAMP '2024-01-30 12:00:00'")
view("sa", "SELECT * FROM sn WHERE captured_at <= TIMESTAMP '2024-01-30 12:00:00'")
