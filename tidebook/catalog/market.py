"""Current-market queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import ASK, KDAY, NOW
from tidebook.catalog.ingest import CAP
from tidebook.catalog.registry import query, r, view
from tidebook.operators import candles as bars, ingest, market as op
from tidebook.session import reuse
from tidebook.sources.bindings import AS_OF

T = "error"
DIV = "CAST(sum(unit_price * qty) {f} AS DOUBLE) / CAST(sum(qty) {f} AS DOUBLE)"
D1, D2 = f"FILTER (sold_date > {NOW} - INTERVAL 24 HOUR)", f"FILTER (sold_date BETWEEN {NOW} - INTERVAL 48 HOUR AND {NOW} - INTERVAL 24 HOUR)"


def days(c):
    return f"(epoch_us(max({c})) - epoch_us(min({c}))) / 1e6 / 86400"


view("tagg", f"""SELECT item_id, count(*) AS trades, {days('sold_date')} AS span_days, {DIV.format(f=D1)} AS vwap24, {DIV.format(f=D2)} AS vwap_prev,
  CAST(coalesce(sum(qty) {D1}, 0) AS BIGINT) AS qty24 FROM ta WHERE category <> 'error' GROUP BY 1""")
for _n, _b in (("aagg", "ask0"), ("aaggm", "askMax")):
    view(_n, f"""SELECT item_id, count(*) AS trades, {days('captured_at')} AS span_days,
      avg(min_unit_price) FILTER (captured_at > {NOW} - INTERVAL 24 HOUR) AS vwap24,
      avg(min_unit_price) FILTER (captured_at BETWEEN {NOW} - INTERVAL 48 HOUR AND {NOW} - INTERVAL 24 HOUR) AS vwap_prev, CAST(0 AS BIGINT) AS qty24
      FROM sa WHERE category = 'error' AND {ASK[_b]} AND min_unit_price > 0 GROUP BY 1""")
AGG = f"SELECT item_id, trades, {r('span_days')} AS span_days, {r('vwap24')} AS vwap24, {r('vwap_prev')} AS vwap_prev, qty24 FROM "
view("v1h", f"""SELECT item_id, {DIV.format(f='')} AS vwap1h, count(*) AS trades1h, CAST(sum(qty) AS BIGINT) AS qty1h FROM ta
  WHERE category <> 'error' AND sold_date > {NOW} - INTERVAL 1 HOUR GROUP BY 1""")
view("ltr", "SELECT item_id, arg_max(unit_price, (sold_date, id)) AS unit_price, max(sold_date) AS sold_date FROM ta GROUP BY 1")
view("lsn", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY captured_at DESC, id DESC) AS rn FROM sa
  WHERE category <> 'error' OR upgrade = 0) WHERE rn = 1""")
view("lsm", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY captured_at DESC, id DESC) AS rn FROM sa
  WHERE category = 'error' AND upgrade > 0 AND upgrade = upgrade_max) WHERE rn = 1""")


@query("trade_agg_24h", AGG + "tagg")
def _(x):
    return op.trade_agg_24h(x.trades(), AS_OF, T)


@query("ask_agg_24h", AGG + "aagg")
def _(x):
    return op.ask_agg_24h(x.snapshots(), AS_OF, T)


@query("ask_agg_24h_max", AGG + "aaggm")
def _(x):
    return op.ask_agg_24h(x.snapshots(), AS_OF, T, "askMax")


@query("vwap_1h", f"SELECT item_id, {r('vwap1h')} AS vwap1h, trades1h, qty1h FROM v1h")
def _(x):
    return op.vwap_1h(x.trades(), AS_OF, T)


@query("last_trade", "SELECT * FROM ltr")
def _(x):
    return op.last_trade(x.trades(), AS_OF)


@query("last_snapshot", "SELECT item_id, upgrade, listing_count, min_unit_price, median FROM lsn")
def _(x):
    return op.last_snapshot(x.snapshots(), AS_OF, T)


@query("last_snapshot_max", "SELECT item_id, upgrade, listing_count, min_unit_price, median FROM lsm")
def _(x):
    return op.last_snapshot(x.snapshots(), AS_OF, T, "askMax")


view("summ", """SELECT i.item_id, i.category, CASE WHEN i.category = 'error' THEN 'ask0' ELSE 'trade' END AS price_basis,
  coalesce(a.trades, 0) AS trades, coalesce(a.span_days, 0) AS span_days,
  coalesce(CASE WHEN i.category = 'error' THEN lsn.min_unit_price ELSE ltr.unit_price END, 0) AS last_price,
  CASE WHEN i.category <> 'error' THEN ltr.sold_date END AS last_trade_at, vwap1h, coalesce(trades1h, 0) AS trades1h, coalesce(qty1h, 0) AS qty1h,
  a.vwap24, a.vwap_prev, coalesce(a.qty24, 0) AS qty24, coalesce(lsn.listing_count, 0) AS listings, lsn.min_unit_price AS min_ask,
  lsn.median AS median_ask, lsm.upgrade AS max_upgrade, coalesce(m.trades, 0) AS max_trades, lsm.min_unit_price AS max_last_price,
  m.vwap24 AS max_vwap24, m.vwap_prev AS max_vwap_prev, coalesce(lsm.listing_count, 0) AS max_listings
  FROM it i LEFT JOIN (SELECT * FROM tagg UNION ALL SELECT * FROM aagg) a USING (item_id) LEFT JOIN aaggm m USING (item_id)
  LEFT JOIN lsn USING (item_id) LEFT JOIN lsm USING (item_id) LEFT JOIN ltr USING (item_id) LEFT JOIN v1h USING (item_id)""")


@query("item_summary", f"""SELECT * REPLACE ({r('span_days')} AS span_days, {r('vwap1h')} AS vwap1h, {r('vwap24')} AS vwap24, {r('vwap_prev')} AS vwap_prev,
  {r('max_vwap24')} AS max_vwap24, {r('max_vwap_prev')} AS max_vwap_prev) FROM summ""")
def _(x):
    return op.item_summary(x.items(), x.trades(), x.snapshots(), AS_OF, T)


def _metrics(x):
    return op.market_metrics(op.item_summary(x.items(), x.trades(), x.snapshots(), AS_OF, T))


view("metr", """SELECT *, CASE WHEN price_basis = 'trade' THEN vwap1h WHEN last_price > 0 THEN last_price END AS display_price,
  CASE WHEN vwap24 <> 0 AND vwap_prev <> 0 THEN (vwap24 / vwap_prev - 1) * 100 END AS chg,
  CASE WHEN max_vwap24 <> 0 AND max_vwap_prev <> 0 THEN (max_vwap24 / max_vwap_prev - 1) * 100 END AS max_chg,
  CASE WHEN price_basis = 'ask0' THEN 0 ELSE coalesce(vwap24, last_price) * qty24 END AS turnover,
  CASE WHEN price_basis = 'trade' AND min_ask > 0 AND vwap24 > 0 THEN (min_ask / vwap24 - 1) * 100 END AS gap,
  CASE WHEN price_basis = 'trade' THEN CASE WHEN pd >= 60 THEN 'A' WHEN pd >= 20 THEN 'B' WHEN pd >= 5 THEN 'C' ELSE 'D' END END AS grade
  FROM (SELECT *, CASE WHEN span_days > 0.5 THEN trades / span_days ELSE trades * 2 END AS pd FROM summ)""")


@query("market_metrics", f"""SELECT item_id, {r('display_price')} AS display_price, {r('chg')} AS chg, {r('max_chg')} AS max_chg,
  {r('turnover')} AS turnover, {r('gap')} AS gap, grade FROM metr""")
def _(x):
    return _metrics(x).select("item_id", "display_price", "chg", "max_chg", "turnover", "gap", "grade")


@query("price_position", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY day DESC) AS rn FROM duk WHERE day < DATE '2024-01-30' AND vwap > 0),
  j AS (SELECT d.*, vwap24 AS price FROM d JOIN tagg USING (item_id) WHERE rn <= 20),
  a AS (SELECT item_id, count(*) AS days, count(*) FILTER (vwap < price) AS below, count(*) FILTER (vwap = price) AS same, min(vwap) AS low,
    max(vwap) AS high, min(day) AS fd, max(day) AS ld, max(price) AS price FROM j GROUP BY 1)
  SELECT item_id, days, below, same, {r('low')} AS low, {r('high')} AS high, CAST(fd AS VARCHAR) AS first_day, CAST(ld AS VARCHAR) AS last_day,
    {r('price')} AS price, coalesce(price > 0 AND days >= 14, false) AS ready,
    CASE WHEN price > 0 AND days >= 14 THEN {r('(below + same / 2) / days * 100')} END AS percentile FROM a""")
def _(x):
    price = op.trade_agg_24h(x.trades(), AS_OF, T).select("item_id", F.col("vwap24").alias("price"))
    return op.price_position(bars.daily_ohlc(x.candles()), price, "2024-01-30", window=20)


view("agap", f"""WITH s AS (SELECT item_id, captured_at, id, min_unit_price FROM sa WHERE captured_at > {NOW} - INTERVAL 7 DAY AND category <> 'error' AND min_unit_price > 0),
  j AS (SELECT s.*, CAST(sum(t.unit_price * t.qty) AS DOUBLE) / CAST(sum(t.qty) AS DOUBLE) AS vwap FROM s JOIN ta t ON t.item_id = s.item_id
    AND t.sold_date <= s.captured_at AND t.sold_date > s.captured_at - INTERVAL 24 HOUR GROUP BY ALL)
  SELECT * FROM (SELECT *, date_trunc('second', captured_at) AS second, row_number() OVER (PARTITION BY item_id, date_trunc('second', captured_at)
    ORDER BY captured_at DESC, id DESC) AS rn FROM j WHERE vwap > 0) WHERE rn = 1""")


@query("ask_gap_asof", f"SELECT item_id, second, min_unit_price, {r('vwap')} AS vwap, {r('(min_unit_price / vwap - 1) * 100')} AS gap FROM agap")
def _(x):
    return op.ask_gap_asof(x.snapshots(), x.trades(), AS_OF, T)


@query("stock_hourly_last", f"""SELECT item_id, upgrade, hour, captured_at, total_qty, listing_count, min_unit_price FROM
  (SELECT *, date_trunc('hour', captured_at) AS hour, row_number() OVER (PARTITION BY item_id, upgrade, date_trunc('hour', captured_at)
    ORDER BY captured_at DESC, id DESC) AS rn FROM sa WHERE captured_at >= {NOW} - INTERVAL 167 HOUR
    AND ((category <> 'error' AND upgrade IS NULL) OR (category = 'error' AND (upgrade = 0 OR upgrade = upgrade_max)))) WHERE rn = 1""")
def _(x):
    return op.stock_hourly_last(x.snapshots(), AS_OF, T)


view("lopen", "SELECT * FROM (SELECT auction_no, item_id, unit_price, cur_count FROM ljudged WHERE next_batch IS NULL AND closed_at IS NULL)")
view("ladder", "SELECT item_id, unit_price, CAST(sum(cur_count) AS BIGINT) AS qty FROM lopen WHERE cur_count > 0 AND unit_price > 0 GROUP BY 1, 2")


def _open(x):
    j = ingest.judged(ingest.sightings(x.listing_rows()), CAP)
    return j.filter(F.col("next_no").isNull() & F.col("closed_at").isNull()).select("auction_no", "item_id", "unit_price", "cur_count")


@query("depth_ladder", "SELECT * FROM ladder")
def _(x):
    return op.depth_ladder(_open(x))


@query("depth_quote", f"""WITH c AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY item_id ORDER BY unit_price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM ladder),
  t AS (SELECT *, least(qty, greatest(100 - prev, 0)) AS take FROM c)
  SELECT item_id, 100 AS target, CAST(sum(take) AS BIGINT) AS filled, count(*) FILTER (take > 0) AS levels_used,
    CASE WHEN sum(take) = 100 THEN {r('sum(take * unit_price) / 100')} END AS avg_cost, CAST(sum(qty) AS BIGINT) AS total_qty,
    min(unit_price) AS best_ask, arg_min(qty, unit_price) AS best_qty FROM t GROUP BY 1""")
def _(x):
    return op.depth_quote(op.depth_ladder(_open(x)), 100)


@query("event_fanout", """SELECT id, name, starts_at, u.item_id FROM cal, unnest(related) AS u(item_id) WHERE len(related) > 0
  UNION ALL SELECT id, name, starts_at, i.item_id FROM cal, it i WHERE coalesce(len(related), 0) = 0""")
def _(x):
    return op.event_fanout(x.calendar().select("id", "name", "starts_at", "related"), x.items())


for _dir, _cmp, _ord in (("up", "> 0", "DESC"), ("down", "< 0", "ASC")):
    @query("top_movers" if _dir == "up" else "top_movers_down", f"""SELECT item_id, {r('chg')} AS chg, qty24, CAST(row_number() OVER (ORDER BY chg {_ord}, item_id) AS INTEGER) AS rank FROM metr
      WHERE price_basis = 'trade' AND vwap24 > 0 AND vwap_prev > 0 AND qty24 >= 20 AND chg {_cmp} ORDER BY chg {_ord}, item_id LIMIT 10""")
    def _(x, _dir=_dir):
        return op.top_movers(_metrics(x), _dir, min_qty=20).select("item_id", "chg", "qty24", "rank")


@query("category_turnover", f"""WITH m AS (SELECT item_id, category, turnover FROM metr UNION ALL SELECT item_id, 'extra', turnover FROM metr WHERE item_id LIKE '%-0')
  SELECT category, {r('sum(turnover)')} AS turnover, count(*) AS items FROM m GROUP BY 1""")
def _(x):
    extra = x.items().filter(F.col("item_id").endswith("-0")).select("item_id", F.lit("extra").alias("category"))
    return op.category_turnover(_metrics(x), extra)


@query("market_list", f"""SELECT item_id, category, {r('chg')} AS chg, {r('turnover')} AS turnover FROM metr WHERE contains(lower(item_id), 'c')
  ORDER BY turnover DESC NULLS LAST, item_id LIMIT 15""")
def _(x):
    return op.market_list(_metrics(x), None, "C ", "turnover", keep=15).select("item_id", "category", "chg", "turnover")


@query("set_cost", f"""WITH s AS (SELECT category AS role, substr(item_id, -1) AS slot, count(*) AS cards,
    sum(CASE WHEN min_ask > 0 THEN min_ask ELSE coalesce(last_price, 0) END) AS cost, max(last_price) AS dearest FROM summ GROUP BY 1, 2)
  SELECT role, slot, cards, CAST(cost AS BIGINT) AS cost, dearest, CAST(sum(cost) OVER (PARTITION BY role) AS BIGINT) AS set_cost FROM s""")
def _(x):
    s = op.item_summary(x.items(), x.trades(), x.snapshots(), AS_OF, T)
    return op.set_cost(s.withColumns({"role": F.col("category"), "slot": F.substring("item_id", -1, 1)}))


@query("stat_transition", """WITH l AS (SELECT id, 'str +' || k || ' · dmg ' || (k % 7) || '%' AS a,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'vit +' || (k + 9) || ' · dmg 3%' ELSE 'str +' || (k + qty) || ' · dmg ' || (k % 7 + k % 2) || '%' END AS b FROM tr)
  SELECT id, CASE WHEN b IS NULL OR a = b THEN a WHEN split_part(a, ' ', 1) <> split_part(b, ' ', 1) THEN 'base ' || a || ' → top ' || b
    ELSE list_aggregate(list_transform(list_zip(string_split(a, ' · '), string_split(b, ' · ')), lambda z: CASE WHEN z[1] = z[2] THEN z[1]
      ELSE z[1] || '→' || split_part(z[2], ' ', 2) END), 'string_agg', ' · ') END AS line FROM l""")
def _(x):
    k = F.col("k")
    text = lambda *p: F.concat(*[F.lit(q) if isinstance(q, str) else q.cast("string") for q in p])
    base = text("str +", k, " · dmg ", k % 7, "%")
    top = (F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, text("vit +", k + 9, " · dmg 3%"))
           .otherwise(text("str +", k + F.col("qty"), " · dmg ", k % 7 + k % 2, "%")))
    return x.trades().select("id", base.alias("a"), top.alias("b")).select("id", op.stat_transition(F.col("a"), F.col("b")).alias("line"))


def bundles(x):
    """Item 0 of every type is the bundle of items 1 to 3."""
    return (x.items().filter(F.col("item_id").endswith("-0")).select(F.col("item_id").alias("bundle_id"), "category", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i"))
            .select("bundle_id", F.concat_ws("-", "category", F.col("i").cast("string")).alias("part_id")))


view("bun", "SELECT category || '-0' AS bundle_id, category || '-' || i AS part_id FROM (SELECT DISTINCT category FROM it), range(1, 4) q(i)")


@query("bundle_margin_24h", f"""WITH p AS (SELECT item_id, {DIV.format(f='')} AS vwap, count(*) AS n FROM ta WHERE sold_date > {NOW} - INTERVAL 24 HOUR GROUP BY 1),
  s AS (SELECT bundle_id, count(*) AS required, count(vwap) AS observed, sum(vwap) AS ps FROM bun LEFT JOIN p ON p.item_id = part_id GROUP BY 1),
  d AS (SELECT s.*, vwap AS bv, n AS bn, CASE WHEN required = observed AND vwap > 0 THEN ps * 0.97 - vwap END AS diff FROM s LEFT JOIN p ON p.item_id = bundle_id)
  SELECT bundle_id, required, observed, {r('bv')} AS bundle_vwap, bn AS bundle_n, CASE WHEN required = observed THEN {r('ps')} END AS parts_sum,
    {r('diff')} AS difference, {r('diff / bv * 100')} AS pct FROM d""")
def _(x):
    return op.bundle_margin_24h(x.trades(), bundles(x), AS_OF)


@query("bundle_margin_daily", f"""WITH h AS (SELECT item_id, date_trunc('hour', captured_at) AS hour, max(captured_at) AS captured_at, arg_max(total_qty, (captured_at, id)) AS q
    FROM sn WHERE upgrade IS NULL GROUP BY 1, 2), st_ AS (SELECT item_id, {KDAY.format('captured_at')} AS day, CASE WHEN count(*) >= 6 THEN avg(q) END AS v FROM h GROUP BY 1, 2),
  d AS (SELECT * FROM duk WHERE day <= DATE '2024-01-25'),
  p AS (SELECT bundle_id, day, count(vwap) AS observed, sum(vwap) AS ps FROM bun JOIN d ON d.item_id = part_id GROUP BY 1, 2),
  b AS (SELECT day, avg(vwap) AS v FROM duk GROUP BY 1)
  SELECT d.item_id AS bundle_id, CAST(d.day AS VARCHAR) AS day, {r('vwap')} AS bundle_vwap, qty AS bundle_qty, observed, {r('st_.v')} AS stock, {r('b.v')} AS benchmark,
    CASE WHEN observed = 3 THEN {r('ps')} END AS parts_sum, CASE WHEN observed = 3 THEN {r('ps * 0.97 - vwap')} END AS margin
  FROM d LEFT JOIN p ON p.bundle_id = d.item_id AND p.day = d.day LEFT JOIN st_ ON st_.item_id = d.item_id AND st_.day = d.day LEFT JOIN b ON b.day = d.day
  WHERE d.item_id LIKE '%-0'""")
def _(x):
    daily = bars.daily_ohlc(x.candles())
    bench = daily.groupBy("day").agg(F.avg("vwap").alias("value"))
    return op.bundle_margin_daily(daily, bundles(x), bars.stock_daily_18h(x.snapshots(), min_hours=6), "2024-01-25", benchmark=bench)


@query("upgrade_economics", f"""WITH f AS (SELECT min(min_price) AS floor FROM sob WHERE scan_id = {NOW} - INTERVAL 1 HOUR),
  e AS (SELECT item_id, last_price, max_last_price, max_upgrade * 2.5 AS ec, max_upgrade * 2.5 * (SELECT floor FROM f) AS mc,
    CASE WHEN last_price > 0 AND max_last_price > 0 THEN max_last_price - last_price END AS premium FROM summ WHERE price_basis = 'ask0' AND max_upgrade > 0)
  SELECT item_id, last_price, max_last_price, {r('ec')} AS expected_cards, {r('mc')} AS material_cost, {r('premium')} AS premium,
    CASE WHEN last_price > 0 THEN {r('last_price + mc')} END AS expected_total, {r('premium - mc')} AS difference FROM e""")
def _(x):
    s = op.item_summary(x.items(), x.trades(), x.snapshots(), AS_OF, T)
    last = x.scan_observations().filter(F.col("scan_id") == F.lit("2024-01-30 11:00:00").cast("timestamp"))
    return op.upgrade_economics(s, last.agg(F.min("min_price")).scalar())


view("linv", """SELECT *, CASE WHEN reason = 'vanished_before_expiry' THEN (SELECT min(s.batch) FROM lseen s WHERE s.auction_no = d.auction_no
  AND s.batch > d.observed_at) END AS invalidated_at FROM ldeltas d""")


def marked_deltas(x):
    rows = x.listing_rows()
    seen = ingest.sightings(rows)
    d = reuse(ingest.listing_diff(seen, CAP))
    inv = ingest.invalidate_vanished(d, seen).select("auction_no", "observed_at", F.lit("vanished_before_expiry").alias("reason"), "invalidated_at")
    return d.join(inv, ["auction_no", "observed_at", "reason"], "left")


@query("market_meta", f"""SELECT CAST(sum(n) AS BIGINT) AS trades, (SELECT count(*) FROM it) AS items, CAST({KDAY.format('min(hour)')} AS VARCHAR) AS first_day,
  CAST({KDAY.format('max(hour)')} AS VARCHAR) AS last_day, (SELECT CAST(sum(qty_sold) AS BIGINT) FROM linv WHERE reason <> 'expired' AND invalidated_at IS NULL
    AND observed_at > {NOW} - INTERVAL 7 DAY) AS depletion_qty FROM c1""")
def _(x):
    return op.market_meta(x.candles(), x.items(), marked_deltas(x), AS_OF, "Asia/Seoul")
