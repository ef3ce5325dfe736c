"""Event study queries."""
from pyspark.sql import functions as F

from tidebook.catalog.registry import query, r, view
from tidebook.catalog.seasonal import TODAY, _effect
from tidebook.operators import candles as bars, events as op
from tidebook.session import reuse

KD = "CAST({} + INTERVAL 9 HOUR AS DATE)"
view("cali", """SELECT id AS event_id, u.item_id, starts_at, announced_at FROM cal, unnest(related) AS u(item_id) WHERE len(related) > 0""")


def _calendar(x):
    return x.calendar().filter(F.size("related") > 0).select(F.col("id").alias("event_id"), F.explode("related").alias("item_id"), "starts_at", "announced_at")


def _kst_day(c):
    return F.to_date(F.from_utc_timestamp(c, "Asia/Seoul"))


@query("event_window_7", f"""WITH e AS (SELECT event_id, item_id, {KD.format('starts_at')} AS d FROM cali),
  j AS (SELECT e.*, s.day - e.d AS o, vwap AS v FROM e LEFT JOIN duk s ON s.item_id = e.item_id AND s.day >= e.d - 7 AND s.day < e.d + 7 AND s.day < DATE '{TODAY}'),
  g AS (SELECT event_id, item_id, d, count(v) FILTER (o < 0) AS pre_n, count(v) FILTER (o >= 0) AS post_n, avg(v) FILTER (o < 0) AS a, avg(v) FILTER (o >= 0) AS b FROM j GROUP BY 1, 2, 3),
  h AS (SELECT *, pre_n = 7 AND post_n = 7 AND d + 6 < DATE '{TODAY}' AS ready FROM g)
  SELECT event_id, item_id, CAST(d AS VARCHAR) AS event_day, pre_n, post_n, ready, CASE WHEN ready THEN {r('a')} END AS pre, CASE WHEN ready THEN {r('b')} END AS post,
    CASE WHEN ready THEN {r('(b / a - 1) * 100')} END AS change FROM h""")
def _(x):
    s = bars.daily_ohlc(x.candles()).select("item_id", "day", F.col("vwap").alias("value"))
    e = _calendar(x).select("event_id", "item_id", _kst_day("starts_at").alias("event_day"))
    return op.event_window_7(s, e, TODAY)


@query("event_stage_3", f"""WITH st_ AS (SELECT event_id, item_id, CASE WHEN event_id % 11 <> 0 THEN {KD.format('starts_at')} + CAST(event_id % 4 AS INTEGER) END AS d FROM cali),
  mr AS (SELECT avg(ret) AS m FROM weff),
  o AS (SELECT item_id, day, vwap / exp((ret - m) / 100) AS p, qty / vol AS q FROM duk JOIN weff ON weff.k = isodow(day), mr WHERE day < DATE '{TODAY}' AND vwap > 0 AND (item_id LIKE 'signup%' OR qty > 0) AND category <> 'error'),
  f AS (SELECT item_id, min(day) AS fd FROM o GROUP BY 1),
  n AS (SELECT s.event_id, s.item_id, s.d, o.p, o.q, o.day < s.d AS pre, CASE WHEN o.day < s.d THEN row_number() OVER (PARTITION BY s.event_id, s.item_id, o.day < s.d ORDER BY o.day DESC)
      ELSE row_number() OVER (PARTITION BY s.event_id, s.item_id, o.day < s.d ORDER BY o.day) END AS rn FROM st_ s JOIN o ON o.item_id = s.item_id),
  g AS (SELECT event_id, item_id, count(*) FILTER (pre) AS bn, count(*) FILTER (NOT pre) AS an, avg(p) FILTER (pre) AS bp, avg(p) FILTER (NOT pre) AS ap, avg(q) FILTER (pre) AS bq, avg(q) FILTER (NOT pre) AS aq FROM n WHERE rn <= 3 AND d IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT s.*, CASE WHEN d IS NULL THEN 'missing' WHEN fd IS NULL OR d < fd THEN 'before' WHEN d > DATE '{TODAY}' THEN 'scheduled' WHEN coalesce(bn, 0) < 3 OR coalesce(an, 0) < 3 THEN 'waiting' ELSE 'ready' END AS state, bp, ap, bq, aq
    FROM st_ s LEFT JOIN f ON f.item_id = s.item_id LEFT JOIN g ON g.event_id = s.event_id AND g.item_id = s.item_id)
  SELECT event_id, item_id, CAST(CAST(d AS DATE) AS VARCHAR) AS stage_day, state, CASE WHEN state = 'ready' THEN {r('(ap / bp - 1) * 100')} END AS price, CASE WHEN state = 'ready' AND item_id NOT LIKE 'signup%' THEN {r('(aq / bq - 1) * 100')} END AS qty FROM j""")
def _(x):
    daily, _elig, effect = _effect(x)
    e = _calendar(x)
    day = F.when(F.col("event_id") % 11 != 0, F.date_add(_kst_day("starts_at"), (F.col("event_id") % 4).cast("int")))
    ask = F.col("item_id").startswith("signup")      # priced by what is on offer: no quantity
    daily = daily.withColumns({"basis": F.when(ask, "ask").otherwise("trade"), "qty": F.when(ask, 0).otherwise(F.col("qty"))})
    return op.event_stage_3(daily, e.select("event_id", "item_id", day.alias("stage_day")), effect, TODAY)


view("hev", "SELECT id AS event_id, category AS item_id, date_trunc('hour', starts_at) AS t0, date_trunc('hour', announced_at) AS announced FROM (SELECT *, type AS category FROM cal)")


def _hourly_events(x):
    return x.calendar().select(F.col("id").alias("event_id"), F.col("type").alias("item_id"), F.date_trunc("hour", "starts_at").alias("at"),
                               F.date_trunc("hour", "announced_at").alias("announced"))


def study_sql(bh, ah):
    return f"""WITH a AS (SELECT event_id, item_id, t0 AS anchor, 'actual' AS kind, announced FROM hev UNION ALL SELECT event_id, item_id, t0 - to_days(CAST(i AS INTEGER)), 'ref', announced FROM hev, range(1, 29) q(i)),
      w AS (SELECT a.*, count(*) FILTER (hour < anchor) AS bn, count(*) FILTER (hour >= anchor) AS an, sum(gold) FILTER (hour < anchor) AS bg, sum(gold) FILTER (hour >= anchor) AS ag,
        sum(qty) FILTER (hour < anchor) AS bq, sum(qty) FILTER (hour >= anchor) AS aq FROM a JOIN c5 c ON c.item_id = a.item_id AND c.hour >= anchor - INTERVAL {bh} HOUR AND c.hour < anchor + INTERVAL {ah} HOUR GROUP BY ALL),
      m AS (SELECT *, CAST(bg AS DOUBLE) / bq AS bp, CAST(ag AS DOUBLE) / aq AS ap, 100 * ((CAST(ag AS DOUBLE) / aq) / (CAST(bg AS DOUBLE) / bq) - 1) AS pp, (aq / {ah} / (bq / {bh}) - 1) * 100 AS qp FROM w WHERE bn = {bh} AND an = {ah}),
      x AS (SELECT event_id, item_id, mode, pp FROM m, (VALUES ('all'), ('noThursday'), ('Tuesday')) v(mode) WHERE kind = 'ref' AND anchor + INTERVAL {ah} HOUR <= announced AND CASE mode WHEN 'all' THEN true
        WHEN 'Tuesday' THEN isodow(anchor + INTERVAL 9 HOUR) = 2 ELSE NOT list_bool_or(list_transform(generate_series(anchor - INTERVAL {bh} HOUR, anchor + INTERVAL {ah - 1} HOUR, INTERVAL 1 HOUR), lambda h: isodow(h + INTERVAL 9 HOUR) = 4)) END),
      s AS (SELECT event_id, item_id, mode, count(*) AS n, quantile_cont(pp, 0.5) AS med, quantile_cont(pp, 0.05) AS lo, quantile_cont(pp, 0.95) AS hi FROM x GROUP BY 1, 2, 3)
      SELECT e.event_id, e.item_id, v.mode, {r('bp')} AS before_price, {r('ap')} AS after_price, {r('pp')} AS actual_pct, {r('qp')} AS actual_qty_pct, coalesce(n, 0) AS "references", {r('med')} AS median, {r('lo')} AS low, {r('hi')} AS high,
        {r('pp - med')} AS excess_pp, CASE WHEN pp IS NULL OR coalesce(n, 0) < CASE WHEN v.mode = 'Tuesday' THEN 4 ELSE 20 END THEN 'insufficient' WHEN pp < lo OR pp > hi THEN 'outside the usual range' ELSE 'no clear sign' END AS status
      FROM hev e CROSS JOIN (VALUES ('all'), ('noThursday'), ('Tuesday')) v(mode) LEFT JOIN m ON m.event_id = e.event_id AND m.item_id = e.item_id AND kind = 'actual' LEFT JOIN s ON s.event_id = e.event_id AND s.item_id = e.item_id AND s.mode = v.mode"""


for _b, _a in ((6, 1), (6, 6), (3, 2)):
    @query("hourly_event_study" if (_b, _a) == (6, 6) else f"hourly_event_study_{_b}h_{_a}h", study_sql(_b, _a))
    def _(x, _b=_b, _a=_a):
        return op.hourly_event_study(x.candles(wide=False), _hourly_events(x), _b, _a)


@query("event_path", f"""WITH b AS (SELECT event_id, e.item_id, CASE WHEN count(*) = 6 THEN CAST(sum(gold) AS DOUBLE) / sum(qty) END AS base FROM hev e JOIN c5 c ON c.item_id = e.item_id AND c.hour >= t0 - INTERVAL 6 HOUR AND c.hour < t0 GROUP BY 1, 2),
  p AS (SELECT event_id, item_id, CAST(o AS INTEGER) AS "offset", t0 + to_hours(CAST(o AS INTEGER)) AS hour FROM hev, range(-24, 24) q(o))
  SELECT p.event_id, p.item_id, "offset", p.hour, {r('CAST(gold AS DOUBLE) / qty')} AS price, {r('100 * (CAST(gold AS DOUBLE) / qty) / base')} AS index, qty
  FROM p LEFT JOIN c5 c ON c.item_id = p.item_id AND c.hour = p.hour LEFT JOIN b ON b.event_id = p.event_id AND b.item_id = p.item_id""")
def _(x):
    return op.event_path(x.candles(wide=False), _hourly_events(x))


# Study design on the 40 items: six treated, eight controls, the rest of a third type as spill-over.
view("mem", """SELECT item_id, CASE category WHEN 'click' THEN 'treatment' WHEN 'view' THEN 'control' ELSE 'spillover' END AS side, CAST(substr(item_id, -1) AS INTEGER) + 1 AS position,
  CASE WHEN category = 'click' THEN DATE '2024-01-26' END AS expires_day FROM it WHERE (category = 'click' AND substr(item_id, -1) < '6') OR category IN ('view', 'purchase', 'signup')""")


def members(x):
    c, last = F.col("category"), F.substring("item_id", -1, 1)
    i = x.items().filter(((c == "click") & (last < "6")) | c.isin("view", "purchase", "signup"))
    return reuse(i.select("item_id", F.when(c == "click", "treatment").when(c == "view", "control").otherwise("spillover").alias("side"), (last.cast("int") + 1).alias("position"),
                    F.when(c == "click", F.lit("2024-01-26").cast("date")).alias("expires_day")))


THROUGH = "2024-01-29"
BASE, ANTI = ("2024-01-02", "2024-01-15"), ("2024-01-16", "2024-01-24")
view("stp", f"SELECT d.item_id, side, position, day, vwap FROM duk d JOIN mem USING (item_id) WHERE n >= 2 AND day <= DATE '{THROUGH}' AND (expires_day IS NULL OR day < expires_day)")
view("grp", """SELECT 'main' AS variant, side, item_id FROM mem WHERE side <> 'spillover'
  UNION ALL SELECT 'without ' || o.item_id, m.side, m.item_id FROM mem m, mem o WHERE m.side <> 'spillover' AND o.side = 'control' AND o.position <= 4 AND m.item_id <> o.item_id
  UNION ALL SELECT 'posing ' || o.item_id, CASE WHEN m.item_id = o.item_id THEN 'treatment' ELSE 'control' END, m.item_id FROM mem m, mem o WHERE m.side = 'control' AND o.side = 'control'""")
view("exc", """WITH s AS (SELECT variant, side, count(*) AS size FROM grp GROUP BY 1, 2), l AS (SELECT variant, g.side, day, avg(ln(vwap)) AS v, count(*) AS n FROM stp p JOIN grp g USING (item_id) GROUP BY 1, 2, 3),
  f AS (SELECT l.* FROM l JOIN s USING (variant, side) WHERE n = size)
  SELECT t.variant, t.day, t.v AS t, c.v AS c, t.v - c.v AS value FROM f t JOIN f c ON c.variant = t.variant AND c.day = t.day AND t.side = 'treatment' AND c.side = 'control'""")


def _prices(x):
    daily = bars.daily_ohlc(x.candles()).select("item_id", "day", "vwap", "n")
    return daily, op.study_prices(daily, members(x), THROUGH, min_trades=2)


def _excess(x):
    return op.did_excess(op.side_logs(_prices(x)[1], op.study_groups(members(x))))


def contrast_sql(windows, excess="exc"):
    return f"""WITH w AS ({windows}), d AS (SELECT w.*, e.day, e.value, e.day BETWEEN b0 AND b1 AS pre, e.day BETWEEN a0 AND a1 AS post FROM w LEFT JOIN {excess} e ON e.variant = w.variant AND (e.day BETWEEN b0 AND b1 OR e.day BETWEEN a0 AND a1)),
      g AS (SELECT variant, label, any_value(b1 - b0 + 1) AS pre_days, any_value(a1 - a0 + 1) AS post_days, any_value(a1) AS e, count(value) FILTER (pre) AS pre_valid, count(value) FILTER (post) AS post_valid, avg(value) FILTER (pre) AS p, avg(value) FILTER (post) AS q FROM d GROUP BY 1, 2),
      s AS (SELECT *, CASE WHEN e > DATE '{THROUGH}' THEN 'pending' WHEN pre_valid < ceil(pre_days * 0.8) OR post_valid < ceil(post_days * 0.8) THEN 'insufficient' ELSE 'ready' END AS status FROM g)
      SELECT variant, label, status, pre_days, pre_valid, post_days, post_valid, CASE WHEN status = 'ready' THEN {r('q - p')} END AS log_effect, CASE WHEN status = 'ready' THEN {r('(exp(q - p) - 1) * 100')} END AS relative_pct FROM s"""


W = f"'plan' AS label, DATE '{BASE[0]}' AS b0, DATE '{BASE[1]}' AS b1, DATE '{ANTI[0]}' AS a0, DATE '{ANTI[1]}' AS a1"


def _plan(df):
    d = lambda s: F.lit(s).cast("date")
    return df.select("variant").distinct().select("variant", F.lit("plan").alias("label"), d(BASE[0]).alias("b0"), d(BASE[1]).alias("b1"), d(ANTI[0]).alias("a0"), d(ANTI[1]).alias("a1"))


@query("did_contrast", contrast_sql(f"SELECT DISTINCT variant, {W} FROM grp"))
def _(x):
    return op.did_contrast(_excess(x), _plan(op.study_groups(members(x))), THROUGH)


@query("did_placebo", contrast_sql("SELECT 'main' AS variant, strftime(d, '%Y-%m-%d') AS label, CAST(d - 7 AS DATE) AS b0, CAST(d - 1 AS DATE) AS b1, d AS a0, CAST(d + 6 AS DATE) AS a1 FROM (SELECT CAST(DATE '2024-01-09' + CAST(i AS INTEGER) AS DATE) AS d FROM range(16) q(i))"))
def _(x):
    return op.did_contrast(_excess(x), op.placebo_windows(x.spark, "2024-01-09", "2024-01-24"), THROUGH)


view("emt", f"""WITH l AS (SELECT 'n>=' || t AS variant, side, day, avg(ln(vwap)) AS v, count(*) AS n FROM duk d JOIN mem USING (item_id), (VALUES (1), (3), (5)) v(t) WHERE side <> 'spillover' AND d.n >= t AND day <= DATE '{THROUGH}' AND (expires_day IS NULL OR day < expires_day) GROUP BY 1, 2, 3),
  f AS (SELECT l.* FROM l JOIN (SELECT side, count(*) AS size FROM mem GROUP BY 1) USING (side) WHERE n = size)
  SELECT t.variant, t.day, t.v - c.v AS value FROM f t JOIN f c ON c.variant = t.variant AND c.day = t.day AND t.side = 'treatment' AND c.side = 'control'""")


@query("min_trades_sensitivity", contrast_sql(f"SELECT variant, {W} FROM (VALUES ('n>=1'), ('n>=3'), ('n>=5')) v(variant)", "emt"))
def _(x):
    logs = op.min_trades_groups(_prices(x)[0], members(x), THROUGH, [1, 3, 5])
    names = x.spark.range(1).select(F.explode(F.array(*[F.lit(f"n>={n}") for n in (1, 3, 5)])).alias("variant"))
    return op.did_contrast(op.did_excess(logs), _plan(names), THROUGH)


@query("study_audit", f"""WITH s AS (SELECT m.*, CAST(DATE '{BASE[0]}' + CAST(i AS INTEGER) AS DATE) AS day FROM mem m, range(28) q(i)),
  g AS (SELECT s.item_id, s.side, count(*) AS expected, count(*) FILTER (n >= 5 AND (expires_day IS NULL OR s.day < expires_day)) AS valid, count(*) FILTER (n IS NULL) AS no_row, count(*) FILTER (n < 5) AS thin
    FROM s LEFT JOIN duk d ON d.item_id = s.item_id AND d.day = s.day GROUP BY 1, 2),
  l AS (SELECT d.item_id, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) FILTER (day >= expires_day) AS after_expiry FROM duk d JOIN mem USING (item_id) WHERE day <= DATE '{THROUGH}' GROUP BY 1)
  SELECT * FROM g JOIN l USING (item_id)""")
def _(x):
    return op.study_audit(_prices(x)[0], members(x), BASE[0], "2024-01-29", THROUGH)


@query("group_coverage", f"""WITH z AS (SELECT side, count(*) AS size FROM mem GROUP BY 1), c AS (SELECT side, day, count(*) AS n FROM stp WHERE day BETWEEN DATE '{BASE[0]}' AND DATE '{BASE[1]}' GROUP BY 1, 2)
  SELECT z.side, count(*) FILTER (n = size) AS days FROM z LEFT JOIN c USING (side) GROUP BY 1""")
def _(x):
    return op.group_coverage(_prices(x)[1], members(x), *BASE)


@query("pre_event_margin", f"""WITH d AS (SELECT day, (sum(vwap) FILTER (position > 1) * 0.97 / max(vwap) FILTER (position = 1) - 1) * 100 AS m FROM stp WHERE side = 'treatment' AND day BETWEEN DATE '{ANTI[0]}' AND DATE '{ANTI[1]}' GROUP BY 1 HAVING count(*) = 6),
  g AS (SELECT count(*) AS valid, avg(m) AS a, min(m) AS mi, max(m) AS mx, avg(CASE WHEN abs(m) > 3 THEN 1.0 ELSE 0.0 END) AS o FROM d), s AS (SELECT *, CASE WHEN valid < 8 THEN 'insufficient' ELSE 'ready' END AS status FROM g)
  SELECT status, valid, CASE WHEN status = 'ready' THEN {r('a')} END AS mean_pct, CASE WHEN status = 'ready' THEN {r('mi')} END AS min_pct, CASE WHEN status = 'ready' THEN {r('mx')} END AS max_pct, CASE WHEN status = 'ready' THEN {r('o')} END AS outside_share FROM s""")
def _(x):
    return op.pre_event_margin(_prices(x)[1], members(x), *ANTI, THROUGH)


@query("did_sensitivity", f"""WITH s AS (SELECT a.variant, count(*) AS n, stddev_samp(a.value - b.value) AS sg FROM exc a JOIN exc b ON b.variant = a.variant AND b.day = a.day - 1 WHERE a.day BETWEEN DATE '{BASE[0]}' AND DATE '{BASE[1]}' AND b.day >= DATE '{BASE[0]}' GROUP BY 1),
  d AS (SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < 14 THEN -1 / 14 ELSE 1 / 9 END AS w FROM range(23) q(i)), t AS (SELECT a.i, sum(b.w) AS tail FROM d a JOIN d b ON b.i >= a.i GROUP BY 1),
  f AS (SELECT sqrt(sum(tail * tail)) AS f FROM t WHERE i > 0)
  SELECT variant, n AS differences, {r('sg')} AS sigma, {r('f')} AS variance_factor, CASE WHEN n >= 8 THEN {r('(1.959964 + 0.841621) * sg * f')} END AS log_effect, CASE WHEN n >= 8 THEN {r('(exp((1.959964 + 0.841621) * sg * f) - 1) * 100')} END AS relative_pct FROM s, f""")
def _(x):
    return op.did_sensitivity(_excess(x), BASE, ANTI, least=8)


@query("did_diagnostic", f"""SELECT a.variant, count(*) AS valid, CASE WHEN count(*) >= 7 THEN {r('regr_slope(a.value, a.day - DATE \'2000-01-01\')')} END AS slope_per_day,
  CASE WHEN count(*) >= 7 AND count(b.t) >= 3 THEN {r('corr(a.t - b.t, a.c - b.c)')} END AS change_corr FROM exc a LEFT JOIN exc b ON b.variant = a.variant AND b.day = a.day - 1 GROUP BY 1""")
def _(x):
    return op.did_diagnostic(_excess(x))
