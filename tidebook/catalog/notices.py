"""Notice and export queries."""
from pyspark.sql import functions as F

from tidebook.catalog.candles import NOW
from tidebook.catalog.market import T
from tidebook.catalog.registry import query, r, view
from tidebook.operators import candles as bars, market, notices as op, seasonal
from tidebook.sources import sinks
from tidebook.sources.bindings import AS_OF


def strip(e):
    e = f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''")):
        e = f"regexp_replace({e}, '{a}', '{b}', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


@query("html_text", f"SELECT page_id, {strip('html')} AS text FROM pages")
def _(x):
    return x.notices().select("page_id", op.html_text("html").alias("text"))


def _articles(x):
    """Pages as article pages: a site heading before the text, another after it; every fourth page holds no article, every
    third has no end mark."""
    pid = F.col("page_id")
    whole = F.concat(F.lit("<h1>site</h1>" + op.BODY_OPENS), "html", F.lit("<h1>notes <i>a</i></h1><h1>notes a</h1>"),
                     F.when(pid % 3 != 0, op.BODY_ENDS + '"><h1>other</h1>').otherwise(op.BODY_OPENS + "<h1>next</h1>"))
    return x.notices().select("page_id", F.when(pid % 4 == 0, F.col("html")).otherwise(whole).alias("html"))


view("part_", f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN html ELSE '<h1>site</h1>{op.BODY_OPENS}' || html || '<h1>notes <i>a</i></h1><h1>notes a</h1>' ||
  CASE WHEN page_id % 3 <> 0 THEN '{op.BODY_ENDS}"><h1>other</h1>' ELSE '{op.BODY_OPENS}<h1>next</h1>' END END AS html FROM pages""")


@query("notice_headings", f"""WITH b AS (SELECT page_id, coalesce(string_split(string_split(html, '{op.BODY_OPENS}')[2], '{op.BODY_ENDS}')[1], '') AS body FROM part_),
  h AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(body, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1), lambda t: {strip('t')}), lambda t: t <> '') AS a FROM b)
  SELECT page_id, array_to_string(list_transform(list_filter(a, lambda t, i: list_position(a, t) = i), lambda t: t)[1:3], '|') AS headings FROM h""")
def _(x):
    return op.notice_headings(_articles(x)).select("page_id", F.array_join("headings", "|").alias("headings"))


def _title(x):
    """Pages with the raw markup of their first heading and a publication day."""
    day = F.date_add(F.lit("2023-12-05").cast("date"), (F.col("page_id") % 40).cast("int"))
    return x.notices().select("page_id", F.regexp_extract("html", r"(?s)<h1\b[^>]*>(.*?)</h1>", 1).alias("h"), day.alias("day"))


view("ptit", """SELECT page_id, regexp_extract(html, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1) AS h, CAST(DATE '2023-12-05' + CAST(page_id % 40 AS INTEGER) AS DATE) AS day FROM pages""")


HEADS = r"(?s)<(?:h1|a)\b[^>]*>(.*?)</(?:h1|a)>"


def _lists(x):
    """One list per page with a row for each of its headings and links; every fourth row names the day it applies."""
    pid = F.col("page_id")
    day = F.date_add(F.lit("2023-12-05").cast("date"), (pid % 40).cast("int"))
    def row(h, i):
        named = F.when((pid + i) % 4 == 0, F.concat(F.lit(" "), ((pid + i) % 12 + 1).cast("string"), F.lit("/"), ((pid + i) % 27 + 1).cast("string"), F.lit("(목)"))).otherwise("")
        return F.concat(F.lit('<ul class="n"><li class="category"> <i>news</i> </li>\n<li class="title" data-no="'), (pid * 1000 + i).cast("string"), F.lit('"><a>'), h, named,
                        F.lit('</a><div class="iconset"></div></li><li class="date"> '), F.date_format(day, "yyyy.MM.dd"), F.lit("</li></ul>"))
    heads = F.regexp_extract_all("html", F.lit(HEADS), F.lit(1))
    return x.notices().select("page_id", F.array_join(F.transform(heads, row), "\n").alias("html"))


@query("notice_rows", f"""WITH h AS (SELECT page_id, regexp_extract_all(html, '{HEADS}', 1) AS a, CAST(DATE '2023-12-05' + CAST(page_id % 40 AS INTEGER) AS DATE) AS day FROM pages),
  n AS (SELECT page_id, i, {strip('a[i + 1]')} AS t, day, (page_id + i) % 12 + 1 AS mo, (page_id + i) % 27 + 1 AS dd, (page_id + i) % 4 = 0 AS explicit FROM h, unnest(range(0, len(a))) AS q(i))
  SELECT page_id, CAST(page_id * 1000 + i AS VARCHAR) AS id, 'news' AS category, trim(t || CASE WHEN explicit THEN ' ' || mo || '/' || dd || '(목)' ELSE '' END) AS title, strftime(day, '%Y-%m-%d') AS published,
    CASE WHEN explicit THEN CAST(year(day) + CASE WHEN mo = 1 AND month(day) = 12 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0')
      ELSE strftime(day, '%Y-%m-%d') END AS date, explicit FROM n""")
def _(x):
    return op.notice_rows(_lists(x))


NEED, SKIP = "er", ["Thaninhethhewh."]


def _periods(x, source, tag, need=None):
    """Period lists: some open, some that end too early, some without a link."""
    t = _title(x)
    pid = F.col("page_id")
    end = F.when(pid % 7 == 0, "").otherwise(F.date_format(F.date_add("day", (pid % 9 - 1).cast("int")), "yyyy.MM.dd"))
    attrs = F.when(pid % 5 == 0, "").when(pid % 5 == 1, F.concat(F.lit("onclick=\"window.location.href='/pg/p"), pid.cast("string"), F.lit("'\""))).otherwise(
        F.concat(F.lit('data-no="'), pid.cast("string"), F.lit('"')))
    html = F.concat(F.lit(f"<{tag} "), attrs, F.lit("><b>"), "h", F.lit("</b> "), F.date_format("day", "yyyy.MM.dd"), F.lit(" ~ "), end, F.lit(f"</{tag}>"))
    return op.period_rows(t.select("page_id", html.alias("html")), source, tag, "https://example.com", need)


def period_sql(source):
    return f"""SELECT page_id, '{source}:' || CASE WHEN page_id % 5 = 1 THEN '/pg/p' || page_id ELSE CAST(page_id AS VARCHAR) END AS id, '{source}' AS source, t AS title, strftime(day, '%Y-%m-%d') AS start_date,
      CASE WHEN page_id % 7 <> 0 THEN strftime(day + CAST(page_id % 9 - 1 AS INTEGER), '%Y-%m-%d') END AS end_date, 'https://example.com' || CASE WHEN page_id % 5 = 1 THEN '/pg/p' || page_id ELSE '/{source}/' || page_id END AS url
      FROM (SELECT *, {strip("h")} AS t FROM ptit) WHERE t <> '' AND page_id % 5 <> 0 AND (page_id % 7 = 0 OR page_id % 9 >= 1)"""


view("pev", period_sql("event"))
view("psh", f"SELECT * FROM ({period_sql('shop')}) WHERE contains(title, '{NEED}')")


@query("period_rows", "SELECT * FROM pev")
def _(x):
    return _periods(x, "event", "li")


@query("period_dedupe", """WITH u AS (SELECT *, regexp_replace(title, '\\s+', '', 'g') AS k, CASE WHEN source = 'shop' THEN 1 ELSE 0 END AS p FROM (SELECT * FROM pev UNION ALL SELECT * FROM psh))
  SELECT page_id, id, source, title, start_date, end_date, url FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, page_id DESC, id DESC) AS rn FROM u WHERE k <> 'Thaninhethhewh.') WHERE rn = 1""")
def _(x):
    return op.period_dedupe(_periods(x, "event", "li").unionByName(_periods(x, "shop", "ul", NEED)), "shop", SKIP)


@query("term_match", """WITH t AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(regexp_replace(title, '20[0-9]{2}', '', 'g'), '[^0-9A-Za-z가-힣]+'), lambda w: length(w) >= 2 AND w <> 'set')) AS term FROM
    (SELECT p.page_id, p.page_id || ' 2024 set ' || n.p_name || ' ' || substr(n2.p_name, 1, 3) || ' ' || array_to_string(regexp_extract_all(html, '""" + HEADS + """', 1), ' ') AS title FROM pages p JOIN part n ON n.p_partkey = p.page_id JOIN part n2 ON n2.p_partkey = p.page_id + 1)),
  d AS (SELECT page_id, least(2, count(*)) AS need FROM t GROUP BY 1), names AS (SELECT DISTINCT p_name FROM part),
  h AS (SELECT page_id, p_name AS item_id, count(*) AS hits FROM t JOIN names ON contains(p_name, term) GROUP BY 1, 2)
  SELECT page_id AS id, item_id, hits FROM h JOIN d USING (page_id) WHERE hits >= need""")
def _(x):
    part = x.table("part").select(F.col("p_partkey").alias("page_id"), "p_name")
    after = part.select((F.col("page_id") - 1).alias("page_id"), F.substring("p_name", 1, 3).alias("tail"))
    heads = F.array_join(F.regexp_extract_all("html", F.lit(HEADS), F.lit(1)), " ")
    titles = x.notices().select("page_id", heads.alias("heads")).join(part, "page_id").join(after, "page_id")
    titles = titles.select(F.col("page_id").alias("id"), F.concat_ws(" ", F.col("page_id").cast("string"), F.lit("2024 set"), "p_name", "tail", "heads").alias("title"))
    items = part.select(F.col("p_name").alias("item_id"), F.col("p_name").alias("item_name")).distinct()
    return op.term_match(titles, items, ["set"])


COLS = ["name", "type", "announced_at", "starts_at", "ends_at", "related", "url"]


@query("event_upsert", """WITH s AS (SELECT id, name, type, announced_at, starts_at, CASE WHEN id % 2 = 0 THEN ends_at END AS ends_at, related, 'u/' || id AS url FROM cal WHERE id % 3 <> 0),
  i AS (SELECT name, upper(type) AS type, CASE WHEN id % 5 <> 0 THEN announced_at + INTERVAL 1 HOUR END AS announced_at, starts_at, CASE WHEN id % 2 = 1 THEN ends_at END AS ends_at, CASE WHEN id % 4 <> 0 THEN related END AS related,
    CASE WHEN id % 11 <> 0 THEN CASE WHEN id % 7 = 0 THEN 'v/' ELSE 'u/' END || id END AS url FROM cal),
  m AS (SELECT i.*, (SELECT min(s.id) FROM s WHERE s.url = i.url OR (s.name = i.name AND CAST(s.starts_at + INTERVAL 9 HOUR AS DATE) = CAST(i.starts_at + INTERVAL 9 HOUR AS DATE))) AS sid FROM i)
  SELECT s.id, s.name, CASE WHEN m.sid IS NOT NULL THEN m.type ELSE s.type END AS type, coalesce(m.announced_at, s.announced_at) AS announced_at, s.starts_at, coalesce(m.ends_at, s.ends_at) AS ends_at,
    array_to_string(coalesce(m.related, s.related), ',') AS related, coalesce(m.url, s.url) AS url FROM s LEFT JOIN m ON m.sid = s.id
  UNION ALL SELECT NULL, name, type, announced_at, starts_at, ends_at, array_to_string(related, ','), url FROM m WHERE sid IS NULL""")
def _(x):
    c, i = x.calendar(), F.col("id")
    url = lambda p: F.concat(p, i.cast("string"))
    stored = c.filter(i % 3 != 0).select("id", "name", "type", "announced_at", "starts_at", F.when(i % 2 == 0, F.col("ends_at")).alias("ends_at"), "related", url(F.lit("u/")).alias("url"))
    new = c.select("name", F.upper("type").alias("type"), F.when(i % 5 != 0, F.col("announced_at") + F.expr("INTERVAL 1 HOUR")).alias("announced_at"), "starts_at",
                   F.when(i % 2 == 1, F.col("ends_at")).alias("ends_at"), F.when(i % 4 != 0, F.col("related")).alias("related"), F.when(i % 11 != 0, url(F.when(i % 7 == 0, "v/").otherwise("u/"))).alias("url"), i.alias("position"))
    return op.event_upsert(stored, new, tz="Asia/Seoul", order=["position"]).withColumn("related", F.array_join("related", ","))


def series(x):
    daily = bars.daily_ohlc(x.candles()).select("item_id", "day", "o", "h", "l", "c", "vwap", "qty", "n")
    hourly = x.candles().filter("hour >= '2024-01-23 12:00:00'").select("item_id", "hour", "vwap", "qty")
    gaps = market.ask_gap_asof(x.snapshots(), x.trades(), AS_OF, T)
    return sinks.export_series(x.items(), {"daily": (daily, "day"), "hourly": (hourly, "hour"), "ask_gap": (gaps, "second")})


@query("export_series", f"""WITH d AS (SELECT item_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY day) AS closes FROM duk GROUP BY 1), h AS (SELECT item_id, count(*) AS n, CAST(sum(qty) AS BIGINT) AS q FROM c1 WHERE hour >= TIMESTAMP '2024-01-23 12:00:00' GROUP BY 1),
  g AS (SELECT item_id, count(*) AS n FROM agap GROUP BY 1) SELECT item_id, category, CAST(d.n AS INTEGER) AS days, closes, CAST(coalesce(h.n, 0) AS INTEGER) AS hours, coalesce(q, 0) AS hour_qty, CAST(coalesce(g.n, 0) AS INTEGER) AS gaps
  FROM it LEFT JOIN d USING (item_id) LEFT JOIN h USING (item_id) LEFT JOIN g USING (item_id)""")
def _(x):
    s = series(x)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    total = F.aggregate(F.coalesce(F.col("hourly.qty"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return s.select("item_id", "category", size("daily").alias("days"), F.array_join(F.col("daily.c").cast("array<string>"), ",").alias("closes"), size("hourly").alias("hours"),
                    total.alias("hour_qty"), size("ask_gap").alias("gaps"))


@query("split_series", "SELECT item_id, CAST(count(*) AS INTEGER) AS ask_gap_count, true AS has_side FROM agap GROUP BY 1 UNION ALL SELECT item_id, NULL, false FROM it WHERE item_id NOT IN (SELECT item_id FROM agap)")
def _(x):
    core, side = sinks.split_series(series(x), "ask_gap")
    j = core.select("item_id", "ask_gap_count").join(side.select("item_id", F.lit(True).alias("s")), "item_id", "left")
    return j.select("item_id", "ask_gap_count", F.coalesce("s", F.lit(False)).alias("has_side"))


@query("export_csv", f"SELECT item_id, CAST(day AS VARCHAR) AS day, complete, hours, {r('average')} AS average, {r('change_pct')} AS change_pct FROM path6 WHERE eligible")
def _(x):
    points = x.candles(wide=False).select("item_id", "hour", F.col("vwap").alias("price"))
    return seasonal.day_paths(points, AS_OF, 6).filter("eligible").select("item_id", "day", "complete", "hours", "average", "change_pct")
