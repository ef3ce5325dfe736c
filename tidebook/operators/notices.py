"""Calendar rows out of notice pages, with built-in string functions only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebook.plans.split import newest

# Entities decoded, in this order.
ENTITIES = [("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")]


def html_text(html: Column | str) -> Column:
    """Tags to blanks, entities decoded, whitespace collapsed."""
    c = F.regexp_replace(F.col(html) if isinstance(html, str) else html, r"<[^>]+>", " ")
    for pattern, plain in ENTITIES:
        c = F.regexp_replace(c, pattern, plain)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _iso(dotted: Column) -> Column:
    return F.replace(dotted, F.lit("."), F.lit("-"))


# Fixed patterns of the notice lists.
LIST_ROW = (r'(?s)<ul[^>]*>.*?<li class="category">(.*?)</li>.*?<li class="title"[^>]*data-no="(\d+)"[^>]*>(.*?)<div class="iconset">'
            r'.*?<li class="date">\s*(\d{4}\.\d{2}\.\d{2})')
TITLE_DAY = r"(\d{1,2})/(\d{1,2})\([월화수목금토일]\)"


def notice_rows(pages: DataFrame) -> DataFrame:
    """One row per listed notice; a day written in the title replaces the day of publication.

    A January day in a December notice belongs to the next year.
    """
    block = F.explode(F.regexp_extract_all("html", F.lit(LIST_ROW), F.lit(0)))
    r = pages.select("page_id", block.alias("b"))
    part = lambda i: F.regexp_extract("b", LIST_ROW, i)
    r = r.select("page_id", part(2).alias("id"), html_text(part(1)).alias("category"), html_text(part(3)).alias("title"), _iso(part(4)).alias("published"))
    month, day = F.regexp_extract("title", TITLE_DAY, 1), F.regexp_extract("title", TITLE_DAY, 2)
    year = F.substring("published", 1, 4).cast("int") + F.when((month.cast("string") != "") & (F.lpad(month, 2, "0") == "01") & (F.substring("published", 6, 2) == "12"), 1).otherwise(0)
    named = F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return r.withColumn("date", F.when(month != "", named).otherwise(F.col("published"))).withColumn("explicit", month != "")


# Fixed marks of an article page: what opens the text and what follows it.
BODY_OPENS, BODY_ENDS = '<div class="bd_viewcont">', '<article class="bdview_btnarea'


def article_body(html: Column | str) -> Column:
    """The text of an article page: from the first opening mark to the end mark, or to the next opening mark or the page's end
    if there is none; empty without an opening mark."""
    parts = lambda c, mark: F.split(c, rf"\Q{mark}\E")
    opened = F.get(parts(F.col(html) if isinstance(html, str) else html, BODY_OPENS), F.lit(1))
    return F.coalesce(F.get(parts(opened, BODY_ENDS), F.lit(0)), F.lit(""))


def notice_headings(pages: DataFrame, keep: int = 3) -> DataFrame:
    """The first distinct h1 texts in the article of a page, in order."""
    raw = F.regexp_extract_all(article_body("html"), F.lit(r"(?s)<h1\b[^>]*>(.*?)</h1>"), F.lit(1))
    texts = F.filter(F.transform(raw, html_text), lambda t: t != "")
    return pages.select("page_id", F.slice(F.array_distinct(texts), 1, keep).alias("headings"))


# Fixed patterns of the period lists: dates, reference, link and title.
REFERENCE, LINK, BOLD = r'data-(?:no|id)="(\d+)"', r"window\.location\.href='(/(?:pg|pr)/[A-Za-z0-9_/-]+)'", r"(?s)<b\b[^>]*>(.*?)</b>"
RANGE = r"(\d{4}\.\d{2}\.\d{2})\s*~\s*(\d{4}\.\d{2}\.\d{2})?"


def period_rows(pages: DataFrame, source: str, tag: str, base_url: str, need: str | None = None) -> DataFrame:
    """Dated periods of a list; rows without title, range or link, or that end before they start, are left out."""
    shape = rf"(?s)<{tag}\b([^>]*)>(.*?)</{tag}>"
    r = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(shape), F.lit(0))).alias("b"))
    r = r.select("page_id", F.regexp_extract("b", shape, 1).alias("attrs"), F.regexp_extract("b", shape, 2).alias("body"))
    ref = F.regexp_extract("attrs", REFERENCE, 1)
    link = F.regexp_extract("attrs", LINK, 1)
    r = r.select("page_id", html_text(F.regexp_extract("body", BOLD, 1)).alias("title"), ref.alias("ref"), link.alias("link"),
                 _iso(F.regexp_extract("body", RANGE, 1)).alias("start_date"), F.nullif(_iso(F.regexp_extract("body", RANGE, 2)), F.lit("")).alias("end_date"))
    ok = (F.col("title") != "") & (F.col("start_date") != "") & ((F.col("ref") != "") | (F.col("link") != "")) & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("start_date")))
    if need:
        ok = ok & F.col("title").contains(need)
    key = F.when(F.col("ref") != "", F.col("ref")).otherwise(F.col("link"))
    url = F.when(F.col("ref") != "", F.concat(F.lit(f"{base_url}/{source}/"), "ref")).otherwise(F.concat(F.lit(base_url), "link"))
    return r.filter(ok).select("page_id", F.concat(F.lit(f"{source}:"), key).alias("id"), F.lit(source).alias("source"), "title", "start_date", "end_date", url.alias("url"))


def period_dedupe(rows: DataFrame, prefer: str, skip: Sequence[str] = ()) -> DataFrame:
    """One row per title without blanks; the preferred source wins, then the later row."""
    r = rows.withColumn("_t", F.regexp_replace("title", r"\s+", "")).withColumn("_p", (F.col("source") == prefer).cast("int"))
    if skip:
        r = r.filter(~F.col("_t").isin(list(skip)))
    return newest(r, ["_t"], ["_p", "page_id", "id"], rows.columns).drop("_t")


def term_match(titles: DataFrame, items: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """Items whose name holds at least two of a title's terms (one, if the title has only one).

    `titles` has id, title; `items` has item_id, item_name. Every distinct term is looked up once. A name cannot
    hold a term without holding its first three characters (two, for a short term), so terms and names meet on
    such fragments before `contains` decides.
    """
    words = F.split(F.regexp_replace("title", r"20\d{2}", ""), r"[^0-9A-Za-z가-힣]+")
    terms = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(list(stop)) if stop else F.length(w) >= 2)
    t = titles.select("id", F.explode(terms).alias("term"))
    need = t.groupBy("id").agg(F.least(F.lit(2), F.count(F.lit(1))).alias("need"))
    n = F.length("item_name")
    pieces = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(F.col("item_name"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    names = items.filter(n >= 2).select("item_id", "item_name", F.explode(F.array_distinct(F.concat(pieces(2), pieces(3)))).alias("gram"))
    known = t.select("term").distinct().withColumn("gram", F.substring("term", 1, 3))
    found = known.join(names, "gram").filter(F.col("item_name").contains(F.col("term"))).select("term", "item_id")
    hits = t.join(found, "term").groupBy("id", "item_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(need, "id").filter(F.col("hits") >= F.col("need")).select("id", "item_id", "hits")


def event_upsert(stored: DataFrame, incoming: DataFrame, tz: str = "UTC", order: Sequence[str] = ("url",)) -> DataFrame:
    """Calendar after an update: matched by url, or by name and starting day in `tz`; blanks keep what is stored.

    Both have name, type, announced_at, starts_at, ends_at, related, url; `stored` also has id. `order` names the
    columns of `incoming` that state its order of arrival; of rows with one url the last counts. An incoming row
    changes the oldest stored row it matches. Rows that match the same stored row, or the same name and day that are
    not stored, are applied in order: the last type, start and url, and the last value that is not null of the rest.
    What matches nothing is appended without an id. A null url, name or start matches nothing.
    """
    cols = ["name", "type", "announced_at", "starts_at", "ends_at", "related", "url"]
    day = lambda c: F.to_date(F.from_utc_timestamp(c, tz))
    i = incoming.select(*[F.col(c).alias(f"n_{c}") for c in cols], F.struct(*order).alias("_at"))
    every = [f"n_{c}" for c in cols] + ["_at"]
    linked = i.filter("n_url IS NOT NULL").groupBy("n_url").agg(F.max_by(F.struct(*every), "_at").alias("s")).select("s.*")
    i = linked.unionByName(i.filter("n_url IS NULL")).withColumn("n_day", day("n_starts_at"))
    by_url = stored.groupBy(F.col("url").alias("n_url")).agg(F.min("id").alias("id_url"))
    by_name = stored.groupBy(F.col("name").alias("n_name"), day("starts_at").alias("n_day")).agg(F.min("id").alias("id_name"))
    m = i.join(by_url, "n_url", "left").join(by_name, ["n_name", "n_day"], "left").withColumn("id", F.least("id_url", "id_name"))
    last = lambda c: F.max_by(f"n_{c}", "_at").alias(f"n_{c}")
    known = lambda c: F.max_by(f"n_{c}", F.when(F.col(f"n_{c}").isNotNull(), F.col("_at"))).alias(f"n_{c}")
    folded = [last("type"), last("starts_at"), *[known(c) for c in ("announced_at", "ends_at", "related", "url")]]
    one = m.filter("id IS NOT NULL").groupBy("id").agg(*folded, F.lit(True).alias("_hit"))
    j = stored.join(one, "id", "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    keep = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c)
    updated = j.select("id", "name", pick("type"), keep("announced_at"), pick("starts_at"), keep("ends_at"), keep("related"), keep("url"))
    fresh = m.filter("id IS NULL")
    whole = F.col("n_name").isNotNull() & F.col("n_day").isNotNull()
    added = (fresh.filter(whole).groupBy("n_name", "n_day").agg(*folded).drop("n_day")
             .unionByName(fresh.filter(~whole).drop("n_day", "id", "id_url", "id_name", "_at")))
    return updated.unionByName(added.select(F.lit(None).cast("bigint").alias("id"), *[F.col(f"n_{c}").alias(c) for c in cols]))
