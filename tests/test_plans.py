"""The split helpers give what a plain window or a sort gives, whatever the group sizes and the partitioning."""
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidebook.operators.archive import bucket_signature, changed_buckets, ensure_budget
from tidebook.operators.candles import candles_1h
from tidebook.operators.ingest import absences, judged, polls
from tidebook.operators.market import last_trade
from tidebook.operators.merge import merge_trades, unify_eligible
from tidebook.operators.models import LCG_A, LCG_C, LCG_SEED, lcg
from tidebook.plans import quantiles
from tidebook.plans.quantiles import exact_quantiles
from tidebook.plans.split import newest, numbered, oldest, trailing_sums
from tidebook.session import reuse


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns a third of the rows; many values repeat."""
    rnd = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"k{i % 17}", i, rnd.choice([1, 2, 5]) * rnd.randint(0, 4000) + rnd.randint(0, 3), rnd.randint(1, 9)) for i in range(6000)]
    return spark.createDataFrame(data, "g string, id long, v long, w int")


def test_numbered_equals_row_number(spark, skewed):
    df = skewed.withColumn("chunk", F.floor(F.col("id") / 500))
    got = {r["id"]: r["rn"] for r in numbered(df.repartition(5), ["g"], "chunk", ["id"]).collect()}
    want = {r["id"]: r["x"] for r in skewed.withColumn("x", F.row_number().over(Window.partitionBy("g").orderBy("id"))).collect()}
    assert got == want
    whole = [r["rn"] for r in numbered(df, [], "chunk", ["id"]).orderBy("id").collect()]
    assert whole == list(range(1, 6001))


def test_quantile_rules(skewed):
    got = {r["g"]: r for r in exact_quantiles(skewed, ["g"], "v", [("fl", "floor", .1), ("lin", "linear", .25), ("up", "floor_n1", .9)]).collect()}
    heavy = {r["g"]: r["wq"] for r in exact_quantiles(skewed, ["g"], "v", [("wq", "weighted", .5)], weight="w").collect()}
    by = {}
    for r in skewed.collect():
        by.setdefault(r["g"], []).append((r["v"], r["w"]))
    for g, rows in by.items():
        v = sorted(a for a, _ in rows)
        n = len(v)
        assert got[g]["fl"] == v[min(n - 1, int(n * .1))]
        assert got[g]["up"] == v[int(.9 * (n - 1))]
        assert got[g]["lin"] == pytest.approx(np.percentile(v, 25))
        total, run = sum(w for _, w in rows), 0
        for value, w in sorted(rows):
            run += w
            if run >= total * .5:
                assert heavy[g] == value
                break


def test_quantiles_of_signed_doubles(spark):
    rnd = random.Random(3)
    vals = [rnd.uniform(-.2, .2) for _ in range(900)] + [-0.0, 0.0, 5.5, -7.25]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = exact_quantiles(df, [], "v", [("a", "floor", .1), ("b", "linear", .5)]).first()
    assert r["a"] == sorted(vals)[int(len(vals) * .1)]
    assert r["b"] == pytest.approx(np.median(vals))


def test_trailing_sums_open_and_closed_ends(spark):
    base = "2024-01-02 00:00:00"
    facts = spark.createDataFrame([("a", -86400, 1), ("a", -86399, 10), ("a", 0, 100), ("a", 1, 1000), ("b", 0, 5)], "g string, s int, q int")
    facts = facts.select("g", (F.lit(base).cast("timestamp") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))).alias("ts"), "q")
    probes = spark.createDataFrame([("a", base), ("b", base), ("c", base)], "g string, t string").select("g", F.col("t").cast("timestamp").alias("t"))
    got = {r["g"]: int(r["q"]) for r in trailing_sums(probes, facts, ["g"], "t", "ts", "24 HOURS", {"q": "q"}).collect()}
    assert got == {"a": 110, "b": 5, "c": 0}


def test_signature_ignores_order_and_sees_every_change(spark, skewed):
    sig = lambda df: {r["bucket"]: r["hash"] for r in bucket_signature(df, F.col("g"), ["id", "v", "w"]).collect()}
    a = sig(skewed)
    assert sig(skewed.orderBy(F.desc("v")).repartition(3)) == a
    b = sig(skewed.withColumn("v", F.when(F.col("id") == 3, F.col("v") + 1).otherwise(F.col("v"))))
    assert {g for g in a if a[g] != b[g]} == {"hot"}
    doubled = sig(skewed.unionByName(skewed.filter("id = 3 OR id = 3")))
    assert doubled["hot"] != a["hot"]
    plan = changed_buckets(bucket_signature(skewed, F.col("g"), ["id"]), bucket_signature(skewed.filter("g <> 'hot'"), F.col("g"), ["id"]))
    assert [r["bucket"] for r in plan.filter("action = 'fetch'").collect()] == ["hot"]
    assert ensure_budget(plan, 10**9) > 0
    with pytest.raises(ValueError):
        ensure_budget(plan, 1)


def test_lcg_stream():
    seed, want = LCG_SEED, []
    for _ in range(1000):
        seed = (seed * LCG_A + LCG_C) % 2**32
        want.append(seed)
    assert lcg(1000).tolist() == want


def test_reuse_goes_to_the_checkpoint_folder(spark, tmp_path):
    sc = spark.sparkContext
    sc.setCheckpointDir(str(tmp_path))
    try:
        assert reuse(spark.range(10)).count() == 10
        assert any(f.name.startswith("rdd-") for f in tmp_path.rglob("*"))
    finally:
        getattr(sc._jsc.sc(), "checkpointDir_$eq")(sc._jvm.scala.Option.empty())
    assert sc._jsc.sc().getCheckpointDir().isEmpty()


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("a", t, i, price, 1) for price, (t, i) in enumerate((("2024-01-02 10:00:00", 5), ("2024-01-02 10:00:00", -3), ("1960-05-01 00:30:00", 9),
                                               ("2024-01-02 10:00:00", 2**62), ("1960-05-01 00:10:00", 2**61), ("2024-01-02 10:59:59", None)))]
    return spark.createDataFrame(rows, "item_id string, t string, id long, unit_price long, qty int").select(
        "item_id", F.col("t").cast("timestamp").alias("sold_date"), "id", "unit_price", "qty")


def test_ordered_picks_equal_a_struct_order(spark, sales):
    for df in (sales, sales.filter("id IS NOT NULL"), sales.filter("sold_date < '1970-01-01'"), sales.filter("id < 0"), sales.filter("false")):
        for pick, by in ((newest, F.max_by), (oldest, F.min_by)):
            want = df.groupBy("item_id").agg(by(F.struct("unit_price", "id"), F.struct("sold_date", "id")).alias("r")).select("item_id", "r.*")
            got = pick(df, ["item_id"], ["sold_date", "id"], ["unit_price", "id"])
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_bars_and_last_sales_sort_nothing(spark, sales):
    for df in (candles_1h(sales), last_trade(sales, "2024-02-01 00:00:00")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_ranks_of_any_size_keep_their_order(spark):
    """A late row of the first of 3,000 sources still comes after every counted row."""
    rows = [(f"s{r}", r, i, "a", f"2024-01-01 00:{r % 60:02d}:00", r, i) for r in (0, 1024, 1500, 2999) for i in (1, 2)]
    src = spark.createDataFrame(rows, "source string, source_rank int, id long, item_id string, t string, unit_price long, qty long")
    src = src.withColumn("sold_date", F.col("t").cast("timestamp")).drop("t")
    key = ["item_id", "sold_date", "unit_price", "qty"]
    states = src.select("source").distinct().withColumn("raw_max_id", F.lit(1).cast("bigint"))
    out = unify_eligible(src, states, "2024-02-01 00:00:00", key).orderBy("id").collect()
    assert [(r["eligible"], r["source_rank"]) for r in out] == [(e, k) for e in (True, False) for k in (0, 1024, 1500, 2999)]
    merged = merge_trades(src, "2024-02-01 00:00:00", key).orderBy("id").collect()
    assert [(r["source_rank"], r["source_id"]) for r in merged] == [(k, i) for k in (0, 1024, 1500, 2999) for i in (1, 2)]


def test_always_capped_polls_fan_out_to_expiry_only(spark):
    """200 hourly polls, each capped; every sighting expires 90 minutes later and is settled by the second poll after it."""
    data = [(f"a{p}-{k}", 100 + k, p) for p in range(200) for k in range(5)]
    hour = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("p"))
    seen = spark.createDataFrame(data, "auction_no string, unit_price long, p int").select(
        "auction_no", F.lit("x").alias("item_id"), F.lit("c").alias("category"), hour.alias("batch"), "unit_price", F.lit(1).alias("cur_count"),
        (hour + F.expr("INTERVAL 90 MINUTES")).alias("expire_date"), F.lit(None).cast("int").alias("upgrade"), F.lit(None).cast("int").alias("upgrade_max"))
    p = polls(seen, cap=5)
    s = seen.join(p, ["item_id", "batch"]).withColumn("next_no", F.lit(None).cast("int"))
    assert absences(s, p).count() <= 1000 * 2
    got = judged(seen, cap=5).filter("unit_price = 104").select(
        ((F.unix_timestamp("closed_at") - F.unix_timestamp("batch")) / 3600).alias("h")).collect()
    assert sorted(r["h"] for r in got if r["h"] is not None) == [2.0] * 198 and sum(r["h"] is None for r in got) == 2


@pytest.mark.parametrize("splits", [0, 16])
def test_small_and_crowded_values_split(spark, splits):
    """Values far below one, of both signs and crowded, keep their exact quantiles and fall into many bands."""
    rng = random.Random(11)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, -2) for _ in range(800)] + [0.0] * 20 + [0.05 + rng.random() * 1e-6 for _ in range(800)]
    frame = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    hist = quantiles.value_counts(frame, ["k"], "v", None)
    bands = quantiles.sampled_bands(hist, ["k"], "v", 16) if splits else hist.withColumn("_band", quantiles.price_band(F.col("v")))
    counts = [r["n"] for r in bands.groupBy("_band").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) >= 15 and (not splits or max(counts) < 300)
    order = sorted(values)
    out = quantiles.exact_quantiles(frame, ["k"], "v", [("p10", "floor", .1), ("p90", "floor_n1", .9)], splits=splits).first()
    assert (out["p10"], out["p90"]) == (order[int(len(order) * .1)], order[int(.9 * (len(order) - 1))])
