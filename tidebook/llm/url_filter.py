"""URL filter: boosted trees on lexical features, trained from URLs that rules label. Column functions and the JVM's trees only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: (host, path, verdict)
Rule = tuple[str, str, str]

SAMPLE = 20_000   # labelled URLs of each verdict that the trees are fitted on, at most
TREES, DEPTH = 12, 3
BLOCK_AT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = ("length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "entropy",
            "host_entropy", "parameters", "hyphens", "has_fragment", "secure", "longest_label", "www",
            *(f"{k}_{v}" for k in ("suffix", "section") for v in ("share", "blocked")))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows them; all empty without "://"."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, "^[^/?#]*[^?#]*([?#](?s:.*))?$", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule fits its host and the hosts below it."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), lambda c: -share(c) * F.log2(share(c)))
    return F.coalesce(F.aggregate(bits, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def _ratio(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def lexical(urls: DataFrame, url: str, rules: Sequence[Rule]) -> DataFrame:
    """`urls` with _host, _path, _suffix, _rule, _verdict and the features that one URL has by itself."""
    host, path, rest = parts(F.col(f"`{url}`"))
    out = urls.withColumns({"_url": F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), "_host": host, "_path": path, "_rest": rest})
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    labels = F.split("_host", r"\.")
    return out.withColumns({
        "_rule": name, "_verdict": verdict, "_suffix": F.element_at(labels, -1),
        "_section": F.regexp_extract("_path", "^/([^/]*)/", 1), "www": F.col("_host").startswith("www.").cast("int"),
        "length": F.length("_url"), "host_length": F.length("_host"), "path_length": F.length("_path"), "query_length": F.length("_rest"),
        "host_depth": F.size(labels), "path_depth": F.regexp_count("_path", F.lit("/")), "digit_ratio": _ratio(F.col("_url"), "[0-9]"),
        "host_digit_ratio": _ratio(F.col("_host"), "[0-9]"), "entropy": _entropy(F.col("_url")), "host_entropy": _entropy(F.col("_host")),
        "parameters": F.regexp_count("_rest", F.lit("[?&][^=&#]*=")), "hyphens": F.regexp_count("_host", F.lit("-")),
        "has_fragment": F.col("_rest").contains("#").cast("int"), "secure": F.col("_url").startswith("https").cast("int"),
        "longest_label": F.array_max(F.transform(labels, F.length)),
    })


def with_statistics(rows: DataFrame) -> DataFrame:
    """`rows` with what the whole table says of the host's last label (suffix) and the path's first part (section): how common
    it is, and how often rules block it."""
    n, rate = rows.agg(F.count(F.lit(1)), F.avg((F.col("_verdict") == "block").cast("double"))).first()
    rate = 0.5 if rate is None else rate
    for key in ("suffix", "section"):
        seen = rows.groupBy(f"_{key}").agg(F.count(F.lit(1)).alias("n"), F.count("_verdict").alias("judged"), F.count_if(F.col("_verdict") == "block").alias("blocked"))
        rows = rows.join(seen.select(f"_{key}", (F.col("n") / F.lit(max(n, 1))).alias(f"{key}_share"),
                                     ((F.col("blocked") + 5 * F.lit(rate)) / (F.col("judged") + 5)).alias(f"{key}_blocked")), f"_{key}")
    return rows


def train(rows: DataFrame) -> PipelineModel | str:
    """Trees that tell blocked from allowed among the URLs that rules judge. A hash picks at most about SAMPLE distinct
    URLs of each verdict. With one verdict only, that verdict; without any, allow."""
    judged = rows.where("_verdict is not null").dropDuplicates(["_url"])
    counts = {r["_verdict"]: r["count"] for r in judged.groupBy("_verdict").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), "allow")
    share = F.when(F.col("_verdict") == "block", min(1.0, SAMPLE / counts["block"])).otherwise(min(1.0, SAMPLE / counts["allow"]))
    sample = (judged.where(F.pmod(F.xxhash64(F.lit("sample"), "_url"), F.lit(1 << 20)) < share * (1 << 20))
              .select(*FEATURES, (F.col("_verdict") == "block").cast("double").alias("label")))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(sample)


def judge(urls: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of block) per row of `urls`.

    The longest fitting rule decides. Where none fits, boosted trees do, trained on the URLs that rules decide: lengths,
    depths, digit shares, entropies, parameter counts, and of the host's last label and the path's first part how common
    they are and how often they are blocked. Null URLs, or URLs without "://", have an empty host and path, which no rule fits. Repeated rows are judged
    alike. An empty table gives no rows.
    """
    source = urls.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = with_statistics(lexical(source, "url", rules))
    model = train(rows)
    if isinstance(model, str):
        scored = rows.withColumn("score", F.lit(float(model == "block")))
    else:
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    decided = F.coalesce("_verdict", F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow"))
    return scored.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
                         decided.alias("verdict"), "score")
