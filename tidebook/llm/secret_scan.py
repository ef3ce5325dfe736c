"""Secrets in texts, and how many owners hold each of them. Column functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidebook.llm.shared import hold

KINDS = ("assign", "access", "hex", "live")
COPIED = 3   # owners, or repositories, from which on a value counts as widely copied

#: Patterns. A run of hexadecimal digits, or of capitals after AKIA, is matched whole, so asking for its
#: length in the pattern drops the same matches as dropping short ones afterwards.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LIVE = r"[A-Za-z0-9+/_-]{20,}"
#: Values that stand for a secret in examples.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0000|1234|abcd"


def _placed(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost matches that do not overlap as structs (start, kind, end, value): what lies between matches gives their places."""
    def build() -> Column:
        between = F.split(text, pattern, -1)
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        step = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("all"), value.alias("value"))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("found"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["all"])
            return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))).alias("found"))

        return F.aggregate(step, first, add)["found"]

    return F.when(text.rlike(pattern), build()).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: list[str] | None = None) -> DataFrame:
    """Spans of secrets per row of `docs`, with what the whole corpus says about their values.

    Base spans (assign, access, hex) come from fixed patterns. Further long tokens of mixed letters and digits are
    candidates; the hashes of all values are counted by distinct repositories (owner and the columns `repository`) and
    distinct owners. What COPIED or more owners hold, or stands in COPIED or more repositories, is a widely copied example; what one owner
    holds in fewer repositories is specific. A specific candidate that is no placeholder is added as a live span.

    Output: doc_id, base (array of start, kind, end), spans (base and live), n_assign, n_access, n_hex, n_live, n_specific
    (spans of specific values), n_copied, most_owners, most_places (repositories of the value that most of them hold) and
    spread (spans whose value one owner holds in several repositories). Null is an empty text. Null owners count as one owner. Repeated rows
    give a row each and do not add owners. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    owner_of = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    where = F.concat_ws("/", owner_of, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (repository or [])])
    rows = docs.select(F.col(doc_id).alias("doc_id"), owner_of.alias("owner"), where.alias("repository"), body.alias("t"))
    rows = rows.select("doc_id", "owner", "repository",
                       F.filter(_placed(F.col("t"), ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= 8).alias("a"),
                       _placed(F.col("t"), ACCESS, 1).alias("k"), _placed(F.col("t"), HEX, 2).alias("x"),
                       F.filter(_placed(F.col("t"), LIVE, 3), lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")
                                & s["value"].rlike("[0-9]") & ~s["value"].rlike(PLACEHOLDER)).alias("l"))
    rows = rows.withColumn("base", F.concat("a", "k", "x")).withColumn(
        "l", F.filter("l", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    short = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    rows = hold(rows.select("doc_id", "owner", "repository", short(F.concat("base", "l")).alias("s"))
                .withColumn("uid", F.monotonically_increasing_id()))
    each = rows.where(F.size("s") > 0).select("uid", "owner", "repository", F.explode("s").alias("s")).select("uid", "owner", "repository", "s.*")
    held = (each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("one").alias("places"))
            .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("places").alias("places")))
    one = F.col("owners") == 1
    copied = (F.col("owners") >= COPIED) | (F.col("places") >= COPIED)
    own = one & ~copied
    judged = (each.join(held, "hash").groupBy("uid").agg(
        F.collect_list(F.when((F.col("kind") == 3) & own, F.struct("start", "kind", "end"))).alias("live"),
        F.count_if(own).alias("n_specific"), F.count_if(copied & (F.col("kind") < 3)).alias("n_copied"),
        F.max("owners").alias("most_owners"), F.max("places").alias("most_places"),
        F.array_sort(F.collect_list(F.when(one & (F.col("places") > 1), F.struct("start", "kind", "end")))).alias("spread")))
    bare = F.transform(F.filter("s", lambda s: s["kind"] < 3), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return (rows.select("uid", "doc_id", bare.alias("base")).join(judged, "uid", "left")
            .withColumn("live", F.coalesce("live", none)).withColumn("spans", F.concat("base", "live"))
            .select("doc_id", "base", "spans", *[count(k) for k in range(3)], F.size("live").cast("bigint").alias("n_live"),
                    zero("n_specific"), zero("n_copied"), zero("most_owners"), zero("most_places"), F.coalesce("spread", none).alias("spread")))


def digests(found: DataFrame) -> DataFrame:
    """The result of `scan` with the list of all spans and the hash of the list of base spans as texts."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), "n_live", "n_specific", "n_copied", "most_owners", "most_places")
