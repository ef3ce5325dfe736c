"""One query for each operator, over whole tables, and SQL where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebook.llm import ann, brown, decontam, filter_audit, level_packing, neardup, packing, phrases, pii, quality, secret_scan, toxicity, url_filter
from tidebook.llm.shared import fold

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Files of the public byte-level vocabulary, as tokenizers and as tiktoken read it."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_scan.digests(secret_scan.scan(docs, repository=["lang"]))


def op2_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"), "score",
                        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), *vocabulary())


def op4_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), RULES)


def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = pii.find(table(spark, folder, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["a"].cast("string"), s["b"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{pii.KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE))
    return found.select("doc_id", *[count(k) for k in range(len(pii.BASE))], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op7_multi_index_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op8_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0))


def op9_brown_classes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = brown.score(docs, *brown.train(brown.training(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), brown.FOLDS) == brown.HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


def op10_noisy_channel(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_retraction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))


def op12_level_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    return level_packing.pack_levels(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_fm_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_ownership, op2_compression_quality, op3_best_two_fit, op4_url_trees, op5_winnowing, op6_weak_supervision,
    op7_multi_index_minhash, op8_permutation_index, op9_brown_classes, op10_noisy_channel, op11_retraction_audit, op12_level_packing, op13_fm_phrases)}

_WORDS5 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWERED}, '{_WORDS5}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_WORDS5}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS gram FROM b WHERE len(w) BETWEEN 1 AND 12
  UNION SELECT item_id, 13, array_to_string(w[i:i + 12], ' ') FROM b, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT uid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT uid, i, dw.k, item_id FROM dw JOIN bw USING (k, gram)),
n AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT uid, i, k FROM hit), unnest(range(i, i + k)) AS t(p) GROUP BY uid),
it AS (SELECT uid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (uid) LEFT JOIN it USING (uid)"""

_OP7_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, to_id) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_id = u.a),
m AS (SELECT id, min(to_id) AS c FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id"""


def _sql_matches(kind: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT uid, {kind} AS kind, pos AS s, pos + length(m) AS e, v FROM (
  SELECT uid, m, v, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT uid, gaps, whole, i, whole[i] AS m, vals[i] AS v FROM (SELECT uid, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS whole,
    regexp_extract_all(t, '{p}', {group}) AS vals FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(whole) + 1)) AS u(i))) WHERE {keep}"""


_KIND = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secret_scan.KINDS)) + " END"
_LIST = f"string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
_OP1_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({_sql_matches(0, secret_scan.ASSIGN, 1, "length(v) >= 8")} UNION ALL {_sql_matches(1, secret_scan.ACCESS, 0, "true")}
  UNION ALL {_sql_matches(2, secret_scan.HEX, 0, "true")}),
wide AS ({_sql_matches(3, secret_scan.LIVE, 0, f"regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '{secret_scan.PLACEHOLDER}')")}),
every AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM wide x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.uid = x.uid AND b.s < x.e AND x.s < b.e)),
held AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS places FROM every JOIN d USING (uid) GROUP BY v),
j AS MATERIALIZED (SELECT every.*, owners, places, owners >= {secret_scan.COPIED} OR places >= {secret_scan.COPIED} AS copied FROM every JOIN held USING (v)),
a AS (SELECT uid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3 AND owners = 1 AND NOT copied) AS n3,
  count(*) FILTER (owners = 1 AND NOT copied) AS n_specific, count(*) FILTER (copied AND kind < 3) AS n_copied, max(owners) AS most, max(places) AS most_p,
  coalesce({_LIST} FILTER (kind < 3), '') AS bs, coalesce({_LIST} FILTER (kind < 3 OR (owners = 1 AND NOT copied)), '') AS al FROM j GROUP BY uid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(al, '') AS spans,
  coalesce(n3, 0) AS n_live, coalesce(n_specific, 0) AS n_specific, coalesce(n_copied, 0) AS n_copied, coalesce(most, 0) AS most_owners,
  coalesce(most_p, 0) AS most_places
FROM d LEFT JOIN a USING (uid)"""

_FAILS = {"A": "len(w) < 200", "B": "100 * len(list_distinct(w)) < 50 * len(w)", "C": "100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t)",
          "D": "regexp_matches(t, '[#$%&*|]')", "E": "coalesce(least_id < doc_id, false)"}
_OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS q, max(toxic = 1) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, {', '.join(f'{f} AS {k}' for k, f in _FAILS.items())}, coalesce(q, false) AS q, coalesce(x, false) AS x FROM d LEFT JOIN l USING (doc_id)),
c AS MATERIALIZED (SELECT part, [A, B, C, D, E] AS f, q, x, count(*) AS n FROM m GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS MATERIALIZED (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS MATERIALIZED (SELECT part, q, x, n, f, ord, step.i AS step, f[ord[step.i]] AS own, len(list_filter(ord[1:step.i - 1], lambda k: f[k])) > 0 AS gone,
  len(list_filter(f, lambda v: v)) AS failed FROM c, o, i AS step),
r AS MATERIALIZED (SELECT part, ord, step, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (own AND failed = 1), 0) AS unique_fails,
  coalesce(sum(n) FILTER (own AND NOT gone AND q), 0) AS good_lost, coalesce(sum(n) FILTER (own AND NOT gone AND x), 0) AS toxic_lost FROM s GROUP BY part, ord, step)
SELECT part, array_to_string(list_transform(ord, lambda k: 'ABCDE'[k]), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, ord[step]) AS BIGINT) AS shapley FROM r"""

_OP13_SQL = rf"""
WITH p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM p) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM u GROUP BY lang),
b AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM p, unnest(range(1, len(w))) AS q(i) GROUP BY ALL HAVING count(*) >= 10),
c AS MATERIALIZED (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM p, unnest(range(1, len(w) - 1)) AS q(i) GROUP BY ALL HAVING count(*) >= 10),
k AS MATERIALIZED (SELECT c.*, u1.f AS l1, b2.f AS r1, b1.f AS l2, u3.f AS r2, 1000000::HUGEINT * c.f * c.f // (u1.f::HUGEINT * b2.f) AS s1,
  1000000::HUGEINT * c.f * c.f // (b1.f::HUGEINT * u3.f) AS s2 FROM c JOIN u u1 ON u1.lang = c.lang AND u1.x = c.x JOIN u u3 ON u3.lang = c.lang AND u3.x = c.z
  JOIN b b1 ON b1.lang = c.lang AND b1.x = c.x AND b1.y = c.y JOIN b b2 ON b2.lang = c.lang AND b2.x = c.y AND b2.y = c.z),
a AS (SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, u1.f AS l, u2.f AS r, 1000000::HUGEINT * b.f * b.f // (u1.f::HUGEINT * u2.f) AS score FROM b
    JOIN u u1 ON u1.lang = b.lang AND u1.x = b.x JOIN u u2 ON u2.lang = b.lang AND u2.x = b.y
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.x = b.x AND c.y = b.y AND 100 * c.f >= 50 * b.f)
      AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.y = b.x AND c.z = b.y AND 100 * c.f >= 50 * b.f)
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN t USING (lang) WHERE rank <= 2000"""

ORACLES: dict[str, str] = {"op1_secret_ownership": _OP1_SQL, "op5_winnowing": _OP5_SQL, "op7_multi_index_minhash": _OP7_SQL, "op11_retraction_audit": _OP11_SQL, "op13_fm_phrases": _OP13_SQL}
