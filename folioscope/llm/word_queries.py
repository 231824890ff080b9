"""Queries about the words and filters of the corpus, with the SQL they must equal."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import filter_audit, personal_data, spelling_variants
from folioscope.llm.queries import query
from folioscope.llm.store import documents


AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
judged AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM split),
labelled AS (
  SELECT part, list_transform(fails, lambda x: coalesce(x, false)) AS fails, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM (SELECT row_number() OVER () AS row_no, * FROM judged) LEFT JOIN labels USING (doc_id) GROUP BY row_no, part, fails),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM labelled GROUP BY ALL),
letters(f, place) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, s::INT AS step, instr('ABCDE', substr(filter_order, s::INT, 1)) AS place,
    list_transform(range(1, s), lambda i: instr('ABCDE', filter_order[i])) AS earlier
  FROM orders, range(1, 6) r(s)),
states AS (
  SELECT part, filter_order, step, place, n, n_good, n_toxic, fails[place] AS failing,
    len(list_filter(earlier, lambda p: fails[p])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM masks, steps),
counted AS (
  SELECT part, filter_order, step, place, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
  FROM states GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, place))::BIGINT AS shapley
FROM counted
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, per source."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


SPELLING_SQL = r"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS told, run, count(*) AS c FROM found GROUP BY ALL),
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS step),
hashed AS (
  SELECT run, c, xor(list_reduce(flatten(list_transform(string_split(told, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
    ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)),
    lambda s, b: xor(s // 256, step[xor(s, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM runs, crc),
results AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM words, range(1, length(word) + 1) r(i)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT cut.word, w.word FROM cut JOIN words w ON cut.rest = w.word UNION SELECT w.word, cut.word FROM cut JOIN words w ON cut.rest = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, first(near.other ORDER BY o.n DESC, near.other) AS other, max(o.n) AS n_other
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= 5 * words.n THEN other END AS form, CASE WHEN n_other >= 5 * words.n THEN n_other END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN last USING (word)
"""


@query("op11_spelling_variants", SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus, the frequent form one edit away, and the last form of its chain."""
    return spelling_variants.variants(documents(spark, sf_dir).select("doc_id", "text"))


@query("op13_personal_data")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the plain rules' spans, and all spans."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = personal_data.find(docs, personal_data.fit(docs)).drop("text")

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in personal_data.KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))
