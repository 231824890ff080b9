import json
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import embedding, numbering, passages as px, precedents, reading, review, search, transcribe, vector_index
from folioscope.operators.spread import checkpoint_dir, durable
from folioscope.plans import desk
from folioscope.plans.desk_sql import fold_sql, squeeze_sql, with_desk, written_sql
from folioscope.plans.reading_queries import GROUP_CTES
from folioscope.plans.registry import query
from folioscope.plans.text_queries import GAP_QUERY_SQL, GAP_SQL, MATCH_SQL, QUERY, WORD_SQL
from folioscope.sources import index_table

PASSAGE = "page_id, page_name, line_id, part_id, linha_documento, linha_transcrita, text, content_hash, confirmed"


def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def doc_of(column="part_id"):
    return F.split_part(column, F.lit("_"), F.lit(2)).cast("bigint")


def passages(spark, sf):
    return px.passages(numbering.number_parts(desk.lines(spark, sf)))


def saved_pages(spark, sf):
    """The pages of one save: two thirds of the corpus."""
    return desk.pages(spark, sf).filter((F.substring("page_id", 2, 20).cast("bigint") - 1) % 3 != 2).select("page_id")


def _stored(spark, sf):
    """The index an earlier save left, with ids, owners, times and some vectors."""
    doc, d = doc_of(), F.col("linha_documento")
    return desk.stored(passages(spark, sf)).select(
        F.xxhash64("part_id").alias("id"),
        F.when(doc % 4 == 0, F.lit(None)).otherwise(doc % 3 + 1).cast("bigint").alias("user_id"),
        "page_id", "page_name", "line_id", "part_id", "linha_documento", "linha_transcrita", "text", "content_hash",
        F.when((doc + d) % 5 != 0, F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>")).alias("embedding"),
        "confirmed",
        F.timestamp_seconds(1_600_000_000 + (doc * 7919 + d) % 100000).alias("updated_at"),
    )


STORED_CTES = {
    "saved": "SELECT page_id FROM desk_pages WHERE doc_id % 3 <> 2",
    "stored_rows": """SELECT *, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 + 1 END AS user_id, (doc_id + linha_documento) % 5 <> 0 AS has_vector
      FROM stored""",
}


@query("passages", with_desk(f"SELECT {PASSAGE} FROM passages"))
def passages_query(spark, sf):
    return passages(spark, sf)


@query("passage_diff", with_desk("""
SELECT coalesce(n.page_id, o.page_id) AS page_id, coalesce(n.part_id, o.part_id) AS part_id,
  CASE WHEN n.part_id IS NULL THEN 'delete' WHEN n.content_hash = o.content_hash THEN 'refresh' ELSE 'write' END AS action
FROM (SELECT * FROM passages WHERE page_id IN (SELECT page_id FROM saved)) n
FULL OUTER JOIN (SELECT * FROM stored WHERE page_id IN (SELECT page_id FROM saved)) o ON o.page_id = n.page_id AND o.part_id = n.part_id""", **STORED_CTES))
def passage_diff(spark, sf):
    pages = saved_pages(spark, sf)
    current = passages(spark, sf).join(pages, "page_id", "left_semi")
    return px.passage_diff(current, _stored(spark, sf), pages)


@query("index_upsert", with_desk("""
SELECT coalesce(n.page_id, o.page_id) AS page_id, coalesce(n.part_id, o.part_id) AS part_id,
  CASE WHEN n.part_id IS NULL THEN o.linha_documento ELSE n.linha_documento END AS linha_documento,
  CASE WHEN n.part_id IS NULL THEN o.content_hash ELSE n.content_hash END AS content_hash,
  CASE WHEN n.part_id IS NULL THEN o.user_id ELSE 9 END AS user_id,
  CASE WHEN n.part_id IS NULL OR (o.part_id IS NOT NULL AND o.content_hash = n.content_hash AND o.page_id = n.page_id) THEN o.has_vector ELSE false END AS has_vector,
  n.part_id IS NOT NULL AS touched
FROM (SELECT * FROM passages WHERE page_id IN (SELECT page_id FROM saved)) n
FULL OUTER JOIN stored_rows o ON o.part_id = n.part_id
WHERE n.part_id IS NOT NULL OR o.page_id NOT IN (SELECT page_id FROM saved)""", **STORED_CTES))
def index_upsert(spark, sf):
    pages = saved_pages(spark, sf)
    current = passages(spark, sf).join(pages, "page_id", "left_semi")
    table = px.index_upsert(_stored(spark, sf), current, pages, now(), F.lit(9).cast("bigint"))
    return table.select(
        "page_id", "part_id", "linha_documento", "content_hash", "user_id",
        F.col("embedding").isNotNull().alias("has_vector"), (F.col("updated_at") == now()).alias("touched"),
    )


@query("index_source", with_desk(f"SELECT {PASSAGE}, user_id, has_vector FROM stored_rows WHERE confirmed", **STORED_CTES))
def index_source(spark, sf):
    """The table written by page hash and read back; the filter reaches the scan."""
    root = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    index_table.write_base(_stored(spark, sf), root)
    table = index_table.read_table(spark, root)
    return table.filter("confirmed").select(
        *[c.strip() for c in PASSAGE.split(",")], "user_id", F.col("embedding").isNotNull().alias("has_vector")
    )


@query("assign_ids", with_desk("""
SELECT part_id, row_number() OVER (ORDER BY page_id, linha_documento, part_id) + 1000 AS id FROM passages
UNION ALL SELECT 'seed', 1000"""))
def assign_ids(spark, sf):
    rows = passages(spark, sf).select(F.lit(None).cast("bigint").alias("id"), "page_id", "linha_documento", "part_id")
    seed = spark.range(1).select(F.lit(1000).cast("bigint").alias("id"), F.lit("p000").alias("page_id"), F.lit(1).alias("linha_documento"), F.lit("seed").alias("part_id"))
    return px.assign_ids(seed.unionByName(rows)).select("part_id", "id")


@query("write_back_vectors", with_desk("""
SELECT part_id, has_vector OR (content_hash <> 'stale' AND doc_id % 2 = 0) AS has_vector,
  NOT has_vector AND content_hash <> 'stale' AND doc_id % 2 = 0 AS filled FROM stored_rows""", **STORED_CTES))
def write_back_vectors(spark, sf):
    """Vectors for the texts as they are now: rows whose stored text is another one keep none."""
    vectors = passages(spark, sf).filter(doc_of() % 2 == 0)
    both = vectors.select(
        F.explode(F.array("part_id", F.concat("part_id", F.lit("_old")))).alias("part_id"), "content_hash",
        F.array(F.lit(9.0)).cast("array<float>").alias("embedding"),
    )
    table = px.write_back_vectors(_stored(spark, sf), both, now())
    return table.select("part_id", F.col("embedding").isNotNull().alias("has_vector"), (F.col("updated_at") == now()).alias("filled"))


@query("outstanding_batch", with_desk("""
SELECT part_id FROM stored_rows WHERE NOT has_vector""", **STORED_CTES))
def outstanding_batch(spark, sf):
    rows = _stored(spark, sf).withColumn("id", F.lit(None).cast("bigint"))
    return px.outstanding(px.assign_ids(rows)).select("part_id")


@query("delete_pages", with_desk("SELECT page_id, part_id FROM stored WHERE page_id NOT IN (SELECT page_id FROM saved)", **STORED_CTES))
def delete_pages(spark, sf):
    return px.delete_pages(_stored(spark, sf), saved_pages(spark, sf)).select("page_id", "part_id")


@query("delete_user", with_desk("SELECT part_id, user_id FROM stored_rows WHERE user_id IS NULL OR user_id NOT IN (SELECT doc_id FROM labels WHERE doc_id < 3 AND toxic >= 0)", **STORED_CTES))
def delete_user(spark, sf):
    users = desk.table(spark, sf, "labels").filter("doc_id < 3").select(F.col("doc_id").alias("user_id"))
    return px.delete_user(_stored(spark, sf), users).select("part_id", "user_id")


@query("legacy_import", with_desk("""
SELECT part_id, text, user_id FROM stored_rows
UNION ALL
SELECT part_id, min(text), NULL FROM (
  SELECT part_id, 'z ' || text AS text FROM passages UNION ALL SELECT part_id, 'a ' || text FROM passages WHERE doc_id % 2 = 0)
WHERE part_id NOT IN (SELECT part_id FROM stored_rows) GROUP BY part_id""", **STORED_CTES))
def legacy_import(spark, sf):
    """An older table that holds every passage, half of them twice."""
    base = passages(spark, sf).select(
        "part_id", "page_id", "page_name", "line_id", "linha_documento", "linha_transcrita", "content_hash",
        F.lit(None).cast("array<float>").alias("embedding"), "text",
    )
    texts = F.when(doc_of() % 2 == 0, F.array(F.concat(F.lit("z "), "text"), F.concat(F.lit("a "), "text"))).otherwise(
        F.array(F.concat(F.lit("z "), "text"))
    )
    legacy = base.withColumn("text", F.explode(texts)).withColumn("content_hash", F.col("text"))
    return px.legacy_import(_stored(spark, sf), legacy).select("part_id", "text", "user_id")


@query("visible_to", with_desk("SELECT part_id, user_id FROM index_vectors WHERE user_id = 2 OR user_id IS NULL"))
def visible_to(spark, sf):
    return search.visible_to(desk.index_vectors(spark, sf), 2).select("part_id", F.col("user_id").cast("int").alias("user_id"))


@query("search_filters", with_desk("""
SELECT part_id FROM index_vectors WHERE embedding IS NOT NULL AND (user_id = 1 OR user_id IS NULL) AND confirmed AND part_id NOT IN ('pv_2', 'pv_4')"""))
def search_filters(spark, sf):
    return search.searchable(desk.index_vectors(spark, sf), 1, True, ["pv_2", "", "pv_4"]).select("part_id")


@query("exclude_parts", with_desk("SELECT part_id, confirmed FROM index_vectors WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def exclude_parts(spark, sf):
    gone = desk.table(spark, sf, "labels").filter("quality = 1").select(F.concat(F.lit("pv_"), F.col("doc_id").cast("string")).alias("part_id"))
    return search.exclude_parts(desk.index_vectors(spark, sf), gone).select("part_id", "confirmed")


def _query_vector(spark, sf):
    row = desk.table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(v) for v in row["embedding"]]


COSINE = "round(list_cosine_similarity(v.embedding, q.embedding), 9)"
SHOWN = "round(greatest(0.0::DOUBLE, least(s, 1.0::DOUBLE)), 4)"


@query("vector_search", with_desk(f"""
SELECT part_id, {SHOWN} AS score FROM (
  SELECT v.part_id, {COSINE} AS s FROM index_vectors v, (SELECT embedding FROM index_vectors ORDER BY vec_id LIMIT 1) q
  WHERE v.user_id = 1 OR v.user_id IS NULL)
ORDER BY s DESC, part_id LIMIT 12"""))
def vector_search(spark, sf):
    return search.vector_search(desk.index_vectors(spark, sf), _query_vector(spark, sf), 12, user_id=1).select("part_id", "score")


@query("vector_search_lists", with_desk(f"""
SELECT part_id, {SHOWN} AS score FROM (
  SELECT v.part_id, {COSINE} AS s FROM index_vectors v, (SELECT embedding FROM index_vectors ORDER BY vec_id LIMIT 1) q
  WHERE v.user_id = 1 OR v.user_id IS NULL)
ORDER BY s DESC, part_id LIMIT 12"""))
def vector_search_lists(spark, sf):
    """The same search over inverted lists of every stored row, all of them opened and all rows re-ranked, so that nothing may differ."""
    table = desk.index_vectors(spark, sf).select("part_id", "user_id", "confirmed", "embedding")
    model = vector_index.fit(table, lists=16)
    root = f"{checkpoint_dir(spark)}/lists-{uuid.uuid4().hex}"
    vector_index.write_index(table, model, root)
    index = vector_index.read_index(spark, root)
    return vector_index.approximate_search(index, model, _query_vector(spark, sf), 12, probes=16, keep=1 << 30, user_id=1).select("part_id", "score")


@query("knn_join", with_desk(f"""
SELECT query_id, part_id, CAST(rank AS INTEGER) AS rank, {SHOWN} AS score FROM (
  SELECT q.part_id AS query_id, v.part_id, {COSINE} AS s,
         row_number() OVER (PARTITION BY q.part_id ORDER BY {COSINE} DESC, v.part_id) AS rank
  FROM index_vectors q JOIN index_vectors v ON v.part_id <> q.part_id)
WHERE rank <= 5"""))
def knn_join(spark, sf):
    """Every stored vector as a query; a row is no neighbour of itself."""
    rows = desk.index_vectors(spark, sf)
    pairs = search.knn_join(
        rows.select(F.col("part_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("part_id").alias("group_id")),
        rows.select("part_id", "embedding", F.col("part_id").alias("group_id")), 5,
    )
    return pairs.withColumn("score", search.shown_score(F.col("score")))


@query("hits_on_live_pages", with_desk("SELECT part_id, page_id FROM stored WHERE page_id IN (SELECT page_id FROM saved)", **STORED_CTES))
def hits_on_live_pages(spark, sf):
    return search.hits_on_live_pages(_stored(spark, sf).select("part_id", "page_id"), saved_pages(spark, sf))


# Word hashing spelled out: buckets, counts, unit length in single precision.
HASH_CTES = {
    "words": f"SELECT part_id, unnest(regexp_extract_all({fold_sql('text')}, {WORD_SQL})) AS word FROM passages",
    "buckets": "SELECT part_id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 768 AS bucket, count(*) AS n FROM words GROUP BY ALL",
    "norms": "SELECT part_id, sqrt(sum(n * n)) AS norm FROM buckets GROUP BY part_id",
    "weights": "SELECT b.part_id, bucket, (n / norm)::FLOAT::DOUBLE AS v FROM buckets b JOIN norms USING (part_id)",
    "lengths": "SELECT part_id, sqrt(sum(v * v)) AS len FROM weights GROUP BY part_id",
}


@query("embed_texts", with_desk("SELECT part_id, CAST(bucket AS INTEGER) AS bucket, round(v, 6) AS value FROM weights", **HASH_CTES))
def embed_texts(spark, sf):
    vectors = embedded(spark, passages(spark, sf).select("part_id", "text"))
    rows = vectors.select("part_id", F.posexplode("embedding").alias("bucket", "value")).filter("value <> 0")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


QUERY_CTES = {
    "q_buckets": """SELECT bucket, count(*) AS n FROM (SELECT CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 768 AS bucket
      FROM (SELECT unnest(['reau', 'ment']) AS w)) GROUP BY bucket""",
    "q_weights": "SELECT bucket, (n / (SELECT sqrt(sum(n * n)) FROM q_buckets))::FLOAT::DOUBLE AS v FROM q_buckets",
    "close_rows": """SELECT p.page_id, p.part_id, round(coalesce(d.dot, 0) / (l.len * (SELECT sqrt(sum(v * v)) FROM q_weights)), 9) AS s
      FROM passages p JOIN lengths l ON l.part_id = p.part_id
      LEFT JOIN (SELECT w.part_id, sum(w.v * q.v) AS dot FROM weights w JOIN q_weights q ON q.bucket = w.bucket GROUP BY w.part_id) d ON d.part_id = p.part_id
      ORDER BY s DESC, p.part_id LIMIT 12""",
    "hits": f"SELECT *, row_number() OVER (ORDER BY page_id, linha_documento, parte) AS pos FROM numbered WHERE {written_sql('text')} AND {MATCH_SQL}",
}


def embedded(spark, rows, **options):
    return embedding.embed_texts(rows, spread=spark.sparkContext.defaultParallelism, **options)


def _embedded_query(text):
    return [float(v) for v in embedding.hashing_model()([" ".join(tx.fold_query(text).split())])[0]]


@query("hybrid_search", with_desk(f"""
SELECT 'literal' AS section, page_id, part_id, NULL::DOUBLE AS score FROM hits
UNION ALL
SELECT 'similar', page_id, part_id, {SHOWN} FROM close_rows WHERE part_id NOT IN (SELECT part_id FROM hits)
UNION ALL
SELECT 'name', page_id, NULL, NULL FROM desk_pages WHERE (contains({fold_sql('filename')}, 'reau ment')) AND page_id NOT IN (SELECT page_id FROM hits)""",
       **HASH_CTES, **QUERY_CTES))
def hybrid_search(spark, sf):
    lines = desk.lines(spark, sf, marks=False)
    numbered = numbering.number_parts(lines)
    cores = spark.sparkContext.defaultParallelism
    rows = px.passages(numbered).select("page_id", "part_id", "text")
    # Texts are dealt out only where the files come in fewer parts than there are cores.
    dealt = rows if desk.table(spark, sf, "documents").rdd.getNumPartitions() >= cores else rows.repartition(cores)
    similar = search.text_search(dealt, _embedded_query(QUERY), 12)
    return search.hybrid_search(desk.pages(spark, sf), numbered, similar, QUERY)


FORM_SQL = f"""
  SELECT form, count(*) AS texts FROM (SELECT DISTINCT part_id, unnest(regexp_extract_all({GAP_QUERY_SQL}, {WORD_SQL})) AS form FROM source_texts)
  WHERE length(form) BETWEEN 2 AND 40 AND lower(form) NOT IN ({", ".join(f"'{w}'" for w in precedents.STOP_WORDS)})
  GROUP BY form HAVING count(*) >= 3 ORDER BY texts DESC, form LIMIT 40"""


@query("word_forms", with_desk(FORM_SQL, source_texts="SELECT part_id, text FROM desk_parts WHERE confirmed"))
def word_forms(spark, sf):
    confirmed = numbering.part_rows(desk.lines(spark, sf)).filter("confirmed")
    return precedents.word_forms(confirmed)


@query("recent_confirmed", with_desk(f"""
SELECT part_id, text FROM desk_parts WHERE confirmed AND {written_sql('text')}"""))
def recent_confirmed(spark, sf):
    rows = numbering.part_rows(desk.lines(spark, sf)).withColumn(
        "updated_at", F.timestamp_seconds((doc_of() * 7919 + F.col("line_pos")) % 100000)
    )
    return px.confirmed_texts(rows).select("part_id", "text")


# Read groups of eight included lines; their gapped parts look for confirmed rows outside the group.
GAPS = {
    "grouped": "SELECT part_id, page_id || '#' || ((linha_documento - 1) // 8) AS group_id, (linha_documento - 1) * 10 + parte AS position, confirmed, text FROM numbered",
    "gaps": f"SELECT *, {GAP_QUERY_SQL} AS query FROM grouped WHERE {GAP_SQL} AND length({GAP_QUERY_SQL}) >= 8",
    "gap_words": f"SELECT part_id, unnest(regexp_extract_all({fold_sql('query')}, {WORD_SQL})) AS word FROM gaps",
    "gap_buckets": "SELECT part_id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 768 AS bucket, count(*) AS n FROM gap_words GROUP BY ALL",
    "gap_norms": "SELECT part_id, sqrt(sum(n * n)) AS norm FROM gap_buckets GROUP BY part_id",
    "gap_weights": "SELECT b.part_id, bucket, (n / norm)::FLOAT::DOUBLE AS v FROM gap_buckets b JOIN gap_norms USING (part_id)",
    "gap_lengths": "SELECT part_id, sqrt(sum(v * v)) AS len FROM gap_weights GROUP BY part_id",
    "candidates": "SELECT p.part_id, p.text, g.group_id FROM passages p JOIN grouped g ON g.part_id = p.part_id WHERE p.confirmed",
    "dots": """SELECT g.part_id AS query_id, w.part_id, sum(g.v * w.v) AS dot FROM gap_weights g
      JOIN weights w ON w.bucket = g.bucket JOIN candidates c ON c.part_id = w.part_id GROUP BY ALL""",
    "scored": """SELECT d.query_id, d.part_id, q.group_id, q.position, c.text, round(d.dot / (gl.len * l.len), 9) AS s
      FROM dots d JOIN gaps q ON q.part_id = d.query_id JOIN candidates c ON c.part_id = d.part_id
      JOIN gap_lengths gl ON gl.part_id = d.query_id JOIN lengths l ON l.part_id = d.part_id WHERE c.group_id <> q.group_id""",
    "nearest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, part_id) AS rank FROM scored) WHERE rank <= 4 AND round(s, 4) >= 0.55""",
    "near_texts": f"SELECT *, substr({squeeze_sql('text')}, 1, 400) AS neighbour FROM nearest",
    "first_seen": "SELECT query_id, group_id, position, neighbour, min(rank) AS rank FROM near_texts WHERE neighbour <> '' GROUP BY ALL",
    "per_group": "SELECT group_id, neighbour, min(position * 100 + rank) AS seen_at FROM first_seen GROUP BY ALL",
    "listed": "SELECT group_id, neighbour, row_number() OVER (PARTITION BY group_id ORDER BY seen_at, neighbour) AS rank FROM per_group",
}


def _gap_inputs(spark, sf):
    numbered = numbering.number_parts(desk.lines(spark, sf))
    group_id = F.concat("page_id", F.lit("#"), F.floor((F.col("linha_documento") - 1) / 8).cast("string"))
    grouped = numbered.select(
        F.col("part_id").alias("query_id"), group_id.alias("group_id"),
        ((F.col("linha_documento") - 1) * 10 + F.col("parte")).alias("position"), "text",
    )
    gaps = embedded(spark, precedents.gap_queries(grouped).drop("text"), text="query").withColumnRenamed("embedding", "vector")
    table = px.passages(numbered).filter("confirmed").select("part_id", "text", group_id.alias("group_id"))
    return durable(search.packed(gaps, "vector")), durable(search.packed(embedded(spark, table), "embedding"))


@query("gap_neighbours", with_desk("""
SELECT query_id, part_id, CAST(rank AS INTEGER) AS rank, round(s, 4) AS score, neighbour FROM near_texts WHERE neighbour <> ''
QUALIFY row_number() OVER (PARTITION BY query_id, neighbour ORDER BY rank) = 1""", **{**HASH_CTES, **GAPS}))
def gap_neighbours(spark, sf):
    gaps, table = _gap_inputs(spark, sf)
    return precedents.gap_neighbours(gaps, table).select("query_id", "part_id", "rank", "score", "neighbour")


@query("gap_precedents", with_desk("SELECT group_id, CAST(rank AS INTEGER) AS rank, neighbour FROM listed WHERE rank <= 4", **{**HASH_CTES, **GAPS}))
def gap_precedents(spark, sf):
    gaps, table = _gap_inputs(spark, sf)
    return precedents.gap_precedents(precedents.gap_neighbours(gaps, table), gaps)


def counting_model():
    """A stand-in for the vision model: says how many precedents its request quotes."""

    def ask(prompt: str, row: dict) -> str:
        texts = [f"relido {prompt.count(chr(10) + '- ')} {i}" for i in range(int(row["lines"]))]
        return json.dumps({"linhas": texts})

    return ask


CORRECTIONS = {
    **GROUP_CTES, **HASH_CTES, **GAPS,
    "line_groups": "SELECT page_id, linha_documento, g, row_number() OVER (PARTITION BY page_id, g ORDER BY linha_documento) - 1 AS position FROM walked",
    "part_groups": "SELECT n.part_id, n.parte, n.confirmed, n.text, n.page_id, l.linha_documento, l.g, l.page_id || '#' || l.g AS group_id, l.position FROM numbered n LEFT JOIN line_groups l ON l.page_id = n.page_id AND l.linha_documento = n.linha_documento",
    "grouped": "SELECT * FROM part_groups WHERE parte = 1 AND group_id IS NOT NULL",
    "candidates": "SELECT p.part_id, p.text, g.group_id FROM passages p JOIN part_groups g ON g.part_id = p.part_id WHERE p.confirmed",
    "scored": GAPS["scored"].replace("c.group_id <> q.group_id", "c.group_id IS DISTINCT FROM q.group_id"),
    "answered": "SELECT group_id, count(*) AS n FROM listed WHERE rank <= 4 GROUP BY group_id",
}


@query("corrections", with_desk(f"""
SELECT page_id, CAST(g AS INTEGER) AS group_no, CAST(position AS INTEGER) AS position,
  CASE WHEN a.n IS NOT NULL AND {GAP_SQL} THEN 'relido ' || a.n || ' ' || position ELSE text END AS text
FROM grouped LEFT JOIN answered a USING (group_id)""", **CORRECTIONS))
def corrections(spark, sf):
    """The corpus' own first parts as a first reading, corrected against its confirmed passages."""
    lines = desk.lines(spark, sf)
    pending = review.pending_lines(lines, only_empty=False)
    groups = durable(reading.read_groups(pending))
    texts = numbering.number_parts(lines).filter("parte = 1 AND include").select("page_id", "linha_documento", "text")
    order = W.partitionBy("page_id", "group_no").orderBy("linha_documento")
    readings = groups.join(texts, ["page_id", "linha_documento"]).withColumn("position", F.row_number().over(order) - 1)
    table = durable(search.packed(embedded(spark, passages(spark, sf).select("part_id", "text", "confirmed", F.lit(None).cast("bigint").alias("user_id"))), "embedding"))
    return transcribe.corrections(readings, groups, pending, table, counting_model).select("page_id", "group_no", "position", "text")


@query("merge_reread", with_desk(f"""
SELECT group_id, position, CASE WHEN {GAP_SQL} AND full_answer AND k % 4 <> 1 THEN 'relido ' || part_id ELSE text END AS text
FROM (SELECT *, NOT bool_or(doc_id % 5 = 0) OVER (PARTITION BY group_id) AS full_answer FROM (
  SELECT page_id AS group_id, doc_id, k, part_id, text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY linha_documento, parte) - 1 AS INTEGER) AS position FROM numbered))"""))
def merge_reread(spark, sf):
    """Pages as groups; every fifth page's answer is one row short, some answers are blank."""
    rows = numbering.number_parts(desk.lines(spark, sf, marks=False))
    placed = rows.withColumn("_at", F.row_number().over(W.partitionBy("page_id").orderBy("linha_documento", "parte")))
    first = placed.select(F.col("page_id").alias("group_id"), (F.col("_at") - 1).alias("position"), "text", "part_id", "line_pos")
    short = (doc_of() % 5 == 0) & (F.col("position") == 0)
    second = first.filter(~short).select(
        "group_id", "position", F.when(F.col("line_pos") % 4 == 1, " ").otherwise(F.concat(F.lit("relido "), "part_id")).alias("text")
    )
    return precedents.merge_reread(first.select("group_id", "position", "text"), second)
