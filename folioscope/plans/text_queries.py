import uuid

from pyspark.sql import functions as F

from folioscope.functions import boxes as bx
from folioscope.functions import responses as rs
from folioscope.functions import text as tx
from folioscope.operators import numbering, postings, search
from folioscope.operators.spread import checkpoint_dir
from folioscope.plans import desk
from folioscope.plans.desk_sql import fold_sql, squeeze_sql, strip_sql, with_desk, written_sql
from folioscope.plans.registry import query

# Two words that occur in the corpus, one typed without its accent.
QUERY = " Réau mênt "
WORDS = ("reau", "ment")
MARKS = "(?i)r[eéèêë][aáàâãä][uúùûü]|m[eéèêë][nñ]t"


def texts(spark, sf):
    return numbering.part_rows(desk.lines(spark, sf, marks=False)).select("part_id", "text")


@query("fold_text", with_desk(f"SELECT part_id, {fold_sql('text')} AS folded FROM texted"))
def fold_text(spark, sf):
    return texts(spark, sf).select("part_id", tx.fold(F.col("text")).alias("folded"))


@query("content_hash", with_desk("SELECT part_id, sha256(text) AS content_hash FROM texted"))
def content_hash(spark, sf):
    return texts(spark, sf).select("part_id", tx.content_hash(F.col("text")).alias("content_hash"))


GAP_SQL = r"regexp_matches(text, '(?i)\[ileg[ií]vel\]')"
GAP_QUERY_SQL = squeeze_sql(r"regexp_replace(text, '(?i)\[ileg[ií]vel\]', ' ', 'g')")


@query("has_gap", with_desk(f"SELECT part_id, {GAP_SQL} AS gap FROM texted"))
def has_gap(spark, sf):
    return texts(spark, sf).select("part_id", tx.has_gap(F.col("text")).alias("gap"))


@query("gap_query", with_desk(f"SELECT part_id, {GAP_QUERY_SQL} AS query FROM texted"))
def gap_query(spark, sf):
    return texts(spark, sf).select("part_id", tx.gap_query(F.col("text")).alias("query"))


WORD_SQL = r"'[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)?'"


@query("tokens", with_desk(f"""
SELECT part_id, CAST(len(w) AS INTEGER) AS words, array_to_string(w, '|') AS joined
FROM (SELECT part_id, regexp_extract_all(text, {WORD_SQL}) AS w FROM texted)"""))
def tokens(spark, sf):
    words = tx.tokens(F.col("text"))
    return texts(spark, sf).select("part_id", F.size(words).alias("words"), F.array_join(words, "|").alias("joined"))


MATCH_SQL = f"(contains({fold_sql('text')}, '{WORDS[0]} {WORDS[1]}') OR (contains({fold_sql('text')}, '{WORDS[0]}') AND contains({fold_sql('text')}, '{WORDS[1]}')))"
HITS = f"SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY page_id, linha_documento, parte) AS pos FROM numbered WHERE {written_sql('text')} AND {MATCH_SQL}"


@query("text_match", with_desk("SELECT page_id, part_id FROM hits", hits=HITS))
def text_match(spark, sf):
    rows = numbering.part_rows(desk.lines(spark, sf, marks=False))
    return search.literal_hits(rows, QUERY).select("page_id", "part_id")


@query("name_match", with_desk(f"SELECT page_id, filename FROM desk_pages WHERE contains({fold_sql('filename')}, 'src1-fr')"))
def name_match(spark, sf):
    return search.name_matches(desk.pages(spark, sf), "Srć1-FR").select("page_id", "filename")


@query("highlight", with_desk(f"SELECT part_id, regexp_replace(text, '{MARKS}', '<mark>\\0</mark>', 'g') AS marked FROM texted"))
def highlight(spark, sf):
    return texts(spark, sf).select("part_id", tx.highlight(F.col("text"), QUERY).alias("marked"))


@query("highlight_spans", with_desk(f"""
SELECT part_id, CAST(len(regexp_extract_all(text, '{MARKS}')) AS INTEGER) AS hits, text AS joined FROM texted"""))
def highlight_spans(spark, sf):
    spans = tx.highlight_spans(F.col("text"), QUERY)
    return texts(spark, sf).select(
        "part_id",
        F.size(F.filter(spans, lambda s: s["hit"])).alias("hits"),
        F.array_join(F.transform(spans, lambda s: s["text"]), "").alias("joined"),
    )


SNIPPET_SQL = f"""CASE WHEN length(text) <= 180 THEN text
  WHEN NOT regexp_matches(text, '{MARKS}') THEN {strip_sql('substr(text, 1, 180)')} || '…'
  ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || {strip_sql('substr(text, s + 1, 180)')} || CASE WHEN s + 180 < length(text) THEN '…' ELSE '' END END"""
WINDOWED = f"SELECT *, greatest(0, length(regexp_split_to_array(text, '{MARKS}')[1]) - 56) AS s FROM"


@query("snippet", with_desk(f"SELECT part_id, {SNIPPET_SQL} AS snippet FROM ({WINDOWED} texted)"))
def snippet(spark, sf):
    return texts(spark, sf).select("part_id", tx.snippet(F.col("text"), QUERY).alias("snippet"))


@query("literal_search", with_desk(f"""
SELECT page_id, line_id, part_id, linha_documento, parte, text, {SNIPPET_SQL} AS snippet, total
FROM ({WINDOWED} hits)""", hits=HITS))
def literal_search(spark, sf):
    return search.literal_search(numbering.number_parts(desk.lines(spark, sf, marks=False)), QUERY)


@query("literal_search_postings", with_desk(f"""
SELECT page_id, line_id, part_id, linha_documento, parte, text, {SNIPPET_SQL} AS snippet, total
FROM ({WINDOWED} hits)""", hits=HITS))
def literal_search_postings(spark, sf):
    """The same search over posting lists written for the corpus."""
    root = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    numbered = numbering.number_parts(desk.lines(spark, sf, marks=False)).select("page_id", "line_id", "part_id", "linha_documento", "parte", "text")
    postings.write_postings(numbered, root)
    return postings.indexed_search(spark, root, QUERY)


@query("hits_by_page", with_desk("SELECT page_id, count(*) AS hits FROM hits GROUP BY page_id", hits=HITS))
def hits_by_page(spark, sf):
    return search.hits_by_page(numbering.number_parts(desk.lines(spark, sf, marks=False)), QUERY)


@query("clean_reading", with_desk(f"""
SELECT part_id, CASE WHEN lower({strip_sql('r')}) IN ('[sem texto]', 'sem texto') THEN '' ELSE {strip_sql('r')} END AS reading
FROM (SELECT part_id, CASE WHEN k % 4 = 0 THEN chr(9) || '[Sem texto] ' WHEN k % 4 = 1 THEN ' SEM TEXTO' ELSE '  ' || text || chr(160) END AS r FROM texted)"""))
def clean_reading(spark, sf):
    k = F.split_part("part_id", F.lit("_"), F.lit(3)).cast("int")
    raw = F.when(k % 4 == 0, "\t[Sem texto] ").when(k % 4 == 1, " SEM TEXTO").otherwise(F.concat(F.lit("  "), "text", F.lit(" ")))
    return texts(spark, sf).select("part_id", rs.clean_reading(raw).alias("reading"))


@query("after_think", with_desk(f"""
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 1 THEN '' ELSE {strip_sql('text')} END AS answer FROM conversations"""))
def after_think(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 3
    raw = (
        F.when(kind == 0, F.concat(F.lit("<think>a</Think>\n"), "text"))
        .when(kind == 1, F.concat(F.lit("<THINK>"), "text"))
        .otherwise(F.concat("text", F.lit(" \n")))
    )
    return desk.table(spark, sf, "conversations").select("conv_id", "turn", rs.after_think(raw).alias("answer"))


ANSWERS = f"""
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM conversations WHERE role = 'assistant'"""
ANSWER_TEXT = f"CASE WHEN (t.i - 1) % 5 = 3 THEN '' ELSE {strip_sql('t.t')} END"


@query("json_object", f"""
SELECT conv_id, turn, true AS parsed, CASE WHEN conv_id % 5 <> 4 THEN CAST(len(string_split(text, chr(10))) AS INTEGER) END AS items
FROM conversations WHERE role = 'assistant'""")
def json_object(spark, sf):
    """All answers; those whose list is one string have no items to count."""
    rows = desk.responses(spark, sf)
    found = rs.json_object(rs.after_think(F.col("response")))
    return rows.select("conv_id", "turn", found.isNotNull().alias("parsed"), F.json_array_length(F.get_json_object(found, "$.linhas")).alias("items"))


@query("response_texts", with_desk(f"""
SELECT p.conv_id, p.turn, CAST(p.i AS INTEGER) AS position, coalesce({ANSWER_TEXT}, '') AS text
FROM (SELECT conv_id, turn, unnest(range(1, 2 + turn % 4)) AS i FROM conversations WHERE role = 'assistant') p
LEFT JOIN answers t ON t.conv_id = p.conv_id AND t.turn = p.turn AND t.i = p.i""", answers=ANSWERS))
def response_texts(spark, sf):
    answer = rs.json_object(rs.after_think(F.col("response")))
    rows = desk.responses(spark, sf).select("conv_id", "turn", F.posexplode(rs.response_texts(answer, F.col("expected"))).alias("i", "text"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).alias("position"), "text")


@query("openai_content", f"""
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN NULL ELSE {strip_sql('text')} END AS content FROM conversations""")
def openai_content(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    half = F.floor(F.length("text") / 2).cast("int")
    text_list = F.array(
        F.struct(F.lit("text").alias("type"), F.substring("text", F.lit(1), half).alias("text")),
        F.struct(F.lit("text").alias("type"), F.substring("text", half + 1, F.length("text")).alias("text")),
    )

    def choices(message):
        return F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))

    payload = (
        F.when(kind == 0, choices(F.struct(F.col("text").alias("content"))))
        .when(kind == 1, choices(F.struct(text_list.alias("content"))))
        .when(kind == 2, choices(F.struct(F.lit("").alias("content"), F.concat(F.lit("<think>x</think>"), "text").alias("reasoning"))))
        .otherwise(F.lit('{"choices": []}'))
    )
    return desk.table(spark, sf, "conversations").select("conv_id", "turn", rs.openai_content(payload).alias("content"))


@query("failure_kind", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'runner' WHEN 'view' THEN 'timeout' WHEN 'purchase' THEN 'timeout'
  WHEN 'error' THEN 'retry' ELSE '' END AS kind,
  CASE event_type WHEN 'click' THEN 45.0::DOUBLE WHEN 'view' THEN 20.0::DOUBLE WHEN 'purchase' THEN 20.0::DOUBLE WHEN 'error' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS pause
FROM events""")
def failure_kind(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "error", "JSONDecodeError").when(kind == "purchase", "TimeoutError").otherwise("RuntimeError")
    message = (
        F.when(kind == "click", "Unexpected EOF").when(kind == "view", "HTTP 503: busy").otherwise(F.concat(F.lit("falha "), F.col("event_id").cast("string")))
    )
    rows = desk.table(spark, sf, "events").select("event_id", rs.failure_kind(name, message).alias("kind"))
    return rows.withColumn("pause", rs.failure_pause(F.col("kind")))


@query("parse_embeddings", """
SELECT vec_id, CASE WHEN vec_id % 5 = 3 THEN 'count' WHEN vec_id % 5 = 4 THEN 'size' END AS error,
  CASE WHEN vec_id % 5 < 3 THEN 2 ELSE -1 END AS vectors,
  CASE WHEN vec_id % 5 < 3 THEN round(embedding[1]::DOUBLE, 6) END AS first_value
FROM embeddings""")
def parse_embeddings(spark, sf):
    rows = desk.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    kind = F.col("vec_id") % 5
    other = F.reverse("v")
    payload = (
        F.when(kind == 0, F.to_json(F.struct(F.array("v", other).alias("embeddings"))))
        .when(kind.isin(1, 2), F.to_json(F.struct(F.array(
            F.struct(F.lit(1).alias("index"), other.alias("embedding")), F.struct(F.lit(0).alias("index"), F.col("v").alias("embedding"))
        ).alias("data"))))
        .when(kind == 3, F.to_json(F.struct(F.col("v").alias("embedding"))))
        .otherwise(F.to_json(F.struct(F.array("v", F.slice("v", 1, 3)).alias("embeddings"))))
    )
    vectors, error = rs.parse_embeddings(payload, F.lit(2), 64)
    return rows.select(
        "vec_id", error.alias("error"), F.coalesce(F.size(vectors), F.lit(-1)).alias("vectors"), F.round(vectors[0][0], 6).alias("first_value")
    )


@query("box_overlaps", with_desk("""
SELECT a.page_id, a.line_pos, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS x_overlap,
  greatest(0, least(a.y1, b.y1 - 50) - greatest(a.y0, b.y0 - 50)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) AS y_overlap
FROM desk_lines a JOIN desk_lines b ON a.page_id = b.page_id AND b.line_pos = a.line_pos + 1"""))
def box_overlaps(spark, sf):
    """Each box against the next line's box moved up by 50 pixels."""
    rows = desk.boxes(spark, sf)
    other = rows.select("page_id", (F.col("line_pos") - 1).alias("line_pos"), *[F.col(c).alias(f"o_{c}") for c in bx.CORNERS])
    moved = (F.col("o_x0"), F.col("o_y0") - 50, F.col("o_x1"), F.col("o_y1") - 50)
    return rows.join(other, ["page_id", "line_pos"]).select(
        "page_id", "line_pos", bx.x_overlap(bx.corners(), moved).alias("x_overlap"), bx.y_overlap(bx.corners(), moved).alias("y_overlap")
    )
