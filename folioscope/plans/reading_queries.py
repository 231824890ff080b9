import json

from pyspark.sql import functions as F

from folioscope.operators import reading, review
from folioscope.plans import desk
from folioscope.plans.desk_sql import with_desk, written_sql
from folioscope.plans.registry import query
from folioscope.plans.review_queries import ALL_PENDING_CTE

# The greedy rule walked line by line.
GROUPS = """
  SELECT page_id, rn, linha_documento, y0, y0 AS top, 1 AS n, 1 AS g FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.page_id, r.rn, r.linha_documento, r.y0,
    CASE WHEN r.y0 < p.y0 OR r.y1 - p.top > 520 OR p.n >= 8 THEN r.y0 ELSE p.top END,
    CASE WHEN r.y0 < p.y0 OR r.y1 - p.top > 520 OR p.n >= 8 THEN 1 ELSE p.n + 1 END,
    CASE WHEN r.y0 < p.y0 OR r.y1 - p.top > 520 OR p.n >= 8 THEN p.g + 1 ELSE p.g END
  FROM walked p JOIN ranked r ON r.page_id = p.page_id AND r.rn = p.rn + 1"""
GROUP_CTES = {
    "all_pending": ALL_PENDING_CTE,
    "ranked": "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY linha_documento) AS rn FROM all_pending",
    "walked": GROUPS,
}


def included(spark, sf):
    return review.pending_lines(desk.lines(spark, sf, marks=False), only_empty=False)


def groups(spark, sf):
    return reading.read_groups(included(spark, sf))


@query("read_groups", with_desk("SELECT page_id, linha_documento, CAST(g AS INTEGER) AS group_no FROM walked", **GROUP_CTES))
def read_groups(spark, sf):
    return groups(spark, sf)


SPANS = """
  SELECT page_id, g AS group_no, count(*) AS lines, CASE WHEN min(linha_documento) = max(linha_documento) THEN 'D-' || printf('%03d', min(linha_documento))
    ELSE 'D-' || printf('%03d', min(linha_documento)) || ' a D-' || printf('%03d', max(linha_documento)) END AS span
  FROM walked GROUP BY page_id, g"""


@query("group_spans", with_desk("""
SELECT page_id, CAST(group_no AS INTEGER) AS group_no, CAST(max(group_no) OVER (PARTITION BY page_id) AS INTEGER) AS groups, lines, span,
  'Lendo ' || span || ' (' || group_no || ' de ' || max(group_no) OVER (PARTITION BY page_id) || ')' AS message FROM spans""", spans=SPANS, **GROUP_CTES))
def group_spans(spark, sf):
    return reading.group_spans(groups(spark, sf))


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


PROMPT_SQL = f"""
  'Esta imagem é um recorte de manuscrito com ' || lines || CASE WHEN lines = 1 THEN ' linha' ELSE ' linhas' END || ' de escrita, de cima para baixo.' ||
  CASE WHEN lines > 1 THEN ' Cada linha está isolada, com uma faixa clara entre uma e outra.' ELSE '' END || chr(10) ||
  {sql_text(reading.PROMPT_RULES)} || '{{"linhas":[' || array_to_string(list_transform(range(lines), lambda x: '"..."'), ', ') || ']}}' ||
  CASE WHEN doc % 3 = 0 THEN {sql_text(reading.PROMPT_COLUMNS)} ELSE '' END || {sql_text(reading.PROMPT_FORMS)} || 'saca, trigo.' ||
  CASE WHEN group_no = 1 THEN {sql_text(reading.PROMPT_NEIGHBOURS)} || '- um' || chr(10) || '- dois' || {sql_text(reading.PROMPT_NEIGHBOURS_END)} ELSE '' END"""


@query("build_prompts", with_desk(f"""
SELECT page_id, CAST(group_no AS INTEGER) AS group_no, CAST(lines AS INTEGER) AS lines, {PROMPT_SQL} AS prompt
FROM (SELECT *, substr(page_id, 2)::BIGINT - 1 AS doc FROM spans)""", spans=SPANS, **GROUP_CTES))
def build_prompts(spark, sf):
    from folioscope.plans.geometry_queries import gutters

    rows = groups(spark, sf)
    precedents = rows.filter("group_no = 1").select("page_id", "group_no").distinct().withColumn(
        "neighbours", F.array(F.lit("um"), F.lit("dois"))
    )
    return reading.build_prompts(rows, gutters(spark, sf), ["saca", "trigo"], precedents)


def echo_model():
    """A stand-in for the vision model: it answers from the request's own numbers, and fails on some."""

    def ask(prompt: str, row: dict) -> str:
        page, group, lines = int(row["page_id"][1:]), int(row["group_no"]), int(row["lines"])
        if (page + group) % 6 == 5:
            raise RuntimeError("HTTP 503")
        texts = [f"lido {page} {group} {i}" for i in range(lines)]
        if (page + group) % 6 == 4:
            texts = texts[:-1] + [" [Sem texto] "]
        body = json.dumps({"linhas": texts}, ensure_ascii=False)
        return f"<think>{group}</think>```json\n{body}\n```" if group % 2 else body

    return ask


READ_CTES = {
    **GROUP_CTES,
    "pending": f"SELECT page_id, line_id, linha_documento, y0, y1 FROM numbered WHERE include GROUP BY ALL HAVING NOT bool_or({written_sql('text')})",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY linha_documento) AS rn FROM pending",
    "placed": """SELECT *, row_number() OVER (PARTITION BY page_id, g ORDER BY rn) - 1 AS position, count(*) OVER (PARTITION BY page_id, g) AS size,
        substr(page_id, 2)::BIGINT AS page FROM walked""",
    "answers": """SELECT page_id, linha_documento, CASE WHEN (page + g) % 6 = 4 AND position = size - 1 THEN ''
        ELSE 'lido ' || page || ' ' || g || ' ' || position END AS reading FROM placed WHERE (page + g) % 6 <> 5""",
}


@query("read_lines", with_desk("""
SELECT n.page_id, n.part_id, CASE WHEN a.page_id IS NOT NULL AND n.parte = 1 THEN a.reading ELSE n.text END AS text,
  CASE WHEN a.page_id IS NOT NULL AND n.parte = 1 THEN false ELSE n.confirmed END AS confirmed
FROM numbered n LEFT JOIN answers a ON a.page_id = n.page_id AND a.linha_documento = n.linha_documento""", **READ_CTES))
def read_lines(spark, sf):
    from folioscope.operators.numbering import part_rows

    lines, _ = _read(spark, sf)
    return part_rows(lines).select("page_id", "part_id", "text", "confirmed")


def _read(spark, sf):
    """The stand-in model is not busy, so nothing is waited for between the rounds."""
    from folioscope.operators.transcribe import read_lines as read

    return read(desk.lines(spark, sf), desk.pages(spark, sf), echo_model, wait=lambda seconds: None)


READ_SPANS = SPANS.replace("FROM walked", "FROM placed")


@query("read_lines_outcome", with_desk("""
SELECT p.page_id, coalesce(o.groups, 0) AS groups, coalesce(o.failures, 0) AS failures,
  CASE WHEN o.failures = o.groups THEN 'error' WHEN o.failures > 0 THEN 'partial' ELSE 'done' END AS status,
  CASE WHEN o.groups IS NULL THEN 'Nenhuma linha vazia para ler.' WHEN o.failures = o.groups THEN o.first
       WHEN o.failures > 0 THEN 'Leitura parcial. ' || o.first ELSE 'Transcrição pronta.' END AS message
FROM desk_pages p LEFT JOIN (
  SELECT page_id, count(*) AS groups, count(*) FILTER (WHERE bad) AS failures, arg_min(span || ': HTTP 503', group_no) FILTER (WHERE bad) AS first
  FROM (SELECT *, (substr(page_id, 2)::BIGINT + group_no) % 6 = 5 AS bad FROM spans) GROUP BY page_id) o USING (page_id)""", **READ_CTES, spans=READ_SPANS))
def read_lines_outcome(spark, sf):
    """What became of every page of the same reading, pages with nothing to read included."""
    _, outcome = _read(spark, sf)
    return outcome


@query("reading_outcome", with_desk("""
SELECT page_id, count(*) AS groups, count(*) FILTER (WHERE bad) AS failures,
  CASE WHEN bool_and(bad) THEN 'error' WHEN bool_or(bad) THEN 'partial' ELSE 'done' END AS status,
  CASE WHEN bool_and(bad) THEN arg_min(span || ': HTTP 503', group_no) FILTER (WHERE bad)
       WHEN bool_or(bad) THEN 'Leitura parcial. ' || arg_min(span || ': HTTP 503', group_no) FILTER (WHERE bad)
       ELSE 'Transcrição pronta.' END AS message
FROM (SELECT *, (substr(page_id, 2)::BIGINT + group_no) % 6 = 5 AS bad FROM spans) GROUP BY page_id""", spans=SPANS, **GROUP_CTES))
def reading_outcome(spark, sf):
    spans = reading.group_spans(groups(spark, sf))
    page = F.substring("page_id", 2, 20).cast("bigint")
    failed = spans.withColumn("failure", F.when((page + F.col("group_no")) % 6 == 5, "HTTP 503"))
    return reading.reading_outcome(failed.select("page_id", "group_no", "span", "failure"))


@query("batch_by_16", with_desk("SELECT CAST(16 AS INTEGER) AS largest_request, count(*) AS texts FROM texted"))
def batch_by_16(spark, sf):
    """Every request carries 16 texts at most: the answers say how large their request was."""
    from folioscope.operators.embedding import embed_texts
    from folioscope.operators.numbering import part_rows

    def factory():
        return lambda texts: [[float(len(texts)), 0.0] for _ in texts]

    rows = part_rows(desk.lines(spark, sf, marks=False)).select("part_id", "text")
    sized = embed_texts(rows, factory, width=2).select(F.col("embedding")[0].cast("int").alias("size"))
    return sized.agg(F.max("size").alias("largest_request"), F.count("*").alias("texts"))
