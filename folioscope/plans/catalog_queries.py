from pyspark.sql import functions as F

from folioscope.operators import catalog, numbering
from folioscope.plans import desk
from folioscope.plans.desk_sql import with_desk
from folioscope.plans.registry import query


def numbered(spark, sf):
    return numbering.number_parts(desk.lines(spark, sf))


def stats(spark, sf):
    return catalog.page_stats(desk.lines(spark, sf))


@query("flatten_parts", with_desk("SELECT page_id, line_id, line_pos, parte, part_id, text, confirmed, skipped FROM desk_parts"))
def flatten_parts(spark, sf):
    return numbering.part_rows(desk.lines(spark, sf)).select(
        "page_id", "line_id", "line_pos", "parte", "part_id", "text", "confirmed", "skipped"
    )


@query("reading_columns", with_desk("SELECT page_id, line_id, reading_column FROM columned"))
def reading_columns(spark, sf):
    return numbering.reading_columns(desk.boxes(spark, sf)).select("page_id", "line_id", "reading_column")


@query("number_document_lines", with_desk("SELECT page_id, line_id, reading_column, linha_documento FROM line_numbers"))
def number_document_lines(spark, sf):
    return numbering.number_lines(desk.boxes(spark, sf)).select("page_id", "line_id", "reading_column", "linha_documento")


@query("number_transcript_lines", with_desk("SELECT page_id, part_id, linha_documento, parte, linha_transcrita FROM numbered"))
def number_transcript_lines(spark, sf):
    rows = numbering.number_parts(numbering.without_texts(desk.lines(spark, sf, marks=False)))
    return rows.select("page_id", "part_id", "linha_documento", "parte", "linha_transcrita")


@query("part_ordinals", with_desk("SELECT line_id, part_id, CAST(row_number() OVER (PARTITION BY line_id ORDER BY part_id) AS INTEGER) AS parte FROM desk_parts"))
def part_ordinals(spark, sf):
    return numbering.part_rows(numbering.without_texts(desk.lines(spark, sf, marks=False))).select("line_id", "part_id", "parte")


@query("line_labels", with_desk("""
SELECT page_id, line_id, linha_documento, 'D-' || printf('%03d', linha_documento) || '  ' ||
  CASE WHEN NOT include OR lo IS NULL THEN 'sem T' WHEN lo = hi THEN 'T-' || printf('%03d', lo)
       ELSE 'T-' || printf('%03d', lo) || '–' || printf('%03d', hi) END AS label
FROM (SELECT page_id, line_id, linha_documento, include, min(linha_transcrita) lo, max(linha_transcrita) hi
      FROM numbered GROUP BY ALL)"""))
def line_labels(spark, sf):
    return numbering.line_labels(numbering.number_parts(numbering.without_texts(desk.lines(spark, sf, marks=False))))


@query("page_view", with_desk("""
SELECT p.page_id, p.filename, p.width, p.height, coalesce(p.original_width, p.width) AS original_width,
  coalesce(p.original_height, p.height) AS original_height, origin_x, origin_y, view_scale::DOUBLE AS view_scale, prepared,
  coalesce(sensitivity, 0.55)::DOUBLE AS sensitivity,
  n.linha_documento, n.line_id, n.x0, n.y0, n.x1, n.y1, n.include, CAST(count(*) AS INTEGER) AS parts,
  string_agg(n.part_id || ':' || coalesce(n.linha_transcrita::VARCHAR, '-'), ',' ORDER BY n.parte) AS part_list
FROM desk_pages p JOIN numbered n ON n.page_id = p.page_id GROUP BY ALL"""))
def page_view(spark, sf):
    """The nested pages, flattened again so that every field can be compared."""
    view = numbering.page_view(desk.pages(spark, sf), numbered(spark, sf))
    flat = view.select(*[c for c in view.columns if c != "lines"], F.inline("lines"))
    part = F.transform(
        "parts",
        lambda p: F.concat(p["part_id"], F.lit(":"), F.coalesce(p["linha_transcrita"].cast("string"), F.lit("-"))),
    )
    return flat.select(
        *[c for c in view.columns if c != "lines"],
        "linha_documento", "line_id",
        *[F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))],
        "include", F.size("parts").alias("parts"), F.array_join(part, ",").alias("part_list"),
    )


@query("page_stats", with_desk("SELECT * FROM page_stats"))
def page_stats(spark, sf):
    return stats(spark, sf)


@query("corpus_totals", with_desk("SELECT count(*) AS documents, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(written) AS BIGINT) AS written FROM page_stats"))
def corpus_totals(spark, sf):
    return catalog.corpus_totals(desk.pages(spark, sf), stats(spark, sf))


STATUS_SQL = """
SELECT page_id, lines, written, confirmed,
  CASE WHEN lines = 0 THEN 'Sem linhas' WHEN written = 0 THEN '0 de ' || lines || ' linhas'
       WHEN confirmed = 0 THEN written || ' de ' || lines || ' linhas'
       WHEN confirmed = written THEN written || ' de ' || lines || ' linhas conferidas'
       ELSE written || ' de ' || lines || ' linhas · ' || confirmed || ' conferidas' END AS status,
  CAST(CASE WHEN lines = 0 THEN 0 ELSE floor(written / lines * 100 + 0.5) END AS INTEGER) AS percent
FROM page_stats"""


@query("status_label", with_desk(STATUS_SQL))
def status_label(spark, sf):
    return catalog.with_status(stats(spark, sf)).drop("preview")


@query("scope_filter", with_desk("""
SELECT 'todos' AS scope, page_id FROM page_stats UNION ALL
SELECT 'texto', page_id FROM page_stats WHERE written > 0 UNION ALL
SELECT 'vazio', page_id FROM page_stats WHERE written = 0"""))
def scope_filter(spark, sf):
    base = stats(spark, sf)
    parts = [
        catalog.in_scope(base, scope).select(F.lit(scope).alias("scope"), "page_id") for scope in ("todos", "texto", "vazio")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
