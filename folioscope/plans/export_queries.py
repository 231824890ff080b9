import uuid

from pyspark.sql import functions as F

from folioscope.operators import numbering
from folioscope.operators.spread import checkpoint_dir
from folioscope.plans import desk
from folioscope.plans.desk_sql import strip_sql, with_desk, written_sql
from folioscope.plans.geometry_queries import fragment_ctes
from folioscope.plans.registry import query
from folioscope.schemas import SESSION_PAGE
from folioscope.sources import exports, session


@query("export_rows", with_desk("""
SELECT page_id, linha_transcrita, linha_documento, parte, text AS texto, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS caixa,
  line_id AS id_linha_documento, part_id AS id_linha_transcrita FROM numbered WHERE include"""))
def export_rows(spark, sf):
    rows = exports.export_rows(numbering.number_parts(desk.lines(spark, sf, marks=False)))
    return rows.withColumn("caixa", F.array_join("caixa", ","))


@query("export_omitted", with_desk(f"""
SELECT page_id, linha_documento, x0 || ',' || y0 || ',' || x1 || ',' || y1 AS caixa,
  coalesce(string_agg(text, ' / ' ORDER BY parte) FILTER (WHERE {written_sql('text')}), '') AS texto_guardado
FROM numbered WHERE NOT include GROUP BY page_id, linha_documento, x0, y0, x1, y1"""))
def export_omitted(spark, sf):
    rows = exports.export_omitted(numbering.number_lines(desk.lines(spark, sf, marks=False)))
    return rows.withColumn("caixa", F.array_join("caixa", ","))


@query("export_text", with_desk(f"""
SELECT page_id, 0 AS section, 0 AS seq, '# ' || filename AS text FROM desk_pages
UNION ALL
SELECT page_id, 1, linha_transcrita, '[T' || printf('%03d', linha_transcrita) || ' | D' || printf('%03d', linha_documento) ||
  CASE WHEN count(*) OVER (PARTITION BY page_id, line_id) > 1 THEN ' parte ' || parte ELSE '' END || '] ' ||
  {strip_sql("replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), ' / ')")}
FROM numbered WHERE include QUALIFY {written_sql('text')}
UNION ALL
SELECT page_id, 2, 0, 'Fora da transcrição: ' || string_agg('D' || printf('%03d', linha_documento), ', ' ORDER BY linha_documento)
FROM line_numbers WHERE NOT include GROUP BY page_id
UNION ALL
SELECT page_id, 3, 0, '' FROM desk_pages WHERE page_id < (SELECT max(page_id) FROM desk_pages)"""))
def export_text(spark, sf):
    return exports.export_text(desk.pages(spark, sf), numbering.number_parts(desk.lines(spark, sf, marks=False)))


@query("export_pages", with_desk(f"""
SELECT p.page_id, p.filename AS arquivo, p.width AS largura, p.height AS altura, coalesce(i.n, 0) AS linhas, coalesce(i.digest, '') AS digest,
  coalesce(o.n, 0) AS fora, coalesce(o.texts, '') AS fora_textos
FROM desk_pages p LEFT JOIN (
  SELECT page_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(linha_transcrita || ':' || linha_documento || ':' || parte || ':' || text || ':' || x0 || ':' || part_id, '|' ORDER BY linha_transcrita)) AS digest
  FROM numbered WHERE include GROUP BY page_id) i USING (page_id)
LEFT JOIN (
  SELECT page_id, CAST(count(*) AS INTEGER) AS n, string_agg(linha_documento || ':' || t, '|' ORDER BY linha_documento) AS texts FROM (
    SELECT page_id, linha_documento, coalesce(string_agg(text, ' / ' ORDER BY parte) FILTER (WHERE {written_sql('text')}), '') AS t
    FROM numbered WHERE NOT include GROUP BY page_id, linha_documento) GROUP BY page_id) o USING (page_id)"""))
def export_pages(spark, sf):
    """The JSON document of every page, parsed again."""
    row = "struct<linha_transcrita:int,linha_documento:int,parte:int,texto:string,text:string,caixa:array<int>,id_linha_transcrita:string>"
    schema = f"arquivo string, largura int, altura int, linhas array<{row}>, linhas_documento_sem_transcricao array<struct<linha_documento:int,texto_guardado:string>>"
    documents = exports.export_pages(desk.pages(spark, sf), numbering.number_parts(desk.lines(spark, sf, marks=False)))
    page = documents.select("page_id", F.from_json("json", schema).alias("d"))
    included = F.transform("d.linhas", lambda r: F.concat_ws(
        ":", r["linha_transcrita"], r["linha_documento"], r["parte"], F.coalesce(r["texto"], r["text"]), r["caixa"][0], r["id_linha_transcrita"]))
    outside = F.transform("d.linhas_documento_sem_transcricao", lambda r: F.concat_ws(":", r["linha_documento"], r["texto_guardado"]))
    return page.select(
        "page_id", "d.arquivo", "d.largura", "d.altura", F.size("d.linhas").alias("linhas"),
        F.when(F.size("d.linhas") == 0, "").otherwise(F.md5(F.array_join(included, "|").cast("binary"))).alias("digest"),
        F.size("d.linhas_documento_sem_transcricao").alias("fora"), F.array_join(outside, "|").alias("fora_textos"),
    )


@query("save_session", with_desk("""
SELECT p.page_id, p.filename, p.width, p.height, p.view_scale, CAST(count(DISTINCT n.line_id) AS INTEGER) AS lines,
  md5(string_agg(n.part_id || ':' || n.text || ':' || n.confirmed || ':' || n.skipped, '|' ORDER BY n.line_pos, n.parte)) AS digest
FROM desk_pages p JOIN numbered n ON n.page_id = p.page_id GROUP BY ALL"""))
def save_session(spark, sf):
    """The rows of a snapshot as it was written, with a digest of their parts in order."""
    root = f"{checkpoint_dir(spark)}/session-{uuid.uuid4().hex}"
    path = session.save_session(desk.pages(spark, sf), desk.lines(spark, sf).drop("filename"), root, 1)
    nested = spark.read.schema(SESSION_PAGE).json(path)
    part = F.flatten(F.transform("lines", lambda l: F.transform(l["parts"], lambda p: F.concat_ws(
        ":", p["id"], p["text"], p["confirmed"].cast("string"), p["skipped"].cast("string")))))
    return nested.select(
        F.col("id").alias("page_id"), "filename", "width", "height", "view_scale", F.size("lines").alias("lines"),
        F.md5(F.array_join(part, "|").cast("binary")).alias("digest"),
    )


@query("load_session", with_desk("""
SELECT page_id, filename, line_id, d.line_pos, x0, y0, x1, y1, include, part_id, parte, text, confirmed, skipped
FROM desk_parts d JOIN flagged f USING (page_id, line_pos) WHERE keep""", **fragment_ctes("desk_lines")))
def load_session(spark, sf):
    """A snapshot written and read back, specks dropped."""
    root = f"{checkpoint_dir(spark)}/session-{uuid.uuid4().hex}"
    session.save_session(desk.pages(spark, sf), desk.lines(spark, sf).drop("filename"), root, 1)
    _, lines = session.load_session(spark, session.latest_snapshot(spark, root))
    return numbering.part_rows(lines).select(
        "page_id", "filename", "line_id", "line_pos", "x0", "y0", "x1", "y1", "include", "part_id", "parte", "text", "confirmed", "skipped"
    )
