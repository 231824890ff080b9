from pyspark.sql import functions as F

from folioscope.operators import edits, numbering, review
from folioscope.plans import desk
from folioscope.plans.desk_sql import strip_sql, with_desk, written_sql
from folioscope.plans.registry import query

PENDING_CTE = f"""
  SELECT page_id, line_id, linha_documento, x0, y0, x1, y1, string_agg(part_id, ',' ORDER BY parte) AS part_ids
  FROM numbered WHERE include GROUP BY ALL HAVING NOT bool_or({written_sql('text')})"""
ALL_PENDING_CTE = """
  SELECT page_id, line_id, linha_documento, x0, y0, x1, y1 FROM numbered WHERE include GROUP BY ALL"""


@query("pending_lines", with_desk("SELECT page_id, line_id, linha_documento, part_ids FROM pending", pending=PENDING_CTE))
def pending_lines(spark, sf):
    rows = review.pending_lines(desk.lines(spark, sf, marks=False))
    return rows.select("page_id", "line_id", "linha_documento", F.array_join("part_ids", ",").alias("part_ids"))


DRAFTS = f"SELECT * FROM numbered WHERE include AND {written_sql('text')} AND NOT confirmed AND NOT skipped"


@query("draft_parts", with_desk(f"SELECT page_id, line_id, part_id, linha_documento, parte, linha_transcrita, text FROM ({DRAFTS})"))
def draft_parts(spark, sf):
    rows = review.draft_parts(numbering.number_parts(desk.lines(spark, sf)))
    return rows.select("page_id", "line_id", "part_id", "linha_documento", "parte", "linha_transcrita", "text")


@query("review_position", with_desk("""
SELECT page_id, part_id, row_number() OVER w AS position, count(*) OVER () AS total,
  row_number() OVER (PARTITION BY page_id ORDER BY linha_documento, parte) AS page_position,
  count(*) OVER (PARTITION BY page_id) AS page_total, lag(part_id) OVER w AS previous_part, lead(part_id) OVER w AS next_part
FROM drafts WINDOW w AS (ORDER BY page_id, linha_documento, parte)""", drafts=DRAFTS))
def review_position(spark, sf):
    return review.review_positions(numbering.number_parts(desk.lines(spark, sf)))


def payload_parts(spark, sf):
    """The stored parts as an editor sends them back: changed texts, marks, blanks, new ids."""
    rows = numbering.part_rows(desk.lines(spark, sf))
    doc = F.split_part("part_id", F.lit("_"), F.lit(2)).cast("bigint")
    kind = (3 * doc + F.col("line_pos")) % 8
    return rows.select(
        "page_id",
        F.when(kind.isin(4, 7), F.concat("part_id", F.lit("n"))).otherwise(F.col("part_id")).alias("part_id"),
        F.when(kind.isin(0, 5), F.concat("text", F.lit(" x"))).when(kind == 3, " \t ").otherwise(F.col("text")).alias("text"),
        (kind == 1).alias("confirmed"),
        kind.isin(2, 5, 7).alias("skipped"),
    )


PAYLOAD_CTE = """
  SELECT page_id, CASE WHEN kind IN (4, 7) THEN part_id || 'n' ELSE part_id END AS part_id,
         CASE WHEN kind IN (0, 5) THEN text || ' x' WHEN kind = 3 THEN ' ' || chr(9) || ' ' ELSE text END AS text,
         kind = 1 AS confirmed, kind IN (2, 5, 7) AS skipped
  FROM (SELECT *, (3 * doc_id + k) % 8 AS kind FROM desk_parts)"""


@query("apply_confirmation", with_desk(f"""
SELECT n.page_id, n.part_id, n.text,
  CASE WHEN {strip_sql('n.text')} = '' THEN false WHEN n.confirmed THEN true
       WHEN n.skipped AND NOT (o.part_id IS NOT NULL AND o.text <> n.text) THEN false
       WHEN o.part_id IS NULL THEN true WHEN o.text <> n.text THEN false ELSE o.confirmed END AS confirmed,
  CASE WHEN {strip_sql('n.text')} = '' OR n.confirmed THEN false
       WHEN n.skipped AND NOT (o.part_id IS NOT NULL AND o.text <> n.text) THEN true
       WHEN o.part_id IS NULL OR o.text <> n.text THEN false ELSE o.skipped AND NOT o.confirmed END AS skipped
FROM payload n LEFT JOIN desk_parts o ON o.page_id = n.page_id AND o.part_id = n.part_id""", payload=PAYLOAD_CTE))
def apply_confirmation(spark, sf):
    return review.apply_confirmation(payload_parts(spark, sf), numbering.part_rows(desk.lines(spark, sf)))


@query("set_line_texts", with_desk(f"""
SELECT page_id, line_id, part_id,
  CASE WHEN hit AND parte = 1 THEN reading ELSE text END AS text,
  CASE WHEN hit AND parte = 1 THEN false ELSE confirmed END AS confirmed,
  CASE WHEN hit AND parte = 1 THEN false ELSE skipped END AS skipped
FROM (SELECT *, 'lido ' || line_id AS reading,
        (doc_id + k) % 3 = 0 AND NOT bool_or({written_sql('text')}) OVER (PARTITION BY page_id, line_id) AS hit FROM desk_parts)"""))
def set_line_texts(spark, sf):
    lines = desk.lines(spark, sf)
    readings = desk.boxes(spark, sf).filter(
        (F.split_part("line_id", F.lit("_"), F.lit(2)).cast("bigint") + F.col("line_pos")) % 3 == 0
    ).select("page_id", "line_id", F.concat(F.lit("lido "), "line_id").alias("text"))
    rows = numbering.part_rows(review.set_line_texts(lines, readings))
    return rows.select("page_id", "line_id", "part_id", "text", "confirmed", "skipped")


@query("strip_lines", with_desk(f"""
SELECT page_id, line_id, CAST(floor(x0 + 0.75 + 0.5) AS INTEGER) AS x0, CAST(floor(y0 - 0.5 + 0.5) AS INTEGER) AS y0,
  CAST(floor(x1 + 0.25 + 0.5) AS INTEGER) AS x1, CAST(floor(y1 + 0.5 + 0.5) AS INTEGER) AS y1,
  CASE WHEN k % 4 = 0 THEN true ELSE include END AS include, part_id, text,
  confirmed AND {written_sql('text')} AS confirmed, k % 3 = 0 AND {written_sql('text')} AND NOT confirmed AS skipped
FROM desk_parts"""))
def strip_lines(spark, sf):
    lines = desk.lines(spark, sf)
    raw = lines.withColumns({
        "x0": F.col("x0") + 0.75, "y0": F.col("y0") - 0.5, "x1": F.col("x1") + 0.25, "y1": F.col("y1") + 0.5,
        "include": F.when(F.col("line_pos") % 4 == 0, F.lit(None)).otherwise(F.col("include")),
        "parts": F.transform("parts", lambda p: p.withField("skipped", F.col("line_pos") % 3 == 0)),
    })
    rows = numbering.part_rows(review.strip_lines(raw))
    return rows.select("page_id", "line_id", "x0", "y0", "x1", "y1", "include", "part_id", "text", "confirmed", "skipped")


def faulty_lines(spark, sf):
    """Saved lines with rough boxes, and with broken ids on some pages."""
    doc = F.split_part("line_id", F.lit("_"), F.lit(2)).cast("bigint")
    k = F.col("line_pos")
    first = F.concat(F.lit("pt_"), doc.cast("string"), F.lit("_0_1"))
    return desk.lines(spark, sf).withColumn("_doc", doc).select(
        "page_id",
        F.when((F.col("_doc") % 50 == 7) & (k == 2), "bad id!")
        .when((F.col("_doc") % 50 == 9) & (k == 3), F.concat(F.lit("ln_"), F.col("_doc").cast("string"), F.lit("_0")))
        .otherwise(F.col("line_id")).alias("line_id"),
        "line_pos",
        (F.col("x0") + 0.5 - (F.col("_doc") % 3) * 30).alias("x0"),
        (F.col("y0") + 0.5).alias("y0"),
        (F.col("x1") + 0.5 + (k % 4) * 700).alias("x1"),
        F.col("y1").cast("double").alias("y1"),
        "include",
        F.when(k % 29 == 5, F.slice("parts", 1, 0))
        .when((F.col("_doc") % 50 == 11) & (k == 1), F.transform("parts", lambda p: p.withField("part_id", first)))
        .otherwise(F.col("parts")).alias("parts"),
    )


FAULTY = {
    "faulty": """
  SELECT doc_id, k, page_id, CASE WHEN doc_id % 50 = 7 AND k = 2 THEN 'bad id!' WHEN doc_id % 50 = 9 AND k = 3 THEN 'ln_' || doc_id || '_0'
         ELSE line_id END AS line_id, line_pos, x0 + 0.5::DOUBLE - (doc_id % 3) * 30 AS x0, y0 + 0.5::DOUBLE AS y0,
         x1 + 0.5::DOUBLE + (k % 4) * 700 AS x1, y1::DOUBLE AS y1, include FROM desk_lines""",
    "faulty_parts": """
  SELECT page_id, line_pos, parte, CASE WHEN doc_id % 50 = 11 AND k = 1 THEN 'pt_' || doc_id || '_0_1' ELSE part_id END AS part_id
  FROM desk_parts WHERE k % 29 <> 5""",
    "broken": """
  SELECT page_id, 'line' AS kind, line_id AS item_id, CASE WHEN NOT regexp_full_match(line_id, '[A-Za-z0-9_-]{1,48}') THEN 'malformed' ELSE 'repeated' END AS reason
  FROM faulty GROUP BY page_id, line_id HAVING count(*) > 1 OR NOT regexp_full_match(line_id, '[A-Za-z0-9_-]{1,48}')
  UNION ALL
  SELECT page_id, 'part', part_id, CASE WHEN NOT regexp_full_match(part_id, '[A-Za-z0-9_-]{1,48}') THEN 'malformed' ELSE 'repeated' END
  FROM faulty_parts GROUP BY page_id, part_id HAVING count(*) > 1 OR NOT regexp_full_match(part_id, '[A-Za-z0-9_-]{1,48}')""",
    "clamped": """
  SELECT f.*, p.width AS w, p.height AS h,
         greatest(0, least(p.width - 2, CAST(round_even(x0, 0) AS INTEGER))) AS a, greatest(0, least(p.height - 2, CAST(round_even(y0, 0) AS INTEGER))) AS b
  FROM faulty f JOIN desk_pages p ON p.page_id = f.page_id WHERE f.page_id NOT IN (SELECT page_id FROM broken)""",
}


@query("clean_lines", with_desk("""
SELECT c.page_id, c.line_id, c.a AS x0, c.b AS y0, greatest(a + 2, least(w, CAST(round_even(x1, 0) AS INTEGER))) AS x1,
  greatest(b + 2, least(h, CAST(round_even(y1, 0) AS INTEGER))) AS y1, c.include,
  coalesce(q.part_list, CASE WHEN c.include THEN 'pt_' || substr(sha256(c.page_id || '|' || c.line_id), 1, 8) ELSE '' END) AS part_list
FROM clamped c LEFT JOIN (SELECT page_id, line_pos, string_agg(part_id, ',' ORDER BY parte) AS part_list FROM faulty_parts GROUP BY ALL) q
  ON q.page_id = c.page_id AND q.line_pos = c.line_pos""", **FAULTY))
def clean_lines(spark, sf):
    rows, _ = review.clean_lines(faulty_lines(spark, sf), desk.pages(spark, sf))
    return rows.select(
        "page_id", "line_id", "x0", "y0", "x1", "y1", "include",
        F.array_join(F.transform("parts", lambda p: p["part_id"]), ",").alias("part_list"),
    )


@query("clean_lines_quarantine", with_desk("SELECT * FROM broken", **FAULTY))
def clean_lines_quarantine(spark, sf):
    return review.violations(faulty_lines(spark, sf))


def line_edits(spark, sf):
    """An edit log over the corpus' own lines: several ops per line, late ones first in the file."""
    doc = F.split_part("line_id", F.lit("_"), F.lit(2)).cast("bigint")
    k = F.col("line_pos")
    part = F.concat(F.lit("pt_"), doc.cast("string"), F.lit("_"), k.cast("string"), F.lit("_1"))
    s = doc + k

    def op(name, when, at, part_id=None, text=None, new_id=None, box=False):
        none = F.lit(None).cast("string")
        return F.when(when, F.struct(
            F.lit(name).alias("op"), F.lit(at).alias("at"), (none if part_id is None else part_id).alias("part_id"),
            (none if text is None else text).alias("text"), (none if new_id is None else new_id).alias("new_id"),
            *[(F.col(c) + 0.5 if box else F.lit(None).cast("double")).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")],
        ))

    extra = F.concat(F.lit("pn_"), F.col("line_id"))
    ops = F.array(
        op("text", s % 4 == 0, 5, part, F.concat(F.lit("novo "), F.col("line_id"))),
        op("text", s % 4 == 0, 2, part, F.lit("antigo")),
        op("confirm", s % 8 == 0, 7, part),
        op("skip", s % 8 == 4, 3, part),
        op("confirm", s % 10 == 1, 1, part),
        op("text", s % 10 == 1, 4, part, F.lit(" ")),
        op("split", s % 5 == 2, 6, part, new_id=extra),
        op("text", s % 15 == 2, 8, extra, F.lit("parte nova")),
        op("remove_part", s % 15 == 7, 9, part),
        op("omit", s % 6 == 3, 2), op("include", s % 12 == 3, 1), op("include", s % 12 == 9, 4),
        op("delete_line", s % 31 == 30, 3),
        op("box", s % 7 == 1, 3, box=True),
    )
    return desk.boxes(spark, sf).select("page_id", "line_id", "line_pos", "x0", "y0", "x1", "y1").select(
        "page_id", "line_id", F.explode(F.filter(ops, lambda o: o.isNotNull())).alias("o")
    ).select(
        "page_id", "line_id", "o.op", "o.part_id", "o.text", "o.new_id",
        *[F.col(f"o.b_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")],
        F.timestamp_seconds(F.col("o.at")).alias("ts"), F.col("o.at").cast("bigint").alias("event_id"),
    )


@query("apply_line_edits", with_desk(f"""
SELECT page_id, line_id, part_id, text, include, x0, y0, x1, y1, confirmed AND {written_sql('text')} AS confirmed,
  skipped AND {written_sql('text')} AND NOT (confirmed AND {written_sql('text')}) AS skipped
FROM (
  SELECT page_id, line_id, part_id, parte,
    CASE WHEN parte = 1 AND s % 4 = 0 THEN 'novo ' || line_id WHEN parte = 1 AND s % 10 = 1 THEN ' ' ELSE text END AS text,
    CASE WHEN s % 12 = 3 THEN false WHEN s % 12 = 9 THEN true ELSE include END AS include,
    CASE WHEN s % 7 = 1 THEN x0 + 1 ELSE x0 END AS x0, CASE WHEN s % 7 = 1 THEN y0 + 1 ELSE y0 END AS y0,
    CASE WHEN s % 7 = 1 THEN x1 + 1 ELSE x1 END AS x1, CASE WHEN s % 7 = 1 THEN y1 + 1 ELSE y1 END AS y1,
    CASE WHEN parte = 1 AND s % 8 = 0 THEN true WHEN parte = 1 AND s % 8 = 4 THEN false
         WHEN parte = 1 AND s % 10 = 1 THEN false ELSE confirmed END AS confirmed,
    CASE WHEN parte = 1 AND s % 8 = 0 THEN false WHEN parte = 1 AND s % 8 = 4 THEN true
         WHEN parte = 1 AND s % 10 = 1 THEN false ELSE skipped END AS skipped, s
  FROM (SELECT *, doc_id + k AS s FROM desk_parts)
  WHERE s % 31 <> 30 AND NOT (parte = 1 AND s % 15 = 7)
  UNION ALL
  SELECT page_id, line_id, 'pn_' || line_id, 0, CASE WHEN s % 15 = 2 THEN 'parte nova' ELSE '' END,
    CASE WHEN s % 12 = 3 THEN false WHEN s % 12 = 9 THEN true ELSE include END,
    CASE WHEN s % 7 = 1 THEN x0 + 1 ELSE x0 END, CASE WHEN s % 7 = 1 THEN y0 + 1 ELSE y0 END,
    CASE WHEN s % 7 = 1 THEN x1 + 1 ELSE x1 END, CASE WHEN s % 7 = 1 THEN y1 + 1 ELSE y1 END, false, false, s
  FROM (SELECT *, doc_id + k AS s FROM desk_lines) WHERE s % 31 <> 30 AND s % 5 = 2)"""))
def apply_line_edits(spark, sf):
    out = edits.apply_line_edits(desk.lines(spark, sf), line_edits(spark, sf))
    return numbering.part_rows(out).filter("part_id IS NOT NULL").select(
        "page_id", "line_id", "part_id", "text", "include", "x0", "y0", "x1", "y1", "confirmed", "skipped"
    )
