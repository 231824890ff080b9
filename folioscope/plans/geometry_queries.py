from pyspark.sql import functions as F

from folioscope.functions import boxes as bx
from folioscope.operators import fragments, geometry, redetect as again, review
from folioscope.plans import desk
from folioscope.plans.desk_sql import with_desk, written_sql
from folioscope.plans.registry import query
from folioscope.plans.review_queries import ALL_PENDING_CTE
from folioscope.sources import segmentation


def doc_of(column="page_id"):
    return F.substring(column, 2, 20).cast("bigint") - 1


def fragment_ctes(source: str) -> dict[str, str]:
    """The rule as a join of narrow and wide boxes, the way it is stated."""
    return {
        "sized": f"SELECT *, x1 - x0 AS w, count(*) OVER (PARTITION BY page_id) AS boxes, row_number() OVER (PARTITION BY page_id ORDER BY x1 - x0) AS wr FROM {source}",
        "limits": "SELECT page_id, greatest(48, CAST(trunc(w * 0.15::DOUBLE) AS INTEGER)) AS lim FROM sized WHERE wr = boxes // 2 + 1",
        "covered": """SELECT a.page_id, a.line_pos, any_value(a.boxes) AS boxes,
            any_value(a.w) >= any_value(l.lim) OR count(b.page_id) >= 2 AS ok
          FROM sized a JOIN limits l ON l.page_id = a.page_id
          LEFT JOIN sized b ON a.w < l.lim AND b.page_id = a.page_id AND b.w >= l.lim AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > a.w * 0.5
          GROUP BY a.page_id, a.line_pos""",
        "flagged": "SELECT page_id, line_pos, boxes < 8 OR ok OR sum(ok::INTEGER) OVER (PARTITION BY page_id) < 4 AS keep FROM covered",
    }


@query("drop_fragments", with_desk("SELECT page_id, line_pos, keep FROM flagged", **fragment_ctes("desk_lines")))
def drop_fragments(spark, sf):
    return fragments.flag_fragments(desk.boxes(spark, sf)).select("page_id", "line_pos", "keep")


@query("read_segmentation", with_desk("""
SELECT page_id, line_id, 0 AS line_pos, x0, y0, x1, y1 FROM desk_lines
UNION ALL SELECT page_id, line_id, 2, x0 + 1, y0, x1 + 1, y1 FROM desk_lines WHERE k % 3 = 0"""))
def read_segmentation(spark, sf):
    box = F.array(*[F.col(c).cast("double") for c in bx.CORNERS])
    near = F.array(F.col("x0") + 1.75, F.col("y0").cast("double"), F.col("x1") + 1.25, F.col("y1").cast("double"))
    lines = F.when(
        F.col("line_pos") % 3 == 0, F.array(F.struct(box.alias("box")), F.struct(F.slice(box, 1, 3).alias("box")), F.struct(near.alias("box")))
    ).otherwise(F.array(F.struct(box.alias("box")), F.struct(F.slice(box, 1, 2).alias("box"))))
    answers = desk.boxes(spark, sf).select("page_id", "line_id", F.to_json(F.struct(lines.alias("lines"))).alias("payload"))
    return segmentation.read_segmentation(answers)


SEGMENTS = """
  SELECT * FROM (
    SELECT s.page_id, line_pos, CAST(greatest(0, least(x0 - 6, p.width - 1)) AS INTEGER) AS x0,
           CAST(greatest(0, least(CASE WHEN k % 4 <> 0 THEN y0 ELSE y1 - 16 END, p.height - 1)) AS INTEGER) AS y0,
           CAST(least(x1 + 6, p.width) AS INTEGER) AS x1,
           CAST(least(CASE WHEN k % 4 <> 0 THEN y1 ELSE y1 + 10 END, p.height) AS INTEGER) AS y1, p.height AS page_height
    FROM desk_lines s JOIN desk_pages p ON p.page_id = s.page_id)
  WHERE x1 - x0 >= 24 AND y1 - y0 >= 8 AND y1 - y0 <= page_height * 0.22"""


@query("segmentation_boxes", with_desk("""
SELECT b.page_id, b.line_pos, b.x0, b.y0, b.x1, b.y1 FROM segment_boxes b
JOIN flagged f ON f.page_id = b.page_id AND f.line_pos = b.line_pos WHERE keep""", segment_boxes=SEGMENTS, **fragment_ctes("segment_boxes")))
def segmentation_boxes(spark, sf):
    return segmentation.segmentation_boxes(desk.segments(spark, sf), desk.pages(spark, sf))


@query("clamp_box", with_desk("""
SELECT page_id, line_pos, a AS x0, b AS y0, greatest(a + 8, least(w, CAST(floor(fx1 + 0.5) AS INTEGER))) AS x1,
  greatest(b + 8, least(h, CAST(floor(fy1 + 0.5) AS INTEGER))) AS y1
FROM (SELECT l.page_id, l.line_pos, p.width AS w, p.height AS h, x1 * 1.5::DOUBLE AS fx1, y1 * 0.5::DOUBLE AS fy1,
        greatest(0, least(p.width - 8, CAST(floor(x0 - 45.5::DOUBLE + 0.5) AS INTEGER))) AS a,
        greatest(0, least(p.height - 8, CAST(floor(y0 * 1.25::DOUBLE + 0.5) AS INTEGER))) AS b
      FROM desk_lines l JOIN desk_pages p ON p.page_id = l.page_id)"""))
def clamp_box(spark, sf):
    rows = desk.boxes(spark, sf).join(desk.pages(spark, sf).select("page_id", "width", "height"), "page_id")
    rough = (F.col("x0") - 45.5, F.col("y0") * 1.25, F.col("x1") * 1.5, F.col("y1") * 0.5)
    box = bx.clamp_box(rough, F.col("width"), F.col("height"), 8, bx.half_up)
    return rows.select("page_id", "line_pos", *bx.named(box))


@query("to_original_box", with_desk("""
SELECT l.page_id, line_pos, round(origin_x + x0 / s, 6) AS x0, round(origin_y + y0 / s, 6) AS y0,
  round(origin_x + x1 / s, 6) AS x1, round(origin_y + y1 / s, 6) AS y1
FROM desk_lines l JOIN (SELECT *, CASE WHEN view_scale = 3 THEN 1.0 ELSE view_scale END::DOUBLE AS s FROM desk_pages) p ON p.page_id = l.page_id"""))
def to_original_box(spark, sf):
    pages = desk.pages(spark, sf).select("page_id", "crop_origin", "view_scale")
    rows = desk.boxes(spark, sf).join(pages, "page_id")
    scale = F.when(F.col("view_scale") == 3, F.lit(-1)).otherwise(F.col("view_scale"))
    box = bx.to_original_box(bx.corners(), F.col("crop_origin"), scale)
    return rows.select("page_id", "line_pos", *[F.round(c, 6).alias(n) for c, n in zip(box, bx.CORNERS)])


VIEW_SQL = """
  SELECT page_id, line_pos, a AS x0, b AS y0, least(greatest(CAST(round_even((x1 - ox) * f, 0) AS INTEGER), a + 1), width) AS x1,
         least(greatest(CAST(round_even((y1 - oy) * f, 0) AS INTEGER), b + 1), height) AS y1
  FROM (SELECT l.*, greatest(0, least(CAST(round_even((x0 - ox) * f, 0) AS INTEGER), width - 1)) AS a,
               greatest(0, least(CAST(round_even((y0 - oy) * f, 0) AS INTEGER), height - 1)) AS b FROM source_boxes l)"""


@query("to_view_box", with_desk("SELECT * FROM viewed", viewed=VIEW_SQL, source_boxes="""
  SELECT l.page_id, line_pos, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, origin_x AS ox, origin_y AS oy,
         view_scale * 0.5::DOUBLE AS f, 1500 AS width, height FROM desk_lines l JOIN desk_pages p ON p.page_id = l.page_id"""))
def to_view_box(spark, sf):
    rows = desk.boxes(spark, sf).join(desk.pages(spark, sf).select("page_id", "height", "crop_origin", "view_scale"), "page_id")
    origin = F.col("crop_origin")
    box = bx.to_view_box(bx.corners(), origin[0], origin[1], F.col("view_scale") * 0.5, F.lit(1500), F.col("height"))
    return rows.select("page_id", "line_pos", *bx.named(box))


def views(spark, sf):
    doc = doc_of()
    return desk.pages(spark, sf).select(
        "page_id", (doc % 40).cast("int").alias("origin_x"), (doc % 20).cast("int").alias("origin_y"),
        (1 + doc % 2).cast("int").alias("scale"), F.lit(3000).alias("width"), (F.col("height") * 2).alias("height"),
        F.lit(2300).alias("original_width"), (F.col("height") + 60).alias("original_height"),
    )


REPROJECT = {
    "due_pages": "SELECT *, NOT (prepared AND prep_version >= 3) AS due FROM desk_pages",
    "source_boxes": """
  SELECT l.page_id, l.line_pos, p.doc_id % 40 AS ox, p.doc_id % 20 AS oy, (1 + p.doc_id % 2)::DOUBLE AS f, 3000 AS width, 2 * p.height AS height,
         CASE WHEN p.prepared THEN p.origin_x + l.x0 / p.view_scale::DOUBLE ELSE l.x0 END AS x0,
         CASE WHEN p.prepared THEN p.origin_y + l.y0 / p.view_scale::DOUBLE ELSE l.y0 END AS y0,
         CASE WHEN p.prepared THEN p.origin_x + l.x1 / p.view_scale::DOUBLE ELSE l.x1 END AS x1,
         CASE WHEN p.prepared THEN p.origin_y + l.y1 / p.view_scale::DOUBLE ELSE l.y1 END AS y1
  FROM desk_lines l JOIN due_pages p ON p.page_id = l.page_id WHERE p.due""",
    "viewed": VIEW_SQL,
}


@query("reproject_pages", with_desk("""
SELECT l.page_id, l.line_pos, coalesce(v.x0, l.x0) AS x0, coalesce(v.y0, l.y0) AS y0, coalesce(v.x1, l.x1) AS x1, coalesce(v.y1, l.y1) AS y1,
  CASE WHEN due THEN 3000 ELSE p.width END AS width, CAST(CASE WHEN due THEN 1 + p.doc_id % 2 ELSE p.view_scale END AS INTEGER) AS view_scale,
  3 AS prep_version, CAST(CASE WHEN due THEN p.doc_id % 40 ELSE p.origin_x END AS INTEGER) AS origin_x
FROM desk_lines l JOIN due_pages p ON p.page_id = l.page_id LEFT JOIN viewed v ON v.page_id = l.page_id AND v.line_pos = l.line_pos""", **REPROJECT))
def reproject_pages(spark, sf):
    lines, pages = geometry.reproject_pages(desk.boxes(spark, sf), desk.pages(spark, sf), views(spark, sf))
    fields = pages.select("page_id", "width", "view_scale", "prep_version", F.col("crop_origin")[0].alias("origin_x"))
    return lines.select("page_id", "line_pos", *bx.CORNERS).join(fields, "page_id")


@query("reading_scale", with_desk("""
SELECT page_id, CASE WHEN 3 * greatest(height * 3, width) <= 12000 THEN 3 WHEN 2 * greatest(height * 3, width) <= 12000 THEN 2 ELSE 1 END AS scale
FROM desk_pages"""))
def reading_scale(spark, sf):
    return desk.pages(spark, sf).select("page_id", bx.reading_scale(F.col("height") * 3, F.col("width")).alias("scale"))


def gutters(spark, sf):
    """A given gutter on the pages that may be open books."""
    doc = doc_of()
    return desk.pages(spark, sf).filter(doc % 3 == 0).select(
        "page_id", (960 + doc % 20).cast("int").alias("gutter_start"), (1030 + doc % 15).cast("int").alias("gutter_end")
    )


GUTTERS = {
    "gutters": "SELECT page_id, CAST(960 + doc_id % 20 AS INTEGER) AS g0, CAST(1030 + doc_id % 15 AS INTEGER) AS g1 FROM desk_pages WHERE doc_id % 3 = 0",
    "limited": """
  SELECT l.*, g.g0, g.g1, CASE WHEN whole THEN x0 WHEN on_left >= on_right THEN x0 ELSE greatest(x0, g.g1) END AS c0,
         CASE WHEN whole THEN x1 WHEN on_left >= on_right THEN least(x1, g.g0) ELSE x1 END AS c1
  FROM (SELECT l.*, g.g0, g.g1, g.g0 IS NULL OR x1 <= g.g0 OR x0 >= g.g1 AS outside,
               greatest(0, least(x1, g.g0) - x0) AS on_left, greatest(0, x1 - greatest(x0, g.g1)) AS on_right,
               coalesce(g.g0 IS NULL OR x1 <= g.g0 OR x0 >= g.g1 OR
                 CASE WHEN greatest(0, least(x1, g.g0) - x0) >= greatest(0, x1 - greatest(x0, g.g1))
                      THEN least(x1, g.g0) - x0 ELSE x1 - greatest(x0, g.g1) END < 24, true) AS whole
        FROM to_limit l LEFT JOIN gutters g ON g.page_id = l.page_id) l LEFT JOIN gutters g ON g.page_id = l.page_id""",
}


@query("limit_box", with_desk("SELECT page_id, line_pos, c0 AS x0, y0, c1 AS x1, y1 FROM limited",
       to_limit="SELECT page_id, line_pos, x0 + 400 AS x0, y0, x1 + 400 AS x1, y1 FROM desk_lines", **GUTTERS))
def limit_box(spark, sf):
    """Boxes moved right by 400 pixels, so that many cross the gutter."""
    rows = desk.boxes(spark, sf).withColumns({"x0": F.col("x0") + 400, "x1": F.col("x1") + 400}).join(gutters(spark, sf), "page_id", "left")
    box = bx.limit_box(bx.corners(), F.col("gutter_start"), F.col("gutter_end"))
    return rows.select("page_id", "line_pos", *bx.named(box))


@query("gutter_matches", with_desk("""
SELECT page_id, "left", "right", crossing, ("left" >= 2 AND "right" >= 2) OR (crossing >= 2 AND "left" + "right" + crossing >= 4) AS matches
FROM (SELECT l.page_id, count(*) FILTER (WHERE (x0 + x1) / 2.0 < g0) AS "left", count(*) FILTER (WHERE (x0 + x1) / 2.0 > g1) AS "right",
        count(*) FILTER (WHERE x0 < g0 - 8 AND x1 > g1 + 8) AS crossing
      FROM desk_lines l JOIN gutters g ON g.page_id = l.page_id GROUP BY l.page_id)""", **GUTTERS))
def gutter_matches(spark, sf):
    return geometry.gutter_matches(desk.boxes(spark, sf), gutters(spark, sf)).drop("gutter_start", "gutter_end")


# Pages of 2200 pixels: 27 taps, the lowest pixel of [396, 1804), bounds in [264, 1936].
VALLEYS = {
    "spans": "SELECT page_id, greatest(0, least(2200, x0)) AS a, greatest(0, least(2200, x1)) AS b FROM desk_lines",
    "steps": """SELECT page_id, x, sum(d) AS d FROM (
      SELECT page_id, a AS x, 1 AS d FROM spans WHERE b > a UNION ALL SELECT page_id, b, -1 FROM spans WHERE b > a) GROUP BY ALL""",
    "boxed_pages": "SELECT page_id FROM spans GROUP BY page_id HAVING count(*) >= 4",
    "pixels": """SELECT p.page_id, r.x, sum(coalesce(s.d, 0)) OVER (PARTITION BY p.page_id ORDER BY r.x) AS c
      FROM boxed_pages p CROSS JOIN (SELECT unnest(range(2200)) AS x) r LEFT JOIN steps s ON s.page_id = p.page_id AND s.x = r.x""",
    "covers": "SELECT page_id, list(c::DOUBLE ORDER BY x) AS c, max(c) AS top FROM pixels GROUP BY page_id",
    "taps": "SELECT list(exp(-power(j, 2) / (2 * power(0.3 * (26 * 0.5 - 1) + 0.8, 2))) ORDER BY j) AS w FROM (SELECT unnest(range(-13, 14)) AS j)",
    "smoothed": """SELECT page_id, top, unnest(range(2200)) AS x, unnest(list_transform(range(2200), lambda x:
        round(list_sum(list_transform(range(27), lambda j: w[j + 1] * c[1 + CASE WHEN x + j < 13 THEN 13 - x - j WHEN x + j - 13 > 2199 THEN 4398 - (x + j - 13) ELSE x + j - 13 END])) / list_sum(w), 6))) AS s
      FROM covers, taps""",
    "lowest": "SELECT page_id, any_value(top) AS top, arg_min(x, (s, x)) AS v, min(s) AS low FROM smoothed WHERE x >= 396 AND x < 1804 GROUP BY page_id",
    "peaks": """SELECT l.page_id, l.top, v, low, least(coalesce(max(s) FILTER (WHERE x < v), 0), coalesce(max(s) FILTER (WHERE x > v), 0)) AS peak
      FROM lowest l JOIN smoothed s ON s.page_id = l.page_id GROUP BY ALL""",
    "valleys": """SELECT p.page_id, CAST(coalesce(max(x) FILTER (WHERE x < v AND s > peak * 0.45), 0) AS INTEGER) AS g0,
        CAST(coalesce(min(x) FILTER (WHERE x > v AND s > peak * 0.45), 2199) AS INTEGER) AS g1
      FROM peaks p JOIN smoothed s ON s.page_id = p.page_id WHERE p.top >= 2 AND peak >= 2 AND low <= peak * 0.45 GROUP BY p.page_id""",
    "detected": "SELECT * FROM valleys WHERE g1 - g0 >= 27 AND g0 >= 264 AND g1 <= 1936",
}


@query("box_gutter", with_desk("SELECT page_id, g0 AS gutter_start, g1 AS gutter_end FROM detected", **VALLEYS))
def box_gutter(spark, sf):
    return geometry.box_gutters(desk.boxes(spark, sf), desk.pages(spark, sf))


BANDS = """
  SELECT *, CASE WHEN b - t < 14 THEN y0 ELSE t END AS top, CASE WHEN b - t < 14 THEN y1 ELSE b END AS bottom
  FROM (
    SELECT *, CASE WHEN least(x1, px1) - greatest(x0, px0) >= 24
                   THEN greatest(y0, CAST(round_even(((py0 + py1) / 2.0::DOUBLE + (y0 + y1) / 2.0::DOUBLE) / 2, 0) AS INTEGER)) ELSE y0 END AS t,
           CASE WHEN least(x1, nx1) - greatest(x0, nx0) >= 24
                THEN least(y1, CAST(round_even(((y0 + y1) / 2.0::DOUBLE + (ny0 + ny1) / 2.0::DOUBLE) / 2, 0) AS INTEGER)) ELSE y1 END AS b
    FROM (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1,
                 lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1
          FROM close_lines WINDOW w AS (PARTITION BY page_id ORDER BY linha_documento)))"""
CLOSE = "SELECT page_id, line_id, linha_documento, x0, y0, x1, CAST(y1 + 20 + (linha_documento % 5) * 15 AS INTEGER) AS y1 FROM all_pending"


def close_lines(spark, sf):
    """Included lines made taller, so that neighbours overlap."""
    rows = review.pending_lines(desk.lines(spark, sf, marks=False), only_empty=False)
    return rows.withColumn("y1", F.col("y1") + 20 + (F.col("linha_documento") % 5) * 15).select(
        "page_id", "line_id", "linha_documento", *bx.CORNERS
    )


@query("line_bands", with_desk("SELECT page_id, line_id, top, bottom FROM bands", bands=BANDS, close_lines=CLOSE, all_pending=ALL_PENDING_CTE))
def line_bands(spark, sf):
    return geometry.line_bands(close_lines(spark, sf)).select("page_id", "line_id", "top", "bottom")


CROPS = """
SELECT * FROM (
  SELECT l.page_id, line_id,
    CASE WHEN g0 IS NOT NULL AND c1 > g0 AND c0 >= g1 THEN greatest(greatest(0, c0 - 8), g1) ELSE greatest(0, c0 - 8) END AS crop_x0,
    greatest(0, top) AS crop_y0,
    CASE WHEN g0 IS NOT NULL AND c1 <= g0 THEN least(least(p.width, c1 + 8), g0) ELSE least(p.width, c1 + 8) END AS crop_x1,
    least(p.height, bottom) AS crop_y1
  FROM limited l JOIN desk_pages p ON p.page_id = l.page_id)
WHERE crop_y1 > crop_y0 AND crop_x1 > crop_x0"""


@query("line_crops", with_desk(CROPS, bands=BANDS, close_lines=CLOSE, all_pending=ALL_PENDING_CTE,
       to_limit="SELECT * FROM bands", **GUTTERS))
def line_crops(spark, sf):
    rows = geometry.line_crops(close_lines(spark, sf), desk.pages(spark, sf), gutters(spark, sf))
    return rows.select("page_id", "line_id", "crop_x0", "crop_y0", "crop_x1", "crop_y1")


@query("line_crops_detected", with_desk(CROPS, bands=BANDS, close_lines=CLOSE, all_pending=ALL_PENDING_CTE, to_limit="SELECT * FROM bands",
       **{**GUTTERS, **VALLEYS, "gutters": """SELECT page_id, g0, g1 FROM (
         SELECT l.page_id, g0, g1, count(*) FILTER (WHERE (x0 + x1) / 2.0 < g0) AS a, count(*) FILTER (WHERE (x0 + x1) / 2.0 > g1) AS b,
                count(*) FILTER (WHERE x0 < g0 - 8 AND x1 > g1 + 8) AS c
         FROM desk_lines l JOIN detected d ON d.page_id = l.page_id GROUP BY ALL) WHERE (a >= 2 AND b >= 2) OR (c >= 2 AND a + b + c >= 4)"""}))
def line_crops_detected(spark, sf):
    """Crops with the gutters found on the pages themselves."""
    found = geometry.page_gutters(desk.boxes(spark, sf), desk.pages(spark, sf))
    rows = geometry.line_crops(close_lines(spark, sf), desk.pages(spark, sf), found)
    return rows.select("page_id", "line_id", "crop_x0", "crop_y0", "crop_x1", "crop_y1")


REDETECT = {
    "new_boxes": """SELECT page_id, k AS box_pos, x0, CAST(y0 + (k % 5) * 9 AS INTEGER) AS y0, x1, CAST(y1 + (k % 5) * 9 AS INTEGER) AS y1,
        row_number() OVER (PARTITION BY page_id ORDER BY k) AS i FROM desk_lines WHERE k % 7 <> 6""",
    # One box of every page per step; `used` are the stored lines taken so far.
    "taking": """
  SELECT page_id, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS used, CAST(NULL AS BIGINT) AS best FROM new_boxes WHERE i = 1
  UNION ALL
  SELECT page_id, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best FROM (
    SELECT t.page_id, t.i + 1 AS i, t.used, arg_max(o.k, (greatest(0, least(o.y1, b.y1) - greatest(o.y0, b.y0)) / greatest(1, least(o.y1 - o.y0, b.y1 - b.y0)), -o.k))
      FILTER (WHERE NOT list_contains(t.used, o.k) AND greatest(0, least(o.y1, b.y1) - greatest(o.y0, b.y0)) / greatest(1, least(o.y1 - o.y0, b.y1 - b.y0)) > 0.4) AS best
    FROM taking t JOIN new_boxes b ON b.page_id = t.page_id AND b.i = t.i + 1 JOIN desk_lines o ON o.page_id = t.page_id
    GROUP BY t.page_id, t.i, t.used)""",
    "taken": "SELECT b.*, t.best FROM new_boxes b JOIN taking t ON t.page_id = b.page_id AND t.i = b.i",
    "written_lines": f"SELECT line_id, count(*) AS parts, bool_or({written_sql('text')}) AS written FROM texted GROUP BY line_id",
    "redetected": """
  SELECT n.page_id, coalesce(o.line_id, 'ln_' || substr(sha256(n.page_id || '|' || n.box_pos || '|' || n.x0 || ',' || n.y0 || ',' || n.x1 || ',' || n.y1), 1, 8)) AS line_id,
         n.box_pos AS line_pos, n.x0, n.y0, n.x1, n.y1, coalesce(o.include, true) AS include, coalesce(w.parts, 1) AS parts
  FROM taken n LEFT JOIN desk_lines o ON o.page_id = n.page_id AND o.k = n.best LEFT JOIN written_lines w ON w.line_id = o.line_id
  UNION ALL
  SELECT o.page_id, o.line_id, o.k + 1000000, o.x0, o.y0, o.x1, o.y1, o.include, w.parts
  FROM desk_lines o JOIN written_lines w ON w.line_id = o.line_id
  WHERE w.written AND NOT EXISTS (SELECT 1 FROM taken n WHERE n.page_id = o.page_id AND n.best = o.k)""",
}


@query("redetect_match", with_desk("""
SELECT r.page_id, line_id, x0, y0, x1, y1, include, CAST(parts AS INTEGER) AS parts
FROM redetected r JOIN flagged f ON f.page_id = r.page_id AND f.line_pos = r.line_pos WHERE keep""", **REDETECT, **fragment_ctes("redetected")))
def redetect_match(spark, sf):
    out = again.redetect(desk.lines(spark, sf, marks=False).drop("filename"), desk.new_boxes(spark, sf))
    return out.select("page_id", "line_id", "x0", "y0", "x1", "y1", "include", F.size("parts").alias("parts"))
