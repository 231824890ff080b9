"""The same derivations as common table expressions, for the engine that checks results."""
import re

SPACES = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{SPACES}+', ' ', 'g')")


def written_sql(x: str) -> str:
    return f"({strip_sql(x)} <> '')"


def fold_sql(x: str) -> str:
    return rf"lower(regexp_replace(strip_accents({x}), '\p{{M}}+', '', 'g'))"


CTES = {}
CTES["docs"] = "SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents"
CTES["dl"] = "SELECT doc_id, lang, source, len(a) AS n, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS k FROM docs"
CTES["dc"] = "SELECT *, CASE WHEN n >= 6 AND doc_id % 3 = 0 AND 2 * k >= n THEN 1 ELSE 0 END AS c FROM dl"
CTES["desk_lines"] = """
  SELECT doc_id, k, n, t, printf('p%06d', doc_id + 1) AS page_id,
         source || '-' || lang || '-' || doc_id || '.jpg' AS filename,
         'ln_' || doc_id || '_' || k AS line_id, CAST(k AS INTEGER) AS line_pos,
         CAST(CASE WHEN k % 17 = 16 THEN 980 ELSE 40 + 1100 * c + (7 * k) % 13 END AS INTEGER) AS x0,
         CAST(40 + 60 * (CASE WHEN c = 1 THEN k - n // 2 ELSE k END) AS INTEGER) AS y0,
         CAST(CASE WHEN k % 17 = 16 THEN 1020 ELSE 40 + 1100 * c + (7 * k) % 13 + 60 + least(840, length(t)) END AS INTEGER) AS x1,
         CAST(84 + 60 * (CASE WHEN c = 1 THEN k - n // 2 ELSE k END) AS INTEGER) AS y1,
         (doc_id + k) % 9 <> 4 AS include
  FROM dc"""
CTES["desk_pages"] = """
  SELECT doc_id, page_id, filename, 2200 AS width, CAST(max(y1) + 40 AS INTEGER) AS height,
         CAST(doc_id % 50 AS INTEGER) AS origin_x, CAST(doc_id % 30 AS INTEGER) AS origin_y,
         CAST(1 + doc_id % 3 AS INTEGER) AS view_scale, CAST(doc_id % 4 AS INTEGER) AS prep_version,
         doc_id % 4 > 0 AS prepared,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 2240 END AS original_width,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(max(y1) + 80 AS INTEGER) END AS original_height,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 0.4 END AS sensitivity
  FROM desk_lines GROUP BY doc_id, page_id, filename"""
CTES["raw_parts"] = """
  SELECT *, 1 AS parte, CASE WHEN length(t) > 200 AND k % 5 = 0 THEN substr(t, 1, 100) ELSE t END AS raw FROM desk_lines
  UNION ALL
  SELECT *, 2 AS parte, substr(t, 101) AS raw FROM desk_lines WHERE length(t) > 200 AND k % 5 = 0"""
CTES["texted"] = """
  SELECT p.*, 'pt_' || doc_id || '_' || k || '_' || parte AS part_id,
         CASE WHEN (doc_id + k) % 13 = 0 THEN ''
              WHEN (31 * doc_id + k) % 11 = 0 THEN '[ilegível] ' || raw ELSE raw END AS text
  FROM raw_parts p"""
CTES["desk_parts"] = f"""
  SELECT t.*, coalesce(l.quality, 0) = 1 AND (t.doc_id + k) % 13 <> 0 AS confirmed,
         NOT (coalesce(l.quality, 0) = 1 AND (t.doc_id + k) % 13 <> 0) AND {written_sql('t.text')} AND (t.doc_id + k) % 19 = 0 AS skipped
  FROM texted t LEFT JOIN labels l ON l.doc_id = t.doc_id"""
CTES["centred"] = """
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x0 + x1, line_pos) AS rk,
         lead(x0) OVER (PARTITION BY page_id ORDER BY x0 + x1, line_pos) - x1 AS gap
  FROM desk_lines"""
CTES["page_gap"] = """
  SELECT page_id, max(gap) AS g FROM centred WHERE n >= 4 AND gap >= 40 AND rk >= 2 AND n - rk >= 2 GROUP BY page_id"""
CTES["page_split"] = """
  SELECT c.page_id, min(c.rk) AS split FROM centred c JOIN page_gap g ON g.page_id = c.page_id AND c.gap = g.g
  WHERE n >= 4 AND rk >= 2 AND n - rk >= 2 GROUP BY c.page_id"""
CTES["columned"] = """
  SELECT c.* EXCLUDE (rk, gap), CASE WHEN s.split IS NOT NULL AND rk > s.split THEN 1 ELSE 0 END AS reading_column
  FROM centred c LEFT JOIN page_split s ON s.page_id = c.page_id"""
CTES["line_numbers"] = """
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY reading_column, y0, x0, line_id) AS INTEGER) AS linha_documento
  FROM columned"""
CTES["numbered"] = """
  SELECT p.page_id, p.filename, p.doc_id, p.k, p.line_id, p.line_pos, p.x0, p.y0, p.x1, p.y1, p.include, l.reading_column,
         l.linha_documento, p.parte, p.part_id, p.text, p.confirmed, p.skipped,
         CASE WHEN p.include THEN CAST(row_number() OVER (
           PARTITION BY p.page_id, p.include ORDER BY l.linha_documento, p.parte) AS INTEGER) END AS linha_transcrita
  FROM desk_parts p JOIN line_numbers l ON l.line_id = p.line_id"""
CTES["passages"] = f"""
  SELECT doc_id, page_id, filename AS page_name, line_id, part_id, linha_documento, linha_transcrita,
         {strip_sql('text')} AS text, sha256({strip_sql('text')}) AS content_hash, confirmed
  FROM numbered WHERE {written_sql('text')}"""
CTES["stored_base"] = """
  SELECT * REPLACE (CASE WHEN (doc_id + linha_documento) % 6 = 0 THEN 'stale' ELSE content_hash END AS content_hash)
  FROM passages WHERE doc_id % 10 <> 3"""
CTES["stored"] = """
  SELECT * FROM stored_base
  UNION ALL
  SELECT * REPLACE (part_id || '_old' AS part_id) FROM stored_base WHERE (doc_id + linha_documento) % 23 = 0"""
CTES["line_text"] = f"""
  SELECT page_id, line_id, any_value(linha_documento) AS d, bool_or({written_sql('text')}) AS written,
         bool_and(NOT {written_sql('text')} OR confirmed) AS settled,
         arg_min({strip_sql('text')}, parte) FILTER (WHERE {written_sql('text')}) AS first_text
  FROM numbered GROUP BY page_id, line_id"""
CTES["page_stats"] = """
  SELECT page_id, count(*) AS lines, count(*) FILTER (WHERE written) AS written,
         count(*) FILTER (WHERE written AND settled) AS confirmed,
         coalesce(array_to_string((list(first_text ORDER BY d) FILTER (WHERE written))[1:2], ' '), '') AS preview
  FROM line_text GROUP BY page_id"""
CTES["edit_log"] = """
  SELECT event_id, ts, 'pt_' || (event_id % 2000) AS part_id,
         CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'skip' WHEN 'purchase' THEN 'confirm'
                         WHEN 'error' THEN 'delete' ELSE 'omit' END AS op,
         CASE WHEN event_type = 'click' THEN 'edit ' || event_id END AS text
  FROM events"""
CTES["index_vectors"] = """
  SELECT vec_id, 'pv_' || vec_id AS part_id, 'g_' || (vec_id % 7) AS group_id,
         CASE WHEN label % 4 = 0 THEN NULL ELSE label % 3 + 1 END AS user_id,
         vec_id % 2 = 0 AS confirmed, embedding::DOUBLE[] AS embedding
  FROM embeddings"""
CTES["progress_events"] = """
  SELECT event_id AS seq, ts, 'folha_' || user_id || '.jpg' AS filename,
         CASE event_type WHEN 'click' THEN 'tile' WHEN 'view' THEN 'original' WHEN 'purchase' THEN 'finished'
                         WHEN 'error' THEN 'error' ELSE 'crop' END AS stage,
         event_id % 100 AS done, CAST(100 AS BIGINT) AS total
  FROM events"""


def with_desk(select: str, **extra: str) -> str:
    """A query over the derived tables, with the expressions it reaches, each after those it reads."""
    named = {**CTES, **extra}
    done: dict[str, str] = {}

    def visit(text: str, inside: str | None = None) -> None:
        for name, body in named.items():
            if name not in done and name != inside and re.search(rf"\b{name}\b", text):
                visit(body, name)
                done.setdefault(name, body)

    visit(select)
    if not done:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in done.items()) + "\n" + select
