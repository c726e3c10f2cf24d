"""Building blocks of the SQL twins (plain DuckDB SQL over the same Parquet tables)."""

from __future__ import annotations

from sagewell.functions import vocab
from sagewell.functions.text import BLANK


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(expr: str, keywords) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(k)})" for k in keywords) + ")"


def first_rule(expr: str, rules, default: str | None) -> str:
    arms = " ".join(f"WHEN {any_of(expr, kws)} THEN {text(name)}" for name, kws in rules)
    return f"CASE {arms} ELSE {'NULL' if default is None else text(default)} END"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, {text(BLANK + '+')}, ' ', 'g'))"


def normalized(expr: str) -> str:
    return (
        f"trim(regexp_replace(replace(strip_accents(lower({expr})), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
    )


ABSOLUTE = r"'^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)'"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, {ABSOLUTE}, 2))"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, {ABSOLUTE}, 1))"


def path(url: str) -> str:
    raw = f"regexp_replace(rtrim(regexp_extract({url}, {ABSOLUTE}, 3)), ';[^/]*$', '')"
    flat = f"regexp_replace(CASE WHEN {raw} = '' THEN '/' ELSE {raw} END, '/{{2,}}', '/', 'g')"
    return f"CASE WHEN {flat} = '/' THEN '/' ELSE regexp_replace({flat}, '/$', '') END"


def canonical(url: str) -> str:
    full = f"{scheme(url)} || '://' || {host(url)} || ({path(url)})"
    return f"CASE WHEN regexp_matches({url}, {ABSOLUTE}) THEN {full} END"


def slug(expr: str) -> str:
    inner = f"regexp_replace({expr}, '[^a-z0-9]+', '-', 'g')"
    return f"coalesce(nullif(regexp_replace({inner}, '^-+|-+$', '', 'g'), ''), 'default')"


# documents in page shape, cut into chunks (recursive), and enriched.
PIECES = f"""
doc_pages AS (
  SELECT doc_id, source AS site_id,
         'https://' || source || '.example.org/' || lang || '/doc-' || doc_id AS source_url,
         'Document ' || lang || ' ' || source AS title,
         TIMESTAMP '2026-01-01' + INTERVAL 1 DAY * CAST(doc_id % 28 AS INTEGER) AS crawled_at,
         {collapse('text')} AS body
  FROM documents),
cuts AS (
  SELECT doc_id, 0 AS n, CAST(0 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b, length(body) AS len
  FROM doc_pages WHERE length(body) > 1100
  UNION ALL
  SELECT c.doc_id, c.n + 1,
         CASE WHEN c.b < 0 THEN 0 ELSE greatest(0, c.b - 160) END AS a,
         (SELECT CASE WHEN strpos(reverse(seg), ' .') > 0
                       AND length(seg) - strpos(reverse(seg), ' .') - 1 > 550
                      THEN st + length(seg) - strpos(reverse(seg), ' .')
                      ELSE st + length(seg) END
          FROM (SELECT CASE WHEN c.b < 0 THEN 0 ELSE greatest(0, c.b - 160) END AS st,
                       substring(p.body, CAST(CASE WHEN c.b < 0 THEN 0 ELSE greatest(0, c.b - 160) END + 1 AS BIGINT), 1100) AS seg)) AS b,
         c.len
  FROM cuts c JOIN doc_pages p ON p.doc_id = c.doc_id
  WHERE c.b < c.len),
raw_pieces AS (
  SELECT p.doc_id, c.n AS n, trim(substring(p.body, CAST(c.a + 1 AS BIGINT), CAST(c.b - c.a AS BIGINT))) AS content
  FROM cuts c JOIN doc_pages p ON p.doc_id = c.doc_id WHERE c.b >= 0
  UNION ALL
  SELECT doc_id, 1, body FROM doc_pages WHERE length(body) <= 1100),
kept_pieces AS (
  SELECT r.doc_id, r.n, r.content FROM raw_pieces r JOIN doc_pages p ON p.doc_id = r.doc_id
  WHERE length(p.body) <= 1100 OR length(r.content) > 80),
pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_no, content
  FROM kept_pieces)"""

_days = " ".join(f"WHEN {text(k)} THEN {v}" for k, v in sorted(vocab.TTL_DAYS.items()))
CHUNKS = PIECES + f""",
labelled AS (
  SELECT p.doc_id, p.site_id, p.source_url, p.title, 'Part ' || (k.chunk_no + 1) AS section, p.crawled_at,
         k.chunk_no, k.content,
         lower(p.title || ' ' || 'Part ' || (k.chunk_no + 1) || ' ' || k.content) AS probe
  FROM pieces k JOIN doc_pages p ON p.doc_id = k.doc_id),
chunks AS (
  SELECT doc_id, site_id, source_url, title, section, crawled_at, chunk_no, content, category,
         sha256(source_url || chr(10) || content) AS content_hash,
         regexp_extract(source_url, '/(en|fr|de|es)/', 1) AS language,
         {first_rule("lower(title || ' ' || content)", vocab.PLACE_RULES, None)} AS location,
         crawled_at + INTERVAL 1 DAY * CASE category {_days} END AS valid_until,
         {normalized("title || ' ' || section || ' ' || category || ' ' || content || ' ' || source_url || ' ' || regexp_extract(source_url, '/(en|fr|de|es)/', 1)")} AS search_text
  FROM (SELECT *, {first_rule('probe', vocab.CATEGORY_RULES, vocab.DEFAULT_CATEGORY)} AS category FROM labelled))"""


def with_chunks(tail: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {CHUNKS}{extra} {tail}"


def with_pieces(tail: str) -> str:
    return f"WITH RECURSIVE {PIECES} {tail}"
