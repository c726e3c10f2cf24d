"""Registered queries over the crawled ``pages``: URLs, links, Markdown and HTML to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagewell.functions import urls as u
from sagewell.functions import vocab
from sagewell.functions.text import first_rule
from sagewell.operators import chunks as ch
from sagewell.operators import pages as ops
from sagewell.operators.rank import first_per
from sagewell.plans import twins as t
from sagewell.plans.registry import query
from sagewell.session import scratch_folder
from sagewell.sources import crawl
from sagewell.sources.tables import spread, table

POLICY = dict(
    allowed_domains=["example.com", "example.org"], include_subdomains=True, exclude_patterns=["spam-farm"]
)
SEED = "https://seed.example.org/"
CRAWL_TIME = "TIMESTAMP_NTZ'2026-01-01 00:00:00'"


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"))


# --- URL twins -------------------------------------------------------------------------------

PAGE_URLS = f"""
page_urls AS (
  SELECT page_id, url, html, {t.canonical('url')} AS source, {t.host('url')} AS host, {t.scheme('url')} AS scheme
  FROM pages)"""
_origin = "scheme || '://' || host"
_folder = "coalesce(nullif(regexp_replace(regexp_extract(url, " + t.ABSOLUTE + ", 3), '[^/]*$', ''), ''), '/')"
# Segments as one-element lists, so that a reduction can build the list of those that stay.
_segments = "string_split(regexp_replace(regexp_replace(target, '(/[.][.]?)$', '\\1/'), '^/', ''), '/')"
_dotless = (
    "CASE WHEN regexp_matches(target, '/[.][.]?(/|$)') THEN '/' || array_to_string(list_reduce(list_concat([['']],"
    f" list_transform({_segments}, lambda s: [s])), lambda a, s: CASE WHEN s[1] = '..' THEN"
    " a[1:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END)[2:], '/') ELSE target END"
)
_decoded = "regexp_replace(v, '^[\"'']|[\"'']$', '', 'g')"
for _entity, _char in ops.ENTITIES:
    _decoded = f"replace({_decoded}, {t.text(_entity)}, {t.text(_char)})"
LINKS = (
    PAGE_URLS
    + rf""",
hrefs AS (
  SELECT page_id, source, scheme, host, url, unnest(h) AS href, generate_subscripts(h, 1) AS pos
  FROM (SELECT *, list_transform(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1),
      lambda v: {_decoded}) AS h FROM page_urls)),
parts AS (
  SELECT *, regexp_extract(href, '^[^?#]*') AS local,
    CASE WHEN local = '' THEN regexp_extract(url, {t.ABSOLUTE}, 3)
         WHEN starts_with(local, '/') THEN local ELSE {_folder} || local END AS target FROM hrefs),
resolved AS (
  SELECT page_id, source, pos,
    CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href
         WHEN starts_with(href, '//') THEN scheme || ':' || href
         ELSE {_origin} || {_dotless} || substr(href, length(local) + 1) END AS link
  FROM parts),
link_rows AS (
  SELECT page_id, 0 AS pos, source AS url, CAST(NULL AS VARCHAR) AS discovered_from FROM page_urls WHERE source IS NOT NULL
  UNION ALL
  SELECT page_id, pos, {t.canonical('link')} AS url, source FROM resolved WHERE {t.canonical('link')} IS NOT NULL),
first_links AS (
  SELECT url, discovered_from, page_id, pos FROM
   (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM link_rows) WHERE rn = 1)"""
)


def _allowed(host: str, domains) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR ends_with({host}, '.{d}')" for d in domains) + ")"


def reason_sql(url: str, domains, excludes=(), languages: bool = False) -> str:
    path = f"lower(regexp_extract({url}, {t.ABSOLUTE}, 3))"
    arms = [
        f"WHEN NOT {_allowed(t.host(url), domains)} THEN 'external_domain'",
        f"WHEN regexp_matches({path}, {t.text(ops.ASSET_PATTERN)}) THEN 'static_asset'",
        f"WHEN {t.any_of(path, vocab.AUTH_SEGMENTS)} THEN 'auth_page'",
        f"WHEN {t.any_of(path, vocab.TRANSACTION_SEGMENTS)} THEN 'auth_or_transaction_page'",
    ]
    arms += [f"WHEN regexp_matches({url}, {t.text('(?i)' + p)}) THEN 'excluded_by_policy'" for p in excludes]
    if languages:
        arms.append(
            f"WHEN regexp_matches({path}, '/(ko|zh|ru)(/|$)') OR NOT regexp_matches({path}, '/(en|fr|de|es)(/|$)') "
            "THEN 'unsupported_language'"
        )
    return "CASE " + " ".join(arms) + " END"


def category_sql(url: str) -> str:
    return t.first_rule(f"lower({url})", vocab.URL_CATEGORY_RULES, "page")


_rank = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(vocab.URL_CATEGORY_RANK.items()))


@query("s5_page_scan", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars FROM pages")
def s5(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", "url", F.length("html").cast("long").alias("html_chars")
    )


@query(
    "p3_canonical_pages",
    f"""WITH {PAGE_URLS} SELECT min(page_id) AS page_id, source AS canonical_url FROM page_urls
        WHERE source IS NOT NULL GROUP BY source""",
)
def p3(spark, folder):
    return ops.canonical_pages(table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "canonical_url"
    )


@query(
    "p4_site_keys",
    f"WITH {PAGE_URLS} SELECT page_id, {t.slug('host')} AS site_id, {_origin} AS root_url FROM page_urls",
)
def p4(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", u.site_key(url).alias("site_id"), u.root_url(url).alias("root_url")
    )


@query(
    "p5_admission_counts",
    f"""WITH {LINKS} SELECT coalesce({reason_sql('url', POLICY['allowed_domains'], POLICY['exclude_patterns'])}, 'admitted') AS reason,
        count(*) AS urls FROM first_links GROUP BY 1""",
)
def p5(spark, folder):
    found = ops.page_links(raw_pages(spark, folder))
    return (
        ops.admit_urls(found, **POLICY)
        .groupBy(F.coalesce("skip_reason", F.lit("admitted")).alias("reason"))
        .agg(F.count("*").alias("urls"))
    )


@query(
    "p5_admission_without_domains",
    f"""WITH {PAGE_URLS} SELECT page_id, source AS url, {reason_sql('source', ['example.com', 'example.net'], languages=True)} AS skip_reason
        FROM page_urls WHERE source IS NOT NULL""",
)
def p5_default(spark, folder):
    urls = table(spark, folder, "pages").select("page_id", u.canonical_url(F.col("url")).alias("url"))
    reason = ops.skip_reason(F.col("url"), default_domains=["example.com", "example.net"])
    return urls.filter(F.col("url").isNotNull()).withColumn("skip_reason", reason)


@query(
    "p6_url_category",
    f"WITH {LINKS} SELECT url, {category_sql('url')} AS category FROM first_links",
)
def p6(spark, folder):
    return ops.page_links(raw_pages(spark, folder)).select("url", ops.url_category(F.col("url")).alias("category"))


_include = [".*/en/.*", ".*/fr/.*"]
_exclude = ops.SCOPE_EXCLUDES + [".*spam-farm.*"]


@query(
    "p7_crawl_scope",
    f"""SELECT page_id, url FROM pages WHERE regexp_matches(url, {t.text('^(?:' + '|'.join(_include) + ')')})
        AND NOT regexp_matches(url, {t.text('^(?:' + '|'.join(_exclude) + ')')})""",
)
def p7(spark, folder):
    return table(spark, folder, "pages").select("page_id", "url").filter(
        ops.in_scope(F.col("url"), _include, _exclude)
    )


@query(
    "p8_page_links",
    f"WITH {LINKS} SELECT url, discovered_from, page_id, CAST(pos AS BIGINT) AS pos FROM first_links",
)
def p8(spark, folder):
    return ops.page_links(raw_pages(spark, folder)).withColumn("pos", F.col("pos").cast("long"))


CANDIDATES = (
    LINKS
    + f""",
extra AS (SELECT DISTINCT {t.canonical(_origin + " || '/'")} AS url FROM page_urls WHERE source IS NOT NULL),
candidates AS (
  SELECT coalesce(f.url, e.url) AS url,
         CASE WHEN e.url IS NOT NULL THEN '{SEED}' ELSE f.discovered_from END AS discovered_from,
         f.page_id, e.url IS NOT NULL AS is_listed
  FROM first_links f FULL JOIN extra e ON e.url = f.url)"""
)


def candidates(spark, folder):
    pages = raw_pages(spark, folder)
    listed = pages.select(F.concat(u.root_url(F.col("url")), F.lit("/")).alias("url")).distinct()
    return ops.merge_candidates(ops.page_links(pages), listed, SEED)


@query("p9_candidate_merge", f"WITH {CANDIDATES} SELECT url, discovered_from, page_id, is_listed FROM candidates")
def p9(spark, folder):
    return candidates(spark, folder)


SELECTION = (
    CANDIDATES
    + f""",
reasons AS (SELECT *, {reason_sql('url', POLICY['allowed_domains'], POLICY['exclude_patterns'])} AS skip_reason FROM candidates),
selection AS (
  SELECT url, discovered_from, skip_reason,
         CASE WHEN skip_reason IS NULL THEN {category_sql('url')} END AS category FROM reasons),
ranked AS (SELECT *, CASE WHEN skip_reason IS NULL THEN CASE category {_rank} ELSE 99 END END AS sort_rank FROM selection)"""
)


@query(
    "g1_selection",
    f"""WITH {SELECTION} SELECT url, discovered_from, skip_reason, category, CAST(sort_rank AS BIGINT) AS sort_rank FROM ranked""",
)
def g1(spark, folder):
    chosen = ops.select_urls(candidates(spark, folder), **POLICY)
    return chosen.select("url", "discovered_from", "skip_reason", "category", F.col("sort_rank").cast("long"))


@query(
    "o1_url_order",
    f"""WITH {SELECTION} SELECT url, category, CAST(sort_rank AS BIGINT) AS sort_rank FROM ranked
        WHERE skip_reason IS NULL ORDER BY sort_rank, url""",
)
def o1(spark, folder):
    chosen = ops.select_urls(candidates(spark, folder), **POLICY).filter("skip_reason IS NULL")
    return chosen.select("url", "category", F.col("sort_rank").cast("long")).orderBy("sort_rank", "url")


@query(
    "o7_keep_first",
    f"""WITH {LINKS} SELECT source_url, url FROM (
          SELECT l.url, p.source AS source_url, row_number() OVER (PARTITION BY l.page_id, lower(l.url) ORDER BY l.pos) AS rn
          FROM link_rows l JOIN page_urls p ON p.page_id = l.page_id) WHERE rn = 1""",
)
def o7(spark, folder):
    """Case-insensitive key de-duplication inside each page, keeping the first link."""
    rows = ops.link_rows(raw_pages(spark, folder))
    kept = rows.groupBy("page_id", F.lower("url").alias("key")).agg(
        F.min_by(F.struct("source", "url"), "pos").alias("first")
    )
    return kept.select(F.col("first.source").alias("source_url"), "first.url")


@query(
    "j5_unvisited",
    f"""WITH {SELECTION} SELECT url FROM ranked WHERE skip_reason IS NULL
        AND url NOT IN (SELECT source FROM page_urls WHERE source IS NOT NULL)""",
)
def j5(spark, folder):
    chosen = ops.select_urls(candidates(spark, folder), **POLICY).filter("skip_reason IS NULL").select("url")
    visited = table(spark, folder, "pages").select(u.canonical_url(F.col("url")).alias("url"))
    return chosen.join(visited, "url", "left_anti")


# --- Markdown --------------------------------------------------------------------------------

TO_MARKDOWN = [
    (r"(?is)<title[^>]*>.*?</title>", ""),
    (r"(?i)<h1[^>]*>", "\n# "),
    (r"(?i)<li><a\s[^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</a></li>", "\n- [$2]($1)"),
    (r"(?i)<div[^>]*>", "\n![ad](https://img.example.org/ad.png) "),
    (r"(?i)<footer[^>]*>", "\n## Related posts\n"),
    (r"(?i)<p[^>]*>", "\n"),
    (r"(?s)<[^>]*>", ""),
]


def markdown_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as Markdown, the form a crawl service delivers."""
    text = ops.without_hidden(F.col("html"))
    for pattern, replacement in TO_MARKDOWN:
        text = F.regexp_replace(text, pattern, replacement)
    for entity, char in ops.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return raw_pages(spark, folder).select(
        "page_id", "url", ops.html_title(F.col("html")).alias("title"), text.alias("markdown")
    )


def _replace(expr: str, pattern: str, replacement: str) -> str:
    back = replacement.replace("$", "\\")
    return f"regexp_replace({expr}, {t.text(pattern)}, {t.text(back)}, 'g')"


def hidden_sql(expr: str) -> str:
    for tag in ("script", "style", "noscript", "svg"):
        expr = _replace(expr, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    return _replace(expr, r"(?s)<!--.*?-->", "")


def entities_sql(expr: str) -> str:
    for entity, char in ops.ENTITIES:
        expr = f"replace({expr}, {t.text(entity)}, {t.text(char)})"
    return expr


def visible_sql(expr: str) -> str:
    return t.collapse(entities_sql(_replace(expr, r"(?s)<[^>]*>", " ")))


def _markdown_sql() -> str:
    expr = hidden_sql("html")
    for pattern, replacement in TO_MARKDOWN:
        expr = _replace(expr, pattern, replacement)
    return entities_sql(expr)


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, {t.text(f'^{t.BLANK}+|{t.BLANK}+$')}, '', 'g')"


def _line_sql(expr: str) -> str:
    for pattern, replacement in ops.LINE_REWRITES:
        expr = _replace(expr, pattern, replacement)
    return strip_sql(expr)


TITLE_SQL = (
    "coalesce(nullif(" + visible_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", ''), 'Untitled page')"
)
_noise_list = ", ".join(t.text(x) for x in vocab.NOISE_LINES)
_bare = strip_sql("regexp_replace(lower(line), '^[#\\- ]+', '')")
_footer = " OR ".join(f"starts_with({_bare}, {t.text(p)})" for p in vocab.FOOTER_PREFIXES)
_contents = ops.CONTENTS_ENTRY.replace("(?iU)", "(?i)").replace(r"[-\w%]", r"[-\pL\pN_%]")
_label = strip_sql("regexp_replace(line, '^[# ]+|[# ]+$', '', 'g')")


def _good(label: str) -> str:
    return f"(length({label}) >= 8 AND NOT {t.any_of(f'lower({label})', vocab.BAD_LABEL_FRAGMENTS)})"


_widgets = ", ".join(t.text(x) for x in vocab.WIDGET_HEADINGS)
LINES = f"""
md AS (SELECT page_id, url, {TITLE_SQL} AS title, {_markdown_sql()} AS markdown FROM pages),
split_lines AS (
  SELECT page_id, unnest(a) AS raw, generate_subscripts(a, 1) AS pos
  FROM (SELECT page_id, string_split_regex(markdown, {t.text(ops.LINE_BREAK)}) AS a FROM md)),
clean_lines AS (SELECT page_id, pos, line FROM (SELECT page_id, pos, {_line_sql(strip_sql('raw'))} AS line FROM split_lines) WHERE line <> ''),
footers AS (SELECT page_id, min(pos) AS stop FROM clean_lines WHERE {_footer} GROUP BY page_id),
head_lines AS (
  SELECT c.* FROM clean_lines c LEFT JOIN footers f ON f.page_id = c.page_id WHERE f.stop IS NULL OR c.pos < f.stop),
content_lines AS (
  SELECT * FROM head_lines WHERE NOT (starts_with(line, '![') OR lower(line) IN ({_noise_list})
    OR {t.any_of('lower(line)', vocab.NOISE_FRAGMENTS)}
    OR regexp_matches(line, {t.text(ops.LANGUAGE_SWITCH)}) OR regexp_matches(line, {t.text(_contents)}))),
starts AS (
  SELECT page_id, min(pos) AS first FROM content_lines
  WHERE regexp_matches(line, '^#\\s+.+') AND {_good(_label)} AND lower({_label}) NOT IN ({_widgets}) GROUP BY page_id),
main_lines AS (
  SELECT c.* FROM content_lines c LEFT JOIN starts s ON s.page_id = c.page_id WHERE s.first IS NULL OR c.pos >= s.first),
md_text AS (
  SELECT m.page_id, m.title, m.url, coalesce(x.body, '') AS body FROM md m LEFT JOIN
   (SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM main_lines GROUP BY page_id) x ON x.page_id = m.page_id)"""


@query(
    "p10_clean_lines",
    f"""WITH {LINES} SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS lines, count(line) AS n_lines
        FROM (SELECT m.page_id, c.pos, c.line FROM md m LEFT JOIN content_lines c ON c.page_id = m.page_id) GROUP BY page_id""",
)
def p10(spark, folder):
    lines = ops.drop_noise(ops.before_footer(ops.cleaned_lines(F.col("markdown"))))
    return markdown_pages(spark, folder).select("page_id", lines.alias("l")).select(
        "page_id", F.array_join("l", "\n").alias("lines"), F.size("l").cast("long").alias("n_lines")
    )


@query(
    "p11_before_footer",
    f"""WITH {LINES} SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS lines
        FROM (SELECT m.page_id, c.pos, c.line FROM md m LEFT JOIN head_lines c ON c.page_id = m.page_id) GROUP BY page_id""",
)
def p11(spark, folder):
    lines = ops.before_footer(ops.cleaned_lines(F.col("markdown")))
    return markdown_pages(spark, folder).select("page_id", F.array_join(lines, "\n").alias("lines"))


@query(
    "w11_running_frames",
    f"""WITH {LINES} SELECT m.page_id, count(h.line) AS lines_kept FROM md m LEFT JOIN head_lines h ON h.page_id = m.page_id GROUP BY m.page_id""",
)
def w11(spark, folder):
    """The footer cut as a running frame over exploded lines, next to the in-row form of p11."""
    lines = markdown_pages(spark, folder).select(
        "page_id", F.posexplode_outer(ops.cleaned_lines(F.col("markdown"))).alias("pos", "line")
    )
    frame = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    passed = F.max(F.coalesce(ops.is_footer(F.col("line")), F.lit(False))).over(frame)
    return lines.withColumn("passed", passed).groupBy("page_id").agg(
        F.count_if(~F.col("passed") & F.col("line").isNotNull()).alias("lines_kept")
    )


@query("p12_primary_content", f"WITH {LINES} SELECT page_id, body FROM md_text")
def p12(spark, folder):
    return markdown_pages(spark, folder).select("page_id", ops.markdown_text(F.col("markdown")).alias("body"))


def _rfind_sql(seg: str, needle_sql: str, reversed_sql: str, width: int) -> str:
    back = f"strpos(reverse({seg}), {reversed_sql})"
    return f"CASE WHEN {back} > 0 THEN length({seg}) - {back} - {width - 1} ELSE -1 END"


def _near(needle: str, reach: int, width: int) -> str:
    pos = f"strpos(substring(body, CAST(base + 1 AS BIGINT), {reach + width}), {needle})"
    return f"CASE WHEN {pos} > 0 THEN base + {pos} - 1 + {width} END"


MD_PIECES = (
    LINES
    + f""",
md_cuts AS (
  SELECT page_id, 0 AS n, CAST(0 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS nxt FROM md_text WHERE length(body) > 1200
  UNION ALL
  SELECT page_id, n + 1, st, stop,
         CASE WHEN base <= 0 THEN 0 ELSE coalesce({_near('chr(10)', 120, 1)}, {_near("'. '", 160, 2)}, {_near("' '", 60, 1)}, base) END
  FROM (SELECT *, greatest(0, stop - 160) AS base FROM
   (SELECT *, CASE WHEN cut > 400 THEN st + cut ELSE st + length(seg) END AS stop FROM
    (SELECT *, CASE WHEN heading > 400 THEN heading ELSE {_rfind_sql('seg', '', 'chr(10)', 1)} END AS cut FROM
     (SELECT *, {_rfind_sql('seg', '', "'#' || chr(10)", 2)} AS heading FROM
      (SELECT c.page_id, c.n, c.nxt AS st, m.body, substring(m.body, CAST(c.nxt + 1 AS BIGINT), 1200) AS seg
       FROM md_cuts c JOIN md_text m ON m.page_id = c.page_id WHERE c.b < length(m.body))))))),
md_raw AS (
  SELECT c.page_id, c.n, {strip_sql("substring(m.body, CAST(c.a + 1 AS BIGINT), CAST(c.b - c.a AS BIGINT))")} AS content
  FROM md_cuts c JOIN md_text m ON m.page_id = c.page_id WHERE c.b >= 0
  UNION ALL SELECT page_id, 1, body FROM md_text WHERE length(body) BETWEEN 1 AND 1200),
md_pieces AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS chunk_no, content
  FROM md_raw WHERE content <> '')"""
)


def markdown_pieces(spark, folder):
    pages = markdown_pages(spark, folder).withColumn("body", ops.markdown_text(F.col("markdown"))).drop("markdown")
    return ch.chunk(pages, "body", style="markdown")


@query(
    "p18_chunk_markdown",
    f"WITH RECURSIVE {MD_PIECES} SELECT page_id, CAST(chunk_no AS BIGINT) AS chunk_no, content FROM md_pieces",
)
def p18(spark, folder):
    return markdown_pieces(spark, folder).select("page_id", F.col("chunk_no").cast("long"), "content")


MD_LABELS = f"""{MD_PIECES},
    piece_lines AS (SELECT page_id, chunk_no, unnest(a) AS raw, generate_subscripts(a, 1) AS pos
      FROM (SELECT page_id, chunk_no, string_split_regex(content, {t.text(ops.LINE_BREAK)}) AS a FROM md_pieces)),
    labels2 AS (SELECT page_id, chunk_no, min_by({_label.replace('line', 'raw')}, pos) AS label FROM piece_lines
      WHERE starts_with(raw, '#') AND {_good(_label.replace('line', 'raw'))} GROUP BY page_id, chunk_no)"""


@query(
    "p13_section_label",
    f"""WITH RECURSIVE {MD_LABELS}
    SELECT p.page_id, CAST(p.chunk_no AS BIGINT) AS chunk_no, coalesce(l.label, m.title) AS section
    FROM md_pieces p JOIN md_text m ON m.page_id = p.page_id
    LEFT JOIN labels2 l ON l.page_id = p.page_id AND l.chunk_no = p.chunk_no""",
)
def p13(spark, folder):
    label = ops.section_label(F.col("content"), F.col("title"))
    return markdown_pieces(spark, folder).select("page_id", F.col("chunk_no").cast("long"), label.alias("section"))


# --- HTML ------------------------------------------------------------------------------------

_marked = _replace(
    _replace(hidden_sql("html"), rf"(?i)<({ops.BLOCK_TAGS})(\s[^>]*)?>", "\x01$1\x02"),
    rf"(?i)</?({ops.BLOCK_TAGS}|{ops.CONTAINER_TAGS})(\s[^>]*)?>",
    "\x01\x02",
)
_tags = ", ".join(t.text(x) for x in ops.BLOCK_TAGS.split("|"))
_meta = "regexp_extract(html, '(?is)<meta\\s(?:[^>]*\\s)?name\\s*=\\s*[\"'']description[\"''][^>]*>', 0)"
_content = f"regexp_extract({_meta}, '(?is)\\scontent\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', 1)"
_DESCRIPTION = f"substr({_content}, 2, greatest(length({_content}) - 2, 0))"
_related = t.any_of("lower(text[1:180])", vocab.RELATED_HEADINGS)
BLOCKS = f"""
block_parts AS (
  SELECT page_id, unnest(a) AS part, generate_subscripts(a, 1) AS pos
  FROM (SELECT page_id, string_split({_marked}, chr(1)) AS a FROM pages)),
blocks AS (
  SELECT * FROM (SELECT page_id, pos, lower(split_part(part, chr(2), 1)) AS tag, {visible_sql("split_part(part, chr(2), 2)")} AS text FROM block_parts)
  WHERE tag IN ({_tags}) AND length(text) >= 12),
page_heads AS (SELECT page_id, {TITLE_SQL} AS title,
   {visible_sql(_DESCRIPTION)} AS description FROM pages),
carried AS (
  SELECT page_id, pos, tag, text, last_value(head IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head
  FROM (SELECT *, CASE WHEN tag IN ('h1', 'h2', 'h3') THEN CASE WHEN {_related} THEN '<skip>' ELSE text[1:180] END END AS head FROM blocks)),
sectioned AS (
  SELECT c.page_id, c.pos, coalesce(c.head, p.title[1:140]) AS section, c.text
  FROM carried c JOIN page_heads p ON p.page_id = c.page_id WHERE c.head IS NULL OR c.head <> '<skip>'
  UNION ALL SELECT page_id, -1, 'Meta description', description FROM page_heads WHERE description <> '')"""


@query("p14_html_blocks", f"WITH {BLOCKS} SELECT page_id, tag, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS block_no FROM blocks")
def p14(spark, folder):
    rows = raw_pages(spark, folder).select(
        "page_id", F.posexplode(ops.html_blocks(F.col("html"))).alias("pos", "block")
    )
    return rows.select("page_id", "block.tag", "block.text", (F.col("pos") + 1).cast("long").alias("block_no"))


@query(
    "p15_heading_carry",
    f"WITH {BLOCKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS block_no, section, text FROM sectioned WHERE pos >= 0",
)
def p15(spark, folder):
    parts = ops.sectioned_blocks(ops.html_blocks(F.col("html")), ops.html_title(F.col("html")))
    rows = raw_pages(spark, folder).select("page_id", F.posexplode(parts).alias("pos", "part"))
    return rows.select("page_id", (F.col("pos") + 1).cast("long").alias("block_no"), "part.section", "part.text")


@query(
    "p16_page_sections",
    f"WITH {BLOCKS} SELECT page_id, section, string_agg(text, ' ' ORDER BY pos) AS text FROM sectioned GROUP BY page_id, section",
)
def p16(spark, folder):
    return ops.page_sections(raw_pages(spark, folder)).select("page_id", "section", "text")


def page_chunks(pages: DataFrame) -> DataFrame:
    """Raw HTML pages to enriched chunks; map-only, used in batch and on streams."""
    sections = ops.page_sections(pages.withColumn("site_id", u.site_key(F.col("url"))))
    pieces = ch.chunk(sections.withColumnRenamed("url", "source_url"), "text")
    stamped = pieces.withColumn("crawled_at", F.expr(CRAWL_TIME)).withColumn("section", F.substring("section", 1, 200))
    return ch.enrich_chunks(
        stamped, vocab.CATEGORY_RULES, vocab.TTL_DAYS, vocab.PLACE_RULES, default_category=vocab.DEFAULT_CATEGORY
    )


def markdown_chunks(pages: DataFrame) -> DataFrame:
    """Markdown pages (``page_id, url, title, markdown``) to enriched chunks; map-only, for batch and streams."""
    ready = pages.withColumn("site_id", u.site_key(F.col("url"))).withColumn("body", ops.markdown_text(F.col("markdown")))
    pieces = ch.chunk(ready.drop("markdown").withColumnRenamed("url", "source_url"), "body", style="markdown")
    stamped = pieces.withColumn("section", ops.section_label(F.col("content"), F.col("title"))).withColumn(
        "crawled_at", F.expr(CRAWL_TIME))
    return ch.enrich_chunks(
        stamped, vocab.CATEGORY_RULES, vocab.TTL_DAYS, vocab.PLACE_RULES, default_category=vocab.DEFAULT_CATEGORY
    )


_md_probe = "lower(m.title || ' ' || coalesce(l.label, m.title) || ' ' || p.content)"


@query(
    "s7_markdown_chunks",
    f"""WITH RECURSIVE {MD_LABELS}, {PAGE_URLS},
    made AS (SELECT {t.slug('u.host')} AS site_id, sha256(u.source || chr(10) || p.content) AS content_hash, p.page_id, p.chunk_no,
        {t.first_rule(_md_probe, vocab.CATEGORY_RULES, vocab.DEFAULT_CATEGORY)} AS category
      FROM md_pieces p JOIN md_text m ON m.page_id = p.page_id JOIN page_urls u ON u.page_id = p.page_id
      LEFT JOIN labels2 l ON l.page_id = p.page_id AND l.chunk_no = p.chunk_no),
    placed AS (SELECT *, row_number() OVER (PARTITION BY site_id, content_hash ORDER BY page_id, chunk_no) AS rn FROM made)
    SELECT site_id, content_hash, page_id, CAST(chunk_no AS BIGINT) AS chunk_no, category FROM placed WHERE rn = 1""",
)
def s7_markdown(spark, folder):
    """Markdown pages cleaned, cut, labelled and enriched, then inserted if absent into an empty table."""
    made = markdown_chunks(markdown_pages(spark, folder))
    kept = first_per(made, ["site_id", "content_hash"], [F.asc("page_id"), F.asc("chunk_no")])
    return kept.select("site_id", "content_hash", "page_id", F.col("chunk_no").cast("long"), "category")


@query(
    "p23_language_rollup",
    f"""WITH {LINKS} SELECT CASE WHEN contains(lower(url), '/en/') THEN 'en' WHEN contains(lower(url), '/fr/') THEN 'fr'
        WHEN contains(lower(url), '/de/') THEN 'de' WHEN contains(lower(url), '/es/') THEN 'es' ELSE 'en' END AS language,
        count(*) AS urls FROM first_links GROUP BY 1""",
)
def p23(spark, folder):
    found = ops.page_links(raw_pages(spark, folder))
    return found.groupBy(ch.url_language(F.col("url")).alias("language")).agg(F.count("*").alias("urls"))


@query(
    "p26_site_default",
    f"""WITH {PAGE_URLS} SELECT page_id, CASE WHEN contains(host, 'blog.') THEN 'blogs' ELSE {t.slug('host')} END AS site_id FROM page_urls""",
)
def p26(spark, folder):
    """A missing site id is derived from the URL; here only blog pages carry one."""
    given = F.when(u.host(F.col("url")).contains("blog."), "blogs")
    return table(spark, folder, "pages").select(
        "page_id", F.coalesce(given, u.site_key(F.col("url"))).alias("site_id")
    )


def url_overrides(spark, folder):
    """Discovery facts per selected URL, as string maps."""
    chosen = ops.select_urls(candidates(spark, folder), **POLICY).filter("skip_reason IS NULL")
    return chosen.select(
        "url",
        F.create_map(
            F.lit("discovery_source"), F.lit("crawl_links"), F.lit("url_category"), F.col("category"),
            F.lit("discovered_from"), F.col("discovered_from"),
        ).alias("extra"),
    )


PAGE_META = f"""{SELECTION},
extra_meta AS (SELECT url, category, discovered_from FROM ranked WHERE skip_reason IS NULL),
page_meta AS (
  SELECT p.page_id, p.url AS source_url, p.source, coalesce(e1.url, e2.url) AS matched,
         coalesce(e1.category, e2.category) AS category,
         CASE WHEN e1.url IS NOT NULL THEN e1.discovered_from ELSE e2.discovered_from END AS discovered_from
  FROM page_urls p LEFT JOIN extra_meta e1 ON e1.url = p.url LEFT JOIN extra_meta e2 ON e2.url = p.source)"""


@query("j4_url_metadata", f"WITH {PAGE_META} SELECT page_id, matched, category, discovered_from FROM page_meta")
def j4(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = crawl.url_metadata(pages, url_overrides(spark, folder), "page_id", [F.col("url")])
    return found.select(
        "page_id",
        F.col("matched_url").alias("matched"),
        F.col("extra")["url_category"].alias("category"),
        F.col("extra")["discovered_from"].alias("discovered_from"),
    )


@query(
    "p24_metadata",
    f"""WITH {PAGE_META} SELECT page_id, array_to_string(list_sort(list_filter([
          'canonical_url=' || source, 'source_type=web_page', 'seed_url={SEED}',
          'discovery_source=' || CASE WHEN matched IS NOT NULL THEN 'crawl_links' END,
          'url_category=' || category,
          'discovered_from=' || coalesce(discovered_from, CASE WHEN matched IS NULL THEN '{SEED}' END)], lambda x: x IS NOT NULL)), '|') AS metadata
        FROM page_meta""",
)
def p24(spark, folder):
    """Base keys, per-URL overrides on top, null values dropped."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    found = crawl.url_metadata(pages, url_overrides(spark, folder), "page_id", [F.col("url")])
    base = F.create_map(
        F.lit("canonical_url"), u.canonical_url(F.col("url")), F.lit("source_type"), F.lit("web_page"),
        F.lit("seed_url"), F.lit(SEED), F.lit("discovered_from"), F.lit(SEED), F.lit("status"), F.lit(None),
    )
    merged = ch.assemble_metadata(base, F.coalesce("extra", F.create_map().cast("map<string,string>")))
    entries = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.select("page_id", F.array_join(entries, "|").alias("metadata"))


# --- crawl envelopes -------------------------------------------------------------------------


def envelopes(spark, folder):
    """The pages as the JSON a crawl service returns: one document per page."""
    return markdown_pages(spark, folder).select(
        "page_id",
        F.to_json(
            F.struct(
                F.lit("completed").alias("status"),
                F.array(
                    F.struct(
                        "markdown",
                        F.struct("title", F.col("url").alias("sourceURL"), F.lit(200).alias("statusCode")).alias("metadata"),
                    )
                ).alias("data"),
            )
        ).alias("value"),
    )


_envelope = f"WITH {LINES} SELECT title, url AS source_url, CAST(200 AS BIGINT) AS status_code, CAST(length(markdown) AS BIGINT) AS chars FROM md"


def delivered(spark, documents, *by):
    """JSON documents as a crawl service leaves them: text files, one document per line."""
    path = scratch_folder(spark, "crawl")
    documents.write.partitionBy(*by).text(path)
    return path


def _page_facts(pages):
    return pages.select(
        "title", "source_url", F.col("status_code").cast("long"), F.length("markdown").cast("long").alias("chars")
    )


@query("s1_crawl_result", _envelope)
def s1(spark, folder):
    """Crawl results written as JSON files and read with the declared schema."""
    path = delivered(spark, envelopes(spark, folder).select("value"))
    return _page_facts(crawl.read_crawl_results(spark, path, lines=True))


@query("s2_single_page", _envelope)
def s2(spark, folder):
    """Single-page results, half of them wrapped in ``data`` and half bare."""
    bare = F.get_json_object("value", "$.data[0]")
    wrapped = F.concat(F.lit('{"success":true,"data":'), bare, F.lit("}"))
    single = envelopes(spark, folder).select(F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(bare).alias("value"))
    return _page_facts(crawl.read_single_pages(spark, delivered(spark, single), lines=True))


@query(
    "s3_site_map",
    f"WITH {LINKS} SELECT page_id, url FROM link_rows",
)
def s3(spark, folder):
    """Site-map lists whose items are objects or bare strings."""
    rows = ops.link_rows(raw_pages(spark, folder))
    item = F.when(F.col("pos") % 2 == 0, F.to_json(F.struct("url"))).otherwise(
        F.concat(F.lit('"'), F.col("url"), F.lit('"'))
    )
    maps = rows.groupBy("page_id").agg(
        F.concat(F.lit('{"links":["",'), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("value")
    )
    return crawl.site_map_urls(maps)


@query(
    "s4_paged_merge",
    f"WITH {LINES} SELECT title, url AS source_url, CAST(200 AS BIGINT) AS status_code, CAST(length(markdown) AS BIGINT) AS chars FROM md",
)
def s4(spark, folder):
    """A crawl delivered in parts, one folder for each scheme, is read as one."""
    part = F.when(F.col("value").contains('"sourceURL":"https://'), "secure").otherwise("plain")
    path = delivered(spark, envelopes(spark, folder).select("value", part.alias("part")), "part")
    return _page_facts(crawl.read_crawl_results(spark, path, lines=True))
