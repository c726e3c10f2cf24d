"""Jobs on crawled pages and URLs. All of them are projections: one row in, one row (or array) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagewell.functions import urls as u
from sagewell.functions import vocab
from sagewell.functions.text import BLANK, collapse, contains_any, decode_entities, first_rule, let, strip
from sagewell.operators.rank import first_per

# What the URL filters reject.
ASSET_PATTERN = r"\.(jpg|jpeg|png|gif|webp|svg|ico|css|js|mp4|mov|zip|pdf|woff2?|ttf|eot)$"
SCOPE_EXCLUDES = [
    r".*\.(jpg|jpeg|png|gif|webp|svg|ico|css|js|mp4|mov|zip)$",
    ".*login.*", ".*register.*", ".*checkout.*", ".*cart.*",
]


def canonical_pages(pages: DataFrame) -> DataFrame:
    """Pages with canonical URL and site key; of equal canonical URLs the lowest page id stays."""
    keyed = pages.withColumn("canonical_url", u.canonical_url(F.col("url"))).withColumn(
        "site_id", u.site_key(F.col("url"))
    )
    return first_per(keyed.filter(F.col("canonical_url").isNotNull()), ["canonical_url"], [F.col("page_id")])


# --- URL rules -------------------------------------------------------------------------------


def _host_allowed(host: Column, domains, include_subdomains: bool) -> Column:
    ok = F.lit(False)
    for domain in domains:
        ok = ok | (host == domain.lower())
        if include_subdomains:
            ok = ok | host.endswith("." + domain.lower())
    return ok


def skip_reason(
    url: Column,
    *,
    allowed_domains=None,
    default_domains=(),
    include_subdomains: bool = True,
    exclude_patterns=(),
    languages=("en", "fr", "de", "es"),
    unsupported_languages=("ko", "zh", "ru"),
) -> Column:
    """Reason a canonical URL is not admitted, null when it is. The first rule that applies wins.

    Language rules apply only when the caller names no domains.
    """
    domains = allowed_domains or default_domains

    def judge(parts: Column) -> Column:
        return _skip_reason(
            parts["url"], parts["path"], parts["host"], domains, include_subdomains, exclude_patterns,
            (languages, unsupported_languages) if allowed_domains is None else None)

    path = F.lower(F.regexp_extract(url, u.ABSOLUTE, 3))
    return let(F.struct(url.alias("url"), path.alias("path"), u.host(url).alias("host")), judge)


def _skip_reason(url, path, host, domains, include_subdomains, exclude_patterns, language_rules) -> Column:
    reason = (
        F.when(~_host_allowed(host, domains, include_subdomains), "external_domain")
        .when(path.rlike(ASSET_PATTERN), "static_asset")
        .when(contains_any(path, vocab.AUTH_SEGMENTS), "auth_page")
        .when(contains_any(path, vocab.TRANSACTION_SEGMENTS), "auth_or_transaction_page")
    )
    for pattern in exclude_patterns:
        reason = reason.when(url.rlike("(?i)" + pattern), "excluded_by_policy")
    if language_rules is not None:
        languages, unsupported_languages = language_rules
        rejected = path.rlike("/(" + "|".join(unsupported_languages) + ")(/|$)")
        supported = path.rlike("/(" + "|".join(languages) + ")(/|$)")
        reason = reason.when(rejected | ~supported, "unsupported_language")
    return reason


def url_category(url: Column, rules=None, suffix_rules=(), default: str = "page") -> Column:
    """Category of a URL: path-suffix rules first, then substring rules, else ``page``."""
    lowered = F.lower(url)
    by_keyword = first_rule(lowered, rules or vocab.URL_CATEGORY_RULES, default)
    for name, suffix in reversed(list(suffix_rules)):
        by_keyword = F.when(
            F.regexp_replace(F.regexp_extract(lowered, u.ABSOLUTE, 3), "/+$", "").endswith(suffix), name
        ).otherwise(by_keyword)
    return by_keyword


def category_rank(category: Column, ranks: dict[str, int] | None = None) -> Column:
    ranks = ranks or vocab.URL_CATEGORY_RANK
    pairs = F.create_map(*[F.lit(v) for pair in sorted(ranks.items()) for v in pair])
    return F.coalesce(F.try_element_at(pairs, category), F.lit(99))


def in_scope(url: Column, include_patterns=(), exclude_patterns=tuple(SCOPE_EXCLUDES)) -> Column:
    """Crawl scope: some include pattern matches (if any are given) and no exclude pattern does."""
    inside = F.lit(True)
    if include_patterns:
        inside = url.rlike("^(?:" + "|".join(include_patterns) + ")")
    if exclude_patterns:
        inside = inside & ~url.rlike("^(?:" + "|".join(exclude_patterns) + ")")
    return inside


def admit_urls(urls: DataFrame, *, url_rules=None, suffix_rules=(), **policy) -> DataFrame:
    """Canonical URLs with ``category`` and ``skip_reason``."""
    return urls.withColumn("skip_reason", skip_reason(F.col("url"), **policy)).withColumn(
        "category", F.when(F.col("skip_reason").isNull(), url_category(F.col("url"), url_rules, suffix_rules))
    )


HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    """Link targets in page order, quoted either way or not at all, with character references resolved."""
    values = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(values, lambda v: decode_entities(F.regexp_replace(v, r"^[\"']|[\"']$", "")))


def link_rows(pages: DataFrame) -> DataFrame:
    """Every page URL and every link on it, canonical, with the page's position in the crawl.

    Relative links are resolved against the page first. ``pos`` 0 is the page itself.
    """
    source = u.canonical_url(F.col("url"))
    # One transform for each step: a bound value is written into the plan once.
    absolute = F.transform(hrefs(F.col("html")), lambda href: u.resolve(href, F.col("url")))
    links = F.transform(absolute, u.canonical_url)
    return (
        pages.withColumn("source", source)
        .select("page_id", "source", F.posexplode(F.concat(F.array("source"), links)).alias("pos", "url"))
        .filter(F.col("url").isNotNull())
        .withColumn("discovered_from", F.when(F.col("pos") > 0, F.col("source")))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per URL with its first discoverer."""
    order = F.struct("page_id", "pos")
    return (
        link_rows(pages)
        .groupBy("url")
        .agg(F.min(F.struct("page_id", "pos", "discovered_from")).alias("first"))
        .select("url", "first.discovered_from", "first.page_id", "first.pos")
    )


def merge_candidates(found: DataFrame, extra: DataFrame, seed_url: str) -> DataFrame:
    """Add listed URLs (site map, entry points) to the discovered ones.

    A URL keeps the place where it was seen first; a listed URL is attributed to the seed.
    """
    listed = extra.select(
        u.canonical_url(F.col("url")).alias("url"),
        F.lit(seed_url).alias("discovered_from"),
        F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("int").alias("pos"),
        F.lit(True).alias("is_listed"),
    ).filter(F.col("url").isNotNull())
    both = found.select("url", "discovered_from", "page_id", "pos", F.lit(False).alias("is_listed")).unionByName(listed)
    return both.groupBy("url").agg(
        F.max_by("discovered_from", "is_listed").alias("discovered_from"),
        F.min("page_id").alias("page_id"),
        F.bool_or("is_listed").alias("is_listed"),
    )


def select_urls(candidates: DataFrame, **policy) -> DataFrame:
    """Candidates with category, skip reason and crawl priority (``sort_rank`` then URL)."""
    return admit_urls(candidates, **policy).withColumn(
        "sort_rank", F.when(F.col("skip_reason").isNull(), category_rank(F.col("category")))
    )


# --- Markdown pages --------------------------------------------------------------------------

LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"

# Image and link mark-up removed from a line, in this order.
LINE_REWRITES = [
    (r"\\", " "),
    (r"\[!\[\s*([^\n]*?)\s*\]\([^)]+\)\s*\]\([^)]+\)", "$1"),
    (r"\[!\[\s*\]\([^)]+\)\s*([^\]]*?)\s*\]\([^)]+\)", "$1"),
    (r"\[!\[\s*([^\n]*?)\]\([^)]+\)([^\]]*?)\s*\]\([^)]+\)", "$1$2"),
    (r"!\[[^\n]*?\]\([^)]+\)", ""),
    (r"\s*!\[\s*", " "),
    (r"\[\s*\]\([^)]+\)", ""),
    (r"(?i)\[_?[^\]\s]*\.(?:jpg|jpeg|png|webp|svg)\)\s*", "["),
    (r"(?i)\s*Copy to clipboard\s+\S+", ""),
    (r"(?i)\(?data:image/svg\+xml[^)\]\s]*\)?", ""),
]
LANGUAGE_SWITCH = r"^-?\s*\[(English|Français|Deutsch|Español)\]\(https?://[^)]+\)$"
CONTENTS_ENTRY = r"(?iU)^\s*-?\s*\[\s*\d+\s*[.)]?\s*.+#[-\w%]+"


def clean_line(line: Column) -> Column:
    # Mark-up needs one of these signs; most lines have none and skip the rewrites.
    rewritten = line
    for pattern, replacement in LINE_REWRITES:
        rewritten = F.regexp_replace(rewritten, pattern, replacement)
    marked = line.rlike(r"(?i)[\\\[!]|copy to clipboard|data:image")
    return F.when(marked, strip(rewritten)).otherwise(line)


def is_footer(line: Column) -> Column:
    def opens(bare: Column) -> Column:
        found = F.lit(False)
        for prefix in vocab.FOOTER_PREFIXES:
            found = found | bare.startswith(prefix)
        return found

    return let(strip(F.regexp_replace(F.lower(line), "^[#\\- ]+", "")), opens)


def is_noise(line: Column) -> Column:
    return let(F.lower(line), lambda lowered: _noise(line, lowered))


def _noise(line: Column, lowered: Column) -> Column:
    return (
        line.startswith("![")
        | lowered.isin(vocab.NOISE_LINES)
        | contains_any(lowered, vocab.NOISE_FRAGMENTS)
        | line.rlike(LANGUAGE_SWITCH)
        | line.rlike(CONTENTS_ENTRY)
    )


def cleaned_lines(markdown: Column) -> Column:
    """Non-empty lines without image mark-up (noise and footer still inside)."""
    lines = F.transform(
        F.split(F.coalesce(markdown, F.lit("")), LINE_BREAK), lambda x: let(strip(x), clean_line)
    )
    return F.filter(lines, lambda line: line != "")


def before_footer(lines: Column) -> Column:
    """Lines up to the first one that opens related content."""
    return let(lines, _cut_at_footer)


def _cut_at_footer(lines: Column) -> Column:
    return let(
        F.array_position(F.transform(lines, is_footer), True),
        lambda at: F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines),
    )


def drop_noise(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~is_noise(line))


def heading_text(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^[# ]+|[# ]+$", ""))


def good_label(label: Column) -> Column:
    return (F.length(label) >= 8) & ~contains_any(F.lower(label), vocab.BAD_LABEL_FRAGMENTS)


def from_primary_heading(lines: Column, preferred=()) -> Column:
    """Lines from a preferred heading on, else from the first usable heading, else all."""

    def usable(line: Column) -> Column:
        label = heading_text(line)
        good = let(label, lambda x: good_label(x) & ~F.lower(x).isin(vocab.WIDGET_HEADINGS))
        return F.when(line.rlike(r"^#\s+.+"), good).otherwise(F.lit(False))

    def start(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, usable), True)
        for heading in reversed(list(preferred)):
            exact = F.array_position(lines, heading)
            at = F.when(exact > 0, exact).otherwise(at)
        return at

    def cut(lines: Column) -> Column:
        return let(
            start(lines),
            lambda at: F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).otherwise(lines),
        )

    return let(lines, cut)


def section_label(chunk: Column, fallback: Column) -> Column:
    """First usable heading inside a Markdown chunk, else the title."""
    headings = F.transform(
        F.filter(F.transform(F.split(chunk, LINE_BREAK), strip), lambda x: x.startswith("#")), heading_text
    )
    return F.coalesce(F.get(F.filter(headings, good_label), 0), fallback)


def markdown_text(markdown: Column, preferred=()) -> Column:
    """Cleaned, trimmed page text ready for the Markdown chunker."""
    lines = drop_noise(before_footer(cleaned_lines(markdown)))
    return F.array_join(from_primary_heading(lines, preferred), "\n")


# --- HTML pages ------------------------------------------------------------------------------

BLOCK_TAGS = "h1|h2|h3|p|li|td|th|figcaption"
CONTAINER_TAGS = "article|section|footer|header|nav|div|ul|ol|table|tr|body|html|main|aside|head"
ENTITIES = [
    ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
MARK, END = "\x01", "\x02"


def without_hidden(html: Column) -> Column:
    """HTML without scripts, styles, hidden parts and comments."""
    for tag in ("script", "style", "noscript", "svg"):
        html = F.regexp_replace(html, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def visible_text(markup: Column) -> Column:
    """Inline tags become blanks, entities are resolved, blanks collapsed."""
    return collapse(decode_entities(F.regexp_replace(markup, r"(?s)<[^>]*>", " ")))


def html_title(html: Column, default: str = "Untitled page") -> Column:
    title = visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title == "", default).otherwise(title)


def html_description(html: Column) -> Column:
    """The page's description tag, whatever the order and the quotes of its attributes."""
    tag = F.regexp_extract(html, r"(?is)<meta\s(?:[^>]*\s)?name\s*=\s*[\"']description[\"'][^>]*>", 0)
    quoted = F.regexp_extract(tag, r"""(?is)\scontent\s*=\s*("[^"]*"|'[^']*')""", 1)
    return visible_text(let(quoted, lambda q: F.substring(q, F.lit(2), F.greatest(F.length(q) - 2, F.lit(0)))))


def html_blocks(html: Column, min_chars: int = 12) -> Column:
    """Array of (tag, text) blocks in page order.

    Blocks are flat: a block or container tag ends the block before it, so text is never repeated
    where mark-up leaves a block open (a parser that nests open paragraphs would repeat it).
    """
    marked = F.regexp_replace(without_hidden(html), rf"(?i)<({BLOCK_TAGS})(\s[^>]*)?>", f"{MARK}$1{END}")
    marked = F.regexp_replace(marked, rf"(?i)</?({BLOCK_TAGS}|{CONTAINER_TAGS})(\s[^>]*)?>", f"{MARK}{END}")
    parts = F.transform(
        F.split(marked, MARK),
        lambda part: F.struct(
            F.lower(F.substring_index(part, END, 1)).alias("tag"),
            visible_text(F.substring_index(part, END, -1)).alias("text"),
        ),
    )
    tags = BLOCK_TAGS.split("|")
    return F.filter(parts, lambda b: b["tag"].isin(tags) & (F.length(b["text"]) >= min_chars))


SECTIONED = "array<struct<section:string,text:string>>"


def sectioned_blocks(blocks: Column, title: Column) -> Column:
    """Carry the latest heading forward; blocks under a related-content heading are left out."""

    def step(state: Column, block: Column) -> Column:
        heading = block["tag"].isin("h1", "h2", "h3")
        label = F.substring(block["text"], 1, 180)
        related = contains_any(F.lower(label), vocab.RELATED_HEADINGS)
        section = F.when(heading & related, F.lit(None)).when(heading, label).otherwise(state["section"])
        return F.struct(
            section.alias("section"),
            F.when(section.isNull(), state["out"])
            .otherwise(
                F.concat(
                    state["out"], F.array(F.struct(section.alias("section"), block["text"].alias("text")))
                )
            )
            .alias("out"),
        )

    start = F.struct(F.substring(title, 1, 140).alias("section"), F.array().cast(SECTIONED).alias("out"))
    return F.aggregate(blocks, start, step, lambda state: state["out"])


def grouped_sections(blocks: Column) -> Column:
    """Texts of equal section joined, sections in first-seen order."""
    return let(blocks, _group)


def _group(blocks: Column) -> Column:
    sections = F.array_distinct(F.transform(blocks, lambda b: b["section"]))
    return F.transform(
        sections,
        lambda s: F.struct(
            s.alias("section"),
            F.array_join(
                F.transform(F.filter(blocks, lambda b: b["section"] == s), lambda b: b["text"]), " "
            ).alias("text"),
        ),
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """One row per (page, section) with the joined text; no shuffle, the page is one row."""
    described = F.when(
        F.col("description") != "",
        F.array(F.struct(F.lit("Meta description").alias("section"), F.col("description").alias("text"))),
    ).otherwise(F.array().cast(SECTIONED))
    return (
        pages.withColumn("title", html_title(F.col("html")))
        .withColumn("description", html_description(F.col("html")))
        .withColumn("blocks", html_blocks(F.col("html")))
        .withColumn("sectioned", F.concat(described, sectioned_blocks(F.col("blocks"), F.col("title"))))
        .withColumn("grouped", grouped_sections(F.col("sectioned")))
        .drop("html", "blocks", "sectioned", "description")
        .select("*", F.posexplode("grouped").alias("section_no", "part"))
        .select("*", "part.section", "part.text")
        .drop("grouped", "part")
    )
