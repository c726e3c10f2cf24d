from pyspark.sql import functions as F

from sagewell.operators import frontier, pages
from sagewell.sources import crawl, sinks

POLICY = dict(allowed_domains=["site.test"], include_subdomains=True)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_markdown_noise_footer_and_heading(spark):
    markdown = "\n".join(
        ["[To the text](#skip)", "![logo](a.png)", "Skip to content", "# Book tickets", "# Opening hours of the park", "Open daily.",
         "[![pic](a.png) caption](http://x)", "- [1. Intro](http://x#intro-part)", "## See also", "Other page"]
    )
    lines = one(spark, markdown, lambda c: pages.drop_noise(pages.before_footer(pages.cleaned_lines(c))))
    assert lines == ["# Book tickets", "# Opening hours of the park", "Open daily.", "pic caption"]
    assert one(spark, markdown, pages.markdown_text).startswith("# Opening hours")
    assert one(spark, markdown, lambda c: pages.section_label(c, F.lit("Title"))) == "Book tickets"
    assert one(spark, "no heading", lambda c: pages.section_label(c, F.lit("Title"))) == "Title"


def test_related_sections_are_left_out(spark):
    html = (
        "<html><head><title>Park</title><meta name='description' content='A fine park to see'><script>x</script></head><body>"
        "<p>Before any heading text</p><h2>Opening hours here</h2><p>Open from nine to five</p><li>short</li>"
        "<h2>Related posts and more</h2><p>Should not be found</p><h2>Opening hours here</h2><p>Closed on holidays &amp; more</p></body></html>"
    )
    df = spark.createDataFrame([(1, "https://site.test/a", html)], "page_id long, url string, html string")
    found = {r["section"]: r["text"] for r in pages.page_sections(df).collect()}
    assert found == {
        "Meta description": "A fine park to see",
        "Park": "Before any heading text",
        "Opening hours here": "Opening hours here Open from nine to five Opening hours here Closed on holidays & more",
    }


def test_skip_reasons_in_order(spark):
    cases = {
        "https://other.test/login": "external_domain",
        "https://a.site.test/x.png": "static_asset",
        "https://site.test/login": "auth_page",
        "https://site.test/cart/1": "auth_or_transaction_page",
        "https://site.test/news": None,
    }
    for url, reason in cases.items():
        assert one(spark, url, lambda c: pages.skip_reason(c, **POLICY)) == reason
    assert one(spark, "https://site.test/ru/x", lambda c: pages.skip_reason(c, default_domains=["site.test"])) == "unsupported_language"
    assert one(spark, "https://site.test/en/x", lambda c: pages.skip_reason(c, default_domains=["site.test"])) is None


def site(spark):
    def page(i, url, *links):
        return (i, url, "".join(f'<a href="{x}">x</a>' for x in links))

    rows = [
        page(1, "https://site.test/", "/b", "/price/late", "https://else.test/"),
        page(2, "https://site.test/b", "/c", "/price/first"),
        page(3, "https://site.test/c"),
        page(4, "https://site.test/price/first"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def crawl_log(spark, **options):
    all_pages = site(spark)
    start = all_pages.filter("page_id = 1")
    found = pages.merge_candidates(pages.page_links(start), all_pages.select("url").limit(0), "https://site.test/")
    return frontier.expand_frontier(found, all_pages, start.select("url"), **options, **POLICY)


def test_strict_frontier_reranks_after_every_page(spark):
    log = [(r["url"][17:], r["scraped"]) for r in crawl_log(spark, budget=2, strict=True).orderBy("wave").collect()]
    # The missing price page is tried first, then /b; the price page /b leads to overtakes /c.
    assert log == [("/price/late", False), ("/b", True), ("/price/first", True)]


def test_wave_frontier_reaches_everything_within_budget(spark):
    log = crawl_log(spark, budget=10).collect()
    assert {(r["url"][17:], r["wave"], r["scraped"]) for r in log} == {
        ("/b", 0, True), ("/price/late", 0, False), ("/c", 1, True), ("/price/first", 1, True)
    }


def test_every_job_of_a_frontier_has_its_own_budget(spark):
    from sagewell.functions.urls import site_key

    hosts = [f"h{i}.site.test" for i in range(5)]
    rows = []
    for at, host in enumerate(hosts):
        first = "".join(f'<a href="/{x}">{x}</a>' for x in ("b", "c", "price/late"))
        rows += [(10 * at, f"https://{host}/", first), (10 * at + 1, f"https://{host}/b", '<a href="/price/new">n</a>'),
                 (10 * at + 2, f"https://{host}/c", ""), (10 * at + 3, f"https://{host}/price/new", "")]
    rows += [(100 + i, f"https://h0.site.test/z{i}", "") for i in range(20)]
    stored = spark.createDataFrame(rows, "page_id long, url string, html string")
    start = stored.filter("page_id % 10 = 0 AND page_id < 100")
    policy = {**POLICY, "allowed_domains": hosts}

    def crawl_of(some):
        mine = start.filter(F.col("url").isin([f"https://{h}/" for h in some]))
        found = pages.merge_candidates(pages.page_links(mine), stored.filter("page_id >= 100").select("url").filter(
            F.lit(hosts[0] in some)), f"https://{some[0]}/")
        return {tuple(r) for r in frontier.expand_frontier(
            found, stored, mine.select("url"), budget=2, job=site_key, **policy
        ).select("url", "category", "wave", "scraped").collect()}

    # All jobs together visit what each visits alone, so none waits for another's budget.
    together = crawl_of(hosts)
    assert {h: sum(r[3] for r in together if r[0].startswith(f"https://{h}/")) for h in hosts} == dict.fromkeys(hosts, 2)
    for host in (hosts[0], hosts[3]):
        assert {r for r in together if r[0].startswith(f"https://{host}/")} == crawl_of([host])


def test_crawl_files_and_single_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data":[{"markdown":"# A","metadata":{"title":"A","sourceURL":"https://site.test/a"}},{"metadata":{"url":"https://site.test/b"}}]}')
    (tmp_path / "b.json").write_text('{"data":[{"markdown":"# C","metadata":{"sourceURL":"https://site.test/c"},"links":["x"]}]}')
    rows = {r["source_url"]: r for r in crawl.read_crawl_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {f"https://site.test/{x}" for x in "abc"}
    assert rows["https://site.test/b"]["markdown"] == "" and rows["https://site.test/c"]["links"] == ["x"]
    single = tmp_path / "one.json"
    single.write_text('{"success":true,"data":{"markdown":"# D","metadata":{"sourceURL":"https://site.test/d"}}}')
    assert crawl.read_single_pages(spark, str(single)).first()["source_url"] == "https://site.test/d"
    cases = tmp_path / "cases.json"
    cases.write_text('[{"id":"1","transcript":"hi","expected_handoff":true},{"id":"2","turns":["a","b"]}]')
    assert crawl.read_cases(spark, str(cases)).count() == 2


def test_insert_twice_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "k"), (2, "k"), (3, "m")], "id int, key string")
    path = str(tmp_path / "t")
    assert sinks.append_new(spark, path, batch, ["key"], [F.asc("id")]) == 2
    assert sinks.append_new(spark, path, batch, ["key"], [F.asc("id")]) == 0
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {1, 3}


def test_url_metadata_prefers_the_url_as_given(spark):
    urls = spark.createDataFrame([(1, "HTTPS://Site.test/a/"), (2, "https://site.test/none")], "page_id long, url string")
    extra = spark.createDataFrame([("https://site.test/a", {"k": "canonical"})], "url string, extra map<string,string>")
    got = {r["page_id"]: r["extra"] for r in crawl.url_metadata(urls, extra, "page_id", [F.col("url")]).collect()}
    assert got == {1: {"k": "canonical"}, 2: None}


def test_links_of_all_forms(spark):
    from sagewell.operators.pages import link_rows

    html = (
        """<A class=x HREF='/one'>1</A> <a href=two/three>2</a> <a\n href = "../four?x=1&amp;y=2#z">3</a>"""
        """<a href="#top">4</a><a href="?p=2">5</a><a data-href="/no">6</a><a href="/x/./y/../caf&eacute;">7</a>"""
        """<a href="../../../..">8</a><a href="mailto:a@b.c">9</a><a href="//other.org/q/">10</a>"""
    )
    pages = spark.createDataFrame([(1, "https://a.org/b/c", html)], "page_id long, url string, html string")
    got = [r["url"] for r in link_rows(pages).orderBy("pos").collect()]
    assert got == [
        "https://a.org/b/c", "https://a.org/one", "https://a.org/b/two/three", "https://a.org/four",
        "https://a.org/b/c", "https://a.org/b/c", "https://a.org/x/café", "https://a.org/", "https://other.org/q",
    ]


def test_character_references(spark):
    import html

    from sagewell.functions.text import decode_entities

    cases = [
        "a &amp; b", "&amp;lt;", "&#8217;&eacute;&Eacute;", "&#x1F600;&#X41;", "&unknown; & &; &amp", "&", "",
        "&#0;&#xD800;&#x110000;&#99999999999999999999;", "&apos;&nbsp;&hellip;", "no reference", None,
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    got = [r["d"] for r in rows.select("i", decode_entities("v").alias("d")).orderBy("i").collect()]
    # References without a semicolon stay.
    expected = [c if c is None or c == "&unknown; & &; &amp" else html.unescape(c) for c in cases]
    assert got == expected


def test_description_in_any_form(spark):
    from sagewell.operators.pages import html_description

    cases = {
        '<meta name="description" content="It\'s &eacute;">': "It's é",
        "<META content='one \"two\"' property=x NAME='description'/>": 'one "two"',
        '<meta name="keywords" content="no">': "", "": "",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "html string, wanted string")
    assert all(r["d"] == r["wanted"] for r in rows.select(html_description(F.col("html")).alias("d"), "wanted").collect())
