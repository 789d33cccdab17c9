"""Feed, API, page and response payloads on inline fixtures."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from postlake.functions import markup
from postlake.operators import ledger
from postlake.plans import jobs
from postlake.sources import apis, elements, feeds, pages, responses


def body(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def feed(*items):
    return ('<?xml version="1.0"?><rss xmlns:dc="d" xmlns:himalayasJobs="h"><channel>'
            + "".join(f"<item>{i}</item>" for i in items) + "</channel></rss>")


def test_feed_location(spark):
    xml = feed(
        "<title> Dev </title><link/><guid isPermaLink='false'>https://g/1</guid>"
        "<description>&lt;b&gt;Pune&lt;/b&gt; - great &amp;amp; good</description><source url='s'>Acme</source>",
        "<title>Ops</title><link>https://l/2</link><description>no dash here</description><author>Bob</author>",
        f"<title>Long</title><link>https://l/3</link><description>{'x' * 60} - y</description>",
        "<title></title><link>https://l/4</link>", "<title>No link</title>",
    )
    rows = {r.url: r for r in feeds.rss_items(body(spark, xml, "not xml", feed()), "location_in_description").collect()}
    assert set(rows) == {"https://g/1", "https://l/2", "https://l/3"}
    assert (rows["https://g/1"].title, rows["https://g/1"].company, rows["https://g/1"].location) == ("Dev", "Acme", "Pune")
    assert rows["https://g/1"].description == "Pune - great &amp; good"
    assert (rows["https://l/2"].company, rows["https://l/2"].location) == ("Bob", None)
    assert (rows["https://l/3"].company, rows["https://l/3"].location) == ("Unknown", None)


def test_feed_creator(spark):
    xml = feed("<title>Dev</title><link>1</link><dc:creator>Acme</dc:creator><company>Other</company>",
               "<title>Dev at Big at Home</title><link>2</link>", "<title>Dev</title><link>3</link>")
    rows = {r.url: (r.title, r.company) for r in feeds.rss_items(body(spark, xml), "creator_company").collect()}
    assert rows == {"1": ("Dev", "Acme"), "2": ("Dev at Big at Home", "Home"), "3": ("Dev", "Unknown")}


def test_feed_role(spark):
    xml = feed(
        "<title>Dev AT  Big Co</title><link>https://h/1</link>",
        "<title>Dev at Big Co</title><link>https://h/2</link><himalayasJobs:companyName>Tagged</himalayasJobs:companyName>",
        "<title>Dev</title><link>https://h/companies/imagine-aRT/jobs/3</link>",
        "<title>Dev</title><link>https://h/4</link><companyName>Plain</companyName>",
    )
    rows = [(r.title, r.company) for r in feeds.rss_items(body(spark, xml), "role_at_company").orderBy("item_no").collect()]
    assert rows == [("Dev", "Big Co"), ("Dev", "Tagged"), ("Dev", "Imagine ART"), ("Dev", "Plain")]
    with pytest.raises(ValueError):
        feeds.rss_items(body(spark, xml), "other")


def test_api_serp_falls_back_to_links(spark):
    df = spark.createDataFrame([
        (json.dumps({"jobs": [{"title": "Dev", "link": "u1"}, {"company": "C", "snippet": "s"}], "organic": [{"title": "o", "link": "l"}]}), "Pune"),
        (json.dumps({"jobs": [], "organic": [{"title": "o", "link": "l"}, {"title": "no link"}]}), "Delhi"),
        ("broken", "x"), ("{}", "y"),
    ], "body string, location string")
    rows = {(r.title, r.company, r.location, r.description, r.url) for r in apis.api_serp(df).collect()}
    assert rows == {("Dev", "Unknown", None, "Dev at undefined", "u1"), ("", "C", None, "s", ""),
                    ("o", "Various / See Link", "Delhi", "o", "l")}


def test_api_board(spark):
    jobs_ = [{"designation": "Dev", "company": "C", "jobId": 7, "placeholders": [{"type": "salary", "label": "5"}], "jobLocation": "Pune"},
             {"title": "Ops", "jdURL": "/x", "snippet": "s"}, {"companyName": "no title"}]
    rows = apis.api_board(body(spark, json.dumps({"data": jobs_}))).orderBy("item_no").collect()
    assert [(r.title, r.company, r.url, r.salary, r.location, r.platform_job_id) for r in rows] == [
        ("Dev", "C", "https://www.naukri.com/job-listings-7", "5", "Pune", "7"),
        ("Ops", "Unknown", "https://www.naukri.com/x", None, None, None)]


def test_api_aggregator(spark):
    data = [{"job_title": "Dev", "job_apply_link": "u", "job_city": "Pune", "job_country": "IN", "job_min_salary": 10.5},
            {"job_title": "Ops", "job_apply_link": "v", "job_is_remote": True, "job_min_salary": 1, "job_max_salary": 2,
             "job_salary_currency": "USD", "job_salary_period": "HOUR"}, {"job_title": "x"}]
    rows = apis.api_aggregator(body(spark, json.dumps({"data": data}))).orderBy("item_no").collect()
    assert [(r.title, r.location, r.salary) for r in rows] == [("Dev", "Pune, IN", "₹10.5+/year"), ("Ops", "Remote", "USD1-2/HOUR")]


def test_jsonld_and_script_rows(spark):
    posting = {"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "C"}, "description": "<p>d</p>",
               "jobLocation": {"name": "Pune"}, "estimatedSalary": [{"value": 9}], "directApply": "d"}
    ld = lambda v: f'<script type="application/ld+json">{json.dumps(v)}</script>'
    html = ld(posting) + ld([posting, {"@type": "Org"}]) + ld({"@graph": [posting]}) + '<script type="application/ld+json">{bad</script>'
    df = spark.createDataFrame([(1, "u", html), (2, "v", "<p>none</p>")], "page_id bigint, url string, html string")
    rows = pages.jsonld_postings(df).collect()
    assert len(rows) == 3 and {(r.page_id, r.company, r.location, r.salary, r.url, r.description) for r in rows} == {(1, "C", "Pune", "9", "d", "d")}
    assert pages.jsonld_postings(df, graph=False).count() == 2
    script = '<script>internship_list_data = [{"id": 5, "title": "I", "location_names": ["a", "b"]}, {"title": ""}]; x = [1];</script>'
    got = pages.script_var_listings(spark.createDataFrame([(1, "u", script)], "page_id bigint, url string, html string")).collect()
    assert [(r.title, r.company, r.location, r.url) for r in got] == [
        ("I", "Unknown", "a, b", "https://internshala.com/internship/detail/5")]


def test_rules_and_links(spark):
    html = ('<h1 class="x"> </h1><h1>Fallback</h1><span class="company-name">Acme <b>Co</b></span>'
            '<a href="/a">a</a><a href="/a">again</a><a href="b?x=1">b</a><a href="https://other.com/c">c</a>'
            '<a href="mailto:x@y.z">m</a><a href="//h.example.com/d">d</a>')
    df = spark.createDataFrame([(1, "https://h.example.com/dir/p.html?q=1", html)], "page_id bigint, url string, html string")
    row = pages.extract_fields(df, [("title", 2, "h1"), ("title", 1, "h1.x"),
                                    ("company", 1, 'span[class*="company"]')]).first()
    assert (row.title, row.company) == ("Fallback", "Acme Co")
    assert {r.link for r in pages.page_links(df).collect()} == {
        "https://h.example.com/a", "https://h.example.com/dir/b?x=1", "https://h.example.com/d"}
    assert pages.page_links(df, scope="all").count() == 4
    assert pages.page_links(df, pattern="/a$").count() == 1


RECORD = {"title": " Dev ", "company": "C", "applyLink": "x", "isFresher": True, "jobType": ""}


@pytest.mark.parametrize("fmt,reply", [
    ("openai", {"choices": [{"message": {"tool_calls": [{"function": {"arguments": "PAYLOAD"}}]}}]}),
    ("openai", {"choices": [{"message": {"content": "PAYLOAD"}}]}),
    ("openai", {"choices": [{"message": {"content": [{"text": "PAYLOAD"}, {"other": 1}]}}]}),
    ("anthropic", {"content": [{"type": "text", "text": "PAYLOAD"}]}),
    ("gemini", {"candidates": [{"content": {"parts": [{"functionCall": {"args": "PAYLOAD"}}]}}]}),
    ("gemini", {"candidates": [{"content": {"parts": [{"text": "PAYLOAD"}]}}]}),
    ("ollama", {"message": {"content": "PAYLOAD"}}),
])
@pytest.mark.parametrize("wrap", [
    "{\"jobs\": [%s]}", "[%s]", "%s", "Sure: [%s] bye", "Sure: %s bye", "{\"z\": 1, \"list\": [%s], \"a\": []}",
])
def test_response_forms(spark, fmt, reply, wrap):
    payload = wrap % json.dumps(RECORD)
    text = json.dumps(reply).replace('"PAYLOAD"', json.dumps(payload))
    df = spark.createDataFrame([(fmt, "p", "https://h.com/a/b", "SHINE_HUB", text)],
                               "api_format string, provider string, page_url string, source_label string, body string")
    rows = responses.sanitize_records(responses.salvage_records(responses.response_payload(df))).collect()
    assert [(r.title, r.apply_link, r.source, r.job_type) for r in rows] == [("Dev", "https://h.com/x", "shine", "")]
    listing = jobs.extract_from_responses(df).first()
    assert (listing.url, listing.location, listing.description, listing.job_type) == ("https://h.com/x", "India", "Dev at C", None)


def test_response_rubbish_and_tool_objects(spark):
    cols = "api_format string, provider string, page_url string, source_label string, body string"
    tool = {"content": [{"type": "tool_use", "input": {"jobs": [RECORD, {**RECORD, "isFresher": False}]}}]}
    df = spark.createDataFrame([
        ("anthropic", "p", "u", "S", json.dumps(tool)), ("openai", "p", "u", "S", "no json"),
        ("openai", "p", "u", "S", json.dumps({"choices": [{"message": {"content": "sorry [not json"}}]})),
        ("ollama", "p", "u", "S", json.dumps({"message": {"content": "42"}})),
    ], cols)
    rows = responses.sanitize_records(responses.salvage_records(responses.response_payload(df)))
    assert rows.count() == 2 and responses.fresher_only(rows).count() == 1


def test_page_path_prefers_cache_then_model_then_rules(spark):
    from postlake.functions.hashing import hash16

    filler = "<p>" + "words " * 30 + "</p>"
    df = spark.createDataFrame([
        (1, "https://h.com/1", "shine", "<title>Job</title>" + filler), (2, "https://h.com/2", "shine", "<h1>Rule title</h1>" + filler),
        (3, "https://h.com/3", "shine", "<title>Access Denied</title>" + filler), (4, "https://h.com/4", "shine", "cached page" + filler),
    ], "page_id bigint, url string, site string, html string")
    reply = json.dumps({"choices": [{"message": {"content": json.dumps([{**RECORD, "applyLink": "https://m/1"}])}}]})
    answers = spark.createDataFrame([("openai", "p", "https://h.com/1", "SHINE_HUB", reply), ("openai", "p", "https://h.com/4", "SHINE_HUB", reply)],
                                    "api_format string, provider string, page_url string, source_label string, body string")
    cache = df.filter("page_id = 4").select(
        hash16("html").alias("content_hash"), F.lit(json.dumps([{**RECORD, "applyLink": "https://cache/4"}])).alias("jobs"),
        F.lit("2024-01-01 12:00:00").cast("timestamp").alias("cached_at"))
    out = jobs.extract_pages(df, answers, cache, "2024-01-02 00:00:00")
    assert {r.url for r in out["extracted"].collect()} == {"https://m/1", "https://cache/4"}
    assert [(r.url, r.title) for r in out["by_rules"].collect()] == [("https://h.com/2", "Rule title")]
    assert [r.page_id for r in out["blocked"].collect()] == [3]
    late = jobs.extract_pages(df, answers, cache, "2024-01-03 00:00:00")
    assert {r.url for r in late["extracted"].collect()} == {"https://m/1"}


def test_site_fields(spark):
    marked = {
        "indeed": '<div data-testid="inlineHeader-companyName"><a>Acme</a></div><a>not this</a><h1 class="x jobTitle">Dev</h1>'
                  '<div id="jobDescriptionText">Long <b>text</b></div>',
        "timesjobs": '<h1 class="jd-job-title">Dev</h1><h2 class="heading other">Acme</h2><li title="salary"><i>9 LPA</i></li>',
        "wellfound": '<h1 class="startup-header">Dev</h1><h1 class="styles_name__x">Dev at Acme | Site</h1>',
        "linkedin": '<h1 class="topcard__title">Dev</h1><a class="topcard__org-name-link">Acme</a><time>2 days ago</time>',
        "unknown": "<h1>Dev</h1>",
    }
    df = spark.createDataFrame([(k, v) for k, v in marked.items()], "site string, html string")
    got = {r.site: r for r in pages.site_fields(df).collect()}
    assert all((got[s].title, got[s].company) == ("Dev", "Acme") for s in marked if s != "unknown")
    assert got["indeed"].description == "Long text" and got["timesjobs"].salary == "9 LPA"
    assert got["linkedin"].posted_date == "2 days ago" and got["unknown"].title is None


@pytest.mark.parametrize("selector,html,want", [
    ("h2 a", "<h2>x</h2><a>out</a><h2><a>in</a></h2>", "in"), ("div.a", '<div class="aa">1</div><div class="b a">2</div>', "2"),
    ('li[title="s"] i', '<li title="t"><i>1</i></li><li title="s"><b>x</b><i>2</i></li>', "2"), ("p,h1", "<h1>a</h1><p>b</p>", "a"),
    ("h2 a", "<h2>" + "x " * 300000 + "<a>deep</a></h2>", "deep"), ("#x", "<div id=x>bare</div>", "bare"), ("div.a", "<div class='a'>q</div>", "q"),
    ("div.d", '<div class="d"><div>Intro</div><p>Must know SQL</p>..</div><p>after</p>', "Intro Must know SQL .."),
    ("title", "<title>Tom &amp; Co</title>", "Tom & Co"), ("i", "<i>&amp;amp;</i>", "&amp;"), ("li", "<ul><li>one<li>two</ul>", "one"),
    ("div", "<div>a<script>no</script>b", "a b"), ("b", "<p>none</p>", None), ("[data-x]", "<i>1</i><i data-x>2</i>", "2"), ('a[href*=">"]', '<a href="x>y">in</a>', "in"),
])
def test_whole_elements(spark, selector, html, want):
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    assert pages.extract_fields(df, [("field", 1, selector)]).first().field == want


def test_unknown_steps_are_refused():
    with pytest.raises(ValueError):
        elements.rule_rows([(None, "field", 1, "ul > li")])


def test_paths_follow_nesting_and_not_order(spark):
    """The running maximum of ends against every pair of elements, on random trees, with paths of up to three steps."""
    rng = random.Random(61)

    def tree(depth):
        tag = rng.choice(["div", "b", "i"])
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f'<{tag} class="{rng.choice("xyz")} {rng.choice("xyz")}" id="{rng.choice("pq")}">{rng.choice("klm")}{inner}</{tag}>'

    df = spark.createDataFrame([(k, "".join(tree(5) for _ in range(3))) for k in range(30)], "page_id bigint, html string")
    rules = elements.rule_rows([(None, p, 1, p) for p in ("div", "div b", "div div", "div .x i", ".x .x .x", "#p b.y", "[class*=z] i".replace("=z", '="z"'))])
    own, hits = elements.landed(df, rules)
    got = {(r.page_no, r.field, r.number) for r in elements.whole_paths(hits, rules, ["page_no"]).collect()}
    want, all_of = set(), {}
    for r in elements.element_table(df).where("number >= 0").collect():
        all_of.setdefault(r.page_no, []).append(r)

    def fits(e, step):
        return all((e.tag == m[0]) if m[0] else True for m in [re.fullmatch(r"(\w*)(.*)", step).groups()]) and (
            "." not in step or step.split(".")[1] in e.classes) and ("#" not in step or e.attributes.get("id") == step[1:]) and (
            "*" not in step or "z" in e.attributes["class"])

    for page, own in all_of.items():
        for path in {r[1] for r in rules}:
            steps = path.split()
            reached = [e for e in own if fits(e, steps[0])]
            for step in steps[1:]:
                reached = [e for e in own if fits(e, step) and any(a.number < e.number <= a.last for a in reached)]
            want |= {(page, path, e.number) for e in reached}
    assert got == want and len(want) > 300


def test_rules_are_joins(spark):
    df = spark.createDataFrame([(1, "s", "<p>x</p>")], "page_id bigint, site string, html string")
    rules = elements.rule_rows([("s", "f", 1, "div p"), ("t", "f", 1, "p.a")])
    _, hits = elements.landed(df, rules)
    plan = elements.whole_paths(hits, rules, ["page_no"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashJoin \[site#\d+, key#\d+\], \[site#\d+, key#\d+\], Inner", plan) and "MapInArrow" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("part", ["<nav ", '<div class="company-box">', '<a "', "<p>", "</p>", "<li><ul>", "<", "<script>", "<title>"])
def test_time_of_field_rules_grows_with_the_page(part):
    def seconds(size):
        started = time.process_time()
        markup.elements_of(part * (size // len(part)))
        return time.process_time() - started

    seconds(10_000)
    assert seconds(400_000) < 12 * max(seconds(100_000), 0.05)


FEED = "<rss><channel>{}</channel></rss>"
GOOD = "<item><title>Good</title><link>https://g/1</link><description>d</description></item>"


@pytest.mark.parametrize("bad,title,description", [
    ("<item><title>A&nbsp;B</title><link>https://b</link></item>", "A\u00a0B", ""), ("<item><title>R & D</title><link>https://b</link></item>", "R & D", ""),
    ("<item><title>T</title><link>https://b</link><description>one<br>two</description></item>", "T", "one two"),
    ("<item><title><![CDATA[C & <b>D</b>]]></title><link>https://b/?a=1&b=2</link></item>", "C & <b>D</b>", ""),
])
def test_a_damaged_item_is_mended_and_takes_nothing_along(spark, bad, title, description):
    df = spark.createDataFrame([(FEED.format(GOOD + bad + GOOD),)], "body string")
    got = [(r.title, r.description) for r in feeds.rss_items(df, "creator_company").orderBy("item_no").collect()]
    assert got == [("Good", "d"), (title, description), ("Good", "d")]
    assert feeds.rejected_items(df).count() == 0


def test_lost_items_are_returned_with_their_reason(spark):
    body = FEED.format(GOOD + "<item><title>open<link>x</link></item>" + GOOD + "<item><link>https://n</link></item><item><title>cut off")
    df = spark.createDataFrame([(1, body)], "id int, body string")
    assert feeds.rss_items(df, "creator_company").count() == 2
    rejected = [(r.id, r.item_no, r.reason) for r in feeds.rejected_items(df).orderBy("item_no").collect()]
    assert rejected == [(1, 1, "item does not parse"), (1, 3, "no title"), (1, 4, "item is not closed")]


def test_repeated_keys_keep_the_last_value(spark):
    reply = json.dumps({"choices": [{"message": {"content": '[{"title":"a","title":"A"},{"title":"B","title":"B2"}]'}}]})
    df = spark.createDataFrame([("openai", "p", "https://h/1", "X_HUB", reply)], "api_format string, provider string, page_url string, source_label string, body string")
    assert [r.title for r in responses.salvage_records(responses.response_payload(df)).orderBy("item_no").collect()] == ["A", "B2"]
    usage = df.withColumn("body", F.lit('{"usage":{"total_tokens":5,"total_tokens":7}}'))
    assert responses.token_usage(usage).first().tokens == 7


def test_unquoted_type_and_unclosed_scripts(spark):
    block = '{"@type":"JobPosting","title":"t","title":"T"}'
    df = spark.createDataFrame([("u", f"<script>x<script type=application/ld+json>{block}</script><script type='application/ld+json'>open")], "url string, html string")
    assert [r.title for r in pages.jsonld_postings(df).collect()] == ["T"]


def test_links_in_any_quotes(spark):
    html = "<a href='/single?a=1&amp;b=2'>x</a><a href=/bare>y</a><a HREF = \"/double\">z</a><a href=''>empty</a>"
    df = spark.createDataFrame([(1, "https://h.example.com/", html)], "page_id bigint, url string, html string")
    assert {r.link for r in pages.page_links(df).collect()} == {
        "https://h.example.com/single?a=1&b=2", "https://h.example.com/bare", "https://h.example.com/double"}


def test_of_repeated_cache_entries_the_latest_counts(spark):
    page = spark.createDataFrame([(1, "h")], "page_id int, content_hash string")
    entries = spark.createDataFrame([("h", "old", "2024-01-01 01:00:00"), ("h", "new", "2024-01-01 02:00:00")], "content_hash string, jobs string, at string")
    cache = entries.select("content_hash", "jobs", F.col("at").cast("timestamp").alias("cached_at"))
    hits, misses = ledger.cache_split(page, cache, "2024-01-01 03:00:00")
    assert [r.jobs for r in hits.collect()] == ["new"] and misses.count() == 0


def test_cards(spark):
    html = ('<div class="individual_internship"><h3><a href="/internship/1">A</a></h3><p class="company_name"> C </p></div>'
            '<div class="individual_internship"><h3><a>B</a></h3></div><div class="individual_internship">empty</div>' + " tail" * 200000)
    rows = pages.card_listings(spark.createDataFrame([(1, html)], "page_id bigint, html string"), "internshala").collect()
    assert [(r.title, r.company, r.url, r.description) for r in rows] == [
        ("A", "C", "https://internshala.com/internship/1", "Internship: A at C"),
        ("B", "Unknown", "https://internshala.com", "Internship: B at ")]


def test_hub_links_by_site(spark):
    card = '<li class="jobs-search-results__list-item" {}>{}</li>'
    linkedin = (card.format('data-entity-urn="urn:li:jobPosting:3912345678"', "a") + card.format("", '<a href="/jobs/view/42?x=1">b</a>')
                + card.format("", '<a href="https://www.linkedin.com/jobs/view/3912345678">again</a>') + card.format("", "<a href='/else'>c</a>"))
    timesjobs = "<h2><a href='/d/1?a=1&amp;b=2'>t</a></h2><h2><a href='https://other.example.com/2'>off</a></h2><a href='/no'>n</a>"
    df = spark.createDataFrame([(1, "https://www.linkedin.com/jobs/search", "linkedin", linkedin), (2, "https://t.example.com/s", "timesjobs", timesjobs),
                                (3, "https://u.example.com/", "unknown", timesjobs), (4, None, None, None)], "page_id bigint, url string, site string, html string")
    assert {(r.page_id, r.link) for r in pages.hub_detail_links(df).collect()} == {
        (1, "https://www.linkedin.com/jobs/view/3912345678/"), (1, "https://www.linkedin.com/jobs/view/42/"), (2, "https://t.example.com/d/1?a=1&b=2")}


def test_search_cards_fall_back_to_the_flat_list(spark):
    cards = "<li data-jds='1'><h3>First job</h3><div>Acme</div><div>Pune</div><a href='/r'>go</a></li><li data-jds='2'><h3>abc</h3></li>"
    flat = "<div role='listitem'><div>x</div><h3>Flat</h3><div>Co</div></div>"
    df = spark.createDataFrame([(1, cards + flat), (2, flat + flat), (3, None)], "page_id bigint, html string")
    got = [(r.page_id, r.title, r.company, r.location, r.url) for r in pages.search_cards(df).orderBy("page_id").collect()]
    assert got == [(1, "First job", "Acme", "Pune", "https://www.google.com/r"), (2, "Flat", "Co", None, "")]
