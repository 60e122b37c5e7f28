"""Operators on pages and vectors against plain restatements, and their defined cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from retailweave.llm import embed_forest, html_blocks, url_templates
from retailweave.llm.html_labels import labelled_pages
from retailweave.llm.url_templates import Rule

VECTOR = "vec_id long, embedding array<float>, label int"


# --- vectors ---------------------------------------------------------------------------------------------------------


def clustered(seed=0, dim=32):
    """Lone vectors, tight groups, and chains of vectors whose neighbours lie around the threshold."""
    rng = np.random.default_rng(seed)
    out = [*rng.standard_normal((300, dim))]
    for size, spread in ((200, 0.02), (40, 0.05), (60, 0.06), (30, 0.3), (2, 0.0), (5, 0.0)):
        centre = rng.standard_normal(dim)
        out += [centre * rng.uniform(0.5, 2) + rng.standard_normal(dim) * spread for _ in range(size)]
    point = rng.standard_normal(dim)
    for _ in range(40):
        point = point + rng.standard_normal(dim) * 0.35
        out.append(point)
    x = np.array(out, np.float32)
    return x[rng.permutation(len(x))]


def brute(x):
    x = x.astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    owner = np.arange(len(x))
    while True:
        least = np.array([min(owner[i], owner[near[i]].min(initial=i)) for i in range(len(x))])
        if (least == owner).all():
            return near, owner
        owner = least


@pytest.mark.parametrize("leaf_size", [64, 2000])
def test_forest_finds_the_links(spark, leaf_size):
    x = clustered()
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    found = embed_forest.near_vectors(spark.createDataFrame(rows, VECTOR), leaf_size=leaf_size).orderBy("id").collect()
    near, owner = brute(x)
    degree = near.sum(axis=1)
    got = np.array([r["n_links"] for r in found])
    assert [r["id"] for r in found] == list(range(len(x)))
    assert (got <= degree).all()
    assert got.sum() >= 0.97 * degree.sum()
    if leaf_size == 2000:
        assert (got == degree).all()
        assert [r["component_id"] for r in found] == owner.tolist()
    assert all(r["kept"] == (r["component_id"] == r["id"]) for r in found)


def test_forest_finds_the_links_of_a_dense_group(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)

    def aside(v, cosine):
        other = rng.standard_normal(64)
        other -= (other @ v) * v
        return v * cosine + other / np.linalg.norm(other) * (1 - cosine**2) ** 0.5

    # mutual cosine 0.8, each tenth one with a partner just above the threshold
    group = [aside(centre, 0.8**0.5) for _ in range(4000)]
    x = np.array(group + [aside(v, 0.905) for v in group[::10]], np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found = embed_forest.near_vectors(spark.createDataFrame(rows, VECTOR), leaf_size=128).collect()
    want = brute(x)[0].sum()
    got = sum(r["n_links"] for r in found)
    assert want >= 800 and 0.97 * want <= got <= want


def test_vectors_defined_cases(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0),
        (7, [float("inf"), 1.0], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [0.0, 1.0], 0),
        (10, [0.0, 3e38], None), (11, [1e-38, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, VECTOR).selectExpr("*", "'x' AS n_links", "1 AS component_id")
    found = sorted(map(tuple, embed_forest.near_vectors(table).collect()), key=str)
    want = [
        (1, 2, 1, True), (2, 2, 1, False), (11, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
        (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (9, 1, 9, True), (None, 1, 10, False), (10, 1, 10, True),
    ]
    assert found == sorted(want, key=str)
    assert embed_forest.near_vectors(table.limit(0)).count() == 0


# --- pages -----------------------------------------------------------------------------------------------------------


def test_tree_knows_its_own_table():
    tree = html_blocks.trained_tree()
    wrong = total = 0
    for page, wanted in labelled_pages():
        got = html_blocks.is_main(tree, html_blocks.features(html_blocks.blocks(page)))
        wrong += int((got != np.array(wanted)).sum())
        total += len(wanted)
    assert total > 80 and wrong <= 0.03 * total


UNSEEN = """<!doctype html><html><head><title>T</title><script>if (a < b) { x = "<p>no</p>"; }</script></head>
<body class="has-sidebar comments-open"><div id="nav-menu"><ul><li><a href="/">Start</a><li><a href="/b">B</a></ul></div>
<form action="/s"><input name=q><p>Search the whole site for words</p></form>
<div id="content"><h1>On   the&nbsp;moor</h1><!-- <p>hidden</p> -->
<p>Fog &amp; wind, 3 &lt; 4, caf&eacute; &#8212; it<br>goes on <b>like</b> <a href="x">this</a> for hours and hours.
<p>Short one.</p><div class="advert">Buy our tea now, the best tea of the whole wide world, says our own test.</div>
<p>And a last paragraph that says where the path ends and how to get back home from there by bus.</p></div>
<div class="comments"><p>I was there last year, and it was not as bad as all that, I would go again at once.</p></div>
<style>p{}</style><footer><p>Made by us for you with love since nineteen hundred and eighty four.</p></footer>"""


def test_unseen_page():
    text = html_blocks.main_text(UNSEEN, html_blocks.trained_tree())
    assert text.split("\n") == [
        "On the moor",
        "Fog & wind, 3 < 4, café — it goes on like this for hours and hours.",
        "Short one.",
        "And a last paragraph that says where the path ends and how to get back home from there by bus.",
    ]


def test_article_of_the_given_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    for row in html_blocks.extract_main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert row["text"] == "\n".join(p for p in parts if p)


@pytest.mark.parametrize(
    "page", [None, "", "   ", "<", "<p", "<p>", "</div></div>", "<script>x", "<!-- x", "<a href='x>y", "&#xFFFFFFF;", "<" * 5000]
)
def test_broken_pages(page):
    assert isinstance(html_blocks.main_text(page, html_blocks.trained_tree()), str)


def test_pages_defined_cases(spark):
    rows = [(1, "u", "<p>" + "word " * 100_000), (2, None, None), (2, None, None), (None, "", ""), (3, "u", "<article><p>Hi.")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_blocks.extract_main_text(table).collect()
    assert sorted(len(r["text"]) for r in found) == [0, 0, 0, 3, 499_999]
    assert html_blocks.extract_main_text(table.limit(0)).count() == 0
    assert html_blocks.extract_main_text(table.withColumnRenamed("url", "text")).columns == ["page_id", "html", "text"]


# --- urls ------------------------------------------------------------------------------------------------------------

RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = re.match(r"[^?#]*", rest[end:])[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max((r.name for r in fits), key=len, default=None)


def test_hosts_paths_and_rules(spark, sf):
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    urls += [
        None, "", "no scheme", "http://", "HTTP://NET/x", "https://A.Example.NET/en/1?x=/y#z", "x://example.net/en", "x://net",
        "x://net?/en/", "x://fr.org/fr/", "x://org/fr/a b\nc", "x://badexample.com/de/1", "x://example.com/de/", "x://É.com/de/",
        "a://b://c/d", "x://b.net#/", "x:///de/", "http://example.net/en/../x",
    ]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    judged = {r["page_id"]: r["judged"] for r in url_templates.judge_urls(table, RULES).collect()}
    verdicts = {r.name: r.verdict for r in RULES}
    for i, url in enumerate(urls):
        host, path, rule = plain_rule(url)
        assert (judged[i]["host"], judged[i]["path"], judged[i]["rule"]) == (host, path, rule), url
        assert judged[i]["verdict"] == verdicts[rule] if rule else judged[i]["verdict"] in ("allow", "block")


def test_templates_learn_bad_branches(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        rows.append((f"/shop/item-{i}/{i}.html", 0))
        rows.append((f"/win/{rng.randrange(10**9)}", 1))
        rows.append((f"/tag/{rng.choice('abcdefgh')}/{i}", 0))
        rows.append((f"/win/{rng.randrange(10**9)}", None))
        rows.append((f"/news/{2000 + i % 20}-01-02/{i}", None))
    urls = spark.createDataFrame([("h", p, y) for p, y in rows], "host string, path string, label int")
    found = {r["template"]: r["verdict"] for r in url_templates.judge_templates(urls).collect()}
    assert found["/win/<n>"] == "block"
    assert {v for t, v in found.items() if not t.startswith("/win")} == {"allow"}
    # the eight tags are alike, so they are one branch
    assert any(t.startswith("/tag/<*>") for t in found) and not any(t.startswith("/tag/a") for t in found)


def test_labels_carry_over_by_shape_and_only_by_evidence(spark):
    rows = [("h", f"/{branch}/{i}.html", 1) for branch in "abcdef" for i in range(50)]
    rows += [("h", f"/{branch}/{i}.html", None) for branch in "uvw" for i in range(50)]  # alike, without labels
    rows += [("h", f"/other/page/{i}/x", None) for i in range(20)]  # another shape
    rows += [("elsewhere", f"/{branch}/{i}.html", None) for branch in "ab" for i in range(50)]
    urls = spark.createDataFrame(rows, "host string, path string, label int")
    found = {(r["host"], r["raw"][0]): r for r in url_templates.judge_templates(urls).collect()}
    assert {found["h", b]["verdict"] for b in "abcdefuvw"} == {"block"}
    assert found["h", "other"]["verdict"] == "allow"
    assert {(found["elsewhere", b]["verdict"], found["elsewhere", b]["purity"]) for b in "ab"} == {("allow", 0.5)}


def test_urls_defined_cases(spark):
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (None, "x"), (3, "http://a.com/" + "seg/" * 5000)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "'v' AS verdict", "2 AS judged", "3 AS __u")
    assert url_templates.judge_urls(table, RULES).count() == 5
    assert url_templates.judge_urls(table, ()).where("judged.verdict <> 'allow'").count() == 0
    assert url_templates.judge_urls(table.limit(0), RULES).count() == 0
