"""Extraction: story that names and shapes must not take, and template counts against counting by hand."""

from collections import Counter

from kerbline.llm import html_extraction as he


def test_story_stays():
    assert he.main_text("<article><p class='social-history'>kept?</p></article>") == "kept?"
    assert he.main_text("<main><p>Short story</p><article>a long teaser about some other thing, a long teaser</article></main>").startswith("Short story")
    assert he.main_text("<body><header><h1>Site</h1></header><div><header><h1>Title</h1></header><p>story</p></div></body>") == "Title\n\nstory"
    assert he.main_text("<article><p>story</p><div class='user-comments'><article class='comment'>first!</article></div></article>") == "story"


def page(i, box):
    return f"<html><body><div class='w{'x' * (i % 3)}'>{box}</div><article><h1>T{i}</h1><div class='z'><span>{box}</span></div><p>Story {i} of its own words {i * 7}.</p></article></body></html>"


def test_boxes_inside_articles_go_by_counts_alone(spark, monkeypatch):
    """Boxes without telling names, inside and outside of articles: roles keep them, counts take them."""
    rows = [(i, "http://a.example/x", page(i, "Read our other pieces")) for i in range(30)] + [(100, "http://b.example/", page(100, "Read our other pieces")), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    texts = lambda **options: {r["page_id"]: r for r in he.extract(pages, **options).collect()}
    kept, got = texts(remove=False), texts(tell=True)
    assert all("Read our" in kept[i]["text"] for i in range(30)) and not any("Read our" in got[i]["text"] for i in range(30))
    assert all(got[i]["text"] == f"T{i}\n\nStory {i} of its own words {i * 7}." for i in range(30))
    assert all(got[i]["n_template"] == 2 * len("Read our other pieces") and got[i]["n_role"] == 0 for i in range(30))
    assert "Read our" in got[100]["text"] and got[101]["text"] == "" and got[101]["n_role"] == 0
    # the elements that recur, counted by hand from the pages' trees
    seen = Counter(key for _, _, html in rows[:30] for key in {own for _, kind, own, _ in he.Page(html).candidates() if kind < 2})
    found = {r["key"] for r in he.templates(he.with_host(pages)).where("host = 'a.example'").collect()}
    assert {k for k, n in seen.items() if n >= 10} <= found and not {k for k, n in seen.items() if n == 1} & found


def test_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, `a.b` int, host string"
    assert he.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://a/x", "<article><p>one</p></article>", 1, "h")] * 5
    assert [(r["text"], r["a.b"], r["host"]) for r in he.extract(spark.createDataFrame(rows, schema)).collect()] == [("one", 1, "h")] * 5
