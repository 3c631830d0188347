"""Branches that differ among many, and below the fourth segment."""

from pathloom.llm import urls

# 5


def test_bad_section_among_thirteen(spark):
    pages = [(100 * s + i, f"http://h.example/{w}/p{100 * s + i}") for s, w in enumerate("abcdefghijklm") for i in range(20)]
    labels = [(i, int(i >= 100), 0) for i, _ in pages]
    got = urls.url_templates(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.page_id < 100, r.template, r.n_pages, r.rejected) for r in got} == {(True, "h.example/a/p{n}", 20, True), (False, "h.example/*/p{n}", 240, False)}


def test_one_bad_page_each_of_many_keeps_the_wildcard(spark):
    pages = [(i, f"http://h.example/{chr(97 + i // 26)}{chr(97 + i % 26)}/{i}") for i in range(200)]
    labels = [(i, int(i % 20 > 0), 0) for i in range(200)]
    got = urls.url_templates(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.template for r in got} == {"h.example/*/{n}"}


def test_branches_of_six_segments(spark):
    pages = [(i, f"http://h.example/a/b/c/d/{'bad' if i < 40 else 'good'}/{i}") for i in range(80)] + [(100 + i, f"http://h.example/a/b/c/d/e/{'x' if i % 4 else 'y'}/{100 + i}") for i in range(80)]
    labels = [(i, int(i >= 40), 0) for i in range(80)] + [(100 + i, int(i % 4 > 0), 0) for i in range(80)]
    got = urls.url_templates(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    bad = {i for i, q, _ in labels if not q}
    assert len(got) == len(pages) and {r.page_id for r in got if r.rejected} == bad
    assert {r.template for r in got if r.page_id < 40} == {"h.example/a/b/c/d/bad/**"} and {r.n_pages for r in got if r.page_id in bad} == {40, 20}
