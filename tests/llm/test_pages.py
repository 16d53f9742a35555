"""Main text of pages."""

import pytest

from peakweave.llm import wrappers


def page(body, kind="article", tail="</body></html>"):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a='</p><article>';</script></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><{kind}>{body}</{kind}><aside>Aside</aside><section id=comments><p>Nice!</p></section><form><input name=q>Search</form><!-- ad --><div class=\"ad\">Buy</div><footer>&copy; 2020</footer>{tail}"


def alone(html):
    """A page's text by its own wrapper."""
    return wrappers.extract(html, wrappers.guide(wrappers.page_wrapper(html)))


def test_parts_that_go():
    text = "<h1>Head &amp; line</h1><p>First  <b>bold</b>\n text&nbsp;here.<br>More.</p><ul><li>x<li>y</ul><div class=share>Tweet</div><p>Last &#233; &lt;tag&gt;"
    assert alone(page(text)) == "Head & line\nFirst bold text here. More.\nx\ny\nLast é <tag>"


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<!-- open", "<script>x", "<a href='", "<b></i></p>", "&amp"])
def test_broken_pages(html):
    assert alone(html) in ("", "&", "<")


def test_cut_off_page():
    assert alone("<html><body><nav>Menu</nav><article><p>One</p><p>Two <b>three</b> <a hre") == "One\nTwo three"


def test_paragraphs_that_say_what_they_are():
    html = page("<p>Text.</p><p class=advert>Buy this.<p>More text.</p><h2 class='newsletter-title'>Sign up</h2><p>End.")
    assert alone(html) == "Text.\nMore text.\nEnd."


def test_page_without_article():
    html = "<body><div><a href=1>One</a> <a href=2>Two</a></div><div><p>Real text with a <a href=3>link</a> inside.</p></div><div class=sidebar><p>Side</p></div></body>"
    assert alone(html) == "Real text with a link inside."


def test_grouping_and_alignment():
    a = wrappers.group(wrappers.read("<ul><li>a</li><li>b</li><li>c</li></ul><p>x</p>")[0])
    assert [x.key for x in a] == ["<ul>", "(<li>#</li>)+", "</ul>", "<p>", "#", "</p>"]

    def of(html):
        stream, texts = wrappers.read(html)
        return wrappers.of_page(wrappers.group(stream), texts)

    both = wrappers.align(of("<ul><li>a</li><li>b</li></ul><p>x</p>"), of("<ul><li>a</li></ul><h2>t</h2><p>x</p>"))
    assert wrappers.expression(both) == "<ul>(<li>#</li>)+</ul>(<h2>)?(#)?(</h2>)?<p>#</p>"


def test_constant_slots_go_and_hosts_differ(spark):
    note = "<div class=top><p>This notice is on every page of the site.</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{note}<div class=story><p>Text number {i} of this host, all its own.</p></div></body>") for i in range(6)]
    rows += [(10, "http://b.example/", "<body><p>Only page.</p></body>"), (11, None, "<p>No host</p>"), (12, "http://a.example/n", None), (12, "http://a.example/n", None)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id bigint, url string, html string, row string, wrapper int")
    found, name = wrappers.main_text(df)
    assert found.columns[:-1] == df.columns
    got = [(r.page_id, r[name]) for r in found.collect()]
    assert len(got) == 10
    text = dict(got)
    assert text[10] == "Only page." and text[11] == "No host" and text[12] == ""
    assert all(text[i] == f"Text number {i} of this host, all its own." for i in range(6))


def test_fold_is_the_same_in_any_order():
    import itertools
    import json

    def of(html):
        stream, texts = wrappers.read(html)
        return json.dumps(wrappers.of_page(wrappers.group(stream), texts), separators=(",", ":"))

    pages = [of("<p>a</p>"), of("<p>a</p><p>b</p>"), of("<h1>t</h1><p>a</p>")]
    assert len({wrappers.fold(list(p)) for p in itertools.permutations(pages)}) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert wrappers.main_text(df)[0].count() == 0


MENU = "<div class=k1><a href=/a>Start page</a><a href=/b>All stories</a></div>"


def _plain(i, notes=("Read our terms again.", "Terms have changed here.")):
    """A page without a tag or a name that says what is main text."""
    own = "".join(f"<p>Story {i} paragraph {k}, which no other page of the site has.</p>" for k in range(1 + i % 3))
    return f"<body>{MENU}<div class=k2>Everybody is greeted on every page.</div><div class=k3>{notes[i % 2]}</div><div class=k4>{own}</div><div class=k5>Printed by the press of the town.</div></body>"


def _story(i):
    return "\n".join(f"Story {i} paragraph {k}, which no other page of the site has." for k in range(1 + i % 3))


def test_host_without_semantic_tags():
    """Only the alignment tells template from text; without wrappers all of it stays."""
    pages = [_plain(i) for i in range(24)]
    guided = wrappers.guide(wrappers.fold([wrappers.page_wrapper(p) for p in pages]))
    assert [wrappers.extract(p, guided) for p in pages] == [_story(i) for i in range(24)]
    assert all("Everybody" in wrappers.extract(p, None) and "Start page" in wrappers.extract(p, None) for p in pages)


def test_host_that_names_its_text_like_a_sidebar():
    """Where names leave no main text, what varies is the text."""
    pages = [_plain(i).replace("k4", "sidebar-widget") for i in range(24)]
    assert alone(pages[0]).find("Story") < 0
    guided = wrappers.guide(wrappers.fold([wrappers.page_wrapper(p.replace("k2", "notice").replace("k3", "ad").replace("k5", "footer")) for p in pages]))
    got = [wrappers.extract(p.replace("k2", "notice").replace("k3", "ad").replace("k5", "footer"), guided) for p in pages]
    assert got == [_story(i) for i in range(24)]


def test_content_of_formulas_and_objects():
    assert alone("<p>Area is <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> or <object data=a>fallback</object> here<script>x</script>.</p>") == "Area is x=12 or fallback here."
    assert alone("<p>One <select><option>a</select> two<svg><text>no</text></svg>.</p>") == "One two."
    assert alone("<p>One <select> two <video> three.</p>") == "One two three."


def test_very_long_pages():
    """A megabyte of paragraphs, of nested and of broken markup, in seconds each."""
    import time

    long = "<body>" + "".join(f"<div class=c{i % 97}><p>Paragraph {i} of a very long page.</p></div>" for i in range(14_000)) + "</body>"
    flat = "<body>" + "".join(f"<p>Paragraph {i}.</p>" for i in range(40_000)) + "</body>"
    began = time.time()
    assert len(alone(long).split("\n")) == 14_000 and len(alone(flat).split("\n")) == 40_000
    broken = ["<a \"" * 250_000, "<a title='x>" * 80_000, "<p <" * 250_000, "<div>" * 200_000, "<select>" * 120_000, "<!" * 500_000, "x<" * 500_000]
    for html in broken:
        alone(html)
    assert time.time() - began < 120


def test_quotes_that_never_close():
    assert alone("<p>One</p><p class=\"x>Two</p><p>Three</p>") == "One\nTwo\nThree"


def test_matches_are_common_subsequences():
    import random

    rng = random.Random(5)
    for _ in range(300):
        a, b = (["".join(rng.choice("abcd")) for _ in range(rng.randint(0, 12))] for _ in "ab")
        got = wrappers.matches(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert got or not set(a) & set(b)
    assert wrappers.matches(list("abc"), list("xabyc")) == [(0, 1), (1, 2), (2, 4)]


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "http://c.example/1", _plain(1), "a", 5, "g")] * 2 + [(2, "http://c.example/2", _plain(2), "b", 6, "h")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, salt int, main_text string")
    found, name = wrappers.main_text(df)
    got = found.collect()
    assert found.columns[:-1] == df.columns and name != "main_text" and sorted(r.page_id for r in got) == [1, 1, 2]
    assert all(_story(r.page_id) in r[name] for r in got)


def test_large_hosts_are_salted(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "PAGES", 3)
    for most in (100_000, 0):
        monkeypatch.setattr(wrappers, "BROADCAST", most)
        df = spark.createDataFrame([(i, f"http://d.example/{i}", _plain(i)) for i in range(20)], "page_id bigint, url string, html string").repartition(7)
        found, name = wrappers.main_text(df)
        assert {r.page_id: r[name] for r in found.collect()} == {i: _story(i) for i in range(20)}


def test_advert_inside_one_page_of_a_host():
    """A block that says what it is goes, also where its paragraph meets the host's slot of main text."""
    pages = [page("".join(f"<p>Story {i} paragraph {k}.</p>" for k in range(2 + i % 3))) for i in range(12)]
    odd = page("<p>Story 99 paragraph 0.</p><div class=advert><p>Buy this now.</p></div><p>Story 99 paragraph 1.</p><p>Story 99 paragraph 2.</p>")
    guided = wrappers.guide(wrappers.fold([wrappers.page_wrapper(p) for p in [*pages, odd]]))
    assert wrappers.extract(odd, guided) == "Story 99 paragraph 0.\nStory 99 paragraph 1.\nStory 99 paragraph 2."
    assert wrappers.extract(pages[1], guided) == "Story 1 paragraph 0.\nStory 1 paragraph 1.\nStory 1 paragraph 2."
