"""Hosts of many different pages have a guide like any other."""

import json

from peakweave.llm import wrappers

NOTE = "<div class=top><p>This text is on every page of the site.</p></div>"


def _page(i, n):
    """A story of n parts whose tags differ by page and part."""
    return f"<body>{NOTE}<div class=story>" + "".join(f"<div class=p{i}x{k}><p>Part {k} of page {i}, all its own.</p></div>" for k in range(n)) + "</div></body>"


def _text(i, n):
    return "\n".join(f"Part {k} of page {i}, all its own." for k in range(n))


def _wrapper(html):
    stream, texts = wrappers.read(html)
    return json.dumps(wrappers.of_page(wrappers.group(stream), texts), separators=(",", ":"))


def test_wrapper_of_more_than_300_tokens():
    folded = wrappers.fold([_wrapper(_page(i, 20)) for i in range(12)])
    assert len(json.loads(folded)) > 300
    assert all(wrappers.extract(_page(i, 20), wrappers.guide(folded)) == _text(i, 20) for i in range(12))


def test_guide_of_a_page_alone():
    html = "<body><article><p>Text.</p></article><p>Other.</p></body>"
    assert wrappers.extract(html, wrappers.guide(_wrapper(html))) == "Text." and wrappers.extract(html, None) == "Text.\nOther."
