"""Plain pages read without a tree, against the tree."""

import random

import pytest

from kvartal.functions import html as h
from tests.test_html import ODD, PIECES

FIELDS = [
    '<div class="a-card offer">', "<h2>H</h2>", "<h3> x", "</h3>", '<div class="offer__info-title">L</div>', "<dl>", "</dl>", "<dt>A</dt>",
    '<b class="offer__advert-short-info">v</b>', "<dd>1<i>2</i></dd>", '<div class="offer__description">', '<span class="text">t\n u</span>',
    '<time datetime="2000">', "<time>", "</time>", "<h1 class=offer__title></h1>", "<h1>x</h1>", "<i data-test=offer-price>5</i>",
    '<b data-test="published-at" datetime=x>', '<div class="a-card__price">9</div>', '<a href="/a/show/2">two</a>', '<p class="a-card__title">',
    '<p class="a-card__subtitle">', '<script class="text">x</script>', '<div class="offer__info"> </div>', "01.02.2003", "&#160;",
    '<p class="js-description">d<br>e</p>', '<template class="a-card"><p class="a-card__title">z</p></template>',
]


@pytest.mark.parametrize("odd", [0.0, 0.05])
def test_flat_pages_equal_the_tree(monkeypatch, odd):
    rnd = random.Random(7)
    pages = ["".join(rnd.choice(ODD if rnd.random() < odd else PIECES + FIELDS) for _ in range(rnd.randint(1, 25))) for _ in range(4000)]
    assert sum(h.scan(p) is not None for p in pages) > 1000
    got = [(h.cards(p), h.detail(p)) for p in pages]
    monkeypatch.setattr(h, "scan", lambda html: None)
    monkeypatch.setattr(h, "_read_plain", lambda html: None)
    for page, told in zip(pages, got, strict=True):
        assert told == (h.cards(page), h.detail(page)), page


def test_plain_pages_need_no_tree(monkeypatch):
    def refuse(html):
        raise AssertionError("a tree was built")

    monkeypatch.setattr(h, "read", refuse)
    card = '<article class="a-card"><a href="/a/show/7?a=1&b=2#x"><img src=\'p.jpg\'></a><p class="a-card__title">T&amp;t</p></article>'
    assert [c["title"] for c in h.cards(f"<!-- <a href='/a/show/1'>no</a> -->{card}")] == ["T&t"]
    assert h.detail("<dl><dt>A</dt><dd>1</dd></dl><script>if (a < b) {}</script>")["params"] == [{"label": "a", "value": "1"}]
