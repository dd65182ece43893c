"""The reader of plain mark-up against the full one."""

import random

import pytest

from kvartal.functions import html as h

PIECES = [
    "<div class='a-card x'>", "</div>", '<a href="/a/show/1?b=1&pos=2#x">', "</a>", "<br>", "<br />", "<img src=p.jpg>", "<P>", "</p >",
    "a &amp; b &nbsp;x", "&copy", "<!-- <a href='/a/show/1'>no</a> -->", "<!DOCTYPE html>", "<p class=\"a-card__subtitle\" class='y'>S</p>",
    "<script>if (a < b) {\"x\": '&amp;'}</script>", "<style>p > a {}</style>", "<title>T &amp; t</title>", "<TITLE>u</TITLE>", "\n\n", "<input disabled>",
    "<b data-test='price' id=q1>5 000</b>", "<dl><dt>A</dt><dd>1</dd></dl>", "<template>t</template>", "</nowhere>", "<h1/>", "<br/>",
]
ODD = [
    "<", "a < b", "<a href='&amp;x'>", "<a href=x/y>", "<p a='1'b='2'>", "<!-- a -- b -->", "<!-->", "<![CDATA[x]]>", "<?pi x?>", "</ x>", "<p", "<p class='",
    "<script><!-- </script>", "<script>x", "<script/>", "<title><b>x</b></title>", "<textarea><p></textarea>", "<a b = 'c'>", "<svg:x>", "<p\x0ca>", "&am",
    "<iframe><p></iframe>", "<noscript><p>x</p></noscript>", "\0", "</p x='1'>", "<p =a>", "</script>", "<p a='x>y'>", "<script>a</script >b", "<плюс>",
]


def shape(html):
    root, nodes = h.read(html)
    at = {id(n): i for i, n in enumerate(nodes)}

    def told(node):
        inside = [c if isinstance(c, str) else at[id(c)] for c in node.children]
        return node.tag, node.attrs, node.classes, node.subtitles, inside, at.get(id(node.parent))

    return [told(n) for n in (root, *nodes)]


@pytest.mark.parametrize("odd", [0.0, 0.1])
def test_plain_reader_equals_the_full_one(monkeypatch, odd):
    rnd = random.Random(5)
    pages = ["".join(rnd.choice(ODD if rnd.random() < odd else PIECES) for _ in range(rnd.randint(1, 14))) for _ in range(4000)] + ODD + [""]
    fast, plain = [shape(p) for p in pages], [h._read_plain(p) is not None for p in pages]
    assert all(plain[:4000]) if not odd else any(plain[:4000])
    monkeypatch.setattr(h, "_read_plain", lambda html: None)
    for page, got in zip(pages, fast, strict=True):
        assert got == shape(page), page
