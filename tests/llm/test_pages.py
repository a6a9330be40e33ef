import html as entities
import random
import time
from html.parser import HTMLParser

import pytest

from flowsentry.llm import common, pages

ARTICLE = "<article><h1>Head &amp; line</h1><p>First  para\n with <b>bold</b>text &eacute;&#233;.<p>Second <a href='/x'>link</a>.</article>"
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body>"
    "<header>Site</header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
    f"<!-- ad --><div class=\"ad\">Buy this now, it is a very long advert text for you</div>{ARTICLE}"
    "<div id='comments'><p>First! A reader comment that goes on and on.</p></div><form><p>Mail</p><input></form>"
    "<aside>Side</aside><footer>&copy; x</footer></body></html>"
)
TEXT = "Head & line\nFirst para with boldtext éé.\nSecond link."


def main_text(html):
    containers, blocks = pages.parse(html)
    best = pages.best_path(containers, blocks)
    return pages.text_under(containers, blocks, best[0]) if best else ""


def test_boilerplate_goes():
    assert main_text(PAGE) == TEXT
    inside = PAGE.replace("</h1>", "</h1><div class='share-buttons'>Share</div><p hidden>secret</p><p style='display: none'>x</p>")
    assert main_text(inside) == TEXT


def test_odd_markup():
    assert main_text("<p>a<p>b<ul><li>c<li>d</ul>e") == "a\nb\nc\nd\ne"
    assert main_text("just text & more <") == "just text & more <"
    assert main_text("<div>unclosed <b>bold<p>next") == "unclosed bold\nnext"
    assert main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert main_text("<p>x</section></p><p title='>'>y<br>z</p>") == "x\ny z"
    assert main_text("<script>never closed <p>x") == ""
    assert main_text("<p>a&nbsp;&lt;b&gt; &unknown; &am</p>") == "a <b> &unknown; &am"
    assert main_text("<p>" + "long " * 100_000 + "</p>") == ("long " * 100_000).strip()
    assert main_text("<div " + "a" * 1000 + "='") != "x"


def test_host_consensus(spark):
    common.prepare(spark)
    body = "<html><body><div class='post-12'><p>{}</p></div><div class='archive'><p>{}</p></div></body></html>"
    rows = [(i, "http://Blog.example.org/%d" % i, body.format("story text number %d" % i, "old")) for i in range(9)]
    rows.append((9, "https://blog.example.org:80/9", body.format("short", "a longer text, but in the archive of this host")))
    rows += [(10, None, PAGE), (11, "nonsense", None), (12, "http://h/", ""), (13, "http://blog.example.org/", "<p>no such path</p>")]
    rows += [(0, "http://Blog.example.org/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "h", "w", "t") for r in rows], "page_id long, url string, html string, host string, winner string, text string")
    for limit in (50_000, 0):
        got = {}
        for r in pages.extract(df.repartition(3), broadcast_hosts=limit).collect():
            got.setdefault(r["page_id"], []).append(r)
        assert len(got) == 14 and len(got[0]) == 2
        assert all(got[i][0]["text"] == f"story text number {i}" for i in range(9))
        assert got[9][0]["text"] == "short" and got[9][0]["path"] == ">html>body>div.post-0"
        assert got[10][0]["text"] == TEXT and got[10][0]["host"] == ""
        assert got[11][0]["text"] == got[12][0]["text"] == "" and got[11][0]["path"] is None
        assert got[13][0]["text"] == "no such path"
    assert pages.extract(df.limit(0)).collect() == []


LONG = "some words of the story " * 20


def test_headline_and_parts_beside_the_main_container():
    long = LONG.strip()
    assert main_text(f"<article><h1>T</h1><div class=content><p>{LONG}</div></article>") == "T\n" + long
    assert main_text(f"<div class=wrap><h1>T</h1><div class=x><p>{LONG}</div><div class=y>more</div></div>") == f"T\n{long}\nmore"
    parts = f"<div class=post><div class=intro><p>{LONG}</div><div class=body>" + f"<p>{LONG}" * 6 + "</div></div>"
    assert main_text(parts) == "\n".join([long] * 7)
    # A headline far away, in a container with much else, does not pull that in.
    far = f"<body><div><h1>Site</h1>{LONG}</div><div class=x><p>{LONG * 4}</div></div>"
    assert main_text(far) == (LONG * 4).strip()


def test_names_with_a_word_of_noise():
    long = LONG.strip()
    for name in ("class='content has-sidebar'", "class='post with-comments'", "id='main-search'", "class='entry-header-wrapper'"):
        assert main_text(f"<div {name}><p>{LONG}</div><div class='cookie-notice'>{LONG * 3}</div>") == long
    # Smaller than the rest, such an element is noise; comments always are.
    assert main_text(f"<div class=x><p>{LONG * 2}</div><div class='page-sidebar'>{LONG}</div>") == (LONG * 2).strip()
    assert main_text(f"<div class='post-comments'>{LONG}</div><p>short") == "short"
    assert main_text(f"<div class='comments'>{LONG}</div>") == ""


@pytest.mark.parametrize(
    "html, length",
    [("<div>" * 40_000 + "x", 1), ("<a " * 40_000, 119_999), ("<a '>" * 40_001, None), ("<svg/>" * 40_000 + "x", 1), ("<!--" * 40_000, 0),
     ("<div>" * 40_000 + "</p>" * 40_000 + "x", 1), ("<p>" * 40_000 + "</div>" * 40_000 + "x", 1), ("<" * 100_000, 100_000),
     ("&#" + "9" * 5_000 + ";&#0000000065;", 2), ("<ul><li>" * 20_000 + "x", 1)],
)
def test_hostile_pages_take_linear_time(html, length):
    start = time.process_time()
    text = main_text(html)
    assert length is None or len(text) == length
    assert time.process_time() - start < 3  # quadratic ones take minutes


class Plain(HTMLParser):
    """Text blocks of well-formed markup, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.dropped = [], "", []

    def close_block(self):
        if words := self.text.split():
            self.blocks.append(" ".join(words))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in pages.BLOCKS:
            self.close_block()
        if tag == "br":
            self.text += " "
        elif tag not in pages.VOID:
            noise = any(w in pages.NOISE for _, v in attrs for w in v.split("-"))
            self.dropped.append(tag in pages.DROPPED | pages.RAW or noise or (self.dropped[-1] if self.dropped else False))

    def handle_endtag(self, tag):
        if tag in pages.BLOCKS:
            self.close_block()
        self.dropped.pop()

    def handle_data(self, data):
        if not (self.dropped and self.dropped[-1]):
            self.text += data


def random_markup(rnd, depth):
    parts = []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.random()
        if kind < 0.4 or depth == 0:
            parts.append(entities.escape(rnd.choice(["a & b", " x\n y ", "<", "é&eacute", "word", "'q'", ' "', "1 > 0"])))
        elif kind < 0.5:
            parts.append(rnd.choice(["<br>", "<!-- <p>no</p> -->", "<img src='x>y'>", "<script>var a = '<p>';</script>"]))
        else:
            tag = rnd.choice("div section article span b a ul blockquote nav footer form em".split())
            name = rnd.choice(["", "", "", " class='ad'", ' id="share-buttons"', " class=plain-1", " data-x='a>b'"])
            parts.append(f"<{tag}{name}>{random_markup(rnd, depth - 1)}</{tag}>")
    return rnd.choice(["", " "]).join(parts)


@pytest.mark.parametrize("seed", range(150))
def test_blocks_equal_those_of_a_plain_parser(seed):
    markup = random_markup(random.Random(seed), 5)
    plain = Plain()
    plain.feed(markup)
    plain.close()
    plain.close_block()
    containers, blocks = pages.parse(markup)
    assert [b.text for b in blocks] == plain.blocks
    assert pages.text_under(containers, blocks, "") == "\n".join(plain.blocks)
    # The best path by the definition: scores summed by whole path, children by recursion.
    def path(i):
        return path(containers[i].parent) + ">" + containers[i].step if i else ""

    def score(i):
        return sum(max(0, len(b.text) - 2 * b.link_chars) for b in blocks if b.container == i) + sum(
            (pages.DECAY if containers[i].tag else pages.DECAY_TO_PAGE) * score(k) for k in range(1, len(containers)) if containers[k].parent == i
        )

    by_path = {}
    for i, c in enumerate(containers):
        by_path[path(i)] = by_path.get(path(i), 0) + score(i) * (1.5 if c.tag in ("article", "main") else 1)
    best = pages.best_path(containers, blocks)
    assert (best is None) == (max(by_path.values()) <= 0)
    if best:
        assert by_path[best[0]] == pytest.approx(best[1]) == max(by_path.values())
