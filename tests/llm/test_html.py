import random
import time
import tracemalloc
from html.parser import HTMLParser

from spendkit.llm import html_extract


class Article(HTMLParser):
    """What stands in <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "a", "i", "em"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag not in ("b", "a", "i", "em"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def one(source):
    page = html_extract.parse(source)
    html_extract.score(page)
    return html_extract.text_below(page, html_extract.best(page))


def test_pages_of_the_test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {}
    for r in pages.collect():
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        want[r["page_id"]] = parser.text()
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == want


LONG = "This paragraph has enough words to count as the text of an article, and then some more of them. "


def test_boilerplate_goes():
    source = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="with-sidebar no-js">
    <header><h1>Site name</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
    <div id="wrap"><aside>Side</aside><div class="left-sidebar"><p>{LONG}</p></div>
    <div class="post-body"><header><h2>Title &amp; more</h2></header><p>{LONG}<b>bold</b>text&nbsp;here<p>2 &lt; 3 &#8364; {LONG}
    <div class="ad-slot">BUY</div><ul><li>one<li>two</ul><form><input>Send</form><script>if (a<b) "</p>"</script></div>
    <section id="comments"><div class="comment"><p>{LONG * 9}</p></div></section></div>
    <!-- {LONG} --><div style="display: none">{LONG}</div><footer>&copy; me</footer></body></html>"""
    assert one(source) == "\n".join(["Title & more", f"{LONG}boldtext here", f"2 < 3 € {LONG}".strip(), "one", "two"])


def test_sloppy_markup():
    assert one("") == one("<p></p>") == one("<!-- x") == one("<script>x") == ""
    assert one("just text") == "just text"
    assert one("<p>a < b and c > d<p>next &amp;amp; &notanentity;") == "a < b and c > d\nnext &amp; ¬anentity;"
    assert one(f"<div><p>{LONG}</div></div></span><p class='x>y'>{LONG}<br>line</p>").count("\n") <= 1
    assert one("<div " * 3000 + "x") is not None
    assert len(one("<p>" + "word " * 100_000)) == 499_999


def test_hosts_outvote_a_page(pages_of):
    template = "<html><body><div class='post n{}'><p>{}</p></div><div class='talk'><p>{}</p></div></body></html>"
    rows = [(k, "http://h.example/x", template.format(k, LONG * 3 + str(k), "short remark")) for k in range(20)]
    rows.append((99, "http://H.example/y", template.format(99, "Brief news of today, that is all there is.", LONG * 5)))
    rows += [(200, None, template.format(1, "a", LONG)), (201, "http://other.example/", None), (202, "no scheme", ""), (99, "http://h.example/y", None)]
    got = sorted(((r["page_id"], r["text"]) for r in html_extract.extract(pages_of(rows)).collect()), key=repr)
    want = [(k, (LONG * 3 + str(k))) for k in range(20)] + [(99, "Brief news of today, that is all there is."), (99, ""), (200, LONG.strip()), (201, ""), (202, "")]
    assert got == sorted(want, key=repr)


def test_empty_table(pages_of):
    assert html_extract.extract(pages_of([])).collect() == []


def test_articles_in_several_containers(pages_of):
    split = f"<article><div class=part>{LONG * 7}</div><div class=ad>BUY</div><div class=part>{LONG * 4}</div></article>"
    wrapped = f"<div class=page><div class=main><h1>Title</h1><div class=in><div class=body>{LONG * 10}</div></div></div></div>"
    led = f"<article><h1>Title</h1>{LONG}<div class=body>{LONG * 10}</div></article>"
    quoting = f"<article><p>First.</p><blockquote>{LONG * 9}</blockquote><p>Last.</p></article><div class=talk>{LONG}</div>"
    halves = f"<div id=wrap><div class=lead>{LONG * 4}</div><div class=rest>{LONG * 7}</div></div><div class=talk>{LONG}</div>"
    wants = {
        split: [LONG * 7, LONG * 4], wrapped: ["Title", LONG * 10], led: ["Title", LONG, LONG * 10], quoting: ["First.", LONG * 9, "Last."],
        halves: [LONG * 4, LONG * 7],
    }
    wants = {f"<html><body>{k}</body></html>": "\n".join(x.strip() for x in v) for k, v in wants.items()}
    assert [one(k) for k in wants] == list(wants.values())
    rows = [(k, None if k % 2 else f"http://h{k}.example/", source) for k, source in enumerate([*wants, *wants])]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages_of(rows)).collect()}
    assert [got[k] for k in sorted(got)] == [*wants.values(), *wants.values()]


def test_every_part_of_the_template(pages_of):
    plain, part = f"<body><div class=part>{LONG * 7}</div></body>", f"<div class=part>{LONG * 4}</div>"
    split = f"<body><div class=part>{LONG * 7}</div><div class=talk>{LONG}</div>{part}</body>"
    led = f"<body><article>A lead.<div class=part>{LONG * 7}</div></article></body>"
    bare = f"<body><article><div class=part>{LONG * 7}</div></article></body>"
    rows = [(k, "http://h.example/", plain) for k in range(6)] + [(6, "http://h.example/", split)]
    rows += [(k, "http://led.example/", bare) for k in range(10, 16)] + [(16, "http://led.example/", led)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages_of(rows)).collect()}
    assert got[0] == got[10] == (LONG * 7).strip()
    assert got[6] == "\n".join([(LONG * 7).strip(), (LONG * 4).strip()])
    assert got[16] == "\n".join(["A lead.", (LONG * 7).strip()])


def test_names_alone_drop_no_article(pages_of):
    text = f"<p>{LONG * 9}</p>"
    sources = [
        f"<article class='post category-social'>{text}</article>", f"<div class='content-with-sidebar'>{text}</div>",
        f"<div class='sidebar'>{text}</div>", f"<main id='menu' class='related'>{text}</main>", f"<div class='comments-open'>{text}</div><p>",
        f"<div id='wrap' class='widget'><div class='widget'>{text}</div></div><div class='misc'><a href=x>{LONG * 20}</a></div>",
        f"<div class='post tag-ad'>{text}</div><div class='pages'>{LONG * 4}</div><div class='comments'>{LONG * 30}</div>",
    ]
    assert [one(f"<body>{x}</body>") for x in sources] == [(LONG * 9).strip()] * len(sources)
    section = f"<article>{text}<section id='discussion'><h2>Discussion</h2>{text}</section><section id='related-work'>And more.</section></article>"
    assert one(section) == "\n".join([(LONG * 9).strip(), "Discussion", (LONG * 9).strip(), "And more."])
    rows = [(k, "http://h.example/", f"<body>{x}</body>") for k, x in enumerate(sources)]
    assert {r["text"] for r in html_extract.extract(pages_of(rows)).collect()} == {(LONG * 9).strip()}


def test_names_still_drop():
    names = ["ad", "js-share", "left-sidebar", "siteFooter", "page-header", "post-comments", "related_content", "comment", "main-menu", "widget with-icon"]
    for name in names:
        assert one(f"<body><div class=post><p>{LONG * 3}</p></div><div class='{name}'><p>{LONG}</p></div>") == (LONG * 3).strip()
        assert one(f"<body><div class=box><p>{LONG * 3}</p><div id='{name.split()[0]}'><p>{LONG}</p></div></div>") == (LONG * 3).strip()
    assert one(f"<article>{LONG}<section id=comments>{LONG * 9}</section><article class=comment>{LONG * 9}</article></article>") == LONG.strip()


def test_boxes_around_a_whole_page_stay():
    text = f"<div id=content><h1>Title</h1><p>{LONG * 3}</p></div>"
    want = f"Title\n{(LONG * 3).strip()}"
    for opening, closing in [
        ("<form action=x>", "</form>"), ("<div role=form>", "</div>"), ("<dialog open>", "</dialog>"), ("<div aria-hidden=true>", "</div>"),
        ("<div style='display:none'>", "</div>"), ("<div hidden><form>", "</form></div>"), ("<aside>", "</aside>"), ("<menu>", "</menu>"),
        ("<div role=alert>", "</div>"), ("<div role=banner>", "</div>"),
    ]:
        assert one(f"<html><body>{opening}{text}{closing}</body></html>") == want
        assert one(f"<body><nav><a href=/>Home</a></nav>{opening}{text}<footer>Legal notes and more</footer>{closing}<footer>&copy; me</footer>") == want
        # Beside an article they are what they are called, however long.
        article = f"<article><p>{LONG * 2}</p></article>"
        assert one(f"<body>{article}{opening}<p>{LONG * 5}</p>{closing}</body>") == (LONG * 2).strip()
    assert one(f"<body><form><article>{text}</article></form><div class=teasers>{LONG}</div></body>") == want
    assert one(f"<body><article>{text}</article><form><article>{LONG}</article></form></body>") == want


def test_a_linked_article():
    linked = "".join(f"<p><a href=/{k}>{LONG}</a></p>" for k in range(3))
    assert one(f"<body><nav><a href=/>Home</a></nav><article>{linked}</article><footer><a>{LONG * 9}</a></footer></body>") == "\n".join([LONG.strip()] * 3)
    assert one(f"<body><div>{linked}</div></body>") == ""


def timed(source):
    begin = time.perf_counter()
    text = one(source)
    return text, time.perf_counter() - begin


def test_depth_and_stray_tags_cost_in_proportion():
    tracemalloc.start()
    text, took = timed("<div class=a>" * 100_000 + f"<p>{LONG}")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text == LONG.strip() and took < 60 and peak < 400 << 20
    for source in [
        "<div>" * 20_000 + "</li>" * 60_000, "<ul>" + "<div>" * 20_000 + "<li></li>" * 60_000, "<div>" * 20_000 + "<li>x" * 60_000,
        "<table>" * 20_000 + "<li>x</li>" * 60_000, "<article>" * 40_000, "<div>" * 20_000 + "<section class=x>a</section>" * 20_000,
    ]:
        assert timed(source)[1] < 20
    rows = html_extract.parse("<div>" * 30_000 + "<section class=x>some words</section>" * 30_000)
    html_extract.score(rows)
    begin = time.perf_counter()
    assert html_extract.chosen(rows, [rows.path(len(rows.containers) - 1)])
    assert time.perf_counter() - begin < 20


def test_generated_class_names(pages_of):
    general = html_extract._general
    assert general("css-1abc2de") == general("css-9zz8x") == "css-0" and general("post12") == "post0" and general("heading") == "heading"
    assert general("a1b2c3d4") == "0" and general("col-md-6") == "col-md-0" and general("x>y") == "xy"
    pick = random.Random(5)
    name = lambda: "css-" + "".join(pick.choice("abcdef0123456789") for _ in range(5)) + "1x"
    page = "<html><body><div class='{} post'><p>{}</p></div><div class='{} talk'><p>{}</p></div></body></html>"
    rows = [(k, "http://h.example/x", page.format(name(), LONG * 3 + str(k), name(), "short remark")) for k in range(20)]
    rows.append((99, "http://h.example/y", page.format(name(), "Brief news of today, that is all there is.", name(), LONG * 5)))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages_of(rows)).collect()}
    assert got == {**{k: LONG * 3 + str(k) for k in range(20)}, 99: "Brief news of today, that is all there is."}


def test_paths_beyond_the_broadcast_bound_are_joined(pages_of, monkeypatch):
    rows = [(k, f"http://h{k % 5}.example/", f"<body><div class=post>{LONG}{k}</div></body>") for k in range(30)]
    whole = sorted(map(tuple, html_extract.extract(pages_of(rows)).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html_extract.extract(pages_of(rows)).collect())) == whole
