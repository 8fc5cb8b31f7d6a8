from html.parser import HTMLParser

from quernstone.llm import wrappers as W


class Plain(HTMLParser):
    """Article text by the standard library's parser."""

    SKIP = {"script", "style", "nav", "aside", "form", "footer"}
    BLOCK = {"p", "h1", "h2", "div", "ul", "li", "blockquote", "section", "table", "tr", "td"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on = self.off = 0
        self.blocks, self.now, self.stack = [], "", []
        self.feed(page)
        self.close()

    def cut(self):
        if t := " ".join(self.now.split()):
            self.blocks.append(t)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        c = dict(attrs).get("class", "")
        if tag == "article":
            self.on = 1
        elif self.off or tag in self.SKIP or c in ("ad", "comments", "share"):
            self.off += tag not in ("br", "img", "p", "input")
        elif tag in self.BLOCK:
            self.cut()
        elif tag == "br":
            self.now += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.cut()
            self.on = 0
        elif self.off:
            self.off -= tag not in ("p",)
        elif tag in self.BLOCK:
            self.cut()

    def handle_data(self, data):
        if self.on and not self.off:
            self.now += data


def page(i, paragraphs, extra=""):
    body = "".join(f"<p>Para {i} {k} with <b>bold</b>&nbsp;and&amp;more\n text<br>next" + ("</p>" if k % 2 else "") for k in range(paragraphs))
    quote = "<blockquote>said &lt;b&gt; &eacute;</blockquote>" if i % 3 == 0 else ""
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body><div class="cookie-notice">ok?</div><header><h1>Site</h1></header>'
        f'<nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><div class="ad">Buy</div><article><h1>Head {i}</h1>{body}{quote}<ul><li>one</li><li>two</li></ul>{extra}'
        f'<section class="comments"><p>first!</p></section></article><aside>side</aside><form><p>mail</p></form><footer>&copy; x</footer></body></html>'
    )


def test_text_against_the_standard_parser():
    pages = [page(i, i % 5) for i in range(12)]
    wrapper = W._merged(("h", W.expression(W.parse(p))) for p in pages)["h"]
    main = W.region(wrapper)
    assert len(main.paths) == 1 and not main.template
    for p in pages:
        assert W.text_of(W.parse(p), main) == "\n".join(Plain(p).blocks)


def test_inference():
    e = lambda s: W.expression(W.parse(s))
    one = e("<h1>a</h1><p>x</p><p>y</p><div>c</div>")
    assert W.shape(one) == "<><h1>CONST</> (<p>TEXT</>)+ <div>CONST</></>"
    both = W.merge(one, e("<h1>b</h1><p>x</p><hr><div>c</div>"))
    assert W.shape(both) == "<><h1>TEXT</> (<p>TEXT</>)+ (<hr></>)? <div>CONST</></>"
    rows = e("<dl>" + "<dt>k</dt><dd>v</dd>" * 3 + "</dl>")
    assert W.shape(rows) == "<><dl>((<dt>CONST</> <dd>CONST</>))+</></>"


def test_no_article():
    assert W.text_of(W.parse("<div id=content><p>x</p></div><div class=menu>m</div>"), W.Region()) == "x"
    assert W.text_of(W.parse("<header>h</header><p>x &am <<p>y"), W.Region()) == "x &am <\ny"
    assert W.text_of(W.parse('<p hidden>n</p>plain <a href="<">link</a>'), W.Region()) == "plain link"


def test_pages(spark, sf):
    rows = [(i, f"https://H{i % 2}.example/p{i}", page(i, i % 4), "clash") for i in range(20)]
    rows += [(100, None, None, "x"), (101, None, ""), (102, "no url", "<p>text"), (103, "https://h0.example/", "<div>" * 3000 + "deep" + "</div>" * 3000), (104, "https://h0.example/", "<p>" + "long " * 100000), (0, "https://H0.example/p0", page(0, 0), "y")]
    rows = [(*r, "x")[:4] for r in rows]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    a = sorted((r.page_id, r.text) for r in W.extract(df).collect())
    assert a == sorted((r.page_id, r.text) for r in W.extract(df, broadcast_bytes=0).collect())
    assert len(a) == len(rows)
    got = dict(a)
    assert all(got[i] == "\n".join(Plain(page(i, i % 4)).blocks) for i in range(20))
    assert got[100] == got[101] == "" and got[102] == "text" and got[103] == "deep" and len(got[104]) == 499999
    assert W.extract(df.limit(0)).count() == 0
    real = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in W.query(spark, sf).collect():
        assert r.text == "\n".join(Plain(real[r.page_id]).blocks) and r.n_chars == len(r.text)


def test_names_at_any_place_of_a_long_class_list():
    long = " ".join(f"utility-class-{c * 5}" for c in "abcdef")
    html = f'<article><p>kept</p><div class="{long} comments">first!</div><div class="{long[:53]} commentary">said</div></article>'
    assert W.text_of(W.parse(html), W.Region()) == "kept\nsaid"
    tree = W.parse(f'<div>out</div><div class="{long} entry">in</div>')
    assert W.text_of(tree, W.Region()) == "in"


def test_regions_at_any_depth(spark):
    def nested(i, depth):
        return "<html><body><p>out</p>" + "<div>" * depth + f"<article><p>in {i}</p></article>" + "</div>" * depth + "</body></html>"

    rows = [(i, f"http://h{i % 2}/{i}", nested(i, 100 if i % 2 else 20_000)) for i in range(6)]
    got = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"in {i}" for i in range(6)}


def test_expressions_as_json():
    e = ["t", 'a"],[\\', [["?", ["#", None]], ["+", ["g", [["#", 7], ["t", "é [", []]]]]]]
    deep = e
    for _ in range(30_000):
        deep = ["t", "div", [["#", 3], deep, ["#", None]]]
    text = W.dumps(deep)
    back = W.loads(text)
    assert W.loads(W.dumps(e)) == e and W.dumps(back) == text
    for _ in range(30_000):
        assert back[2][0] == ["#", 3] and back[2][2] == ["#", None]
        back = back[2][1]
    assert back == e


def test_slots_decide_without_names():
    """No class name says anything: constant strings are template, slots are text."""
    def neutral(i):
        story = "".join(f"<p>Story {i} part {k} text here</p>" for k in range(i % 3 + 1))
        return f'<body><div class="qa">Welcome to the portal</div><div class="qb"><div class="qd">Printed for you</div><h2>Title {i}</h2><div class="qe">{story}</div></div><div class="qf"><a href="/{i}">see number {i} of all the others too</a></div><div class="qc">All rights reserved</div></body>'

    wrapper = W._merged(("h", W.expression(W.parse(neutral(i)))) for i in range(5))["h"]
    main = W.region(W.loads(W.dumps(wrapper)))
    for i in range(5):
        assert W.text_of(W.parse(neutral(i)), main) == "\n".join([f"Title {i}", *(f"Story {i} part {k} text here" for k in range(i % 3 + 1))])
    flat = [f"<div class=qa>Welcome to the portal</div><div class=qb><p>Story {i} text here</p></div><div class=qc>All rights reserved</div>" for i in range(5)]
    main = W.region(W._merged(("h", W.expression(W.parse(p))) for p in flat)["h"])
    assert [W.text_of(W.parse(p), main) for p in flat] == [f"Story {i} text here" for i in range(5)]
    mixed = [f"<div class=qb><p>Story {i} text here</p><ul>Ask the author</ul><p>and more of {i}</p></div><div class=qc>All rights reserved</div>" for i in range(5)]
    main = W.region(W._merged(("h", W.expression(W.parse(p))) for p in mixed)["h"])
    assert [W.text_of(W.parse(p), main) for p in mixed] == [f"Story {i} text here\nand more of {i}" for i in range(5)]
    copies = [flat[0]] * 5
    main = W.region(W._merged(("h", W.expression(W.parse(p))) for p in copies)["h"])
    assert "Story 0 text here" in W.text_of(W.parse(copies[0]), main)


def test_an_article_element_beside_longer_slots():
    pages = [f"<body><article class=teaser><p>More {i}</p></article><article><h1>Title {i}</h1><p>{'story ' * (30 + i)}</p></article><div class=zz>{f'<p>reader {i} says this and that</p>' * 6}</div></body>" for i in range(6)]
    main = W.region(W._merged(("h", W.expression(W.parse(p))) for p in pages)["h"])
    assert [W.text_of(W.parse(p), main) for p in pages] == [f"Title {i}\n{('story ' * (30 + i)).strip()}" for i in range(6)]


def test_a_header_in_the_article_stays():
    page = "<header>Site</header><article><header><h1>Title</h1></header><p>one two three</p></article>"
    assert W.text_of(W.parse(page), W.Region()) == "Title\none two three"


def test_common_subsequences(monkeypatch):
    import random

    rnd = random.Random(5)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for bits in (1 << 28, 40):
        monkeypatch.setattr(W, "ALIGN_BITS", bits)
        for _ in range(150):
            a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(24))] for _ in range(2))
            got = W.common(a, b)
            assert len(got) == length(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(p < q and i < j for (p, i), (q, j) in zip(got, got[1:]))


def test_many_siblings():
    import random

    rnd = random.Random(6)
    pages = ["<article>" + "".join(rnd.choice(["<p>x</p>", "<div>y</div>", "<h2>z</h2>", "<ul>u</ul>", "<pre>v</pre>"]) for _ in range(20_000)) + "</article>" for _ in range(2)]
    wrapper = W._merged(("h", W.expression(W.parse(p))) for p in pages)["h"]
    assert W.text_of(W.parse(pages[0]), W.region(wrapper)).count("\n") == 19_999
