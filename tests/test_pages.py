"""HTML extraction against a standard-library HTMLParser walk with implied paragraph ends."""

import html as htmlmod
from html.parser import HTMLParser

from quarry.functions.html import BLOCK_TAGS, CONTAINERS
from quarry.operators import pages as PG


class Walk(HTMLParser):
    """Text nodes per element, with <p> closed by a new <p>, </p> or a block tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.skip = [], 0
        self.h1, self.in_h1, self.h1_done = [], False, False
        self.art_depth, self.art_done, self.art_nodes = 0, False, []
        self.paras, self.cur, self.quotes, self.open, self.around = [], None, [], [], 0
        self.art_paras = []

    def _close_p(self):
        if self.cur is not None:
            self.paras.append(("art" if self.art_depth and not self.art_done else "page", self.quoted, self.cur))
            self.cur = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "p" or tag in BLOCK_TAGS:
            self._close_p()
        if tag == "p":
            self.cur, self.quoted = [], any(not q["ended"] for q in self.open)
        if tag in CONTAINERS:
            self.around += 1
        if tag == "h1" and not self.h1_done:
            self.in_h1 = True
        if tag == "article" and not self.art_done:
            self.art_depth += 1
        if tag == "blockquote":
            self.open.append({"around": self.around, "ended": False, "nodes": []})
            self.quotes.append(self.open[-1]["nodes"])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        if tag == "p" or tag in BLOCK_TAGS:
            self._close_p()
        if tag == "h1" and self.in_h1:
            self.in_h1, self.h1_done = False, True
        if tag == "article" and self.art_depth:
            self.art_depth -= 1
            self.art_done = self.art_depth == 0
        if tag == "blockquote" and self.open:
            self.open.pop()
        if tag in CONTAINERS and self.around:
            self.around -= 1
            for q in self.open:
                q["ended"] |= self.around < q["around"]

    def handle_data(self, data):
        if self.skip:
            return
        t = data.strip()
        if self.in_h1:
            self.h1.append(t)
        if self.art_depth and not self.art_done:
            self.art_nodes.append(t)
        if self.cur is not None:
            self.cur.append(t)
        for q in self.open:
            if not q["ended"]:
                q["nodes"].append(t)


def oracle(doc):
    w = Walk()
    w.feed(doc)
    w.close()
    w._close_p()
    join = lambda xs, s="": s.join(x for x in xs if x)
    return {"headline": join(w.h1) if w.h1_done else None,
            "paragraphs": [join(p) for k, _, p in w.paras if k == "art"],
            "article": join(w.art_nodes, " ") if w.art_done else None,
            "quotes": [join(q) for q in w.quotes],
            "outside_p": [join(p) for _, bq, p in w.paras if not bq]}


PAGES = [
    "<html><head><script>var s='</p>';</script><style>p{}</style></head><body><!-- <p>hidden</p> -->"
    "<h1> Big <b>News</b>&amp;more </h1><article><p><b>Lead<br><p>Second  para &quot;q&quot; &#233;t&#xE9;</p>"
    "<p></p><p>a<b>b</b>c<div>block</div><ul><li>x</li></ul><p>Last</article><footer>&copy; f</footer></body></html>",
    "<html><body><p>No article, Dr Ann Lee.</p><blockquote><p>Quoted Mr Bob Ray</p> tail</blockquote>"
    "<p>After</p></body></html>",
    "<article><p>First</p></article><article><p>Second article</p></article>",
    "<blockquote>outer <blockquote>inner</blockquote> tail</blockquote><p>out</p>",
    "<div><blockquote>open <p>in</p></div><p>after</p><blockquote>b<BLOCKQUOTE class='x'>c</blockquote >d<p>e</blockquote>f<p>g",
    "</blockquote><p>a<blockquote>q<section>r</section></blockquote>b</p><article><blockquote>x</article>y</blockquote><p>z",
    "<blockquote>1<blockquote>2<blockquote>3</blockquote>4<p>5",
    "<blockquote>" * 1500 + "<p>deep</p>" + "</blockquote>" * 1499 + "<p>still in</p></blockquote><p>out</p>",
]


def test_pages_match_parser_walk(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    heads = {r.page_id: r.headline for r in PG.headline(df).collect()}
    paras = {}
    for r in PG.article_paragraphs(df).orderBy("page_id", "para_pos").collect():
        paras.setdefault(r.page_id, []).append(r.paragraph)
    arts = {r.page_id: r.text for r in PG.article_text(df).collect()}
    blocks = {}
    for r in PG.blocks(df).orderBy("page_id", "kind", "pos").collect():
        blocks.setdefault((r.page_id, r.kind), []).append(r.text)
    for i, doc in enumerate(PAGES):
        o = oracle(doc)
        assert heads[i] == o["headline"], i
        assert paras.get(i, []) == o["paragraphs"], i
        assert arts.get(i) == o["article"], i
        assert blocks.get((i, "blockquote"), []) == o["quotes"], i
        assert blocks.get((i, "p"), []) == o["outside_p"], i


def test_entities_decoded_once(spark):
    df = spark.createDataFrame([(1, "<h1>&amp;lt; &#60; &#x3C; &nbsp;x</h1>")], "page_id long, html string")
    assert PG.headline(df).first().headline == htmlmod.unescape("&amp;lt; &#60; &#x3C;") + " \xa0x"


def test_references_by_html_rules(spark):
    cases = ["&eacute;&pound;&bull;", "&#9999999;", "&#99999999999999999999;", "&#xFFFFFFFFFF;", "&#55357;&#56832;", "&#146;&#x80;", "&#38;lt;",
             "&#0000065;", "&#x41", "&#0;", "&notit; &copy2021 &unknown; &;&", "&amp", "AT&T", "&NotEqualTilde;"]
    want = [htmlmod.unescape(c) for c in cases]
    df = spark.createDataFrame([(i, f"<h1>{c}</h1>") for i, c in enumerate(cases)], "page_id long, html string")
    got = {r.page_id: r.headline for r in PG.headline(df).collect()}
    assert [got[i] for i in range(len(cases))] == want


def test_element_names_nesting_and_open_ends(spark):
    docs = ["<h1-x>no</h1-x><h1 class='a'>yes</h1>", "<body><h1>open <b>end</b>", "<article>a<article>b</article>c</article>d",
            "<article-teaser>t</article-teaser><article>x</article>", "</article><ARTICLE\n>y</ARTICLE >"]
    df = spark.createDataFrame(list(enumerate(docs)), "page_id long, html string")
    assert {r.page_id: r.headline for r in PG.headline(df).collect()} == {0: "yes", 1: "openend", 2: None, 3: None, 4: None}
    assert {r.page_id: r.text for r in PG.article_text(df).collect()} == {2: "a b c", 3: "x", 4: "y"}


from hypothesis import given, settings, strategies as st  # noqa: E402

_tok = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<br>", "<p class='x'>", " word ", "Dr Ann Lee",
                        "&amp;", "&quot;q&quot;", "&#233;", "<!-- <p>c</p> -->", "<div>", "</div>",
                        "<ul><li>i</li></ul>", "<script>var a='</p>';</script>", "  ", "\n", "x<i>y</i>z",
                        "<blockquote>", "<blockquote cite='u'>", "</blockquote>", "</blockquote>", "<section>", "</section>"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(_tok, max_size=12), st.lists(_tok, max_size=8), st.booleans(), st.booleans()),
                min_size=1, max_size=4))
def test_pages_property(spark, specs):
    docs = []
    for body, quote, with_article, with_h1 in specs:
        inner = "".join(body) + "<blockquote>" * bool(quote) + "".join(quote)
        head = "<h1>Head <b>line</b></h1>" if with_h1 else ""
        docs.append("<html><body>" + head + (f"<article>{inner}</article>" if with_article else inner)
                    + "<p>tail</p></body></html>")
    df = spark.createDataFrame(list(enumerate(docs)), "page_id long, html string")
    heads = {r.page_id: r.headline for r in PG.headline(df).collect()}
    paras, blocks = {}, {}
    for r in PG.article_paragraphs(df).orderBy("page_id", "para_pos").collect():
        paras.setdefault(r.page_id, []).append(r.paragraph)
    for r in PG.blocks(df).orderBy("page_id", "kind", "pos").collect():
        blocks.setdefault((r.page_id, r.kind), []).append(r.text)
    arts = {r.page_id: r.text for r in PG.article_text(df).collect()}
    for i, doc in enumerate(docs):
        o = oracle(doc)
        assert heads[i] == o["headline"], doc
        assert paras.get(i, []) == o["paragraphs"], doc
        assert arts.get(i) == o["article"], doc
        assert blocks.get((i, "p"), []) == o["outside_p"], doc
        assert blocks.get((i, "blockquote"), []) == o["quotes"], doc
