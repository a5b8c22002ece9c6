"""Wrappers and main text of pages: against an independent reader, templates and odd markup."""

import json
import random
from html.parser import HTMLParser

from siftgraph.llm import page_wrappers, queries
from siftgraph.llm.page_wrappers import Node, add_in, dumped, expression, extract, fold, infer_wrappers, loaded, main_text, read_page, unify

PAGES = "page_id long, url string, html string, host string, nodes string, n long"


class Article(HTMLParser):
    """Blocks of the article, read event by event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "br", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def brute(html):
    reader = Article()
    reader.feed(html or "")
    reader.close()
    return " ".join(" ".join(b.split()) for b in reader.blocks if b.strip())


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES).repartition(3)


def texts(df):
    return {r.page_id: r.text for r in extract(df).collect()}


def wrapper_of(*htmls):
    out = None
    for h in htmls:
        nodes = fold(read_page(h)[0])
        out = nodes if out is None else unify(out, nodes)
    return out


def test_query_equals_independent_reader(spark, small):
    rows = queries.op11_page_wrappers(spark, small).collect()
    html = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(html) > 0
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (html[r.page_id].url, brute(html[r.page_id].html), len(r.text))


def test_wrapper_has_slots_optional_and_repeated_parts():
    a = "<ul><li>one</li><li>two</li><li>three</li></ul><div>same words<b>x</b></div>"
    b = "<ul><li>four</li></ul><div>same words</div><hr>"
    wrapper = wrapper_of(a, b)
    assert expression(wrapper, 2) == "<ul> (<li> # </li>)+ </ul> <div> ' ( <b> # </b> )? </div> ( <hr> )?"
    assert expression(loaded(json.loads(json.dumps(dumped(wrapper)))), 2) == expression(wrapper, 2)
    # nested repeats, and groups that begin and end alike
    rows = "".join(f"<tr>{'<td>c</td>' * k}</tr>" for k in (3, 2, 4))
    assert expression(fold(read_page(f"<table>{rows}</table>")[0]), 1) == "<table> (<tr> (<td> # </td>)+ </tr>)+ </table>"
    two = wrapper_of("<dl><dt>a</dt><dt>b</dt></dl>", "<dl><dt>a<i>x</i></dt><dt>b<i>y</i></dt></dl>")
    assert expression(two, 2) == "<dl> (<dt> # ( <i> # </i> )? </dt>)+ </dl>"


def test_every_page_fits_its_wrapper():
    # the texts of every page that went in fall into slots, whatever the order
    rng = random.Random(3)
    def part(depth):
        kind = rng.randrange(4)
        if depth == 0 or kind == 0:
            return f"w{rng.randrange(50)}"
        tag = rng.choice(["div", "p", "li", "b"])
        return "".join(f"<{tag}>{part(depth - 1)}</{tag}>" for _ in range(rng.randint(1, 3)))
    for _ in range(60):
        htmls = ["<body>" + "".join(part(3) for _ in range(rng.randint(1, 4))) + "</body>" for _ in range(4)]
        wrapper = wrapper_of(*htmls)
        assert max(x.n for x in wrapper) <= len(htmls)
        nodes = json.dumps(dumped(wrapper))
        for h in htmls:
            stream = fold(read_page(h)[0])
            assert [i for x in page_wrappers._slots(stream) for i in x.at].__len__() == sum(bool(t.strip()) for t in read_page(h)[1])
            assert len(page_wrappers._ranks(loaded(json.loads(nodes)), stream, lambda x: 0)) == len(list(page_wrappers._slots(stream)))


MENU = "<div class='wrap'><div id=top><ul><li><a href=/>Home</a></li><li><a href=/x>News of the day and more</a></li></ul></div>"


def plain_page(title, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<html><head><title>{title}</title></head><body>{MENU}<div class=left><p>Buy our fine goods today, everybody does so.</p></div>"
        f"<div class=text><h2>{title}</h2>{body}</div><div class=end><p>All rights are reserved by us for ever.</p></div></div></body></html>"
    )


def test_pages_without_article_by_what_varies(spark):
    rng = random.Random(8)
    said = [[" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(4, 9))) for _ in range(rng.randint(1, 4))] for _ in range(9)]
    rows = [(i, f"http://h.example/{i}", plain_page(f"Title {i}", p)) for i, p in enumerate(said)]
    got = texts(pages_of(spark, rows))
    assert got == {i: " ".join([f"Title {i}", *p]) for i, p in enumerate(said)}


def test_parts_that_are_no_article(spark):
    article = (
        "<article class='post has-comments'><header><h1>A  title</h1><p>By somebody</p></header><p>One &amp; two&nbsp;&lt;b&gt;"
        "<b>bo</b>ld <a href=x>link</a>.</p><div class='ad-slot'>Buy</div><p class=notice>We use cookies</p><form><p>Mail</p></form>"
        "<aside>Side</aside><ul><li>first<li>second</ul><table><tr><td>1<td>2</table><!-- <p>no</p> --><script>var a='<p>x</p>';</script>"
        "<div id=comments><p>I disagree</p></div><section class=comment-list><div class=comment>me too</div></section></article>"
    )
    outer = f"<header><h1>Site</h1></header><div role=navigation>go</div><main><p>near</p>{article}</main><footer>end</footer>"
    main = "<nav>menu</nav><main><h1>Only</h1>text in main<div class=sidebar>no</div></main><div>long long long long text outside</div>"
    noted = "<article><p>real</p><article class=comment><p>reader</p></article></article>"
    rows = [(1, "https://a.example/1", outer), (2, "https://a.example/2", main), (3, "https://b.example", noted)]
    got = texts(pages_of(spark, rows))
    assert got[1] == "A title One & two <b>bold link. first second 1 2"
    assert got[2] == "Only text in main"
    assert got[3] == "real"


def test_awkward_pages(spark):
    long = "<article>" + "".join(f"<p>word{i}<b>b{i}</b></p><h2>h</h2>" for i in range(4000)) + "</article>"
    rows = [
        (1, "http://x.example/", None),
        (2, "http://x.example/", ""),
        (3, None, "<article>no host</article>"),
        (4, "not a url", "<article>a < b and 1 <2 </ p></article>"),
        (5, "HTTP://X.example?q", "<article><p>cut off here <a href='"),
        (6, "http://x.example/", "plain text without markup"),
        (7, "http://x.example/", long),
        (8, "http://x.example/", long),
        (8, "http://x.example/", long),
        (None, "http://x.example/", "<ARTICLE><P>upper\n\n case &copy;&#65;&bogus; &am</P></ARTICLE><p>after"),
        (9, "http://y.example/", "</div></p><article>stray</b> ends</i></article></article><p title='>'>quoted"),
        (10, "http://y.example/", "<!-- <article>x</article>"),
        (11, "http://y.example/", "<article><p></p><br><br></article>"),
        (12, "http://y.example/", "<article><p>a b c</p>tail<div>d</div>e</article>"),
    ]
    got = [(r.page_id, r.text) for r in extract(pages_of(spark, rows)).collect()]
    assert len(got) == len(rows)
    want = " ".join(f"word{i}b{i} h" for i in range(4000))
    assert dict(got) == {
        1: "",
        2: "",
        3: "no host",
        4: "a < b and 1 <2",
        5: "cut off here",
        6: "plain text without markup",
        7: want,
        8: want,
        None: "upper case ©A&bogus; &am",
        9: "stray ends",
        10: "",
        11: "",
        12: "a b c tail d e",
    }
    assert extract(pages_of(spark, rows[:0])).collect() == []


def test_hot_host_and_parts_of_the_input(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        body = "".join(rng.choice(["<p>%d</p>", "<ul><li>%d</li><li>x</li></ul>", "<h2>%d</h2>"]) % rng.randrange(9) for _ in range(rng.randint(1, 12)))
        host = "hot.example" if i % 3 else f"h{i % 7}.example"
        rows.append((i, f"http://{host}/{i}", f"<nav><a href=1>m</a></nav><article>{body}</article><footer>f{i}</footer>"))
    df = pages_of(spark, rows)
    wrappers = {r.host: r for r in infer_wrappers(df).collect()}
    assert {h: r.n for h, r in wrappers.items()} == {h: sum(h in r[1] for r in rows) for h in wrappers}
    assert len(wrappers) == 8
    got = texts(df)
    assert got == texts(df.repartition(17))
    for i, _, html in rows:
        inner = html.split("<article>")[1].split("</article>")[0]
        assert got[i] == " ".join(inner.replace("<", " <").replace(">", "> ").replace("<p>", "").replace("</p>", "").replace("<h2>", "").replace("</h2>", "").replace("<ul>", "").replace("</ul>", "").replace("<li>", "").replace("</li>", "").split())


def test_wrapper_that_is_full_loses_no_text(monkeypatch):
    monkeypatch.setattr(page_wrappers, "MOST_NODES", 6)
    htmls = [f"<article>{'<p>a</p>' * k}<h{k}>t{k}</h{k}><i>z</i></article>" for k in (1, 2, 3)]
    wrapper = wrapper_of(htmls[0])
    for h in htmls[1:]:
        wrapper = unify(wrapper, fold(read_page(h)[0]), 6)
    nodes = json.dumps(dumped(wrapper))
    for k, h in zip((1, 2, 3), htmls, strict=True):
        assert main_text(h, nodes) == " ".join(["a"] * k + [f"t{k}", "z"])
    monkeypatch.setattr(page_wrappers, "CELLS", 1)
    assert main_text("<article><i>q</i><p>b</p></article>", nodes + " ") == "q b"


def test_added_pages_share_texts_or_not():
    a, b = (Node("#o|", lit=k, words=2) for k in (5, 6))
    add_in(a, b, True)
    assert (a.n, a.words, a.lit) == (2, 4, 0)
