import html
import re
from collections import Counter

import pyarrow.parquet as pq

from tidemill.llm.html_text import _key, extract_main_text, main_text, op8_html_text, parse, templates


def plain(page):
    """Pages of the test tables: paragraphs of the one article element."""
    m = re.search("<article>(.*?)(</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|article|div|ul|li)\b[^>]*>", m[1] if m else "")
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_op8_on_pages(spark, sf):
    t = pq.read_table(f"{sf}/pages.parquet")
    want = {i: plain(h) for i, h in zip(t.column("page_id").to_pylist(), t.column("html").to_pylist())}
    got = op8_html_text(spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


PAGE = """<html><head><title>t</title><script>if (a < b) "</p>";</script></head><body class=page><header>Site</header><nav><a href=x>Menu</a></nav>
<main><h2>Head&eacute; &amp; more</h2><p>One <b>two</b>
 three<p>Four<br>five <a href='q>r'>six</a></p><ul><li>a<li>b</ul><div class="advert-box">Buy</div><form>Name <input></form><aside>Side</aside>
<table><tr><td>c1<td>c2</table><!-- no --><section id="comments"><p>Nice!</p></section></main><div class="cookie-notice">Cookies</div><footer>&copy; x</footer></body>"""


def test_regions_and_blocks():
    assert main_text(PAGE) == "Headé & more\nOne two three\nFour five six\na\nb\nc1\nc2"
    assert main_text("no markup &lt;b&gt;  at\tall") == "no markup <b> at all"
    assert main_text("<p>cut <a href=\"x") == "cut"
    assert main_text("<p>" + "<b>x " * 5000) == " ".join(["x"] * 5000) and main_text("") == ""


def test_templates_and_odd_rows(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><div><p>Welcome to our site</p></div><div><p>Story {k} of many words</p><p>Rated by {k % 3} readers</p></div><p>All rights kept</p>") for k in range(30)]
    pages += [(100 + k, "http://copies.example/", "<p>Same text</p>") for k in range(40)] + [(200, None, None), (201, "", "<p>x"), (201, "odd", "<p>y")]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, text string, host int")
    for send in (10**6, 0):
        got = extract_main_text(df, send).collect()
        by = {r["page_id"]: r["text"] for r in got}
        assert len(got) == len(pages) and by[7] == "Story 7 of many words\nRated by 1 readers" and by[110] == "Same text" and by[200] == ""
    assert extract_main_text(df.limit(0)).collect() == []


def test_blocks_of_links_stay():
    page = "<body><p>Text of the story</p><p><a href=x>A paragraph that is one link</a></p><ul><li><a href=y>Source one</a><li><a href=z>Source</a> two</ul></body>"
    assert main_text(page) == "Text of the story\nA paragraph that is one link\nSource one\nSource two"


def test_names_of_articles_parts_stay():
    page = '<article><div class="related-work"><p>Work</p></div><p class="side">Side</p><p id="noticeable">Seen</p><p class="notice">Note</p><p class="comment-form">Say</p></article>'
    assert main_text(page) == "Work\nSide\nSeen"


def f1(got, want):
    got, want = Counter(got.split()), Counter(want.split())
    shared = sum((got & want).values())
    return 2 * shared / max(1, sum(got.values()) + sum(want.values()))


def test_slots_of_the_template_decide_without_marks(spark, sf):
    """The given pages without article elements and class names, on hosts with a template: adverts go by their slot."""
    t = pq.read_table(f"{sf}/pages.parquet")
    rows = [(i, f"http://host{i % 3}/x", re.sub("</?article>", "", h.replace(' class="ad"', "")), plain(h)) for i, h in zip(t.column("page_id").to_pylist(), t.column("html").to_pylist())]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()}
    scores = [f1(got[i], want) for i, _, _, want in rows]
    assert min(scores) > 0.95 and sum(scores) / len(scores) > 0.99
    bare = [f1(main_text(h), want) for _, _, h, want in rows]
    assert min(bare) < min(scores) and sum(bare) < sum(scores)


def test_classes_of_two_layouts_and_copies(spark):
    """Texts of a layout that half the pages have go; a paragraph that near copies share, or one frequent text in no class, stays."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    pages = []
    for k in range(40):
        frame = ("<body><h3>Daily paper</h3><div>", "</div><h4>Made by us</h4>") if k % 2 else ("<body><table><tr><td>Weekly paper<td>", "<td>All by them</table>")
        pages.append((k, f"{frame[0]}<p>{words(k)}</p><p>{words(k + 100)}</p>{frame[1]}"))
    copied = "".join(f"<p>{words(500 + j)}</p>" for j in range(4))
    pages += [(100 + k, f"<body><h3>Daily paper</h3><div><p>Copy {k}</p>{copied}</div><h4>Made by us</h4>") for k in range(12)]
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in pages], "page_id long, url string, html string")
    by = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert all(by[k] == f"{words(k)}\n{words(k + 100)}" for k in range(1, 40, 2))
    assert all(by[100 + k] == "\n".join([f"Copy {k}", *(words(500 + j) for j in range(4))]) for k in range(12))


def test_no_article_text_is_lost(spark):
    """Short blocks in slots of their own stay if their texts differ; names of the page's or the article's state, or ones that only begin like noise, say nothing."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(120))
    pages = [(k, "http://h/", f"<body><h3>Site name</h3><div class='a'><p>{words(k)}</p></div><div class='b'><p>Closing remark number {k} of the author</p></div><div class='c'><p>Read on {k % 3}</p></div><h5>Foot</h5>") for k in range(20)]
    pages += [(100 + k, "http://h/", pages[3][2]) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{words(k)}\nClosing remark number {k} of the author" for k in range(20)) and got[110] == got[3]
    for page in ('<body class="nav-open"><article><p>Text</p></article></body>', '<article class="post comment-enabled"><p>Text</p></article>', '<article id="comment-policy"><p>Text</p></article>', '<body class="header"><p>Text</p>', '<article><p class="ad-hoc">Text</p><p class="ad-slot-2">Buy</p></article>', '<html class="menu-open"><main id=search><p>Text</p></main>', '<div class="sidebar-right">Side</div><p>Text', "<p><span class=ad>Buy</span> Text</p>"):
        assert main_text(page) == "Text", page


def test_deeply_nested_pages():
    deep = "<div>" * 100_000
    assert main_text(deep + "core" + "</div>" * 100_000 + "<p>after</p>") == "core\nafter"
    assert main_text(deep + "</section></b>x</td>" * 1000) == "x" * 1000
    assert main_text("<div><b>" * 50_000 + "a" + "</i></p>" * 50_000) == "a"
    assert len(parse(deep)[1]) == 100_000


def brute_template(pages):
    """Classes of one host's different pages, held as whole vectors of counts."""
    pages, tokens = list(dict.fromkeys(pages)), {}
    orders, sizes = [], []
    for k, page in enumerate(pages):
        blocks, tags = parse(page)
        found = [(t, None) for t in tags] + [(_key(b[0], b[1]), len(b[1])) for b in blocks]
        orders.append(list(dict.fromkeys(t for t, _ in found)))
        sizes.append(sum(len(b[1]) for b in blocks))
        for t, n in found:
            tokens.setdefault(t, (n, Counter()))[1][k] += 1
    classes = {}
    for t, (n, count) in tokens.items():
        if len(count) >= 8 and len(count) >= 0.4 * len(pages):
            classes.setdefault(tuple(sorted(count.items())), []).append((t, n))
    texts, tags = set(), set()
    for vector, own in classes.items():
        names, on = {t for t, _ in own}, [k for k, _ in vector]
        one_order = len({tuple(t for t in orders[k] if t in names) for k in on}) == 1
        if len(own) >= 2 and one_order and sum((n or 0) * len(on) for _, n in own) <= 0.5 * sum(sizes[k] for k in on):
            texts |= {t for t, n in own if n is not None}
            tags |= {t for t, n in own if n is None}
    return texts, tags


def test_templates_agree_with_whole_vectors(spark, sf):
    t = pq.read_table(f"{sf}/pages.parquet")
    html_of = [re.sub("</?article>", "", h.replace(' class="ad"', "")) for h in t.column("html").to_pylist()]
    rows = [(f"host{k % 4}", h) for k, h in enumerate(html_of)]
    rows += [("rows", f"<table>{''.join(f'<tr><td>Label {j}<td>{k * j}' for j in range(k % 4))}</table><p>All of us</p><h6>End</h6><p>{'own words ' * 20}{k}") for k in range(30)] + [("rows", "<h6>End</h6><p>All of us</p>")] * 5
    got = {r["host"]: (set(r["texts"]), set(r["tags"])) for r in templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    for host in {h for h, _ in rows}:
        assert got.get(host, (set(), set())) == brute_template([h for name, h in rows if name == host]), host
    assert got["rows"][0]
