"""Main text: pages built from known articles, the given pages, broken markup."""

import html
import math
import random
import re

from plumbline.llm.html_extract import extract, extract_pages


def page(article, title="A headline of the page", tail=True):
    return (
        "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h2>Site name</h2></header><nav><ul><li><a href='/a'>Home</a><li><a href=/b>News</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies, always, on every page. Please accept.</div><!-- ad --><div class=\"ad\">Buy this now. Really, do.</div>"
        f"<article><h1>{title}</h1>{article}</article>"
        "<aside>Related, stories. More, here.</aside><form><label>Mail</label><input name=q><button>Go</button></form>"
        "<section id=comments><p>First, comment here. It is long, and has marks.</p></section>"
        + ("<footer>&copy; site &middot; About us.</footer></body></html>" if tail else "")
    )


def test_articles():
    r = random.Random(2)
    for n in range(60):
        paragraphs = [" ".join(r.choice(("le", "été", "of", "R&D", "a<b", "word", '"q"')) for _ in range(r.choice((1, 3, 30, 200)))) + r.choice((".", "", "!")) for _ in range(r.randint(2, 9))]
        article = "".join(r.choice(("<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>")).format(html.escape(p).replace(" ", r.choice((" ", "\n  ")))) for p in paragraphs)
        if max(map(len, paragraphs)) < 120:
            continue
        want = "\n".join(["A headline of the page", *paragraphs])
        assert extract(page(article, tail=n % 3 > 0)) == want


def test_broken_pages():
    assert extract("") == "" and extract("plain text") == "plain text"
    assert extract("<p>a<p>b &amp c<script>x") == "a\nb & c"
    assert extract("<p>a <!-- never closed") == "a" and extract("<p>x <div class='") == "x"
    assert extract("1 < 2 &lt; 3 &#233; &eacute;") == "1 < 2 < 3 é é"
    assert extract("<nav>only a menu</nav>") == ""
    assert extract("<p>a<br>b  c\n d</p>") == "a b c d"
    assert extract("<" * 50_000 + "a" + "<a \"" * 2000)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div)>", article)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks) if x)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want)


def test_small_table(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p>a</p>", 3), (3, "u", "<p>a</p>", 3), (None, "u", "<p>" + "x " * 100_000, 4)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert sorted((r.page_id or 0, r.text[:3], r.n_chars) for r in got) == [(0, "x x", 199_999), (1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1)]


PROSE = "A sentence of the article, with a comma. Another one follows it, and it is long enough to be read as prose. "


def test_ratios_choose_blocks():
    """Names are evidence only, link lists fall by their ratios, and nothing beside the largest container is lost."""
    article = f"<p>{PROSE * 3}</p>" * 4
    text = "\n".join([(PROSE * 3).strip()] * 4)
    assert extract(f"<div class='container has-sidebar'>{article}</div><div class='sidebar'><p>Short note.</p></div>") == text
    assert extract(f"<div class='post comments-open'><h1>Head</h1>{article}</div>") == "Head\n" + text
    assert extract(f"<div class='widget'>{article}</div>") == text
    links = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "Shop")) + "</ul>"
    assert extract(f"<article>{article}{links}{article}</article>") == text + "\n" + text
    assert extract(f"<div><h1>Head</h1><p>Lead.</p><div class='body'>{article}</div></div>") == "Head\nLead.\n" + text
    assert extract(f"<main><p>Lead of it.</p><article>{article}</article></main>") == "Lead of it.\n" + text
    assert extract(f"<article>{article}</article><div id='comments'><p>{PROSE * 20}</p></div>") == text
    items = "<ul>" + "<li>Milk</li><li>Eggs</li>" * 30 + "</ul>"
    assert extract(f"<article><h1><a href='/'>Head</a></h1>{article}{items}</article>") == "Head\n" + text + "\nMilk\nEggs" * 30
    inline = "<b>" * 30
    assert extract(f"<p>{inline}one<p>two") == "one\ntwo"
    assert extract("<div>" * 50_000 + "deep" + "<b>" * 50_000 + "<p>er") == "deep\ner"


def test_path_ratios_by_hand():
    """The scores of paths against a direct reading of the definition over path strings."""
    from plumbline.llm import html_extract as h

    source = f"<div><h1>Head</h1><p>{PROSE}<b>bold, text</b> and.</p><ul><li><a>Home</a><li><a>Shop</a><li>item</ul><p>{PROSE * 2}</p></div>"
    read = h._Page(source)
    nodes = [n for n in read.nodes if n[0].strip()]

    def name(p):
        out = []
        names = {v: k for k, v in read.paths.items()}
        while p:
            p, tag = names[p]
            out.append(tag)
        return out[::-1]

    paths = [name(n[2]) for n in nodes]
    fused = []
    for p in paths:
        own = [n[0] for n, q in zip(nodes, paths) if q == p]
        length = sum(len(x.strip()) for x in own) / len(own)
        fused.append((h.LINK if "a" in p else 1) * math.sqrt(length) * (1 + math.log1p(sum(len(re.findall(r"[.,;:!?]", x)) for x in own) / len(own))))
    gap = lambda p, q: len(p) + len(q) - 2 * next((k for k, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
    smooth = []
    for i, p in enumerate(paths):
        near = [(1 / (1 + abs(i - j) + gap(p, paths[j])), fused[j]) for j in range(len(paths)) if abs(i - j) <= h.SPREAD and ("a" in p) == ("a" in paths[j])]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    got = h.ratios(read, nodes, [False] * len(read.parent))
    for p, path in {n[2]: q for n, q in zip(nodes, paths)}.items():
        own = [s for s, q in zip(smooth, paths) if q == path]
        assert abs(got[p, False] - sum(own) / len(own)) < 1e-9


def test_no_semantic_tags_nor_names():
    """Without any telling tag or name: menus, boxes of short texts and notes fall by their ratios, short paragraphs stay."""
    r = random.Random(4)
    for n in range(40):
        paragraphs = [PROSE * r.randint(2, 5) if k % 3 else r.choice(("Short.", "A short one, too.", "So it goes")) for k in range(r.randint(4, 9))]
        article = "".join(f"<p>{x.strip()}</p>" for x in paragraphs)
        menu = "<ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(r.randint(4, 20))) + "</ul>"
        box = "<div><div>Log in</div><div>Subscribe now!</div></div>"
        note = "<div><div><span>Copyright, the site</span></div><div>Imprint</div></div>"
        head = f"<h1>Headline {n}</h1>"
        parts = [f"<div>{menu}</div>", box, f"<div>{head}{article}</div>", note] if n % 2 else [menu, box, f"<div><div>{head}<div>{article}</div></div></div>", note]
        source = "<html><body>" + "".join(parts) + "</body></html>"
        assert extract(source) == "\n".join([f"Headline {n}", *map(str.strip, paragraphs)]), source


def test_header_in_article_and_page_header():
    article = f"<p>{PROSE * 3}</p>" * 3
    text = "\n".join([(PROSE * 3).strip()] * 3)
    assert extract(f"<header><p>Site</p></header><article><header><h1>Headline</h1><p>Lead</p></header>{article}<table><tr><td>a</td><td>b</td></tr></table></article><footer>About us</footer>") == "Headline\nLead\n" + text + "\na\nb"
    assert extract(f"<div class='related-posts'>{article}</div><div>Log in</div>") == text


def test_empty_table(spark):
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
