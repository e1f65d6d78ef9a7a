import random
import time

from tests.llm.helpers import rows
from weftline.llm.html_text import WINDOW, extract_text, main_text, stretches

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body class="has-sidebar">
<header>Site head</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad box">Buy!</div><div id="cookie-notice">We use cookies<form>Mail <input></form></div>
<div class="content-wrapper"><article class="post"><h1>Title &amp; more</h1><p>One <b>bo</b>ld   line<br>next&nbsp;line<p>Short.<p><a href="x">only a link</a><aside>side</aside>
<ul><li>a<li>b</ul><!-- no --><div class="related">other posts</div><p>End &lt;x&gt; caf&#233;.</article></div>
<section class="comments"><article>reader says</article></section><footer>foot</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more One bold line next line Short. only a link a b End <x> café."


def test_without_article():
    page = "<body><div class='menu'><a>Home</a> <a>More</a></div><div><a>l1</a></div><div><a>l2</a></div><div><a>l3</a></div><h2>Head</h2><p>First long paragraph.</p><p>Second.</p><div><a>l4</a></div><div><a>l5</a></div><div><a>l6</a></div><div><p>tail</p></div><div class=footer>x</div>"
    assert main_text(page) == "Head First long paragraph. Second. tail"


def test_every_stretch_without_article():
    links = "<ul><li><a>l1</a></li><li><a>l2</a></li><li><a>l3</a></li></ul>"
    assert main_text(f"<body><p>A first paragraph.</p>{links}<p>A second paragraph, longer.</p>{links}<p>Last words here.</p></body>") == "A first paragraph. A second paragraph, longer. Last words here."
    assert main_text("<body><p><a>Before</a></p><p>Some text.</p><p><a>Source</a></p></body>") == "Before Some text. Source"
    assert main_text("<body><p><a>only</a></p></body>") == "" and main_text(f"<body>{links}<p>tiny</p>{links}</body>") == "tiny"


def test_short_stretches_without_article():
    links = "<ul><li><a>l1</a></li><li><a>l2</a></li><li><a>l3</a></li></ul>"
    assert main_text(f"<body><p>Hi you.</p>{links}<p>A longer paragraph follows here.</p></body>") == "Hi you. A longer paragraph follows here."


def test_long_pages_take_linear_time():
    for page in ("<a " * 350_000, "<div>" * 100_000 + "</p>" * 100_000, "<foo>" * 100_000 + "<td>x" * 100_000, "<b>" * 50_000 + "<div>" * 50_000 + "</b>" * 50_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 20  # minutes, if a tag were sought to the end of the page each time
    assert main_text("<article><p>A paragraph.</p></article> a < b <!-- <p>no") == "A paragraph."


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert main_text('<p title="a>b">x</p><p title="y>z') .startswith("x")
    assert main_text("<article>" + "<p>w</p>" * 5000 + "</article>") == " ".join(["w"] * 5000)
    assert main_text("<article><div class='advert'>no<p>yes?</div><p>yes") == "yes"


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "0 as text", "1 as n_chars")
    got = rows(extract_text(df), "page_id", "text", "n_chars")
    want = main_text(PAGE)
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert extract_text(df.limit(0)).count() == 0


def test_names_of_text_elements():
    page = "<article><div class='post-header'><h1 class='menu-title'>T</h1></div><p class='notice-period'>Three months.</p><p class='advert'>Buy</p><p hidden>gone</p><p style='color:red; display: none'>gone</p><p title='hidden'>Seen.</p></article>"
    assert main_text(page) == "T Three months. Seen."


def test_dense_text_outside_a_teaser():
    prose = "<div><p>" + "</p><p>".join(["A long paragraph of the story that goes on and on."] * 4) + "</p></div>"
    teaser, full = "<article><p>Read it.</p></article>", "<article>" + prose + "</article>"
    assert main_text(f"<body>{teaser}{prose}</body>").startswith("Read it. A long") and main_text(f"<body>{teaser}{prose}</body>").count("story") == 4
    assert main_text(f"<body>{full}<div><p>Next story, out tomorrow.</p></div></body>").count("tomorrow") == 0
    assert main_text(f"<body>{prose}<ul><li><a>l</a><li><a>l</a><li><a>l</a></ul><div>(c) us</div></body>").endswith("goes on and on. (c) us")


def test_stretches_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        weights = [rng.choice([0, 0, 0, 1, 5, 12]) for _ in range(rng.randrange(0, 14))]
        least = rng.choice([1, 6, 10, 20])
        n = len(weights)
        quiet = [any(0 <= s and s + WINDOW <= n and sum(weights[s : s + WINDOW]) == 0 for s in range(k - WINDOW + 1, k + 1)) for k in range(n)]
        want = set()
        for a in range(n):
            for b in range(a + 1, n + 1):
                whole = not any(quiet[a:b]) and (a == 0 or quiet[a - 1]) and (b == n or quiet[b])
                if whole and max(sum(weights[max(a, s) : min(b, s + WINDOW)]) for s in range(a - WINDOW + 1, b)) >= least:
                    want.add((a, b))
        assert set(stretches(weights, least)) == want


def test_names_that_are_subjects():
    for name in ("share-price", "related-work", "comment-on-law", "social-policy", "menu-of-the-day", "ad-hoc-networks", "notice_of_motion"):
        for key in ("class", "id"):
            assert main_text(f'<article><p>Before.</p><div {key}="{name}"><p>Of the matter.</p></div><p>After.</p></article>') == "Before. Of the matter. After."
        assert main_text(f'<body><div class="{name}"><p>Of the matter.</p></div></body>') == "Of the matter."
    for name in ("share-buttons", "related posts", "related-posts", "comments-section", "social_links", "menu-2", "ad", "ad-slot-3", "google-ads", "cookie-law-info", "promo-banner", "responses", "reader-responses", "alertbox"):
        assert main_text(f'<article><p>Before.</p><div class="{name}"><p>Not this.</p></div><p>After.</p></article>') == "Before. After."
        assert main_text(f'<body><div class="{name}"><p>Not this.</p></div><p>But this.</p></body>') == "But this."


def test_names_around_an_article():
    talk = "<p>" + "</p><p>".join(["A reader says a lot about it, and at length."] * 9) + "</p>"
    for name in ("discussion", "legal", "privacy", "site-legal", "alertbox", "responses"):
        assert main_text(f'<body><article><p>Short news.</p></article><section id="{name}">{talk}</section></body>') == "Short news."
    assert main_text(f'<article><p>Method.</p><section id="discussion">{talk}</section></article>').count("at length") == 9
    assert main_text('<body><main id="legal"><p>Terms.</p></main></body>') == "Terms."
