import pytest

from tidemark.llm import templates

PAGE = """<!DOCTYPE html><html><head><title>T {k}</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/{k}">Home {k}</a></li><li>About</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head&amp;line {k}</h1><p>First <b>bold</b>
 words &#8212; {k}.<br>more<p>Second &lt;para&gt; {k}<div class="ad">Buy {k}</div><form><input value=1><label>Name</label></form><ul><li>item a</li><li>item b</li></ul></article>
<section id="comments"><p>Reader says {k}</p></section><aside>Side {k}</aside><footer>&copy; me</footer></body></html>"""
WANT = "Head&line {k}\nFirst bold words — {k}. more\nSecond <para> {k}\nitem a\nitem b"


def test_article_of_each_page(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k))) for k in range(6)] + [(10, "http://lone.example/x", PAGE.replace("{k}", "x")), (11, None, None), (12, "http://h.example/e", ""), (None, "http://h.example/n", "plain text"), (3, "http://h.example/3", PAGE.replace("{k}", "3"))]
    out = templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out}
    for k in [*range(6), 10]:
        assert got[k]["text"] == WANT.replace("{k}", "x" if k == 10 else str(k))
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[11]["text"] == got[12]["text"] == "" and got[None]["text"] == "plain text"
    assert templates.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_template_text_outside_an_article_goes(spark):
    page = "<body><div><p>Welcome to our site</p></div><div><p>Story number {k} about {k}</p></div><div><p>Call us today</p></div></body>"
    rows = [(k, f"http://t.example/{k}", page.replace("{k}", "abcdefgh"[k])) for k in range(8)]
    out = templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Story number {c} about {c}" for c in "abcdefgh"}


def test_unclosed_article_and_markup():
    page = templates.tokens("<html><body><article><p>One<p>Two<footer>no</footer>")
    assert templates.extract(page, None) == "One\nTwo"
    assert templates.extract(templates.tokens("<p>a < b and c</p><!-- never ends"), None) == "a < b and c"


def texts_of(page, n=8):
    pages = [templates.tokens(page.replace("{k}", "abcdefgh"[k])) for k in range(n)]
    template = templates.deduce(pages) if n >= templates.SUPPORT else None
    main = templates.main_element(pages, template) if template else None
    return [templates.extract(p, template, main) for p in pages]


def test_template_text_inside_an_article_goes():
    page = "<body><nav>Top</nav><article><h1>Head {k}</h1><p>Tell your friends</p><p>Story {k}</p><p>More {k}</p><div>Made with care</div></article></body>"
    assert texts_of(page) == [f"Head {c}\nStory {c}\nMore {c}" for c in "abcdefgh"]
    assert texts_of(page, 1) == ["Head a\nTell your friends\nStory a\nMore a\nMade with care"]


def test_notice_on_some_pages_inside_an_article_goes():
    page = "<body><article><p>Story {k}</p>{n}<p>End {k}</p></article></body>"
    pages = [templates.tokens(page.replace("{k}", c).replace("{n}", "<p>Closed on Monday</p>" if c < "i" else "")) for c in "abcdefghi"]
    template = templates.deduce(pages)
    assert [templates.extract(p, template, templates.main_element(pages, template)) for p in pages] == [f"Story {c}\nEnd {c}" for c in "abcdefghi"]


def test_equal_pages_are_not_their_own_template(spark):
    page = "<body><article><p>One story</p></article></body>"
    out = templates.main_text(spark.createDataFrame([(k, f"http://c.example/{k}", page) for k in range(6)], "page_id bigint, url string, html string")).collect()
    assert [r["text"] for r in out] == ["One story"] * 6


def test_cards_do_not_hide_the_main_text():
    cards = "<article><p>See {k}1</p></article><article><p>See {k}2</p></article>"
    page = "<body><div><p>A long story about {k} that goes on and on</p><p>and on about {k}</p></div>" + cards + "</body>"
    want = [f"A long story about {c} that goes on and on\nand on about {c}" for c in "abcdefgh"]
    assert texts_of(page) == want and texts_of(page, 2) == want[:2]


def test_names_of_wrappers_do_not_drop_the_article():
    for outer in ('<body class="has-sidebar">', '<body><div class="header-fixed">', '<body><main class="no-sidebar">', '<body><div id="with-nav"><div class="right-sidebar">', '<body><main>Here {k}<div class="with-nav">'):
        page = outer + '<div class="sidebar">Side {k}</div><article class="post tag-social"><p>Story of {k} and more</p></article><section class="comments"><article><p>Yes {k}</p></article></section>'
        for n in (1, 8):
            assert [t.removeprefix(f"Here {c}\n") for t, c in zip(texts_of(page, n), "abcdefgh", strict=False)] == [f"Story of {c} and more" for c in "abcdefgh"[:n]]


def test_layout_words_on_body_without_an_article():
    assert texts_of('<body class="no-sidebar"><p>Plain {k}</p></body>', 1) == ["Plain a"]


def random_site(seed, n=9):
    """Pages of a random nested template without roles, articles or names; the texts of its slots are what must remain."""
    import random

    rng = random.Random(seed)
    count = iter(range(100_000))

    def block(depth):
        """A list of parts: fixed markup and texts, or a slot."""
        parts = []
        for _ in range(rng.randint(2, 4)):
            kind = rng.random()
            if kind < 0.35:
                parts.append(f"<p>Fixed words {next(count)} of {seed}</p>")
            elif kind < 0.7 or depth == 0:
                parts.append(None)
            else:
                k = next(count)
                parts += [f'<div data-k="{k}"><section>', *block(depth - 1), "</section></div>"]
        return parts

    template = [f"<div><h2>Site {seed}</h2>", *block(2), "</div>"]
    pages, wanted = [], []
    for page in range(n):
        html, texts = [], []
        for j, part in enumerate(template):
            if part is None:
                for _ in range(rng.randint(1, 3)):
                    text = f"Own text {page} {j} {next(count)}"
                    html.append(f"<p>{text}</p>")
                    texts.append(text)
            else:
                html.append(part)
        pages.append("<body>" + "".join(html) + "</body>")
        wanted.append("\n".join(texts))
    return pages, wanted


def plain_template_texts(pages):
    """Texts with enough support, found by comparing the occurrence vectors of all pairs."""
    import re
    from collections import Counter

    found = [Counter(re.findall(r"<(?:p|h2)>([^<]*)", p)) for p in pages]
    texts = sorted({t for c in found for t in c})
    vectors = {t: tuple(c[t] for c in found) for t in texts}
    classes = {t: {u for u in texts if vectors[u] == vectors[t]} for t in texts}
    return {u for t in texts if sum(v > 0 for v in vectors[t]) >= max(templates.SUPPORT, (len(pages) + 1) // 2) for u in classes[t]}


def test_random_templates_against_plain_classes():
    for seed in range(25):
        pages, wanted = random_site(seed)
        tokens = [templates.tokens(p) for p in pages]
        template = templates.deduce(tokens)
        assert {key[1] for key, _ in template.tokens if key[0] == "t"} == plain_template_texts(pages)
        assert [templates.extract(t, template) for t in tokens] == wanted


def test_long_page_nulls_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    body = "".join(f"<p>Line {k} of the long story</p>" for k in range(20_000))
    rows = [(k, f"http://l.example/{k}", f"<body><div>Menu</div><article>{body if k == 0 else f'<p>Short {k}</p>'}</article></body>") for k in range(5)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("host", "part", "parts", "n", "text", "n_chars")])
    got = {r["page_id"]: r["text"] for r in templates.main_text(df).collect()}
    assert got[0].count("\n") == 19_999 and got[0].endswith("Line 19999 of the long story") and got[3] == "Short 3" and got[None] == ""


def plain_site(rng, pages, named):
    """Pages without any role, their layers in div elements alone; named: with tags of roles instead."""
    nav, main, foot = ("nav", "article", "footer") if named else ("div", "div", "div")
    word = lambda n: " ".join(rng.choice(["alo", "bera", "cinu", "dofe", "guma"]) + str(rng.randint(0, 99)) for _ in range(n))
    out, wanted = [], []
    for _ in range(pages):
        title, body = word(5), [word(rng.randint(8, 30)) for _ in range(rng.randint(3, 9))]
        advert, links = word(4), [word(1) for _ in range(rng.randint(2, 5))]
        menu = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in links)
        text = "".join(f"<p>{p}</p>" for p in body)
        out.append(f"<html><head><title>{title}</title></head><body><{nav}><ul>{menu}</ul></{nav}><div>{advert}</div><{main}><h1>{title}</h1>{text}</{main}><{foot}>&copy; site, {word(2)}</{foot}></body></html>")
        wanted.append("\n".join([title, *body]))
    return out, wanted


@pytest.mark.parametrize("named", [False, True])
def test_slots_find_the_main_text_without_roles(spark, named):
    """Nothing but the template tells the layers of pages without roles apart; it finds the same text as roles do."""
    import random

    site, wanted = plain_site(random.Random(4), 30, named)
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", x) for i, x in enumerate(site)], "page_id long, url string, html string")
    assert [r.text for r in templates.main_text(pages).orderBy("page_id").collect()] == wanted
    alone = [templates.extract(templates.tokens(x), None) for x in site]
    assert (alone == wanted) == named
