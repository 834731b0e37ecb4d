"""Chat formatting and HTML extraction."""

import hashlib
import time

import pytest

from campaignlens.llm import chat, html, queries


def test_chat_round_trip_and_mask(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\\b<|im_start|>\n<"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, "x"), (3, 1, "we\nird<|", "|>\\"), (None, 0, "system", "s"), (1, 2, "user", ""), (1, 3, "assistant", "é👍")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("Formatted", chat.F.lit(0)).repartition(3)
    made = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.read_chats(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "hi <|im_end|>"), ("assistant", "a\\b<|im_start|>\n<"), ("user", ""), ("assistant", "é👍")]
    assert back[1].loss_text == "a\\b<|im_start|>\n<é👍" and back[1].valid and not back[2].valid and back[2].loss_text == ""
    assert [(t.role, t.text) for t in back[3].turns] == [("", "x"), ("we\nird<|", "|>\\")] and back[None].loss_text == ""
    for r in made.collect():
        assert r.formatted.count("<|im_start|>") == len(back[r.conv_id].turns)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_the_machine_judges_the_order_of_roles(spark):
    orders = {1: "sua", 2: "uaua", 3: "au", 4: "suu", 5: "ua" + "s", 6: "u", 7: "ssua", 8: "sa", 9: "xua"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(k, i, names[c], "t") for k, order in orders.items() for i, c in enumerate(order)]
    got = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()
    assert {r.conv_id for r in got if r.valid} == {1, 2}


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>About us and more</a></ul></nav>
<div class="cookie-banner">We use cookies on this site, please accept all of them now.</div>
<div id=main><article><h1>Title &amp; more</h1><p>First <b>para</b>graph&nbsp;with  words and so on, quite long to be sure.<p>Short.
<aside>Read also this other very long article about something else entirely.</aside>
<div class="ad">Buy now! Buy now! Buy now! Buy now!</div><form><label>Mail</label><input></form>
<p>Second paragraph is long enough as well, with &lt;tags&gt; in it &#233;.</article>
<section class="comments"><p>Great article, I liked it very much, thanks for it!</p></section></div>
<div class=sidebar><p>Popular: a long list of other things that people read here.</p></div><footer>&copy; all rights</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more First paragraph with words and so on, quite long to be sure. Short. Second paragraph is long enough as well, with <tags> in it é."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == html.main_text("<nav>a</nav>") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<p>a < b &am &unknown; <![x]> <3") != ""
    assert len(html.main_text("<p>" + "word " * 200_000)) == 999_999


def test_html_query(spark, sf_dir):
    got = queries.op6_html_extraction(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        article = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        plain = html.re.sub("<[^>]*>", "", html.re.sub("</?p>|</h1>|<br>", " ", article))
        assert r.text == " ".join(__import__("html").unescape(plain).split()) and r.n_chars == len(r.text)


def test_main_text_drops_nothing_of_the_article():
    long = "word " * 400
    assert html.main_text(f"<body><nav><a href=/>Home</a></nav><article><p>lead</p><blockquote>{long}</blockquote><p>end</p></article></body>") == f"lead {long}end"
    for tag in ("section", "div", "ul", "table"):
        row = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(tag, "{}").format(long)
        assert html.main_text(f"<body><div><p>short one</p><{tag}>{row}</{tag}><p>short two</p></div></body>") == f"short one {long}short two", tag
    assert html.main_text(f"<article><h1><a href=/x>Linked title</a></h1><p>{long}</p><p><a href=/y>One whole link</a></p><ul><li>plain</li><li><a href=/z>linked item</a></li></ul></article>") == f"Linked title {long}One whole link plain linked item"
    assert html.main_text(f"<body><div><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></div><div><p>{long}</p></div></body>") == long.strip()
    assert html.main_text(f"<article><p>{long}</p><ul><li><a href=/a>Source one</a></li><li><a href=/b>Source two</a></li></ul></article>") == f"{long}Source one Source two"
    assert html.main_text(f"<main><p>{long}</p><ol><li><a href=/a>Source one</a></li><li><a href=/b>Two</a></li></ol><p>{long}</p></main>") == f"{long}Source one Two {long}".strip()


TEXT = "Somewhat long sentences of the story stand here, one after the other, until the end of the line comes. "
FLAT = (
    "<body><p>Accept all?<p><a href=/>Start</a><p><a href=/b>Weather</a><p><a href=/c>Sports</a><p>Today<p>Monday<p>1 May<p>Edition<p>Page 1<p>North"
    + "<h1>What happened</h1>" + f"<p>{TEXT * 3}<p>Short one.<p>{TEXT * 4}<p>Why?<p>{TEXT * 2}" + "<p>No rights<p>Imprint<p>Made in Spring<p>v2<p>Top<p>Help<p>Jobs<p>Press</body>"
)


def test_the_method_selects_on_pages_without_telling_names(monkeypatch):
    got = html.main_text(FLAT)
    want = f"What happened {TEXT * 3}Short one. {TEXT * 4}Why? {TEXT * 2}"
    assert want.strip() in got and not any(x in got for x in ("Accept", "Weather", "Monday", "Page", "Made", "Jobs"))
    monkeypatch.setattr(html, "threshold", lambda values: -1.0)  # every line is content
    assert "Weather" in html.main_text(FLAT) or "Imprint" in html.main_text(FLAT)
    monkeypatch.undo()
    monkeypatch.setattr(html, "smoothed", lambda values: values)  # lines stand for themselves
    assert "What happened" not in html.main_text(FLAT)


def test_marks_are_a_feature_only():
    assert html.main_text(f"<body><div class=sidebar><nav><a href=/>Home</a></nav><p>{TEXT * 3}</p><p>Short.</p></div></body>") == f"{TEXT * 3}Short."
    assert html.main_text(f"<article><p>{TEXT}<p class=advert>Buy this now, it is very good and cheap!<p>{TEXT}</article>") == f"{TEXT}{TEXT}".strip()
    assert html.main_text(f"<body><div><p>{TEXT * 2}</div><div class=comments>" + "<p>I do not like what they say here at all, and that for years!" * 30 + "</div>") == (TEXT * 2).strip()
    assert html.main_text(f"<article><p>{TEXT}and <span class=ad>Ad</span><span hidden>x</span>more.<p>{TEXT}</article>") == f"{TEXT}and more. {TEXT}".strip()
    assert html.main_text("<ul><li><a href=/>Home</a><li><a href=/b>About</a></ul>") == "" == html.main_text("<!-- <p>text</p>")
    assert html.main_text("<article><p>text<a ") == html.main_text("<article><p>text<!-- x") == "text"


def test_main_text_in_linear_time():
    pages = ("<div>x" * 100_000, "<a " * 250_000, "<div>" * 50_000 + "</td>" * 100_000, "<!-- " * 200_000 + ">", "<![CDATA[" * 100_000 + ">", '<a b="' * 150_000 + ">", "<3" * 400_000, "<ul><li><a href=x>y</a>" * 25_000)
    for page in pages:
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 6, page[:20]


def test_sections_named_by_their_subject_stay():
    from campaignlens.llm.html import main_text

    page = lambda name: (
        f"<body><div class='nav'><a href=x>a</a><a href=y>b</a></div><div class='content'><p>{'Lead words of the article. ' * 8}</p>"
        f"<section class='{name}'><p>{'Work that others did on this. ' * 6}</p></section><p>{'End of the article. ' * 6}</p></div></body>"
    )
    for name in ("related-work", "legal-history", "searchAlgorithms", "social_structure", "methods"):
        assert "others" in main_text(page(name)), name
    for name in ("related-posts", "search-box", "share-buttons", "sidebar-x7", "newsletter", "related", "legal notice"):
        assert "others" not in main_text(page(name)), name
