"""Extraction: long attributes, marked containers, articles beside the main text."""

import time

from tessera.llm import html_lines


def test_long_quoted_values():
    prose = "<p>" + "word " * 40 + "end</p>"
    for filler in ("x>" * 3000, "<b>y</b>" * 1000, "'<svg>" * 700, "=" * 5000, " <b class='z' id=q>" * 300):
        for page in (f'<body><div class="sidebar" data-x="{filler}"><p>{"side " * 40}</p></div><article data-y="{filler}">{prose}</article></body>',
                     f'<body><div data-x="{filler}" class="advert"><p>{"side " * 40}</p></div><article><img src="{filler}">{prose}</article></body>',
                     f'<body><script data-x="{filler}">side</script><article>{prose}</article></body>'):
            assert html_lines.page_text(page) == " ".join(["word"] * 40 + ["end"])
    inner = "<i class='sidebar'>" * 100
    assert html_lines.page_text(f'<article><div data-x="{inner}">{prose}</div></article>').endswith("word end")
    assert html_lines.page_text('<article><p title="a"">one "two" three</p><a href="x>four</a><p>five</p></article>').startswith('one "two" three')


def test_scan_of_unclosed_values_is_linear():
    for evil in ('<a b="' * 50000, "<a b='\"" * 50000, '<a b="<a c=\'' * 30000, '<a b="<a" ' * 50000, "<a " + "= " * 100000, '<a b="\'>' * 50000 + "<"):
        began = time.process_time()
        html_lines.page_text(evil)
        assert time.process_time() - began < 5


def prose(word, n=40):
    return f"<p>{(word + ' ') * n}</p>"


def test_marked_containers_are_weighed():
    for name in ("content with-sidebar", "has-comments", "top", "search", "related-work"):
        page = f'<body><div class="menu"><a href=x>Home</a></div><div class="{name}">{prose("main") * 4}<div class="sidebar">{prose("side", 9)}</div></div></body>'
        text = html_lines.page_text(page)
        assert text.split() == ["main"] * 160, name
        page = f'<body><div class="{name}"><article>{prose("main") * 4}</article><div class="comments">{prose("nice")}</div></div>{prose("after", 9)}</body>'
        assert html_lines.page_text(page).split() == ["main"] * 160, name
    page = f'<article>{prose("main") * 4}<section class="related-work">{prose("work", 30) * 3}</section><div class="related-posts"><a href=x>More</a></div><div class="ad">{prose("buy")}</div></article>'
    assert html_lines.page_text(page).split() == ["main"] * 160 + ["work"] * 90
    page = f'<body><form id=aspnet><div class="sidebar">{prose("side")}</div><div>{prose("main") * 4}</div></form></body>'
    assert html_lines.page_text(page).split() == ["main"] * 160


def test_text_after_a_dropped_article_stays_dropped():
    page = f'<body><article>{prose("main") * 4}</article><aside><article>{prose("card", 5)}</article>{prose("side", 9)}</aside></body>'
    assert html_lines.page_text(page).split() == ["main"] * 160


def test_advert_larger_than_a_short_article():
    page = f'<body><div class="ad">{"buy " * 21}</div><article><h1>Head.</h1><p><b>Head.<br></article><footer>f</footer></body>'
    assert html_lines.page_text(page) == "Head. Head."


def test_teaser_card_beside_the_main_text():
    page = f'<body><div>{prose("main") * 5}</div><article><p>card</p></article></body>'
    assert html_lines.page_text(page).split()[:200] == ["main"] * 200
    links = "".join(f"<li><a href=r{i}>reference {i}</a></li>" for i in range(6))
    page = f'<article>{prose("main")}<ol>{links}</ol>{prose("end")}</article>'
    assert html_lines.page_text(page).count("reference") == 6


def test_deep_marked_containers_are_linear():
    for evil in ('<div class="ad">' * 50000 + "x", '<div class="ad"><p>x' * 30000, '<article><div class="ad">x' * 20000 + "</article>" * 20000):
        began = time.process_time()
        html_lines.page_text(evil)
        assert time.process_time() - began < 5
