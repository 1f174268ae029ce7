"""Main text of pages."""

import pytest

from inspectlake.llm.extraction import extract, main_text

PROSE = "A sentence of some length, with a comma. And another one follows it here, as prose does."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<html><head><title>t</title></head><body></body></html>", ""),
        (f"<p>{PROSE}</p>", PROSE),
        (f"<body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>T &amp; U</h1><p><b>{PROSE}<br><p>x\n  y</article><footer>&copy; z</footer>",
         f"T & U {PROSE} x y"),
        (f"<article><p>{PROSE}</p><div class='comments'><p>Reader says, quite long, indeed.</p></div><aside>s</aside></article>", PROSE),
        (f"<article><script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>on<b>e</b> two</p><p>{PROSE}</p>", f"one two {PROSE}"),
        (f"<body><div class=cookie-notice>We use cookies, please agree.</div><div id=main><h2>Head</h2><p>{PROSE}</p><p>Short.</p></div>"
         "<form>name<input></form></body>", f"Head {PROSE} Short."),
        (f"<article><p>{PROSE}</p><p>cut &am", f"{PROSE} cut &am"), (f"<article><p>{PROSE}</p><p>cut<a href='x", f"{PROSE} cut"),
        (f"<div class='content no-sidebar'><p>{PROSE}</p></div>", PROSE),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


CARD = "A teaser of some other page, with a comma."


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div class=body>" + f"<p>{PROSE}</p>" * 30 + f"</div><article class=card><p>{CARD}</p></article>", " ".join([PROSE] * 30 + [CARD])),
        (f"<div><article><h2>One</h2><p>{PROSE}</p><p>{PROSE}</p></article><article><h2>Two</h2><p>Short.</p></article><article><p>{PROSE}</p></article></div>",
         f"One {PROSE} {PROSE} Two Short. {PROSE}"),
        (f"<main><h1>Head</h1><article><p>{PROSE}</p></article></main>", f"Head {PROSE}"),
    ],
)
def test_articles_do_not_hide_what_passes(html, text):
    assert main_text(html) == text


LINK = "<a href=x>Link</a>"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div><p title='a hidden gem' data-x=\"aria-hidden=true\">{PROSE}</p></div>", PROSE),
        (f"<div class='md:flex hidden x'><p>{PROSE}</p></div>", PROSE),
        (f"<div><p hidden>No.</p><p aria-hidden='true'>No.</p><p style='color:red;display: none'>No.</p><p>{PROSE}</p></div>", PROSE),
        ("<article>" + f"<div class='elementor-widget t'><p>{PROSE}</p></div>" * 8 + "</article>", " ".join([PROSE] * 8)),
        ("<div>" + f"<div class='elementor-widget a'><h2>Head</h2></div><div class='elementor-widget text'><p>{PROSE}</p></div>" * 4 + "</div>",
         " ".join([f"Head {PROSE}"] * 4)),
        (f"<div class=section-header><p>{PROSE}</p><p>{PROSE}</p></div><div class=related-x><p>{PROSE}</p></div><div>{LINK}</div>",
         " ".join([PROSE] * 3)),
        (f"<body><form action=x><header>Top</header><div><h1>Head</h1><p>{PROSE}</p></div><input><form>n</form></form></body>", f"Head {PROSE}"),
        (f"<body><form><label>Your name</label><input></form><div><p>{PROSE}</p></div></body>", PROSE),
        ("<article>" + f"<p>{PROSE}</p>" * 9 + f"<div class=comments>{f'<div class=comment><p>{PROSE}</p></div>' * 4}</div></article>", " ".join([PROSE] * 9)),
        ("<article>" + f"<p>{PROSE}</p>" * 9 + f"<div class=newsletter><p>{PROSE}</p></div></article>", " ".join([PROSE] * 9)),
    ],
)
def test_hints_do_not_remove_the_article(html, text):
    assert main_text(html) == text


def test_long_pages_are_not_cut():
    html = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert main_text(html) == " ".join([PROSE] * 5000)
    assert main_text("<div>" * 5000 + PROSE) == PROSE


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, f"<p>{PROSE}</p>", "old"), (1, f"<p>{PROSE}</p>", "old"), (2, None, None)], "page_id long, html string, text string")
    out = extract(pages)
    assert out.columns == ["page_id", "html", "text"]
    assert sorted(r.text for r in out.collect()) == ["", PROSE, PROSE]
    assert extract(pages.limit(0)).count() == 0
