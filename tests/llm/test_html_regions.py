"""Class words mark what stands beside the text, not the page."""

import pytest

from timbral.llm.html_text import main_text

TEXT = "This is the text of the page and it has all of the words that are in a long passage which you would read, " * 3
TEXT = TEXT.strip()


@pytest.mark.parametrize(
    "page",
    [
        "<html class='no-header'><body class='single no-sidebar'><p>{}</p></body></html>",
        "<body class='sidebar'><p>{}</p></body>",
        "<main class='with-sidebar'><p>{}</p></main>",
        "<main class='search'><p>{}</p></main>",
        "<article class='post has-share'><p>{}</p></article>",
        "<article class='comment'><p>{}</p></article>",
        "<div id='page' class='header-image'><p>{}</p></div>",
        "<div class='sidebar'><main><p>{}</p></main></div>",
        "<div class='social'><div><article><p>{}</p></article></div></div>",
    ],
)
def test_page_is_kept(page):
    assert main_text(page.format(TEXT)) == TEXT


@pytest.mark.parametrize(
    "aside",
    ["<div class='ad'><p>{}</p></div>", "<div class='left-sidebar'><p>{}</p></div>", "<div class='widget-area'><p>{}</p></div>", "<div id='comments'><article class='comment'><p>{}</p></article></div>", "<nav><p>{}</p></nav>", "<aside><article><p>{}</p></article></aside>"],
)
def test_asides_are_left_out(aside):
    assert main_text(f"<div id='page'><article><p>{TEXT}</p></article>{aside.format('It is beside ' + TEXT)}</div>") == TEXT
