"""Layout wrappers with a name of boilerplate around the main text."""

import pytest

from kinsift.llm import html_extract


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<div class='content has-sidebar'><article><p>a</p></article></div>", ["a"]),
        ("<div id='no-sidebar'><div class='ad-free'><main>a<div class='ad'>b</div></main></div></div>", ["a"]),
        ("<div class='has-sidebar'><article>a<section class='comments'><article>c</article></section></article></div>", ["a"]),
        ("<article>a<div class='ad'>b</div></article><div class='sidebar'>c</div>", ["a"]),
        ("<aside><div class='widget'><article>t</article></div></aside><article>a</article>", ["a"]),
    ],
)
def test_wrappers_of_the_main_text(page, wanted):
    assert [t for zone, t in html_extract.blocks(page) if zone == html_extract.CORE] == wanted
