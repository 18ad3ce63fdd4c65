"""Main text against a plain version: a parser of the standard library and a walk down the tree block by block."""

import re
import time
from html.parser import HTMLParser

import pytest

from sextant.llm import html_text

from ..conftest import data

NAMES = """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar
navigation newsletter notice pagination popup promo promotion related replies reply share sharing sidebar signup skip social sponsor sponsored
subscribe toolbar widget contentinfo complementary""".split()
BESIDE = "area bar block box container form item items link links list main page posts section site top user widgets wrap wrapper".split()
INLINE = "a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split()


class Blocks(HTMLParser):
    """Blocks of pages whose elements are closed, save for paragraphs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.said, self.links, self.raw = [], [], "", "", 0

    def end(self):
        text = " ".join(self.said.split())
        if text:
            aside = any(e or n for _, e, n in self.open)
            words = text.split()
            self.out.append((text, len(words), min(1.0, len(self.links.split()) / len(words)), aside))
        self.said = self.links = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.raw += 1
        elif tag == "br":
            self.handle_data(" ")
        elif tag in INLINE:
            self.open += [(tag, False, False)] * (tag == "a")
        elif tag != "meta":
            self.end()
            self.open = [o for o in self.open if o[0] not in ("a", *["p"] * (tag == "p"))]
            called = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().split()
            whole = [n for n in called if {*re.split("[-_]+", n)} & {*NAMES} and {*re.split("[-_]+", n)} <= {*NAMES, *BESIDE}]
            inside = any(o[0] in ("article", "main") for o in self.open)
            other = tag in "nav footer aside form button dialog menu fieldset".split() or tag == "header" and not inside
            self.open.append((tag, other, bool(whole)))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.raw -= 1
        elif tag == "a" and any(o[0] == "a" for o in self.open):
            self.open = [o for o in self.open if o[0] != "a"]
        elif tag not in INLINE:
            self.end()
            self.open = [o for o in self.open if o[0] != "a"]
            at = [k for k, o in enumerate(self.open) if o[0] == tag]
            if at:
                del self.open[at[-1] :]

    def handle_data(self, text):
        if not self.raw:
            self.said += text
            if any(o[0] == "a" for o in self.open):
                self.links += text


def plain_text(page):
    tree, parser = html_text.trained(), Blocks()
    parser.feed(page)
    parser.close()
    parser.end()
    kept, none = [], ("", 0, 0.0, False)
    for before, block, after in zip([none, *parser.out], parser.out, [*parser.out[1:], none], strict=False):
        x, node = [y for b in (block, before, after) for y in b[1:3]], 0
        while tree.feature[node] >= 0:
            node = (tree.left if x[tree.feature[node]] <= tree.limit[node] else tree.right)[node]
        if tree.share[node] >= 0.5 and not block[3]:
            kept.append(block[0])
    return "\n".join(kept)


def test_pages_of_the_sample_and_made_up_ones(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{data('sf0.01')}/pages.parquet").collect()]
    pages += [page for page, _ in html_text.labelled_pages(100, 99)]
    for page in pages:
        assert html_text.main_text(page, html_text.trained()) == plain_text(page)


def test_the_tree_uses_words_and_links_of_neighbours():
    used = set(html_text.trained().feature.tolist()) - {-1}
    assert {0, 1} <= used and used & {2, 3} and used & {4, 5}


def test_blocks_of_other_pages_are_told():
    """Pages made by the same rule from another seed: what each block is, is known."""
    right = total = 0
    for page, said in html_text.labelled_pages(150, 4321):
        got = html_text.main_text(page, html_text.trained()).split("\n")
        want = [text for text, good in said if good]
        total += len(said)
        right += len(said) - len(set(got) ^ set(want))
    assert right / total > 0.97


PROSE = "Some words that make up long prose, and more of them here. " * 8


@pytest.mark.parametrize("name", ["header-image", "post-share-notice content", "comments-off-main-text", "menu-of-the-day", "ad-hoc"])
def test_names_that_only_hold_such_a_word_keep_their_prose(name):
    page = f'<nav><a href="/">x</a></nav><h1>A title of a page</h1><p>{PROSE}</p><div class="{name}"><p>{PROSE}</p></div><p>The end.</p>'
    want = ["A title of a page", PROSE.strip(), PROSE.strip(), "The end."]
    assert html_text.main_text(page, html_text.trained()).split("\n") == want == plain_text(page).split("\n")


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "ad", "user comment", "related_posts", "nav-menu", "ad-box"])
def test_names_that_say_it_in_whole_do_not(name):
    page = f'<h1>A title of a page</h1><p>{PROSE}</p><div class="{name}"><p>{PROSE}</p></div><p>The end.</p>'
    assert html_text.main_text(page, html_text.trained()) == f"A title of a page\n{PROSE.strip()}\nThe end." == plain_text(page)
    story = f'<div class="{name}"><article><h1>A title of a page</h1><p>{PROSE}</p></article></div>'
    assert html_text.main_text(story, html_text.trained()) == f"A title of a page\n{PROSE.strip()}"


def test_short_titles_and_paragraphs_stay():
    page = "<h1>News</h1><p>Yes.</p><p>No.</p><ul><li><a href=1>One</a></li><li><a href=2>Two three</a></li></ul>"
    assert html_text.main_text(page, html_text.trained()) == "News\nYes.\nNo."


@pytest.mark.parametrize(
    "page",
    [
        '<form id="aspnetForm"><nav><a href="/">x</a></nav><article>{}</article></form>',
        "<form><fieldset><main>{}</main></fieldset></form>",
        '<nav><a href="/">x</a><main>{}</main>',
        '<nav><ul><li><a href="/">x</a></li></ul><article>{}</article>',
        '<main class="notice">{}</main>',
        '<div class="social main">{}</div>',
        '<div id="content" class="sidebar">{}</div>',
    ],
)
def test_articles_in_wrapping_elements_are_kept(page):
    assert html_text.main_text(page.format(f"<h1>A title of a page</h1><p>{PROSE}</p>"), html_text.trained()) == f"A title of a page\n{PROSE.strip()}"


@pytest.mark.parametrize("page", ["<aside><article>{}</article></aside>", "<footer><article>{}</article></footer>", '<article class="comment">{}</article>', "<form>{}</form>"])
def test_side_matters_stay_out(page):
    assert html_text.main_text(page.format(f"<p>{PROSE}</p>"), html_text.trained()) == ""


def test_linked_sentence_between_prose_is_kept():
    page = f'<article><h1>A title here</h1><p>{PROSE}</p><p>See <a href="1">the full report of the commission on water</a> for more.</p><p>{PROSE}</p></article>'
    assert html_text.main_text(page, html_text.trained()).split("\n")[2] == "See the full report of the commission on water for more."


@pytest.mark.parametrize("unit", ['<a "', "<svg ", "<div>", "</x>", '<a ">', "<a '\"", '<p class="', "<nav><p>", "<script>", '<a" "><a" "'])
def test_a_megabyte_of_odd_markup_takes_a_moment(unit):
    for page in (unit * (1_000_000 // len(unit)), unit * (500_000 // len(unit)) + "</y>" * 125_000, '<i ">' + unit * (1_000_000 // len(unit)) + '>"'):
        began = time.process_time()
        html_text.main_text(page, html_text.trained())
        assert time.process_time() - began < 6


def test_a_quote_that_is_never_closed():
    page = f'<p>{PROSE}</p><p class="x>{PROSE}</p><p>Last words here.</p>'
    assert html_text.main_text(page, html_text.trained()) == f"{PROSE.strip()}\n{PROSE.strip()}\nLast words here."
