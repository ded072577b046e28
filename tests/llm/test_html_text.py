"""Main text by density: hand-written pages, a plain recursive version of the densities, pages that no parser likes."""

import math
import random
import time

import pytest
from ledgerflow.llm import html_text

WORDS = "Some words of a paragraph that goes on for a while, as they do. "
NAMES = ["post-content", "related-work", "search-results", "social-policy", "comment-piece", "sponsor-profile", "news-alert", "ad-hoc", "sharing-economy", "banner-story"]


def paragraphs(n, tag="p"):
    return "".join(f"<{tag}>{i}. {WORDS * 3}</{tag}>" for i in range(n))


def page(body):
    return f"<html><body><nav><a href=/>Home</a> <a href=/x>More</a></nav>{body}<footer>Imprint</footer></body></html>"


@pytest.mark.parametrize("name", [*NAMES, "comments", "article"])
def test_body_is_kept_whatever_its_name(name):
    text = html_text.main_text(page(f'<div class="{name}">{paragraphs(8)}</div>'))
    assert text.count("\n\n") == 7 and text.startswith("0. Some") and "Home" not in text and "Imprint" not in text


@pytest.mark.parametrize("name", ["ad", "ad-box", "comments", "comment_list", "sidebar", "cookie-notice", "newsletter signup"])
def test_what_names_itself_beside_goes(name):
    beside = f'<div class="{name}">Buy this. {WORDS}</div>'
    for body in (f"<div>{paragraphs(6)}</div>{beside}", f"{beside}<article><h1>Title</h1>{paragraphs(6)}</article>", f"<article>{paragraphs(6)}{beside}</article>"):
        text = html_text.main_text(page(body))
        assert "Buy this" not in text and "5. Some" in text and "0. Some" in text


def test_sections_of_one_article_stay_together():
    sections = "".join(f"<section><h2>Part {i}</h2>{paragraphs(n)}</section>" for i, n in enumerate((1, 7, 2, 5)))
    text = html_text.main_text(page(f"<main><h1>Title</h1>{sections}</main>"))
    assert [text.count(f"Part {i}") for i in range(4)] == [1] * 4 and text.count("0. Some") == 4 and text.startswith("Title")


def test_links_beside_are_no_content_and_headings_before_are():
    links = "".join(f'<li><a href="/{i}">A link to another story, number {i}</a></li>' for i in range(30))
    text = html_text.main_text(page(f"<div id=wrap><div><ul>{links}</ul></div><h1>Title</h1><div>{paragraphs(8)}</div><div><ul>{links}</ul></div></div>"))
    assert text.startswith("Title\n\n0. Some") and "another story" not in text and text.endswith("do.")


def random_tree(rng, depth=0):
    node = html_text.Node(rng.choice(["div", "p", "a", "b", "section", "span", "li"]))
    for _ in range(rng.randint(0, 4)):
        if depth < 4 and rng.random() < 0.6:
            child = random_tree(rng, depth + 1)
            child.parent = node
            node.parts.append(child)
        else:
            node.parts.append("word " * rng.randint(1, 30))
    return node


@pytest.mark.parametrize("seed", range(20))
def test_densities_equal_a_recursive_version(seed):
    root = random_tree(random.Random(seed))
    html_text._measure(root)
    below = lambda n: [x for y in n.children for x in (y, *below(y))]
    chars = lambda n: sum(len(x.replace(" ", "")) for x in n.parts if isinstance(x, str)) + sum(map(chars, n.children))
    links = lambda n: chars(n) if n.tag == "a" else sum(map(links, n.children))

    def density(n):
        c, lc = chars(n), links(n)
        t = max(1, sum(x.tag not in html_text.INLINE for x in below(n)))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + links(root) / max(1, chars(root)) * c + math.e)
        value = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, sum(x.tag == "a" for x in below(n))))) / math.log(max(base, 1.0001)))
        return max(value, c / t) if t == 1 and not lc else value

    total = lambda n: sum(total(x) if x.tag in html_text.INLINE else density(x) for x in n.children)
    for n in [root, *below(root)]:
        assert n.density == pytest.approx(density(n)) and n.total == pytest.approx(total(n))
    best = max((n for n in [root, *below(root)] if n is root or n.tag not in html_text.INLINE), key=total)
    assert html_text._largest(root).total == pytest.approx(total(best))


@pytest.mark.parametrize("text", [
    '<p a="x ' * 130_000, "<b>" * 20_000 + "</i>" * 200_000, "<b>" * 20_000 + "<p>x</p>" * 40_000, "<!--" * 200_000, "<" * 1_000_000, "<a href='" * 100_000,
    "<p/ = / " * 100_000, "<p a='b c" * 100_000 + ">", "<script></scrip " * 60_000, "&amp" * 250_000, "<!x" * 300_000])
def test_megabytes_of_broken_markup(text):
    began = time.process_time()
    html_text.main_text(text)
    assert time.process_time() - began < 4


def test_pages_without_text():
    for text in (None, "", " ", "<html></html>", "<nav>menu</nav>", "<script>x</script>", "<!-- x -->"):
        assert html_text.main_text(text) == ""
    assert html_text.main_text("just  text\n here") == "just text here"
    assert html_text.main_text("a < b and <unknown>c</unknown> &lt;p&gt;") == "a < b and c <p>"
