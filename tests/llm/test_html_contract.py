"""Pages whose parts lengths or names alone would misjudge, and the ratios in a plain form."""

import math
from collections import defaultdict

import pytest

from lodestone.llm import html_text as M

NAV = "<nav><a href=/>Home</a> <a href=/x>News</a></nav>"
TALKS = "".join(f"<p>I wholly disagree with point {i}, and I said so last year as well; nobody listened.</p>" for i in range(8))
PARTS = ["The old mill was rebuilt in spring, after two years of work.", "It now grinds flour again, twice a week."]
TEXT = "".join(f"<p>{p}</p>" for p in PARTS)


@pytest.mark.parametrize("head", ["<h2>The mill</h2>", "<h1>The mill</h1>", ""])
@pytest.mark.parametrize("name", ['id="comments"', 'class="comment-list"', 'class="post-comments"', "id=disqus_thread", 'class="replies"'])
def test_comments_go_however_long(head, name):
    page = f"<html><body>{NAV}<div class=main>{head}{TEXT}</div><div {name}>{TALKS}</div></body></html>"
    assert M.main_text(page).split("\n")[-2:] == PARTS
    assert "disagree" not in M.main_text(page)


@pytest.mark.parametrize("name", ["cookie-notice", "notice", "newsletter-box", "advert", "consent popup"])
@pytest.mark.parametrize("wrap", ["div", "article", "main"])
def test_notices_go_however_long(name, wrap):
    notice = f'<div class="{name}">' + "<p>We and our partners store data on your device, to measure, to improve and to offer more; you may refuse.</p>" * 6 + "</div>"
    assert M.main_text(f"<body>{notice}<{wrap}>{TEXT}</{wrap}></body>").split("\n") == PARTS
    assert M.main_text(f"<body><{wrap}>{TEXT}{notice}</{wrap}></body>").split("\n") == PARTS


def test_lists_of_links_in_an_article_stay():
    items = "".join(f"<li><a href=/{i}>Hammer number {i}</a></li>" for i in range(3))
    page = f"<body>{NAV}<article><h1>Ten tools</h1>{TEXT}<ul>{items}</ul><h2>Further reading</h2><ul><li><a href=/m>On mills</a></li></ul></article><div class=related><ul><li><a href=/q>Other</a></li></ul></div></body>"
    assert M.main_text(page).split("\n") == ["Ten tools", *PARTS, "Hammer number 0", "Hammer number 1", "Hammer number 2", "Further reading", "On mills"]


def test_names_of_an_articles_own_parts():
    page = f'<body><article><h1>Signing in</h1><div class="login-page-text"><p>The login page asks for a name, a word and some patience, as it did before.</p></div>{TEXT}<div class="share-buttons"><p>Share this, if you like it.</p></div><div class=comments>{TALKS}</div></article></body>'
    assert M.main_text(page).split("\n") == ["Signing in", "The login page asks for a name, a word and some patience, as it did before.", *PARTS]


def test_a_page_of_talk_alone_is_not_empty():
    assert "disagree" in M.main_text(f"<body>{NAV}<div class=comments>{TALKS}</div></body>")


def test_ratios_equal_their_plain_form():
    page = f"<body>{NAV}<div class=a><h2>Title here</h2>{TEXT}<p>Short one.</p></div><div class=print><p>Print, now, again!</p></div><ul><li><a>One</a> two, three.</li></ul></body>"
    _, found = M.blocks(page)
    by = defaultdict(list)
    for b in found:
        if not b.at.out:
            by[b.at.path].append(b)
    paths = M._Paths(found)
    assert set(by) == set(paths.own)
    for k, own in by.items():
        sizes = [len(b.text) - 0.9 * b.links for b in own]
        mean = sum(sizes) / len(sizes)
        spread = math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))
        points = sum(len(M.POINTS.findall(b.text)) for b in own) / len(own)
        assert math.isclose(paths.own[k], own[0].at.weight * mean * math.log1p(points) * (1 + math.log1p(spread)), rel_tol=1e-6)
    got = M.ratios(found, paths)
    line = [0.0 if b.at.out else paths.own[b.at.path] for b in found]
    for i, b in enumerate(found):
        near = {j: math.exp(-(j * j) / 2) for j in range(-2, 3)}
        smooth = sum(w * line[i + j] for j, w in near.items() if 0 <= i + j < len(line)) / sum(near.values())
        want = 0.0 if b.at.out else math.sqrt(line[i] * smooth) if line[i] else smooth / 4
        assert math.isclose(got[i], want, rel_tol=1e-9)
