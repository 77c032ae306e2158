"""Visible text of pages: rule by rule, on deep and long pages, and against an independent walk of random well-formed pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from lattica.llm import html_text
from lattica.llm.html_text import page_text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<p aria-hidden="true">seen</p>', "seen"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select><option>a<option>b</select>", "a"),
        ("x<select multiple><optgroup label=g><option>a<option>b</optgroup></select>", "x\ng\na\nb"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"),
        ("<svg><title>no</title><g><text>label</text></g><defs><text>no</text></defs></svg>", "label"),
        ("<svg><path d='M0'/><text>a</text></svg>b", "ab"),
        ("<object data=x><p>fallback</object>", "fallback"),
        ("<input value=typed><input type=password value=no><input type=checkbox value=no><input placeholder=hint>", "typed hint"),
        ('<div style="visibility:hidden">no<b style="visibility:visible">yes</b>no</div>', "yes"),
        ('<div style="display:none;display:block">yes</div>', "yes"),
        ('<div style="display:block !important;display:none">yes</div>', "yes"),
        ('<div style="display:none"><b style="display:block">no</b></div>', ""),
        ('<div style="display:nonsense">yes</div>', "yes"),
        ('<p hidden style="display:block">yes', "yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<details><summary>sum</summary>no</details><details open><summary>sum</summary>yes</details>", "sum\nsum\nyes"),
        ("a<noscript>no</noscript><canvas>no</canvas><video>no</video><template>no</template>b", "ab"),
        ("<textarea>kept  so</textarea>", "kept  so"),
        ("<table><tr><td>a<td>b<tr><td rowspan=2>c<td>d<tr><td>e</table>", "a  b\nc  d\n   e"),
        ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\nx  y"),
        ("<table><tr><td style='visibility:hidden'>no<td>b</table>", "  b"),
        ("<table><tr><td>o<table><tr></td><td>i</table></table>", "o\n\ni"),
        ('<a href="x>y">l</a><a b"c>m</a>', "lm"),
        ("<p>a<p>b</p></p>c", "a\n\nb\n\nc"),
        ("<b><div>x</div>y</b>z", "x\nyz"),
    ],
)
def test_rules(source, text):
    assert page_text(source) == text


@pytest.mark.parametrize(
    ("source", "holds"),
    [
        ("<table><tr><td>a<td>b" * 5000 + "deep", "deep"),
        ("<table><tr><td>" * 5000 + "deep", "deep"),
        ("<div>" * 100_000 + "deep", "deep"),
        ("<ul><li>a" * 20_000 + "deep", "deep"),
        ("<p><button>" + "<div>" * 100_000 + "deep", "deep"),
        ("<div>" * 50_000 + "</span>" * 50_000 + "deep", "deep"),
        ("deep" + "<a " * 100_000 + '"', "deep"),
        ('deep<a b="' * 50_000, "deep"),
        ("<b>" * 20_000 + "<div>x</div>" * 2000 + "deep", "deep"),
        ("deep " * 400_000, "deep"),
    ],
)
def test_deep_and_long_pages(source, holds):
    began = time.perf_counter()
    assert holds in page_text(source) and time.perf_counter() - began < 10


class Walk(HTMLParser):
    """Words outside hidden elements, in order, for pages whose tags all match."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        gone = tag in ("script", "style", "template") or "hidden" in dict(attrs) or "none" in (dict(attrs).get("style") or "")
        self.hidden.append(gone or (bool(self.hidden) and self.hidden[-1]))

    def handle_endtag(self, tag):
        self.hidden.pop()

    def handle_data(self, data):
        if not (self.hidden and self.hidden[-1]):
            self.words += data.split()


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "div", "b", "ul", "table", "blockquote", "script", "hidden", "h2", "pre"])
        if kind == "text" or depth > 5:
            out.append(" " + " ".join(rng.choice(["alpha", "beta &amp; co", "gamma", "x&lt;y", "δ"]) for _ in range(rng.randint(1, 4))) + " ")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{random_page(rng, depth + 1)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind == "table":
            rows = "".join("<tr>" + "".join(f"<td>{random_page(rng, depth + 2)}</td>" for _ in range(rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(1, 3)))
            out.append(f"<table><tbody>{rows}</tbody></table>")
        elif kind == "script":
            out.append("<script>no no</script>")
        elif kind == "hidden":
            out.append(f"<div {rng.choice(['hidden', 'style=display:none'])}>{random_page(rng, depth + 1)}</div>")
        elif kind in ("b", "h2", "pre"):
            out.append(f" <{kind}>word{rng.randint(0, 9)} more</{kind}> ")
        else:
            out.append(f"<{kind}>{random_page(rng, depth + 1)}</{kind}>")
    return "".join(out)


def test_random_pages_against_an_independent_walk():
    rng = random.Random(7)
    for _ in range(400):
        page = random_page(rng)
        walk = Walk()
        walk.feed(page)
        assert sorted(page_text(page).replace("- ", " ").split()) == sorted(w for w in " ".join(walk.words).replace("- ", " ").split())


def test_tables(spark):
    empty = spark.createDataFrame([], "page_id long, html string")
    assert html_text.extract_text(empty).count() == 0
    rows = [(1, "<p>a", 1), (1, "<p>a", 1), (None, None, 2), (2, "", 3), (3, "<div>" * 50_000 + "word " * 100_000, 4)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, __x int")).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, 1, 1, 499_999] and got[0].asDict().keys() == {"page_id", "html", "__x", "text"}
