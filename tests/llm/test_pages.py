"""Extraction of main text: hierarchical choice against enumeration, broken markup, and awkward tables."""

import itertools
import random

import numpy as np
import pytest

from tonemill.llm import html_text


@pytest.mark.parametrize("seed", range(8))
def test_choice_equals_enumeration(seed):
    rng = random.Random(seed)
    nodes = [html_text.Node("#root", -1, 0)]
    for i in range(1, 11):
        parent = rng.randrange(i)
        tag = rng.choice(["div", "p", "div", "span", "nav", "form"])
        nodes.append(html_text.Node(tag, parent, nodes[parent].depth + 1, hidden=rng.random() < 0.1))
        nodes[parent].children.append(i)
    odds = np.array([rng.uniform(-2, 2) for _ in nodes])
    keep = html_text.decode(nodes, odds)
    barred = [v.tag in html_text.NEVER or v.hidden for v in nodes]
    best = 0.0
    for chosen in itertools.product([False, True], repeat=10):
        take = [True, *chosen]
        if all(not take[i] or take[nodes[i].parent] and not barred[i] for i in range(1, 11)):
            best = max(best, sum(odds[i] for i in range(1, 11) if take[i]))
    assert all(not keep[i] or keep[nodes[i].parent] and not barred[i] for i in range(1, 11))
    assert sum(odds[i] for i in range(1, 11) if keep[i]) == pytest.approx(best)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Story one</p><svg><path><p>Story two</p></article>", ["Story one", "Story two"]),
        ("<main><p>a</p><object><p>fallback</p></main><p>c</p>", ["a", "c"]),
        ("<p>x<select><option>1<option>2<p>y", ["x", "y"]),
        ("<div><math><mi>x<div>z</div>", ["z"]),
        ("<svg><text>in</text></svg><p>ok</p><svg><p>more", ["ok", "more"]),
        ("<div><iframe src=x>old</div><p>after", ["after"]),
        ("<p>a</p><noscript><p>b</p></noscript><template><p>c</p></template><p>d", ["a", "d"]),
        ("<script>a<p>b</script><p>t</p><title>never closed <p>gone", ["t"]),
    ],
)
def test_unclosed_elements(page, want):
    nodes = html_text.parse(page)
    assert html_text.blocks(nodes, html_text.decode(nodes, np.ones(len(nodes)))) == want


STORY = "<html><body><nav><a href='#'>Home</a></nav><article><h1>Title</h1><p>A long first paragraph, with words. And more.</p></article><footer>All rights reserved</footer></body></html>"
DEEP = "<div>" * 3000 + "deep" + "</div>" * 3000


def test_awkward_tables(spark):
    big = (1 << 60) + 1
    pages = [None, "", "no markup", STORY, STORY, DEEP, "<p>x</p>" * 5000, "&amp;&#8364;&bogus; \x00 é"]
    rows = [(i if i % 3 else None, f"http://x/{i}", p) for i, p in enumerate(pages * 4)] + [(big, None, STORY), (None, "u", STORY)] * 2
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], "page_id long, url string, html string, text string, n_chars int, seed string")
    got = html_text.extract_text(df).collect()
    assert got and len(got) == len(rows)
    assert sorted((str(r["page_id"]), str(r["url"])) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    texts = {str(r["url"]): r for r in got}
    assert texts["http://x/0"]["text"] == texts["http://x/1"]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert "A long first paragraph, with words. And more." in texts["http://x/3"]["text"]
    equal = {r["text"] for r in got if r["url"] in ("http://x/3", "http://x/4", "u", None)}
    assert len(equal) == 1
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_only_null_ids(spark):
    rows = [(None, "u", STORY.replace("Title", f"Title {i}")) for i in range(6)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all("first paragraph" in r["text"] and r["page_id"] is None for r in got)
