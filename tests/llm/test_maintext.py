import random
import re
import time
from html import unescape

import numpy as np
import pytest

from tablewright.llm import maintext as M, queries


@pytest.fixture(scope="module")
def model():
    return M.train()


def text(page, model):
    return M.main_text(page, model)


def test_labelled_pages_are_read_right(model):
    assert [k for k, p in enumerate(M.PAGES) if text(M.unmarked(p), model) != M.wanted(p)] == []


def test_pages_that_it_did_not_learn_from(model):
    """Each labelled page read by a model of the others."""
    right = 0
    for k, page in enumerate(M.PAGES):
        others = M.train([p for j, p in enumerate(M.PAGES) if j != k], steps=1000)
        right += text(M.unmarked(page), others) == M.wanted(page)
    assert right >= len(M.PAGES) // 2


def plain_article(html):
    """Main text of the tables' pages, which have one article of headings and paragraphs."""
    inside = re.search("<article>(.*)</article>", html, re.S).group(1)
    blocks = (" ".join(unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?p>|<br>|</?h1>", inside))
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_pages_of_the_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    html = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op12_main_text(spark, folder).collect()
    assert len(rows) == len(html)
    for r in rows:
        url, page = html[r["page_id"]]
        assert r["url"] == url and r["text"] == plain_article(page) and r["n_chars"] == len(r["text"])


def test_markup_of_all_kinds(model):
    body = lambda x: f"<html><body><nav><a>Home</a></nav><article>{x}</article><footer>Imprint</footer></body></html>"
    for inner, want in {
        "<p>a  b\n\tc</p> <p> d </p>": "a b c\nd",
        "<p>x &lt;b&gt; &amp;amp; &#233; &euro;&nbsp;5</p>": "x <b> &amp; é € 5",
        "<p>one<p>two<br>three": "one\ntwo three",
        "<P>1 < 2 and 3<4</P>": "1 < 2 and 3<4",
        "<p title='a > b'>in</p><p title=\"it's\">out</p>": "in\nout",
        "<p>a<!-- no <p> -->b</p>": "ab",
        "<p>a</p><script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><p>b</p>": "a\nb",
        "<p>a <b>b <i>c</b> d</i></p>": "a b c d",
        "<ul><li>a<li>b</ul>c": "a\nb\nc",
        "<p>a</p><div class='ad'>buy this</div><p>b</p>": "a\nb",
        "<p>a</p><form><p>name</p></form><aside>see also</aside><p>b</p>": "a\nb",
        "<p>" + "a " * 100_000 + "</p>": " ".join("a" * 100_000),
        "": "",
    }.items():
        assert text(body(inner), model) == want, inner[:80]


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<", "<"), ("plain words", "plain words"), ("<p>cut off <b", "cut off"), ("<script>x", ""), ("<!-- x", ""), ("<p title=\"x>a</p><p>b</p>", "a\nb"), ("</p>a</div>", "a")])
def test_broken_pages(model, page, want):
    assert text(page, model) == want


def test_time_goes_with_length(model):
    pieces = ["<", "<a ", '<a title="', "<b>", "</b>", "<p>", "<li>", "<div>", "</x", "<!--", "<script>", "&", "<a b=' ", "<td>", "class ", "<p class", "<ul>"]
    for piece in pieces:
        began = time.process_time()
        text(piece * 40_000, model)
        assert time.process_time() - began < 15, piece


def test_best_region_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randrange(12))]
        first, last = M.best_region(np.array(scores, float))
        best = max((sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)), default=0)
        assert sum(scores[first:last]) == best


def test_rows_of_all_kinds(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "v", "", "y")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(str, (tuple(r) for r in queries.op12_main_text(spark, str(tmp_path)).collect()))) == sorted(map(str, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)]))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op12_main_text(spark, f"{tmp_path}/none").count() == 0
