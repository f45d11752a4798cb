import itertools
import time

import numpy as np
import pytest
from mmcohort.llm import html as X


@pytest.fixture(scope="module")
def model():
    return X.trained()


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    pages = [X.Page(X.labelled_page(rng)) for _ in range(n)]
    f = X.Forest(pages)
    f.label[f.roots] = 1
    for rows in f.levels:
        own = f.label[rows]
        f.label[rows] = np.where(own < 0, f.label[f.parent[rows]], own)
    return pages, f


def test_held_out_pages(model):
    pages, f = labelled(150, 1234)
    main = model.marginals(f) >= 0.5
    same = [p.text(main[a:b]) == p.text(f.label[a:b] == 1) for p, a, b in zip(pages, f.at, f.at[1:])]
    assert np.mean(same) > 0.93


def test_marginals_are_exact():
    """Against the sum over all labellings of small trees."""
    rng = np.random.default_rng(0)
    m = X.Model()
    m.weight = rng.normal(0, 0.5, X.FEATURES)
    m.edge = rng.normal(0, 1, (X.KINDS, 2, 2))
    for source in ("<div><p>a<b>c</b></p><ul><li>x</li><li>y</li></ul></div>", "text", "<nav><a>q</a></nav><p>r"):
        f = X.Forest([X.Page(source)])
        n = len(f.kind)
        unary = m.weight[f.feat].sum(1)
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = sum(unary[i] for i in range(n) if y[i])
            w += sum(m.edge[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, n))
            total += np.exp(w)
            ones += np.exp(w) * np.array(y)
        assert np.allclose(m.marginals(f), ones / total)


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


PROSE = "The first sentence, with a comma. A second one follows here. And then a third, longer than both of them."


def test_layout(model):
    body = (
        "<nav><ul><li><a href='/x'>Home</a></li><li><a href='/y'>News</a></li></ul></nav><div class='ad'>Buy now.</div>"
        f"<article><h1>Head &amp; Line</h1><p>{PROSE}  x\n\ty&nbsp;z &lt;b&gt; &#233;</p><script>var a='<p>no</p>'</script>"
        f"<p>{PROSE} <b>bold</b> end<p>Unclosed. {PROSE}<!-- note --></article>"
        f"<section class='comments'><h3>Comments</h3><div class='comment'><p>{PROSE}</p></div></section>"
        "<footer>&copy; someone</footer>"
    )
    got = X.extract_many([page(body, "<style>p{}</style>")], model)[0].split("\n\n")
    assert got == ["Head & Line", f"{PROSE} x y z <b> é", f"{PROSE} bold end", f"Unclosed. {PROSE}"]


def brute_article(source):
    """Blocks of the test pages: what stands between the article tags."""
    import html
    import re

    s = source[source.index("<article>") + 9 : source.index("</article>")]
    s = re.sub(r"</?(?:p|h1)>", "\0", s)
    s = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", s))
    return "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in s.split("\0")) if x)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r for r in pages.collect()}
    rows = X.extract(pages).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(source)
    for r in rows:
        assert r["text"] == brute_article(source[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == source[r["page_id"]]["url"]


def test_edges(spark):
    long = page("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>")
    deep = "<div>" * 3000 + PROSE
    rows = [
        (1, "u", None), (2, None, ""), (None, "u", page(f"<article><p>{PROSE}</p></article>")), (3, "u", long), (4, "u", deep), (5, "u", "plain words"),
        (6, "u", "<p title=\"" + "<" * 5000), (7, "u", "<" * 5000), (8, "u", "<a " * 2000 + "'"), (9, "u", "</p></b><!-- open"), (10, "u", "<script>x"),
        (3, "u", long), (11, "u", "<table><tr><td>a<td>b<tr><td>c</table>"), (12, "u", "a &am &bogus; &amp &#0; &#x110000;"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, text int, label string")
    out = X.extract(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r for r in out}
    assert got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[2]["text"] == ""
    assert got[None]["text"] == PROSE and got[3]["text"] == "\n\n".join([PROSE] * 20_000)
    assert X.extract(df.where("false")).collect() == []


def test_broken_pages_take_linear_time(model):
    """Megabytes each, seconds each."""
    size = 5 << 20
    for unit, tail in (
        ("<a ", ""), ("<!", ""), ("<a '", ""), ("<a \"", ">"), ("<a '>' ", '">'), ("<p x=\"'>", ""), ("</", ">"), ("<!--", ""), ("<", ""), ("<script", ""),
    ):
        began = time.time()
        X.Page(unit * (size // len(unit)) + tail)
        assert time.time() - began < 10, unit
    began = time.time()
    for source in ("<b>" * 60_000 + "<p>x" * 20_000, "<div>" * 50_000 + PROSE, "<ul><li>" * 20_000, "<b><p>" * 20_000 + "</b>" * 9):
        X.extract_many([source], model)
    assert time.time() - began < 40


def test_slashes_and_controls(model):
    def article(inner):
        return X.extract_many([page(f"<article><h1>Head line</h1><p>{PROSE}</p>{inner}<p>{PROSE}</p></article>")], model)[0]

    plain = article("")
    assert article("<script src=x.js/>var a=1; alert(2);</script>") == plain
    assert article("<style media=print/>p { color: red }</style>") == plain
    assert article("<textarea>Say something here. It is a longer text, with a comma.</textarea>") == plain
    assert article("<select><option>One choice, of some length.</option><option>Another.</option></select>") == plain
    assert article(f"<button><b>{PROSE}</b></button><label>{PROSE}</label>") == plain
    assert article(f"<p>{PROSE}<br/>next</p>").split("\n\n")[2] == f"{PROSE} next"
    p = X.Page("<div class=content/><a href=/x/>text</a></div>")
    assert p.parent[1:] == [0, 1] and p.linked[2] == 4


def test_foreign_data_main(spark):
    """data-main is the generator's own label; real pages carry it with any value."""
    marks = ['data-main="js/app"', 'data-main=""', "data-main=1e9", 'data-main="300"', 'data-main="0"']
    rows = [(i, "u", page(f"<article {x}><p {x}>{PROSE}</p></article>", f'<script {x} src="require.js"></script>')) for i, x in enumerate(marks)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in X.extract(df).collect()} == {r[0]: PROSE for r in rows}


def test_every_class_word_counts(model):
    """The telling word may stand behind any number of utility classes."""
    utility = ["col-12", "col-md-4", "d-none", "d-lg-block", "px-3", "mt-auto", "order-last", "float-end", "h-100", "bg-white"]
    for names in (utility, utility * 30, [f"{a}{b}" for a in utility for b in ("", "-sm", "-xl")]):
        for name in ("sidebar", "advert", "comment", "notice"):
            weights = []
            for c in (names, [*names, name]):
                f = X.Forest([X.Page(f"<div class='{' '.join(c)}'>{PROSE}</div>")], labelled=False)
                weights.append(model.messages(f)[0][1, 1])
            assert np.isclose(weights[1] - weights[0], model.weight[X._feature("word " + name)])
    main = f"<article><h1>Head line</h1><p>{PROSE}</p></article>"
    side = f"<div class='{' '.join(utility)} sidebar'><p>{PROSE}</p></div>"
    assert X.extract_many([page(main + side)], model) == [f"Head line\n\n{PROSE}"]


def test_groups_change_nothing(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a, b = ({r["page_id"]: r["text"] for r in X.extract(pages, group_chars=n).collect()} for n in (1 << 22, 1))
    assert a == b
