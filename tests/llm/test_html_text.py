import random

from llm.helpers import sentence
from pyspark.sql import types as T

from storepulse.llm.html_text import Block, blocks, extract, markup_factor, style_tree

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("host", T.StringType()), T.StructField("text", T.StringType()), T.StructField("dropped", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA)


def site(host, n, seed=1):
    """Pages whose noise has no telling names: a menu, a notice and a credit line that repeat."""
    rng = random.Random(seed)
    rows, texts = [], {}
    for i in range(n):
        parts = [sentence(rng, rng.randint(15, 50)) for _ in range(rng.randint(2, 5))]
        body = "".join(f"<p>{p}" + rng.choice(["</p>", ""]) for p in parts)
        notice = ["Site closes at nine.", "New rules apply."][i % 2]
        html = (f"<html><head><title>t</title><script>var a='</p><p>x';</script></head><body><div class='top'><div>Home</div><div>News</div></div>"
                f"<div class='box'>{notice}</div><div class=main>{body}</div><div class='credit'>Made by us</div></body></html>")
        rows.append((seed * 1000 + i, f"https://{host}/p/{i}", html))
        texts[seed * 1000 + i] = "\n\n".join(" ".join(p.split()) for p in parts)
    return rows, texts


def found(df):
    return {r["page_id"]: r["text"] for r in extract(df).collect()}


def test_repeated_branches_go_and_contents_stay(spark):
    rows, texts = site("a.example.org", 60)
    more, other = site("b.example.org", 40, seed=2)
    assert found(pages(spark, rows + more)) == {**texts, **other}


def test_article_page_without_other_pages(spark):
    html = ("<!DOCTYPE html><body><nav><ul><li><a href=x>One</a></ul></nav><header>Top</header><article><header>Title &amp; more</header>"
            "<p>First <b>bold</b>,\n line<br>two&nbsp;x<p>Second</article><aside>Side</aside><div class='comments'><p>Nice!</p></div>"
            "<form><label>Name</label></form><!-- <p>not</p> --><footer>Foot</footer>")
    assert found(pages(spark, [(1, "https://one.example.org/", html)])) == {1: "Title & more\n\nFirst bold, line two x\n\nSecond"}


def test_names_do_not_decide_over_many_pages(spark):
    rng = random.Random(4)
    rows, texts = [], {}
    for i in range(400):
        title, price, body = sentence(rng, 8), sentence(rng, 30), sentence(rng, 40)
        rows.append((i, f"https://a.example.org/{i}", f"<body class='has-sidebar'><nav>Home News</nav><article class='widget'><div class='entry-header'><h1>{title}</h1></div>"
                     f"<div class='share-price'>{price}</div><p>{body}</article><footer>Made by us</footer>"))
        texts[i] = "\n\n".join(" ".join(p.split()) for p in (title, price, body))
    assert found(pages(spark, rows)) == texts


def test_a_page_gets_only_its_own_paths(spark, monkeypatch):
    from storepulse.llm import html_text
    kept, written = {}, html_text.written
    monkeypatch.setattr(html_text, "written", lambda df, name, *more: kept.setdefault(name, written(df, name, *more)))
    rng = random.Random(9)
    letters = "abcdefghij"
    rows = [(i, f"https://a.example.org/{i}", f"<nav><div id='{''.join(rng.choice(letters) for _ in range(9))}'>Menu</div></nav><p>{sentence(rng, 30)}")
            for i in range(60)]
    out = found(pages(spark, rows))
    assert all("Menu" not in text and text for text in out.values())
    assert max(len(r["dropped"]) for r in kept["dropped"].collect()) == 1


def test_awkward_pages(spark):
    long_text = "word " * 40000
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain text &lt;b&gt; only"), (4, "http://[bad", "<p>unclosed <b>tags <i>here"),
            (5, "https://h.example.org/", "<p" + "x" * 10), (6, "https://h.example.org/", f"<article><p>{long_text}</p></article>"),
            (7, "https://h.example.org/", "<div>" * 3000 + "deep"), (None, "https://h.example.org/", "<p>no id</p>"),
            (8, "https://h.example.org/", "<p>twice</p>"), (8, "https://h.example.org/", "<p>twice</p>"), (9, "x", "<!-- open <p>a</p>")]
    out = extract(pages(spark, rows)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    text = {r["page_id"]: r["text"] for r in out}
    assert text[1] == text[2] == text[9] == "" and text[3] == "plain text <b> only" and text[4] == "unclosed tags here"
    assert text[6] == long_text.strip() and text[7] == "deep" and text[None] == "no id" and text[8] == "twice"
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_copies_of_a_page_count_once(spark):
    rows, texts = site("a.example.org", 30)
    copy = rows[0][2]
    rows += [(5000 + i, "https://a.example.org/copy", copy) for i in range(300)]
    out = found(pages(spark, rows))
    assert out == {**texts, **{5000 + i: texts[rows[0][0]] for i in range(300)}}


def test_blocks_and_markup():
    found_blocks, _ = blocks("<body>a<div class='X12 y'>b<ul><li>c<li>d</ul></div>e<table><tr><td>f<td>g</table>")
    assert found_blocks == [Block("/body", "a"), Block("/body/div.x0.y", "b"), Block("/body/div.x0.y/ul/li", "c"),
                            Block("/body/div.x0.y/ul/li", "d"), Block("/body", "e"), Block("/body/table/tr/td", "f"), Block("/body/table/tr/td", "g")]
    assert markup_factor("/html/body/article/header") == markup_factor("/body/div.loader") == 1
    assert max(map(markup_factor, ["/body/nav", "/body/div.ad", "/body/div.user-comments", "/body/article/aside"])) < 1


def test_importance_of_the_tree(spark):
    rows, _ = site("a.example.org", 60)
    tree = {r["path"]: r["importance"] for r in style_tree(pages(spark, rows)).collect()}
    assert tree["/html/body/div.main/p"] > 0.8 > 0.2 > tree["/html/body/div.top/div"]


def test_empty_table(spark):
    assert extract(pages(spark, [])).count() == 0
