import html
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pelagos.llm import html_extraction as hx

CASES = [
    ("<p>a &amp; b<br>c</p>", "a & b c"),
    ("<html><body><nav><a>Home</a></nav><article><h1>T</h1><p>x <b>y</b>z<p>q</article><footer>f</footer>", "T x yz q"),
    ("<body class='has-sidebar'><div class='page sidebar-left'><main><p>m</p><div class='ad'>no</div></main></div>", "m"),
    ("<article><p>one</p><section id=comments><article class=comment>nope</article></section></article>", "one"),
    ("<script>var t='</p>'</script><style>p{}</style><p>t<!-- c --><!-- open", "t"),
    ("<div role=navigation>n</div><div id='cookie-notice'>c</div><form>f</form><div class='post-content'>body &lt;b&gt; &#233;</div>", "body <b> é"),
    ("<ul><li><a href=x>l1</a><li><a href=y>l2</a></ul><p>text with a <a href=z>link</a> in it</p>", "text with a link in it"),
    ("a < b <3 c", "a < b <3 c"),
    ("<article><header><h1>H</h1></header><p>p</p><footer>by</footer></article>", "H p"),
    ("<p>a</p></div></p>b<table><tr><td>1<td>2</table>", "a b 1 2"),
    ("", ""),
    ("<article></article><p>x", "x"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert hx.main_text(hx.parse(page)) == text


def test_template_text_goes(spark):
    say = lambda i: f"Own text {i} {'that is the longest by far ' * 3}{i}."
    rows = [(i, "http://A.example/x", f"<div class=z><p>Always here.</p><p>{say(i)}</p><p>{'Sometimes.' if i % 3 == 1 else f'Other {i}.'}</p></div>", 0) for i in range(12)]
    rows += [(100 + i, "http://small.example", "<div><p>Always here.</p></div>", 0) for i in range(3)]
    # null, empty and odd pages do not switch the template off
    rows += [(200, None, None, 0), (201, "x", "", 0), (None, None, "<p>n</p>", 0), (3, rows[3][1], rows[3][2], 0), (202, "http://a.example/e", None, 0), (203, "http://a.example/e", "<h1>Error</h1>", 0)]
    # copies of one page are no template
    rows += [(300 + i, f"http://copies.example/{i}", f"<div><h1>Head</h1><p>{'A long article text. ' * 5}</p><p>Second.</p></div><div>Ad {i}</div>", 0) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in hx.extract(pages).collect()]
    want = [(i, f"{say(i)} {'Sometimes.' if i % 3 == 1 else f'Other {i}.'}") for i in [*range(12), 3]] + [(100 + i, "Always here.") for i in range(3)] + [(200, ""), (201, ""), (None, "n"), (202, ""), (203, "Error")]
    want += [(300 + i, "Head " + ("A long article text. " * 5).strip() + " Second.") for i in range(10)]
    assert sorted(got, key=str) == sorted(((i, t, len(t)) for i, t in want), key=str)
    t = hx.templates(pages).collect()
    assert {r["host"] for r in t} == {"a.example"} and any(r["text"] for r in t) and any(r["article"] for r in t)
    assert hx.extract(pages.limit(0)).collect() == []


def test_classes_against_occurrence_vectors(spark):
    """Classes are the tokens with equal counts on all different pages, compared one by one."""
    rng = random.Random(2)
    htmls = []
    for i in range(30):
        menu = "".join(f"<li><a href={k}>{rng.random()}</a></li>" for k in range(rng.randint(1, 4)))
        note = "<section><b>Note</b><p>We use things.</p></section>" if rng.random() < 0.5 else ""
        body = "".join(f"<p>{rng.random()} {'w ' * 40}</p>" for _ in range(rng.randint(2, 5)))
        htmls.append(f"<body><div><ul>{menu}</ul></div>{note}<div><h1>{rng.random()}</h1>{body}</div><div>foot {rng.random()}</div></body>")
    rows = [(i, "http://h.example/", h) for i, h in enumerate(htmls)]
    found = hx.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).where("class is not null").collect()
    vectors = defaultdict(dict)
    for h in htmls:
        page = hx.parse(h)
        for token, _, _, n, _ in page.tokens():
            vectors[token][page.likeness()] = n
    by = defaultdict(set)
    for token, v in vectors.items():
        if len(v) >= hx.LEAST_PAGES:
            by[frozenset(v.items())].add(token)
    want = {frozenset(x) for x in by.values() if len(x) >= 2}
    got = defaultdict(set)
    for r in found:
        got[r["class"]].add(r["token"])
    assert {frozenset(x) for x in got.values()} <= want and len(got) >= 2
    # the largest class, that of the fixed frame, is there and so is the notice
    assert max(want, key=len) in {frozenset(x) for x in got.values()}
    texts = {hx.parse(f"<body><section><p>We use things.</p></section></body>").blocks[0].text}
    assert texts == {"We use things."} and any(r["text"] for r in found)


def test_neutral_names(spark):
    """The template finds the articles where no tag, class, id or role tells them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    marked = {r["page_id"]: r["text"] for r in hx.extract(pages).collect()}
    plain = F.regexp_replace("html", r"<(/?)(?:article|nav|footer|aside|header|main)\b", "<$1div")
    plain = F.regexp_replace(plain, r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    # hosts of one page or two have no template; here all are one host
    neutral = pages.select("page_id", F.lit("http://one.example/").alias("url"), plain.alias("html"))
    got = {r["page_id"]: r["text"] for r in hx.extract(neutral).collect()}
    assert sum(got[k] == marked[k] for k in marked) >= 0.99 * len(marked)


def test_generated_pages(spark):
    """The test pages mark their articles: all their text, and nothing else, comes out."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in hx.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        plain = html.unescape(re.sub(r"<(?!b>|/b>)[^>]*>", " ", body).replace("<b>", "").replace("</b>", ""))
        assert texts[r["page_id"]] == " ".join(plain.split())
