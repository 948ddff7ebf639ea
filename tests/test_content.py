"""Main content of pages, by hand-labelled pages and by the articles of the test table."""

import html
import re
from collections import Counter

import pyarrow.dataset as ds

from quillgraph.sources.content import main_content, markdown

PROSE = "Some prose that goes on for a while, so that it is more than a scrap of text. "

CASES = [
    (f"<title>t</title><div><a href=x>one</a> <a href=y>two</a></div><div><h2>Head</h2><div><p>{PROSE}<p>{PROSE * 2}</div></div><div>© 2024</div>", f"## Head\n\n{PROSE.strip()}\n\n{(PROSE * 2).strip()}"),
    (f"<body><div><p>{PROSE * 2}</p><ul><li>first item that is long enough to be read as prose<li>second</ul><p><a href=z>{PROSE}</a></p></div><div><ul>" + "<li><a href=q>A link with quite a long text in it</a>" * 9 + "</ul></div></body>", f"{(PROSE * 2).strip()}\n\n- first item that is long enough to be read as prose\n\n- second"),
    (f"<div id=a><div><p>{PROSE * 3}</p></div><div><p>{PROSE * 3}</p></div><div>scrap</div></div>", f"{(PROSE * 3).strip()}\n\n{(PROSE * 3).strip()}\n\nscrap"),
    ("<nav><a href=x>a</a></nav><p>short</p>", ""),
    ("", ""), ("no markup but enough of a text to count as prose", "no markup but enough of a text to count as prose"), ("<script>var x = 'a text that is not shown at all, ever';</script>", ""), ("<p>&lt;b&gt; stays text &amp; so on and on</p", "<b> stays text & so on and on"),
]


def test_hand_labelled_pages():
    for page, want in CASES:
        assert markdown(page) == want, page[:80]


def test_precision_and_recall_on_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.markdown for r in main_content(pages).collect()}
    same = extra = lost = 0
    for row in ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table().to_pylist():
        article = re.search(r"(?s)<article>(.*?)</article>", row["html"])[1]
        want = Counter(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        have = Counter(re.sub(r"(?m)^#+ ", "", got[row["page_id"]]).split())
        same, extra, lost = same + sum((want & have).values()), extra + sum((have - want).values()), lost + sum((want - have).values())
    assert same / (same + extra) > 0.99 and same / (same + lost) > 0.99


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "<div>" * 3000 + PROSE)], "page_id bigint, html string")
    assert sorted((str(r.page_id), r.markdown) for r in main_content(df).collect()) == [("1", ""), ("2", ""), ("2", ""), ("None", PROSE.strip())]
