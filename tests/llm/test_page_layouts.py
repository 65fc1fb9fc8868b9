"""Main text of pages that do not mark it, and what the cut adds to the classifier."""

from __future__ import annotations

import re

import numpy as np
import pytest

from prefixlake.llm import html_cut
from tests.llm.helpers import SF

ONE = "The harbour was quiet that morning, and the boats had not yet come back from the night's fishing; nobody was surprised. " * 3
TWO = "Later the mayor said that the works would go on until spring, since the money was there and the people wanted it. " * 3
BOTH = f"<p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{ONE.strip()}\n\n{TWO.strip()}"
LAYOUTS = {
    "content": (f'<body><div id="content">{BOTH}</div></body>', TEXT),
    "bare": (f"<body><h1>Head line</h1>{BOTH}</body>", f"Head line\n\n{TEXT}"),
    "taxonomy": (f'<body><div class="post tag-privacy category-search">{BOTH}</div></body>', TEXT),
    "topic": (f'<body><article><section class="related-work">{BOTH}</section></article></body>', TEXT),
    "science": (f'<body><article><div class="entry-content social-science">{BOTH}</div></article></body>', TEXT),
    "comments": (f'<body><div id="main"><h1>Head</h1>{BOTH}</div><div id="comments"><ol><li><div class="comment-body"><p>{ONE} So I think.</p></div></li></ol></div><div>&copy; 2024 Us</div></body>', f"Head\n\n{TEXT}"),
    "unnamed": (
        f'<body><div class="topbar"><a href=/>Home</a> <a href=/x>News</a></div><div><h2>Head</h2><p>{ONE}</p><h3>Sub</h3><p>Short one.</p><p>{TWO}</p></div><div class="related-posts"><p>{ONE}</p></div><div class="cookieNotice"><p>We use cookies to do all of this and more, please agree.</p></div></body>',
        f"Head\n\n{ONE.strip()}\n\nSub\n\nShort one.\n\n{TWO.strip()}",
    ),
}


@pytest.fixture(scope="module")
def weights(spark):
    return html_cut.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(weights, name):
    page, want = LAYOUTS[name]
    for w in (weights, html_cut.PRIOR):
        assert html_cut.main_text(page, w)[0] == want


def test_cut_mends_labels_on_pages_without_marks(spark, weights):
    """Pages the fit has not seen, their telling elements turned into plain ones: the cut changes labels, for the better."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    changed = right = blocks_right = total = 0
    for p in pages:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", p["html"], re.S)[1]
        want = {b.text for b in html_cut.blocks_of(article)[0]}
        plain = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p["html"]).replace(' class="ad"', "")
        blocks, up = html_cut.blocks_of(plain)
        alone = html_cut.log_odds(blocks, html_cut.PRIOR) > 0
        cut = html_cut.label_blocks(blocks, up, html_cut.PRIOR) == 1
        truth = np.array([b.text in want for b in blocks])
        changed += int((alone != cut).sum())
        right += int(((alone != cut) & (cut == truth)).sum())
        blocks_right += int((html_cut.label_blocks(blocks, up, weights) == truth).sum())
        total += len(blocks)
    assert changed > 0 and right > 0.8 * changed
    assert blocks_right >= 0.99 * total


def test_long_deep_and_repeated_pages(weights):
    page = f"<body><article>{BOTH * 2000}</article></body>"
    assert html_cut.main_text(page, weights) == ("\n\n".join([TEXT] * 2000), 4000, 4000)
    assert html_cut.main_text("<body>" + "<div>" * 20_000 + f"<p>{ONE}</p><p>{TWO}</p>", weights)[0] == TEXT
    assert html_cut.main_text(page, weights) == html_cut.main_text(page, weights)


def test_fit_without_marks_or_rows_keeps_the_prior(spark):
    df = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "page_id long, html string")
    for pages in (df, df.limit(0)):
        assert (html_cut.fit(pages) == html_cut.PRIOR).all()
