"""Hand-labelled pages, none of which relies on an article element unless that is the case tested."""

from __future__ import annotations

import pytest

from watchgrid.llm import html_extract

P1 = "The first paragraph tells at some length what happened, who was there, and why it took so long to be noticed."
P2 = "The second one goes on, with less to say, but with commas, clauses, and a sentence that ends as it should."
P3 = "A third paragraph, which is long enough as well, closes the account and names what was learnt from it."
SHORT = "It ended there."
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"{P1}\n{P2}\n{P3}"
MENU = "<div><a href=/a>Home</a> <a href=/b>News</a> <a href=/c>Contact us today</a></div>"

CASES = {
    "sidebar as a property": (f'<body>{MENU}<div class="content has-sidebar">{BODY}</div></body>', TEXT),
    "entry header": (f'<body><article><div class="entry-header"><h1>Title</h1></div>{BODY}</article></body>', f"Title\n{TEXT}"),
    "entry header, no article": (f'<body>{MENU}<div class="post"><div class="entry-header"><h1>Title</h1></div><div class="text">{BODY}</div></div></body>', f"Title\n{TEXT}"),
    "paragraph named social": (f'<body><article>{BODY}<p class="social">{SHORT}</p></article></body>', f"{TEXT}\n{SHORT}"),
    "page in a form": (f'<body><form id="aspnetForm"><div id="header">My site</div>{MENU}<div id="main">{BODY}</div><label>Mail</label><button>Send</button></form></body>', TEXT),
    "small form": (f"<body><div>{BODY}<form><p>Search this site, please.</p><input></form></div></body>", TEXT),
    "sources": (f"<body><div class=text>{BODY}<h2>Sources</h2><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div></body>", f"{TEXT}\nSources\nOne\nTwo\nThree"),
    "heading beside": (f"<body>{MENU}<h1>Title</h1><div>{BODY}</div><p>{SHORT}</p><div>(c) 2020 the owner</div></body>", f"Title\n{TEXT}\n{SHORT}"),
    "advert as an article": (f'<body><article class="advert"><p>{P3}</p></article><div>{BODY}</div></body>', TEXT),
    "two articles": (f"<body>{MENU}<article>{BODY}</article><article><p>{P3}</p></article></body>", f"{TEXT}\n{P3}"),
    "short sections": (f"<body>{MENU}<div><section>{BODY}</section><section><h2>Then</h2><p>A short section, too.</p></section></div></body>", f"{TEXT}\nThen\nA short section, too."),
    "ids of headings": (f'<body><div><h2 id="related-work">Related work</h2>{BODY}<p id="notice-period">{P3}</p><div class="social-history"><p>{P1}</p></div></div></body>', f"Related work\n{TEXT}\n{P3}\n{P1}"),
    "discussion section": (f'<body><div>{BODY}<section class="discussion"><h2>Discussion</h2><p>{P1}</p></section></div></body>', f"{TEXT}\nDiscussion\n{P1}"),
    "comments": (f'<body><div>{BODY}</div><div id="comments"><div class=comment><p>{P3}</p></div><div class=comment><p>{P2}</p></div></div></body>', TEXT),
    "comments longer than the text": (f"<body><div class=text><p>{P1}</p></div><ol class=commentlist>{f'<li class=comment><p>{P2}</p>' * 30}</ol></body>", P1),
    "related links": (f'<body><div>{BODY}<div class="related-posts"><h3>Related</h3><ul><li><a href=1>One thing</a><li><a href=2>Another thing</a></ul></div></div></body>', TEXT),
    "menu without names": (f"<body>{MENU}<div>{BODY}</div>{MENU}</body>", TEXT),
    "notice and cookies": (f'<body><div class="notice"><p>{P3}</p></div><div>{BODY}</div><div id="cookie-banner">{P3}</div></body>', TEXT),
    "share buttons": (f'<body><div>{BODY}<ul class="share-buttons"><li>Tell all of your friends</ul></div></body>', TEXT),
    "site header and footer": (f"<body><header><h1>My site</h1></header><div><h2>Title</h2>{BODY}</div><footer><p>{P3}</p></footer></body>", f"Title\n{TEXT}"),
    "sidebar of a main": (f'<body><main><div class="left">{BODY}</div><div class="sidebar"><p>{P3}</p></div></main></body>', TEXT),
    "everything named": (f'<body><div class="modal">{BODY}</div></body>', TEXT),
    "mathematics": (f"<body><div>{BODY}<p>So <math><mi>x</mi></math> is what we want to find here.</p></div></body>", f"{TEXT}\nSo x is what we want to find here."),
    "quotation": (f"<body><div>{BODY}<blockquote><p>{P2}</p><footer>A reader</footer></blockquote></div></body>", f"{TEXT}\n{P2}\nA reader"),
    "short lines only": ("<body><div><p>One.</p><p>Two.</p></div></body>", "One.\nTwo."),
    "paragraphs in the body": (f"<body>{MENU}<h1>Title</h1>{BODY}</body>", f"Title\n{TEXT}"),
    "hidden": (f'<body><div>{BODY}<div style="display: none"><p>{P3}</p></div><p hidden>{P2}</p></div></body>', TEXT),
}


@pytest.mark.parametrize("name", list(CASES))
def test_page(name):
    page, want = CASES[name]
    assert html_extract.extract(page) == want


def test_scores_decide():
    """The same marks on two containers: the one with the points wins, whatever its place."""
    thin = "<div><p>Read on.</p></div>"
    assert html_extract.extract(f"<body>{thin}{MENU}<section><div>{BODY}</div></section></body>") == TEXT
    # an article of links loses against plain text outside of it
    links = "".join(f"<p><a href={k}>A headline, with commas, and of some length, number {k}</a></p>" for k in range(9))
    assert html_extract.extract(f"<body><article>{links}</article><div>{BODY}</div></body>") == TEXT


def test_long_page_in_linear_time():
    page = f"<body><div>{''.join(f'<p>{P1} {k}</p>' for k in range(20_000))}</div></body>"
    assert html_extract.extract(page).count("\n") == 19_999


def test_pages_with_null_ids(spark):
    rows = [(None, None, CASES["comments"][0]), (None, "u", None), (7, "v", "")]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got} == {(None, None, TEXT, len(TEXT)), (None, "u", "", 0), (7, "v", "", 0)}


#: What names and shapes must not take away, and what they must.
MORE = {
    "opinion": (f'<body>{MENU}<article class="comment"><h1>Opinion</h1>{BODY}</article></body>', f"Opinion\n{TEXT}"),
    "specs": (f'<body>{MENU}<div><section>{BODY}</section><section><h2>Specs</h2><p>Weight 5 kg</p></section></div></body>', f"{TEXT}\nSpecs\nWeight 5 kg"),
    "specs2": (f'<body>{MENU}<section><h1>T</h1>{BODY}</section><section><h2>Specs</h2><p>Weight 5 kg</p></section></body>', f"T\n{TEXT}\nSpecs\nWeight 5 kg"),
    "faq": (f'<body>{MENU}<h1>FAQ</h1><div class=q><h3>Is it hot?</h3>{BODY}</div><div class=q><h3>Is it cold?</h3><p>No</p></div></body>', f"FAQ\nIs it hot?\n{TEXT}\nIs it cold?\nNo"),
    "byline": (f'<body>{MENU}<h1>Title</h1><div class="byline">By Ann Lee</div><div class="text">{BODY}</div></body>', f"Title\nBy Ann Lee\n{TEXT}"),
    "standfirst": (f'<body>{MENU}<h1>Title</h1><p class="standfirst">A short summary without a stop</p><div class="text">{BODY}</div></body>', f"Title\nA short summary without a stop\n{TEXT}"),
    "sources": (f'<body>{MENU}<div class="text">{BODY}</div><h2>Sources</h2><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></body>', f"{TEXT}\nSources\nOne\nTwo"),
    "copyright law": (f'<body>{MENU}<div class="text">{BODY}</div><p>Copyright law is old, and it has changed very often since then.</p></body>', f"{TEXT}\nCopyright law is old, and it has changed very often since then."),
    "copyright law art": (f'<body>{MENU}<article>{BODY}<p>Copyright law is old</p></article></body>', f"{TEXT}\nCopyright law is old"),
    "promotion": (f'<body>{MENU}<article><h1>T</h1>{BODY}<section class="promotion"><h2>Promotion</h2>{BODY}</section></article></body>', f"T\n{TEXT}\nPromotion\n{TEXT}"),
    "id copyright": (f'<body>{MENU}<article>{BODY}<section id="copyright"><h2>C</h2>{BODY}</section></article></body>', f"{TEXT}\nC\n{TEXT}"),
    "id navigation": (f'<body>{MENU}<article>{BODY}<div id="navigation"><h2>C</h2>{BODY}</div></article></body>', f"{TEXT}\nC\n{TEXT}"),
    "footer rights": (f'<body>{MENU}<div>{BODY}</div><p>Copyright 2021 Some Owner, all rights reserved.</p></body>', TEXT),
    "shape": (f'<body>{MENU}<article>{BODY}<h3>3 responses</h3><div class=x><b>Ann</b> <time>1 May</time><p>{P1}</p></div><div class=x><b>Bob</b> <time>2 May</time><p>{P3}</p></div></article></body>', TEXT),
    "shape2": (f'<body>{MENU}<div class=t>{BODY}</div><ul class=y><li><a href=u>Ann</a> 3 hours ago<p>{P1}</p><a href=r>Reply</a></li><li><a href=u>Bob</a> 2 hours ago<p>{P2}</p><a href=r>Reply</a></li></ul></body>', TEXT),
    "live": (f'<body>{MENU}<article><h1>Live</h1><div class=u><time>10:05</time><p>{P1}</p></div><div class=u><time>10:20</time><p>{P2}</p></div></article></body>', f"Live\n10:05\n{P1}\n10:20\n{P2}"),
}
OUT = "comment-body user-comments reader-comments comment-thread fb-comments disqus_thread google-ad ad-300x250 dfp-ad advert-mpu legal-notice privacy-notice alert-bar share-tools left-rail".split()


@pytest.mark.parametrize("name", MORE)
def test_evidence(name):
    page, text = MORE[name]
    assert html_extract.extract(page) == text


@pytest.mark.parametrize("name", OUT)
@pytest.mark.parametrize("page", ["<body>{}<article>{}{}</article></body>", "<body>{}<div class=post>{}</div>{}</body>"])
def test_compound_names(name, page):
    for attribute in ("class", "id"):
        assert html_extract.extract(page.format(MENU, BODY, f'<div {attribute}="{name}"><p>{P3}</p></div>')) == TEXT
