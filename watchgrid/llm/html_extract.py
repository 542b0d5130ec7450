"""Operator 8: main text of web pages by tree scoring.

A page is read into a tree, tolerantly: a missing end tag ends where HTML says it does. What can never hold main
text goes at once: menus, asides, form controls, scripts, styles, and what is hidden or has such a role. Each
stretch of text between block boundaries gives points for its length and commas to its ancestors, fewer the further
up, discounted by the share of their text that is in links. The element with the most points is the best container.
All of it is kept, and of its ancestors those other children that go with it: within an article element all, else
headings and paragraphs, containers of the same make with sentences in them, and containers that score close to it.

Names only suggest. A class or id counts if one of its tokens consists of a word for what isn't main text (ad,
sidebar, comments, ...) and words without meaning of their own (box, wrapper, list, body, user, ...), on containers
alone. Even then a container stays where next to nothing would be left without it, and so does one named as comments
that holds the title and most of the page. A single word that an article may be about (promotion, copyright, ...)
doesn't count against a section of prose in an article. Words that articles use too (related, social, ...) need a
container without long plain paragraphs besides. Without names, readers' comments are siblings of one make, each with
a time, that offer answers or follow a heading of comments. A header stays within the kept part if it has a heading
and no menu, a form if half of the page's points are in it; its controls go.

Defined results: a null or empty page, and one without main text, gives the empty text. A page without any tags
is one block. Repeated rows and null ids give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.common import table

TOKEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: The rest of a tag; a quoted value may hold ">".
REST = re.compile(r"((?:\"[^\"]*\"|'[^']*'|[^>\"']+)*+)>")
CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea iframe noembed noframes xmp".split()}
#: What an element's start ends, if it is open within the elements after the bar.
ENDS = {t: ({"p"}, {"button", "td", "th", "table", "caption"}) for t in BLOCKS - set("body html td th tr tbody thead tfoot caption option optgroup".split())}
ENDS |= {"dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "li": ({"li"}, {"ul", "ol", "menu", "dir"})}
ENDS |= {t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")} | {"tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select", "datalist"})}
ENDS |= {t: ({"tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = set("p li td th pre blockquote dd dt figcaption caption summary".split()) | HEADINGS
#: Elements that a class or an id may leave out.
CONTAINERS = set("div section aside ul ol dl table article header footer form details center li p".split())

OUT_TAGS = set("head nav aside button select option optgroup datalist script style template noscript iframe embed svg canvas audio video dialog menu title textarea".split())
OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids by what they suggest.
STRONG = set(
    """ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors promo promos promotion nav navbar navigation menu submenu
    breadcrumb breadcrumbs pagination pager masthead topbar footer bottombar sidebar aside notice notices cookie cookies consent gdpr popup modal overlay
    newsletter subscribe subscription signup login share sharing outbrain taboola recirculation copyright skip alert rail""".split()
)
#: Those of them that a section of an article may be about as well.
TOPICS = set("advertising promotion navigation menu notice notices cookie cookies consent subscription sponsor sponsors share sharing copyright alert rail aside popup modal overlay sidebar footer".split())
COMMENTS = set("comment comments commentlist disqus respond reply replies".split())
#: Words that go with these names and mean nothing against them.
QUALIFIERS = set("body user users reader readers fb facebook google dfp gpt mpu x thread threads tool tools legal privacy native display inline unit visitor visitors public".split())
WEAK = set("social related recommended recommendations widget widgets discussion hidden toolbar".split())
TOPS = set("header banner".split())
#: Words that say nothing of what a container holds, and those that turn the word after them.
NEUTRAL = set(
    """box block area wrap wrapper container list item items section links link bar top bottom left right main inner outer posts post articles article
    content entry story stories blog news text message messages buttons button icons icon policy row col column columns group module region panel component unit slot form
    float floating sticky fixed mobile desktop first last more id js page site global primary secondary to""".split()
)
SITE = set("page site global top main primary".split())
TURNS = set("has with no without is not non hide".split())
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
SENTENCE = re.compile(r"[.!?:;…。！？»”\"')]$")
RIGHTS = re.compile(r"(?i)(?:©|\(c\)\s*(?:19|20)?\d\d|\(c\)\s.{0,60}$|copyright\s*(?:©|\(c\)|(?:19|20)\d\d)|all rights reserved)")
#: A heading of links that belong to the text, and one of readers' comments; what stands in a comment besides its text.
SOURCES = re.compile(r"(?i)\W*(?:sources?|references?|(?:foot|end)?notes?|citations?|works cited|bibliography|further reading|literature|see also)\W*$")
SPEAKS = re.compile(r"(?i)\b(?:comments?|responses?|replies|discussion|reader reactions?|what readers say)\b")
WHEN = re.compile(r"(?i)\b(?:\d+\s*(?:min(?:ute)?s?|h(?:ou)?rs?|days?|weeks?|months?|years?|[mhdwy])\s+ago|\d{1,2}:\d\d|(?:19|20)\d\d-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2})\b")
ANSWER = re.compile(r"(?i)^\W*(?:reply|answer|like|report|flag|upvote|quote)\b.{0,20}$")
LEAST, LONG = 25, 100
#: Letters of prose beyond which a name that may be a topic is taken for one.
PROSE = 250

#: What an element is before its contents are known.
PLAIN, HARD, IS_STRONG, IS_COMMENT, IS_WEAK, IS_TOP, IS_FORM, IS_TOPIC = range(8)


def by_name(tag: str, names: str) -> int:
    """What the tokens of a class and an id suggest."""
    found = PLAIN
    for token in CAMEL.sub(r"\1-\2", names).lower().split():
        words = WORD.findall(token)
        if not words or words[0] in TURNS:
            continue
        if tag == "p" and len(words) > 1:
            continue
        meant = [w for w in words if w not in NEUTRAL]
        if not meant:
            continue
        named = [w for w in meant if w not in QUALIFIERS]
        if named and all(w in COMMENTS for w in named):
            return IS_COMMENT
        if any(w in STRONG for w in named) and all(w in STRONG or w in COMMENTS or w in TOPS or w in WEAK for w in named):
            if len(words) > 1 or words[0] not in TOPICS:
                return IS_STRONG
            found = found or IS_TOPIC
            continue
        if all(w in TOPS for w in meant):
            found = IS_STRONG if SITE & set(words) else IS_TOP
        elif all(w in WEAK or w in TOPS for w in meant) and tag != "p":
            found = found or IS_WEAK
    return found


def kind_of(tag: str, attributes: str, in_article: bool, in_quote: bool) -> int:
    kind = HARD if tag in OUT_TAGS else PLAIN
    if tag == "footer" and not in_quote:
        kind = IS_STRONG
    elif tag == "header" and not in_article:
        kind = IS_TOP
    elif tag == "form":
        kind = IS_FORM
    if kind == HARD or not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return kind
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if tag in ("html", "body"):
        return kind
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return HARD
    if tag != "main" and OUT_ROLES & set(found.get("role", "").lower().split()):
        return HARD
    if tag in CONTAINERS and kind in (PLAIN, IS_FORM, IS_TOP):
        named = by_name(tag, f"{found.get('class', '')} {found.get('id', '')}")
        if not (in_article and named == IS_TOP) and named:
            return named
    return kind


def extract(page: str) -> str:
    """The main text of a page: its blocks in order, joined by newlines."""
    tags, parents, ends, kinds, names = ["html"], [-1], [0], [PLAIN], [""]
    out, in_article, in_quote, in_form = [False], [False], [False], [False]
    own, linked = [0], [0]
    runs: list[tuple[int, str]] = []
    stack, blocks, counts = [0], [0], {"html": 1}
    parts: list[str] = []
    in_link = 0
    owner = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                runs.append((owner, text))
            parts = []

    def pop() -> None:
        nonlocal in_link
        k = stack.pop()
        ends[k] = len(tags)
        counts[tags[k]] -= 1
        in_link -= tags[k] == "a"
        if tags[k] in BLOCKS or not k:
            blocks.pop()

    def close(names: set[str], within: set[str]) -> None:
        """End the innermost of names, with all in it, unless one of within comes first."""
        if any(counts.get(n) for n in names):
            for at in range(len(stack) - 1, 0, -1):
                tag = tags[stack[at]]
                if tag in names:
                    while len(stack) > at:
                        pop()
                    return
                if tag in within:
                    return

    def settle() -> None:
        nonlocal owner
        owner = blocks[-1]

    at, quotes = 0, True
    while at < len(page):
        m = TOKEN.search(page, at)
        if m and m[1]:
            end = page.find("-->", m.end())
            rest, then = "", end + 3 if end >= 0 else len(page)
        elif m:
            whole = REST.match(page, m.end()) if m[4] and quotes else None
            if whole:
                rest, then = whole[1], whole.end()
            else:  # a quote that never ends: from here on the next ">" ends a tag
                quotes = quotes and not m[4]
                end = page.find(">", m.end())
                rest, then = page[m.end() : end], end + 1
                if end < 0:
                    m = None  # no tag ends here any more
        start = m.start() if m else len(page)
        if start > at and not out[stack[-1]]:
            text = html.unescape(page[at:start])
            parts.append(text)
            n = len(text) - text.count(" ")
            own[owner] += n
            if in_link:
                linked[owner] += n
        if not m:
            break
        at = then
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if m[3]:
            if tag in VOID or not counts.get(tag) or tag == "html":
                continue
            if tag in BLOCKS:
                flush()
                close({tag}, {"table"} - {tag} if tag not in ("table", "body", "article", "main", "section", "div") else set())
                settle()
            else:
                close({tag}, BLOCKS)
            continue
        if tag in RAW:
            done = RAW[tag].search(page, at)
            at = done.start() if done else len(page)
            if done and (gt := page.find(">", at)) >= 0:
                at = gt + 1
            else:
                at = len(page)
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if tag in ENDS:
            if tag not in ("p", "td", "th", "tr", "option", "tbody", "thead", "tfoot"):
                close(*ENDS["p"])
            close(*ENDS[tag])
        if block:
            settle()
        if tag == "body" and counts.get("head"):
            close({"head"}, set())
        if tag == "br":
            parts.append(" ")
        if tag in VOID or tag == "html":
            continue
        if tag == "a":
            close({"a"}, BLOCKS)
        top = stack[-1]
        k = len(tags)
        tags.append(tag)
        parents.append(top)
        ends.append(k + 1)
        kind = kind_of(tag, rest, in_article[top], in_quote[top])
        kinds.append(kind)
        classes = CLASS.search(rest) if block and rest else None
        names.append(" ".join(sorted((classes[1] or classes[2] or classes[3] or "").split())) if classes else "")
        out.append(out[top] or kind == HARD or in_form[top] and tag in ("label", "legend"))
        in_article.append(in_article[top] or tag == "article")
        in_quote.append(in_quote[top] or tag == "blockquote")
        in_form.append(in_form[top] or tag == "form")
        own.append(0)
        linked.append(0)
        stack.append(k)
        counts[tag] = counts.get(tag, 0) + 1
        in_link += tag == "a"
        if block:
            blocks.append(k)
            owner = k
    flush()
    while stack:
        pop()
    return "\n".join(text for k, text in choose(tags, parents, ends, kinds, names, in_article, own, linked, runs))


def gain_of(text: str) -> float:
    """Points of a stretch of text; less than a sentence gives a part of one."""
    return 1 + text.count(",") + min(len(text) // 100, 3) if len(text) >= LEAST else len(text) / LEAST / 2


def comments_by_shape(tags: list[str], parents: list[int], names: list[str], runs: list[tuple[int, str]]) -> set[int]:
    """Elements that are readers' comments by their shape: siblings of one make, two or more, each with a time and
    without a heading, that all offer an answer or follow a heading of comments."""
    texts: dict[int, list[str]] = {}
    timed, headed = set(), set()
    for k, text in runs:
        texts.setdefault(k, []).append(text)
    for k, tag in enumerate(tags):
        if tag == "time" or any(len(t) < LONG and WHEN.search(t) for t in texts.get(k, ())):
            up = k
            while up > 0 and up not in timed:
                timed.add(up)
                up = parents[up]
        if tag in HEADINGS:
            up = k
            while up > 0 and up not in headed:
                headed.add(up)
                up = parents[up]
    if not timed:
        return set()
    answers = set()
    for k, said in texts.items():
        if any(ANSWER.match(t) or len(t) < LONG and ANSWER.search(t.rsplit("·", 1)[-1].rsplit("|", 1)[-1]) for t in said):
            up = k
            while up > 0 and up not in answers:
                answers.add(up)
                up = parents[up]
    groups: dict[tuple[int, str, str], list[int]] = {}
    speaks: dict[int, int] = {}
    for k in range(1, len(tags)):
        if tags[k] in HEADINGS and any(len(t) < LONG and SPEAKS.search(t) for t in texts.get(k, ())):
            speaks.setdefault(parents[k], k)
        if tags[k] in CONTAINERS and k in timed and k not in headed:
            groups.setdefault((parents[k], tags[k], names[k]), []).append(k)
    found: set[int] = set()
    for (parent, *_), members in groups.items():
        # the heading stands before them, beside them or beside the list that holds them
        heads = [h for h in (speaks.get(parent), speaks.get(parents[parent]) if parent else None) if h is not None and h < members[0]]
        if len(members) > 1 and (heads or all(k in answers for k in members)):
            found.update(members)
            found.update(heads)
    return found


def choose(tags: list[str], parents: list[int], ends: list[int], kinds: list[int], names: list[str], in_article: list[bool], own: list[int], linked: list[int], runs: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The runs that are main text. Elements are numbered in page order; ends has the number after an element's last descendant."""
    n = len(tags)
    gain, clean, longest = [0.0] * n, 0.0, [0] * n
    doubtful = [False] * n
    for k in range(1, n):
        doubtful[k] = doubtful[parents[k]] or kinds[k] in (IS_STRONG, IS_COMMENT, IS_TOPIC)
    for k, text in runs:
        g = gain_of(text)
        gain[k] += g
        clean += 0.0 if doubtful[k] else g
        if own[k] and linked[k] <= own[k] // 2:
            longest[k] = max(longest[k], len(text))
    headed, menus = [t in HEADINGS for t in tags], [t == "nav" or k in (IS_STRONG, IS_TOPIC) for t, k in zip(tags, kinds)]
    titles, prose = [t == "h1" for t in tags], [0] * n
    for k, text in runs:
        if len(text) >= LONG and linked[k] <= own[k] // 2:
            prose[k] += len(text)
    total, share_own, share_linked = gain[:], own[:], linked[:]
    for k in range(n - 1, 0, -1):
        p = parents[k]
        total[p] += total[k]
        share_own[p] += share_own[k]
        share_linked[p] += share_linked[k]
        longest[p] = max(longest[p], longest[k])
        headed[p] |= headed[k]
        menus[p] |= menus[k]
        titles[p] |= titles[k]
        prose[p] += prose[k]
    spoken_of = comments_by_shape(tags, parents, names, runs)
    dense = lambda k: share_linked[k] / max(1, share_own[k])
    gone = bytearray(n)
    for k in range(1, n):
        kind, drop = kinds[k], False
        if kind == IS_COMMENT:
            # what holds the page's title and most of its text is a piece of opinion
            drop = not (titles[k] and total[k] >= 0.5 * total[0])
        elif k in spoken_of:
            drop = True
        elif kind == IS_STRONG:
            drop = clean >= 0.1 * total[k]
        elif kind == IS_TOPIC:
            # a section of prose about it, in an article, or a box that is named for what it is
            drop = clean >= 0.1 * total[k] and not (in_article[k] and prose[k] >= PROSE and dense(k) < 0.3)
        elif kind == IS_WEAK:
            drop = longest[k] < LONG or dense(k) > 0.5
        elif kind == IS_TOP:
            drop = not headed[k] or menus[k] or dense(k) > 0.5 or tags[parents[k]] in ("body", "html")
            drop = drop and clean >= 0.1 * total[k]
        elif kind == IS_FORM:
            drop = total[k] < 0.5 * total[0]
        gone[k] = drop or gone[parents[k]]
    kept_runs = [(k, text) for k, text in runs if not gone[k]]
    points: dict[int, float] = {}
    for k, text in kept_runs:
        g = gain_of(text)
        up = parents[k] if tags[k] in PARAGRAPHS and k else k
        for share in (1, 2, 6, 9):
            if up < 0:
                break
            points[up] = points.get(up, 0.0) + g / share
            up = parents[up]
    if not points:
        return []
    own, linked = own[:], linked[:]
    total = [0.0] * n
    for k, text in kept_runs:
        total[k] += gain_of(text)
    for k in range(n - 1, 0, -1):
        if gone[k]:
            own[k] = linked[k] = 0
        own[parents[k]] += own[k]
        linked[parents[k]] += linked[k]
        total[parents[k]] += total[k]
    dense = lambda k: linked[k] / max(1, own[k])
    best = max(points, key=lambda k: (points[k] * (1 - dense(k)), k))
    texts: dict[int, list[str]] = {}
    for k, text in kept_runs:
        texts.setdefault(k, []).append(text)
    spoken, titled = [False] * n, [False] * n
    for k in range(n - 1, 0, -1):
        if not gone[k]:
            spoken[k] |= any(SENTENCE.search(t) and not (len(t) < 2 * LONG and RIGHTS.match(t)) for t in texts.get(k, ()))
            titled[k] |= tags[k] == "h1" and k in texts
            spoken[parents[k]] |= spoken[k]
            titled[parents[k]] |= titled[k]
    held = bytearray(n)
    first = next((k for k, _ in kept_runs if best <= k < ends[best]), best)
    path = -1 if tags[best] in ("body", "html") else best
    if path >= 0:
        held[best : ends[best]] = b"\1" * (ends[best] - best)
    while path < 0 or parents[path] >= 0:
        p = best if path < 0 else parents[path]
        inside = in_article[p]
        if texts.get(p) and (inside or path < 0 or dense(p) <= 0.5):
            held[p] = 1
        goes = True  # whether what follows a heading is kept
        children = []
        k = p + 1
        while k < ends[p]:
            children.append(k)
            k = ends[k]
        after = None  # the heading that a child follows
        title = {}
        for k in children:
            title[k] = after
            if not gone[k] and total[k]:
                after = k if tags[k] in HEADINGS else None
        for k in reversed(children):
            if k == path:
                goes = True
                continue
            if gone[k] or not total[k]:
                continue
            tag, rights = tags[k], any(len(t) < 2 * LONG and RIGHTS.match(t) for t in texts.get(k, ()))
            quiet = dense(k) < 0.1 and not rights
            if inside:
                keep = True
            elif tag in HEADINGS:
                keep = goes and not (path >= 0 and tag == "h1" and titled[best])
            elif tag in CONTAINERS and tag not in ("p", "ul", "ol", "dl", "table"):
                close = path < 0 or total[k] >= 0.2 * total[best] and dense(k) < 0.25
                alike = path >= 0 and tag == tags[path] and names[k] == names[path]
                keep = (spoken[k] or quiet) and dense(k) < 0.5 and (close or alike) or 0 <= path and k < path and quiet and title[k] is not None and own[k] < 3 * LONG or kinds[k] == IS_TOP and not titled[best] and tags[first] not in HEADINGS
            else:
                listed = title[k] is not None and any(SOURCES.match(t) for t in texts.get(title[k], ()))
                keep = listed or dense(k) <= 0.5 and not rights and (spoken[k] or own[k] >= LEAST or k < path and title[k] is not None)
            if tag not in HEADINGS:
                goes = keep
            if keep:
                held[k : ends[k]] = b"\1" * (ends[k] - k)
        path = p
        if not p:
            break
    return [(k, text) for k, text in kept_runs if held[k]]


def pages_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page) if page else "" for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    held = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return held.mapInArrow(pages_text, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
