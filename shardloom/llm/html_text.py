"""HTML main-text extraction by a maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    # empty: ends in "/>" that is not the end of an unquoted value
    r"|<(?:svg|iframe)(?=[\s/])(?:\"[^\"]*\"|'[^']*'|[^>\"'=]|=\s*(?=[\"'])|=\s*[^\s>\"']+(?=[\s>]))*?/>"
    r"|<(script|style|noscript|template|textarea|svg|iframe|select|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPACE = re.compile(r"\s+")
# Elements that end a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements of any kind whose names may mark them, and what ends those that are often left open.
INLINE = frozenset("span ins a".split())
NAMED = BLOCK | INLINE
UNTIL = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "td": "tr table", "th": "tr table", "tr": "table"}
LOOSE = frozenset("p li td tr th dt dd".split())  # kept in mind only if marked
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
# "has-sidebar", "page-with-comments", "no-banner": what follows says what a layout has or lacks.
HAVING = frozenset("has with without no not hide hides show shows".split())
# Marked elements with more than this share of the page's words hold its text; of comments, with nearly all.
BULK, BULK_REPLIES = 0.5, 0.9
REPLY_WORDS = frozenset("comment comments commentlist replies reply respond disqus".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Labelled pages: the main text stands between the two marks. All that is known of tags and names comes from them.
BEGIN, END = "<!--begin main-->", "<!--end main-->"
LABELLED = (
    '<html><head><title>Harbour</title>Harbour Daily</head><body><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">About us</a></li></ul></nav><div class="ad">Buy one and get one free today only.</div>'
    "<!--begin main--><article class='post article'><h1>The harbour opens again</h1><p>After two years of work the old harbour opens on Monday.</p><p>Ships will arrive <b>early</b> in the morning.<br>The mayor is glad.</p></article><!--end main--><footer>&copy; Harbour Daily. All rights reserved.</footer></body></html>",
    '<html><body><header><a href="/">Home</a> <a href="/shop">Shop</a></header><div id="content" class="page wrapper"><!--begin main--><h1>How to bake bread</h1><p>Mix flour, water, salt and yeast.</p><ul class="list items"><li class="item">Knead the dough for ten minutes.</li><li class="item">Let it rise for an hour.</li></ul><p>Then bake it until it is brown.</p><!--end main--></div>'
    '<aside class="sidebar widget-area"><ul><li><a href="/x">Cakes</a></li><li><a href="/y">Soups</a></li></ul></aside><div class="comments"><p>Great recipe, thank you so much!</p><p>Mine came out flat.</p></div><footer><a href="/imprint">Imprint</a></footer></body></html>',
    '<html><body><div class="cookie-notice">We use cookies. <button>Accept</button></div><div class="menu"><a href="/1">One</a><a href="/2">Two</a></div><main><!--begin main--><h2 class="title">Notes on rivers</h2><p>A river carries <a href="/silt">silt</a> to the sea.</p><blockquote>No one steps in the same river twice.</blockquote>'
    '<p>In spring the water is high and the meadows are under water for some weeks.</p><!--end main--></main><form><label>Mail</label><input type="text"></form><div class="related"><a href="/3">Lakes</a><a href="/4">Ponds</a></div></body></html>',
    '<html><body><div role="banner" class="site-header masthead"><div id="search" role="search">Search this site</div><div class="login toolbar">Log in or sign up</div></div><div role="navigation" class="navbar navigation breadcrumbs"><a href="/">Home</a> <a href="/g">Garden</a></div>'
    '<div class="container main-content left"><!--begin main--><div class="section text block body"><h1 class="headline">Pruning apple trees</h1><p class="lead intro">Late winter is the best time to prune an apple tree, before the buds open.</p><div class="box inner"><p>Cut dead wood first, then branches that cross.</p></div><p>Seal nothing: a clean cut heals by itself.</p></div><!--end main-->'
    '<div class="share-bar share sharing"><span class="social-links">Share this on your favourite network</span><ul class="social buttons"><li>Post</li></ul></div><div class="pagination pager">Page 1 of 3 <a href="?p=2">Next</a></div></div><div class="right col"><div class="promo-box promoted promotion">Our new pruning saw, half the price</div><div class="sponsored sponsor">Paid for by Saws and Sons</div></div>'
    '<div class="footer bottom">Garden Weekly, 12 Orchard Road</div></body></html>',
    '<html><body class="home"><div class="popup modal"><div class="newsletter signup">Get our newsletter every week <button>Sign up</button></div></div><dialog>Are you still there?</dialog><div id="consent" class="gdpr overlay">Manage your consent choices</div><ins class="adsbygoogle">Cheap flights to the sun</ins>'
    '<div class="content area row"><!--begin main--><article class="entry"><header class="entry-header"><h1 class="entry-title">A night on the glacier</h1></header><div class="entry-content"><p>We left the hut at midnight, roped together, with the moon behind the ridge.</p><figure class="image media"><figcaption class="caption">The ridge at dawn</figcaption></figure><p>At four the snow turned blue and nobody spoke.</p><table class="table data"><tr><td class="cell">Height</td><td class="cell">3,480 m</td></tr></table></div></article><!--end main-->'
    '<div class="advert">Warm socks for cold nights</div><div id="comments" class="commentlist comment-area"><article class="comment"><p>What a trip, I was there last year in June!</p></article><div id="respond" class="comment-form replies reply">Leave a reply</div></div></div><div class="recommended recommendations outbrain taboola">You may also like these ten huts</div><menu><li>Map</li><li>Huts</li></menu></body></html>',
    '<html><body><div class="page-header header"><div class="header-inner">Work and Law, the free guide to your rights at work, in plain words</div></div><div class="topbar top"><a class="skip-link" href="#m">Skip to text</a></div><div id="nav" class="menu-main"><ul><li>Law</li><li>Work</li></ul></div><div id="main" class="columns grid"><!--begin main--><div class="story"><h1>Your notice period</h1><p>The law gives every worker at least four weeks, and the contract may give more.</p><div class="warning note"><p>Send the letter by post: a message by telephone is not enough.</p></div><div class="col right top bottom bar site overlay"><p>A site with fewer than five workers may shorten the notice by agreement. <ins>Since last spring</ins> the agreement must be <span>in writing</span>, and both sides keep a copy of it for three years.</p><p class="links">The <a class="link" href="/text">full text of the law</a> and <a href="/cases">the cases that explain it</a> are open to all.</p></div><dl class="terms"><dt>Worker</dt><dd>One who works for pay.</dd></dl><p class="source quote">See the results of the last court cases for the history of this rule.</p></div><!--end main-->'
    '<div class="sidebar right"><div class="widget widgets">Most read this week</div><div class="adv ads advertisement adverts adsense banner">Lawyers near you call now</div><div class="breadcrumb subscribe subscription">Subscribe for two pounds a month</div><div class="cookies disclaimer copyright">All content protected</div></div><footer class="contentinfo complementary">Work and Law, London</footer></div></body></html>',
)


def name_words(attributes: str) -> list[list[str]]:
    """The words of each name in class, id and role values, up to a word of HAVING."""
    out = []
    for a in NAMES.findall(attributes):
        for name in "".join(a).lower().split():
            words = []
            for w in re.split(r"[^a-z0-9]+", name):
                if w in HAVING:
                    break
                if w:
                    words.append(w)
            out.append(words)
    return out


class Marks:
    """Which tags and names mark boilerplate: log odds of the words inside them, from labelled pages."""

    def __init__(self, labelled: tuple[str, ...] = LABELLED, bar: float = -1.0) -> None:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for page in labelled:
            main, open_ = False, []
            for m in TOKEN.finditer(page):
                name = (m[3] or "").lower()
                if m[0] in (BEGIN, END):
                    main = m[0] == BEGIN
                elif not name and m[1] is None and not m[0].startswith("<"):
                    n = len(m[0].split())
                    seen[main].update({"": n} | dict.fromkeys({f for _, own in open_ for f in own}, n))
                elif name and m[2]:
                    while open_ and open_.pop()[0] != name:
                        pass
                elif name and name not in VOID:
                    open_.append((name, {f"<{name}>", *(w for names in name_words(m[4]) for w in names)}))
        every = seen[True][""], seen[False][""]
        self.weight = {f: math.log((seen[True][f] + 0.5) / (every[0] + 1)) - math.log((seen[False][f] + 0.5) / (every[1] + 1)) for f in seen[True] | seen[False] if f}
        self.bar, self.known = bar, {}

    def tag(self, name: str) -> bool:
        return name not in INLINE and self.weight.get(f"<{name}>", 0.0) < self.bar

    def words(self, attributes: str) -> frozenset[str]:
        """The words that mark the element. A name counts if its last word is one of the labelled pages'."""
        found = self.known.get(attributes)
        if found is None:
            if len(self.known) > 20_000:
                self.known.clear()
            found = self.known[attributes] = frozenset(w for names in name_words(attributes) if names and names[-1] in self.weight for w in names if self.weight.get(w, 0.0) < self.bar)
        return found


class Wrapper:
    """An element marked by its names, while the page is read: what it holds."""

    def __init__(self, at: int, words: int, replies: bool) -> None:
        self.at, self.words, self.replies = at, words, replies
        self.main, self.articles = False, []


def tokens(page: str, marks: Marks) -> list[tuple[str, str, bool]]:
    """(kind, value, aside): words as text runs, tags by name; aside: inside a marked element.

    Names do not mark an element that holds main, the longest article or the bulk of the
    page's words: it is a layout, whatever its name says.
    """
    found, wrappers, words, longest = walked(page, frozenset(), marks)
    plain = frozenset(w.at for w in wrappers if w.main or longest in w.articles or w.words > (BULK_REPLIES if w.replies else BULK) * words)
    return walked(page, plain, marks)[0] if plain else found


def walked(page: str, plain: frozenset[int], marks: Marks) -> tuple[list[tuple[str, str, bool]], list[Wrapper], int, int]:
    """Tokens, if the names of the elements at plain do not count; the elements that names mark; words; the longest article (-1: none).

    Words are those outside elements whose tags mark them. Articles that names mark do not count.
    """
    found: list[tuple[str, str, bool]] = []
    open_: list[tuple[str, bool, bool, Wrapper | None, int, int]] = []
    wrappers: list[Wrapper] = []
    inside = articles = named = words = 0
    longest, most = -1, 0

    def ended(part: list) -> None:
        nonlocal inside, articles, named, longest, most
        for name, aside, by_name, wrapper, at, before in part:
            inside -= aside
            articles -= name == "article"
            named -= by_name
            if wrapper:
                wrapper.words = words - wrapper.words
            if at >= 0 and (words - before > most or longest < 0):
                longest, most = at, words - before

    for m in TOKEN.finditer(page):
        whole = m[0]
        name = m[3]
        if name is None:
            if m[1] is not None or (whole[0] == "<" and whole != "<"):
                if whole in (BEGIN, END):
                    found.append(("mark", whole, False))
                elif m[1] is not None:
                    found.append(("raw", m[1].lower(), inside > 0))
                continue
            found.append(("text", whole, inside > 0))
            if not named:
                words += len(whole.split())
            continue
        name = name.lower()
        if m[2]:
            found.append(("close", name, inside > 0))
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    ended(open_[i:])
                    del open_[i:]
                    break
            continue
        if name in BLOCK or name in UNTIL:  # ends what is often left open
            stop = UNTIL.get(name, "").split()
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == "p" or open_[i][0] in SAME.get(name, (name,)) and name in UNTIL:
                    ended(open_[i:])
                    del open_[i:]
                elif not stop or open_[i][0] in stop:
                    break
        by_tag = marks.tag(name) or (name == "header" and not articles)
        if not by_tag and name not in NAMED:
            found.append(("open", name, inside > 0))
            continue
        own = marks.words(m[4]) if m[4] and name not in ("body", "html", "main") else frozenset()
        if articles:
            own -= {"header"}  # an article's own heading
        marked = by_tag or bool(own)
        if name in VOID or m[4].endswith("/") or (name in LOOSE and not marked):
            marked = False  # nothing to close
        else:
            wrapper, at = None, len(found)
            if marked and not by_tag:
                wrapper = Wrapper(at, words, not REPLY_WORDS.isdisjoint(own))
                if at in plain:
                    marked = False
                elif name != "article":
                    wrappers.append(wrapper)
            lone = name == "article" and not marked and not named
            if not named and (name == "main" or lone):
                for _, _, _, w, _, _ in open_:
                    if w and name == "main":
                        w.main = True
                    elif w:
                        w.articles.append(at)
            open_.append((name, marked, by_tag, wrapper, at if lone else -1, words))
            inside += marked
            named += by_tag
            articles += name == "article"
        found.append(("open", name, inside > 0))
    ended(open_)
    return found, wrappers, words, longest


class Scorer:
    """Weights of words and tags: log odds of standing in the main text, from labelled pages.

    A word outside marked elements scores 1. A tag scores its log odds in units of a word's, but
    always below 0: a link costs up to a word, any other tag up to a quarter. Words inside marked
    elements, which are left out of the text anyway, weigh a quarter against it.
    """

    def __init__(self, labelled: tuple[str, ...] = LABELLED) -> None:
        self.marks = Marks(labelled)
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for page in labelled:
            main = False
            for kind, value, _ in tokens(page, self.marks):
                if kind == "mark":
                    main = value == BEGIN
                elif kind != "raw":
                    seen[main].update({"": len(value.split())} if kind == "text" else {value: 1})
        every = [sum(seen[k].values()) + 1 for k in (True, False)]
        odds = {k: math.log((seen[True][k] + 0.5) / every[0]) - math.log((seen[False][k] + 0.5) / every[1]) for k in seen[True] | seen[False]}
        unit = max(0.05, odds.pop("", 0.0))
        self.tag = {k: max(-1.0 if k == "a" else -0.25, min(-0.01, v / unit)) for k, v in odds.items()}

    def score(self, kind: str, value: str, aside: bool) -> float:
        if kind == "text":
            return len(value.split()) * (-0.25 if aside else 1.0)
        return 0.0 if kind in ("mark", "raw") else self.tag.get(value, -0.1)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum, in one linear scan.

    Of equal sums the first, and of it the longest start; (0, 0) if nothing is positive.
    """
    best, span = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def whole_elements(found: list[tuple[str, str, bool]], name: str) -> list[tuple[int, int]]:
    """Start and end of the outermost unmarked elements of this name."""
    depth, spans, begin = 0, [], 0
    for i, (kind, value, aside) in enumerate(found):
        if value == name and kind == "open" and not aside:
            begin = i if not depth else begin
            depth += 1
        elif value == name and kind == "close" and depth:
            depth -= 1
            if not depth:
                spans.append((begin, i))
    return [*spans, (begin, len(found))] if depth else spans


def main_text(page: str | None, scorer: Scorer) -> str:
    """The main text: blocks of the best region without its marked elements, joined by blank lines."""
    if not page:
        return ""
    found = tokens(page, scorer.marks)
    start, end = best_region([scorer.score(*t) for t in found])
    spans = whole_elements(found, "article") or whole_elements(found, "main")
    met = [(a, b) for a, b in spans if a < end and b > start]
    if met:  # the region belongs to whole articles, or else to main
        start, end = min(a for a, _ in met), max(b for _, b in met)
    blocks, now = [], []

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, aside in found[start:end]:
        if kind == "text":
            if not aside:
                now.append(value)
        elif kind in ("open", "close"):
            if value in BLOCK:
                close()
            elif value == "br":
                now.append(" ")
    close()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame, labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    A linear scan finds the contiguous region of the largest score (words outside marked
    elements positive, tags and words inside them negative); it is widened to the ends of the
    articles (or else of main) that it meets. Which tags and which names of class, id and role mark menus, headers,
    sidebars, notices, adverts, forms and reader comments, and all weights, are log odds from the
    labelled pages; elements so marked are the negative holes that the region leaves out. A
    wrapper of main, the longest article or most words is none of these, nor is an element with a
    name whose last word the labelled pages do not know. Character references are decoded, white
    space inside a block is one space, blocks are joined by two line breaks; nothing is cut.

    pages needs page_id, url, html; other columns are ignored. Null or empty html gives an empty
    text, of any length it is read whole; repeated rows are treated alike, an empty table gives no
    rows. Pages are independent: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(labelled)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                text = [main_text(t, scorer) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
