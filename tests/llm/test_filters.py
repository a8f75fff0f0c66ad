import math
from collections import Counter

import brute
import pytest
from oracle import connect, rows_of_duck, rows_of_spark

from shardloom.llm.decontaminate import OP10_SQL, RADIUS, _variants, decontaminated, matches, op10_benchmark_decontamination
from shardloom.llm.html_text import LABELLED, Scorer, best_region, extracted, main_text, op9_html_extraction
from shardloom.llm.quality import grams, judged, kneser_ney, op2_quality_classifier, pieces, score_grams, scored
from shardloom.llm.url_filter import OP1_SQL, Rule, host_and_path, judged as judged_pages, op1_url_filter, propagate


# --- URL filter

def test_op1_on_the_table(spark, sf_dir):
    assert rows_of_spark(op1_url_filter(spark, sf_dir)) == rows_of_duck(connect(sf_dir), OP1_SQL)


def test_hosts_paths_and_rules(spark):
    from pyspark.sql import functions as F

    urls = {"HTTP://Www.Example.COM:80/en/A?x#y": ("www.example.com:80", "/en/A"), "https://a.net": ("a.net", ""), "ftp://B?q": ("b", ""), "nothing": ("", ""), None: ("", ""), "x://É.com/#f": ("É.com", "/"), "a://b/c://d": ("b", "/c://d"), "": ("", "")}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = host_and_path(F.col("url"))
    assert {r["url"]: (r["h"], r["p"]) for r in df.select("url", host.alias("h"), path.alias("p")).collect()} == urls
    pages = spark.createDataFrame([(i, u, None, "z", 1) for i, u in enumerate(["http://a.com/", "http://com/x", "http://acom/", "http://example.com/en/1", "http://m.example.com/en/1", "http://www.example.com/en/1", "http://x.net/es/", "http://x.net/es", None])], "page_id long, url string, html string, host string, rule int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged_pages(pages).collect()}
    assert got == {0: ("com/", "allow"), 1: ("com/", "allow"), 2: (None, "allow"), 3: ("example.com/en/", "block"), 4: ("example.com/en/", "block"), 5: ("www.example.com/en/", "allow"), 6: ("net/es/", "block"), 7: (None, "block"), 8: (None, "allow")}
    assert judged_pages(pages.limit(0)).count() == 0


def test_trust_and_distrust_follow_links(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/p">x</a>' for h in hosts)
    rows = [(1, "http://good.com/", link("friend.org", "hub.org")), (2, "http://friend.org/", link("far.org")), (3, "http://far.org/", ""), (4, "http://bad.net/es/", link("hub.org")), (5, "http://shill.org/", link("bad.net", "bad.net")), (6, "http://lone.org/", "<a href='/x'>"), (7, "http://hub.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = (Rule("com", "/", "allow"), Rule("net", "/es/", "block"))
    got = {r["page_id"]: r for r in judged_pages(pages, rules).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    assert got[2]["trust"] > got[3]["trust"] > 0 and got[5]["distrust"] > 0 and got[7]["distrust"] in (0, None)
    # the same power iteration, plainly
    edges = {"good.com": {"friend.org": 1, "hub.org": 1}, "friend.org": {"far.org": 1}, "bad.net": {"hub.org": 1}, "shill.org": {"bad.net": 1}}
    rank = {"good.com": 1.0}
    for _ in range(12):
        new = {"good.com": 0.15}
        for s, out in edges.items():
            for d, w in out.items():
                new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * w / sum(out.values())
        rank = new
    links = spark.createDataFrame([(s, d, float(w)) for s, o in edges.items() for d, w in o.items()], "src string, dst string, w double")
    seeds = spark.createDataFrame([("good.com", 1.0, 0.0), ("bad.net", 0.0, 1.0)], "host string, trusted double, blocked double")
    trust = {r["host"]: r["trust"] for r in propagate(links, seeds).collect() if r["trust"] > 0}
    assert trust.keys() == {h for h, v in rank.items() if v > 0} and all(abs(trust[h] - rank[h]) < 1e-12 for h in trust)


def test_walks_reach_all_hosts_and_equal_brute_force(spark):
    """A chain of 20 links to a blocked host, a loop, links without a scheme, and random links; the walks done plainly for 1,000 rounds."""
    import random

    rnd = random.Random(3)
    to = {f"h{i}.org": [f"h{i + 1}.org"] for i in range(20)} | {"h20.org": ["blocked.net"], "blocked.net": []}
    near = [f"r{i}.org" for i in range(12)] + ["a.com", "b.com", "c.net"]
    to |= {h: rnd.sample([x for x in near if x != h], rnd.randrange(4)) for h in near}
    pages = [(h, "/es/" if h.endswith(".net") else "/", out) for h, out in to.items() for _ in range(1 + (h == "a.com"))]
    pages += [("c.net", "/", ["a.com"]), ("lone.org", "/", [])]
    forms = ('<a href="http://{}/p">', "<a href='//{}/p'>", "<a href=//{}>", '<a href="/x"> {{}}<a href="HTTPS://{}">')
    rows = [(i, f"http://{h}{p}", "".join(forms[(i + k) % 4].format(d) for k, d in enumerate(out))) for i, (h, p, out) in enumerate(pages)]
    rules = (Rule("com", "/", "allow"), Rule("net", "/es/", "block"))
    got = {r["page_id"]: r for r in judged_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    links = Counter((h, d) for h, _, out in pages for d in out)

    def walk(fits, edges):
        n, hit = Counter(h for h, _, _ in pages), Counter(h for h, p, _ in pages if fits(h, p))
        seed = {h: hit[h] / n[h] for h in hit}
        seed = {h: v / sum(seed.values()) for h, v in seed.items()}
        total = Counter()
        for (s, _), w in edges.items():
            total[s] += w
        rank = dict(seed)
        for _ in range(1000):
            new = {h: 0.15 * v for h, v in seed.items()}
            for (s, d), w in edges.items():
                if s in rank:
                    new[d] = new.get(d, 0) + 0.85 * rank[s] * w / total[s]
            rank = new
        return rank

    trust = walk(lambda h, p: h.endswith(".com"), links)
    distrust = walk(lambda h, p: h.endswith(".net") and p == "/es/", {(d, s): w for (s, d), w in links.items()})
    reached = len(trust.keys() | distrust.keys())
    scale = [reached / sum(x.values()) for x in (trust, distrust)]
    for i, (h, p, _) in enumerate(pages):
        t, d = trust.get(h, 0) * scale[0], distrust.get(h, 0) * scale[1]
        rule = "allow" if h.endswith(".com") else "block" if h.endswith(".net") and p == "/es/" else None
        assert got[i]["verdict"] == (rule or ("block" if d > t else "allow")), h
        assert abs((got[i]["trust"] or 0) - t) < 1e-6 and abs((got[i]["distrust"] or 0) - d) < 1e-6, h
    assert {r["verdict"] for r in got.values() if r["host"][0] == "h"} == {"block"}


def test_op1_on_a_table_with_links(spark, tmp_path):
    rows = [(1, "http://a.com/", '<a href="http://far.org/">'), (2, "http://b.net/es/", ""), (3, "http://s.org/", '<a href="//t.org/x">'), (4, "http://t.org/", "<a href=http://b.net/>"), (5, "http://far.org/", ""), (6, "http://lone.org/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["verdict"], r["trust"] > 0, r["distrust"] > 0) for r in op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: ("allow", True, False), 2: ("block", False, True), 3: ("block", False, True), 4: ("block", False, True), 5: ("allow", True, False), 6: ("allow", False, False)}


def test_op1_equals_its_sql_on_a_graph_of_hosts(spark, tmp_path):
    """Some hundred hosts with cycles, dangling hosts and a hub; scores to six digits."""
    import random

    rnd = random.Random(6)
    hosts = [f"h{i}.{rnd.choice(['com', 'net', 'org', 'org'])}" for i in range(120)]
    forms = ('<a href="http://{}/p">', "<a href='//{}/p'>", "<a href=//{}>", '<A HREF="/x"> <a href="HTTPS://{}?q">')
    rows = []
    for i in range(400):
        h = rnd.choice(hosts)
        to = [] if hosts.index(h) % 7 == 0 else [rnd.choice(hosts) for _ in range(rnd.randrange(4))] + [hosts[1]]
        rows.append((i, f"http://{h}{rnd.choice(['/es/', '/fr/x', '/'])}", "".join(rnd.choice(forms).format(d) for d in to)))
    rows += [(400, None, '<a href="//x.com/">'), (401, "http://lone.org", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = {r[0]: r for r in c.sql(f"select {', '.join(columns)}, trust, distrust from ({OP1_SQL})").fetchall()}
    got = {r["page_id"]: r for r in op1_url_filter(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len({r["verdict"] for r in got.values() if not r["rule"]}) == 2
    for i, r in got.items():
        assert tuple(r[k] for k in columns) == want[i][:5] and abs(r["trust"] - want[i][5]) < 1e-6 and abs(r["distrust"] - want[i][6]) < 1e-6, i


# --- quality

def test_grams_cover_each_text_once():
    parts = pieces("abc", 5) + pieces(None, 5) + pieces("日本\U0001f600", 5)
    known, code, owner = grams(parts, 5)
    assert [known[c] for c, o in zip(code, owner, strict=True) if o == 0] == ["\2\2\2\2a", "\2\2\2ab", "\2\2abc", "\2abc\3"]
    assert Counter(owner.tolist()) == {0: 4, 1: 1, 2: 4}
    from shardloom.llm import quality

    old, quality.PIECE = quality.PIECE, 3
    try:
        cut = grams(pieces("hello world", 4), 4)
    finally:
        quality.PIECE = old
    whole = grams(pieces("hello world", 4), 4)
    assert Counter(cut[0][c] for c in cut[1]) == Counter(whole[0][c] for c in whole[1])


def test_kneser_ney_is_a_distribution(spark):
    """Over all characters after a seen context the probabilities sum to one."""
    seen = Counter()
    for t in ["abracadabra", "abba", "cab", "dab cab"]:
        known, code, _ = grams(pieces(t, 3), 3)
        seen.update(known[c] for c in code)
    model, floor = kneser_ney(spark.createDataFrame(list(seen.items()), "gram string, n long"), 3)
    alphabet = sorted({g[-1] for g in seen})
    assert abs(floor - 1 / (1 + len(alphabet))) < 1e-12
    asked = ["ab" + c for c in [*alphabet, "?"]] + ["zz" + c for c in [*alphabet, "?"]]
    logp = {r["gram"]: r["logp"] for r in score_grams(spark.createDataFrame([(g,) for g in asked], "gram string"), model, floor, 3).collect()}
    for context in ("ab", "zz"):
        assert abs(sum(math.exp(v) for g, v in logp.items() if g.startswith(context)) - 1) < 1e-5
    assert logp["abr"] > logp["abd"]


def test_junk_goes_and_clean_stays(spark):
    rows, labels = [], []
    import random

    rnd = random.Random(5)
    words = ["the", "of", "river", "stone", "and", "water", "under", "bridge", "slow", "over"]
    for i in range(80):
        rows.append((i, " ".join(rnd.choice(words) for _ in range(80)) + ".", "en", 1.0))
        if i < 40:
            labels.append((i, 1, 0))
    rows += [(100, " ".join(rnd.choice(words) + "***" for _ in range(80)), "en", 1.0), (101, "RIVER!! STONE!! " * 40, "en", 1.0), (102, None, "en", 1.0), (103, "  ", None, 1.0), (104, rows[50][1], None, 1.0), (104, rows[50][1], None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double")
    out = judged(docs.drop("perplexity").withColumnRenamed("lang", "lang"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(got[i] for i in range(80)) and got[104] and not any(got[i] for i in (100, 101, 102, 103))
    assert out.count() == len(rows)
    none = judged(docs.drop("perplexity"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["kept"] for r in none.where("doc_id in (102, 103)").collect()} == {False} and none.where("kept").count() == len(rows) - 2
    assert judged(docs.drop("perplexity").limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_perplexity_by_brute_force(spark):
    """Mean surprise of each text under the interpolated modified Kneser-Ney model, computed plainly."""
    import random

    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice("aab ceé") for _ in range(rnd.randrange(1, 60))) + ".", "en" if i % 3 else None) for i in range(60)]
    labels = [(i, 1, 0) for i in range(25)] + [(40, 1, 1), (41, 0, 0)]
    order = 4
    of = lambda t: ["\2" * (order - 1) + t + "\3"][0]
    top = Counter(g for i, t, _ in rows if i < 25 for x in [of(t)] for g in (x[k : k + order] for k in range(len(x) - order + 1)))
    counts = {order: top}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    floor = 1 / (1 + len(counts[1]))

    def discount(m, c):
        n = [sum(v == i for v in counts[m].values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        i = min(c, 3)
        return min(i, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else i / 2

    def p(g):
        if not g:
            return floor
        m = len(g)
        follow = {x: c for x, c in counts[m].items() if x[:-1] == g[:-1]}
        if not follow:
            return p(g[1:])
        s = sum(follow.values())
        own = (follow[g] - discount(m, follow[g])) / s if g in follow else 0.0
        return own + sum(discount(m, c) for c in follow.values()) / s * p(g[1:])

    memo = {}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), order=order).collect()}
    for i, t, _ in rows:
        x = of(t)
        each = [math.log(memo.setdefault(g, p(g))) for g in (x[k : k + order] for k in range(len(x) - order + 1))]
        assert got[i]["n_tokens"] == len(each) and got[i]["perplexity"] == pytest.approx(math.exp(-sum(each) / len(each)), rel=1e-4), i


def test_quality_keeps_columns_of_any_name(spark):
    names = ["n_tokens", "perplexity", "low_bound", "high_bound", "kept", "rid", "of", "known", "n", "logp", "q", "mid", "h", "row", "a.b"]
    docs = spark.createDataFrame([(i, "some words of a text " * (1 + i % 4), "en") for i in range(30)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = scored(docs, labels).select("row.*").collect()
    assert len(got) == 30 and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
    flat = judged(docs, labels)
    assert flat.columns == [c for c in docs.columns if c not in names[:5]] + names[:5] and flat.where("kept").count() == 30


def test_op2_accuracy(spark):
    """Held-out labels: of the good documents nearly all stay, of the bad ones most go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    kept = {r["doc_id"] for r in judged(spark.read.parquet(f"{sf}/documents.parquet"), half).where("kept").select("doc_id").collect()}
    told = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    good, bad = [d for d, q in told.items() if q], [d for d, q in told.items() if not q]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d in kept for d in bad) <= 0.2 * len(bad)
    assert op2_quality_classifier(spark, sf).count() > 800


# --- HTML

def test_labelled_pages_come_out():
    s = Scorer()
    for page in LABELLED:
        text = main_text(page, s)
        assert "\n\n" in text and not any(x in text for x in ("Sport", "Buy one", "reserved", "cookies", "Great recipe", "Cakes", "Ponds", "Mail", "Imprint"))


def test_region_is_the_maximum():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        x = [rnd.choice([-2.0, -1.0, 0.5, 1.0]) for _ in range(rnd.randrange(12))]
        a, b = best_region(x)
        most = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert sum(x[a:b]) == max(0, most)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site <a href="/">Home</a></header>
<nav><ul><li>Menu</li></ul></nav><article><h1>A &amp;  title</h1><p>One&nbsp;two <b>three</b>.<br>Four
five<script>var x = "</p>";</script></p><div class="ad box">Buy</div><aside>Side</aside><p>x &lt; y</p>
<form><label>Name</label><textarea>typed</textarea></form><section id="comments"><p>First!</p></section><p>End</p></article>
<div class="cookie-banner">We use cookies</div><footer>&copy; me</footer></body></html>"""


def test_main_text_by_hand():
    assert main_text(PAGE, Scorer()) == "A & title\n\nOne two three. Four five\n\nx < y\n\nEnd"
    assert main_text(None, Scorer()) == main_text("", Scorer()) == main_text("<p></p><!-- x", Scorer()) == ""
    assert main_text("just words", Scorer()) == "just words"
    assert main_text("<article><p>cut off here", Scorer()) == "cut off here"
    assert main_text("a < b", Scorer()) == "a < b"


def test_layouts_named_after_what_they_hold_keep_the_text():
    story = "<h1>The harbour</h1><p>After two years of work the old harbour opens on Monday.</p><p>Ships arrive early.</p>"
    want = "The harbour\n\nAfter two years of work the old harbour opens on Monday.\n\nShips arrive early."
    side = '<div class="sidebar"><ul><li><a href="/x">Cakes</a></li></ul></div>'
    text = lambda page: main_text(f"<html><body>{page}<footer>&copy; me</footer></body></html>", Scorer())
    for names in ('class="content has-sidebar"', 'id="page" class="with-comments"', 'class="no-banner"', 'class="page-with-comments"', 'class="sidebar-left"', 'class="widget content"'):
        for body in (f"<article>{story}</article>", f"<main>{story}</main>", f"<article class='post'>{story}</article>", story):
            assert text(f"<div {names}>{body}{side}</div>") == want, (names, body)
            assert text(f"<div {names}><div class='social page'>{body}</div>{side}</div>") == want, (names, body)
    # what is boilerplate stays out
    lots = "<p>" + "Great news, thank you so much for this. " * 3 + "</p>"
    assert text(f"<article>{story}</article><div class='comments'>{lots}</div>") == want
    assert text(f"<div id='content'>{story}</div><section id='comments'>{lots}</section>") == want
    assert text(f"<main>{story}<ol class='commentlist'><li><article class='comment'>{lots}</article></li></ol></main>") == want
    assert text(f"<article>{story}</article><div class='related'><article><p>Lakes and ponds</p></article></div>") == want
    assert text(f"<article>{story}<div class='ad'>Buy one and get one free</div></article>") == want


def test_names_that_only_sound_like_boilerplate_keep_their_text():
    text = lambda body: main_text(f"<html><body><nav>Menu</nav><article><p>one</p>{body}<p>three</p></article></body></html>", Scorer())
    for tag, names in (("div", "legal"), ("div", "warning"), ("div", "notice-period"), ("div", "search-results"), ("section", "social-history"), ("p", "adversary"), ("li", "shared-memory"), ("span", "related-work"), ("div", "content link right")):
        assert text(f'<{tag} class="{names}">two words</{tag}>').replace("\n\n", " ") == "one two words three", names
    for tag, names in (("p", "advert"), ("li", "share"), ("ins", "adsbygoogle"), ("td", "ad"), ("div", "ad-box"), ("div", "comment-list"), ("section", "related-links"), ("span", "social buttons"), ("div", "cookie-bar")):
        assert text(f'<{tag} class="{names}">two words</{tag}>') == "one\n\nthree", names
    # marked elements that are never closed end where the language ends them
    assert text('<p class="advert">Buy<p>two') == "one\n\ntwo\n\nthree"
    assert text('<ul><li class="share">Tell<li>two<ul><li class="ad">Buy</ul>more</ul>') == "one\n\ntwo\n\nmore\n\nthree"
    assert text('<table><tr><td class="ad">Buy<td>two<tr class="ad"><td>Buy<tr><td>four</table>') == "one\n\ntwo\n\nfour\n\nthree"
    assert text('<dl><dt class="ad">Buy<dd>two</dl>') == "one\n\ntwo\n\nthree"


def test_the_scan_decides_the_region(monkeypatch):
    """Pages without an article: what stands around the text in unmarked elements goes by its score alone."""
    from shardloom.llm import html_text

    story = "".join(f"<p>The {i}th paragraph of a story that goes on for a while, as stories do.</p>" for i in range(6))
    links = "<ul>" + "".join(f'<li><a href="/{i}"><b><i></i></b></a></li>' for i in range(60)) + "</ul>"
    page = f"<html><body><div>Top</div>{links}<div>{story}</div>{links}<div>Bottom</div></body></html>"
    want = main_text(f"<div>{story}</div>", Scorer())
    assert main_text(page, Scorer()) == want
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert main_text(page, Scorer()) != want


def test_marks_come_from_the_labelled_pages():
    page = '<html><body><div class="zzz">Buy it</div><!--begin main--><div class="yyy"><p>A long enough text of a page.</p></div><!--end main--><div class="zzz">Now and here</div></body></html>'
    other = '<article><p>one</p><div class="zzz">two</div><div class="ad">three</div></article>'
    assert main_text(other, Scorer((page,))) == "one\n\nthree" and main_text(other, Scorer()) == "one\n\ntwo"


def test_elements_that_look_raw_lose_no_text():
    text = lambda body: main_text(f"<article>{body}<p>three</p></article>", Scorer())
    for icon in ('<svg class="i"/>', "<svg/>", "<svg hidden />", '<svg title="a > b" class=i />', "<iframe src='x'/>", "<svg><title>No</title><path d='M0'/></svg>", "<svg class=i/>No</svg>"):
        assert text(f"<p>One {icon} two</p>") == "One two\n\nthree", icon
    for name in ("svg-icon", "object-viewer", "select-box", "title-bar", "math-field"):
        assert text(f"<p>One <{name} a='b'>mid</{name}> two</p>") == "One mid two\n\nthree", name
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold</p>") == "Let x=2 hold\n\nthree"
    assert text('<p>See <object data="a.pdf">the paper</object> here</p>') == "See the paper here\n\nthree"
    assert text("<p>One <math/> two <object data='x'/> x</p>") == "One two x\n\nthree"
    assert text("<p>One<script>var a = '<svg/>';</script> two <select><option>No</option></select></p>") == "One two\n\nthree"


def test_extracted_edges(spark, sf_dir):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = extracted(df).collect()
    assert [r["n_chars"] for r in got] == [len(got[0]["text"]), 0, 0]
    assert extracted(df.limit(0)).count() == 0
    assert op9_html_extraction(spark, sf_dir).where("n_chars = 0").count() == 0


# --- decontamination

def test_op10_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op10_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == brute.leaks(docs, items)


def test_edited_items_equal_sql_and_brute_force(spark, tmp_path):
    """200 random edits of items: swapped parts, inserted and dropped words, repeats, shifted blocks."""
    import random

    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (20, 30, 45, 60, 80, 9)]
    items[2][20:40] = items[2][:20]  # repeats inside an item
    docs = []
    for i in range(200):
        w = list(rnd.choice(items))
        for _ in range(rnd.randrange(4)):
            k, how = rnd.randrange(1, len(w)), rnd.randrange(5)
            w = [w[k:] + w[:k], w[:k] + [word()] + w[k:], w[: k - 1] + w[k:], w[:k] + w[max(0, k - 6) :], w[k:] + [word() for _ in range(3)] + w[:k]][how] or ["x"]
        docs.append((i, " ".join([word() for _ in range(rnd.choice([0, 3, 50]))] + w + [word() for _ in range(rnd.choice([0, 2, 60]))])))
    bench = [(i, " ".join(w)) for i, w in enumerate(items)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["words"], r["similarity"]) for r in op10_benchmark_decontamination(spark, str(tmp_path)).collect()}
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2:] for r in c.sql(f"select doc_id, item_id, start, words, similarity from ({OP10_SQL})").fetchall()}
    assert set(want) == brute.leaks(docs, bench) and 60 < len(want) < 200
    assert got == want


def test_decontamination_edges(spark):
    import random

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 40, 12, 5, 4, 60])] + [(6, None), (7, "")]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, fill(30) + "\n" + items[0][1].upper().replace(" ", ", ") + " " + fill(9)), (2, items[2][1]), (3, fill(5) + " " + items[3][1]), (4, items[4][1]), (5, None), (6, ""), (7, fill(200)), (8, " ".join(items[5][1].split()[:54])), (9, " ".join(items[5][1].split()[:30]))]
    edited = items[1][1].split()
    edited[1] = "changed"
    docs += [(10, fill(20) + " " + " ".join(edited) + " " + fill(20)), (11, items[0][1]), (11, items[0][1]), (None, items[0][1])]
    d = spark.createDataFrame([(i, t, 1, "n") for i, t in docs], "doc_id long, text string, n int, sh string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    got = [(r["doc_id"], r["item_id"]) for r in matches(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.leaks(docs, items)
    left = decontaminated(d, b)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {g[0] for g in got}
    assert matches(d.limit(0), b).count() == matches(d, b.limit(0)).count() == 0


def test_reordered_items_are_found(spark):
    """Parts of an item in another order, inside other text: no window has a shared shingle at its place."""
    import random

    rnd = random.Random(11)
    fill = lambda n: [f"f{rnd.randrange(10**6)}" for _ in range(n)]
    a, b = fill(30), fill(30)
    c, d, e = fill(45), fill(40), fill(35)
    items = [(1, " ".join(a + b)), (2, " ".join(c + d + e))]
    texts = [fill(80) + b + a + fill(80), b + a, fill(80) + b + a, fill(90) + e + d + c + fill(70), fill(80) + b[:24] + fill(1) + a + fill(80), fill(80) + b + fill(40) + a, b + a[:20]]
    texts.append(fill(20) + texts[0] + texts[3] + a + b)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == brute.leaks(docs, items) and {(0, 1), (3, 2), (7, 1), (7, 2)} <= set(got)
    assert got[0, 1]["start"] == 80 and abs(got[0, 1]["similarity"] - 52 / 60) < 1e-12 and got[7, 1]["similarity"] == 1.0


def test_multi_index_finds_all_within_the_radius(spark):
    from pyspark.sql import functions as F

    import random

    rnd = random.Random(4)
    base = rnd.getrandbits(63)
    rows = []
    for k in range(RADIUS + 1):
        for _ in range(5):
            x = base
            for bit in rnd.sample(range(64), k):
                x ^= 1 << bit
            rows.append((k, x - (1 << 64) if x >= 1 << 63 else x))
    from shardloom.llm.decontaminate import BLOCKS, _block

    probes = spark.createDataFrame([(base,)], "fp long").select(F.explode(_variants("fp")).alias("v")).select("v.block", "v.value")
    places = spark.createDataFrame(rows, "k int, fp long").withColumn("id", F.monotonically_increasing_id())
    each = places.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block("fp", i).alias("value")) for i in range(len(BLOCKS))])).alias("v")).select("id", "v.block", "v.value")
    assert each.join(probes, ["block", "value"]).select("id").distinct().count() == len(rows)
