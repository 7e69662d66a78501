import random

from tastegrid.llm import html_extract as he

from .helpers import prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Head</header><div class="cookie-notice">We use cookies</div>
<!-- <article>hidden</article> --><div class=ad>Buy</div><aside>Side</aside>
<article class="post"><h1>Title &amp; more&lt;</h1><p>One <b>bo</b>ld&#x21; two<br>three<p>un&#233;closed   <i>in\tline</i>
<form><input value="a>b"><button>Go</button></form><div id="adBox">Buy now</div><p>Last &copy; 2 < 3</p>
<section class="post-comments"><article>me too</article></section></article><footer>Foot</footer></body></html>"""


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars string")
    return {r["page_id"]: r["text"] for r in he.extract(df).collect()}


def test_article():
    assert he.article_text(PAGE) == "Title & more< One bold! two three unéclosed in line Last © 2 < 3"
    assert he.article_text("<main><p>a</p><nav>b</nav></main>") == "a"
    assert he.article_text("<p>a</p>") is None
    assert he.article_text("<article><p>cut off") == "cut off"
    assert he.article_text("<article>a<script>never closed</article>") == "a"


def test_pages_without_article_lose_what_the_host_repeats(spark):
    rnd = random.Random(6)
    notice, own = "this very notice stands on all our pages", {}
    rows = []
    for i in range(40):
        own[i] = prose(rnd, 30)
        rows.append((i, f"http://h{i % 2}.net/{i}", f"<body><nav>menu</nav><div>{notice} {i % 2}</div><div>{own[i]}</div></body>", "x"))
    # an equal page is the same page, not a repetition
    rows.append((40, "http://h0.net/40", rows[0][2], "x"))
    # another host's page may say what this one repeats
    rows.append((41, "http://other.net/", f"<body><p>{notice}</p></body>", "x"))
    got = extracted(spark, rows)
    assert all(got[i] == own[i] for i in range(40)) and got[40] == own[0] and got[41] == notice


def test_shards_give_the_same(spark, monkeypatch):
    rnd = random.Random(7)
    notices = [prose(rnd, 9) for _ in range(8)]
    rows = [(i, "http://h.net/", f"<div>{rnd.choice(notices)}</div><div>{prose(rnd, 20)}</div>", "x") for i in range(60)]
    whole = extracted(spark, rows)
    monkeypatch.setattr(he, "SHARD_PAGES", 3)
    assert extracted(spark, rows) == whole
    # brute force: windows of six tokens within a block, or whole shorter blocks, on distinct pages
    page = {i: [b.split() for b in h.replace("</div>", "").split("<div>")[1:]] for i, _, h, _ in rows}
    seen, kept = {}, {}
    spans = lambda b: [tuple(b[p:p + 6]) for p in range(max(1, len(b) - 5))]
    for i, bs in page.items():
        for b in bs:
            for w in spans(b):
                seen.setdefault((w, len(b) < 6), set()).add(rows[i][2])
    for i, bs in page.items():
        kept = []
        for b in bs:
            gone = {q for p, w in enumerate(spans(b)) if len(seen[w, len(b) < 6]) > 1 for q in range(p, p + 6)}
            kept += [w for q, w in enumerate(b) if q not in gone]
        assert whole[i] == " ".join(kept)


def test_edges(spark):
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, None, None, "x"), (2, "no scheme", "", "x"), (3, None, "<article></article>", "x"), (4, "http://a.b/", long, "x"),
            (5, "http://a.b/", "<article>same</article>", "x"), (6, "http://a.b/", "<article>same</article>", "x"), (7, None, "plain < text", "x")]
    got = extracted(spark, rows)
    assert got[1] == got[2] == got[3] == "" and got[5] == got[6] == "same" and got[7] == "plain < text" and len(got[4]) == 999_999
    assert extracted(spark, []) == {}


def test_a_run_twice_in_a_shard_and_once_in_another_goes_everywhere(spark, monkeypatch):
    rnd = random.Random(8)
    notice = "this very notice stands on three of all our pages"
    own = [prose(rnd, 20) for _ in range(30)]
    plain = [f"<div>{t}</div>" for t in own]
    with_notice = [f"<div>{notice}</div>{p}" for p in plain]
    # two shards; find pages of which two lie in the one and one in the other
    of = [r[0] for r in spark.createDataFrame([(p,) for p in with_notice], "h string").selectExpr("pmod(xxhash64(xxhash64(h)), 2)").collect()]
    chosen = [i for i in range(30) if of[i] == 0][:2] + [i for i in range(30) if of[i] == 1][:1]
    assert len(chosen) == 3
    rows = [(i, "http://h.net/", with_notice[i] if i in chosen else plain[i], "x") for i in range(30)]
    monkeypatch.setattr(he, "SHARD_PAGES", 15)
    assert extracted(spark, rows) == dict(enumerate(own))


def test_pages_whose_markup_names_no_text_keep_their_main_text(spark):
    rnd = random.Random(9)
    notice, menu = "this very notice stands on all of our many pages", "<nav>menu</nav>"
    own = [prose(rnd, 40) for _ in range(9)]
    frame = lambda body: f"<body>{menu}<div>{notice}</div>{body}</body>"
    pages = [
        f"<script>var x = '<article>';</script><div>{own[0]}</div>",
        f"<!-- <main> --><div>{own[1]}</div><!-- </main> -->",
        f"<main-nav>x</main-nav><article-card></article-card><div>{own[2]}</div>".replace("x", ""),
        f"<div>{own[3]}</div><aside><article>teaser</article></aside>",
        f"<div>{own[4]}</div><section class='comments'><article>me too</article></section>",
        f"<div class='page has-sidebar'><article>{own[5]}</article></div><aside>side</aside>",
        f"<div class='layout sidebar-left'><article>{own[6]}</article></div>",
        f"<article></article><div>{own[7]}</div>",
        f"<main><div id='search-results'>{own[8]}</div></main>",
    ]
    rows = [(i, f"http://h.net/{i}", frame(p), "x") for i, p in enumerate(pages)]
    assert extracted(spark, rows) == dict(enumerate(own))
    # an article in a wrapper is not cut where another page repeats it
    same = [(i, f"http://h.net/{i}", frame(f"<div class='sidebar-left'><article>{own[0]}</article></div><p>{i}</p>"), "x") for i in range(3)]
    assert extracted(spark, same) == {i: f"{own[0]} {i}" for i in range(3)}
    assert he.article_text(f"<div class='no-sidebar'><article>a</article></div><div class=related><article>b</article></div>") == "a"


def test_a_page_with_nothing_but_excluded_text_keeps_what_is_its_own(spark):
    rnd = random.Random(10)
    own = [prose(rnd, 40) for _ in range(4)]
    rows = [(i, "http://h.net/", f"<div id='notice-board'><div class='menu'>this menu of many words stands on all</div>{t}</div>", "x")
            for i, t in enumerate(own)]
    assert extracted(spark, rows) == dict(enumerate(own))


def test_batches_of_more_pages_than_are_parsed_at_once(spark):
    rows = [(i, "http://h.net/", f"<article><p>{'word ' * (i % 7)}{i}</p></article>" if i % 3 else f"<p>plain {i}</p>", "x") for i in range(1203)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in he.extract(df).collect()}
    assert all(got[i] == f"{'word ' * (i % 7)}{i}" for i in range(1203) if i % 3) and all(got[i] == f"plain {i}" for i in range(0, 1203, 3))


def test_boilerplate_blocks_inside_articles_go_and_content_stays(spark, monkeypatch):
    rnd = random.Random(11)
    call, passage, short = "join our list of readers and get a letter every week", prose(rnd, 12), "Read on"
    pages, want = [], {}
    for i in range(40):
        own = [prose(rnd, 30) for _ in range(3)]
        # a passage within a block is content, as is a short block
        own[1] = f"{own[1]} {passage} {i}"
        pages.append([own[0], short, own[1], call, own[2]] if i % 3 else own)
        want[i] = " ".join(p for p in pages[-1] if p != call)
    # copies and a near-copy of an article that has the call: their text stays, the call goes
    for i, source, last in ((40, 1, None), (41, 1, "and one more line that stands in this copy alone today")):
        pages.append([*pages[source], *([last] if last else [])])
        want[i] = " ".join(p for p in pages[-1] if p != call)
    frame = lambda ps, i: f"<body><p>{i}</p><article>{''.join(f'<p>{p}</p>' for p in ps)}</article></body>"
    rows = [(i, "http://h.net/", frame(p, i), "x") for i, p in enumerate(pages)]
    # another host's articles that say it once, and an article of nothing but the call
    rows += [(50, "http://other.net/", frame([call], 50), "x"), (51, "http://h.net/", frame([call], 51), "x"), (52, None, frame([call], 52), "x")]
    want |= {50: call, 51: call, 52: call}
    assert extracted(spark, rows) == want
    monkeypatch.setattr(he, "SHARD_PAGES", 4)
    assert extracted(spark, rows) == want


def test_windows_of_articles_against_brute_force():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(12)
    runs = [prose(rnd, rnd.choice([3, 6, 7, 15])) for _ in range(12)]
    pages = [None if i % 9 == 8 else [rnd.choice(runs) if rnd.random() < 0.4 else prose(rnd, rnd.randint(1, 20)) for _ in range(rnd.randint(1, 6))]
             for i in range(60)]
    pages.append(pages[0])
    articles = sorted({tuple(p) for p in pages if p})
    windows = lambda b: [tuple(b.split()[i:i + 6]) for i in range(len(b.split()) - 5)]
    held = {}
    for a in articles:
        for w in {w for b in a for w in windows(b)}:
            held[w] = held.get(w, 0) + 1
    want = []
    for p in pages:
        if p:
            n = sorted(held[w] for b in p for w in windows(b))
            want.append([bool(windows(b)) and all(held[w] > n[(len(n) - 1) // 2] for w in windows(b)) for b in p])
    got = he.ArticleWindows(pa.array(pages, pa.list_(pa.string())))
    assert [list(g) for g in got.dropped(np.zeros(len(got.count), np.int64))] == want and any(any(w) for w in want)
    assert len(np.unique(got.hashes())) == len(held) == len(got.count)
