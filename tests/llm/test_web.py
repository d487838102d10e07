import base64
import fnmatch
import gzip
import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from dyadic.llm import html_extract, url_filter, warc_index
from dyadic.llm.common import shared_path
from dyadic.llm.queries import URL_RULES


def pages(spark):
    big = "<article><p>" + "long text " * 100_000 + "</p></article>"
    rows = [(1, "http://a.example.com/x", "<p>one</p>"), (2, "http://a.example.com/x", "<p>one</p>"), (3, None, None),
            (4, "no scheme", ""), (5, "http://A.Example.net/en/", "é£ \r\n\r\nWARC/1.1\r\n\r\nx"), (None, "http://b.net", "y"),
            (None, "http://b.net", "y"), (6, "http://b.net/\r\nX: 1", "<p>one</p>"), (6, "http://b.net/2", "<p>one</p>"),
            (7, "http://c.org/fr/?q#f", big), (8, "http://c.org", "a\x00b\u2028c"), (-5, "http://c.org", "<p>one</p>")]
    return spark.createDataFrame([(*r, "d", 1, "t") for r in rows],
                                 "page_id long, url string, html string, digest string, n int, record_type string").repartition(3)


def test_archives_round_trip(spark):
    rows = [tuple(r) for r in pages(spark).select("page_id", "url", "html").collect()]
    got = warc_index.archive_and_index(pages(spark)).collect()
    first = defaultdict(lambda: None)
    for i, _, h in rows:
        first[h or ""] = max((x for x in (first[h or ""], i) if x is not None), default=None)
    want = []
    for i, u, h in rows:
        payload = (h or "").encode()
        alone = sum((x[2] or "") == (h or "") for x in rows) < 2
        revisit = not alone and i != first[h or ""]
        want.append((i, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), len(payload),
                     base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response",
                     first[h or ""] if revisit else None))
    assert sorted(((r.page_id, r.uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got),
                  key=repr) == sorted(want, key=repr)
    keys = [(r.url_key, r["at"], -(1 << 62) if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys)  # collect() keeps partition order: the index is ordered globally


def test_archive_bytes_are_warc(spark, tmp_path):
    path = shared_path(spark, "test-warc")
    warc_index.write_archives(pages(spark).where("page_id in (1, 2, 5)"), path)
    data = b"".join(gzip.decompress(bytes(r.content)) for r in
                    spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect())
    records = {r["fields"]["WARC-Record-ID"]: r for r in warc_index.parse_records(data)}
    assert records["<urn:dyadic:page:1>"]["fields"]["WARC-Refers-To"] == "<urn:dyadic:page:2>"
    assert records["<urn:dyadic:page:1>"]["block"].endswith(b"\r\n\r\n") and b"one" not in records["<urn:dyadic:page:1>"]["block"]
    assert records["<urn:dyadic:page:5>"]["block"].partition(b"\r\n\r\n")[2].decode() == "é£ \r\n\r\nWARC/1.1\r\n\r\nx"


def test_minimum_size_of_a_revisit(spark):
    path = shared_path(spark, "test-warc")
    warc_index.write_archives(pages(spark), path, min_bytes=11)
    got = warc_index.read_archives(spark, path).collect()
    assert {r.record_type for r in got if r.payload_bytes < 11} == {"response"}


def test_empty_tables(spark):
    none = pages(spark).limit(0)
    assert warc_index.archive_and_index(none).count() == 0
    assert url_filter.filter_urls(none, URL_RULES).count() == 0
    assert html_extract.extract_main_text(none).count() == 0


def test_loser_tree_merges_any_runs():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randrange(9), j, n) for n in range(rnd.randrange(6))) for j in range(k)]
        assert [row for _, row in warc_index.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_globs_against_fnmatch():
    rnd = random.Random(2)
    globs = ["".join(rnd.choice("ab/*") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    globs = [re.sub(r"\*+", "*", g) for g in globs if g.strip("*")]
    texts = ["".join(rnd.choice("ab/c") for _ in range(rnd.randrange(0, 9))) for _ in range(300)]
    hits = url_filter.GlobAutomaton(globs).run(texts)
    assert url_filter.GlobAutomaton(globs).words > 1
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert hits[i, j] == fnmatch.fnmatchcase(t, g), (t, g)


def test_gap_without_slash():
    a = url_filter.GlobAutomaton(["%.net/*", "a%b"])
    assert a.run([".x.net/", ".x.net", ".x.org/.net/", ".net/a", "ab", "acb", "a/b", ""]).tolist() == [
        [True, False], [False, False], [False, False], [True, False], [False, True], [False, True], [False, False],
        [False, False]]


def test_url_rules_edges(spark):
    urls = ["https://EXAMPLE.net/en/x", "http://sub.example.net/en/", "http://example.net/EN/", "http://notexample.net/en/",
            "http://example.com/de/", "http://example.com.evil.org/fr/a", "http://x.org/fr", "http://net", "http://net/",
            None, "", "no scheme/net/", "http://h/.net/", "ftp://u@a.b.net/?x#y", "http://a.org/fr/?x",
            "http://a.net?/en/", "x://" + "l" * 50_000 + ".net/" + "p" * 50_000, "http://ünï.net/é"]
    df = spark.createDataFrame([(i, u, "r", 2) for i, u in enumerate(urls)], "page_id long, url string, rule string, path int")
    got = {r.page_id: r for r in url_filter.filter_urls(df, URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = re.split(r"[?#]", u.partition("://")[2])[0] if u and "://" in u else ""
        host, slash, path = rest.partition("/")
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = slash + path
        fits = [r for r in URL_RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((best.name, best.verdict) if best else (None, "allow"))


PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">A</a></li></ul></nav><div class="cookie-notice">We use</div>
<div class="wrap"><div class="content post-12"><article id=a><header><h2>Title &amp;amp; x</h2></header>
<p>One  two<br>three &lt;b&gt; <b>bold<p>Second a < b para<!-- <p>no</p> -->
<ul><li>i1<li>i2 <a href="x">link</a></ul><aside>side</aside><form>f</form><div class="ad">ad</div>
<div class=comments><p>reader words</div></article></div><div class="sidebar">sb</div></div><footer>f</footer></body></html>"""


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    return {r.page_id: r for r in html_extract.extract_main_text(df).collect()}


def test_main_text(spark):
    got = extracted(spark, [(1, "http://h/1", PAGE), (2, None, None), (3, "http://h/3", ""), (4, "u", "plain & text"),
                            (5, "http://h/5", "<article>cut <p>off &eacute")])
    assert got[1].text == "Title &amp; x\nOne two three <b> bold\nSecond a < b para\ni1\ni2 link"
    assert got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[4].text == "plain & text" and got[5].text == "cut\noff é"


def test_given_pages_against_their_articles(spark, sf_dir):
    src = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html_extract.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        article = re.search(r"<article>(.*?)</article>", src[r.page_id], re.S)[1]
        want = [re.sub(r"\s+", " ", html_extract.html.unescape(re.sub(r"<[^>]*>", "", x))).strip()
                for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in want if x)


def test_text_beside_the_body_stays(spark):
    body, items = "the real story " * 60, "".join(f"<li>point {k} of the long list" for k in range(40))
    want = {1: f"Title\nlead\n{body.strip()}\nend", 2: f"Title\nlead\n{body.strip()}", 4: f"lead\n{body.strip()}\nend"}
    got = extracted(spark, [
        (1, "http://a/1", f"<article><h1>Title</h1><p>lead</p><div class=body><p>{body}</div><p>end</article>"),
        (2, "http://b/2", f"<body><div>by</div><div class=post><h1>Title</h1><p>lead</p><div class=body>{body}</div></div>"),
        (3, "http://c/3", f"<body><div class=t>x</div><div class=post><p>lead</p><ul>{items}</ul><p>end</div>"),
        (4, "http://d/4", f"<main><p>lead</p><blockquote>{body}</blockquote><p>end</main>")])
    assert {k: got[k].text for k in want} == want
    assert got[3].text.startswith("lead\npoint 0") and got[3].text.endswith("list\nend")


def test_wrappers_named_like_boilerplate():
    text = html_extract.main_text
    story = "the real story " * 30
    inner = f"<article><h2 id=legal-status>Title</h2><p>{story}<span id=form>end</span></article><div class=sidebar>sb</div>"
    for wrap in ("<div class='content-sidebar-wrap'>{}</div>", "<body class=x><form id=f><div class=no-sidebar>{}</div></form>"):
        assert text(wrap.format(inner)) == f"Title\n{story}end"
    assert text(f"<nav>menu</nav><form>{story}</form>") == story.strip()


def test_hosts_agree_on_a_path(spark):
    page = "<body><div class='{}'><p>{}</p></div><div class='story{}'><p>{}</p></div></body>"
    story, teaser = "the real story " * 30, "a much longer teaser " * 40
    rows = [(k, "http://h/" + str(k), page.format("teaser", "short", k, story)) for k in range(9)]
    # here the teaser is as long as the story: the host's consensus decides
    rows.append((9, "http://h/9", page.format("teaser", teaser, 9, story)))
    # a winner that holds next to nothing of the page's text replaces nothing
    rows.append((10, "http://h/10", page.format("teaser", teaser, 10, "story")))
    got = extracted(spark, rows)
    assert got[3].text == got[9].text == story.strip() and got[10].text == teaser.strip()
    alone = extracted(spark, [(9, "http://other/9", rows[9][2])])
    assert alone[9].text == f"{teaser.strip()}\n{story.strip()}"


def test_articles_are_kept_whatever_is_around_them():
    text, story = html_extract.main_text, "the real story " * 30
    s = story.strip()
    assert text(f'<p>Stray line.</p><div class="content-sidebar-wrap"><article><p>{story}</article></div>') == s
    assert text(f"<p>Stray line.</p><form><article><p>{story}</article></form>") == s
    assert text(f"<p>Stray</p><header><article><p>{story}</article></header><div class=widget-area>w</div>") == s
    inner = '<section id="discussion"><p>We discuss.</section><p class="side-effects">none<p class="legal-status">ok'
    assert text(f"<article><p>{story}</p>{inner}</article>") == f"{s}\nWe discuss.\nnone\nok"
    for gone in ("<section class=comments><p>reader</section>", "<div id=comment-list>reader</div>", "<div class='ad-slot x2'>ad</div>",
                 "<div class='notice'>n</div>", "<p hidden>h", "<div hidden='hidden'><p>h</div>", "<span HIDDEN>h</span>"):
        assert text(f"<article><p>{story}</p>{gone}</article>") == s
    assert text(f"<article><p>{story}</p><p style='overflow:hidden' data-id=ad>stays <button>no</button>here</article>") == f"{s}\nstays here"
    # replies are articles too on some pages
    assert text(f"<div class=post><article><p>{story}</article></div><ol class=comment-list><li><article><p>me too</article></ol>") == s


def test_deep_nesting_is_linear():
    import time
    pages = ["<div>x" * 20_000, "<div>" * 20_000 + "</section>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, "<iframe>" * 20_000,
             "<p><b>" * 20_000, "<li><i>x" * 20_000, '<div class="a b1">' * 20_000 + "x"]
    for page in pages:
        began = time.process_time()
        html_extract.main_text(page, ["html>body>div.x", "div>div"])
        assert time.process_time() - began < 2


def plain_blocks(source):
    """(path of containers, block text) of simple well-formed markup."""
    path, blocks, pieces = [], [], []

    def flush():
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((tuple(path), text))
        pieces.clear()

    for tag, name, attributes, words in re.findall(r"(<(/?\w+)([^>]*)>)|([^<]+)", source):
        if words:
            pieces.append(words)
            continue
        flush()
        if name.startswith("/"):
            path.pop()
        else:
            kind = re.sub(r"[0-9]+", "", "".join(sorted(f".{c}" for c in re.findall(r"class='([^']*)'", attributes)[0].split())
                                         ) if attributes else "")
            path.append((name + kind, len(blocks), len(path), tag, random.random()))
    flush()
    return blocks


def plain_choice(blocks):
    """By brute force: of all containers with 80 % of the text the deepest; then the outermost below with own text."""
    total = sum(len(t) for _, t in blocks)
    places = {p[:k] for p, _ in blocks for k in range(len(p) + 1) if k == 0 or p[k - 1][0].split(".")[0] != "p"}
    held = {p: sum(len(t) for q, t in blocks if q[:len(p)] == p) for p in places}
    best = max((p for p in places if held[p] >= html_extract.HOLDS * total), key=len)
    own = {q[:-1] if q and q[-1][0] == "p" else q for q, _ in blocks}
    for k in range(1, len(best)):
        if best[:k] in own and best[k - 1][0] not in ("html", "body"):
            return best[:k]
    return best


def random_page(rnd, depth=0):
    out = ""
    for _ in range(rnd.randrange(1, 4)):
        if depth < 5 and rnd.random() < 0.55:
            name, kind = rnd.choice(["div", "section", "td"]), rnd.choice(["", " class='a'", " class='b2 a'"])
            out += f"<{name}{kind}>{random_page(rnd, depth + 1)}</{name}>"
        else:
            out += f"<p>{'w' * rnd.randrange(1, 60)}</p>"
    return out


def test_votes_and_choices_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [(k, f"http://h{k % 3}/", "<body>" + random_page(rnd) + "</body>") for k in range(150)]
    votes, own = defaultdict(lambda: defaultdict(list)), {}
    name = lambda path: ">".join(step[0] for step in path)
    for k, url, source in rows:
        blocks = plain_blocks(source)
        path = plain_choice(blocks)
        own[k] = (path, blocks, sum(len(t) for q, t in blocks if q[:len(path)] == path))
        votes[url][name(path)].append(own[k][2])
    got = extracted(spark, rows)
    switched = 0
    for k, url, _ in rows:
        path, blocks, worth = own[k]
        all_votes = sum(len(v) for v in votes[url].values())
        winners = sorted((p for p, v in votes[url].items() if len(v) >= 0.2 * all_votes),
                         key=lambda p: (-len(votes[url][p]), -sum(votes[url][p]), p))
        chosen = path
        if name(path) not in winners:
            for w in winners:
                places = {q[:j] for q, _ in blocks for j in range(1, len(q) + 1) if name(q[:j]) == w}
                held = {p: sum(len(t) for q, t in blocks if q[:len(p)] == p) for p in places}
                if held and max(held.values()) >= html_extract.FAIR * worth:
                    first = max(held, key=lambda p: (held[p], -p[-1][1]))
                    chosen, switched = first, switched + 1
                    break
        assert got[k].text == "\n".join(t for q, t in blocks if q[:len(chosen)] == chosen), k
    assert switched > 5


def test_long_unbalanced_markup_is_linear(spark):
    got = extracted(spark, [(1, "http://h/1", "<a href=\"" * 20_000), (2, "http://h/2", "<div>" * 3000 + "deep"),
                            (3, "http://h/3", "<p>x " * 20_000)])
    assert got[2].text == "deep" and got[3].n_chars == 2 * 20_000 - 1
