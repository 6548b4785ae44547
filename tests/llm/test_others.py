"""Vectors, pages, queries and the pipeline."""

import hashlib
import math
import random
import re
import time
from html.parser import HTMLParser

import brute
import pytest

import __spark_entry__ as entry
from compare import duck, rows_of
from echofold.llm import entries, html_extract, kdtree_topk, url_filter


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    df = entries.QUERIES[name](spark, sf)
    cur = duck(sf).execute(entries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(entries.QUERIES) - set(entries.ORACLES)))
def test_query_returns_every_row(spark, sf, name):
    df = entries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/{'pages' if 'html' in name else 'documents'}.parquet").count()
    assert df.count() == n


def plain_topk(rows, k, every):
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [64, 1 << 17])
def test_topk_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(kdtree_topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(kdtree_topk, "BLOCK_QUERIES", 8)
    r = random.Random(1)
    rows = [(i, [r.choice([r.gauss(0, 1), 0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, None]), (1050, [float("nan")] * 6), (1002, [float("inf")] * 6), (None, [9.0] * 6), (2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (3000, [1e9] * 6)]
    rows += [(i, [0.25] * 6) for i in range(500, 600)]  # ties
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id bigint, embedding array<double>, d int")
    assert sorted(map(tuple, kdtree_topk.top_k(df, 5, 50).collect())) == plain_topk(rows, 5, 50)
    assert kdtree_topk.top_k(df.limit(0)).count() == 0


def test_topk_of_components_of_any_size(spark):
    big = [1.7e308, 1e12, -1.7e308, 3e15, 1.0]
    r = random.Random(4)
    rows = [(i, [r.choice([*big, 0.5, -2.0]) for _ in range(3)]) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    exact = lambda x: int(x) * 256 if abs(x) > 2**53 else math.floor(256 * x)
    v, want = {i: [exact(x) for x in e] for i, e in rows}, []
    for q in (50, 100):
        clamped = {c: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v[q], v[c])))) for c in v if c != q}
        best = sorted((-s, c) for c, s in clamped.items())[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(map(tuple, kdtree_topk.top_k(df, 5, 50).collect())) == sorted(want)


def test_topk_ties_far_beyond_exact_doubles(spark, monkeypatch):
    monkeypatch.setattr(kdtree_topk, "SHARD_ROWS", 16)
    base = float((1 << 23) + 1)  # scores near 2**62, far apart as doubles
    rows = [(i, [base, float(i % 3)]) for i in range(1, 201)] + [(250, [-base, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, kdtree_topk.top_k(df, 5, 50).collect())) == plain_topk(rows, 5, 50)


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "/en/7/x", "block"), ("org", "", "block"), ("www.x.org", "/p", "allow"), ("EN", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("com", "/en/", "allow")]
URLS = [None, "", "no scheme", "http://", "http://com/en/", "https://COM/en/x?y", "http://example.com/en/7", "http://b.example.com/en/70#z", "http://a.example.com/en/7/xy", "http://xexample.com/en/7", "http://org", "http://www.x.org/p/q", "http://www.x.org/q", "http://x.en/", "http://x.en", "ftp://u@example.com:80/en/7", "http://é.com/en/ü", "http://com.example/en/", "x://y://com/en/", "http://a.com//en/", "http://com/en\n/"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = {}
    for h, p, v in RULES:
        if h:
            rules[h.lower(), p] = max(v, rules.get((h.lower(), p), ""))
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (low == h or low.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return low, path, best[2], best[3]


def test_urls_equal_brute_force(spark):
    r = random.Random(2)
    urls = URLS + [f"http://{r.choice(['', 'a.', 'www.'])}{r.choice(['com', 'example.com', 'x.org', 'org', 'en'])}/{r.choice(['en/', 'en/7', 'p', ''])}{r.randrange(99)}" for _ in range(200)]
    urls += urls[:5]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, key string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)).collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(repr((i if i % 50 else None, *plain_verdict(u))) for i, u in enumerate(urls))
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)).count() == 0
    assert url_filter.judge_urls(pages, spark.createDataFrame([], url_filter.RULE_SCHEMA)).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_url_filter_is_native(spark, sf):
    plan = entries.op8_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


@pytest.fixture(scope="module")
def field():
    return html_extract.trained()


PAGES = [
    ("<article><h1>T &amp; x</h1><p>One  <b>two</b>\n three.<p>Fo<i>ur</i></article>", "T & x\nOne two three.\nFour"),
    ("<html><head><title>t</title><script>var a='<p>no</p>'</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><div class=ad>Buy now.</div><main><h1>Head line</h1><p>First paragraph of the text.</p><form><label>Mail</label><input><button>Go</button></form><p>Second &lt;one&gt;&nbsp;here.</p></main><aside><h3>Related</h3><ul><li><a href=/r>More</a></li></ul></aside><section class=comments><h3>Comments</h3><p>I read it all and liked it very much indeed.</p></section><footer>&copy; 2020 Site.</footer></body></html>", "Head line\nFirst paragraph of the text.\nSecond <one> here."),
    ("<header>Site</header><div id=cookie-notice><p>We use cookies.</p></div><div class=post-content><h2>Ti</h2><p>a<br>b<div>c</div></div><div id=footer>Imprint</div>", "Ti\na b\nc"),
    ("", ""), (None, ""), ("<!-- <p>x</p>", ""), ("<script>never closed <p>x", ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(field, page, want):
    assert html_extract.main_text(field, page) == want


def test_held_out_layouts(field):
    pages = html_extract.label_pages(200, seed=123)
    right = sum(a == b for found, labels in pages for a, b in zip(field.decode(found), labels))
    assert right >= 0.99 * sum(len(labels) for _, labels in pages)


def test_extract_rows(spark, field):
    rows = [(1, "u", "<article><p>é x</p></article>", "t"), (1, "u", "<article><p>é x</p></article>", "t"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted(map(repr, (tuple(r) for r in html_extract.extract(df, field).collect()))) == sorted(map(repr, [(1, "u", "é x", 3), (1, "u", "é x", 3), (None, None, "", 0)]))
    assert html_extract.extract(df.limit(0), field).count() == 0


def test_viterbi_is_the_best_labelling(field):
    import itertools

    for found, _ in html_extract.label_pages(30, seed=9):
        found = found[:8]
        u, t = field.unary(found), field.trans
        best = max(itertools.product((0, 1), repeat=len(found)), key=lambda y: sum(a for a, b in zip(u, y) if b) + sum(t[a][b] for a, b in zip(y, y[1:])), default=())
        assert field.decode(found) == list(best)


def small_corpus():
    """Toxic texts, near copies, repeats, benchmark passages, blanks, ids that are null or repeated."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda k: r.choices(vocabulary, k=k)
    items = [(k, " ".join(text(n))) for k, n in enumerate([12, 20, 35])]
    base, passage, rows, labels = [text(90) for _ in range(4)], text(70), [], []
    for i in range(150):
        kind, t = i % 10, text(r.randint(1, 160))
        if kind in (0, 1):
            t = list(r.choice(base))
            t[r.randrange(90)] = r.choice(vocabulary)
        elif kind == 2:
            t += passage + text(20)
        elif kind == 3:
            t += r.choice(items)[1].split()
        toxic = kind in (4, 5)
        if toxic:
            t.insert(r.randrange(len(t) + 1), r.choice(["slur", "insult"]))
        rows.append((i, " ".join(t), f"s{min(3, i % 7)}"))
        labels.append((i, 1, int(toxic)))
    rows += [(200, None, "s0"), (201, "", None), (202, " ", "s1"), (3, rows[3][1], "s3"), (None, rows[6][1], "s0"), (None, rows[6][1], "s0"), (203, "w1 slur " * 3000 + "end", "s1")]
    return rows, items, [*labels, (None, 1, 1), (300, 1, 1), (5, None, None)]


def test_pipeline_equals_plain_versions(spark, tmp_path, monkeypatch):
    """Every stage on what its predecessor kept, and the whole."""
    import corpus_pipeline
    from echofold.llm import toxicity

    rows, items, labels = small_corpus()
    columns = ["doc_id", "text", "lang", "source", "n_chars", "component", "key", "place", "at"]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, component string, key int, place string, at string"
    docs = spark.createDataFrame([(d, t, "en", s, len(t or ""), "c", 7, "p", "x") for d, t, s in rows], kinds)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*items, (None, "w1 w2"), (99, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    nets, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *x: nets.append(train(*x)) or nets[-1])
    seen = [[tuple(r) for r in docs.collect()]]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(seen[-1], kinds), str(tmp_path))
        assert out.columns == columns or len(seen) == 5
        seen.append([tuple(r) for r in out.collect()])
    plain = lambda x: sorted(map(repr, x))
    reader = toxicity.Reader()
    logits = {r[1]: brute.toxic_logit(nets[0], reader, r[1]) for r in seen[0]}
    assert min(abs(x) for x in logits.values()) > 1e-4  # none so near to the border that rounding decides
    assert plain(seen[1]) == plain(r for r in seen[0] if logits[r[1]] < 0) and len(seen[1]) < len(seen[0])
    named = {r[0]: r[1] for r in seen[1] if r[0] is not None}
    kept = {d for d, _, _, k in brute.near_duplicates(list(named.items()), 5) if k}
    assert plain(seen[2]) == plain(r for r in seen[1] if r[0] is None or r[0] in kept) and len(seen[2]) < len(seen[1])
    unique = {r[0]: r[1] for r in seen[2] if r[0] is not None}
    digests = {x[0]: x for x in brute.substring_dedup(list(unique.items()))}
    assert sum(x[2] for x in digests.values()) > 0
    for before, after in zip(sorted(seen[2], key=repr), sorted(seen[3], key=lambda r: repr((r[0], next(x[1] for x in seen[2] if x[0] == r[0]))))):
        words = brute.WORD.findall(after[1] or "")
        assert before[:1] + before[2:] == after[:1] + after[2:]
        if before[0] is None or not digests[before[0]][2]:
            assert before[1] == after[1]
        else:
            assert hashlib.sha256(" ".join(words).encode()).hexdigest() == digests[before[0]][3]
    leaks = [r for r in seen[3] if any(brute.distance(t.split(), re.findall("[0-9a-z]+", (r[1] or "").lower())) <= len(t.split()) // 5 for _, t in items)]
    assert plain(seen[4]) == plain(r for r in seen[3] if r not in leaks) and leaks
    mixed = brute.mixing([(r[0], r[1], r[3]) for r in seen[4]], entries.TARGET_ENTROPY, entries.MAX_REPETITION)
    assert plain(r[:6] for r in seen[5]) == plain(mixed)
    texts = {(r[0], r[1], r[2], r[4]) for r in seen[4]}
    at = {c: i for i, c in enumerate(out.columns)}
    assert all((r[0], r[at["text"]], r[at["lang"]], r[at["n_chars"]]) in texts for r in seen[5])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == out.columns and plain(map(tuple, whole.collect())) == plain(seen[5])
    assert {"pipeline", *entries.QUERIES} <= set(entry.queries())


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(
    "head",
    [
        "<html><head><title>t</title>", "<html><head><title>t</title><noscript><link href=a>", "<html><head><title>t", "<html><head><title>t</head>",
        "<html><head><title>t</title><script>var a='</head>'</script><style>p{}</style>", "<html><head><title>t</title></head>",
    ],
)
def test_pages_without_the_end_of_their_head(head):
    page = head + "<body><article><h1>Head line</h1><p>First paragraph of the text.</p></article></body></html>"
    assert [b.text for b in html_extract.blocks(page)] == ["Head line", "First paragraph of the text."]


def test_silent_elements_stay_silent():
    page = "<head><title>a <b>c</b></title><noscript><p>no</p></noscript></head><body><template><p>x</p><script>'</template>'</script><p>y</p></template><svg><title>z</title></svg><p>One.</p>"
    assert [b.text for b in html_extract.blocks(page)] == ["One."]


def test_unclosed_silent_elements_silence_nothing():
    page = "<head><title>t</title><body><p>One.</p><svg><p>Two.</p><object><p>Three."
    assert [b.text for b in html_extract.blocks(page)] == ["One.", "Two.", "Three."]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><article><p>Whole text here.</p></article>", "Whole text here."),
        ("<html><head><script>if (a) document.write('<!-- x')</script></head><body><article><p>Whole text here.</p></article>", "Whole text here."),
        ("<body><noscript><article><p>Whole text here.</p></article>", "Whole text here."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be one.</p></article>", "Let x=1 be one."),
        ("<article><p>Sum <math><semantics><mi>s</mi><annotation encoding=tex>\\sum s</annotation></semantics></math> of all.</p></article>", "Sum s of all."),
        ("<article><p title='a > b' lang=de>One.<p class=\"x\">Two &#" + "9" * 6000 + "; &#0000065;.</p></article>", "One.\nTwo � A."),
        ("<article><p>1 < 2 and <b>3 > 2</b> and a <3</p></article>", "1 < 2 and 3 > 2 and a <3"),
        ("<article><p lang=\"de>One.</p><p>Two.</p></article>", "One.\nTwo."),
    ],
)
def test_no_text_is_lost(field, page, want):
    assert html_extract.main_text(field, page) == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 340_000, "<" * 1_000_000, '<a x=">" ' * 110_000, '<a ">" ' * 140_000 + '"', "<script>" + "</script " * 110_000, "<div>x" * 170_000, "<x>" * 170_000 + "</y>" * 125_000, "<li><ul>" + "<x>" * 1000 + "<li></li>" * 110_000, "<title>" * 140_000, "&" * 1_000_000, "<p>&#" + "1" * 1_000_000, "<!--" * 250_000, "<p " + "class='a" * 120_000 + ">", "<svg>" * 200_000],
    ids=lambda p: p[:12],
)
def test_hostile_pages_take_linear_time(field, page):
    began = time.perf_counter()
    html_extract.main_text(field, page)
    assert time.perf_counter() - began < 3


def test_deep_pages_keep_their_text():
    page = "<div>" * 5000 + "<p>One.</p>" + "</div>" * 5000 + "<p>Two.</p>"
    assert [b.text for b in html_extract.blocks(page)] == ["One.", "Two."]


@pytest.mark.parametrize("page,found", [
    ("<p>A<script>1</script>B</p>", ["AB"]), ("<p>C<svg></svg>D</p>", ["CD"]), ("<p>x <noscript>..</noscript> y</p>", ["x y"]), ("<p>a<!-- c -->b<style>z</style>c", ["abc"]),
    ("<svg><svg></svg><text>leak</text></svg>ok", ["ok"]), ("<template><template></template><p>leak</p></template>ok", ["ok"]), ("<object><object></object>leak</object>ok", ["ok"]),
    ("<svg><svg></svg>rest", ["rest"]), ("<svg><svg/>leak</svg>ok", ["ok"]), ("<template>a<svg></template>ok</svg>", ["ok"]), ("<svg>" * 600 + "x" + "</svg>" * 600 + "ok", ["ok"]),
])
def test_silent_elements_nest_and_leave_blocks_whole(page, found):
    assert [b.text for b in html_extract.blocks(page)] == found


class PlainReader(HTMLParser):
    """Blocks by the standard library's parser: text between block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.silent = [], [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.SILENT:
            self.silent.append(tag)
        elif not self.silent and tag == "br":
            self.parts.append(" ")
        elif not self.silent and tag not in html_extract.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if self.silent and tag == self.silent[-1]:
            self.silent.pop()
        elif not self.silent and tag not in html_extract.INLINE:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in html_extract.SILENT:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def plain_blocks(page):
    reader = PlainReader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.out


def test_blocks_equal_those_of_a_plain_reader(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    r = random.Random(9)
    tags = ["p", "div", "li", "b", "em", "span", "a href='x'", "svg", "template", "h2", "td", "section"]

    def tree(depth):
        out = ""
        for _ in range(r.randrange(1, 4)):
            out += r.choice(["word ", "&amp;", "two words", " ", "<br>", "<!-- no -->", "<script>if (a < b) '<p>'</script>", "<style>p {}</style>", "&eacute;t&eacute;"])
            if depth:
                tag = r.choice(tags)
                out += f"<{tag}>{tree(depth - 1)}</{tag.split()[0]}>"
        return out

    for page in pages + [tree(4) for _ in range(200)]:
        assert [b.text for b in html_extract.blocks(page)] == plain_blocks(page)



def test_page_texts_of_the_table(spark, sf):
    """Every block that the field keeps is in the page's own text, in order; menus and the like are not."""
    rows = entries.op6_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        found = [b.text for b in html_extract.blocks(r["html"])]
        at = iter(found)
        assert all(line in at for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"]) > 0
