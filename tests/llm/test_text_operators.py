"""Language ID, quality, toxicity, HTML, WARC, decontamination and mixing."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.errors import LaminaError
from lamina.llm import decontaminate, html_text, langid, mixing, quality, toxicity, warc
from lamina.llm.storage import new_path

WORD = r"[^\x20\x09-\x0D]+"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# language ID


def brute_language(text, known):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    counts = collections.Counter()
    for w in words:
        p = f" {w} "
        for n in (1, 2, 3):
            counts.update(g for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g != " ")
    if not counts:
        return "und"

    def key(g):
        out = 0
        for c in g:
            out = out << 21 | (1 if c == " " else ord(c) + 2)
        return out

    top = sorted(counts, key=lambda g: (-counts[g], key(g)))[: langid.TOP]
    best = None
    for lang in sorted(known):
        rank = {int(k): i for i, k in enumerate(known[lang])}
        far = sum(abs(i - rank[key(g)]) if key(g) in rank else langid.TOP for i, g in enumerate(top))
        if best is None or far < best[0]:
            best = (far, lang, 1 - far / (len(top) * langid.TOP))
    return best[1:]


def test_language_matches_brute_force_and_is_accurate(spark, make, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = langid.profiles(docs)
    odd = make([(9001, None), (9002, "12 %$ \n"), (9003, "ẞ é"), (9004, "zzz " * 5000), (None, "the")])
    both = docs.select("doc_id", "text").unionAll(odd)
    texts = collections.defaultdict(list)
    for r in both.collect():
        texts[r.doc_id].append(r.text)
    right = []
    lang = {r.doc_id: r.lang for r in docs.collect()}
    for r in langid.identify(both, known).collect():
        want = brute_language(texts[r.doc_id][0], known)
        if want == "und":
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=1e-9)
        if r.doc_id in lang and held(r.doc_id):
            right.append(r.lang_pred == lang[r.doc_id])
    assert sum(right) >= 0.98 * len(right)


def test_language_edges(make):
    schema = "doc_id long, text string, lang string, lang_pred string"
    assert langid.identify(make([(1, "abc", None, "x")], schema).select("doc_id", "text"), {}).first().lang_pred == "und"
    assert langid.keep_known(make([(1, "abc", None, "x")], schema)).collect()[0].lang_pred == "x"
    docs = make([(i, "lorem ipsum dolor", "la", "x") for i in range(20)] + [(50, "Привет мир", None, "x"), (51, None, "la", "x")], schema)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(20))


# quality


def brute_counts(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            lines += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered)


def test_quality_counts_and_verdict(spark, make, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(9000 + i, t) for i, t in enumerate([None, "", "\n\n", "a", "a\na\n\na", "x y z x y z x", "a b c\na b c", " a\r\na\r\n\x0b#*é \xa0", "q " * 9000, "\n", "a\n", "\na"])]
    docs = docs.unionAll(make(odd))
    texts = dict(docs.collect())
    out = quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    passed = [r for r in out if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.95 * len(passed)


def test_quality_without_rows_or_labels(make):
    labels = make([], "doc_id long, quality int, toxic int")
    assert quality.judged(make([]), labels).count() == 0
    rows = [(1, "w%d " % i * 60 if i < 0 else " ".join(f"w{j}" for j in range(60))) for i in range(3)]
    assert [r.kept for r in quality.judged(make([(*r, 0.5) for r in rows], "doc_id long, text string, features double"), labels).collect()] == [True] * 3


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(500, 3))
    points[:5] += 9
    trees = [np.array([256, *quality.grow(points[rng.choice(500, 256, replace=False)], rng).ravel()]) for _ in range(50)]
    score = quality.anomaly(points, trees)
    assert score[:5].min() > np.quantile(score[5:], 0.97)


def brute_path(node, nodes, point, depth=0):
    """Path length by walking the tree as Python lists."""
    feature, split, left, right, length = nodes[node]
    if feature < 0:
        return depth, length
    return brute_path(int(left if point[int(feature)] < split else right), nodes, point, depth + 1)


def test_quality_verdict_matches_brute_force(spark, sf, monkeypatch):
    """Scores by walking each tree, leaf lengths by their definition, the threshold by trying all, the verdict from both."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    kept = {}
    real = quality.forest
    monkeypatch.setattr(quality, "forest", lambda stats: kept.setdefault("trees", real(stats)))
    out = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    points = {r.doc_id: r.features for r in quality.measured(docs).collect()}
    c = lambda n: 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    trees = [(int(t[0]), t[1:].reshape(-1, 5).tolist()) for t in kept["trees"]]
    assert len(trees) > 50 and sum(size for size, _ in trees) == len(points)
    for i, point in points.items():
        total = 0.0
        for size, nodes in trees:
            depth, length = brute_path(0, nodes, point)
            assert length >= depth and depth <= math.ceil(math.log2(max(size, 2)))
            total += length
        assert out[i].anomaly == pytest.approx(2 ** (-total / sum(max(c(size), 1e-9) for size, _ in trees)))
    known = [(out[r.doc_id].anomaly, r.quality) for r in labels.collect() if r.quality is not None and not out[r.doc_id].base_failed]
    good, bins = [a for a, q in known if q == 1], quality.BINS
    tried = []
    for b in range(bins + 1):
        rejected = [q for a, q in known if int(a * bins) >= b]
        if rejected.count(1) <= quality.FALSE_REJECTS * len(good) and rejected.count(0):
            tried.append((rejected.count(0), b))
    edge = max(tried)[1] / bins if tried and good else 2.0
    assert {i for i, r in out.items() if r.kept} == {i for i, r in out.items() if not r.base_failed and r.anomaly < edge}


def test_quality_grows_leaves_by_their_sizes():
    points = np.random.default_rng(1).normal(size=(64, 2))
    nodes = quality.grow(points, np.random.default_rng(2)).tolist()
    held = collections.Counter()
    for p in points:
        node, depth = 0, 0
        while nodes[node][0] >= 0:
            node, depth = int(nodes[node][2 if p[int(nodes[node][0])] < nodes[node][1] else 3]), depth + 1
        held[node, depth] += 1
    for (node, depth), n in held.items():
        assert nodes[node][4] == pytest.approx(depth + (0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n))


def test_odd_rows_of_map_operators(make):
    """Repeated rows, long texts and clashing columns: one result for each row, alike for alike rows."""
    schema = "doc_id long, text string, score double, lang_pred string, n_words string, anomaly int"
    long = "word other " * 60_000
    rows = [(1, long, 0.1, "x", "y", 3), (1, long, 0.2, "x", "y", 3), (None, None, None, None, None, None), (2, "", 0.0, "", "", 0)]
    docs = make(rows, schema)
    judged = quality.judged(docs, make([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words, r.base_failed) for r in judged) == [("1", 120_000, 120_000, True)] * 2 + [("2", 0, 0, True), ("None", 0, 0, True)]
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    assert sorted((str(r.doc_id), r.score) for r in toxicity.scored(docs, model).collect()) == [("1", 0.5), ("1", 0.5), ("2", 0.5), ("None", 0.5)]


# toxicity


def brute_rates(text):
    """n-gram -> count over the text's length, by slicing strings."""
    plain = re.sub("\x01+", "\x01", "\x01" + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() or c in "0123456789" else "\x01" for c in text) + "\x01")
    grams = collections.Counter(plain[i : i + n] for n in (3, 4, 5) for i in range(len(plain) - n + 1))
    return {g: c / max(len(text), 1) for g, c in grams.items()}


def gram_key(gram):
    """The feature's number of an n-gram, in plain integers."""
    mask = 2**64 - 1

    def mixed(x):
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = ((x ^ x >> shift) * by) & mask
        return x ^ x >> 33

    key = 0
    for c in gram:
        key = (key * 0x9E3779B97F4A7C15 + mixed(1 if c == "\x01" else ord(c) + 2)) & mask
    return mixed((key + len(gram)) & mask) >> (64 - toxicity.BITS)


def test_toxicity_features_ratios_and_scores_match_brute_force(make):
    rng = random.Random(8)
    ids = [i for i in range(400) if not held(i)][:120]
    words = ["you", "are", "Idiot", "fool", "nice", "day", "ünd", "x9", "..", "ok!"]
    texts = {i: " ".join(rng.choice(words[2 * (k % 2) : 8 + k % 3]) for _ in range(rng.randrange(1, 12))) for k, i in enumerate(ids)}
    toxic = {i: int("diot" in t or "fool" in t) for i, t in texts.items()}
    docs = make([*texts.items(), (401, ""), (402, None)])
    model = toxicity.train(docs, make([(i, 1, x) for i, x in toxic.items()], "doc_id long, quality int, toxic int"))
    sums, seen = [collections.Counter(), collections.Counter()], collections.Counter()
    by_key = {}
    for i, t in texts.items():
        by_key[i] = collections.Counter()
        for g, r in brute_rates(t).items():
            by_key[i][gram_key(g)] += r
        for k, r in by_key[i].items():
            sums[toxic[i]][k] += r
            seen[k] += 1
    bad, good = sum(toxic.values()), len(toxic) - sum(toxic.values())
    scale, smooth = toxicity.SCALE, toxicity.SMOOTH
    ratio = {k: math.log((smooth + sums[1][k] * scale) / bad) - math.log((smooth * good / bad + sums[0][k] * scale) / good) for k, n in seen.items() if n >= toxicity.LEAST_TEXTS}
    assert model.keys.tolist() == sorted(ratio) and len(ratio) > 50
    # a weight is the ratio times what logistic regression gives it, so its sign is the ratio's in the main
    assert np.corrcoef(model.weights, [ratio[k] for k in sorted(ratio)])[0, 1] > 0.5
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.scored(docs, model).collect():
        z = model.bias + sum(weights.get(k, 0.0) * v for k, v in by_key.get(r.doc_id, {}).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_toxicity_fit_comes_near_the_least_loss():
    """The fit, which stops after ``STEPS``, against long gradient descent on the same penalised loss."""
    rng = np.random.default_rng(3)
    usable, ratio = np.arange(6), rng.normal(size=6)
    keys = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(80)]
    values = [rng.random(len(k)) / toxicity.SCALE for k in keys]
    x = np.zeros((80, 6))
    for i, (k, v) in enumerate(zip(keys, values, strict=True)):
        x[i, k] = v * toxicity.SCALE * ratio[k]
    toxic = (x @ rng.normal(size=6) + rng.normal(size=80) * 0.3 > 0).astype(int)
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - toxic * z)).sum() + toxicity.PENALTY / 2 * (w**2).sum()

    w, b = np.zeros(6), 0.0
    for _ in range(20_000):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - toxic)
        w, b = w - 2 * (x.T @ g + toxicity.PENALTY * w), b - 2 * g.sum()
    got, bias = toxicity._fit(keys, values, toxic, usable, ratio)
    assert loss(got / ratio / toxicity.SCALE, bias) - loss(w, b) <= 0.3 * (loss(np.zeros(6), 0.0) - loss(w, b))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in toxicity.op5_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held(r.doc_id)]
    toxic = [out[r.doc_id].predicted for r in labels if r.toxic == 1]
    clean = [out[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean) and len(toxic) > 50
    assert all(out[i].held_out == held(i) for i in out) and all(0 <= r.score <= 1 for r in out.values())


def test_toxicity_edges(make):
    labels = "doc_id long, quality int, toxic int"
    docs = make([(i, f"you {'idiot' if i % 2 else 'friend'} number {i % 3}") for i in range(60)] + [(None, None), (60, ""), (3, "idiot again")])
    model = toxicity.train(docs, make([(i, 1, i % 2) for i in range(60)] + [(5, None, None), (None, 1, 1)], labels))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 63 and all(r.score > 0.5 for r in got if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 60)
    assert all(r.score < 0.5 for r in got if r.doc_id is not None and r.doc_id % 2 == 0)
    none = toxicity.train(docs, make([], labels))
    assert {round(r.score, 9) for r in toxicity.scored(docs, none).collect()} == {0}
    assert toxicity.scored(make([]), model).count() == 0


def test_toxicity_learns_from_four_texts(make):
    ids = [i for i in range(200) if not held(i)][:64]
    rows = [(i, "you idiot" if k < 4 else f"a friend {k % 3}", int(k < 4)) for k, i in enumerate(ids)]
    docs = make([r[:2] for r in rows])
    model = toxicity.train(docs, make([(i, 1, toxic) for i, _, toxic in rows], "doc_id long, quality int, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert min(score[i] for i in ids[:4]) > 0.5 > max(score[i] for i in ids[4:])


# HTML


PAGES = [
    (1, "http://a.example/x", "<html><body><nav><a href=/>Home</a></nav><div class='post-12'><h1>T &amp; U</h1><p>One <b>two</b>&nbsp;three<br>four<p>five</div><div id=comments>No</div><footer>F</footer></body></html>"),
    (2, "http://a.example/y", "<body><div class='sidebar'>menu</div><div class=\"post-7\"><p>A&#233; &lt;b&gt;</p><script>var a='<p>no</p>';</script><form>f</form></div>"),
    (3, "http://a.example/z", "<body><div class='post-1'>short</div><div class='other'><p>much longer text of another container here</p></div>"),
    (4, None, None), (5, "junk", "plain text only"), (6, "http://b.example/", "<article><p>cut &am"), (6, "http://b.example/", "<article><p>cut here <a href='x"),
    (None, "http://c.example", ""),
]


def test_html_text(make):
    rows = html_text.extracted(make([(*p, "t") for p in PAGES], "page_id long, url string, html string, text string"))
    got = sorted(((r.page_id, r.text) for r in rows.collect()), key=str)
    want = [(1, "T & U One two three four five"), (2, "Aé <b>"), (3, "short"), (4, ""), (5, "plain text only"), (6, "cut &am"), (6, "cut here"), (None, "")]
    assert got == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in rows.collect())
    assert html_text.extracted(make([], "page_id long, url string, html string")).count() == 0


def test_html_names_never_drop_the_article(make):
    words = "An article of a few words. " * 9
    inner = f"<p>{words}</p>"
    shells = [
        f"<body class='no-sidebar'><div>{inner}</div>", f"<body class='home search'><div>{inner}</div>", f"<html class='nav'><body>{inner}",
        f"<body><div class='has-sidebar'>{inner}</div><footer>legal</footer>", f"<body><article class='post share'>{inner}</article>", f"<body><section id='related'>{inner}</section>",
        f"<body><main id='search'><h2 class='header'></h2>{inner}</main>", f"<body><div class='widget'><div class='x'>{inner}</div></div>", f"<body><table id='header'><tr><td>{inner}</table>",
    ]
    shells = [(i, f"http://h{i}.example/", s) for i, s in enumerate(shells)]
    kept = [
        (90, "http://k.example/", f"<body><h1 class='post-header'>T</h1>{inner}<ul class='menu'><li>no</ul><p>x <span class='share'>no</span>y</p><div id='sidebar'><div>no</div></div>"),
        (91, "http://l.example/", f"<body><div class='share'>{inner}<div class='comments'>no</div></div><div class='ad'><p>no</p></div>"),
    ]
    got = {r.page_id: r.text for r in html_text.extracted(make(shells + kept, "page_id long, url string, html string")).collect()}
    assert got == {i: words.strip() for i, *_ in shells} | {90: f"T {words}x y", 91: words.strip()}


def test_html_keeps_title_lead_and_sections(make):
    long = "A long text of many words, the body of it. " * 20
    pages = [(i, "http://a.example/", f"<body><nav>n</nav><article><h1>T{i}</h1><p>lead</p><div class='body'><p>{long}</p></div></article>") for i in range(3)]
    pages += [(10 + i, "http://b.example/", f"<body><article><div class='p'><h1>T</h1></div><section class='a'>{long}</section><section class='b'>more</section></article>") for i in range(3)]
    # another template, with a small container of the winning path
    pages += [(20, "http://a.example/", f"<body><article><p>teaser</p></article><div class='story'><h1>S</h1><p>{long}</p></div>")]
    # the article is in the page itself
    pages += [(30, "http://c.example/", f"<h1>T</h1><div><p>{long}</p></div>")]
    got = {r.page_id: r.text for r in html_text.extracted(make(pages, "page_id long, url string, html string")).collect()}
    long = long.strip()
    assert got == {i: f"T{i} lead {long}" for i in range(3)} | {10 + i: f"T {long} more" for i in range(3)} | {20: f"teaser S {long}", 30: f"T {long}"}


def test_html_of_the_tables(spark, sf):
    """The tables' pages have one layout, for which an expression suffices."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op6_html_text(spark, sf).collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", pages[r.page_id])[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


# WARC


def archive_rows():
    fake = (warc.record(77, "http://fake", b"boo", None, False) + warc.END).decode()
    big = "x" * 50_000
    texts = [None, "", "a", "a", "a", fake, f"{fake}tail", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é\r\n\r\n", big, big, "last\r\n\r\n", "WARC/1."]
    return [(i, f"http://h/ {i}" if i % 3 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("block", [64, 1 << 20])
def test_warc_round_trip(spark, make, compressed, block):
    rows = archive_rows()
    path = warc.write_archives(make([(*r, "s") for r in rows], "page_id long, url string, html string, sha string"), new_path(spark, "w"), compressed)
    got = {r.page_id: r for r in warc.read_archives(spark, path, block).collect()}
    groups = collections.defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for i, url, t in rows:
        data, top = (t or "").encode(), max(groups[t or ""])
        r = got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.intact
        assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
        assert r.url == (url and url.replace(" ", "%20"))


def test_warc_false_starts_are_candidates_but_not_kept():
    fake = warc.record(77, None, b"boo", None, False) + warc.END
    data = warc.record(1, None, b"--" + fake + b"--", None, False) + warc.END + warc.record(2, None, b"z", None, False) + warc.END
    assert [c["record"]["page_id"] for c in warc.candidates(data)] == [1, 77, 2]


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_long_headers_and_broken_chains(spark, make, tmp_path, compressed):
    rows = [(1, "http://h/1", "a"), (2, "http://h/" + " " * 30_000, "b"), (3, "http://h/3", "c"), (4, "http://h/" + "x" * 1_000_000, "d"), (5, None, "e")]
    pages = make(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.archived(pages, compressed).collect()
    assert {r.page_id: r.url for r in got} == {i: u and u.replace(" ", "%20") for i, u, _ in rows}
    parts = [warc.record(i, u, t.encode(), None, False) + warc.END for i, u, t in rows]
    data = b"".join(map(warc._gzip, parts) if compressed else parts)
    (tmp_path / "a.warc").write_bytes(data)
    assert warc.read_archives(spark, str(tmp_path)).count() == 5
    for bad in (data[:-9], data + b"x", b"x" + data):
        (tmp_path / "a.warc").write_bytes(bad)
        with pytest.raises(LaminaError):
            warc.read_archives(spark, str(tmp_path))


def test_warc_repeated_and_empty(spark, make):
    rows = [(1, None, "p"), (1, None, "p"), (None, None, "q"), (None, None, "q"), (None, None, "p")]
    got = warc.archived(make(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("1", "response", "None")] * 2 + [("None", "response", "None")] * 2 + [("None", "revisit", "1")]
    )
    assert warc.archived(make([], "page_id long, url string, html string")).count() == 0


# decontamination


def brute_matches(text, items):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for i, item in items.items():
        n = len(item)
        if n < decontaminate.MIN_WORDS:
            continue
        row = [0] * (len(words) + 1)
        for a in item:
            new = [row[0] + 1]
            for j, b in enumerate(words):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= int(n * 0.2 + 1e-9):
            out.add((i, min(row)))
    return out


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdefg')}{rng.randrange(400)}"
    items = {i: [word() for _ in range(rng.randrange(5, 50))] for i in range(20)}
    docs = []
    for i in range(200):
        words = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            p = list(items[i % 20])
            for _ in range(rng.randrange(0, len(p) // 5 + 2)):
                k = rng.randrange(len(p))
                rng.choice([lambda: p.__setitem__(k, word()), lambda: p.pop(k), lambda: p.insert(k, word())])()
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).replace("a", "A")))
    return docs, items


def test_decontamination_recall_against_brute_force(make):
    docs, items = planted(5)
    bench = make([(i, " ".join(w)) for i, w in items.items()] + [(99, "the"), (98, None), (97, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(make(docs), bench).collect()}
    want = {(d, i, n) for d, t in docs for i, n in brute_matches(t, items)}
    assert {g[:2] for g in got} <= {w[:2] for w in want} and len(want) > 60
    assert len(got & want) >= 0.97 * len(want)


def test_decontamination_of_sizes_that_sampling_cannot_reach(make, monkeypatch):
    """Where too few repeats are allowed, all windows that pass the count filter are verified."""
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 1)
    docs, items = planted(6)
    index = decontaminate.build([(i, " ".join(w)) for i, w in items.items()])
    assert 0 in index.repeats.values()
    bench = make([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(make(docs), bench).collect()}
    sizes = {len(w) for w in items.values() if not index.repeats.get(len(w), 1)}
    want = {(d, i, n) for d, t in docs for i, n in brute_matches(t, items) if len(items[i]) in sizes}
    assert want and want <= got


def test_decontamination_edges(make):
    bench = make([(1, "one two three four five six"), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "ONE, two-three FOUR five (six)!"), (3, "one two three four five six"), (None, "x one two four five six y"), (4, "six five four three two one"), (5, "alpha beta gamma delta epsilon zeta")]
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(make(rows), bench).collect()), key=str)
    assert got == sorted([(3, 1, 0), (3, 1, 0), (None, 1, 1), (5, None, 0)], key=str)
    kept = decontaminate.clean(make([(*r, "s") for r in rows], "doc_id long, text string, hit string"), bench)
    assert kept.columns == ["doc_id", "text", "hit"] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    none = make([], "item_id long, text string")
    assert decontaminate.contaminated(make(rows), none).count() == 0 and decontaminate.clean(make(rows), none).count() == len(rows)
    assert decontaminate.contaminated(make([]), bench).count() == 0


# mixing


def brute_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, fixed = [0.0] * len(sizes), set()
    while True:
        rest = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in fixed)
        total = sum(w for i, w in enumerate(weights) if i not in fixed)
        for i, w in enumerate(weights):
            out[i] = 2.0 * sizes[i] if i in fixed else rest * w / total
        new = {i for i in range(len(sizes)) if i not in fixed and out[i] > 2 * sizes[i] + 1e-9}
        if not new:
            return out
        fixed |= new


def test_mixing(spark, make, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    odd = make([(9000, None, "src0"), (9001, "a b", None), (9002, "", "src1"), (5, "é\xa0é x", "src2"), (5, "é\xa0é x", "src2"), (None, "q", "zz")], "doc_id long, text string, source string")
    docs = docs.unionAll(odd)
    plain = docs.collect()
    sizes = collections.Counter()
    for r in plain:
        sizes[r.source] += len(re.findall(WORD, r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, brute_targets([sizes[s] for s in order]), strict=True))
    documents, slots = mixing.mix(docs)
    got = documents.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs)[0].collect()))
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in got) == sorted(
        (str(r.doc_id), len(re.findall(WORD, r.text or "")), sizes[r.source], round(aims[r.source], 6)) for r in plain
    )
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken, near = collections.Counter(), {(sizes[s], round(aims[s], 6)): s for s in order}
    for r in got:
        taken[near[r.source_size, round(r.target, 6)]] += r.taken
    assert all(abs(taken[s] - aims[s]) <= 0.01 * aims[s] + 2 * mixing.BLOCK for s in order)

    # taken, word by word from the slots, for documents in the order that is stated
    placed = collections.defaultdict(list)
    rows = mixing.sized(docs).collect()
    buckets = max(1, len(rows) // mixing.BUCKET)
    for r in sorted(rows, key=lambda r: (r.h % buckets, r.doc_id is None, r.doc_id or 0, r.h, r["size"])):
        placed[r.source] += [(r.doc_id, r.h)] * r["size"]
    count = collections.Counter()
    slots = slots.collect()
    for x in slots:
        count.update(placed[x.source][x.block * mixing.BLOCK : (x.block + 1) * mixing.BLOCK])
    want = sorted(((r.doc_id, r["size"], count[r.doc_id, r.h] // sum(y[:2] == r[:2] and y.h == r.h for y in rows)) for r in rows if r.doc_id != 5), key=str)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got if r.doc_id != 5), key=str) == want

    # slots: each source's number is exact, each pass takes every block once, shards are multinomial draws but for the last step
    blocks = [-(-sizes[s] // mixing.BLOCK) for s in order]
    wanted = mixing.slots_of(np.array(blocks), [sizes[s] for s in order], [aims[s] for s in order])
    by = collections.Counter(x.source for x in slots)
    assert [by[s] for s in order] == wanted.tolist() and all(abs(w - b * aims[s] / sizes[s]) < 1 for w, b, s in zip(wanted, blocks, order, strict=True))
    for s, b in zip(order, blocks, strict=True):
        used = collections.Counter(x.block for x in slots if x.source == s)
        assert set(used.values()) <= ({by[s] // b, -(-by[s] // b)}) and max(used) < b
    shards = collections.defaultdict(collections.Counter)
    for x in slots:
        shards[x.shard][x.source] += 1
    total = int(wanted.sum())
    drawn = {i: np.random.default_rng([mixing.SEED, i]).multinomial(min(mixing.SLOTS, total - i * mixing.SLOTS), wanted / total) for i in range(-(-total // mixing.SLOTS))}
    moved = sum(abs(shards[i][s] - n) for i, d in drawn.items() for s, n in zip(order, d.tolist(), strict=True))
    assert sorted(shards) == sorted(drawn) and moved == np.abs(sum(drawn.values()) - wanted).sum()

    # another split of the rows gives the same mix
    again = mixing.mix(docs.repartition(7, "text").sortWithinPartitions(F.desc("doc_id")))[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mixing_draws_are_corrected_over_many_shards():
    blocks, wanted = np.array([500, 40, 9, 0]), np.array([700, 80, 10, 0])
    draw = mixing.Draw(blocks, wanted, 32, 5)
    counts = np.array([draw.counts(i) for i in range(draw.shards)])
    draw.drawn = counts.sum(axis=0)
    assert draw.total == counts.sum() == 790 and (draw.drawn != wanted).any()
    got = [np.stack(draw.corrected(s, np.arange(n))) for s, n in enumerate(draw.drawn)]
    source, turn = np.concatenate(got, axis=1)
    for s, w in enumerate(wanted):
        assert sorted(turn[source == s].tolist()) == list(range(w))


def test_mixing_edges(make):
    schema = "doc_id long, text string, source string, size long"
    assert mixing.mix(make([], schema))[0].count() == 0
    got = mixing.mix(make([(1, None, "a", 7), (2, " ", None, 7)], schema))[0].collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    got = mixing.mix(make([(1, "w " * 30_000, "a", 7), (2, "x", "b", 7)], schema))[0].collect()
    assert sum(r.taken for r in got) == pytest.approx(45_001.5, rel=0.02)


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 1000):
        for key in (1, 99):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(out.tolist()) == list(range(n))


def test_words_share_no_row():
    from lamina.llm.vectors import Words, text_bytes

    w = Words(*text_bytes(pa.array(["ab", "cd ", None, "", " e", "f"]).slice(0)))
    assert w.count.tolist() == [1, 1, 0, 0, 1, 1] and len(set(w.hash.tolist())) == 4
