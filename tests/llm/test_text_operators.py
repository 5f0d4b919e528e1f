"""Each operator against brute force on small messy tables, and on sf0.001 where that is quick."""

import collections
import hashlib
import json
import random
import re
import zlib

import duckdb
import pytest

from marketflow.llm import (bpe, components, decontaminate, html_extract, jaccard_join, line_dedup, pii, quality_rules,
                            substring_dedup, toxicity, url_filter)
from marketflow.llm.queries import tokenizer_path
from tests.llm.conftest import messy_texts

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lower = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)
big = lambda i: (1 << 63) if i is None else i


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ------------------------------------------------------------------ substring dedup

def brute_substrings(docs, window=50):
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, big(None)), big(i))
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < big(i):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, messy, empty):
    got = substring_dedup.substring_dedup(messy)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_text") == brute_substrings(messy_texts())
    assert set(got.columns) == {*messy.columns, "n_words", "n_removed", "removed", "kept_text"}
    docs = [tuple(r) for r in docs_of(spark).collect()]
    assert rows(substring_dedup.substring_dedup(docs_of(spark)), "doc_id", "n_words", "n_removed", "kept_text") == brute_substrings(docs)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_common_passage(spark):
    """A passage in every document, in contexts of its own: only the passage goes, from all but the first."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(70))
    texts = [(k, " ".join(f"w{rng.random()}" for _ in range(40)) + f" {passage} " + " ".join(f"w{rng.random()}" for _ in range(40)))
             for k in range(300)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5))
    assert {r[0]: r[1] for r in got.select("doc_id", "n_removed").collect()} == {k: 70 * (k > 0) for k in range(300)}


# ------------------------------------------------------------------ n-gram Jaccard join

def brute_components(docs):
    sets = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), big(None)), big(i))
    return sorted(((i, len(sets[k]), None if least[find(k)] == big(None) else least[find(k)])
                   for k, (i, _) in enumerate(docs)), key=repr)


def test_jaccard_join(spark, messy, empty):
    got = jaccard_join.near_duplicates(messy)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(messy_texts())
    docs = [tuple(r) for r in docs_of(spark).collect()]
    assert rows(jaccard_join.near_duplicates(docs_of(spark)), "doc_id", "n_shingles", "component_id") == brute_components(docs)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_chains_and_near_copies(spark):
    """Chains of ever further texts, a large group of near copies and a common line in all texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    line = " ".join(word() for _ in range(9))
    base = [word() for _ in range(60)]
    texts = []
    for k in range(260):  # enough that the group's n-grams count as hot
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = word()
        texts.append(f"{' '.join(w)} {line}")
    chain = [word() for _ in range(40)]
    for k in range(30):
        chain[k] = word()
        texts.append(" ".join(chain))
    texts += [f"{line} {' '.join(word() for _ in range(rng.randrange(3, 20)))}" for _ in range(60)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------ quality rules and URL filter

def test_quality_rules(spark, messy, empty):
    good = " ".join(f"Word{k} follows w{k}." for k in range(40))
    extra = spark.createDataFrame([(100, "Home | News | About | Contact | Login\n" + good),
                                   (101, "### $$$ %%% &&& *** ###\n" * 30), (102, "same three words " * 40),
                                   (103, "\n".join(f"| a{k} | b{k} | c{k} | d{k} |" for k in range(60)) + "\n" + good[:300]),
                                   (104, "click here\nWe make use of cookies\n" + good)], "doc_id bigint, text string")
    table = messy.select("doc_id", "text").union(extra)
    got = quality_rules.quality_rules(table)
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    want = con.sql(quality_rules._sql("documents")).fetchall()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    assert rows(got, *names) == sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in want), key=repr)
    kept = {r[0] for r in got.where("kept").collect()}
    assert {100, 104} <= kept and not kept & {101, 102, 103, 0, 1}
    assert got.where("doc_id = 100").first()["clean_text"]== good
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_rules(messy).count() == len(messy_texts())


@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_url_filter"])
def test_sql_oracles(spark, name):
    from marketflow.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert rows(got, *names) == sorted((tuple(r) for r in want.select(*names).fetchall()), key=repr)


def test_url_filter(spark):
    rules = [*url_filter.RULES, ("block", "example.org", "/private"), ("allow", "example.org", "/private/ok/"), ("block", "com", "/"),
             ("allow", "b.c", "/xx"), ("block", "a.b.c", "/")]
    urls = ["https://WWW.Example.com/en/1?x=1", "http://example.com/en/2", "http://m.example.com/de/", "https://x.net/es/a", "x.net/es/a",
            "http://net", "http://net/es", "http://net/es/", None, "", "http://example.org/privateer", "http://example.org/private/ok/1",
            "ftp://a.b.c/xx", "http://notexample.com/en/", "http://example.com?/en/", "a://b://c/en/", "http://.com/", "HTTP://É.COM/\n/en/"]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string")

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host, best = lower(host), None
        for v, h, p in rules:
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                if best is None or (len(h + p), len(h), v == "block") > (len(best[1] + best[2]), len(best[1]), best[0] == "block"):
                    best = (v, h, p)
        return host, path, best and best[1] + best[2], best[0] if best else url_filter.DEFAULT_VERDICT

    got = url_filter.filter_urls(pages, rules)
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(((k, *plain(u)) for k, u in enumerate(urls)), key=repr)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, [("allow", "h" * (url_filter.MAX_RULE_BYTES + 1), "/")])


# ------------------------------------------------------------------ HTML extraction

PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One  two\n three</p><p>Four</p></article></body></html>":
        "T & U\nOne two three\nFour",
    "<body><div class='cookie-notice'>We use cookies here and there and everywhere</div><div id=main><p>First real paragraph of it.</p>"
    "<p>Second real one, as long.</p><div class=comments><p>I am a reader and say much more than the text does.</p></div></div>"
    "<div class='sidebar'>x</div></body>": "First real paragraph of it.\nSecond real one, as long.",
    "<article><p>a<b>b</b>c<br>d</p><script>var t='</p>';</script><form><p>no</p></form><ul><li>x<li>y</ul></article>": "abc d\nx\ny",
    "plain &lt;text&gt; only": "plain <text> only",
    "<main><p>cut off he": "cut off he",
    "<main><p>cut off</p><p cla": "cut off",
    "<p>&#233;&eacute;&#x4e2d; &nosuch;": "éé中 &nosuch;",
    "<!-- <p>no</p> --><p>yes</p>": "yes",
    "<style>p{}</style>": "",
    "<div hidden>a</div><div style='display: none'>b</div><p>seen</p>": "seen",
}


def test_html_extract(spark):
    pages = list(PAGES.items()) + [(None, ""), ("", ""), ("<b>" * 3000 + "deep", "deep"), ("<p>" + "long " * 40000 + "</p>", ("long " * 40000).strip())]
    table = spark.createDataFrame([(k, h, "old", 3) for k, (h, _) in enumerate(pages)], "page_id bigint, html string, text string, n_chars int")
    got = html_extract.extract(table)
    assert rows(got, "page_id", "text", "n_chars") == sorted(((k, t, len(t)) for k, (_, t) in enumerate(pages)), key=repr)
    assert html_extract.extract(table.limit(0)).count() == 0


def test_html_extract_articles():
    """Sibling articles, titles in an article's header, comments marked up as articles, teasers made of links."""
    long = "One plain sentence of the story goes here, and it goes on for a while. " * 6
    page = (f"<body><header><h1>Site</h1></header><div><article><header><h2>First title</h2></header><p>{long}</p></article>"
            f"<article><header class='x'><h2>Second title</h2></header><div><p>{long}</p><p>{long}</p></div><footer>tags</footer></article>"
            f"<article class='comment-7'><p>{long}</p></article><article><ul><li><a href=a>go</a></li><li><a href=b>on</a></li></ul></article></div>"
            "<footer>about</footer></body>")
    block = long.strip()
    assert html_extract.main_text(page) == "\n".join(["First title", block, "Second title", block, block])
    nested = f"<main><p>Short.</p><article><p>{long}</p><article><p>Inner.</p></article></article></main><article><p>{long}</p></article>"
    assert html_extract.main_text(nested) == "\n".join(["Short.", block, "Inner.", block])
    many = "<body>" + f"<article><h2>T</h2><p>{long}</p></article>" * 3 + "</body>"
    assert html_extract.main_text(many) == "\n".join(["T", block] * 3)
    assert html_extract.main_text("<body><article></article><article> </article></body>") == ""


def test_html_extract_pages(spark):
    """All pages of the test data: the text is the article's blocks."""
    for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).select("html", "text").collect():
        body = r["html"].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html_extract.html.unescape(re.sub(r"<[^>]*>?", "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", body))]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_jaccard_join_near_misses_are_not_counted(spark):
    """Large sets of one family that miss the threshold do not reach the overlap counts pair by pair; links all do."""
    import itertools

    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]

    def edited(words, seed, step):
        return [f"x{seed}_{k}" if (k + 7 * seed) % step == 0 else w for k, w in enumerate(words)]

    texts = [" ".join(edited(base, k, 50)) for k in range(24)]
    texts += [" ".join(texts[k].split()[:-rng.randrange(1, 40)]) for k in range(12)]
    sets = jaccard_join.Sets(pa.array(texts), jaccard_join.N)
    grams = [set(sets.grams[a:b].tolist()) for a, b in zip(sets.off[:-1], sets.off[1:])]
    linked = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
              if 100 * len(grams[a] & grams[b]) >= 75 * len(grams[a] | grams[b])}
    rows = spark.createDataFrame([(k, len(grams[k]), m.tolist(), *n.tolist()) for k, (m, n) in enumerate(zip(sets.bitmaps(jaccard_join.WIDE), sets.bitmaps()))],
                                 "sid bigint, n bigint, wide array<bigint>, m0 bigint, m1 bigint, m2 bigint, m3 bigint")
    a, b = (rows.select(*(F.col(c).alias(x + c) for c in ("sid", "n", *jaccard_join.MAP))) for x in "ab")
    pairs = a.join(b, F.col("asid") < F.col("bsid")).where(jaccard_join._bounds("a", "b", "an", "bn")).selectExpr(
        "asid AS a", "bsid AS b", "an AS na", "bn AS nb")
    near = {(r.a, r.b) for r in jaccard_join._near(pairs, rows).collect()}
    assert len(linked) >= 12 and linked <= near
    assert pairs.count() > 400 and len(near) < len(linked) + 20


# ------------------------------------------------------------------ line dedup

def brute_lines(docs):
    seen, out = set(), []
    for i, t in sorted(set(docs), key=lambda d: big(d[0])):
        lines = (t or "").split("\n")
        some = [k for k, x in enumerate(lines) if x.encode().strip()]
        gone = set()
        for j, k in enumerate(some):
            keys = [((lines[k], lines[some[j + 1]]), [k, some[j + 1]])] if j + 1 < len(some) else []
            if len(lines[k].encode().split()) >= line_dedup.LONG_WORDS:
                keys.append((lines[k], [k]))
            for key, at in keys:
                if key in seen:
                    gone |= set(at)
                seen.add(key)
        out.append((i, len(some), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return {(r[0], t): r for r, (_, t) in zip(out, sorted(set(docs), key=lambda d: big(d[0])))}


def test_line_dedup(spark, messy, empty):
    n = "aggregate(deleted, 0L, (n, r) -> n + r.end - r.start)"
    for table, docs in ((messy, messy_texts()), (docs_of(spark), [tuple(r) for r in docs_of(spark).collect()])):
        if table is messy:  # of the rows without id, only one has lines
            assert sum(i is None and bool(t) for i, t in docs) == 1
        want = brute_lines(docs)
        got = line_dedup.line_dedup(table).selectExpr("doc_id", "text", "n_lines", f"{n} AS n", "clean_text").collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r[0], *r[2:]) == want[r[0], r[1]]
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_larger_window():
    import numpy as np
    import pyarrow as pa

    lines = line_dedup.Lines(pa.array(["a\nb\nc\nd\n\ne", "x\nb\nc\nd\ny", None, "z"]))
    assert lines.counts.tolist() == [5, 5, 0, 1]
    doc, place, fp, win, size = line_dedup.fingerprints(lines, 3)
    assert (doc == 0).sum() == 3 and (doc == 1).sum() == 3 and not np.isin(doc, (2, 3)).any()
    shared = set(zip(fp[doc == 0], win[doc == 0])) & set(zip(fp[doc == 1], win[doc == 1]))
    assert len(shared) == 1 and place[(doc == 1) & (win == next(iter(shared))[1])].tolist() == [1]


def test_line_dedup_single_short_lines(spark):
    """A short line between lines of one document only goes from all documents but the first, a one-word line too."""
    docs = [(k, f"start {k} here\nread our nine word notice before you go on\nmiddle {k}\n\nmenu\nend {k}") for k in range(50)]
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    want = {k: t if not k else f"start {k} here\nmiddle {k}\n\nend {k}" for k, t in docs}
    assert {r[0]: r[1] for r in got.select("doc_id", "clean_text").collect()} == want


def test_line_dedup_windows_of_shorter_lines(monkeypatch):
    """With a larger least number of words, windows that hold a shorter line are joined besides the longer lines."""
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "LONG_WORDS", 2)
    doc, place, win, size = line_dedup.positions(line_dedup.Lines(pa.array(["a\nb b\nc c\nd d", "x\na\nb b"])), 2)
    assert sorted(zip(doc, place, size)) == [(0, 0, 2), (0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 0, 2), (1, 1, 2), (1, 2, 1)]
    assert len(set(win)) == 5


def test_line_dedup_winnowed_anchors():
    """One line of each window is an anchor, that with the least hash; positions in a matched run are not joined again."""
    import numpy as np
    import pyarrow as pa

    lines = line_dedup.Lines(pa.array(["\n".join(f"line {k}" for k in range(40)), "one", None, "p\nq"]))
    again = line_dedup.Lines.of(*lines.packed())
    assert (again.hash == lines.hash).all() and (again.words == lines.words).all() and again.doc.tolist() == lines.doc.tolist()
    doc, at = line_dedup.anchors(again, 4)
    want = {a + int(np.argmin(lines.hash[a:a + 4])) for a in range(37)}
    assert at.tolist() == sorted(want) and not doc.any() and len(want) < 30
    runs = [[[0, 39]], None, [], [[0, 1], [0, 2]]]
    doc, place, _, size = line_dedup.positions(again, 4)
    left = line_dedup.outside(again, runs, doc, place, size)
    assert list(zip(doc[left].tolist(), place[left].tolist())) == [(0, 39), (1, 0)]


def test_line_dedup_matches_are_extended(spark):
    """A passage is matched as one run, found by its anchors and extended both ways; nothing is lost beside it."""
    passage = [f"passage line {k}" for k in range(30)]
    docs = [(k, "\n".join([f"own {k}", *passage, f"end {k}"])) for k in range(4)]
    hashed = line_dedup._line_hashes(spark.createDataFrame([(i, b"t", t) for i, t in docs], "doc bigint, th binary, text string"))
    got = line_dedup.matched_runs(hashed).collect()
    covered = {i: set() for i, _ in docs}
    for r in got:
        assert r["size"] >= line_dedup.WINDOW
        covered[r["doc"]] |= set(range(r["place"], r["place"] + r["size"]))
    assert covered == {0: set(), **{k: set(range(1, 31)) for k in range(1, 4)}}
    assert len(got) < 3 * 30

    rng = random.Random(7)
    docs = [(k, "\n".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.choice((1, 2)) for _ in range(rng.randrange(12)))) for k in range(60)]
    docs.append((None, "a\nb\nunique\na\nb"))
    want = brute_lines(docs)
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5))
    got = got.selectExpr("doc_id", "text", "n_lines", "aggregate(deleted, 0L, (n, r) -> n + r.end - r.start) AS n", "clean_text").collect()
    assert len(got) == len(docs) and all((r[0], *r[2:]) == want[r[0], r[1]] for r in got)


# ------------------------------------------------------------------ decontamination

def brute_hits(docs, items, window=13):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find(lower(t or ""))
        for s in ([0] if 0 < len(w) < window else range(len(w) - window + 1)):
            windows[tuple(w[s:s + window])].add(i)
    sizes, out = {len(k) for k in windows}, []
    for i, t in docs:
        w = find(lower(t or ""))
        hit, names = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names |= {str(x) for x in windows[tuple(w[s:s + n])] if x is not None}
        out.append((i, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontaminate(spark, messy, empty, monkeypatch):
    names = ("doc_id", "n_words", "n_hit", "items", "contaminated")
    items = [(1, messy_texts()[5][1][:200]), (2, "Two-Words"), (3, None), (4, "... --"), (None, "a b c d E f"), (5, "beta3 beta4 beta5"),
             (5, "beta3 beta4 beta5"), (10, " ".join(f"long{k}" for k in range(30)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_hits(messy_texts(), items)
    got = decontaminate.decontaminate(messy, bench)
    assert rows(got, *names) == want
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)  # several blocks of the benchmark
    assert rows(decontaminate.decontaminate(messy, bench), *names) == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    none = decontaminate.decontaminate(messy, bench.limit(0))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(messy_texts())


def test_decontaminate_documents(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    want = brute_hits([tuple(r) for r in docs_of(spark).collect()], [tuple(r) for r in bench.collect()])
    got = decontaminate.decontaminate(docs_of(spark), bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == want
    assert any(r[4] for r in want)


# ------------------------------------------------------------------ byte-pair encoding

def test_bpe_equals_the_library(spark, messy, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    letters = "ab 's\n\t'tdélo12_-=<>|. é中😀\u0301\xa0\x1f\x85\u2003"
    texts = ["<|endoftext|>", "x<|endoftext|> y", "a" * 3000, "ab" * 700, " " * 90, "don't WE'LL 'll ½²٣", "\r\n\r\n\tx",
             *("".join(rng.choice(letters) for _ in range(60)) for _ in range(400)),
             *("".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(0x300, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)]))
                       for _ in range(30)) for _ in range(200))]
    table = messy.select("doc_id", "text", "lang").union(spark.createDataFrame(
        [(k, t, "") for k, t in enumerate(texts, 100)], "doc_id bigint, text string, lang string"))
    for r in bpe.encode_decode(table.withColumnRenamed("lang", "ids"), tokenizer_path()).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.encode_decode(empty, tokenizer_path()).count() == 0


def test_bpe_pairs_and_bounded_table(monkeypatch):
    """Greedy merging by rank, written out, agrees on glued tokens; clearing the piece table changes nothing."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    encoder = bpe.Encoder(vocabulary)
    byte = {t: i for i, t in enumerate(vocabulary.tokens) if len(t) == 1}
    ids = {t: i for i, t in enumerate(vocabulary.tokens)}

    def merge(data):
        out = [byte[data[k:k + 1]] for k in range(len(data))]
        while True:
            ranked = [(vocabulary.rank[p], k) for k, p in enumerate(zip(out, out[1:])) if p in vocabulary.rank]
            if not ranked:
                return tuple(out)
            k = min(ranked)[1]
            out[k:k + 2] = [ids[vocabulary.tokens[out[k]] + vocabulary.tokens[out[k + 1]]]]

    rng = random.Random(4)
    pieces = [b"".join(rng.choice(vocabulary.tokens[:50000]) for _ in range(rng.randrange(1, 6))) for _ in range(600)]
    assert [encoder.encode_piece(p) for p in pieces] == [merge(p) for p in pieces]
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    assert encoder.encode("one two three four five six") == bpe.Encoder(vocabulary).encode("one two three four five six")


# ------------------------------------------------------------------ personal data

def plain_base(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub(r"[^0-9]", "", m[0])]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans():
    rng = random.Random(6)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "256.1.1.1", "4539 1488 0343 6467", "4539-1488-0343-6467", "+1 (743) 555-3824", "+12", "9", ".",
              " ", "a", "+", "é", "@b.c.d.", "00012.3.4.5.6.7.8.9", "%", "-", "1111111111111117"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000) == []


def test_pii_tagger(spark, messy, empty):
    """Held-out accuracy of the tagger, forms the patterns lack, and base spans that stay."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    codes, tags = pii.training_windows(docs, "text")
    cut = len(codes) * 4 // 5
    tagger = pii.Tagger(1 + 2 * len(pii.KINDS))
    tagger.train(codes[:cut], tags[:cut], pii.TRAIN_STEPS)
    got = np.array(tagger.decode(list(tagger.emissions(codes[cut:]))))
    want = tags[cut:]
    assert (got == want)[want > 0].mean() > 0.9 and (got == want)[want == 0].mean() > 0.98
    text = "She wrote: mail bob.42 (at) mail3.example.com or call (743) 555-3824 now. " + "Plain words follow here. " * 20
    found = pii.all_spans(text, pii.base_spans(text), pii.tagged_spans(tagger, [text])[0])
    assert {text[a:b] for _, a, b in found} <= {"bob.42 (at) mail3.example.com", "(743) 555-3824"} and found
    table = messy.withColumnRenamed("kept", "base_spans").union(spark.createDataFrame(
        [(200, "é😀 a.b@c.de 1.2.3.4", "", 1, "", 1, 0.5, ["x"], False)], messy.schema))
    out = pii.find_pii(table).where("doc_id = 200").first()
    assert [(s["kind"], s["start"], s["end"]) for s in out["base_spans"]] == [("email", 3, 11), ("ip", 12, 19)]
    assert set(map(tuple, out["base_spans"])) <= set(map(tuple, out["spans"]))
    assert pii.find_pii(table).count() == len(messy_texts()) + 1
    assert pii.find_pii(empty).count() == 0


def test_tagger_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    tagger = pii.Tagger(3, 4, 5)
    codes, tags = rng.integers(0, 99, (2, 6)), rng.integers(0, 3, (2, 6))
    _, grads = tagger._loss(codes, tags)
    for name, value in tagger.p.items():
        at = (codes[0, 2], 1) if name == "E" else tuple(rng.integers(0, s) for s in value.shape)
        old = value[at]
        value[at] = old + 1e-5
        up = tagger._loss(codes, tags)[0]
        value[at] = old - 1e-5
        down = tagger._loss(codes, tags)[0]
        value[at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    tagger = pii.Tagger(3)
    for k in "Tse":
        tagger.p[k] = rng.normal(size=tagger.p[k].shape)
    seqs = [rng.normal(size=(n, 3)) for n in (1, 4, 2, 5)]
    for em, got in zip(seqs, tagger.decode(seqs)):
        value = lambda t: tagger.p["s"][t[0]] + tagger.p["e"][t[-1]] + sum(em[k, x] for k, x in enumerate(t)) + sum(
            tagger.p["T"][a, b] for a, b in zip(t, t[1:]))
        assert tuple(got) == max(itertools.product(range(3), repeat=len(em)), key=value)


# ------------------------------------------------------------------ toxicity

def test_block_max_neighbours_are_exact():
    import numpy as np

    rng = np.random.default_rng(2)
    counts = rng.poisson(0.15, (700, 40))
    w = toxicity.vectors(counts, rng.random(40) + 0.5)
    index = toxicity.BlockMaxIndex(w[:500], np.arange(500), rng.integers(0, 2, 500))
    who, best = index.search(w[500:])
    exact = np.sort(np.round((w[500:] @ w[:500].T).astype(np.float64), 5), 1)[:, ::-1][:, :toxicity.NEIGHBOURS]
    assert np.allclose(best, np.where(exact > 0, exact, 0), atol=2e-5)
    for q in range(200):
        for k, s in zip(who[q], best[q]):
            assert k < 0 or abs(float(w[500 + q] @ index.rows[k]) - s) < 2e-5


def test_block_max_neighbours_of_sparse_vectors(monkeypatch):
    """Many rare terms and some frequent ones, in small steps: the neighbours of the full product."""
    import numpy as np

    monkeypatch.setattr(toxicity, "POSTINGS", 500)
    rng = np.random.default_rng(3)
    counts = np.hstack([rng.poisson(0.3, (600, 20)), rng.poisson(0.004, (600, 2000))])
    w = toxicity.vectors(counts, rng.random(2020) * 3 + 0.5)
    index = toxicity.BlockMaxIndex(toxicity.Sparse.of(w[:450]), np.arange(450), np.zeros(450, np.int64))
    assert 0 < index.blocks.shape[2] <= 20 and len(index.example)
    who, best = index.search(toxicity.Sparse.of(w[450:]))
    exact = np.sort(w[450:] @ w[:450].T, 1)[:, ::-1][:, :toxicity.NEIGHBOURS]
    assert np.allclose(best, exact, atol=2e-5)
    own, sims = index.search(index.rows, skip=np.arange(index.size))
    assert not (own == np.arange(index.size)[:, None]).any() and (sims[:, 0] > 0).all()


def test_postings_are_example_numbers_with_runs_of_equal_values():
    """No weight for each posting: terms of counts 1 and 2 have two runs each, lengths divide the sums, also in what travels."""
    import pickle

    import numpy as np

    rng = np.random.default_rng(4)
    counts = toxicity.Sparse.of((rng.random((900, 300)) < 0.03) * rng.integers(1, 3, (900, 300)))
    raw, length = toxicity.weighted(counts, rng.random(300) * 3 + 0.5)
    index = toxicity.BlockMaxIndex(raw, np.arange(900), np.zeros(900, np.int64), length)
    assert index.example.itemsize == 2 and len(index.example) > 7000 and len(index.run_value) <= 600
    whole = raw.dense() / length[:, None]
    assert np.allclose(index.rows.dense(), whole[index.names[:index.size]], atol=1e-6)
    who, best = pickle.loads(pickle.dumps(index)).search(whole[:300], skip=np.argsort(index.names[:index.size])[:300])
    exact = whole[:300] @ whole.T
    exact[np.arange(300), np.arange(300)] = 0
    assert np.allclose(best, -np.sort(-exact, 1)[:, :toxicity.NEIGHBOURS], atol=2e-5)
    assert (np.abs(np.take_along_axis(exact, index.names[who], 1) - best) < 2e-5).all()


def test_toxicity_term_counts_of_repeated_words():
    """Words that repeat within and between texts count as if each was looked up by itself."""
    import collections

    import numpy as np
    import pyarrow as pa

    texts = pa.array(["Abcdefghij abcdefghij abcdxyz", None, "abcd " * 3 + "zzz", "", "abcdefghij 12 zzz zzz"])
    feature, doc, words = toxicity._features(texts)
    hashes = np.unique(feature)[::2]
    got = toxicity.Vocabulary(hashes, np.zeros(0, np.int64)).counts(texts)
    want = collections.Counter((int(d), int(f)) for f, d in zip(feature, doc) if f in hashes)
    assert {(int(r), int(hashes[t])): int(v) for r, t, v in zip(got.row, got.term, got.value)} == want
    assert (np.diff(got.row) >= 0).all() and words.tolist() == [3, 0, 4, 0, 4]


def test_toxicity_finds_rare_terms(spark):
    """A word in two of the examples only, and labelled words by the hundred: all are found, none is cut off."""
    insults = [f"insult{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(400)]
    ids = [i for i in range(3000) if i and zlib.crc32(str(i).encode()) % 3 != 1]
    other = [i for i in range(3000, 9000) if zlib.crc32(str(i).encode()) % 3 == 1][:400]
    pairs = [(i, insults[k // 2]) for k, i in enumerate(ids[:800])]
    plain = [(i, f"calm{i % 37}z peace{i % 11}q") for i in ids[800:1600]]
    docs = spark.createDataFrame([(i, f"some text {w}") for i, w in pairs + plain + list(zip(other, insults))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in pairs] + [(i, 0) for i, _ in plain], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels).where("doc_id >= 3000").select("doc_id", "predicted", "evidence").collect()
    twins = {w: {i for i, x in pairs if x == w} for w in insults}
    word = dict(zip(other, insults))
    assert len(got) == 400
    for r in got:
        assert r["predicted"] == 1 and {e["id"] for e in r["evidence"][:2]} == twins[word[r["doc_id"]]]


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels.select("doc_id", "toxic"))
    table = got.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    caught = [r["predicted"] for r in table if r["toxic"] == 1]
    false = [r["predicted"] for r in table if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(false) / len(false) < 0.02
    assert all(0 <= r["score"] <= 1 for r in table)


def test_toxicity_ignores_held_out_labels_and_ids(spark, messy, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    docs = docs_of(spark)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity._held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic"))
                                .otherwise(toxicity.F.col("toxic")))
    a, b = (rows(toxicity.score_toxicity(docs, x), "doc_id", "score") for x in (labels, flipped))
    assert a == b
    scored = toxicity.score_toxicity(messy, spark.createDataFrame([(5, 1), (5, 0), (9, None), (None, 1)], "doc_id bigint, toxic int"))
    assert scored.count() == len(messy_texts()) and scored.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert toxicity.score_toxicity(messy, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_evidence(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    for r in toxicity.score_toxicity(docs_of(spark), labels).select("evidence").collect():
        sims = [e["similarity"] for e in r[0]]
        assert sims == sorted(sims, reverse=True) and len(sims) <= toxicity.NEIGHBOURS
    assert json.dumps(sims) is not None
