"""Line dedup, decontamination, host rules and main text against plain loops."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from framewright.llm import decontaminate, host_rules, html_text, line_dedup

STRIP = " \t\n\x0b\f\r"


def ascii_lower(text):
    return text.encode().lower().decode()


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    hashed = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
    assert line_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def brute_lines(rows, min_chars=40, min_docs=5):
    ids, out = defaultdict(set), []
    key = lambda line: ascii_lower(line.strip(STRIP))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                ids[key(line)].add(i)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(ids[key(x)]) < min_docs or i == max(ids[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_bytes", [64 << 20, 1])
def test_line_dedup(spark, odd, pass_bytes, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    extra = [(i, f"Shared line number {i % 3} that is long enough to be dropped here\nown {i}") for i in range(100, 121)]
    both = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = line_dedup.drop_repeated_lines(both, keep=["doc_id"], digest=True, pass_bytes=pass_bytes)
    want = brute_lines(rows + extra)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(n for _, _, n, _ in want)


def test_line_dedup_keeps_columns(odd, empty):
    got = line_dedup.drop_repeated_lines(odd, prefix="_")
    assert [c for c in got.columns if not c.startswith("_")] == odd.columns and got.count() == odd.count()
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def brute_hits(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[p : p + window])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in grams:
                    hit |= set(range(p, p + k))
                    found |= {str(x) for x in grams[g] if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_words", [400_000, 5])
def test_decontamination(spark, odd, pass_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", pass_words)
    rng = np.random.default_rng(5)
    items = [(i, " ".join(rng.choice(list("abcde"), n))) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 30, 30])]
    items += [(3, "a b c d e a b c d e a b c d e"), (None, "one two"), (20, None), (21, "..."), (22, "Ten")]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + i, " ".join(rng.choice(list("abcdef"), 60))) for i in range(20)]
    rows += [(200, items[8][1] + " x " + items[6][1]), (201, "z " + items[7][1][2:] + " y")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, keep=["doc_id"])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_hits(rows, items)


def test_decontamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "three four five six seven eight nine ten")], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.find_contamination(odd.filter("doc_id = 6"), bench, cut=True).collect()}
    assert cut[6].startswith("one, TWO \n")
    assert decontaminate.find_contamination(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0
    clean = decontaminate.find_contamination(odd, bench, prefix="_")
    assert [c for c in clean.columns if not c.startswith("_")] == odd.columns


def test_host_rules(odd, empty):
    got = sorted((r.asDict() for r in host_rules.judge(odd).collect()), key=lambda r: repr((r["doc_id"], r["text"])))
    rows = sorted(odd.collect(), key=lambda r: repr((r["doc_id"], r["text"])))
    for g, r in zip(got, rows, strict=True):
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[p : p + 8]) for p in range(len(words) - 7))
        repeated = {q for p in range(len(words) - 7) if grams[tuple(words[p : p + 8])] > 1 for q in range(p, p + 8)}
        lines = [x for x in text.split("\n") if x.strip(STRIP)]
        assert (g["n_words"], g["word_chars"], g["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (g["n_dup_lines"], g["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        assert g["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert not (g["kept"] and g["base_failed"])
    assert host_rules.judge(empty).count() == 0


def test_host_verdict_reaches_clean_documents(spark):
    good = " ".join(f"word{i}" for i in range(50))
    rows = [(i, good if i % 10 == 0 or i >= 200 else "short", "bad" if i < 200 else "fine") for i in range(400)] + [(400, good, None)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r["doc_id"] for r in got.filter("kept").collect()}
    assert kept == set(range(200, 401))


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies, you know, a lot of them, really.</div>{}<footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(("body", "want"), [
    ("<article><h1>Title &amp; more</h1><p>One\n two<br>three<p>Four <b>bo</b>ld<ul><li>a<li>b</ul></article>", "Title & more\nOne two three\nFour bold\na\nb"),
    ("<article><p>Short.</p><section class=comments><p>A long, long, long comment, with many commas, by a reader.</p></section></article>", "Short."),
    ("<div><div id=main><p>Text, with commas, in the main box, of some length, which wins.</p><p>Second.</p></div><div class=sidebar><p>Ads, ads, ads</p></div></div>",
     "Text, with commas, in the main box, of some length, which wins.\nSecond."),
    ("<main><p>a<form><p>Your name</p></form><p>b<aside>c</aside></main>", "a\nb"),
    ("<p>Bare &lt;text&gt; here &#233;</p><div>x <a href=y>all of it linked text</a></div>", "Bare <text> here é"),
    ("", ""),
])
def test_main_text(body, want):
    assert html_text.main_text(PAGE.format(body)) == want


LINE = "A sentence, with commas, that is long enough to count as the text of a page, which it is. " * 4


@pytest.mark.parametrize(("body", "want"), [
    ('<div class="content has-sidebar"><article><p>Whole, whole text.</p></article></div>', "Whole, whole text."),
    ("<div class=sidebar><article><p>Whole, whole text.</p></article></div>", "Whole, whole text."),
    ("<article><p>One, two.</p><section id=related-work><p>Three, four.</p></section><h2 id=search>Five</h2><p id=alerts-and-limits>Six</p></article>",
     "One, two.\nThree, four.\nFive\nSix"),
    (f"<div class=related><p>{LINE}</p></div>", LINE.strip()),
    (f"<div><article><p>{LINE}</p></article><div><p>{LINE}</p><p>End.</p></div></div>", f"{LINE.strip()}\n{LINE.strip()}\nEnd."),
    ("<article><div><p>One, two, three.</p><p>Four.</p></div><div class=site-comments><p>Away, away.</p></div><div>Tail</div></article>", "One, two, three.\nFour.\nTail"),
])
def test_main_text_is_not_lost_by_names(body, want):
    assert html_text.main_text(PAGE.format(body)) == want


def test_extract_edges(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain, text"), (4, "u", "<p>a</p>" * 2), (4, "u", "<p>a</p>" * 2), (5, "u", deep), (6, "u", "<p>x" * 50_000), (7, "u", "<<>&am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as n_chars")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()), key=repr)
    assert got[:7] == [(1, "", 0), (2, "", 0), (3, "plain, text", 11), (4, "a\na", 3), (4, "a\na", 3), (5, "deep", 4), (6, "\n".join("x" * 50_000), 99_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_comments_and_notices_go_and_the_article_stays():
    from framewright.llm.html_text import main_text

    para = lambda n, k=1: f"<p>{' '.join(f'word{n}, and more text' for _ in range(6 * k))}.</p>"
    plain = lambda *parts: "\n".join(" ".join(x.removeprefix("<p>").removesuffix("</p>").split()) for x in parts)
    article = para("a") + para("b")
    loud = "".join(para(f"c{n}", 4) for n in range(3))
    for box in ('div class="comments"', 'section class="comments"', 'div class="user-comments"', 'section class="post-comments"', 'div id="comment-list"', 'ol class="commentlist"',
                'div class="cookie-notice"', 'div id="gdpr-popup"'):
        tag = box.split()[0]
        got = main_text(f'<body><div id="content">{article}</div><{box}>{loud}</{tag}></body>')
        assert got == plain(para("a"), para("b")), box
    each = "".join(f'<article class="comment">{para(n, 4)}</article>' for n in range(3))
    assert main_text(f'<div class="post">{article}</div><section class="comments">{each}</section>') == plain(para("a"), para("b"))
    each = each.replace(' class="comment"', "")
    assert main_text(f'<div class="post">{article}</div><section id="comments">{each}</section>') == plain(para("a"), para("b"))
    # Names of wrappers drop no article, and one that only speaks of comments is no comment.
    for name in ("has-comments", "with-sidebar", "no-comments", "sidebar", "content has-sidebar"):
        assert main_text(f'<div class="{name}"><article>{article}</article></div>') == plain(para("a"), para("b")), name
    assert main_text(f'<div class="sidebar">{article}{loud}</div>').startswith(plain(para("a"), para("b")))
    assert main_text(f'<article class="post">{article}<div class="comments"><article class="comment">{para("x", 4)}</article></div></article>') == plain(para("a"), para("b"))
