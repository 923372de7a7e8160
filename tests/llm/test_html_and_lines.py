import math
import os
import random
import re
import time

import pytest

from batchloom.llm import line_dedup
from batchloom.llm.html_text import copies, lines, main_text, shared
from batchloom.llm.line_dedup import drop_repeated_lines, removals


def stored(spark, tmp_path, rows, schema, name="t", parts=3):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(parts).write.parquet(path)
    return spark.read.parquet(path)


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


def test_common_subsequences_by_force():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        kept = [a[i] for i in shared(a, b)]
        rest = iter(b)
        assert all(x in rest for x in kept) and len(kept) == longest(a, b)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>menu</a></nav><!-- <p>c</p> -->
      <div class="ad">buy</div><article><h1>A &amp; B&nbsp;c</h1><p>one
      two <b>bold<br>x</b></p><div class="comments"><p>reader</p></div><form><p>f</p></form><p>last &lt;3</article><footer>&copy; me</footer>"""
    assert [t for t, s in lines(page) if s == "main"] == ["A & B c", "one two bold x", "last <3"]
    assert lines(None) == lines("") == [] and lines("a < b<") == [("a < b<", "open")]
    assert lines("<p>" * 50_000 + "x")[0][0] == "x"


@pytest.mark.parametrize("inside, want", [
    ('<ul><li class="promo">Buy<li>Real item</ul>', ["Real item"]),
    ('<p class="ad">Buy<div>Body text</div>', ["Body text"]),
    ('<dl><dt class="ad">x<dd>y</dl><table><tr><td class="ad">a<td>b<tr><td>c</table>', ["y", "b", "c"]),
    ('<p>a<span class="ad">buy</span>b</p><p>x <button>Go</button> y</p>', ["ab", "x y"]),
    ('<div class="related-work">w</div><p id="search">s</p><p class="share-price">p</p><p class="alert">a</p>', ["w", "s", "p", "a"]),
    ('<div class="related-posts">w</div><p class="cookie-banner">s</p><p class="ad-slot-3">p</p><div id="comments"><p>a</div><div class="share-buttons">q</div>z', ["z"]),
    ("<svg>no end <p>kept</p>", ["no end", "kept"]),
    ("<script>if (a < b) x();</script ><p>kept<noscript>no</noscript></p>", ["kept"]),
    ("<b>x</i></b> y</u><p>z</b> w", ["x y", "z w"]),
    ('<p hidden>x</p><p aria-hidden="true">y</p><p>caf&eacute; &#233;&#x2014;&nbsp;.</p>', ["café é— ."]),
])
def test_what_stands_in_an_article(inside, want):
    assert [t for t, s in lines(f"<nav>n</nav><article>{inside}</article><p>out</p>") if s == "main"] == want


def test_markup_takes_linear_time():
    for page in ("<b>" * 40_000 + "</i>" * 40_000, "<svg>" * 40_000, "<li>" * 40_000, "<p><b>" * 40_000 + "</div>" * 40_000, "<div class='a'>" * 40_000 + "x"):
        began = time.monotonic()
        lines(page)
        assert time.monotonic() - began < 5


PAGES = "page_id long, url string, html string, row string, host string"


def test_neighbours_decide_what_no_markup_tells(spark, tmp_path):
    page = lambda k: f"<body><p>Welcome to our site</p><p>story number {k}</p><p>All rights reserved</p></body>"
    rows = [(k, f"http://h.org/{k:03}", page(k), "x", "y") for k in range(60)] + [(100, "http://alone.org/", page(100), "x", "y"), (101, None, None, "x", "y"), (102, "odd", "", "x", "y")]
    rows += [(200, "http://z.org/a", "<article><p>same</p></article>", "x", "y"), (201, "http://z.org/b", "<article><p>same</p></article><p>same</p>", "x", "y")]
    found = {r.page_id: r.text for r in main_text(stored(spark, tmp_path, rows, PAGES)).collect()}
    assert len(found) == len(rows) and all(found[k] == f"story number {k}" for k in range(60))
    assert found[100].split("\n")[0] == "Welcome to our site" and found[101] == found[102] == ""
    assert found[200] == found[201] == "same"
    assert main_text(stored(spark, tmp_path, [], PAGES, "none")).count() == 0


@pytest.fixture
def split_in(spark):
    """Sets the number of parts that a shuffle has."""
    values = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def split(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield split
    for k, v in values.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_copies_are_no_neighbours(spark, split_in, tmp_path, parts):
    """Repeated rows, query strings and copies at paths next to each other, equal or almost so, over the parts of the sort."""
    body = lambda k: "".join(f"<p>paragraph {n} of the long story number {k}</p>" for n in range(9))
    page = lambda k, more="": f"<body><p>Welcome to our site</p>{body(k)}<p>All rights reserved</p>{more}</body>"
    story = lambda k, more="": "\n".join(f"paragraph {n} of the long story number {k}" for n in range(9)) + more
    rows, want = [], {}

    def add(url, html, text):
        rows.append((len(rows), url, html, "x", "y"))
        want[len(rows) - 1] = text

    for k in range(30):
        add(f"http://r.org/a{k // 10}", page(k // 10), story(k // 10))  # three stories of ten equal rows each
    for k in range(40):
        add(f"http://q.org/b?session={k}", page(7), story(7))
    add("http://q.org/c", page(8), story(8))
    for k in range(40):
        add(f"http://n.org/d{k:02}", page(9, f"<p>seen {k}</p>"), story(9, f"\nseen {k}"))
    add("http://n.org/e", page(10), story(10))
    whole = "\n".join(["Welcome to our site", story(11), "All rights reserved"])
    for k in range(20):
        add(f"http://only.org/{k}", page(11), whole)
    split_in(parts)
    found = {r.page_id: r.text for r in main_text(stored(spark, tmp_path, rows, PAGES, parts=parts)).collect()}
    assert found == want


def texts_by_force(rows):
    """Main texts by a plain walk over all pages in one list; rows are (page_id, url, html)."""
    found = {}
    for number, (_, url, html) in enumerate(rows):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        outline = lines(html)
        has_main = any(s == "main" for _, s in outline)
        page = {"path": path, "hashes": [t for t, _ in outline], "open": [] if has_main else [i for i, (_, s) in enumerate(outline) if s == "open"], "sizes": [0 if s == "furniture" else len(t) for t, s in outline]}
        found.setdefault((host, repr((page["hashes"], page["open"], page["sizes"]))), []).append((path, number, page, outline, has_main))
    firsts = sorted((host, *min(same, key=lambda x: x[:2])[:2], digest) for (host, digest), same in found.items())
    runs = []
    for host, _, _, digest in firsts:
        page = min(found[host, digest], key=lambda x: x[:2])[2]
        if not runs or runs[-1][0] != host or not copies(page, runs[-1][1]):
            runs.append((host, page, []))
        runs[-1][2].append((digest, page))
    texts = {}
    for k, (host, _, members) in enumerate(runs):
        beside = [runs[j][1] if 0 <= j < len(runs) and runs[j][0] == host else None for j in (k - 1, k + 1)]
        for digest, page in members:
            own = page["path"].split("/")
            alike = [-1 if b is None else len(os.path.commonprefix([own, b["path"].split("/")])) for b in beside]
            other = beside[1] if alike[1] > alike[0] else beside[0]
            gone = set() if other is None or copies(page, other) else set(shared(page["hashes"], other["hashes"])) & set(page["open"])
            for _, number, _, outline, has_main in found[host, digest]:
                texts[rows[number][0]] = "\n".join(t for i, (t, s) in enumerate(outline) if s == "main" or s == "open" and not has_main and i not in gone)
    return texts


@pytest.mark.parametrize("parts", [1, 13])
def test_texts_by_force(spark, split_in, tmp_path, parts):
    """Random pages, most without marks, that share lines with others of their host or are copies of them."""
    rng = random.Random(parts)
    rows, bodies = [], []
    for k in range(220):
        body = [f"<p>line {rng.randrange(40)}{' of some length' * rng.randrange(4)}</p>" for _ in range(rng.randrange(12))]
        if bodies and rng.random() < 0.4:
            body = list(rng.choice(bodies))
            if body and rng.random() < 0.5:
                body[rng.randrange(len(body))] = f"<p>seen {k}</p>"
        bodies.append(body)
        html = "<p>Welcome</p>" + "".join(body) + "<div>All rights reserved</div><footer>f</footer>"
        if rng.random() < 0.1:
            html = f"<article>{html}</article>"
        url = "/".join([f"http://h{rng.randrange(4)}.org", *(rng.choice("abc") for _ in range(rng.randrange(4)))]) + rng.choice(["", "?q=1"])
        rows.append((k, rng.choice([url] * 20 + [None, "odd"]), rng.choice([html] * 20 + [None, ""])))
    split_in(parts)
    pages = stored(spark, tmp_path, [(*r, "x", "y") for r in rows], PAGES, parts=1)
    found = {r.page_id: r.text for r in main_text(pages).collect()}
    assert found == texts_by_force(rows)
    plain = {i: "\n".join(t for t, s in lines(h) if s == "open") for i, _, h in rows if h and "<article>" not in h}
    assert sum(found[i] != t for i, t in plain.items()) > 100  # differencing decided


DOCS = "doc_id long, text string, row string, line string, removed string"


def removed_by_force(rows):
    seen, out = [], []
    for i, (_, text) in enumerate(rows):
        gone = []
        for k, line in enumerate((text or "").encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if s:
                if any(4 * len(s & t) >= 3 * len(s | t) for t in seen):
                    gone.append(k)
                seen.append(s)
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [1 << 15, 8])
def test_similar_lines_by_force(spark, tmp_path, monkeypatch, hot):
    """With a low HOT the lines of most words are compared in cells."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "CELL", max(4, hot // 2))
    monkeypatch.setattr(line_dedup, "NEAR", 24 if hot > 8 else 2)
    monkeypatch.setattr(line_dedup, "DENSE", 5)
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", 900)
    monkeypatch.setattr(line_dedup, "BUCKET_CHARS", 5000)
    rng = random.Random(6)
    pool = ["a b c d e f g h", "A  b c d e f g i", "the", "The end", "x y z", "x y z w", *(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))) for _ in range(60))]

    def edited(line):
        words = line.split()
        words[rng.randrange(len(words))] = f"n{rng.randrange(1000)}"
        return " ".join(words)

    texts = ["\n".join(edited(rng.choice(pool)) if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "\n \n"), (3, texts[3]), (None, "q " * 5000 + "\n" + "é é é")]
    docs = stored(spark, tmp_path, [(i, t, "r", "l", "m") for i, t in rows], DOCS, parts=1)
    found = removals(docs).orderBy("row").collect()
    assert [r.removed for r in found] == removed_by_force(rows)
    assert [r.n_lines for r in found] == [0 if t is None else t.count("\n") + 1 for _, t in rows]
    cleaned = drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert math.isclose(sum((t or "").count("\n") + (t is not None) for _, t in rows) - sum(len(r.removed) for r in found), sum(len(r.text.split("\n")) if r.text else int(r.text == "" and (r.doc_id == 901)) for r in cleaned.collect()), abs_tol=len(rows))


def test_lines_empty_table(spark, tmp_path):
    assert removals(stored(spark, tmp_path, [], DOCS)).count() == 0


@pytest.mark.parametrize("wide", [512, 8])
def test_lines_just_below_the_threshold_make_no_row_for_each_pair(spark, tmp_path, monkeypatch, wide):
    """Lines that share 20 of 24 words match none but the last, which is one of them but for a word."""
    monkeypatch.setattr(line_dedup, "WIDE", wide, raising=False)
    monkeypatch.setattr(line_dedup, "DENSE", 7)
    shared = " ".join(f"s{k}" for k in range(20))
    texts = [f"{shared} " + " ".join(f"n{i}x{k}" for k in range(4)) for i in range(80)]
    filler = "\n".join(f"n{i}x{k} " * 100 for i in range(80) for k in range(4))  # what tells the lines apart is more used than what they share
    rows = list(enumerate([*texts, texts[0].replace("s7", "other"), filler]))
    asked, verified = [], line_dedup._verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    found = removals(stored(spark, tmp_path, [(i, t, "r", "l", "m") for i, t in rows], DOCS, parts=1)).orderBy("row").collect()
    assert [r.removed for r in found] == removed_by_force(rows) == [[]] * 80 + [[0], []]
    assert wide == 8 or sum(asked) < 10 * len(rows)
