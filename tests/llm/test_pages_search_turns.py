"""Page text, lexical search and conversation repair against brute force, and on hard inputs."""

import collections
import hashlib
import html
import math
import os
import random
import re
import time
import zlib

import pytest
from pyspark.sql import types as T

from sylvagrid.llm import html_text, lexical_search, queries, turn_repair

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


# 11: page text

def pages(spark, rows):
    fields = [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
              *(T.StructField(c, T.StringType()) for c in ("text", "n_chars", "own"))]
    return spark.createDataFrame([(i, None if i is None else f"http://x/{i}", h, "old", "old", "kept") for i, h in rows], T.StructType(fields)).repartition(3)


AROUND = [
    '<nav><ul><li><a href="/a">Menu</a><li><a href="/b">Other</a></ul></nav>', '<header><h1>The site</h1><p>claim</p></header>',
    '<div class="cookie-notice">We use cookies and much else, which takes a long sentence to say in full length.</div>',
    '<aside><p>Aside text that is rather long, as such things are, and goes on and on for a while.</p></aside>',
    '<div id="sidebar">Side</div>', '<form><label>Name</label><input><button>Send</button></form>', '<script>var t = "<p>not text</p>";</script>',
    '<style>p > a { color: red }</style>', '<section class="comments"><article class="comment"><p>What a page, and what a comment this is!</p></article></section>',
    '<div class="ad">Buy now</div>', '<footer>&copy; site</footer>', '<p class="ad">Ad<p class="advert">Advert', "<!-- <p>hidden</p> -->", '<div role="navigation">x</div>',
    "<noscript>No script</noscript>", '<div class="AdBanner"><div>deep</div></div>', '<ul class="share"><li>a<li>b</ul>']


def page(rng, article):
    """A page around an article, and its text."""
    blocks, text = [], []
    for b in article:
        words, shown = b.split(" "), []
        for w in words:
            w = html.escape(w).replace("é", rng.choice(["é", "&eacute;", "&#233;"]))
            shown.append(rng.choice([f"<b>{w}</b>", f"<a href='x'>{w}</a>", *[w] * 8]))
        inner = rng.choice([" ", "\n", "  ", "\t\n "]).join(shown)
        tag = rng.choice(["p", "p", "p", "h2", "li", "blockquote", "pre", "div"])
        blocks.append(f"<{tag}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"))
        text.append(" ".join(words))
    inside = "".join(blocks)
    if rng.random() < 0.5:
        at = rng.randint(0, len(blocks))
        inside = "".join(blocks[:at]) + '<div class="ad"><p>Inside ad that is long enough to look like text.</p></div>' + "".join(blocks[at:])
    around = rng.sample(AROUND, rng.randint(0, len(AROUND)))
    cut = rng.randint(0, len(around))
    frame = rng.choice(["<article>{}</article>", "<main class='has-sidebar'><div>{}</div></main>", "<article id='post-1'><section>{}</section></article>"])
    return ("<!DOCTYPE html><html><head><title>T &amp; t</title><meta charset=utf-8></head><body class='with-sidebar'>" + "".join(around[:cut])
            + frame.format(inside) + "".join(around[cut:]) + rng.choice(["</body></html>", ""]), "\n\n".join(text))


def article(rng):
    return [" ".join(rng.choice(["word", "é", "<x>", "&", "a", "longerword", "Be."]) for _ in range(rng.choice([1, 2, 40, 90]))) for _ in range(rng.randint(1, 9))]


def test_generated_pages_round_trip(spark):
    rng = random.Random(5)
    made = [page(rng, article(rng)) for _ in range(300)]
    out = html_text.extract(pages(spark, [(i, h) for i, (h, _) in enumerate(made)]))
    assert sorted(out.columns) == ["html", "n_chars", "own", "page_id", "text", "url"]
    for r in out.collect():
        assert r.text == made[r.page_id][1], made[r.page_id][0]
        assert r.n_chars == len(r.text) and r.own == "kept"


def test_pages_without_articles_by_ratio():
    menu = "".join(f'<div><a href="/{i}">Item {i}</a> <a href="/{i}">more</a></div>' for i in range(12))
    text = ["A sentence of the page's own text that is long enough to be one. " * 4, "Short.", "Another sentence, no shorter than the first one was, of this page. " * 4]
    got = html_text.main_text(f"<body>{menu}<div id='x'>" + "".join(f"<p>{t}</p>" for t in text) + f"</div><div>{menu}</div></body>")
    assert got == "\n\n".join(t.strip() for t in text)


def test_hard_pages(spark):
    one = "<article><p>Text</p></article>"
    rows = [(1, None), (2, ""), (3, "<<<"), (4, "plain &lt;b&gt; text"), (5, one + "<a hre"), (6, "<article><p>a<br>b<br/>c d</p></article>"),
            (7, one + "<!-- never closed <p>x</p>"), (8, one * 2), (None, one), (None, None), (9, one), (9, one), (10, "<![foo[x]]>" + one),
            (11, "<div class=ad>" * 3 + "</div>" * 3 + one), (12, "<article>" + "<p>w</p>" * 20000 + "</article>"), (13, "<script>x"), (14, "<p>&amp;amp; &#x41;</p>")]
    want = {1: "", 2: "", 3: "<<<", 4: "plain <b> text", 5: "Text", 6: "a b c d", 7: "Text", 8: "Text\n\nText", None: "", 9: "Text", 10: "Text", 11: "Text",
            12: "\n\n".join("w" * 20000), 13: "", 14: "&amp; A"}
    got = collections.defaultdict(list)
    for r in html_text.extract(pages(spark, rows)).collect():
        got[r.page_id].append(r.text)
    assert sorted(got.pop(None)) == ["", "Text"] and got.pop(9) == ["Text", "Text"]
    want.pop(None), want.pop(9)
    assert {i: t for i, (t,) in got.items()} == want
    assert html_text.extract(pages(spark, [])).count() == 0


def test_unclosed_markup_takes_linear_time():
    start = time.process_time()
    for piece in ("<a ", "<!--", '<a b="', "</", "<script>", "<?", "<![CDATA[", "<div class=ad><li>", "&amp", "<"):
        for end in ("", ">"):
            html_text.main_text(piece * 30_000 + end)
    assert time.process_time() - start < 20


@needs_data
def test_page_query_returns_the_articles(spark):
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    out = queries.op11_html_text(spark, SMALL).collect()
    assert len(out) == len(src)
    for r in out:
        inside = re.search(r"(?s)<article>(.*?)</article>", src[r.page_id]).group(1)
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 12: lexical search

def found_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=20):
    words = [(i, collections.Counter(found_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = collections.Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        wanted = collections.Counter(found_terms(text))
        scores = []
        for i, c in words:
            m = 75 + 25 * sum(c.values()) * n_docs // total if total else 0
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def texts(spark, rows, key):
    fields = [T.StructField(key, T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("ids", "score", "n", "item", "rank"))]
    return spark.createDataFrame([(i, t, *["own"] * 5) for i, t in rows], T.StructType(fields)).repartition(5)


def searched(out):
    return sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_search_equals_brute_force(spark, block):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdeßéñ9", k=rng.randint(1, 5))) for _ in range(80)]
    docs = [(i * 7 % 101, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 400]))).replace(" ", rng.choice([" ", "-", "\n", "_"]))) for i in range(100)]
    docs += [(1000 + i, docs[5][1].upper()) for i in range(60)]  # ties beyond the last place
    docs += [(7, None), (8, ""), (None, docs[5][1]), (None, None), (5000, docs[9][1]), (5000, docs[9][1]), (5001, "\0--"), (5002, "ab " * 50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(70)]
    items += [(100, None), (101, ""), (102, "never said"), (103, docs[5][1]), (None, vocabulary[3]), (104, "AB ab Ab " * 300)]
    got = lexical_search.search(texts(spark, docs, "doc_id"), texts(spark, items, "item_id"), block_bytes=block)
    assert searched(got) == sorted(brute_search(docs, items), key=repr)


def test_search_of_nothing(spark):
    some, none = [(1, "a b")], []
    for docs, items in ((some, none), (none, some), (none, none), (some, [(1, None)]), ([(1, None)], some)):
        out = lexical_search.search(texts(spark, docs, "doc_id"), texts(spark, items, "item_id"))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_tiles_stay_exact():
    """Weights so large that an item's partial sums would pass 2**53 in one tile."""
    block = lexical_search.Block([(1, b"a " * 9 + b"b c " * 3), (2, b"c"), (3, b" ".join(b"w%d" % i for i in range(5000)))])
    weight = [(1 << 53) // (4 * lexical_search.SCALE)] * len(block.vocabulary)
    sums = collections.Counter()
    for first, size, columns, triples in block.tiles(weight):
        assert len(columns) <= lexical_search.TERM_TILE
        partial = collections.Counter()
        for i, c, n in triples.tolist():
            partial[i] += n * weight[columns[c]] * lexical_search.SCALE
            sums[first + i, int(columns[c])] += n
        assert size == 3 and max(partial.values()) < lexical_search.EXACT
    assert sums == {(i, t): n for i, c in enumerate(block.counts) for t, n in c}


def test_ties_of_many_tiles_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOC_TILE", 16)
    docs = [(i, "same text") for i in random.Random(3).sample(range(10_000), 400)] + [(20_000, "other")]
    out = lexical_search.search(texts(spark, docs, "doc_id"), texts(spark, [(1, "text")], "item_id"))
    assert [r.doc_id for r in out.orderBy("rank").collect()] == sorted(i for i, t in docs if t == "same text")[:20]


# 13: conversation repair

STEPS = {0: "su", 1: "u", 2: "a", 3: "u"}
AFTER = {"s": 1, "u": 2, "a": 3}


def cheapest(codes):
    """(cost, least audit) by the states of the grammar alone, without targets."""
    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for p, (c, a) in list(ways.items()):
                for r in STEPS[p].replace("s", ""):
                    ways[AFTER[r]] = min(ways.get(AFTER[r], (1 << 60, "")), (c + 3, a + "I"))
        return ways
    ways = {0: (0, "")}
    for x in codes:
        nexts = {}
        for p, (c, a) in inserted(ways).items():
            options = [(p, c + 4, "D")]
            for r in STEPS[p] if x != "x" else "":
                cut = 3 * x.isupper()
                options += [(AFTER[r], c + cut, "K")] * (x.lower() == r) + [(AFTER[r], c + cut + 3, "R")] * (r != "s")
            for q, cost, op in options:
                nexts[q] = min(nexts.get(q, (1 << 60, "")), (cost, a + op))
        ways = nexts
    return min(v for q, v in inserted(ways).items() if q in (0, 3))


@pytest.mark.parametrize("seed", range(3))
def test_alignment_equals_brute_force(seed):
    rng = random.Random(seed)
    for n in range(22):
        for _ in range(12):
            codes = "".join(rng.choice("sSuuuuUaaaaAoOx") for _ in range(n))
            want = cheapest(codes)
            assert turn_repair.whole_repair(codes) == want, codes
            at, way = 0, turn_repair.IDENTITY
            while at < n:
                step = rng.randint(1, 9)
                way, at = turn_repair.joined(way, turn_repair.segment_table(codes[at:at + step])), at + step
            assert turn_repair.closed(way) == want, codes


def brute_repair(rows):
    out, by_conv = [], collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by_conv[conv] += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * ({0: 0, 3: 2}.get(fate, 1))
    for conv, rs in by_conv.items():
        rs.sort()
        seen, faults, codes = set(), collections.Counter(), ""
        for _, _, role, text in rs:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        cost, audit = cheapest(codes)
        kept, state, it = [], 0, iter(rs)
        for op in audit:
            role, text = (None, "") if op == "I" else next(it)[2:]
            if op != "D":
                c = role[0] if op == "K" else STEPS[state][-1]
                state = AFTER[c]
                kept.append((role if op == "K" else {"u": "user", "a": "assistant"}[c]) + ":" + text)
        turns = [t for known, t, _, _ in rs if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    fields = [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
              *(T.StructField(c, T.StringType()) for c in ("audit", "kind", "code", "same"))]
    return spark.createDataFrame([(*r, *["own"] * 4) for r in rows], T.StructType(fields)).repartition(4)


def talk(seed, convs=60):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "well", "é. \n", "  ", "Long " * 40 + ".", "😀"]
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["user", "assistant"][t % 2:] + ["assistant", "system", "tool", ""][:rng.randint(0, 4)] or ["user"])
            rows.append((c * 13, t * rng.choice([1, 1, 3]), role, rng.choice(said) + rng.choice(["", str(t) + "."])))
    return rows + [(None, 1, "user", "Hi."), (None, None, None, None), (7000, None, "user", "A."), (7000, None, "assistant", "B."), (7001, 4, None, None),
                   (7002, 1, "user", "Same."), (7002, 1, "user", "Same."), (7002, 9, "user", "Same."), (7003, 1, "user", "x" * 200_000 + ".")]


def test_repair_equals_brute_force(spark):
    rows = talk(1)
    assert any(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for c, t, _, _ in rows)
    got = sorted((tuple(r) for r in turn_repair.digest(conversations(spark, rows)).collect()), key=repr)
    assert got == brute_repair(rows)


def test_one_conversation_with_most_turns(spark, monkeypatch):
    """Its turns lie in several ranges and many segments."""
    rng = random.Random(6)
    rows = talk(2, 20) + [(500, t, "user" if t % 2 == 0 else "assistant", rng.choice(["Fine.", "open", f"No {t}."])) for t in range(700)]
    got = sorted((tuple(r) for r in turn_repair.digest(conversations(spark, rows)).collect()), key=repr)
    assert got == brute_repair(rows)


def test_repaired_turns_follow_the_grammar(spark):
    rows = turn_repair.damaged(conversations(spark, talk(3)).select("conv_id", "turn", "role", "text"))
    out = collections.defaultdict(list)
    for r in turn_repair.repaired_turns(rows).orderBy("conv_id", "position").collect():
        out[r.conv_id].append((r.position, r.role, r.text))
    found = {r.conv_id: r for r in turn_repair.audits(rows).collect()}
    assert set(out) <= set(found)
    for conv, turns in out.items():
        assert [p for p, _, _ in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in turns))
        assert len(turns) == len(found[conv].audit.replace("D", ""))


def test_repair_of_nothing(spark):
    assert turn_repair.digest(conversations(spark, [])).count() == 0
