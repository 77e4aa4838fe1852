"""The text operators against brute force, and on hard inputs."""

import base64
import collections
import hashlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from sylvagrid.llm import (common, components, decontam, jaccard_join, line_clean, packing, queries, sharding, substring_dedup,
                           suffix_dedup, toxicity, url_rules, warc)

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
# Column names that operators use inside, or return.
CLASHES = ["_k", "_b", "_t", "_doc", "score", "predicted", "n_words", "open", "ids", "task", "cls", "_text", "_spans", "shard", "curve", "kept"]


def frame(spark, rows, extra=True):
    """documents with null metadata, and columns whose names operators use inside."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
              T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in CLASHES] if extra else []
    data = [(i, t, None if n % 3 else "en", None if n % 2 else "src0", None if t is None else len(t),
             *([f"own{n}"] * len(CLASHES) if extra else [])) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType(fields)).repartition(3)


def corpus(seed, docs=24, words=400):
    """Texts with shared passages, copies, repeats, odd characters, and the hard cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeßéñ€", k=rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choices(vocabulary, k=70)) for _ in range(4)]
    out = []
    for i in range(docs):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, words // 4)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 20):len(p) - rng.randint(0, 20)], " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))]
        out.append((i * 3, rng.choice([" ", "\n", "  \t"]).join(parts)))
    out += [(200, out[3][1]), (201, out[3][1]), (202, None), (203, ""), (204, " \n "), (205, "x"), (None, passages[0]), (None, None),
            (206, passages[1] * 3), (206, passages[1] * 3), (207, "ab" * 3000), (208, "\0" * 120 + "<|endoftext|>"), (-5, passages[2])]
    return out


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def order_of(i):
    return 2**63 - 1 if i is None else i


# 1 and 5: repeats

def brute_repeats(rows, units, least):
    """Kept units of each row: windows that a smaller document holds are gone."""
    first = {}
    cut = [units(t) for _, t in rows]
    for (i, _), u in zip(rows, cut):
        for p in range(len(u) - least + 1):
            w = tuple(u[p:p + least])
            first[w] = min(first.get(w, order_of(i)), order_of(i))
    out = []
    for (i, _), u in zip(rows, cut):
        gone = [False] * len(u)
        for p in range(len(u) - least + 1):
            if first[tuple(u[p:p + least])] < order_of(i):
                gone[p:p + least] = [True] * least
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((len(u), sum(gone), runs, [x for x, g in zip(u, gone) if not g]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    want = sorted(((i, n, gone, runs, hashlib.sha256(bytes(kept)).hexdigest()) for (i, _), (n, gone, runs, kept) in
                   zip(rows, brute_repeats(rows, lambda t: (t or "").encode(), 50))), key=repr)
    assert collected(suffix_dedup.digest(frame(spark, rows))) == want


def test_suffix_dedup_with_hot_anchors_and_small_buckets(spark):
    rows = corpus(5)
    def finish(text, found):
        a, b = suffix_dedup.spans_of(text, found, 50)
        return int((b - a).sum()), hashlib.sha256(suffix_dedup.without(text, a, b)).hexdigest()
    import pyarrow as pa

    from sylvagrid.llm.repeats import remove_repeats
    got = [collected(remove_repeats(frame(spark, rows), suffix_dedup.ByteRule(), finish, {"gone": pa.int64(), "sha": pa.string()},
                                    ["doc_id"], bucket_bytes=b, hot=h)) for b, h in ((1 << 20, 5000), (2000, 2))]
    assert got[0] == got[1]


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_rows_with_a_hot_passage_do_not_meet_in_one_task(spark, unit):
    import pyarrow as pa

    from sylvagrid.llm.repeats import remove_repeats
    rng, limit = random.Random(7), 40
    passage, other = (" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n)) for n in (60, 55))
    def own():
        return " ".join("".join(rng.choices("klmnopqrst", k=5)) for _ in range(rng.randint(0, 30)))
    rows = [(i, f"{own()} {passage if i % 3 == 0 else other if i % 3 == 1 else own()} {own()}") for i in range(200)]
    rows += [(3, passage[2:]), (None, passage), (500, rows[9][1]), (501, rows[9][1])]
    rule = suffix_dedup.ByteRule if unit == "bytes" else substring_dedup.WordRule

    class Bounded(rule):
        def match(self, text, sizes, docs):
            assert len(sizes) <= limit
            return super().match(text, sizes, docs)

    def finish(text, found):
        units = text if unit == "bytes" else text.split()
        a, b = suffix_dedup.spans_of(units, found, 50)
        return int((b - a).sum()), hashlib.sha256(repr([list(units[x:y]) for x, y in zip(a, b)]).encode()).hexdigest()
    docs = frame(spark, rows)
    added = {"gone": pa.int64(), "sha": pa.string()}
    got = [collected(remove_repeats(docs, r(), finish, added, ["doc_id"], bucket_bytes=2000, hot=h)) for r, h in ((rule, 10**6), (Bounded, 10))]
    assert got[0] == got[1]
    want = brute_repeats(rows, (lambda t: t.encode()) if unit == "bytes" else str.split, 50)
    assert sorted(((i, g) for i, g, _ in got[1]), key=repr) == sorted(((i, w[1]) for (i, _), w in zip(rows, want)), key=repr)


def test_dedup_keeps_columns_and_valid_text(spark):
    rows = corpus(3)
    docs = frame(spark, rows)
    out = suffix_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert {r._k for r in out.collect()} <= {r._k for r in docs.collect()}
    kept = {(i, t) for i, t in out.select("doc_id", "text").collect()}
    assert (0, rows[0][1]) in kept or len(rows[0][1]) >= 50
    assert all("�" not in (t or "") for _, t in kept)


def test_run_index_streams_exact_classes():
    rng = random.Random(4)
    text = bytes(rng.choices(b"ab", k=600)) + b"abab" * 40
    symbols = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    index = suffix_dedup.RunIndex(np.concatenate([symbols, [0]]).astype(np.int16), 12)
    classes = {}
    for step, lanes, found in index.stream(np.array([len(text) - 12]), np.array([len(text) - 11])):
        classes.setdefault(int(found[0]), set()).add(text[len(text) - 12 - step:len(text) - step])
    assert all(len(v) == 1 for v in classes.values())
    assert len(classes) == len({text[i:i + 12] for i in range(len(text) - 11)})
    assert len(index.symbol) < len(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    want = sorted(((i, n, gone, b" ".join(kept).decode()) for (i, _), (n, gone, _, kept) in
                   zip(rows, brute_repeats(rows, lambda t: (t or "").encode().split(), 50))), key=repr)
    assert collected(substring_dedup.remove_long_matches(frame(spark, rows))) == want


@pytest.mark.parametrize("period", [3, 7, 13, 31])
def test_difference_cover(period):
    cover = set(substring_dedup.difference_cover(period))
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


# 2: packing

@pytest.mark.parametrize("window,keep", [(64, 4), (2048, 32)])
def test_packing(spark, window, keep):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(n, x) for n, (_, x) in enumerate(corpus(6))] + [(900, "a  b   c\n\n d\t e \n"), (901, "x<|endoftext|> y  <|endoftext|>")]
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    docs = frame(spark, rows).repartition(5)
    got = packing.pack(docs, packing.public_encoder(), window=window, open_windows=keep, fan=2).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        cut = ids[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length == len(cut) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for held, total in [*((pieces[i], len(v)) for i, v in ids.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at <= window if total is None else at == total
    short = [s for s in (sum(n for _, n in v) for v in sequences.values()) if s <= window - packing.LEAST_PIECE]
    assert len(short) <= 1


@pytest.mark.parametrize("text", ["x \u00a0 \u00a0 \u00a0 y", "x\u00a0 y \u00a0z", "a \u3000 b", "a\t b \t c", "a \n b", "a \u2003 \u2003 b", " \u00a0 \u00a0", "a\u200b b"])
def test_token_ids_of_mixed_white_space(text):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.public_encoder()()
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_one_very_long_text_is_cut_in_linear_time():
    """Eight million tokens of one document, at any offset of the open windows."""
    start = time.process_time()
    packer = packing.Packer(2048, 8, 64, 0)
    packer.add(1, 0, bytes(4 * 1000), 1000)
    packer.add(2, 0, np.arange(8_000_000, dtype="<u4").tobytes(), 8_000_000)
    packer.flush()
    assert time.process_time() - start < 3
    pieces = sorted((r[1], r[2], r[3]) for r in packer.done if r[0] == 2)
    at = 0
    for begin, length, crc in pieces:
        assert begin == at and crc == zlib.crc32(np.arange(at, at + length, dtype="<u4").tobytes())
        at += length
    assert at == 8_000_000


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, []), packing.public_encoder()).count() == 0


# 3: toxicity

def toxic_corpus(n=700):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abdefghilmnoprstuw", k=rng.randint(2, 7))) for _ in range(300)] + ["the", "stop", "list", "tid"]
    bad = ["idiot", "stupid", "loser"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=40)
        toxic = i % 4 == 0
        if toxic:
            words[rng.randint(0, 39)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_is_learned_and_deobfuscated(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    disguised = ["you 1d10t", "so $tup1d", "what a l0ser", "s t u p i d", "i.d.i.o.t", "stuuuupid", "nice l o s e r here"]
    clean = ["the list 42 of 2 b2b", "", None, "a b c", "###", "0123 4567", "x" * 200_000]
    extra = [(10_000 + i, t) for i, t in enumerate(disguised + clean)]
    docs = frame(spark, rows + extra)
    out = {r.doc_id: r for r in toxicity.score(docs, lab).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(out[i].predicted == t for i, _, t in labels)
    assert all(out[10_000 + i].predicted == 1 for i in range(len(disguised)))
    assert all(out[10_000 + len(disguised) + i].predicted == 0 for i in range(len(clean)))
    kept = toxicity.reject_toxic(docs, lab)
    assert kept.columns == docs.columns
    assert kept.count() == len(docs.collect()) - sum(r.predicted for r in out.values())
    assert toxicity.score(docs, lab.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_of_doubled_and_split_words(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    forms = ["stuupid", "looser", "sstupid", "i d i o t", "i  d  i  o  t", "stu pid", "stu.pid", "i/d/i/o/t", "id iot", "s tupid"]
    words = [w for _, t in rows[1:60:4] for w in t.split() if w not in ("idiot", "stupid", "loser")]
    disguised = [f"{words[5 * i]} {words[5 * i + 1]} {x} {words[5 * i + 2]}" for i, x in enumerate(forms)] + forms
    clean = [" ".join(words[i:i + 12]) for i in range(0, 480, 12)]
    docs = frame(spark, rows + [(10_000 + i, t) for i, t in enumerate(disguised + clean)])
    out = {r.doc_id: r.predicted for r in toxicity.score(docs, lab).collect()}
    assert [t for i, t in enumerate(disguised) if not out[10_000 + i]] == []
    assert not any(out[10_000 + len(disguised) + i] for i in range(len(clean)))
    assert all(out[i] == t for i, _, t in labels)


def all_readings(decoder, text, letters):
    """Second readings of every word and of every run of words of up to so many letters."""
    text, out = decoder.replaced(text.lower()), set()
    parts = [m.span() for m in toxicity.PART.finditer(text)]
    for i, (a, _) in enumerate(parts):
        for j in range(i, min(i + letters, len(parts))):
            if j > i and not toxicity.GAP.match(text, parts[j - 1][1]):
                break
            out.add(decoder.decode(text[a:parts[j][1]], j > i))
    return out


def test_no_reading_is_lost_by_looking_at_features_only(spark):
    rows, _ = toxic_corpus(200)
    bad = ["idiot", "stupid", "loser", "stoopid"]
    targets = frozenset(toxicity.target(w[:n].encode()) for w in bad for n in (4, 5, 6, 7))
    model = toxicity.language_model(toxicity.count_trigrams(frame(spark, rows)))
    decoder, rng = toxicity.Decoder(model, targets), random.Random(2)
    found = 0
    for _, text in rows[:60]:
        words = text.split()[:12]
        for _ in range(3):
            w, k = rng.choice(bad), rng.randint(1, 3)
            words.insert(rng.randint(0, 12), rng.choice([w[:k] + rng.choice([" ", ".", " - ", "/"]) + w[k:], w[:k] + w[k - 1] + w[k:], w[:k] + " " + w[k] + w[k:]]))
        text = " ".join(words)

        def hits(lines):
            return {w[:n] for line in lines for w in re.findall("[a-z]+", line) for b in bad for n in (4, 5, 6) if w[:n] == b[:n]}
        mine, brute = hits(decoder.restored([text])[0].split("\n")), hits({decoder.replaced(text)} | all_readings(decoder, text, 12))
        assert mine == brute
        found += len(mine)
    assert found > 100


def test_long_text_of_short_words(spark):
    model = np.log(np.full((toxicity.SYMBOLS,) * 3, 1 / toxicity.SYMBOLS, np.float32))
    decoder = toxicity.Decoder(model, frozenset(toxicity.target(w) for w in (b"idio", b"stup", b"stupid")))
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abdiostupu", k=rng.randint(1, 3))) for _ in range(100_000))
    start = time.process_time()
    got = decoder.restored([text + " stu pid", "s tupid"])[0]
    assert time.process_time() - start < 5
    assert len(decoder.memo) <= toxicity.MEMO and max(map(len, (w for w, _ in decoder.memo)), default=0) <= toxicity.MEMO_LETTERS
    assert "stupid" in got.split("\n")


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows, labels = toxic_corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = frame(spark, rows)
    got = [collected(toxicity.score(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).select("doc_id", "score"))
           for x in (labels, flipped)]
    assert got[0] == got[1]


def test_trigrams_count_every_row(spark):
    rows = [(1, "abc"), (2, None), (3, "abc abc"), (4, "ABC")]
    counts = toxicity.count_trigrams(frame(spark, rows))
    assert counts[1, 2, 3] == 4 and counts[2, 3, 0] == 4


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    good = sum((r.predicted == 1) == (r.toxic == 1) for r in out)
    assert good / len(out) > 0.93


# 4: decontamination

def brute_windows(rows, items, width=10):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for p in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[p:p + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for window, ids in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p:p + len(window)]) == window:
                    hit.update(range(p, p + len(window)))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    rows = corpus(8)
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[0].split()[:15]).upper()), (2, texts[5][40:200]), (30, "x"), (4, None), (5, "  "), (6, "no such words here"),
             (1, "x"), (None, "a"), (7, " ".join(texts[9].split()[-12:]) + "!")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.digest(decontam.find_windows(frame(spark, rows), benchmark, block_bytes=block_bytes))
    assert collected(got) == brute_windows(rows, items)


def test_decontaminated_texts(spark):
    leak = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "Before, " + leak + " - and a good many other words after it, more than were hit"), (2, leak), (3, "clean text\nstays"), (4, None), (5, "")]
    docs = frame(spark, rows)
    benchmark = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    out = decontam.decontaminate(docs, benchmark)
    assert out.columns == docs.columns
    assert {r._spans for r in out.collect()} == {"own0", "own2", "own3", "own4"}
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: "Before,  - and a good many other words after it, more than were hit", 3: "clean text\nstays", 4: None, 5: ""}
    assert collected(decontam.decontaminate(docs, benchmark.limit(0)).select("doc_id", "text")) == sorted(rows, key=repr)


# 6: URLs

def test_given_rules(spark):
    urls = ["https://a.com/x", "http://com/", "http://com", "http://example.com/en/a", "http://m.example.com/en/", "http://www.example.com/en/",
            "http://WWW.EXAMPLE.COM/en/?q", "http://x.net/es/1", "http://x.net/fr/1#a/b", "http://net/de/", "ftp://examplecom/en/", "no scheme",
            None, "", "http://notexample.com/en/", "http://x.net?/es/", "://net/es/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", url_rules.host_of(F.coalesce("url", F.lit(""))).alias("host"), url_rules.path_of(F.coalesce("url", F.lit(""))).alias("path"))
    name, verdict = url_rules.given_rule(F.col("host"), F.col("path"))
    for r in df.withColumns({"rule": name, "verdict": verdict}).collect():
        u = r.url or ""
        rest = u.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        assert r.path == re.match(r"[^?#]*", rest[len(host):])[0] and r.host == host.lower()
        fits = [(h + p, v) for h, p, v in url_rules.HOST_RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_mined_rules_by_brute_force(spark):
    rng = random.Random(3)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['a', 'b', 'spam'])}.{rng.choice(['org', 'net'])}/{rng.choice(['en', 'de', 'win'])}/{n}"
            + rng.choice(["", ".html", "?ref=1"]) for n in range(150)]
    label = ["block" if "spam" in u and "win" in u or rng.random() < 0.1 else "allow" for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, label)), "url string, label string")
    pages = spark.createDataFrame(list(enumerate(urls)) + [(500, None), (501, urls[0]), (None, urls[1])], "page_id bigint, url string")
    limits = {"min_support": 0.04, "min_confidence": 0.6, "min_lift": 1.2}
    tokens = {r.url: frozenset(r.t) for r in pages.where("url is not null").select("url", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    sets = [tokens[u] for u in urls]
    support = collections.Counter()
    for s, v in zip(sets, label):
        for n in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), n):
                support[c, None] += 1
                support[c, v] += 1
    share = {v: label.count(v) / len(urls) for v in ("block", "allow")}
    rules = [(n / support[c, None], n / len(urls), len(c), v, set(c)) for (c, v), n in support.items()
             if v and n >= 0.04 * len(urls) - 1e-9 and n / support[c, None] >= 0.6 and n / support[c, None] / share[v] >= 1.2]
    def verdict(u):
        fit = [r for r in rules if u and r[4] <= tokens[u]]
        return max(fit, key=lambda r: r[:4])[3] if fit else "allow"
    got = url_rules.filter_urls(pages, labelled, (), **limits).collect()
    assert len(got) == 153 and rules
    assert all(r.verdict == verdict(r.url) for r in got)
    assert {r.verdict for r in got} == {"block", "allow"}


def decided_by_all_rules(urls, label, pages, tokens, least, confidence, lift):
    """Verdict of each page by every token combination it has, listed one by one."""
    share = {v: label.count(v) / len(urls) for v in ("block", "allow")}
    having = collections.defaultdict(int)  # labelled urls with a token, as bits
    for i, u in enumerate(urls):
        for t in tokens[u]:
            having[t] |= 1 << i
    said = {v: sum(1 << i for i, x in enumerate(label) if x == v) for v in share}
    out = {}
    for u in pages:
        best, level = (0, 0, 0, "allow"), [(-1, (1 << len(urls)) - 1, 0)]
        order = sorted(tokens[u])
        while level:
            at, cover, size = level.pop()
            for j in range(at + 1, len(order)):
                c = cover & having[order[j]]
                if not any((c & x).bit_count() >= least for x in said.values()):
                    continue
                level.append((j, c, size + 1))
                for v, x in said.items():
                    hits = (c & x).bit_count()
                    if hits >= least and hits / c.bit_count() >= confidence and hits / c.bit_count() / share[v] >= lift:
                        best = max(best, (hits / c.bit_count(), hits / len(urls), size + 1, v))
        out[u] = best[3]
    return out


@pytest.mark.parametrize("url_tokens", [0, 9])
def test_rules_of_long_urls_by_brute_force(spark, url_tokens):
    """Rules that need rare tokens of labelled urls with many, tokens that always come together, and ties."""
    rng = random.Random(11)
    words = [f"w{i:02d}" for i in range(9)]
    urls, label = [], []
    for n in range(60):
        has = [w for w in words if rng.random() < (0.9 if n % 4 else 0.3)] + [f"t{k}" for k in range(6) if rng.random() < 0.25]
        has += ["left", "right"] if rng.random() < 0.2 else []
        urls.append(f"http://h.org/{'/'.join(has)}/{n}")
        label.append("block" if "t0" in has or {"t1", "w03"} <= set(has) or rng.random() < 0.2 else "allow")
    labelled = spark.createDataFrame(list(zip(urls, label)), "url string, label string")
    others = ["http://h.org/" + "/".join(rng.sample(words + ["t0", "t1", "t2", "t3", "left", "right"], rng.randint(1, 9))) for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls + others)), "page_id bigint, url string")
    tokens = {r.url: frozenset(r.t) for r in pages.select("url", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    assert max(len(tokens[u]) for u in urls) > 12
    want = decided_by_all_rules(urls, label, set(tokens), tokens, 5, 0.5, 1.05)
    got = url_rules.filter_urls(pages, labelled, (), min_confidence=0.5, min_lift=1.05, url_tokens=url_tokens).collect()
    assert len(got) == 120 and set(want.values()) == {"block", "allow"}
    assert {r.url: r.verdict for r in got} == want


def test_rule_of_a_rare_token_of_long_urls(spark):
    """What tells the labels apart is the rarest of more token classes than FP-growth is given."""
    words = [f"w{i:02d}" for i in range(16)]
    urls = [("http://h.org/" + "/".join(w for i, w in enumerate(words) if i != n % 16) + ("/bad" if n < 8 else ""), "block" if n < 8 else "allow") for n in range(64)]
    labelled = spark.createDataFrame(urls, "url string, label string")
    pages = spark.createDataFrame([(1, urls[0][0]), (2, urls[63][0]), (3, "http://new.net/bad")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, labelled, ()).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def test_long_labelled_urls_do_not_enumerate_their_subsets(spark):
    """Six copies of a URL of 60 path words, and urls that share random parts of it."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    urls = ["http://spam.org/" + "/".join(words)] * 6 + ["http://spam.org/" + "/".join(rng.sample(words, 30)) for _ in range(10)]
    urls += [f"http://good.org/en/{i}" for i in range(84)]
    labelled = spark.createDataFrame([(u, "block" if "spam" in u else "allow") for u in urls] + [(None, "block"), ("http://x/", None)], "url string, label string")
    rules = url_rules.mine_rules(labelled)
    assert 0 < rules.count() < 2 * 2**url_rules.URL_TOKENS
    assert rules.where("verdict = 'block' and confidence = 1 and array_contains(tokens, 'host:spam')").count()
    assert rules.where("verdict = 'allow' and array_contains(tokens, 'host:good')").count()
    pages = spark.createDataFrame([(1, urls[0]), (2, urls[9]), (3, "http://good.org/en/500"), (4, "http://new.net/")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, labelled, ()).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_rules_need_enough_labelled_urls(spark):
    urls = [(f"http://a.org/{w}/x", "block") for w in ("rare", "rare", "rare", "rare")] + [(f"http://a.org/{w}/x", "block") for w in ["seen"] * 5]
    urls += [("http://b.org/y", "allow")] * 60
    rules = url_rules.mine_rules(spark.createDataFrame(urls, "url string, label string"), min_support=0.0001)
    said = {t for r in rules.collect() for t in r.tokens}
    assert "path:seen" in said and "path:rare" not in said


@needs_data
def test_blocked_pages_hold_up_on_held_out_labels(spark):
    """Rules from four fifths of the labelled pages, judged on the rest: blocking is right more often than chance."""
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "labels"))
    labelled = url_rules.labelled_pages(pages, labels).withColumn("held", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0)
    held = labelled.where("held").select("url", "label")
    got = url_rules.filter_urls(held, labelled.where("not held").select("url", "label"), ()).collect()
    blocked, bad = [r for r in got if r.verdict == "block"], sum(r.label == "block" for r in got) / len(got)
    assert len(blocked) < 0.2 * len(got)
    assert not blocked or sum(r.label == "block" for r in blocked) / len(blocked) >= bad


def test_url_filter_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://q.org/"), (2, None)], "page_id bigint, url string")
    got = url_rules.filter_urls(pages, spark.createDataFrame([], "url string, label string"))
    assert [r.verdict for r in got.collect()] == ["allow", "allow"]


# 7: WARC

def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}\nx", "<p>" + " ".join(rng.choices(["tag", "text", "é"], k=rng.randint(0, 400))) + "</p>") for i in range(60)]
    rows += [(100, "u", rows[0][2]), (101, None, rows[0][2]), (102, "u", None), (103, "u", ""), (-7, "u", "\0\r\n\r\nContent-Length: 3"),
             (104, "u", "z" * 6_000_000), (None, "u", "only null"), (None, "u", rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    made = warc.write_archives(pages, str(tmp_path / "a"))
    got = {(r.page_id, r.payload_bytes): r for r in warc.read_archives(made).collect()}
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    assert len(got) == len(rows)
    for i, url, html in rows:
        payload = (html or "").encode()
        r = got[i, len(payload)]
        last = max((x for x in groups[html or ""] if x is not None), default=None)
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = len(groups[html or ""]) > 1 and i != last
        assert (r.record_type, r.refers_to) == (("revisit", last) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == payload
    path = made.first()["path"]
    import zstandard
    with open(path, "rb") as f:
        data = f.read()
    n = int.from_bytes(data[4:8], "little")
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + n])).decompressobj()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and one.decompress(data[8 + n:]).startswith(b"WARC/1.1") and one.unused_data
    assert warc.write_archives(pages.limit(0), str(tmp_path / "b")).count() == 0


# 8: sharding

@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 4), (2, 1)])
def test_hilbert_curve(spark, dims, bits):
    cells = sorted(spark_rows(sharding.hilbert_cells(spark, dims, bits)), key=lambda r: r[-1])
    assert [c[-1] for c in cells] == list(range(2 ** (dims * bits)))
    assert all(sum(abs(x - y) for x, y in zip(a[:-1], b[:-1])) == 1 for a, b in zip(cells, cells[1:]))


def spark_rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("bucket_rows", [5, 100_000])
def test_sharding(spark, bucket_rows, monkeypatch):
    rows = corpus(4, docs=90)
    monkeypatch.setattr(sharding.shard, "__defaults__", (*sharding.shard.__defaults__[:-1], bucket_rows))
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert sorted((order_of(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (order_of(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(40))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    line = [r.curve for k in sorted(shards) for r in sorted(shards[k], key=lambda r: r.slot)]
    assert line == sorted(line)


def test_sharding_of_nothing(spark):
    assert sharding.shard_documents(frame(spark, [])).count() == 0


# 9: line cleaning

def brute_repeated(words):
    n = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if n[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)})


def test_line_cleaning(spark):
    body = "This is a plain sentence with a fair number of words, and it ends well."
    rows = corpus(9) + [(400, "\n".join([body] * 3)), (401, "a | b | c | d | e\n" * 10), (402, body + "\nLicensed under CC.\nAnother line follows it with other content, and that one ends well too."),
                        (403, " ".join(f"w{i}###" for i in range(40))), (404, "no no no no no " * 10), (405, "é " * 30 + ".")]
    got = {(r.doc_id, r.clean_text): r for r in line_clean.clean_lines(frame(spark, rows)).collect()}
    by_id = collections.defaultdict(list)
    for r in got.values():
        by_id[r.doc_id].append(r)
    for i, t in rows:
        t = t or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(words) < 20 or 100 * brute_repeated(words) > 30 * len(words)
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                brute_repeated(words), failed)
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in by_id[i]]
        assert all(not (r.base_failed and r.kept) for r in by_id[i])
    assert by_id[402][0].kept and "Licensed" not in by_id[402][0].clean_text
    assert not any(by_id[i][0].kept for i in (400, 401, 403, 404, 405))


# 10: Jaccard join

def brute_components(rows, shingle, percent):
    sets = []
    for _, t in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        sets.append({tuple(w[i:i + shingle]) for i in range(max(len(w) - shingle, 0) + 1)} if w else set())
    label = list(range(len(rows)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            label[find(b)] = find(a)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, len(s), least.get(find(n), i)) for n, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for base in range(14):
        words = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 8, 20, 60, 150, 400]))
        for _ in range(rng.randint(1, 7)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            rows.append((i, " ".join(copy)))
            i += rng.randint(1, 3)
            words = copy if rng.random() < 0.4 else words  # chains
    rng.shuffle(rows)
    return rows + [(-1, None), (900, ""), (901, " "), (902, "W1 w2"), (903, "w1\tw2"), (None, rows[0][1]), (904, rows[0][1]), (904, rows[0][1]), (905, "one " * 5000)]


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_jaccard_join(spark, seed, percent):
    rows = near_copies(seed)
    assert collected(jaccard_join.join_components(frame(spark, rows), 4, percent)) == brute_components(rows, 4, percent)


def test_jaccard_join_over_levels_of_buckets(spark):
    """Buckets of a few bytes, and three lots at a time: the entries are dealt over several levels."""
    rows = near_copies(4)
    got = jaccard_join.join_components(frame(spark, rows), 4, 85, bucket_bytes=4000, fan=5)
    assert collected(got) == brute_components(rows, 4, 85)


def test_dealt_rows_grow_with_the_entries():
    """Five times the entries over five times the buckets: five times the rows, at every level."""
    rng = np.random.default_rng(6)
    made = {}
    for n in (40_000, 200_000):
        cls, value = np.repeat(np.arange(n // 20), 20), rng.integers(0, 2**48, n, dtype=np.uint64)
        deal = jaccard_join.Deal(n // 200, fan=16, held=1000)
        rows = pa.Table.from_batches(deal.held_back((cls[i:i + 100], value[i:i + 100]) for i in range(0, n, 100)))
        made[n] = [rows.num_rows]
        for level in range(1, deal.levels):
            groups = [(lot, rows.filter(pa.compute.equal(rows["lot"], lot)).slice(p, 16)) for lot in pa.compute.unique(rows["lot"])
                      for p in range(0, pa.compute.sum(pa.compute.equal(rows["lot"], lot)).as_py(), 16)]
            rows = pa.concat_tables([deal.again(level)((lot,), g) for lot, g in groups])
            made[n].append(rows.num_rows)
        c, v = jaccard_join.entries(rows)
        assert sorted(zip(c.tolist(), v.tolist())) == sorted(zip(cls.tolist(), value.tolist()))
        for lot, group in ((r["lot"], pa.Table.from_pylist([r])) for r in rows.to_pylist()):
            assert (deal.place(*jaccard_join.entries(group)) == lot).all()
        assert all(m <= 17 * n // 1000 or m <= 16 * len(groups) for m in made[n])
    assert made[200_000][0] <= 5.5 * made[40_000][0]


def test_shuffles_of_finished_steps_go(spark, tmp_path):
    """Nothing that the join's own steps shuffled is left when it returns but what the result still needs."""
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    common.let_go(spark)
    time.sleep(1)
    before = held()
    docs = spark.createDataFrame(near_copies(5), "doc_id bigint, text string")
    summary, links = jaccard_join.link_classes(docs)
    for _ in range(40):
        if held() <= before:
            break
        time.sleep(0.25)
    assert held() <= before


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands(85)
    for n in (1, 2, 7, 13, 40, 90, 200, 700, 2000):
        for _ in range(25):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = x.copy()
            while True:  # as different as a link allows
                z = np.unique(np.concatenate([rng.choice(y, len(y) - 1, replace=False), rng.integers(0, 2**63, rng.integers(0, 2), dtype=np.uint64)])) \
                    if len(y) > 1 else y
                common = len(np.intersect1d(x, z))
                if len(y) == 1 or 100 * common < 85 * (len(x) + len(z) - common):
                    break
                y = z
            sig, which = jaccard_join.signatures([x, y], bands)
            a, b = sig[which == 0], sig[which == 1]
            both = set((a >> np.uint64(1)).tolist()) & set((b >> np.uint64(1)).tolist())
            whole = {int(s) >> 1 for s in sig if not int(s) & 1}
            assert both & whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (5, 3)]
    got = dict(spark_rows(components.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_firsts_of_near_copies(spark):
    rows = near_copies(3)
    docs = frame(spark, rows)
    kept = jaccard_join.keep_firsts(docs, 5, 80)
    first = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == first


# all operators on empty tables, and the pipeline

def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    for out in (suffix_dedup.digest(docs), suffix_dedup.dedup(docs), substring_dedup.remove_long_matches(docs), toxicity.score(docs, labels),
                decontam.decontaminate(docs, benchmark), line_clean.clean_lines(docs), jaccard_join.join_components(docs)):
        assert out.count() == 0


@needs_data
def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    # The same stages over plain lists.
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    scored = toxicity.score(docs.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    rows = sorted((r.doc_id, r.text) for r in scored if not r.predicted)
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, sorted(brute_components(rows, 5, 80))) if i == c]
    left = [(i, bytes(kept).decode("utf-8", "ignore"), gone) for (i, _), (_, gone, _, kept) in
            zip(rows, brute_repeats(rows, lambda t: (t or "").encode(), 50))]
    rows = [(i, t) for i, t, gone in left if not gone or t.strip(" ")]
    hits = {r[0]: r for r in brute_windows(rows, benchmark)}
    ids = {r.doc_id: r.doc_tokens for r in got}
    assert set(ids) == {i for i, _ in rows if hits[i][2] < 0.5 * hits[i][1] or not hits[i][2]}
    from tokenizers import Tokenizer
    public_tokenizers = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(ids[i] == len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows if i in ids and not hits[i][2])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "benchmark", "packing"]


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_signatures_are_packed():
    sig = np.array([0, 1, 2**48 - 1, 2**63 + 5], np.uint64)
    assert (jaccard_join.unpacked(jaccard_join.packed(sig)) == sig & np.uint64(2**48 - 1)).all()


# Memory of the pipeline's stages

def test_lists_are_cut_into_slices_as_well():
    rows = pa.record_batch({"cls": pa.array(range(40)), "tokens": pa.array([list(range(i * 100)) for i in range(39)] + [None], pa.list_(pa.int64()))})
    got = list(common.slices([rows], "tokens", 20_000))
    assert pa.Table.from_batches(got).to_pylist() == rows.to_pylist()
    assert len(got) > 20 and max(8 * len(b["tokens"].flatten()) for b in got) <= 20_000 + 8 * 3_800


def test_what_a_group_freed_is_handed_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "trim", lambda: calls.append(1))
    assert common.trimmed(lambda key, table: (key, table))(1, 2) == (1, 2)
    assert common.trimmed(lambda key, left, right: (key, left, right))(1, 2, 3) == (1, 2, 3)
    assert len(calls) == 2


def test_a_slice_without_places_to_read():
    decoder = toxicity.Decoder(np.zeros((27, 27, 27)), frozenset([toxicity.target(b"stupid")]))
    assert not len(decoder.places("all good words here\nand nothing else")) and not len(decoder.places(""))
