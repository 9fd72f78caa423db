"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and
clashing extra columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import ann, attribution, bpe, decontaminate, near_dup, pii, quality, revisits, substring_dedup, url_filter
from framelake.llm import queries as registered
from framelake.llm.shared import components
from framelake.llm.words import groups

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCAB = "the of and to in is it for on with as was at by an be this that from or are ähm né éa über".split()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus(seed=1, n=40):
    """(doc_id, text) with copies, near copies, shared passages, short, empty, null and repeated texts."""
    rng = random.Random(seed)
    base = words(rng, 150)
    passage = words(rng, 30)
    rows = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            for _ in range(1 + i % 3):
                w[rng.randrange(len(w))] = "changed" + str(i)
            t = " ".join(w)
        elif kind == 2:
            t = words(rng, 40) + "\n" + passage.upper() + "\t" + words(rng, 20)
        elif kind == 3:
            t = words(rng, 40) + "  " + passage + " " + words(rng, 20)
        elif kind == 4:
            t = ["", " \n ", "one", "one two three four", words(rng, 5)][i // 8 % 5]
        elif kind == 5:
            t = None if i % 16 == 5 else words(rng, 400)
        else:
            t = words(rng, rng.randrange(1, 120))
        rows.append((i * 3, t))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (3, 3), (20, 1), (9, 8)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    star = [(i, 50) for i in range(60)] + [(i, i + 1) for i in range(100, 120)] + [(110, 3)]
    assert dict(components(spark.createDataFrame(star, "u long, v long"), hubs_from=0).collect()) == {i: 0 for i in [*range(60), *range(100, 121)]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/71?x#y", "x://com/en/", "x://notcom/en/", "x://example.com/en", "x://b.com/en/é", "x://b.com?/en/", "x://b.net#/de/", "x://a..net/de/8", "x://example.net/de/89", "x://example.net/de/89", "a://b://c.org/es/", "x://b.com/en/" + "y" * 100_000]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = registered.URL_RULES
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"), u
    again = url_filter.judge_urls(pages.union(pages), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert rows_of(again) == sorted(2 * rows_of(url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))), key=repr)
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_url_rules_are_the_contracts(spark, tmp_path):
    urls = ["x://a.net/de/1", "x://www.example.net/de/8/b", "x://a.com/en/1", "x://example.com/en/71", "x://a.org/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in registered.op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("example.net/de/8", "block"), 2: ("com/en/", "block"), 3: ("example.com/en/7", "allow"), 4: ("org/es/", "block")}


def test_revisits(spark):
    full, again = {"ETag": 'W/"a"', "Content-Type": "t", "Date": "1", "date": "2"}, {"etag": '"a"', "Date": "9", "Content-Type": "no"}
    records = [
        (1, "http://www.x.org/p/", 10, True, full),
        (2, "https://X.org:80/p#f", 20, False, again),
        (3, "x://x.org/p", 10, False, again),  # not strictly later
        (4, "x://x.org/p", 30, False, {"etag": "other"}),
        (5, "x://x.org/p?b=1&a=2&utm_x=3", 40, False, again),
        (6, None, 40, False, None),
        (7, "x://x.org/p", None, False, again),
        (8, "x://x.org/p", 50, True, {"Last-Modified": "m"}),
        (9, "x://x.org/p", 60, False, {"Last-Modified": "m", "Expires": "e"}),
        (9, "x://x.org/p", 60, False, {"Last-Modified": "m", "Expires": "e"}),
        (0, "x://x.org/p", 50, True, {"Last-Modified": "m", "Server": "s"}),
    ]
    df = spark.createDataFrame([(*r, "kept") for r in records], "record_id long, url string, ts long, full boolean, headers map<string,string>, status string")
    for ranges in (2, 64):
        got = {}
        for r in revisits.resolve_revisits(df, ranges=ranges).collect():
            got.setdefault(r.record_id, []).append((r.status, r.refers_to, r.merged))
        assert got[2] == [("resolved", 1, {"etag": '"a"', "content-type": "t", "date": "9"})]
        assert [got[i][0][0] for i in (3, 4, 5, 6, 7)] == ["orphan", "mismatch", "orphan", "orphan", "orphan"]
        assert got[9] == [("resolved", 0, {"last-modified": "m", "server": "s", "expires": "e"})] * 2
        assert got[1][0][2]["date"] == "2"
    assert revisits.resolve_revisits(df.limit(0)).count() == 0
    assert revisits.canonical_url(F.lit("x")) is not None


def slow_spans(t, enc):
    raw = t.encode()
    char = np.cumsum([b & 0xC0 != 0x80 for b in raw]) - 1
    at, out = 0, []
    for i in enc.encode_ordinary(t):
        n = len(enc.decode_single_token_bytes(i))
        out.append((int(char[at]), int(char[at + n - 1]) + 1))
        at += n
    return out


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_attribution(spark, tokenizer):
    texts = ["Hello world\nsecond line", "", None, "naïve 🙂🙂 text\n\n\n  x", "🙂" * 50, "a" * 3000]
    sections = [[(0, 3), (3, 9), (2, 99)], None, [(0, 0)], [(0, 7), (7, 8), (8, 20), (None, 4), (9, 2)], [(i, i + 1) for i in range(50)], [(0, 1000), (1000, 3000)]]
    df = spark.createDataFrame([(i, t, s, 7) for i, (t, s) in enumerate(zip(texts, sections))], "doc_id long, text string, parts array<struct<start:long,end:long>>, section int")
    for rule in attribution.RULES:
        got = attribution.attribute_tokens(df, RANKS, public_tokenizers.PATTERN, sections="parts", rule=rule, keep=["doc_id"]).collect()
        for r in got:
            spans = slow_spans(texts[r.doc_id] or "", tokenizer)
            lo, hi = r.start, r.end
            if rule == "first":
                want = sum(lo <= a < hi for a, b in spans)
            elif rule == "last":
                want = sum(lo < b <= hi for a, b in spans)
            else:
                want = sum(max(0, min(b, hi) - max(a, lo)) / (b - a) for a, b in spans)
            assert abs(r.n_tokens - want) < 1e-9, (rule, r)
            assert r.n_crossing == sum(a < hi and b > lo and not (lo <= a and b <= hi) for a, b in spans), r
        assert len(got) == sum(len(s or ()) for s in sections)
    lines = attribution.attribute_tokens(df, RANKS, public_tokenizers.PATTERN, keep=["doc_id"]).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in lines} == {i: len(tokenizer.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert attribution.attribute_tokens(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        attribution.attribute_tokens(df, RANKS, public_tokenizers.PATTERN, rule="none")


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_pii(t):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def pii_texts():
    rng = random.Random(3)
    pieces = ["a@b.c", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6468", "+1 (988) 555-2485", "+12", "+1234567890123456", "é🙂", "a@b.c_d@e.f", "0001.2.3.004", ".", "-", " ", "\n", "12", "word"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ","]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    return [None, "", "1" * 30_000, "1.1" * 9_000, "a" * 50_000 + "@", "a.b@c.d " * 3_000, "+1 " * 5_000 + "9", *texts]


def test_pii_base(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    for r in pii.summary(pii.find_personal_data(df, keep=["doc_id"])).collect():
        want = slow_pii(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
        assert set(want) <= set(filter(None, r.spans.split(",")))
    assert pii.find_personal_data(df.limit(0), keep=["doc_id"]).count() == 0


def test_pii_bootstrap_and_redaction(spark):
    seeds = [f"Please call Support Hotline: +1 (988) 555-{2000 + i} today" for i in range(6)]
    unseen = ["then call support hotline: 988-555-7777 now", "the number 988-555-8888 is only a number", "mail me a@b.co or +1 (988) 555-2485"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(seeds + unseen)], "doc_id long, text string")
    got = {r.doc_id: r.added_spans for r in pii.find_personal_data(df, keep=["doc_id"]).collect()}
    assert [(s["kind"], unseen[0][s["start"] : s["end"]]) for s in got[6]] == [(3, "988-555-7777")]
    assert not any(got[i] for i in got if i != 6)
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[6] == "then call support hotline: [phone] now"
    assert clean[7] == unseen[1]
    assert clean[8] == "mail me [email] or [phone]"


def planted(n=300, seed=17):
    """Documents with identifiers in contexts that seeds vouch for, contexts that only found identifiers vouch for, and
    contexts that say nothing."""
    rng = random.Random(seed)

    def number():
        return f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"

    shared = [number() for _ in range(12)]
    out = []
    for i in range(n):
        kind = i % 10
        if kind < 3:
            t = f"call the Support Hotline: +1 {number()} or"
        elif kind == 3:
            t = f"call our support hotline: {shared[i // 10 % 12]} for"
        elif kind == 4:
            t = f"the desk answers {shared[i // 10 % 12]} too,"
        elif kind == 5:
            t = f"the desk answers {number()} and" if i % 30 == 5 else "nobody counts"
        elif kind == 6:
            t = f"we counted {number()} of them\nin"
        elif kind == 7:
            t = f"write to editor{i}(at)mail{i % 4} or contact: a{i}@mail.example.com, contact: b{i}(at)host"
        elif kind == 8:
            t = f"contact: c{i}@mail.example.com and +1 {number()} too"
        else:
            t = "support hotline: closed" if i % 50 == 9 else "the desk is closed"
        out.append((i, words(rng, rng.randrange(0, 12)) + " " + t + " " + words(rng, rng.randrange(0, 12))))
    return [*out, (n, None), (n + 1, ""), (n + 2, out[3][1])]


def slow_bootstrap(texts, support=pii.SUPPORT, confidence=pii.CONFIDENCE, rounds=pii.ROUNDS):
    """Weights of every round, and the added spans of each text, by plain loops over texts."""

    def contexts(gap):
        tail = gap[-80:].lower()
        one = re.search(r"(?:^|\s)(\S{1,30})[ \t]*$", tail, re.A)
        two = re.search(r"(?:^|\s)(\S{1,30})[ \t]+(\S{1,30})[ \t]*$", tail, re.A)
        return [x for x in (one and one[1], two and one and f"{two[1]} {one[1]}") if x]

    def matches(t, pattern):
        at = 0
        for m in re.finditer(pattern, t, re.A):
            yield m.start(), m.end(), m[0], contexts(t[at : m.start()])
            at = m.end()

    found, edges, seen = [], {}, {}
    for t in texts:
        t = t or ""
        good = {tuple(x.split(":")) for x in slow_pii(t)}
        base = [(k, s, e, v, c) for k, name in enumerate(PLAIN) for s, e, v, c in matches(t, PLAIN[name]) if (name, str(s), str(e)) in good]
        loose = []
        for s, e, v, c in matches(t, pii.LOOSE):
            kind = 0 if re.search(r"@|\(at\)|\[at\]", v) else 1 if ":" in v else 2 if len(re.sub("[^0-9]", "", v)) >= 13 else 3
            if not any(b[1] < e and s < b[2] for b in base):
                loose.append((kind, s, e, v, c))
        for seed, rows in ((1, base), (0, loose)):
            for kind, _, _, v, c in rows:
                for p in c:
                    old = edges.get((kind, p, v.lower()), (0, 0))
                    edges[kind, p, v.lower()] = max(old[0], seed), old[1] + 1
        found.append(loose)
        w = re.split(r"\s+", t.lower(), flags=re.A)
        for p in [*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))]:
            seen[p] = seen.get(p, 0) + 1
    groups_ = {}
    for (kind, p, v), (seed, n) in edges.items():
        groups_.setdefault((kind, p), []).append((v, seed, n))
    groups_ = {k: g for k, g in groups_.items() if len(g) >= support and any(not seed for _, seed, _ in g)}
    scores, history = {(k, v): 1.0 for (k, _), g in groups_.items() for v, seed, _ in g if seed}, []
    seeds = set(scores)
    for _ in range(rounds):
        weights = {}
        for (kind, p), g in groups_.items():
            sure = sum(scores.get((kind, v), 0) >= confidence for v, _, _ in g)
            weights[kind, p] = min(1.0, sum(scores.get((kind, v), 0) * n for v, _, n in g) / seen[p]) if sure >= support else 0.0
        scores = {x: 1.0 for x in seeds}
        for x in {(k, v) for (k, _), g in groups_.items() for v, _, _ in g} - seeds:
            scores[x] = 1 - np.prod([max(1e-9, 1 - weights[k, p]) for (k, p), g in groups_.items() if k == x[0] and any(v == x[1] for v, _, _ in g)])
        history.append(weights)
    trusted = {x for x, w in history[-1].items() if w >= confidence}
    return history, [sorted({(k, s, e) for k, s, e, _, c in rows if any((k, p) in trusted for p in c)}) for rows in found]


def test_pii_bootstrap_against_brute_force(spark, monkeypatch):
    rows = planted()
    history, want = slow_bootstrap([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scanned = pii.settle(pii.scan(df, "text").select("base", "loose"))
    graph = pii.settle(pii.graph_of(scanned))
    seen = pii.settle(pii._words_seen(df, "text", graph))
    for weights, slow in zip(pii.weigh(graph, seen), history, strict=True):
        got = {(r.kind, r.pattern): r.w for r in weights.collect()}
        assert got.keys() == slow.keys() and all(abs(got[k] - slow[k]) < 1e-9 for k in got)
    grown = [{k for k, w in x.items() if w >= pii.CONFIDENCE} for x in history]
    assert (3, "desk answers") in grown[1] - grown[0]  # vouched for by found identifiers only
    for few in (pii.BROADCAST_PATTERNS, 0):
        monkeypatch.setattr(pii, "BROADCAST_PATTERNS", few)
        got = {r.doc_id: [tuple(x) for x in r.added_spans] for r in pii.find_personal_data(df, keep=["doc_id"]).collect()}
        assert [got[i] for i, _ in rows] == want
    assert sum(map(bool, want)) >= 60 and not any(want[i] for i in range(6, 300, 10))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[300] is None and "[phone]" in clean[3] and clean[302] == clean[3] and "[email]" in clean[7]


def test_pii_stays_native(spark, docs):
    found = pii.find_personal_data(docs, keep=["doc_id"])
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab 1é\n", max_size=200), st.text("aehlnot", min_size=60, max_size=400)))
def test_bpe_tree(tokenizer, text):
    own = test_bpe_tree.codecs.setdefault(0, bpe.Codec(bpe.read_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN, bpe.unknown_letters()))
    ids = tokenizer.encode_ordinary(text)
    assert own.encode(text) == ids
    assert own.decode(ids).decode() == text
    raw = text.encode()
    if raw:  # any bytes, and any two parts of them
        assert own.encode_bytes(raw) == own.merge(raw) == tokenizer._encode_single_piece(raw)
        for cut in {1, len(raw) // 3, len(raw) - 1} - {0, len(raw)}:
            assert own.join(own.encode_bytes(raw[:cut]), own.encode_bytes(raw[cut:])) == own.merge(raw)


test_bpe_tree.codecs = {}


def test_bpe_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0}, ".", "")


def test_bpe_documents(spark, tokenizer):
    odd = chr(int("88f", 16))  # a letter to one library only
    texts = [None, "", "x" * 20_000, "same row", "same row", " " * 5_000 + "y", "é" * 3_000, f"ab{odd}cd {odd}{odd} 12", "".join(map(chr, range(1, 3000)))]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN, digests=True), RANKS, public_tokenizers.PATTERN)
    for r in coded.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == tokenizer.encode_ordinary(t) and bytes(r.decoded) == t.encode() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24))
    x[700:1000] = x[100]  # a vector that many rows share
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(10_000, None, 0), (20_000, [0.0] * 24, 0), (30_000, [float("nan")] * 24, 0), (40_000, [None] + [1.0] * 23, 0), (50_000, [1.0, 2.0], 0), (None, [1.0] * 24, 0), (60_000, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert set(got) == set(range(0, 1500, 100))
    for q, rows in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(1500), d))[:10]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert all(s == d[v] for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hits += len(set(true) & {v for _, v, _ in rows})
        if q in (100, 700, 800, 900):
            assert [v for _, v, _ in rows] == true.tolist()
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_exact(spark, clustered):
    """All nearest, in clusters (where few vectors have to be verified) and without any structure; one vec_id has two
    vectors."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 12))
    if clustered:
        x = rng.standard_normal((60, 12))[np.arange(6000) % 60] * 20 + x * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[7].tolist())]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.append(np.arange(6000), 100)
    every = np.concatenate((x, x[7:8]))
    for q, rows in got.items():
        near = []
        for v in every[ids == q]:
            d = np.sqrt(((every - v) ** 2).sum(axis=1))
            near += [(d[i], ids[i]) for i in np.lexsort((ids, np.where(ids == q, np.inf, d)))[:10]]
        assert [(s, v) for _, v, s in sorted(rows)] == sorted(near)[:10]
    assert len(got) == 60


def test_nearest_deals_queries_too(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(6)]) for i in range(600)], "vec_id long, embedding array<double>")
    want = rows_of(ann.nearest(df, every=3))  # 200 queries in one block
    block = ann._block

    def bounded(base, asked, k, exact):
        assert len(asked) <= 80
        return block(base, asked, k, exact)

    monkeypatch.setattr(ann, "_block", bounded)
    assert rows_of(ann.nearest(df, every=3, query_rows=40)) == want and len(want) == 2000


def test_decontaminate(spark, docs):
    rows = corpus()
    long = rows[2][1].split()
    items = [(1, " ".join(long[45:60])), (2, "One, TWO three"), (3, None), (4, "!!"), (5, rows[5 + 8][1]), (6, " ".join(long[44:53])), (10, "the"), (None, "of and to in is"), (1, "over there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(rows, [("" if i is None else i, t) for i, t in items]), key=repr)
    for size in (decontaminate.BLOCK_WORDS, 5):
        marked = decontaminate.decontaminate(docs.withColumn("n_words", F.lit("x")), bench, block_words=size)
        assert rows_of(decontaminate.summary(marked)) == want
    nothing = decontaminate.summary(decontaminate.decontaminate(docs, bench.limit(0)))
    assert {r.contaminated for r in nothing.collect()} == {False}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_substring_dedup(spark, docs):
    rows = corpus()
    for batches in (1, 6):
        got = substring_dedup.dedup_substrings(docs.withColumn("n_removed", F.lit("x")), batches=batches, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_text")
        assert rows_of(got) == sorted(substring_dedup.brute_force(rows), key=repr)
    odd = spark.createDataFrame([(None, words(random.Random(1), 20)), (None, words(random.Random(1), 20)), (5, words(random.Random(1), 20)), (5, words(random.Random(1), 20))], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.dedup_substrings(odd).collect()) == [0, 0, 20, 20]
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_substring_index_grows_and_is_opened_again(spark, tmp_path):
    """Seven batches, each into the index as a later session finds it, against brute force over all documents."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(7, 70))]
    want = {r[0]: r for r in substring_dedup.brute_force(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    folder = str(tmp_path / "index")
    made = substring_dedup.FingerprintIndex.for_size(spark, folder, 10_000)
    compacted = 0
    for n in range(7):
        index = made if not n else substring_dedup.FingerprintIndex.open(spark, folder)
        before = len(index.runs)
        batch, history = df.filter(f"doc_id >= {n * 10} AND doc_id < {n * 10 + 10}"), df.filter(f"doc_id < {n * 10}")
        null = spark.createDataFrame([(None, rows[0][1])], "doc_id long, text string")
        got = substring_dedup.dedup_batch(index, batch.union(null), history if n else None, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert {tuple(r) for r in got if r.doc_id is not None} == {want[i] for i in range(n * 10, n * 10 + 10)}
        assert [r.n_removed for r in got if r.doc_id is None] == [150]  # an earlier document holds all of it
        compacted += before >= substring_dedup.FANOUT
        assert len(index.runs) <= substring_dedup.FANOUT
    assert compacted >= 3
    with pytest.raises(ValueError):
        substring_dedup.dedup_batch(substring_dedup.FingerprintIndex.open(spark, folder), df.filter("doc_id = 3"))


def test_index_survives_a_killed_write(spark, tmp_path, monkeypatch):
    docs = [(i, t) for i, t in corpus(5) if t]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: (n, gone, sha(kept)) for d, n, gone, kept in substring_dedup.brute_force(docs)}
    folder = str(tmp_path / "index")
    Index = substring_dedup.FingerprintIndex
    index, rows, last = Index.for_size(spark, folder, 10_000), {}, -1
    cuts = [docs[len(docs) * k // 4][0] for k in range(1, 4)] + [docs[-1][0] + 1]

    def dies(*a, **k):
        raise RuntimeError("killed")

    for k, cut in enumerate(cuts):
        batch, history = df.filter((F.col("doc_id") > last) & (F.col("doc_id") < cut)), df.filter(F.col("doc_id") <= last)
        for step in ("_replace", "compact", "commit"):  # before the manifest, in compaction, after the result
            with monkeypatch.context() as m:
                m.setattr(Index, step, dies)
                if step != "compact" or len(index.runs) >= substring_dedup.FANOUT:
                    with pytest.raises(RuntimeError, match="killed"):
                        substring_dedup.dedup_batch(index, batch, history if k else None)
            index = Index.open(spark, folder) if k else Index.for_size(spark, folder, 10_000)
        got = substring_dedup.dedup_batch(index, batch, history if k else None)
        rows |= {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text)) for r in got.collect()}
        last = cut - 1 if cut - 1 in dict(docs) else max(d for d, _ in docs if d < cut)
        index = Index.open(spark, folder)
    assert rows == want
    runs = [x for x in (tmp_path / "index").iterdir() if x.name.startswith("run-")]
    assert len(runs) == len(index.runs)  # what was left behind is swept



def test_near_duplicates(spark, docs):
    rows = corpus()
    want = sorted(near_dup.brute_force(rows), key=repr)
    assert rows_of(near_dup.near_duplicates(docs)) == want
    assert rows_of(near_dup.near_duplicates(docs, block_shingles=300)) == want  # large clusters, in blocks
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "A B C d e f")], "doc_id long, text string")
    assert rows_of(near_dup.near_duplicates(odd).select("doc_id", "component_id", "kept")) == sorted([(None, None, True), (3, 3, True), (3, 3, True), (7, 3, False)], key=repr)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def thue_morse(order):
    """Two words that any polynomial hash modulo a power of two takes for one."""
    a, b = "a", "b"
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomial_hashes_confuse(spark):
    """Words of 2,048 letters, and runs of 16 words, that follow the Thue-Morse sequence."""
    one, two = thue_morse(11)
    long = [" ".join(x + str(i) for i in range(20)) for x in (one, two)]
    runs = [" ".join(x) for x in thue_morse(4)]
    rows = list(enumerate([one, two, *long, *runs, " ".join(runs), " ".join(runs[::-1])]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dup.near_duplicates(df)) == sorted(near_dup.brute_force(rows), key=repr)
    got = substring_dedup.dedup_substrings(df, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_text")
    assert rows_of(got) == sorted(substring_dedup.brute_force(rows), key=repr)
    items = [(1, two), (2, long[1]), (3, runs[1])]
    marked = decontaminate.decontaminate(df.filter("doc_id IN (0, 2, 4)"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(decontaminate.summary(marked)) == sorted(decontaminate.brute_force([rows[i] for i in (0, 2, 4)], items), key=repr)


def test_word_hash_is_siphash():
    """Against SipHash-1-3 by its definition, on words of every length of lanes."""
    from framelake.llm import words as w

    def plain(key, m):
        top = (1 << 64) - 1
        k0, k1 = int.from_bytes(key[:8], "little"), int.from_bytes(key[8:16], "little")
        v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

        def turn(x, n):
            return ((x << n) | (x >> (64 - n))) & top

        def rounds(n):
            for _ in range(n):
                v[0] = (v[0] + v[1]) & top
                v[1] = turn(v[1], 13) ^ v[0]
                v[0] = turn(v[0], 32)
                v[2] = (v[2] + v[3]) & top
                v[3] = turn(v[3], 16) ^ v[2]
                v[0] = (v[0] + v[3]) & top
                v[3] = turn(v[3], 21) ^ v[0]
                v[2] = (v[2] + v[1]) & top
                v[1] = turn(v[1], 17) ^ v[2]
                v[2] = turn(v[2], 32)

        for i in range(len(m) // 8 + 1):
            x = int.from_bytes(m[8 * i : 8 * i + 8].ljust(8, b"\0"), "little") | (len(m) % 256 << 56 if i == len(m) // 8 else 0)
            v[3] ^= x
            rounds(1)
            v[0] ^= x
        v[2] ^= 0xFF
        rounds(3)
        return v[0] ^ v[1] ^ v[2] ^ v[3]

    texts = [bytes(range(33, 33 + n)).decode() for n in range(1, 64)]
    for which in (0, 1):
        got = next(groups(pa.array([" ".join(texts)]), w.byte_table(words="nonspace", lower=False), which)).hash
        assert got.tolist() == [plain(w._KEYS[which], t.encode()) for t in texts]


def test_prefixes_part_template_pages(spark):
    """Pages alike by their template only fall apart before any two of them are compared; linked ones stay together."""
    rng = random.Random(8)
    frame = [f"t{i}" for i in range(64)]
    rows = [(i, " ".join(frame + [f"w{rng.randrange(10**9)}" for _ in range(20)])) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(10)]
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows], "rep long, cluster long, text string")
    sets = docs.mapInArrow(near_dup._sets, "rep long, cluster long, hashes binary")
    parts = {}
    for node, part in near_dup._parted(sets).collect():
        parts.setdefault(part, set()).add(node)
    assert all(any({i, 200 + i} <= p for p in parts.values()) for i in range(10))
    assert max(map(len, parts.values())) <= 20


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [a[:1000], np.concatenate((a[:900], a[1000:1100])), a[:1]]
    doc = np.repeat(np.arange(3), [len(s) for s in sets])
    s = near_dup.sketches(doc, np.concatenate(sets), 3, 512)
    assert (s != near_dup._NONE).all()
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.08


def test_chain_of_near_copies(spark):
    """Neighbours of a chain are linked, its ends are not: one component all the same."""
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[rng.randrange(300)] = f"n{i}"
    want = sorted(near_dup.brute_force(rows), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dup.near_duplicates(df, block_shingles=3000)) == want


def test_template_pages_meet_in_bounded_blocks(spark, monkeypatch):
    """A cluster of pages alike by their template, with few true links: no task gets all that are left over."""
    rng = random.Random(5)
    frame = [f"t{i}" for i in range(64)]
    rows = [(i, " ".join(frame + [f"w{rng.randrange(10**9)}" for _ in range(20)])) for i in range(150)]
    rows += [(200 + i, rows[i][1] + f" end{i}" * (1 + i % 9)) for i in range(40)]
    most = 400 * near_dup.ACROSS
    across = near_dup._across

    def bounded(asked, base):
        for side in (asked, base):
            assert sum(len(b) // 8 for b in side["hashes"]) <= 2 * most
        return across(asked, base)

    monkeypatch.setattr(near_dup, "_across", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, block_shingles=400)
    assert rows_of(got) == sorted(near_dup.brute_force(rows), key=repr)


def test_left_overs_meet_all_of_like_size_once(spark):
    rng = random.Random(6)
    sizes = {i: rng.choice([17, 20, 100, 117, 118, 119, 400]) for i in range(120)}
    parted = spark.createDataFrame([(1, i, n, i % 100, 0, b"") for i, n in sizes.items()], "cluster long, rep long, n long, part long, main long, hashes binary")
    asked, base = near_dup._meetings(parted, 1000)
    keys = ["cluster", "asked_block", "base_block"]
    met = asked.join(base.withColumnRenamed("rep", "other"), keys).select("rep", "other").collect()
    assert len(met) == len(set(met))
    like = {(a, b) for a in sizes for b in sizes if a % 100 and 100 * min(sizes[a], sizes[b]) >= near_dup.PERCENT * max(sizes[a], sizes[b])}
    assert like <= {tuple(r) for r in met}
    assert len(met) < 120 * 120 / 2  # sizes that can't be linked don't meet


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in registered.op9_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(scored[d].score, q) for d, q in labels.items() if scored[d].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in scored.items())


def test_quality_edges(spark):
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "x", 9.0), (4, "y " * 100_000, 9.0)], "doc_id long, text string, score double")
    model = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score_quality(odd, model).collect()] == [0.5] * 4
    assert quality.score_quality(odd.limit(0), model).count() == 0


def slow_features(text):
    """The features of one text by loops over its bytes and words."""
    raw = (text or "").encode()

    def kind(b):
        for i, c in enumerate(quality.CLASSES):
            if bytes([b]).decode("latin-1") in c:
                return i
        return len(quality.CLASSES) + (b < 128)

    k = quality.N_CLASSES
    kinds, n = [kind(b) for b in raw], max(1, len(raw))
    one, two = [0.0] * k, [0.0] * k * k
    for i in kinds:
        one[i] += 1 / n
    for i, j in zip(kinds, kinds[1:]):
        two[i * k + j] += 1 / n
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))
    m = max(1, len(w))
    again, second = (sum(a == b for a, b in zip(w, w[i:])) / m for i in (1, 2))
    lengths = [len(x) for x in w]
    x = [*one, *two, again, second, len(set(w)) / m, 0.0, 0.0, 0.0, 0.0, sum(lengths) / m / 20]
    x = [np.log1p(1000 * v) / np.log(1001) for v in x]
    return x, np.log1p(len(raw)) / 10, np.log1p(len(w)) / 10, np.log1p(max(lengths, default=0)) / 10


def test_quality_features_against_loops():
    texts = ["Plain text, twice. Plain text!", None, "", "a a a b a b | #hash (x) 12-3", "Größe ñandú\n\tb " * 40, "  \n "]
    for a in groups(pa.array(texts), quality._TABLE):
        got = quality.features(a)
        for i in range(a.n_docs):
            slow, size, n_words, longest = slow_features(texts[a.first + i])
            width = quality.N_CLASSES + quality.N_CLASSES**2
            assert np.allclose(got[i][: width + 3], slow[: width + 3])
            assert np.allclose(got[i][-4:-1], [size, n_words, longest])


def test_quality_risk_against_loops():
    rng = np.random.default_rng(6)
    p, u = rng.normal(1, 1, (7, 3)), rng.normal(0, 1, (11, 3))

    def parts(w, pi):
        loss = lambda z: np.log1p(np.exp(-z))
        at = lambda x: sum(a * b for a, b in zip(x, w[:-1])) + w[-1]
        good = pi * sum(loss(at(x)) for x in p) / len(p)
        bad = sum(loss(-at(x)) for x in u) / len(u) - pi * sum(loss(-at(x)) for x in p) / len(p)
        return good, bad

    seen = set()
    for pi, w in [(0.3, rng.normal(0, 1, 4)) for _ in range(10)] + [(0.95, np.array([3.0, 3, 3, 1])), (0.9, np.array([5.0, 5, 5, 0]))]:
        bad = parts(w, pi)[1]
        seen.add(bool(bad >= 0))

        def goal(w):
            good, bad_now = parts(w, pi)
            return good + bad_now if bad >= 0 else -bad_now

        step = 1e-6 * np.eye(4)
        slow = [(goal(w + s) - goal(w - s)) / 2e-6 for s in step]
        assert np.allclose(quality.risk_gradient(w, p, u, pi), slow, atol=1e-6)
    assert seen == {True, False}


def test_best_bin_against_loops():
    rng = np.random.default_rng(9)
    p, u = rng.normal(1, 1, 200).round(1), np.concatenate((rng.normal(1, 1, 60), rng.normal(-2, 1, 90))).round(1)
    slack = np.sqrt(np.log(4 / 0.1) / 2)
    best = None
    for cut in sorted(set(p.tolist())):
        qp, qu = sum(x >= cut for x in p) / len(p), sum(x >= cut for x in u) / len(u)
        bound = (qu + slack / np.sqrt(len(u)) + 1.01 * slack / np.sqrt(len(p))) / qp
        if best is None or bound < best[0]:
            best = bound, qu / qp
    assert abs(quality.best_bin(p, u) - min(0.98, max(0.05, best[1]))) < 1e-12


def test_prior_estimate():
    rng = np.random.default_rng(2)
    p, n = rng.normal(2, 1, (3000, 3)), rng.normal(-2, 1, (900, 3))
    u = np.concatenate((rng.normal(2, 1, (2100, 3)), n))
    rng.shuffle(u)
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.06


def test_word_scan_slices():
    """Long documents are cut into slices, which changes no hash."""
    from framelake.llm import words as w

    table = w.byte_table(words="nonspace", lower=True)
    texts = ["Aé b  " * 300_000, "x" * 3_000_000, "", "a\tb"]
    column = pa.array(texts)
    got = {}
    for g in groups(column, table):
        for d in range(g.n_docs):
            got[g.first + d] = g.hash[g.doc == d]
    one = next(groups(pa.array(["aé b"]), table)).hash
    assert (got[0] == np.tile(one, 300_000)).all()
    assert len(got[1]) == 1 and len(got[2]) == 0 and len(got[3]) == 2


def test_quality_fit_is_the_same_however_rows_are_dealt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.train(x, labels, max_positives=40, max_unlabelled=60) for x in (docs, docs.repartition(3, "n_chars")))
    assert (a.weight == b.weight).all() and (a.bias, a.prior) == (b.bias, b.prior)


def test_attribution_takes_texts_together_and_keeps_what_recurs(monkeypatch):
    with open(RANKS, "rb") as f:
        own = bpe.Codec(bpe.read_ranks(f.read()), public_tokenizers.PATTERN, "")
    known, fresh, encode = attribution._Lengths(own), [], own.encode_bytes
    monkeypatch.setattr(attribution, "REMEMBERED", 3)
    monkeypatch.setattr(own, "encode_bytes", lambda data: fresh.append(data) or encode(data))
    for i in range(40):  # one piece recurs among others that don't
        start, stop, first, base = attribution.token_spans(known, ["né", "", f"né{'x' * (i + 1)} né"])
        assert base.tolist() == [0, 2, 2, 2 + 2 + i + 1 + 3] and first[1] == first[2] and stop[-1] == base[-1] and (start < stop).all()
    assert fresh.count(" né".encode()) == 1
