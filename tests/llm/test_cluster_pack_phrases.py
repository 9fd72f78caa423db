"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelake.llm import lloyd, packing, phrases
from framelake.llm import queries as registered
from framelake.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- 11


def plain_lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) < lloyd.LARGEST for x in v)]
    centres = [v for _, v in sorted((x for x in kept if x[0] is not None), key=lambda x: (sha(f"1:{x[0]}"), x[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centres)]
    got = [(i, *reversed(near(v))) for i, v in kept]
    each = Counter()
    for _, j, d in got:
        each[j] += d
    return Counter((i, j, d, each[j], sum(each.values()), sha(",".join(map(str, centres[j])))) for i, j, d in got)


@pytest.mark.parametrize("k,width", [(5, 3), (40, 8), (3, 2)])
def test_lloyd(spark, k, width):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, [9.5] * 8), (7, [9.5] * 8), (None, [0.25] * 8), (200, None), (201, [1.0] * 7), (202, [None] + [1.0] * 7), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [1e30] * 8), (206, [1e5] * 8), (207, [0.0] * 8), (208, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, chunk string").repartition(3)
    got = Counter(map(tuple, lloyd.lloyd(df, k=k, dims=8, width=width).collect()))
    assert got == plain_lloyd(rows, k, 3, 8)


def test_lloyd_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert lloyd.lloyd(spark.createDataFrame([], kind), dims=2).collect() == []
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = Counter(map(tuple, lloyd.lloyd(spark.createDataFrame(rows, kind), dims=2).collect()))
    assert got == plain_lloyd(rows, 16, 3, 2)
    with pytest.raises(ValueError):
        lloyd.lloyd(spark.createDataFrame(rows, kind), k=1 << 20)


# ---- 12


def plain_ids(texts, end=2):
    t = Tokenizer.from_file(WORDS)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def check_packing(rows, texts, ids, size):
    """Every id lies in one piece, pieces lie gapless in sequences, and nothing is padded but for a power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, at in rows:
        pieces[doc].append((start, length, crc, total))
        sequences[sequence].append((at, length))
    assert set(pieces) == set(range(len(texts)))
    for doc, own in pieces.items():
        at = 0
        for start, length, crc, total in sorted(own):
            assert start == at and length > 0 and total == len(ids[doc])
            assert crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[doc])
    sizes = []
    for own in sequences.values():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        sizes.append(at)
    assert max(sizes) <= size
    odd = [x for x in sizes if x != size]
    assert len(odd) == len(set(odd)) and all(x & (x - 1) == 0 for x in odd)


ODD = [
    None, "", " ", "\n\t ", "one", "ÁB ć ́x", "ᄀ ᅡᆨ ë", "a\x1cb\x85c\xa0d e", "it's we'LL I'd", "İstanbul ΣΑΣ ς",
    "<|endoftext|> and <|startoftext|>", "\x00 nul\x00", "x" * 5000, "漢字 かな 한글", "🙂🙂 👩‍👩‍👧", "wort " * 3000, "12 345 6.7", "\r\n\v\f q",
]


@pytest.mark.parametrize("size,windows,parts", [(64, 3, 1), (64, 2, 40), (100, 16, 5), (4096, 16, 3)])
def test_packing(spark, size, windows, parts):
    rng = random.Random(size + parts)
    letters = "abc ABC  \n'.é́ß1漢"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, start int, _open int").repartition(parts)
    got = packing.pack(docs, WORDS, size=size, windows=windows)
    rows, ids = got.collect(), plain_ids(texts)
    check_packing([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows], texts, ids, size)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length] for r in rows)


def test_packing_edges(spark):
    kind = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], kind), WORDS).collect() == []
    assert packing.pack(spark.createDataFrame([(1, None), (None, "")], kind), WORDS, end=None).collect() == []
    same = spark.createDataFrame([(None, "twice told")] * 2 + [(1 << 60, None)], kind)
    rows = packing.pack(same, WORDS, ids=False).collect()
    assert sum(r.length for r in rows) == 2 * len(plain_ids(["twice told"])[0]) + 1 and "ids" not in rows[0]
    assert {r.doc_id for r in rows} == {None, 1 << 60}
    with pytest.raises(ValueError):
        packing.pack(same.withColumn("start", same.doc_id), WORDS, keep=["start"])
    text = "<|endoftext|>"
    as_text = packing.pack(spark.createDataFrame([(1, text)], kind), WORDS, special_as_text=True, end=None).collect()
    assert sum(r.length for r in as_text) > 1


def test_words_are_encoded_alone_as_in_the_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)  # texts are taken apart
    encoder, plain = packing.Encoder(WORDS, False), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300, 0x370), rng.randrange(0xA0, 0x3100), rng.randrange(0xAC00, 0xD7A4), 32, 10, 9])) for _ in range(rng.randrange(120)))
        assert [x.tolist() for x in encoder.encode([text, "", text])] == [plain.encode(x, add_special_tokens=False).ids for x in (text, "", text)]
    monkeypatch.setattr(packing, "MOST_WORDS", 3)  # and words are forgotten
    texts = ODD[1:] * 2
    assert [x.tolist() for x in encoder.encode(texts)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_letters_recur_with_other_marks_and_in_capitals(monkeypatch):
    encoder, plain, seen = packing.Encoder(WORDS, False), Tokenizer.from_file(WORDS), []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched()
    text = "wortel, Wortel. WORTEL!? Größe größe; wortel's Жук жук..."
    assert [x.tolist() for x in encoder.encode([text])] == [plain.encode(text, add_special_tokens=False).ids]
    assert Counter(re.findall(r"\w{3,}", " ".join(seen))) == {"wortel": 2, "größe": 1, "жук": 1}  # once more with 's
    seen.clear()
    assert [x.tolist() for x in encoder.encode(["WORTEL. größe?!"])] == [plain.encode("WORTEL. größe?!", add_special_tokens=False).ids]
    assert seen == ["?!"] or seen == []


def test_letters_and_marks_of_all_kinds():
    encoder, plain = packing.Encoder(WORDS, False), Tokenizer.from_file(WORDS)
    text = " ".join(w for c in (*range(33, 0x590), *range(0x1E00, 0x2200), *range(0xFB00, 0xFB50)) for w in (f"{chr(c)}", f"n{chr(c)}.", f"{chr(c)}A!\"", f"ä{chr(c)}я'"))
    words = text.split(" ")
    assert [x.tolist() for x in encoder.encode(words)] == [x.ids for x in plain.encode_batch(words, add_special_tokens=False)]
    assert next(encoder.encode([text])).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_query(spark):
    rows = registered.op12_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    place = {r.doc_id: i for i, r in enumerate(docs)}
    texts = [r.text for r in docs]
    check_packing([(place[r.doc_id], r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows], texts, plain_ids(texts), 4096)


# ---- 13


def plain_phrases(rows, least, longest, top, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, longest + 1):
                    if i + m <= len(w):
                        f[lang, tuple(w[i : i + m])] += 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cands.items():
        within = any(k == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (k, q), b in cands.items())
        if not within:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return Counter((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def talk(seed):
    rng = random.Random(seed)
    vocab = "the of and New York City élan Ä a\x00b don't x 漢字".split(" ")
    fixed = ["New York City", "the City of New York", "of the", "élan vital the x"]
    rows = []
    for i in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(rng.randrange(60))]
        rows.append(("".join(p + rng.choice([" ", "  ", "\t", ", ", "\n", ". "]) if rng.random() < 0.9 else p + " " for p in parts), rng.choice(["en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("!!! ,", "en"), ("one", "zz"), ("no no " * 5000, "en"), ("w" * 3000 + " the", "en")] + [("exact same old line of words", "en")] * 30


@pytest.mark.parametrize("budget,least_groups", [(100_000, 256), (1, 7), (20, 1)])
def test_phrases(spark, monkeypatch, budget, least_groups):
    monkeypatch.setattr(phrases, "LEAST_GROUPS", least_groups)
    monkeypatch.setattr(phrases, "AT_ONCE", 500 * budget)  # tasks hand on what they have counted more than once
    rows = talk(budget)
    docs = spark.createDataFrame([(t, k, 3, "z") for t, k in rows], "text string, lang string, n int, phrase string").repartition(3)
    for percent, top in ((100, 40), (50, 1000)):
        got = Counter(map(tuple, phrases.collocations(docs, least=12, top=top, percent=percent, budget=budget).collect()))
        assert got == plain_phrases(rows, 12, 5, top, percent)
        assert got


def test_prefixes_are_extended(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_GROUPS", 4)
    tree = spark.createDataFrame([("en", f"a b {i % 3} {i}", 1) for i in range(90)] + [("en", "a b", 4), ("en", "q r", 5)], "lang string, path string, n long")
    out = phrases.grouped(tree, 5, 1000)
    assert {r.path: r.depth for r in out.collect()} == {f"a b {i % 3} {i}": 4 for i in range(90)} | {"a b": 3, "q r": 1}
    assert out.groupBy("group").count().agg({"count": "max"}).first()[0] < 60


def test_long_thresholds_and_short_phrases(spark):
    docs = spark.createDataFrame([("a b a b c " * 200, "en"), ("a b", None)], "text string, lang string")
    for least, longest in ((300, 5), (250, 2), (200, 3)):
        got = Counter(map(tuple, phrases.collocations(docs, least=least, longest=longest).collect()))
        assert got == plain_phrases([tuple(r) for r in docs.collect()], least, longest, 2000)


def test_phrases_of_nothing(spark):
    kind = "text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], kind)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b c", "en"), (None, None)], kind)).collect() == []


# ---- SQL


@pytest.mark.parametrize("name", ["op11_sharded_lloyd", "op13_phrases"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registered.queries()[name](spark, SF)
    got = Counter(map(tuple, df.collect()))
    want = Counter(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall())
    assert got == want and got
