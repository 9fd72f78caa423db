"""The pipeline against its stages by brute force, on a few documents."""

import base64
import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from framelake.llm import decontaminate, near_dup, quality

from .test_operators import VOCAB, slow_pii, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    base, leak = words(rng, 90), " ".join(f"{rng.choice(VOCAB)}{i}" for i in range(14))
    rows = []
    for i in range(120):
        t = words(rng, rng.randrange(30, 120)).capitalize() + "."
        if i % 10 == 1:
            t = base + (f" end{i}" if i % 20 == 1 else "")
        elif i % 10 == 2:
            t = " ".join(w.upper() + "!!" for w in t.split())  # junk
        elif i % 10 == 3 and i > 60:
            t = words(rng, 20) + " " + leak + " " + words(rng, 20)
        elif i % 10 == 4:
            t += f" write to a{i}@mail.example.com or +1 (988) 555-{1000 + i}."
        rows.append((i, t if i != 119 else None, "en", f"s{i % 3}", len(t)))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 2), 0) for i in range(0, 120, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "no such passage here at all in any of the documents of it")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def redacted(text):
    spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in slow_pii(text)))
    order = ["email", "ip", "card", "phone"]
    spans.sort(key=lambda x: (x[0], x[1], order.index(x[2])))
    out, at = "", 0
    for s, e, k in spans:
        if s >= at:
            out += text[at:s] + f"[{k}]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = [r.asDict() for r in docs.collect()]
        if name != "bpe":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        stages.append(sorted(rows, key=lambda r: r["doc_id"]))
    scored, unique, clean, private, coded = stages
    everything = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in scored}
    junk = {i for i in everything if i % 10 == 2}
    assert len(kept & junk) <= 3 and len(kept - junk) >= 105, (kept & junk, len(kept))
    assert all(r["text"] == everything[r["doc_id"]] for r in scored)
    want = [d for d, _, _, keep in near_dup.brute_force([(r["doc_id"], r["text"]) for r in scored]) if keep]
    assert [r["doc_id"] for r in unique] == sorted(want) and len(want) < len(scored)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [x[0] for x in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in unique], bench) if not x[5]]
    assert [r["doc_id"] for r in clean] == want and len(want) < len(unique)
    for before, after in zip(clean, private):
        want = None if before["text"] is None else redacted(before["text"])
        assert after["text"] == want
        assert after["n_chars"] == (None if want is None else len(want))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for before, after in zip(private, coded):
        ids = enc.encode_ordinary(before["text"] or "")
        assert after["ids"] == ids and after["n_tokens"] == len(ids)
        assert after["decoded_sha256"] == hashlib.sha256((before["text"] or "").encode()).hexdigest()
    assert re.fullmatch("[0-9a-f]{64}", coded[0]["ids_sha256"])
    assert quality.MAX_POSITIVES > 0


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    assert 0 < got.count() < 120


EXTRA = {"score": "1.5", "n_words": "'w'", "n_hit": "2L", "items_sha256": "'i'", "base": "'b'", "_row": "3", "added_spans": "'a'", "component_id": "'c'"}


def test_stages_keep_clashing_columns_and_rows_without_words(spark, folder):
    """Null, empty and very long texts, null ids, repeated rows, extra columns named like results, empty tables."""
    long = " ".join(f"w{i}" for i in range(60_000))
    odd = [(1, "One two three four five six. " * 3), (1, "One two three four five six. " * 3), (2, None), (3, ""), (None, "Seven eight nine ten eleven."), (None, "Seven eight nine ten eleven."), (4, long), (5, long + " end"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    for name, sql in EXTRA.items():
        docs = docs.selectExpr("*", f"{sql} AS {name}")
    want = {"near_dup": [(1, 1), (2, 2), (3, 1), (4, 1), (None, 2)], "decontaminate": None, "pii": None, "quality": None}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        if name == "bpe":
            assert got.count() == len(odd)
        else:
            assert got.columns == docs.columns
            rows = got.collect()
            assert all(r.score == 1.5 and r.n_words == "w" and r.n_hit == 2 and r.items_sha256 == "i" and r.base == "b" and r._row == 3 and r.added_spans == "a" for r in rows)
            ids = [r.doc_id for r in rows]
            counts = sorted(((i, ids.count(i)) for i in set(ids)), key=repr)
            if name == "near_dup":
                assert counts == sorted(want[name], key=repr)
            elif name != "quality":
                assert len(rows) == len(odd)
        assert stage(spark, docs.limit(0), folder).count() == 0
