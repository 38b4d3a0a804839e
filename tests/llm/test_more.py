"""Classifier votes, licence Dice, stored layout and chunk cuts against brute force; ties; clashing columns."""

import glob
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.llm import lattice, licences, quality, setsketch, token_store
from cairn.llm.queries import QUERIES
from tests.llm.test_small import docs


def _vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_chunks_have_the_texts_ids():
    from tokenizers import Tokenizer

    vocabulary = _vocabulary()
    theirs, ours = Tokenizer.from_str(vocabulary), token_store.ChunkEncoder(vocabulary)
    assert ours.cuts
    rnd = random.Random(1)
    letters = [*"ab1é'sÀ. ,\t\n　\x85́日x<|>_-…ıİßſªº·×÷²½ǅ̸‍𝄞", "<|endoftext|>", "'ll", "'re", "\x01", "\xa0", "É", "≠", "don't"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    got = [ids for i in range(0, 6000, 500) for ids in ours.encode_batch(pa.array(texts[i : i + 500]), 2).to_pylist()]
    assert got == [[*e.ids, 2] for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert ours.encode_batch(pa.array([None, "", "x"]).slice(0, 2), 2).to_pylist() == [[2], [2]]
    ours.known, token_store_memo = {}, token_store.MEMO_ENTRIES
    try:
        token_store.MEMO_ENTRIES = 5  # chunks are forgotten and found again
        assert [ids for i in range(0, 1000, 50) for ids in ours.encode_batch(pa.array(texts[i : i + 50]), 2).to_pylist()] == got[:1000]
    finally:
        token_store.MEMO_ENTRIES = token_store_memo


def test_remembered_chunks_are_no_objects():
    import gc
    import sys

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(20_000)]
    ours = token_store.ChunkEncoder(_vocabulary())
    ours.encode_batch(pa.array(["some words"]), 2)
    gc.collect()
    before = sys.getallocatedblocks()
    first = ours.encode_batch(pa.array([" ".join(words)]), 2)
    gc.collect()
    assert sys.getallocatedblocks() - before < len(words) / 2
    assert ours.encode_batch(pa.array([" ".join(words)]), 2).equals(first)


def test_chunks_of_one_hash_and_other_end_ids(monkeypatch):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_str(_vocabulary()), token_store.ChunkEncoder(_vocabulary())
    texts = [f"abcdefgh{x}stuvwxyz, {x}" for x in ("one", "two", "six", "", "one", "\xdf\xe9", "\xc9!")] + ["", "a" * 5000, "six"]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    hashes = token_store._hashes(pa.array([b"abcdefghonestuvwxyz", b"abcdefghtwostuvwxyz", b"", b"a"]))
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 3
    for end, bound in ((2, 64_000_000), (2, 64_000_000), (7, 64_000_000), (7, 10), (7, 10), (2, 10)):
        monkeypatch.setattr(token_store, "MEMO_BYTES", bound)
        assert ours.encode_batch(pa.array(texts), end).to_pylist() == [[*ids, end] for ids in want]
        assert ours.encode_batch(pa.array(texts[1:2]), end).to_pylist() == [[*want[1], end]]
    monkeypatch.setattr(token_store, "_hashes", lambda chunks: np.zeros(len(chunks), np.uint64))
    ours.known, ours.old = {}, {}
    for _ in range(3):
        assert ours.encode_batch(pa.array(texts), 2).to_pylist() == [[*ids, 2] for ids in want]


def test_other_vocabularies_are_not_cut():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        other = f.read()
    assert not token_store.can_cut(other)
    from tokenizers import Tokenizer

    text = "Some words, and 12.5 more  of them"
    assert token_store.ChunkEncoder(other).encode_batch(pa.array([text]), 7).to_pylist() == [[*Tokenizer.from_str(other).encode(text, add_special_tokens=False).ids, 7]]


def test_stored_layout(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", f"w{rnd.randint(0, 999)}"]) for _ in range(40))) for i in range(6000)]
    token_store.write_tokens(docs(spark, rows), _vocabulary(), 2, f"{tmp_path}/t")
    before = -1
    for f in sorted(glob.glob(f"{tmp_path}/t/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(c).path for c in range(meta.num_columns)]
        ids, key = next(i for i, n in enumerate(names) if n.startswith("ids")), names.index("doc_id")
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            assert group.total_byte_size <= 2 * token_store.LAYOUT["parquet.block.size"]
            assert group.column(ids).has_dictionary_page and group.column(ids).has_column_index and group.column(ids).has_offset_index
            s = group.column(key).statistics
            assert before < s.min <= s.max
            before = s.max
    some = token_store.read_tokens(spark, f"{tmp_path}/t", 10, 12).select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "LessThanOrEqual(doc_id,12)" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert some.count() == 3


def _naive_terms(text):
    shape = []
    for c in (text or "").encode():
        x = "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else "a" if c >= 128 or 97 <= c <= 122 else chr(c)
        if not shape or shape[-1] != x:
            shape.append(x)
    out = np.zeros(quality.TERMS)
    for k in (1, 2, 3):
        for i in range(len(shape) - k + 1):
            code = sum(ord(shape[i + j]) << (8 * j) for j in range(k)) + (k << 24)
            out[(code * 0x9E3779B97F4A7C15 % 2**64) >> 54] += 1
    return np.sqrt(out / out.sum()) if out.sum() else out


def test_quality_equals_a_plain_vote(spark):
    rnd = random.Random(8)
    kinds = [lambda: "The cat sat. " * rnd.randint(1, 4), lambda: "BUY NOW!! " * rnd.randint(1, 4), lambda: "x" * rnd.randint(1, 9), lambda: "12 % $$ ", lambda: "The cat sat. "]
    rows = [(i, rnd.choice(kinds)()) for i in range(160)] + [(500, None), (501, ""), (502, "The cat sat. ")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    voters = quality.fit(d, labels)
    got = {r.doc_id: r.score for r in quality.score_documents(d.select("doc_id", "text"), voters).collect()}
    for i, t in rows:
        assert np.allclose(quality.terms(t), _naive_terms(t), atol=1e-6)
        z = quality.terms(t) @ voters.projection
        if not np.linalg.norm(z):
            assert got[i] == round(float(voters.labels.mean()), 6)
            continue
        cosine = [float(v @ (z / np.linalg.norm(z))) for v in voters.vectors]
        near = sorted(range(len(cosine)), key=lambda k: (-round(cosine[k], 6), k))[: quality.NEIGHBOURS]
        weight = [max(cosine[k], 0) ** quality.POWER for k in near]
        # Equal texts have equal vectors: of a crowd of them the first ones vote.
        assert got[i] == pytest.approx(sum(w * voters.labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight), abs=0.07)


def test_nearest_takes_the_earlier_of_equal_ones():
    c = np.array([[0.5] * 40 + [0.9, 0.1], list(np.linspace(0, 1, 42)), [0.0] * 42])
    assert quality.nearest(c, 15).tolist() == [[*range(14), 40], [*range(27, 42)], [*range(15)]]
    rnd = np.random.RandomState(1)
    x = rnd.randint(0, 6, (200, 60)) / 6
    assert (quality.nearest(x, 9) == np.sort(np.argsort(-x, axis=1, kind="stable")[:, :9], axis=1)).all()


def _dice(text, grams):
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    mine = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    return (2 * len(mine & set(grams)) / (len(mine) + len(grams)), len(mine)) if mine else (0, 0)


def test_licence_units_equal_plain_dice(spark):
    rnd = random.Random(4)
    known = licences.template_bigrams()
    notices = [n for ns in licences.TEMPLATES.values() for n in ns]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            words = rnd.choice(notices).split()
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(words))
                words[k : k + 1] = rnd.choice([[], ["odd"], [words[k], "more"], [words[k].upper()]]) or []
                words = words or ["x"]
            lines.append(rnd.choice([" ", "  ", "\t"]).join(words) + rnd.choice(["", ".", " !"]))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "\n\n"), (904, notices[0])]
    got = {(r.doc_id, r.unit): (r.licence, round(r.dice, 9)) for r in licences.scan(docs(spark, rows).select("doc_id", "text")).collect()}
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        for unit, body in [*enumerate(lines, 1), *([(0, t)] if len(lines) > 1 else [])]:
            scored = [(-_dice(body or "", g)[0], name) for name, g in known if len(g) * (2 / 3) - 1e-9 <= _dice(body or "", g)[1] <= len(g) * 1.5 + 1e-9]
            if scored and -min(scored)[0] >= 0.8:
                want[i, unit] = (min(scored)[1], round(-min(scored)[0], 9))
    assert got == want and len(want) > 60


def test_every_match_has_a_mark():
    rnd = random.Random(7)
    t = licences.THRESHOLD
    every = [(b, t / (2 - t)) for _, b in licences.template_bigrams()] + [(b, t) for _, b in licences.template_bigrams(licences.HEADERS) + licences.template_bigrams(licences.full_texts())]
    some = licences.marks(every)
    assert 0 < len(some) < 60
    has = lambda grams: any(w in g if len(w) >= 5 else w in g.split() for g in grams for w in some)
    for grams, share in every:
        least = int(np.ceil(share * len(grams) - 1e-9))
        unmarked = [g for g in grams if not has([g])]
        assert len(unmarked) < least  # no subset that matches lacks all marks
        assert all(has(rnd.sample(grams, least)) for _ in range(20))
    assert licences.marks([(["of the", "the of"], 0.5)]) == []  # then every text may match


def test_licence_recall_in_running_text(spark):
    rnd = random.Random(11)
    noise = lambda n: " ".join(rnd.choice("this is quite another text without any of that law in it and so on with words".split()) for _ in range(n))
    notices = [(name, n) for name, ns in licences.TEMPLATES.items() for n in ns]
    rows, want = [], []
    for i in range(len(notices) * 3):
        name, n = notices[i % len(notices)]
        words = n.split()
        at = 60 // 8
        wrapped = "\n".join(" ".join(words[k : k + at]) for k in range(0, len(words), at))
        rows.append((i, f"{noise(rnd.randint(0, 30))} {wrapped if i % 2 else n} {noise(rnd.randint(0, 30))}"))
        want.append(name)
    rows.append((10_000, noise(300)))
    got = {r.doc_id: r.licences.split(",") for r in licences.scan_documents(docs(spark, rows)).collect()}
    assert sum(want[i] in got[i] for i in range(len(want))) >= 0.9 * len(want) and got[10_000] == [""]


def test_ties_and_clashing_columns(spark):
    v = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    rows = [(i, v[i % 2], i, i, "x", 2) for i in range(40)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, member long, cell long, same string, n int")).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(0, 19), (1, 19)} and sum(r.kept for r in got) == 2
    d = docs(spark, [(i, "equal words in all of these rows") for i in range(30)]).withColumn("member", F.lit(1)).withColumn("registers", F.lit(2)).withColumn("component", F.lit(3))
    assert {(r.component_id, r.n_shingles) for r in setsketch.near_duplicates(d, 2).collect()} == {(0, 6)}
    tie = docs(spark, [(1, "Licensed under the MIT License.\nReleased under the MIT License."), (2, "Licensed under CC BY 4.0.")]).withColumn("unit", F.lit(1)).withColumn("grams", F.lit(2)).withColumn("known", F.lit(3))
    assert sorted((r.doc_id, r.n_notices, r.licences) for r in licences.scan_documents(tie).collect()) == [(1, 2, "mit"), (2, 1, "cc-by-4.0")]


def test_crowds_meet_blockwise(spark, monkeypatch):
    """A group of near copies larger than a block, with a second group that its members meet but do not all resemble."""
    from cairn.llm import cells

    rnd = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rnd.sample(range(100), i % 14):
            w[k] = f"n{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    want = sorted(map(tuple, setsketch.near_duplicates(docs(spark, rows), 2).collect()))
    monkeypatch.setattr(cells, "BLOCK", 16)
    assert sorted(map(tuple, setsketch.near_duplicates(docs(spark, rows), 2).collect())) == want
    e = np.random.RandomState(5).randn(3, 16)
    vectors = [(i, (e[i % 3] + 0.05 * np.random.RandomState(i).randn(16)).tolist()) for i in range(90)]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    small = sorted(map(tuple, lattice.near_duplicates(d).collect()))
    monkeypatch.setattr(cells, "BLOCK", 1024)
    assert sorted(map(tuple, lattice.near_duplicates(d).collect())) == small


def test_queries_are_whole(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_fm_index_dedup", "op4_token_store", "op9_licence_scan", "op10_setsketch_duplicates"):
        assert QUERIES[name](spark, sf_dir).count() == n


def test_no_shared_folder_is_an_error():
    from types import SimpleNamespace as N

    from cairn.llm.common import shared_dir

    held = N(getCheckpointDir=lambda: N(isDefined=lambda: False))
    with pytest.raises(ValueError):
        shared_dir(N(conf=N(get=lambda key, default: default), sparkContext=N(master="spark://host:7077", _jsc=N(sc=lambda: held))))
