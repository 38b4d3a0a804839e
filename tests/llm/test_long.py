"""Texts of ten million bytes, and copies of them, in every operator on documents."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from cairn.llm import bpe, fmindex, licences, mixing, quality, setsketch, suffixes, token_store
from tests.llm.test_small import docs

SIZE = 10_000_000


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    parts = [f"{rnd.choice(['the', 'of', 'Word', 'né', 'x,'])}{rnd.randint(0, 10**6)}" for _ in range(SIZE // 9)]
    parts[500:500] = licences.full_texts()["mit"][0].split()
    long = " ".join(parts)
    assert len(long.encode()) >= SIZE
    return [(1, "a short text of a few words"), (2, long), (3, "start " + long), (4, "z" * SIZE), (5, None)]


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "d")
    docs(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


def test_substrings(spark, table, rows):
    words = {r.doc_id: r for r in fmindex.digests(table).collect()}
    n = len(rows[1][1].split())
    assert (words[2].n_words, words[2].n_removed, words[3].n_words, words[3].n_removed) == (n, n, n + 1, n)
    assert words[3].kept_sha256 == hashlib.sha256(b"start").hexdigest() and words[1].n_removed == 0 and words[4].n_removed == 0
    got = {r.doc_id: r for r in suffixes.digests(table).collect()}
    size = len(rows[1][1].encode())
    assert (got[2].n_removed, got[3].n_removed, got[3].n_spans) == (0, size, 1) and got[3].kept_sha256 == hashlib.sha256(b"start ").hexdigest()
    assert got[4].n_removed == 0 and got[4].n_bytes == SIZE  # a smaller document is needed, not another place


def test_tokens(spark, table, rows, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.PrefixBPE.from_tiktoken(raw, public_tokenizers.PATTERN).ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.token_digests(bpe.encode_documents(table.where("doc_id < 3"), raw, public_tokenizers.PATTERN, decoded="decoded")).collect()}
    ids = theirs.encode_ordinary(rows[1][1])
    assert got[2].n_tokens == len(ids) and got[2].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert got[2].decoded_sha256 == hashlib.sha256(rows[1][1].encode()).hexdigest()
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        token_store.write_tokens(table.where("doc_id < 3"), f.read(), 2, f"{tmp_path}/t")
    stored = {r.doc_id: r for r in token_store.token_digests(spark, f"{tmp_path}/t").collect()}
    ids = [*Tokenizer.from_file(path).encode(rows[1][1], add_special_tokens=False).ids, 2]
    assert stored[2].n_tokens == len(ids) and stored[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_other_operators(spark, table, rows):
    got = {r.doc_id: r for r in setsketch.near_duplicates(table, 2).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 2, 2, 4, 5] and got[4].n_shingles == 1 and got[5].n_shingles == 0
    pieces, sizes = mixing.mix(table, [5.0, 2.0, 1.0], 3, 64)
    taken = {r.doc_id: r for r in mixing.taken(pieces, sizes).collect()}
    assert taken[2].size == len(rows[1][1].split()) and all(0 <= r.taken <= 3 * r.size for r in taken.values())
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r for r in quality.classify(table, quality.fit(table, labels)).collect()}
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores.values())
    found = {r.doc_id: r for r in licences.scan_documents(table).collect()}
    assert found[2].licences == "mit" and found[3].licences == "mit" and found[4].n_notices == 0
