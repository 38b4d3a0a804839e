"""Operators against brute force on small inputs with nulls, empty and repeated rows, and clashing extra columns."""

import base64
import hashlib
import itertools
import math
import random
import struct
import zlib
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, fmindex, lattice, licences, mixing, quality, setsketch, suffixes, token_store, topk
from cairn.llm.components import connected_components
from cairn.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

TEXT = "doc_id long, text string, lang string, source string, n_chars long, row int, cell int, ids string, kept string"


def docs(spark, rows):
    """rows of (doc_id, text) with columns that clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 4 else None, len(t or ""), 1, 2, "x", "y") for i, t in rows], TEXT)


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    words = ["ab", "cd", "éf", "gh!", "日本", "x", "the", "of"]
    passage = " ".join(rnd.choice(words) + str(k) for k in range(60))
    out = []
    for i in range(n):
        body = [rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 120))]
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()[: rnd.randint(30, 60)]
        out.append((i, " ".join(body)))
    out += [(100, None), (101, ""), (102, "  \n"), (103, out[5][1]), (104, out[5][1]), (105, "a a " * 60), (106, "z" * 200), (107, out[5][1] + " end"), (108, "one"), (109, "one"), (110, "\t".join(["q"] * 36))]
    return out


def test_bpe_equals_the_library(spark):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ours = bpe.PrefixBPE.from_tiktoken(raw, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rnd = random.Random(1)
    letters = "ab é\n\t  　\x1c\x85'sS1.,!日本中 𝄞-_"
    for _ in range(1500):
        x, y = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, k))) for k in (30, 6))
        assert ours.encode(x).tolist() == theirs.encode_ordinary(x)
        text = ours.start(x)
        text.append(y)
        assert text.ids() == theirs.encode_ordinary(x + y)
        a = rnd.randint(0, len(text.text))
        b = rnd.randint(a, len(text.text))
        z = text.text[:a] + y + text.text[b:]
        text.edit(a, b, y)
        assert text.text == z and text.ids() == theirs.encode_ordinary(z)
    rows = corpus()
    got = {r.doc_id: r for r in bpe.token_digests(bpe.encode_documents(docs(spark, rows), raw, public_tokenizers.PATTERN, decoded="decoded")).collect()}
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    again = bpe.decode_documents(bpe.encode_documents(docs(spark, rows), raw, public_tokenizers.PATTERN), raw, public_tokenizers.PATTERN)
    assert again.where(F.decode("decoded", "UTF-8") != F.coalesce("text", F.lit(""))).count() == 0
    assert bpe.encode_documents(docs(spark, rows).limit(0), raw, public_tokenizers.PATTERN).count() == 0


def test_bpe_small_vocabulary_has_unreachable_tokens():
    ranks = {bytes([c]): c for c in range(256)} | {b"bc": 256, b"ab": 257, b"abcd": 258, b"aa": 259}
    ours = bpe.PrefixBPE(ranks, r"\S+|\s+")
    assert b"abcd" not in ours.merged
    for word in (b"abcd", b"aaa", b"aabcab", b"bcbcaab"):
        assert ours.encode_piece(word) == ([ranks[word]] if word in ranks else ours.merge(word))
    assert base64.b64encode(b"bc") == b"YmM="


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    tok = Tokenizer.from_file(path)
    rows = [*corpus(), (200, "İstanbul ΣΑΣ é é <|endoftext|> A<|STARTOFTEXT|>.b it's, we'll. 3.14,5")]
    out = f"{tmp_path}/tokens"
    token_store.write_tokens(docs(spark, rows), vocabulary, 2, out)
    got = {r.doc_id: r for r in token_store.token_digests(spark, out).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    some = token_store.read_tokens(spark, out, 5, 8)
    assert sorted(r.doc_id for r in some.collect()) == [5, 6, 7, 8]
    token_store.write_tokens(docs(spark, rows).limit(0), vocabulary, 2, f"{tmp_path}/none")
    assert token_store.token_digests(spark, f"{tmp_path}/none").count() == 0


def _removed_words(rows, width=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen: dict = {}
    for _, w in words:
        for a in range(len(w) - width + 1):
            seen[tuple(w[a : a + width])] = seen.get(tuple(w[a : a + width]), 0) + 1
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if seen[tuple(w[a : a + width])] > 1:
                gone[a : a + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_fm_index_dedup(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in fmindex.digests(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == _removed_words(rows)
    twice = [*rows, rows[7], (None, rows[5][1]), (7, "other text " * 20)]
    got = fmindex.digests(docs(spark, twice)).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == _removed_words([(-1 if i is None else i, t) for i, t in twice])
    assert fmindex.digests(docs(spark, rows).limit(0)).count() == 0


def test_matching_statistics():
    rnd = np.random.RandomState(4)
    passage = rnd.randint(1, 6, 40)
    s = np.r_[rnd.randint(1, 6, 150), 0, passage, 0, passage[5:30], rnd.randint(1, 6, 60), 0, np.full(70, 3), 0]
    several = np.zeros(len(s), bool)
    several[151:191] = True
    index = fmindex.FMIndex(s, several)
    assert (fmindex.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:].tolist())).all()

    def count(p):
        hits = [i for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all()]
        return sum(1 + bool(several[i]) for i in hits)

    foreign = np.r_[passage[10:25], 0, rnd.randint(1, 6, 40), -1, passage[:20]]
    for stream, least in ((s, 2), (foreign, 1), (foreign, 2)):
        for most in (5, 12):
            got = index.matching_statistics(stream, least, most)
            for e in range(len(stream)):
                k = 0
                while k < most and e - k >= 0 and stream[e - k] > 0 and count(stream[e - k : e + 1]) >= least:
                    k += 1
                assert got[e] == k
    assert len(index.heads) < len(s)  # runs are fewer than symbols


def test_suffix_dedup(spark):
    rows = corpus()
    seen: dict = {}
    want = []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if seen.get(b[a : a + 50], i) < i:
                gone[a : a + 50] = b"\1" * 50
        for a in range(len(b) - 49):
            seen.setdefault(b[a : a + 50], i)
        spans = sum(1 for a in range(len(b)) if gone[a] and (not a or not gone[a - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = suffixes.digests(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want
    twice = suffixes.digests(docs(spark, [*rows, rows[5]])).where("doc_id = 5").collect()
    assert len(twice) == 2 and len({r.kept_sha256 for r in twice}) == 1  # rows of one id remove nothing from each other
    assert suffixes.digests(docs(spark, rows).limit(0)).count() == 0


def test_radix_groups():
    rnd = np.random.RandomState(2)
    text = rnd.randint(97, 99, 500).astype(np.uint8)
    starts = np.arange(480)
    got = suffixes.equal_windows(text, starts, 20)
    whole = [text[s : s + 20].tobytes() for s in starts]
    for i in range(0, 480, 7):
        same = [j for j in range(480) if whole[j] == whole[i]]
        assert (got[i] == -1) == (len(same) == 1)
        assert [j for j in range(480) if got[j] == got[i] and got[i] >= 0] == (same if len(same) > 1 else [])


def _components(n, links):
    at = list(range(n))
    for _ in range(n):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_connected_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 79), rnd.randint(0, 79)) for _ in range(60)] + [(i, i + 1) for i in range(40, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert [got.get(i, i) for i in range(80)] == _components(80, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_setsketch_duplicates(spark, k):
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(20, 90))] for _ in range(8)]
    rows = []
    for i in range(90):
        w = list(base[i % 8])
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 999)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, "solo"), (203, "SOLO"), (204, "two words")]
    sets = [_shingles(t, k) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    at = _components(len(rows), links)
    got = {r.doc_id: r for r in setsketch.near_duplicates(docs(spark, rows), k).collect()}
    for n, (i, _) in enumerate(rows):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[n]), rows[at[n]][0], at[n] == n)
    assert setsketch.near_duplicates(docs(spark, rows).limit(0), k).count() == 0
    repeated = setsketch.near_duplicates(docs(spark, [*rows, rows[3], (3, "quite another text")]), k)
    assert repeated.where("doc_id = 3").count() == 3


def test_setsketch_links_of_repeated_and_null_ids(spark):
    w, v, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "wvu")
    rows = [(1, w), (1, v), (2, w + " x"), (3, v + " y"), (None, u), (None, u + " z"), (None, "apart from all"), (7, u)]
    got = setsketch.near_duplicates(docs(spark, rows), 2).select("doc_id", "component_id", "kept").collect()
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 7, False), (None, 7, False), (None, None, True), (7, 7, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sketches_merge_and_estimate():
    rnd = np.random.RandomState(3)
    a, b = (np.unique(rnd.randint(0, 2**62, 900).astype(np.uint64)) for _ in range(2))
    ra, rb, rab = setsketch.sketches([a, b, np.unique(np.r_[a, b])])
    assert (setsketch.merged(ra, rb) == rab).all()
    c = np.unique(np.r_[a[:850], b[:50]])
    rc = setsketch.sketches([c])
    best, keep = setsketch.estimate(ra[None], rc, np.array([len(a)]), np.array([len(c)]))
    true = len(np.intersect1d(a, c)) / len(np.union1d(a, c))
    assert abs(best[0] - true) < 0.12 and keep[0]
    assert not setsketch.estimate(ra[None], rb[None], np.array([900]), np.array([900]))[1][0]


def test_lattice_duplicates(spark):
    rnd = np.random.RandomState(6)
    base = rnd.randn(12, 24)
    rows = [(i, (base[i % 12] + 0.12 * rnd.randn(24)).tolist()) for i in range(90)]
    rows += [(200, None), (201, []), (202, [0.0] * 24), (203, [float("nan")] + [1.0] * 23), (204, [None] + [1.0] * 23), (205, rows[3][1]), (206, [2 * x for x in rows[3][1]]), (207, [1.0, 2.0]), (208, [2.0, 4.0])]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, cell int")).collect()}
    ok = [v if v and None not in v and np.isfinite(v).all() and np.any(v) else None for _, v in rows]
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and len(ok[a]) == len(ok[b]) and cos(ok[a], ok[b]) >= 0.95]
    at = _components(len(rows), links)
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.98 * len(links) <= found <= len(links)
    for n, (i, _) in enumerate(rows):
        assert got[i].n_links <= sum(n in p for p in links)
        assert got[i].component_id == rows[at[n]][0] and got[i].kept == (at[n] == n)
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lattice_links_null_ids(spark):
    a, b, c = [1.0] + [0.0] * 8, [0.0] * 8 + [1.0], [0.0, 1.0] + [0.0] * 7
    rows = [(None, a), (None, a), (None, b), (5, [1.0, 1e-6] + [0.0] * 7), (6, c), (7, b)]
    got = [tuple(r) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 5, False), (None, 2, 5, False), (None, 1, 7, False), (5, 2, 5, True), (6, 0, 6, True), (7, 1, 7, True)], key=str)


def test_lattice_counts_links_of_repeated_ids(spark):
    e = np.eye(9)
    a, b = e[0], e[4]
    rows = [(1, a), (1, b), (2, a + 1e-3 * e[1]), (3, b + 1e-3 * e[2]), (None, e[7]), (None, e[7] + 1e-3 * e[8])]
    got = lattice.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_nearest_lattice_point():
    rnd = np.random.RandomState(1)
    y = rnd.randn(200, 8) * 2
    p = lattice.nearest_e8(y)
    assert ((2 * p) == np.rint(2 * p)).all() and (p.sum(axis=1) % 2 == 0).all()
    best = ((y - p) ** 2).sum(axis=1)
    for m in lattice._NEIGHBOURS:
        assert (((y - p - m) ** 2).sum(axis=1) >= best - 1e-9).all()


def test_top_k(spark):
    rnd = np.random.RandomState(9)
    rows = [(i, rnd.randint(-3, 4, 20).astype(float).tolist()) for i in range(220)]
    rows += [(300, None), (400, [1.0, float("inf")]), (500, []), (601, rows[1][1]), (602, rows[1][1]), (700, [1.0, 2.0]), (701, [1.5, 2.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v and np.isfinite(v).all()]
    want = []
    for q, a in ok:
        if q % 100 == 0:
            top = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a)))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(top)]
    assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_dealt(spark, monkeypatch):
    rnd = np.random.RandomState(3)
    rows = [(i % 190, rnd.randint(-3, 4, 12).astype(float).tolist()) for i in range(230)] + [(None, [1.0] * 12), (7, None), (8, [1.0, 2.0]), (9, [2.0, 2.0])]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, chunk int, side int")
    ask = F.col("vec_id") % 5 == 0
    want = sorted(map(tuple, topk.top_k(d, ask).collect()))
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 16)
    monkeypatch.setattr(topk, "RANGE_ROWS", 50)
    assert sorted(map(tuple, topk.top_k(d, ask).collect())) == want and len(want) > 300


def test_top_k_bounds_hold_and_prune():
    rnd = np.random.RandomState(2)
    x, q = np.floor(rnd.randn(300, 37) * 100), np.floor(rnd.randn(37) * 100)
    for n in topk.SEGMENTS:
        bound = topk._segment_statistics(x, n) @ topk._segment_statistics(q[None], n)[0]
        assert (bound >= x @ q - 1e-6).all()


def test_mix(spark):
    rows = corpus()
    d = docs(spark, rows)
    pieces, sizes = mixing.mix(d, [5.0, 2.0, 1.0], 3, 16)
    got = mixing.taken(pieces, sizes).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * max(1, total)
    for v in by.values():
        assert sum(r.taken for r in v) == int(v[0].target + 1e-9) and v[0].source_size == sum(r.size for r in v)
    slots = pieces.groupBy("slot").agg(F.countDistinct("source", "block").alias("n")).where("n > 1").count()
    assert slots == 0
    p1 = sorted(map(tuple, mixing.taken(*mixing.mix(d.repartition(7), [5.0, 2.0, 1.0], 3, 16)).select("doc_id", "taken").collect()))
    assert p1 == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.taken(*mixing.mix(d.limit(0), [5.0, 2.0, 1.0], 3, 16)).count() == 0


def _golden_slots(blocks, n):
    """(source number, its block) of each slot, by exact integers."""
    total, phi = sum(blocks), (Decimal(5).sqrt() - 1) / 2
    ends = list(itertools.accumulate(blocks))
    taken, out = [0] * len(blocks), []
    for s in range(n):
        at = s * phi % 1 * total
        k = next(k for k, e in enumerate(ends) if at < e)
        if taken[k] < blocks[k]:
            out.append((s, k, taken[k]))
        taken[k] += 1
    return out


def test_schedule_is_golden(spark):
    blocks = [700, 1, 230, 69]
    targets = spark.createDataFrame([("a", 700 * 64.0), ("b", 3.0), ("c", 230 * 64.0 - 1), (None, 69 * 64.0), ("d", 0.5)], "source string, target double")
    got = sorted(((r.slot, r.source, r.block) for r in mixing.schedule(targets, 64).collect()), key=lambda r: r[0])
    names = ["a", "b", "c", None]
    assert got == [(s, names[k], b) for s, k, b in _golden_slots(blocks, 2 * sum(blocks) + mixing.SPARE_POINTS)]
    assert len(got) == sum(blocks)  # every block is taken once
    for n in range(1, 600):  # before the first source is used up, every prefix is close to the shares
        for k, name in enumerate(names):
            assert abs(sum(r[1] == name for r in got[:n]) - n * blocks[k] / sum(blocks)) <= 2 + math.log(n)


def test_points_leave_no_gap():
    for blocks in range(1, 400):
        u = np.sort(np.arange(2 * blocks + mixing.SPARE_POINTS) * mixing.GOLDEN % 1)
        assert np.diff(np.r_[u, 1.0]).max() < 1 / blocks


def test_mix_needs_its_schedule(spark, monkeypatch):
    d = docs(spark, corpus())
    monkeypatch.setattr(mixing, "schedule", lambda t, n: t.select(F.lit(0).alias("slot"), "source", F.lit(0).cast("long").alias("block")).where("target >= 1"))
    for r in mixing.taken(*mixing.mix(d, [5.0, 2.0, 1.0], 3, 16)).groupBy("source").agg(F.sum("taken").alias("n")).collect():
        assert r.n <= 16


def test_mix_stage_takes_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    d = docs(spark, [(None, "a b c d"), (None, "e f g"), (4, "x y z w"), (4, "p q r s t u"), (8, "k l m n o")])
    want = sum(r.taken for r in mixing.taken(*mixing.mix(d, p.MIX_WEIGHTS, p.MIX_REPEATS, p.MIX_BLOCK_WORDS)).collect())
    got = p.mix(spark, d, "").collect()
    assert sum(len(r.text.split()) for r in got) == want and {r.doc_id for r in got} == {None, 4, 8}
    assert {" ".join(r.text.split()[:1]) for r in got} == {"a", "e", "x", "p", "k"}


def test_quality(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["the", "cat", "sat", "Down", "here."]) for _ in range(40))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "###"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, "")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(300)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, quality.fit(d, labels)).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
    assert sum(got[i].predicted == bool(i % 3) for i in range(300) if got[i].held_out) >= 0.95 * sum(got[i].held_out for i in range(300))
    none = quality.classify(d, quality.fit(d, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5}


def test_quality_of_repeated_ids(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:6]
    rows = [(ids[0], "BUY!! NOW!! $$$")] * 50 + [(i, "the cat sat down" if k % 2 else "$$$ ###") for k, i in enumerate(ids) if k]
    labels = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    voters = quality.fit(docs(spark, rows), labels, examples=6)
    assert sorted(voters.labels) == [0, 0, 0, 1, 1, 1]


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT licence.\n"), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, ""), (5, "nothing here"), (5, "Licensed under CC BY-NC 4.0."), (6, "GNU General Public License")]
    got = sorted((r.doc_id, r.n_notices, r.licences) for r in licences.scan_documents(docs(spark, rows)).collect())
    assert got == [(1, 0, ""), (2, 1, "apache-2.0"), (3, 0, ""), (4, 0, ""), (5, 0, ""), (5, 1, "cc-by-nc-4.0"), (6, 0, "")]
    assert licences.scan_documents(docs(spark, rows).limit(0)).count() == 0


def test_licences_in_runs(spark):
    mit, gpl3 = licences.full_texts()["mit"][0], licences.full_texts()["gpl-3.0"][0]
    header = "\n".join(["/* This program is free software: you can redistribute it and/or modify", " * it under the terms of the GNU General Public License as published by", " * the Free Software Foundation, either version 3 of the License, or", " * (at your option) any later version. */"])
    code = "\n".join(f"int f{i}(int x{i}) {{ return {i}; }}" for i in range(40))
    shared = "This package is distributed free of charge. Released under the MIT License. See the file for the rest of it."
    rows = [(1, f"The MIT License\n\n{mit}"), (2, f"first line\n{header}\n{code}"), (3, shared), (4, shared + "\n\n" + shared), (5, gpl3), (6, f"first line\n{header.replace('version 3', 'version 2')}\n{code}"), (7, "x Released under the MIT licence."), (8, "Released under the MIT License.\nmore of it\nReleased under the MIT License")]
    got = sorted((r.doc_id, r.n_notices, r.licences) for r in licences.scan_documents(docs(spark, rows)).collect())
    assert [g for g in got if g[0] != 5] == [(1, 1, "mit"), (2, 1, "gpl-3.0"), (3, 1, "mit"), (4, 2, "mit"), (6, 1, "gpl-2.0"), (7, 0, ""), (8, 2, "mit")]
    assert [g[2] for g in got if g[0] == 5] == ["gpl-3.0"]


def test_queries_equal_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in ORACLES.items():
        compare(spark, con, sf_dir, QUERIES[name], sql)


def test_classifier_on_held_out_rows(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has 19 held-out labels
    got = QUERIES["op5_quality_neighbours"](spark, larger)
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
