"""Every stage of the corpus pipeline against brute force: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from cairn.llm import mixing, quality
from tests.llm.test_small import _components, _removed_words, _shingles, docs

GOOD = ["the", "cat", "sat", "Down", "here.", "And", "then", "went", "home", "again"]


def _text(rnd, n=60):
    return " ".join(rnd.choice(GOOD) + str(rnd.randint(0, 400)) for _ in range(n))


def _corpus(seed=2):
    rnd = random.Random(seed)
    base = [_text(rnd) for _ in range(12)]
    rows = []
    for i in range(48):
        w = base[i % 12].split()
        for _ in range(i // 12 % 3):
            w[rnd.randrange(len(w))] = f"other{rnd.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "short"), (103, "short"), (104, "short"), (None, base[3]), (None, _text(rnd)), (7, _text(rnd)), (105, base[2] + " " + _text(rnd, 50))]
    return rows


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _labels(spark, sf, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return str(sf)


@pytest.fixture
def stages():
    yield dict(p.STAGES)
    p._scope.mark = None


def test_stages_keep_columns_and_empty_tables(spark, tmp_path, stages):
    sf = _labels(spark, tmp_path, [(0, 1, 0), (1, 0, 0)])
    d = docs(spark, _corpus()).withColumn("score", F.lit("x")).withColumn("terms", F.lit("y")).withColumn("slot", F.lit(1)).withColumn("same", F.lit(2)).withColumn("words", F.lit(3))
    for name, stage in stages.items():
        out = stage(spark, d, sf)
        none = stage(spark, d.limit(0), sf)  # a stage deletes what the one before it wrote
        if name == "bpe_encoding":
            assert out.columns == ["doc_id", "source", "n_tokens", "ids"]
        else:
            assert out.columns == p.COLUMNS and dict(out.dtypes) == {c: t for c, t in d.dtypes if c in p.COLUMNS}
        assert none.columns == out.columns and none.count() == 0


def test_classify(spark, tmp_path, stages):
    rnd = random.Random(5)
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "###", "99%"]) for _ in range(40))
    rows = [(i, bad() if i % 4 == 0 else _text(rnd)) for i in range(200)] + [(300, None), (301, ""), (302, _text(rnd)), (302, _text(rnd)), (None, _text(rnd)), (None, bad())]
    sf = _labels(spark, tmp_path, [(i, int(i % 4 > 0), 0) for i in range(0, 200)] + [(3, None, 0)])
    d = docs(spark, rows)
    voters = quality.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted(str(r) for r in rows if float(voters.score(quality.terms(r[1])[None])[0].round(6)) >= quality.CUT)
    assert sorted(map(str, _rows(stages["quality_classifier"](spark, d, sf)))) == want
    kept = {t for _, t in rows if str((_, t)) in want}
    assert sum(t in kept for i, t in rows if i is not None and i < 200 and i % 4) >= 145 and sum(t in kept for i, t in rows if i is not None and i < 200 and i % 4 == 0) <= 3


def test_near_dedup_keeps_one_row_of_each_group(spark, stages):
    for rows in (_corpus(), [r for r in dict(_corpus()).items() if r[0] is not None]):
        sets = [_shingles(t, 5) for _, t in rows]
        links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        at = _components(len(rows), links)
        got = _rows(stages["minhash_near_dedup"](spark, docs(spark, rows), ""))
        assert len(got) == len(set(at))
        left = list(got)
        for group in set(at):
            members = [rows[i] for i in range(len(rows)) if at[i] == group]
            ids = [i for i, _ in members if i is not None]
            kept = [r for r in left if r in members and r[0] == (min(ids) if ids else None)]
            assert kept
            left.remove(kept[0])
        assert not left


def test_substring_dedup(spark, stages):
    rows = _corpus()
    want = []
    for (i, t), (_, _, gone, _) in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), sorted(_removed_words([(-1 if i is None else i, t) for i, t in rows])), strict=True):
        want.append((i, gone))
    got = stages["substring_dedup"](spark, docs(spark, rows), "").collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r.text)
        assert r.text is None or r.n_chars == len(r.text)
    for i, t in rows:
        if not sum(g for k, g in want if k == i):
            assert t in texts[i]  # as it was, white space included
    kept = {i: sum(len((t or "").split()) for t in ts) for i, ts in texts.items()}
    words = {}
    for i, t in rows:
        words[i] = words.get(i, 0) + len((t or "").split())
    for i in words:
        assert kept[i] == words[i] - sum(g for k, g in want if k == i)


def test_mix_stage(spark, stages):
    rows = _corpus()
    d = docs(spark, rows)
    want = mixing.taken(*mixing.mix(d, p.MIX_WEIGHTS, p.MIX_REPEATS, p.MIX_BLOCK_WORDS)).collect()
    got = stages["source_mix"](spark, d, "").collect()
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + len(r.text.split())
        whole = [t for i, t in rows if i == r.doc_id and t and t.split()[: len(r.text.split())] == r.text.split()]
        assert whole and (r.text in whole or r.text == " ".join(r.text.split()))
    sums, target = {}, {}
    for r in want:
        sums[r.source], target[r.source] = sums.get(r.source, 0) + r.taken, r.target
    assert by == {s: n for s, n in sums.items() if n} and all(abs(sums[s] - target[s]) < 1 for s in sums)
    again = _rows(stages["source_mix"](spark, d.repartition(3), ""))  # the first result's tables are gone by now
    assert sorted(map(str, again)) == sorted(str((r.doc_id, r.text)) for r in got)


def test_mix_stage_stands_in_slot_order(spark, tmp_path, stages):
    rnd = random.Random(9)
    d = spark.createDataFrame([(i, _text(rnd, 64), "en", f"s{i % 3}", 1) for i in range(240)], "doc_id long, text string, lang string, source string, n_chars long")
    stages["source_mix"](spark, d, "").coalesce(1).write.parquet(str(tmp_path / "m"))
    order = [r.source for r in spark.read.parquet(str(tmp_path / "m")).collect()]
    share = {s: order.count(s) / len(order) for s in set(order)}
    for n in range(10, 60):  # every beginning is mixed as the whole is
        assert all(abs(order[:n].count(s) - n * share[s]) <= 6 for s in share)


def test_encode(spark, stages):
    import tiktoken

    from cairn.llm.bpe import PrefixBPE

    rows = [*_corpus(), (400, "é 日本 𝄞  \n\n x")]
    got = stages["bpe_encoding"](spark, docs(spark, rows), "").collect()
    with open(p.TOKEN_RANKS, "rb") as f:
        ranks = PrefixBPE.from_tiktoken(f.read(), public_tokenizers.PATTERN).ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(str((i, theirs.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted(str((r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids)))) for r in got) == want


def test_run(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["BUY!!", "$$$", "###"]) for _ in range(40)) if i % 5 == 0 else _text(rnd, 80)) for i in range(100)]
    rows += [(200, rows[1][1]), (201, rows[2][1] + " more"), (202, None), (203, " ".join(f"long{rnd.randint(0, 10**6)}" for _ in range(30_000)))]
    docs(spark, rows).select(*p.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    sf = _labels(spark, tmp_path, [(i, int(i % 5 > 0), 0) for i in range(100)])
    ids = {r.doc_id for r in p.run(spark, sf).collect()}
    assert not ids & {0, 5, 10, 200, 201} and ids >= {1, 2, 3, 4, 6}
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "source_mix", "bpe_encoding"]
