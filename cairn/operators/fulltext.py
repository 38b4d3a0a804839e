"""Full-text search: an index of postings, boolean and phrase matching, BM25, snippets, and grep over live text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.search import Clauses, LiveTerms, Terms, parse

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"
#: Words that are sorted at once, and rows of a run that leave together.
WORDS_AT_ONCE = 4_000_000
RUN_ROWS = 100_000
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"


def tokens(body: Column) -> Column:
    """Runs of letters and digits in lower case; no stemming, no stop words. Runs of CJK letters, which have no blanks, are taken apart from others and become overlapping pairs, so that any word of two letters or more is found as a phrase of pairs."""
    low = F.lower(body)
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), F.lit(0))

    def pairs(run: Column) -> Column:
        split = F.rlike(run, F.lit(f"^[{CJK}]")) & (F.length(run) > 1)
        return F.when(split, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array(run))

    return F.when(F.rlike(body, F.lit(f"[{CJK}]")), F.flatten(F.transform(runs, pairs))).otherwise(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))


def token_stats(docs: DataFrame) -> DataFrame:
    """n_docs, n_tokens, n_terms, longest (characters)."""
    t = docs.select("file_id", F.explode(tokens(F.col("body"))).alias("term"))
    per_term = t.groupBy("term").agg(F.count("*").alias("n"))
    sums = per_term.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_terms"), F.coalesce(F.max(F.length("term")), F.lit(0)).alias("longest"))
    return docs.agg(F.count("*").alias("n_docs")).join(F.broadcast(sums))  # one row


@dataclass
class TextIndex:
    """postings: term, file_id, tf, dl (words of the document), positions (ascending); terms: term, df, n; corpus: one row of n (documents) and avgdl. Kept in order of term (see in_order), a query reads the parts of its words alone."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def postings(docs: DataFrame) -> DataFrame:
    """term, file_id, tf, dl, positions. One row for each word of each document, so a common word is spread over its documents. All words of a document stand in one row, so that they are grouped without a shuffle: words are numbered in their order and sorted with their places, WORDS_AT_ONCE together, so that the rows of a task are runs in order of term and document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            n = np.diff(batch.column("t").offsets.to_numpy())
            for begin, stop in _bounds(n):
                more = int(n[begin:stop].sum())
                if held and words + more > WORDS_AT_ONCE:
                    yield from _run(held)
                    held, words = [], 0
                held.append(batch.slice(begin, stop - begin))
                words += more
        if held:
            yield from _run(held)

    t = docs.select(F.col("file_id").cast("long").alias("file_id"), tokens(F.col("body")).alias("t")).where("t is not null")
    return t.mapInArrow(work, "term string, file_id bigint, tf bigint, dl int, positions array<int>")


def _run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of some documents in order of term and document, in parts of RUN_ROWS."""
    ids = pa.concat_arrays([b.column("file_id") for b in batches])
    order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
    lists = pa.concat_arrays([b.column("t") for b in batches])
    if (order[1:] < order[:-1]).any():
        ids, lists = ids.take(pa.array(order)), lists.take(pa.array(order))
    dl = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    names = words.dictionary
    by_name = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    names = names.take(pa.array(by_name))
    key = rank[words.indices.to_numpy(zero_copy_only=False)] << 32 | np.arange(len(words))  # word, then document and place
    del words, lists
    key.sort()
    at = key & 0xFFFFFFFF
    word = (key >> 32).astype(np.int32)
    doc = np.repeat(np.arange(len(dl), dtype=np.int32), dl)[at]
    pos = (at - (np.cumsum(dl) - dl)[doc]).astype(np.int32)
    del key, at
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[first, len(doc)]
    for k in range(0, len(first), RUN_ROWS):
        e = ends[k : k + RUN_ROWS + 1]
        f, d = e[:-1], doc[e[:-1]]
        places = pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), pa.array(pos[e[0] : e[-1]]))
        columns = [names.take(pa.array(word[f])), ids.take(pa.array(d)), pa.array(np.diff(e), pa.int64()), pa.array(dl[d], pa.int32()), places]
        yield pa.RecordBatch.from_arrays(columns, ["term", "file_id", "tf", "dl", "positions"])


def _bounds(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows that hold about WORDS_AT_ONCE words together, or one row."""
    sums, begin = np.cumsum(n, dtype=np.int64), 0
    while begin < len(n):
        stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + WORDS_AT_ONCE, "right")))
        yield begin, stop
        begin = stop


def in_order(rows: DataFrame) -> DataFrame:
    """Postings of several makings (see updated) sorted by term and document in each file, for row groups and pages whose statistics tell their terms. They are sorted where they lie and not shuffled; those of postings() are runs in that order as they come."""
    return rows.sortWithinPartitions("term", "file_id")


def term_counts(index: DataFrame) -> DataFrame:
    """term, df, n of postings."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def terms_in_order(index: DataFrame) -> DataFrame:
    """term_counts() sorted by term in each file; they lie dealt by term already."""
    return term_counts(index).sortWithinPartitions("term")


def word_counts(docs: DataFrame) -> DataFrame:
    """term, df, n of documents, without postings: words are counted before they are shuffled."""
    t = docs.select("file_id", F.explode(tokens(F.col("body"))).alias("term"))
    return t.groupBy("term", "file_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def corpus_row(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """n, avgdl: documents, and their mean number of words."""
    words = terms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    return docs.agg(F.count("*").alias("n")).join(F.broadcast(words)).select("n", F.try_divide(F.col("words").cast("double"), F.col("n").cast("double")).alias("avgdl"))  # one row


def build(docs: DataFrame) -> TextIndex:
    """The index of documents (file_id, body), not kept."""
    p = postings(docs)
    terms = term_counts(p)
    return TextIndex(p, terms, corpus_row(docs, terms))


def updated(index: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings after a change: without those of the documents in `gone` (file_id) and in docs, with docs' own. Documents that did not change are not read again."""
    out = gone.select("file_id").unionByName(docs.select("file_id"))
    return index.join(out, "file_id", "left_anti").unionByName(postings(docs))


def _words(tree: Terms | Clauses) -> set[str]:
    return set(tree.words) if isinstance(tree, Terms) else set().union(*(_words(p) for _, p in tree.parts))


def _scored_words(tree: Terms | Clauses) -> set[str]:
    if isinstance(tree, Terms):
        return set(tree.words)
    return set().union(*(_scored_words(p) for kind, p in tree.parts if kind != "must_not"))


def _holds(tree: Terms | Clauses, at: Column) -> Column:
    """Whether a document matches, from its map of words to positions (the query's words alone)."""
    if isinstance(tree, Terms):
        first = F.try_element_at(at, F.lit(tree.words[0]))
        if len(tree.words) == 1:
            return first.isNotNull()

        def followed(p: Column) -> Column:
            out = F.lit(True)
            for k, w in enumerate(tree.words[1:], 1):
                out = out & F.coalesce(F.array_contains(F.try_element_at(at, F.lit(w)), p + F.lit(k)), F.lit(False))
            return out

        return F.coalesce(F.exists(first, followed), F.lit(False))
    must = [_holds(p, at) for kind, p in tree.parts if kind == "must"]
    should = [_holds(p, at) for kind, p in tree.parts if kind == "should"]
    must_not = [_holds(p, at) for kind, p in tree.parts if kind == "must_not"]
    out = F.lit(bool(must or should))  # negation alone matches nothing
    for c in must:
        out = out & c
    if should and not must:
        any_of = F.lit(False)
        for c in should:
            any_of = any_of | c
        out = out & any_of
    for c in must_not:
        out = out & ~c
    return out


def _phrase_words(tree: Terms | Clauses) -> set[str]:
    if isinstance(tree, Terms):
        return set(tree.words) if len(tree.words) > 1 else set()
    return set().union(*(_phrase_words(p) for _, p in tree.parts))


def search(index: TextIndex, query: str, limit: int | None = 10) -> DataFrame:
    """file_id, score: the best `limit` in order, ties by file_id, or all without order. Only postings and counts of the query's words are read, positions only of words in phrases, and postings meet once by document; scores are BM25 over exact lengths, to six digits. Counts of documents per word and the corpus are at most a row for each word of the query."""
    tree = parse(query)
    words, phrases = sorted(_words(tree)), sorted(_phrase_words(tree))
    asked = F.col("term").isin(words)
    df = index.terms.where(asked).select("term", "df")
    scored = F.col("term").isin(sorted(_scored_words(tree)))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    nowhere = F.array().cast("array<int>")
    positions = F.when(F.col("term").isin(phrases), F.col("positions")).otherwise(nowhere) if phrases else nowhere
    rows = index.postings.where(asked).select("term", "file_id", "tf", "dl", positions.alias("positions"))
    rows = rows.join(F.broadcast(df), "term").join(F.broadcast(index.corpus.select("n", "avgdl")))
    rows = rows.withColumn("part", F.when(scored, idf * tf).otherwise(F.lit(0.0)))
    docs = rows.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.sum("part").alias("total"))
    out = docs.where(_holds(tree, F.col("at"))).select("file_id", F.round("total", 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "file_id").limit(limit)


def resolve(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with the path that their file has now; `gone` for tombstones and unknown ids."""
    now = files.select("file_id", "path", "deleted_at")
    gone = F.col("path").isNull() | F.col("deleted_at").isNotNull()
    return hits.join(now, "file_id", "left").withColumn("gone", gone).drop("deleted_at")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring in text that is in lower case already."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))


def grep_score(body: Column, terms: LiveTerms) -> Column:
    """How often a live text has the required and optional words, as substrings without ASCII case; 0 unless it has every required one, one at least in all, and no excluded one."""
    low = ascii_lower(body)
    has = lambda w: F.contains(low, F.lit(w))
    ok = F.lit(bool(terms.required or terms.optional))
    for w in terms.required:
        ok = ok & has(w)
    if not terms.required and terms.optional:
        some = F.lit(False)
        for w in terms.optional:
            some = some | has(w)
        ok = ok & some
    for w in terms.excluded:
        ok = ok & ~has(w)
    total = F.lit(0.0)
    for w in terms.body_terms:
        total = total + occurrences(low, w)
    return F.when(F.coalesce(ok, F.lit(False)), total.cast("long")).otherwise(F.lit(0).cast("long"))


def snippet(body: Column, words: list[str], max_chars: int = 160) -> Column:
    """The text around the first of the words, white space as single blanks, with an ellipsis where it is cut; the head where none occurs."""
    text = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))
    low = ascii_lower(text)
    found = [F.nullif(F.locate(w, low), F.lit(0)) for w in words]
    first = F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("int")
    start = F.greatest(F.coalesce(first - 1, F.lit(0)) - max_chars // 3, F.lit(0))
    cut = F.substr(text, start + 1, F.lit(max_chars))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(start + max_chars < F.length(text), F.lit("…")).otherwise(F.lit("")))


def without_kerning_blanks(body: Column) -> Column:
    """Blanks between two CJK characters go, as in text extracted from PDF."""
    cjk = "[　-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿＀-￯]"
    return F.regexp_replace(body, f"(?<={cjk}) +(?={cjk})", "")


def long_runs_broken(text: str, limit: int = 32 << 10) -> tuple[str, int]:
    """(text, breaks): no run over `limit` bytes without newline, tab or the CJK full stop and comma; the last blank in a run becomes a newline, else one is put in between two characters. For analyzers that search a lattice."""
    out, breaks = [], 0
    for found in re.finditer("[^\n\t。、]*[\n\t。、]|[^\n\t。、]+", text):
        run = found.group().encode()
        begin = 0
        while len(run) - begin > limit:  # what is left is not copied for each piece
            end = begin + limit
            while run[end] & 0xC0 == 0x80:  # not inside a character
                end -= 1
            at = max(run.rfind(b" ", begin, end), run.rfind(b"\r", begin, end))
            breaks += 1
            out += [run[begin : at if at > begin else end], b"\n"]
            begin = at + 1 if at > begin else end
        out.append(run[begin:] if begin else run)
    return b"".join(out).decode(), breaks


def recall_precision(found: DataFrame, truth: DataFrame) -> DataFrame:
    """n_found, n_true, n_both, recall, precision of two sets of file_id."""
    both = found.select("file_id", F.lit(1).alias("f")).join(truth.select("file_id", F.lit(1).alias("t")), "file_id", "full_outer")
    sums = both.agg(F.count("f").alias("n_found"), F.count("t").alias("n_true"), F.count(F.col("f") * F.col("t")).alias("n_both"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    return sums.withColumn("recall", share("n_both", "n_true")).withColumn("precision", share("n_both", "n_found"))


def top_terms(counts: DataFrame, limit: int = 20) -> DataFrame:
    """term, df, n: the words in most documents, from term_counts() or word_counts()."""
    return counts.orderBy(F.desc("df"), F.desc("n"), "term").limit(limit)
