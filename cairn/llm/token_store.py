"""Token-ID output: Parquet files of token ids, written in document order and read back selectively.

Rows are dealt out by ranges of doc_id before they are encoded, so a file holds one stretch of ids in ascending order.
The ids are a list column with dictionary pages (a vocabulary fits one page; past that the version 2 pages fall back
to delta encoding); row groups and pages are small enough for the column and offset indexes to serve a range of documents or the metadata
columns alone without reading the rest.

Nulls count as empty texts, and an empty text is stored as the end id alone; repeated ids are stored in order of text;
null ids come first; extra columns are not stored; an empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import give_back_memory

#: Layout of the files: bytes of a row group, rows of a page (what one entry of the page indexes covers), bytes of a dictionary.
LAYOUT = {
    "parquet.block.size": 16 << 20,
    "parquet.page.row.count.limit": 1000,
    "parquet.page.size": 1 << 20,
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.writer.version": "v2",
    "compression": "snappy",
}
#: Chunks that a worker remembers and their bytes, chunks encoded at once, and bytes of text after which rows are handed on: they bound memory alone.
MEMO_ENTRIES = 350_000
MEMO_BYTES = 64_000_000
CHUNKS_AT_ONCE = 2_000
FLUSH_BYTES = 3_000_000

#: The kind of vocabulary whose texts can be cut: lower case, white space dropped, every digit alone, runs of letters and of other characters, words marked at their ends.
CUT_KIND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "end": "</w>",
}
#: Classes of bytes: white space, letters (of Latin-1 the two bytes together), digits, ASCII punctuation, the apostrophe, all others.
_SPACE, _LETTER, _DIGIT, _PUNCTUATION, _QUOTE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _PUNCTUATION
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[39] = _QUOTE
#: Between which classes a text is cut: where no rule of the vocabulary reaches across. An apostrophe may belong to the letters after it.
_CUT = np.zeros((6, 6), bool)
_CUT[_LETTER, [_DIGIT, _PUNCTUATION, _QUOTE]] = True
_CUT[_DIGIT, [_LETTER, _DIGIT, _PUNCTUATION, _QUOTE]] = True
_CUT[_PUNCTUATION, [_LETTER, _DIGIT]] = True
_CUT[_QUOTE, _DIGIT] = True
_CUT[_SPACE, :] = True
_CUT[:, _SPACE] = True
#: The same as tables for bytes.translate: of a byte's class, of 6 * one class + the next, and the blanks.
_CLASS_TABLE, _CUT_TABLE = _CLASS.tobytes(), _CUT.tobytes().ljust(256, b"\0")
_BLANKS = np.flatnonzero(_CLASS == _SPACE).astype(np.uint8).tobytes()


def can_cut(content: str) -> bool:
    """Whether a tokenizers file is of CUT_KIND, so that chunks of a text have the ids that they have in the text."""
    d = json.loads(content)
    pre = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = pre[0].get("pattern", {}).get("Regex") == CUT_KIND["split"] and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
    rest = [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre[1:]] == [("ByteLevel", False, False)]
    model = d["model"]
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == CUT_KIND["end"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
    named = all(x["content"].startswith("<|") and not x["normalized"] for x in d.get("added_tokens", []))
    return d.get("normalizer") == CUT_KIND["normalizer"] and split and rest and plain and named and not d.get("post_processor") and not d.get("truncation")


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts, with an empty one after each text; how many chunks the texts up to and with each have). texts: no nulls."""
    raw, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw, offsets = raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
    plain = bytearray(raw)
    kind = np.frombuffer(plain.translate(_CLASS_TABLE), np.uint8)
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.ones(len(raw), bool)
    begins[1:] = np.frombuffer((kind[:-1] * np.uint8(6) + kind[1:]).tobytes().translate(_CUT_TABLE), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    blank = kind == _SPACE
    begins &= ~blank
    ends = offsets[1:] - np.searchsorted(np.flatnonzero(blank), offsets[1:])
    starts = np.flatnonzero(begins)
    starts -= np.cumsum(blank, dtype=np.int32)[starts]
    upto = np.searchsorted(starts, ends)
    at = np.r_[np.insert(starts, upto, ends), ends[-1:]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(plain.translate(None, _BLANKS))]), upto + np.arange(1, len(ends) + 1)


class ChunkEncoder:
    """Encodes whole texts with a tokenizers vocabulary. Texts are cut where its rules allow (see can_cut), and the ids of chunks are remembered; texts of other vocabularies, and texts that name a special token, go to the library whole."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(content)
        self.cuts = can_cut(content)
        self.end_id = -1
        self.known: _Memo | dict = {}
        self.old: _Memo | dict = {}
        if self.cuts:
            # The same model behind no rules but white space: for words that the rules leave as they are.
            d = json.loads(content)
            d["normalizer"], d["pre_tokenizer"]["pretokenizers"][0] = None, {"type": "WhitespaceSplit"}
            self.bare = Tokenizer.from_str(json.dumps(d))
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(CUT_KIND["end"])]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """(an order of the chunks, the ids of the chunks in that order)."""
        lengths = np.diff(_offsets(chunks))
        bare = _bare(chunks)
        order = [np.flatnonzero(lengths == 0), np.flatnonzero(bare), np.flatnonzero(~bare & (lengths > 0))]
        ids, ends = [np.full(len(order[0]), self.end_id, np.int32)], [np.arange(len(order[0]) + 1)]
        words, rest = (chunks.take(pa.array(x)) for x in order[1:])
        for i in range(0, len(words), CHUNKS_AT_ONCE):
            some = words[i : i + CHUNKS_AT_ONCE]
            ids.append(np.array(self.bare.encode_batch_fast([_joined(some)], add_special_tokens=False)[0].ids, np.int32))
            ends.append(np.flatnonzero(self.ends[ids[-1]]) + 1 + ends[-1][-1])
            if len(ends[-1]) != len(some):
                raise ValueError("words and their ends differ in number")
        for i in range(0, len(rest), CHUNKS_AT_ONCE):
            some = rest[i : i + CHUNKS_AT_ONCE]
            got = self.tokenizer.encode(_joined(some), add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            at = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(got.offsets))
            letters = pc.utf8_length(some.cast(pa.string())).to_numpy(zero_copy_only=False)
            ends.append(np.searchsorted(at, np.cumsum(letters + 1)) + ends[-1][-1])
        return np.concatenate(order), pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(ids)))

    def _ids(self, chunks: pa.Array) -> pa.ListArray:
        """The ids of distinct chunks."""
        if self.known and (len(self.known) > MEMO_ENTRIES or self.known.nbytes > MEMO_BYTES):  # what is asked for again comes over from the old ones
            self.old, self.known = self.known, {}
        self.known = self.known or _Memo()
        hashes = _hashes(chunks)
        place = self.known.find(hashes, chunks)
        missing = np.flatnonzero(place < 0)
        if len(missing) and self.old:
            there = self.old.find(hashes[missing], chunks.take(pa.array(missing)))
            again = missing[there >= 0]
            place[again] = self.known.add(hashes[again], chunks.take(pa.array(again)), self.old.ids.take(pa.array(there[there >= 0])))
            missing = missing[there < 0]
        if len(missing):
            order, ids = self._learn(chunks.take(pa.array(missing)))
            missing = missing[order]
            place[missing] = self.known.add(hashes[missing], chunks.take(pa.array(missing)), ids)
        return self.known.ids.take(pa.array(place))

    def encode_batch(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """A list of ids for each text (null: empty), the end id last."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        named = _named(texts) if self.cuts else np.ones(len(texts), bool)
        end = end_id.to_bytes(4, "little")
        if named.all():
            return _lists([self._whole(t) + end for t in texts.to_pylist()])
        # The vocabulary lowers letters itself; A-Z are lowered here so that chunks are known again.
        plain = pc.if_else(pa.array(named), "", texts) if named.any() else texts
        chunks, upto = cut(pc.ascii_lower(plain))
        coded = chunks.dictionary_encode()
        if end_id != self.end_id:  # an empty chunk's id
            self.end_id, self.known, self.old = end_id, {}, {}
        ids = self._ids(coded.dictionary).take(coded.indices)
        offsets = ids.offsets.to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, offsets[upto]], pa.int32()), ids.values)
        if not named.any():
            return lists
        whole = _lists([self._whole(t) + end for t in texts.filter(pa.array(named)).to_pylist()])
        place = np.where(named, len(lists) + np.cumsum(named) - 1, np.arange(len(lists)))
        return pa.concat_arrays([lists, whole]).take(pa.array(place))


def _named(texts: pa.Array) -> np.ndarray:
    """Which texts may name a special token."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]]
    return np.asarray(pc.match_substring(texts, "<|")) if bytes(raw).find(b"<|") >= 0 else np.zeros(len(texts), bool)


def _offsets(binary: pa.Array) -> np.ndarray:
    return np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]


def _bytes(binary: pa.Array) -> np.ndarray:
    """The bytes that an array's offsets count into."""
    return np.frombuffer(binary.buffers()[2] or b"", np.uint8)


def _joined(chunks: pa.Array) -> str:
    """The chunks with a space between each two."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks.cast(pa.string())), " ")[0].as_py()


def _bare(chunks: pa.Array) -> np.ndarray:
    """Which chunks are bare words: what the vocabulary's rules leave as it is and take for one word, a-z and the lower letters of Latin-1."""
    at = _offsets(chunks)
    raw = _bytes(chunks)[: at[-1]]
    odd = (raw < 97) | (raw > 122)
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] >= 0x9F) & (raw[lead + 1] <= 0xBF) & (raw[lead + 1] != 0xB7)]
    odd[lead] = odd[lead + 1] = False
    before = np.searchsorted(np.flatnonzero(odd), at)
    return (before[1:] == before[:-1]) & (at[1:] > at[:-1])


def _hashes(chunks: pa.Array) -> np.ndarray:
    """A number for each chunk, of its length and its first and last eight bytes: chunks that share one are told apart by their bytes."""
    at = _offsets(chunks).astype(np.int64)
    raw = np.zeros(at[-1] + 16, np.uint8)
    raw[8:-8] = _bytes(chunks)[: at[-1]]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    lengths = np.diff(at).astype(np.uint64)
    spare = np.uint64(8) * (np.uint64(8) - np.minimum(lengths, np.uint64(8)))
    first, last = eight[at[:-1] + 8], eight[at[1:]]
    first = np.where(lengths > 0, (first << spare) >> spare, np.uint64(0))
    last = np.where(lengths > 0, last >> spare, np.uint64(0))
    h = first * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = (h + last * np.uint64(0xC2B2AE3D27D4EB4F) + lengths) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Memo:
    """Chunks and their ids in flat arrays, found by their hashes and compared byte by byte."""

    def __init__(self) -> None:
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int32)  # by hash: where its chunk stands
        self.chunks, self.ids = pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))

    def __len__(self) -> int:
        return len(self.chunks)

    @property
    def nbytes(self) -> int:
        return self.chunks.nbytes + self.ids.nbytes

    def find(self, hashes: np.ndarray, chunks: pa.Array) -> np.ndarray:
        """Where each chunk stands, or -1."""
        if not len(self):
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.searchsorted(self.hashes, hashes[order])
        at[at == len(self.hashes)] = 0
        place = np.where(self.hashes[at] == hashes, self.places[at], -1).astype(np.int64)
        there = np.flatnonzero(place >= 0)
        same = pc.equal(self.chunks.take(pa.array(place[there])), chunks.take(pa.array(there)))
        place[there[~same.to_numpy(zero_copy_only=False)]] = -1
        return place

    def add(self, hashes: np.ndarray, chunks: pa.Array, ids: pa.ListArray) -> np.ndarray:
        """Where the chunks, which are not here yet, stand from now on. Of chunks with one hash the first is found again."""
        place = len(self) + np.arange(len(chunks))
        self.chunks, self.ids = pa.concat_arrays([self.chunks, chunks]), pa.concat_arrays([self.ids, ids])
        new, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, new)
        fresh = np.ones(len(new), bool)
        inside = at < len(self.hashes)
        fresh[inside] = self.hashes[at[inside]] != new[inside]
        self.hashes = np.insert(self.hashes, at[fresh], new[fresh])
        self.places = np.insert(self.places, at[fresh], place[first[fresh]])
        return place


def _lists(ids: list[bytes]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


_encoders: dict[int, ChunkEncoder] = {}


def write_tokens(df: DataFrame, vocabulary: str, end_id: int, path: str, text: str = "text") -> None:
    """Writes shard, row, doc_id, n_tokens, ids for every row of df to Parquet files at path, ascending by doc_id. vocabulary is the content of a tokenizers file, broadcast as it is (its size is the vocabulary's)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, flushes = hash(shared.value), 0, 0
        if key not in _encoders:
            _encoders[key] = ChunkEncoder(shared.value)
        encoder = _encoders[key]
        for batch in batches:
            begin = 0
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            while begin < batch.num_rows:
                stop = int(max(begin + 1, np.searchsorted(lengths, (lengths[begin - 1] if begin else 0) + FLUSH_BYTES)))
                part = batch.slice(begin, stop - begin)
                lists = encoder.encode_batch(part.column(1), end_id)
                sizes = pc.list_value_length(lists).cast(pa.int64())
                rows = pa.array(np.arange(row, row + len(lists)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), rows, sizes, lists], ["doc_id", "shard", "row", "n_tokens", "ids"])
                row, begin, flushes = row + len(lists), stop, flushes + 1
                if flushes % 4 == 0:
                    give_back_memory()

    ordered = df.select("doc_id", F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("shard", F.spark_partition_id())
    ordered.mapInArrow(work, "doc_id bigint, shard int, row bigint, n_tokens bigint, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored rows, or those with doc_id from first to last: the bounds reach the row groups' and pages' statistics, and only the columns asked for are read."""
    out = spark.read.schema("doc_id bigint, shard int, row bigint, n_tokens bigint, ids array<int>").parquet(path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out


def token_starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds start to rows of a store (with shard, row and n_tokens): how many ids stand before each document in the whole store; sums of shards, then of the rows in a shard. The shards, not the rows, are summed in one task."""
    sums = stored.groupBy("shard").agg(F.sum("n_tokens").alias("words"))
    before = W.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, "shard").withColumn("start", F.col("offset") + F.col("within")).drop("offset", "within")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a store, all from its files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "shard", "row", "n_tokens", "ids_crc32"])

    sums = read_tokens(spark, path).select("doc_id", "shard", "row", "ids").mapInArrow(crc, "doc_id bigint, shard int, row bigint, n_tokens bigint, ids_crc32 bigint")
    return token_starts(sums, read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
