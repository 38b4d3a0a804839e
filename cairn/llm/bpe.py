"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece the encoding's last token is unique, so one token id per prefix states the whole
encoding: prefix i ends in token t exactly if t is a suffix of the prefix, t comes out of merging its own bytes, and t
may follow the last token of the prefix that it leaves. "May follow" is local: two tokens are compatible if merging
their joined bytes gives back just these two. Appending bytes goes on from the stored table; an edit redoes only
the pieces near it.

Nulls count as empty texts; empty texts have no ids and decode to no bytes; repeated rows are encoded one by one;
extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import give_back_memory

#: Entries after which a worker's memo tables start anew: bounds memory, never results.
MEMO_ENTRIES = 250_000
#: Bytes of text after which a worker hands rows on.
FLUSH_BYTES = 2_000_000


class PrefixBPE:
    """An encoder for one vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self._fits: dict[int, bool] = {}
        self._chunks = _Memo(lambda chunk: np.fromiter(self._encode_chunk(chunk.decode()), "<u4").tobytes())
        self._token_bytes = pa.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)], pa.binary())
        self._pieces = _Memo(lambda piece: tuple(self.encode_piece(piece.encode())))
        # Only a token that its own bytes merge to can come out of merges; others occur as whole pieces alone.
        self.merged = {b: i for b, i in ranks.items() if self.merge(b) == [i]}
        self.longest = max(map(len, self.merged), default=1)
        self._suffixes = ahocorasick.Automaton()
        for b, i in self.merged.items():
            self._suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self._suffixes.make_automaton()

    @classmethod
    def from_tiktoken(cls, content: bytes, pattern: str) -> PrefixBPE:
        rows = (line.split() for line in content.splitlines() if line)
        return cls({base64.b64decode(token): int(rank) for token, rank in rows}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Merges of adjacent parts by lowest rank, leftmost first: the definition that the tables follow."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            at = rank = None
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (rank is None or r < rank):
                    at, rank = i, r
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; remembered."""
        if len(self._fits) >= MEMO_ENTRIES:
            self._fits.clear()
        known = self._fits[a << 32 | b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Continues the table of last tokens (last[0] is unused) to all prefixes of piece. Exact for appended bytes."""
        known, done = self._fits.get, len(last)
        offset = max(0, done - self.longest)
        for at, (t, n) in self._suffixes.iter(piece[offset:].decode("latin-1")):
            # The tokens that end at a prefix come one after another; the one that fits is the only one.
            if at + offset + 1 != done:
                continue
            if n < done:
                before = last[done - n]
                fit = known(before << 32 | t)
                if not (self.fits(before, t) if fit is None else fit):
                    continue
            last.append(t)
            done += 1
        if done != len(piece) + 1:
            raise ValueError("the vocabulary lacks a byte")
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens states."""
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read_back(self.extend(piece, [-1]))

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._pieces.__getitem__, self.pattern.findall(chunk))))

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        return self.encode_batch(pa.array([text])).values.to_numpy().astype("<u4")

    def encode_batch(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (null: none). Texts are cut where the pattern always cuts; of each distinct chunk in the batch the ids are looked up once, and chunks are remembered."""
        self._chunks.bound()
        self._pieces.bound()
        chunks, upto = cut(pc.fill_null(texts.cast(pa.string()), ""))
        coded = chunks.dictionary_encode()
        raw, at = bytes(coded.dictionary.buffers()[2] or b""), np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].tolist()
        ids = [self._chunks[raw[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        known = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        found = known.take(coded.indices)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, found.offsets.to_numpy()[upto]], pa.int32()), found.values)

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        tokens = self._token_bytes.take(ids.values)
        if not len(tokens):
            return pa.array([b""] * len(ids), pa.binary())
        at = np.frombuffer(tokens.buffers()[1], np.int32)[: len(tokens) + 1][ids.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), tokens.buffers()[2]])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def start(self, text: str = "") -> EditableText:
        return EditableText(self, text)


#: White space as Unicode has it, other than ASCII's: the bytes that follow each lead byte.
_WIDE_BLANKS = {0xC2: ("\x85", "\xa0"), 0xE1: ("\u1680",), 0xE2: (*map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f"), 0xE3: ("\u3000",)}
_ASCII_BLANK = np.zeros(256, bool)
_ASCII_BLANK[[*range(9, 14), 32]] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts, how many chunks the texts up to and with each have). A text is cut before each single blank that stands before a non-blank, where the pattern always cuts too. texts: no nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    blank = np.flatnonzero(raw[:-1] == 32)
    after = raw[blank + 1]
    goes = ~_ASCII_BLANK[after]
    padded = np.r_[raw, np.zeros(3, np.uint8)]
    for lead, blanks in _WIDE_BLANKS.items():
        at = np.flatnonzero(after == lead)
        if len(at):
            rest = [x.encode()[1:] for x in blanks]
            code = padded[blank[at] + 2].astype(np.int64) << 8 | (padded[blank[at] + 3] if lead >= 0xE0 else 0)
            goes[at] &= ~np.isin(code, [r[0] << 8 | (r[1] if len(r) > 1 else 0) for r in rest])
    begins = np.zeros(len(raw) + 1, bool)
    begins[blank[goes]] = True
    # A text's last blank stands before nothing, and every text begins a chunk.
    lasts = offsets[1:] - 1
    begins[lasts[(np.diff(offsets) > 0)]] &= raw[lasts[(np.diff(offsets) > 0)]] != 32
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    at = np.r_[starts, len(raw)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))]), np.searchsorted(starts, offsets[1:])


class _Memo(dict):
    """Remembers what make() returns, in a young and an old generation; what is asked for again becomes young."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.pop(key, None)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def bound(self) -> None:
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()


class EditableText:
    """A text with its pieces and ids, kept exact under appends and edits without encoding it all again."""

    def __init__(self, bpe: PrefixBPE, text: str) -> None:
        self.bpe, self.text = bpe, text
        self.starts = [m.start() for m in bpe.pattern.finditer(text)]
        self.tables = [self._table(m.group()) for m in bpe.pattern.finditer(text)]

    def _table(self, piece: str) -> list[int]:
        return self.bpe.extend(piece.encode(), [-1])

    def ids(self) -> list[int]:
        out: list[int] = []
        for i, table in enumerate(self.tables):
            end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
            whole = self.bpe.ranks.get(self.text[self.starts[i] : end].encode())
            out += [whole] if whole is not None else self.bpe.read_back(table)
        return out

    def append(self, more: str) -> None:
        """Adds text at the end; the last piece's table is continued if the piece goes on."""
        if more and self.tables:
            at = self.starts[-1]
            old = self.text[at:]
            first = self.bpe.pattern.match(old + more)
            if first and first.group().startswith(old):
                self.bpe.extend(first.group().encode(), self.tables[-1])
                self.text += more
                self._redo(first.end() + at, len(self.text), len(self.starts), [])
                return
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces text[start:stop]; pieces from two before the edit on are redone until the cuts meet the old ones again."""
        keep = max(0, sum(s < start for s in self.starts) - 2)
        tail = [(s + len(new) - (stop - start), t) for s, t in zip(self.starts, self.tables, strict=True) if s >= stop]
        self.text = self.text[:start] + new + self.text[stop:]
        self._redo(self.starts[keep] if keep < len(self.starts) else 0, start + len(new), keep, tail)

    def _redo(self, at: int, until: int, keep: int, tail: list[tuple[int, list[int]]]) -> None:
        del self.starts[keep:], self.tables[keep:]
        old = {s: k for k, (s, _) in enumerate(tail)}
        for m in self.bpe.pattern.finditer(self.text, at):
            if m.start() >= until + 1 and m.start() in old:
                self.starts += [s for s, _ in tail[old[m.start()] :]]
                self.tables += [t for _, t in tail[old[m.start()] :]]
                return
            self.starts.append(m.start())
            self.tables.append(self._table(m.group()))


_encoders: dict[int, PrefixBPE] = {}


def _encoder(shared, pattern: str) -> PrefixBPE:
    """One encoder for each worker process and vocabulary."""
    content = shared.value
    key = hash((content, pattern))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PrefixBPE.from_tiktoken(content, pattern)
    return _encoders[key]


def encode_documents(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds binary column `ids` (little-endian unsigned 32-bit ids of the whole text) and, if named, `decoded` (the bytes that the ids decode to). ranks is the content of a rank file, broadcast as it is (the vocabulary's size bounds it). A column of df with such a name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    new = [ids, *([decoded] if decoded else [])]
    df = df.drop(*new)
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, flushes = _encoder(shared, pattern), 0
        for batch in batches:
            begin = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(names.index(text))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            while begin < batch.num_rows:
                stop = int(max(begin + 1, np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + FLUSH_BYTES)))
                part = batch.slice(begin, stop - begin)
                got = bpe.encode_batch(part.column(names.index(text)))
                values = got.values.buffers()[1] if len(got.values) else pa.py_buffer(b"")
                raw = pa.Array.from_buffers(pa.binary(), len(got), [None, pa.py_buffer(4 * got.offsets.to_numpy().astype(np.int32)), values])
                yield pa.RecordBatch.from_arrays([*part.columns, raw, *([bpe.decode_batch(got)] if decoded else [])], [*names, *new])
                begin, flushes = stop, flushes + 1
                if flushes % 4 == 0:
                    give_back_memory()

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)
    return df.mapInArrow(work, fields + "".join(f", `{c}` binary" for c in new))


def decode_documents(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds binary column `out`: the bytes of the ids in binary column `ids`. A null decodes to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    df = df.drop(out)
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(shared, pattern)
        for batch in batches:
            got = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(names.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*names, out])

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)
    return df.mapInArrow(work, f"{fields}, `{out}` binary")


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from encode_documents(..., decoded="decoded")."""
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 AS bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
