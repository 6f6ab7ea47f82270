"""Token-ID output: static range asymmetric numeral coding of token blocks.

Texts are tokenised once, with a public vocabulary, and each document ends with id 0. Documents are
range-partitioned by doc_id, so partition p holds the p-th run of the ascending order; each task
cuts its run into blocks of whole documents and codes every block on its own with LANES
interleaved states and the frequency table of its own ids (one entry for each id in use, total
2^SCALE), so no pass over all texts has to come first. A block is one frame of bytes, complete in
itself: frequency table, document index, checkpoints (states, word position and CRC-32 of the ids
up to the next) every GAP steps, and the coded words. Any checkpoint of any frame can be decoded
alone. Frames lie in a table of (shard, block, first, n_tokens, frame) in the shared folder, beside
the number of ids in each shard, and a file is the frames in the order of (shard, block).

Tokenising goes by pieces between single spaces that the vocabulary's pre-tokeniser always
splits at, so each distinct piece is encoded once a worker and looked up afterwards by its 64-bit
hash, checked by a second one of length and both ends; ids equal those of whole texts. A
text that holds an added token of the vocabulary is one piece, so it goes to the tokeniser whole.

Null texts are empty: only the end id. Null doc_ids come first. Rows of one doc_id are documents of
their own, in the order of their texts' hashes; equal rows are alike in any order, so partitions may
cut between them. An empty table gives no frames. A text over 1 MB is a chunk of its own and never
cut, and a block holds at least one document. Only doc_id and text are read, so further columns may
have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, bounded_batches
from .words import chunks, hash_ranges

SCALE, LANES, GAP, BLOCK_TOKENS, END = 18, 2048, 64, 1 << 18, 0
LOW = np.uint64(1 << 31)
HEAD = "<4sHHIIIII"
MAGIC = b"RLT1"
#: Pieces a worker keeps the ids of; beyond them it starts anew.
KEPT_PIECES = 1 << 21


def _classes() -> dict[str, np.ndarray]:
    """Byte classes: ends and begins of what is surely no white space, ASCII letters, ASCII marks but the apostrophe."""
    c = {k: np.zeros(256, bool) for k in ("ends", "begins", "letter", "mark")}
    c["ends"][0x21:0x7F] = c["begins"][0x21:0x7F] = True
    c["begins"][0xC3:0xE0] = True
    for x in range(0x21, 0x7F):
        c["letter"][x] = chr(x).isalpha()
        c["mark"][x] = not chr(x).isalnum() and chr(x) != "'"
    return c


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: rows, lone spaces or line breaks, and where ASCII letters and marks meet.

    The pre-tokeniser takes one space together with what follows, a line break alone as one
    piece, and never letters together with marks other than the apostrophe, whatever stands on
    the far side; so cutting there changes nothing.
    """
    n, c = len(data), _classes()
    starts = np.zeros(n + 1, bool)
    if n > 2:
        letter, mark = c["letter"][data], c["mark"][data]
        starts[1:n] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        ends = c["ends"][data]
        # A continuation byte of a two-byte character from U+00C0 on.
        ends[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        lone = ends[:-2] & c["begins"][data][2:]
        space, line = lone & (data[1:-1] == 32), lone & (data[1:-1] == 10)
        # Not at a row's edge, where the white space may stand alone.
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        inner = ~(first[1 : n - 1] | first[2:n])
        starts[1 : n - 1] |= (space | line) & inner
        starts[2:n] |= line & inner
    starts[offsets] = True
    return np.flatnonzero(starts[:n])


def _letters_only(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranges of one optional space and letters, of ASCII or U+00C0 to U+00FF."""
    letter = _classes()["letter"][data]
    if len(data) > 1:
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[:-1] |= pair
        letter[1:] |= pair
    total = np.concatenate([[0], np.cumsum(letter)])
    size = ends - starts
    return total[ends] - total[starts] == size - ((data[starts] == 32) & (size > 1))


def _looks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second hash of ranges: of length, first and last eight bytes (zeros where a range is shorter)."""
    wide = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(wide[:8].view(np.uint64), (len(data) + 9,), (1,))
    size = (ends - starts).astype(np.uint64)
    cut = np.uint64(8) * (np.uint64(8) - np.minimum(size, np.uint64(8)))
    return (word[starts + 8] << cut) * np.uint64(0x9E3779B97F4A7C15) + (word[ends] >> cut) * np.uint64(0xC2B2AE3D27D4EB4F) + size


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: its own if it is printable in Latin-1, else the next from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Pieces:
    """Ids of distinct pieces, by hash, with the vocabulary's file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.hash, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.look = np.zeros(0, np.uint32), np.zeros(0, np.uint64)

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start; rows that hold an added token are one piece."""
        starts, raw, whole = piece_starts(data, offsets), data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                # One that spans two rows only makes them go whole, too.
                whole.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = raw.find(token, at + 1)
        for row in whole:
            starts = starts[(starts <= offsets[row]) | (starts >= offsets[row + 1])]
        return starts

    def find(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The entries of the pieces from each start to the next."""
        ends = np.append(starts[1:], len(data))
        keys = hash_ranges(data, starts, ends)
        inverse, distinct = pd.factorize(keys)
        at = np.empty(len(distinct), np.int64)
        at[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)
        look = _looks(data, starts, ends)
        if (look != look[at][inverse]).any():
            raise ValueError("two pieces of one hash")
        place = np.searchsorted(self.hash, distinct)
        have = np.zeros(len(distinct), bool)
        inside = place < len(self.hash)
        have[inside] = self.hash[place[inside]] == distinct[inside]
        if (self.look[place[have]] != look[at[have]]).any():
            self.clear()
            return self.find(data, starts)
        if not have.all():
            raw = data.tobytes()
            new = np.flatnonzero(~have)
            new = new[np.argsort(distinct[new])]
            begin, end = starts[at[new]], ends[at[new]]
            if len(self.hash) and len(self.hash) + len(new) > KEPT_PIECES:
                self.clear()
                return self.find(data, starts)
            lists = self.lookup([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], _letters_only(data, begin, end))
            size = np.array([len(x) for x in lists], np.int64)
            first = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.array([i for x in lists for i in x], np.uint32)])
            where = place[new]
            added = ((self.hash, distinct[new]), (self.look, look[at[new]]), (self.first, first), (self.size, size))
            self.hash, self.look, self.first, self.size = (np.insert(a, where, b) for a, b in added)
            place += np.searchsorted(distinct[new], distinct)
        return place[inverse]

    def lookup(self, pieces: list[bytes], simple: np.ndarray) -> list[list[int]]:
        """Ids of pieces; simple ones are single pre-tokens, which go straight to the merges."""
        out: list = [None] * len(pieces)
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for i in np.flatnonzero(simple).tolist():
            out[i] = [t.id for t in tokenize(pieces[i].decode("latin-1").translate(letters))]
        rest = np.flatnonzero(~simple).tolist()
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows, each closed by the end id, and the number of each row's."""
        rows = len(offsets) - 1
        starts = self.starts(data, offsets)
        if not len(starts):
            return np.full(rows, END, np.uint32), np.ones(rows, np.int64)
        entry = self.find(data, starts)
        size, first = self.size[entry], self.first[entry]
        row = np.searchsorted(offsets, starts, side="right") - 1
        per_row = np.bincount(row, weights=size, minlength=rows).astype(np.int64) + 1
        # Where the ids of pieces lie; an end id follows each row.
        total = int(size.sum())
        source = np.ones(total, np.int32)
        begin = np.cumsum(size) - size
        source[begin] = np.diff(first, prepend=0) - np.append(0, size[:-1] - 1)
        ids = self.ids[np.cumsum(source, out=source)]
        return np.insert(ids, np.cumsum(per_row - 1), END), per_row


def pieces_of(path: str) -> Pieces:
    """The worker's own, kept between tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_rasterloom_pieces", types.ModuleType("_rasterloom_pieces"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.pieces = path, Pieces(path)
    return kept.pieces


def shared_table(counts: dict[int, int]) -> np.ndarray:
    """(id, frequency) rows that add up to 2^SCALE, each at least 1, in proportion to the counts."""
    ids = np.array(sorted(counts), np.int64)
    count = np.array([counts[i] for i in ids.tolist()], np.float64)
    room = (1 << SCALE) - len(ids)
    if room < 0:
        raise ValueError("more ids than the table has room for")
    freq = 1 + np.floor(count * (room / count.sum())).astype(np.int64)
    freq[int(np.argmax(count))] += (1 << SCALE) - int(freq.sum())
    return np.stack([ids, freq])


def packed_table(table: np.ndarray) -> bytes:
    """A frequency table in bytes: their number, then, compressed, steps from id to id and frequencies."""
    body = zlib.compress(np.concatenate([np.diff(table[0], prepend=0), table[1]]).astype("<u4").tobytes(), 1)
    return struct.pack("<I", len(body)) + body


def unpacked_table(frame: bytes) -> tuple[np.ndarray, int]:
    """The table at the begin of a stored frame, and where the coded block begins."""
    (size,) = struct.unpack_from("<I", frame)
    steps, freq = np.frombuffer(zlib.decompress(frame[4 : 4 + size]), "<u4").astype(np.int64).reshape(2, -1)
    return np.stack([np.cumsum(steps), freq]), 4 + size


def coded(tokens: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A block as a stored frame, with the table of its own ids."""
    times = np.bincount(tokens)
    ids = np.flatnonzero(times)
    table = shared_table(dict(zip(ids.tolist(), times[ids].tolist(), strict=True)))
    return packed_table(table) + Coder(table).encode(tokens, doc_ids, sizes)


def decoded(frame: bytes, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, sizes and ids of a stored frame; only: the ids from that checkpoint to the next."""
    table, at = unpacked_table(frame)
    return Coder(table).decode(frame[at:], only)


class Coder:
    """Codes and decodes blocks with a frequency table."""

    def __init__(self, table: np.ndarray):
        self.ids, freq = table[0].astype(np.uint32), table[1].astype(np.uint64)
        self.freq, self.start = freq, np.cumsum(freq) - freq
        self.symbol = np.zeros(int(self.ids.max()) + 1, np.int64)
        self.symbol[self.ids] = np.arange(len(self.ids))
        self.slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), freq.astype(np.int64))

    def encode(self, tokens: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
        n = len(tokens)
        steps = -(-n // LANES)
        symbols = np.zeros(steps * LANES, np.int64)
        symbols[:n] = self.symbol[tokens]
        symbols = symbols.reshape(steps, LANES)
        live = n - (steps - 1) * LANES
        x = np.full(LANES, LOW)
        words, points = [], []
        for t in range(steps - 1, -1, -1):
            m = live if t == steps - 1 else LANES
            f, c, y = self.freq[symbols[t, :m]], self.start[symbols[t, :m]], x[:m]
            over = y >= f << np.uint64(63 - SCALE)
            words.append((y[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            y = np.where(over, y >> np.uint64(32), y)
            q = y // f
            x[:m] = (q << np.uint64(SCALE)) + (y - q * f) + c
            if t % GAP == 0:
                points.append((t, x.copy()))
        words.reverse()
        points.reverse()
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        head = [struct.pack(HEAD, MAGIC, 1, SCALE, LANES, GAP, n, len(doc_ids), len(points)), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes()]
        for t, states in points:
            part = tokens[t * LANES : (t + GAP) * LANES].astype("<u4")
            head += [struct.pack("<II", at[t], zlib.crc32(part.tobytes())), states.astype("<u8").tobytes()]
        return b"".join([*head, *(w.astype("<u4").tobytes() for w in words)])

    def decode(self, frame: bytes, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, sizes and ids of a frame; only: the ids from that checkpoint to the next."""
        magic, version, scale, lanes, gap, n, docs, count = struct.unpack_from(HEAD, frame)
        if magic != MAGIC or version != 1 or scale != SCALE:
            raise ValueError("not a token frame of this version")
        at = struct.calcsize(HEAD)
        doc_ids = np.frombuffer(frame, "<i8", docs, at)
        sizes = np.frombuffer(frame, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        each = 8 + 8 * lanes
        words = np.frombuffer(frame, "<u4", -1, at + each * count).astype(np.uint64)
        out, mask = [], np.uint64((1 << SCALE) - 1)
        for k in range(count) if only is None else [only]:
            place, crc = struct.unpack_from("<II", frame, at + each * k)
            x = np.frombuffer(frame, "<u8", lanes, at + each * k + 8).copy()
            got = []
            for t in range(k * gap, min((k + 1) * gap, -(-n // lanes))):
                m = min(lanes, n - t * lanes)
                y = x[:m]
                low = y & mask
                s = self.slot[low.astype(np.int64)]
                y = self.freq[s] * (y >> np.uint64(SCALE)) + low - self.start[s]
                under = np.flatnonzero(y < LOW)
                y[under] = (y[under] << np.uint64(32)) | words[place : place + len(under)]
                place += len(under)
                x[:m] = y
                got.append(self.ids[s])
            part = np.concatenate(got) if got else np.zeros(0, np.uint32)
            if zlib.crc32(part.astype("<u4").tobytes()) != crc:
                raise ValueError("the ids don't match their checksum")
            out.append(part)
        return doc_ids, sizes, np.concatenate(out) if out else np.zeros(0, np.uint32)


NO_ID = np.iinfo(np.int64).min


def _frames(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, pieces = TaskContext.get().partitionId(), pieces_of(path)
        block, first, docs, sizes, tokens, held = 0, 0, [], [], [], 0

        def close():
            nonlocal block, first, held
            ids, size = np.concatenate(tokens), np.concatenate(sizes)
            frame = coded(ids, np.concatenate(docs), size)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([frame], pa.binary())], ["shard", "block", "first", "n_tokens", "frame"])
            block, first, held = block + 1, first + len(ids), 0
            docs.clear(), sizes.clear(), tokens.clear()
            return row

        for batch in batches:
            names = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at, stop, data, offsets in chunks(batch.column(1)):
                ids, size = pieces.encode(data, offsets)
                ends = np.cumsum(size)
                doc, token = 0, 0
                while doc < len(size):
                    upto = min(len(size), 1 + int(np.searchsorted(ends, token + BLOCK_TOKENS - held)))
                    docs.append(names[at + doc : at + upto])
                    sizes.append(size[doc:upto])
                    tokens.append(ids[token : ends[upto - 1]])
                    held += len(tokens[-1])
                    doc, token = upto, int(ends[upto - 1])
                    if held >= BLOCK_TOKENS:
                        yield close()
        if held:
            yield close()

    return run


def write_frames(spark: SparkSession, space: Workspace, docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write docs(doc_id, text) in ascending doc_id order: the frames, and the shards (shard, n_tokens)."""
    docs = bounded_batches(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows may fall on either side of a cut, so a doc_id of many rows spreads.
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text"
    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at"))
    ordered = dealt.repartitionByRange(parts, *order[:2], "at").sortWithinPartitions(*order).select("doc_id", "text")
    frames = space.save(ordered.mapInArrow(_frames(path), "shard int, block long, first long, n_tokens long, frame binary"), "frames")
    return frames, space.save(frames.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1), "shards")


def read_frames(spark: SparkSession, frames: DataFrame, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the frames, decoded."""
    # One row a shard: as many as the partitions of the write.
    base, total = [], 0
    for r in shards.orderBy("shard").collect():
        base.append((r.shard, total))
        total += r.n_tokens
    bases = spark.sparkContext.broadcast(dict(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, sizes, ids = decoded(frame)
                end = np.cumsum(sizes.astype(np.int64))
                start = end - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs.astype(np.int64), mask=docs == NO_ID), pa.array(start + first + bases.value[shard]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return frames.select("shard", "first", "frame").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
