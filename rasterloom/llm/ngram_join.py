"""N-gram Jaccard join: T-occurrence search over inverted lists with DivideSkip.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold t.
For sets of n and m shingles that needs an overlap of T = ceil(t * max(n, m)) or more, so the
join is a T-occurrence problem: which documents occur T times in the inverted lists of a query
document's shingles? Links and components are exact up to 64-bit hashes of shingles.

1. Documents of equal sets are one class, known by the 128-bit digest of the set. What follows
   works on classes, so copies cost nothing beyond that aggregation.
2. In one global order of shingles the first n - T + l of both of a linked pair share at least
   l (common shingles in order: the j-th leaves O - j behind it). Posting these gives the first
   lists. Shingles with lists of one document count for nothing, and a class that keeps fewer
   than the l of its least partner is out: this ends nearly all documents that have no partner.
   A bounded table of frequent shingles stands last in the order and never enters the shuffle;
   any order is right, the frequencies only shorten lists. Lists name classes by half a digest:
   two classes of one half post together, which can only add candidates.
3. Within what is left, a pair still shares `need` shingles, so among the c kept ones, rarest
   first, it shares one of the first c - need + 1. Classes that meet there get one block.
4. A block over the bounds (`block_docs` members or `block_shingles` shingles) may only be chained
   by passages that many unlike documents share. Step 3 is done again on its whole sets, with
   need = T in the order of the frequencies within: a document of whose shingles fewer than T are
   shared by anyone is out, and what meets only in a common passage comes apart. The frequencies
   are counted in 2^SKETCH_BITS slots at most, each for all shingles that fall in it, so nothing
   of a set is posted but its c - T + 1 rarest. Slots count too many, never too few: a slot of
   one holds a shingle that nobody shares, and any order that all keep to is right.
5. A block holds every candidate of its members. Its whole sets are indexed and each member
   searches: short lists are merged through a heap with the lowered threshold T - L, the L longest
   are only probed by binary search, and survivors have their exact overlap. A block that is still
   over the bounds is cut into s slices, and its pairs of slices are cells of their own: one side
   is indexed, the other searches, so no task holds an unbounded group and each member is sent s
   times. A member's links are the rows of the classes that its searches find, and the other rows
   of its own class; links stay counts, no pair leaves a cell but a spanning forest's.

Null and empty texts have the empty set: n_shingles 0, a component of their own. A null doc_id
links like any other and is never the least of a component; a component of none but null doc_ids
has a null component_id. Repeated rows stay rows, each with the others as links. Ties can't arise:
component_id is a minimum. A text of any length is one set, held whole by the task that reads it.
An empty table gives no rows. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Workspace, bounded_batches
from .words import mix64, shingle_sets, word_chunks

#: Frequent shingles that stand last in the order: at most so many, each in so many documents or more.
HEAVY_MOST, HEAVY_DF = 1 << 16, 500
#: Document frequencies are told apart up to here; a list being read holds no more.
DF_MOST = 1 << 16
#: Merges of up to so many postings go through a heap; what is longer, as in dense groups, is counted in an array.
HEAP_MOST = 1024
#: Rough costs for choosing how many lists to probe: of a posting in the heap and in an array, and of a probe.
HEAP_COST, ARRAY_COST, PROBE_COST = 0.3, 0.012, 0.06
#: A cell holds about so many members and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 20
#: log2 of the bits of the filter by which scans find the texts of block members.
FILTER_BITS = 26
#: log2 of the slots, a byte each, that count shingles of blocks over the bounds, and of the slots of a chunk of them.
SKETCH_BITS, CHUNK_BITS = 26, 16


def least_overlap(n, percent: int):
    """T: shingles that a set of n shares with any linked set, at least (arrays or ints)."""
    return (n * percent + 99) // 100


def spare(n, percent: int):
    """l: how many shared shingles the first lists ask for."""
    t = least_overlap(n, percent)
    return np.minimum(t, n // 10 + 1)


def prefix_length(n: int, percent: int) -> int:
    return int(n - least_overlap(n, percent) + spare(n, percent))


def needed(n: int, percent: int) -> int:
    """Shared shingles among the first lists, at least, with the least partner of a set of n."""
    return int(spare(least_overlap(n, percent), percent))


def digest(shingles: np.ndarray) -> bytes:
    """The name of a class: 16 bytes; half() of it stands in lists."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def half(name: bytes) -> int:
    return int.from_bytes(name[:8], "big", signed=True)


def _ordered(shingles: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequent ones last; and how many those are."""
    if not len(heavy):
        return shingles, 0
    at = np.searchsorted(heavy, shingles)
    at[at == len(heavy)] = 0
    last = heavy[at] == shingles
    return np.concatenate([shingles[~last], shingles[last]]), int(last.sum())


def _heavy_counts(k: int):
    """Counts of shingles within a task's distinct sets; those in under eight sets stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = np.sort(np.concatenate(held))
                at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                count = np.diff(np.append(at, len(found)))
                at, count = at[count >= 8], count[count >= 8]
                yield pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(count.astype(np.int64))], ["token", "df"])

        for batch in batches:
            for _, _, words in word_chunks(batch.column(0), True):
                for s in shingle_sets(words, k):
                    if len(s) and (d := half(digest(s))) not in seen:
                        seen.add(d)
                        held.append(s)
                        size += len(s)
                if size > 1 << 21:
                    yield from flush()
                    held, size = [], 0
                if len(seen) > 1 << 20:
                    seen.clear()
        yield from flush()

    return run


SIGNED = "doc_id long, text_key long, n long, fp long, cid binary, hot long, need long"


def _signatures(k: int, percent: int, heavy_b):
    """From (doc_id, text_key, text): set size, name, and how many frequent shingles stand in the first lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = heavy_b.value
        for batch in batches:
            for at, stop, words in word_chunks(batch.column(2), True):
                rows = []
                for s in shingle_sets(words, k):
                    n, name = len(s), digest(s)
                    light = n - _ordered(s, heavy)[1]
                    rows.append((n, half(name), name, max(0, prefix_length(n, percent) - light) if n else 0, needed(n, percent) if n else 0))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                own = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), batch.column(1).slice(at, stop - at), *own], ["doc_id", "text_key", "n", "fp", "cid", "hot", "need"])

    return run


def _postings(k: int, percent: int, heavy_b, hot: bool):
    """(token, fp) of the first lists: the infrequent shingles, or the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, seen = heavy_b.value, set()
        for batch in batches:
            for _, _, words in word_chunks(batch.column(0), True):
                tokens, owners, counts = [], [], []
                for s in shingle_sets(words, k):
                    if not len(s) or (d := half(digest(s))) in seen:
                        continue
                    seen.add(d)
                    s, last = _ordered(s, heavy)
                    most, light = prefix_length(len(s), percent), len(s) - last
                    part = s[light:most] if hot else s[: min(most, light)]
                    tokens.append(part)
                    owners.append(d)
                    counts.append(len(part))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), counts))], ["token", "fp"])
            if len(seen) > 1 << 20:
                seen.clear()

    return run


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (token, fp, ...) sorted by both: (fp, token, df, ...) for tokens of two classes or more.

    A list that is still growing at a batch's end waits, at most DF_MOST entries of it: beyond
    these its df counts as DF_MOST and it passes through.
    """
    wait, passing = None, None

    def out(columns, df):
        t, f, *more = columns
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (f, t, df, *more)], ["fp", "token", "df", *names])

    def emit(columns):
        t = columns[0]
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        df = np.diff(np.append(at, len(t)))
        each = np.repeat(df, df)
        keep = each > 1
        return out([x[keep] for x in columns], np.minimum(each[keep], DF_MOST))

    for batch in batches:
        columns, names = [c.to_numpy(zero_copy_only=False) for c in batch.columns], batch.schema.names[2:]
        if not len(batch):
            continue
        if passing is not None:
            n = int(np.searchsorted(columns[0], passing, side="right"))
            if n:
                yield out([x[:n] for x in columns], np.full(n, DF_MOST))
            columns = [x[n:] for x in columns]
            if not len(columns[0]):
                continue
            passing = None
        if wait is not None:
            columns = [np.concatenate(x) for x in zip(wait, columns, strict=True)]
        t, f = columns[:2]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (f[1:] != f[:-1])])
        columns = [x[new] for x in columns]
        last = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
        if last:
            yield emit([x[:last] for x in columns])
        wait = [x[last:] for x in columns]
        if len(wait[0]) >= DF_MOST:
            passing = wait[0][0]
            yield out(wait, np.full(len(wait[0]), DF_MOST))
            wait = None
    if wait is not None:
        yield emit(wait)


def _rare_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by fp, df, token: the rarest c - need + 1 of each class that keeps enough.

    Columns fp, token (null: none kept), df, need, hot. Gives (token, fp, c, left): left is how
    many frequent shingles the prefix needs beyond these; a row of null token says so for classes
    that have no other.
    """
    wait = None

    def runs(fp, token, need, hot):
        at = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        size = np.diff(np.append(at, len(fp)))
        none = token == np.iinfo(np.int64).min
        light = size - none[at]
        c, least = light + hot[at], np.minimum.reduceat(need, at)
        length = np.where(c >= least, c - least + 1, 0)
        rank = np.arange(len(fp)) - np.repeat(at, size)
        left = np.maximum(0, length - light)
        keep = (rank < np.repeat(length, size)) & (~none | (np.repeat(left, size) > 0))
        return pa.RecordBatch.from_arrays([pa.array(token[keep], mask=none[keep]), pa.array(fp[keep]), pa.array(np.repeat(c, size)[keep]), pa.array(np.repeat(left, size)[keep])], ["token", "fp", "c", "left"])

    for batch in batches:
        cols = [batch.column(i).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4)]
        if not len(cols[0]):
            continue
        if wait is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(wait, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if last:
            yield runs(*(x[:last] for x in cols))
        wait = [x[last:] for x in cols]
    if wait is not None:
        yield runs(*wait)


class Index:
    """Inverted lists over whole shingle sets, with DivideSkip searches."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.members = percent, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        token = token[order]
        self.at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        self.token = token[self.at]
        self.end = np.append(self.at[1:], len(token))
        #: Ascending (list, member) pairs, for probes of many lists at once.
        self.posting = np.repeat(np.arange(len(self.at)) * self.members, self.end - self.at) + self.owner

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members linked to the query set, ascending, and their overlaps (a member of equal set included)."""
        n, none = len(query), np.zeros(0, np.int64)
        t = least_overlap(n, self.percent)
        if not len(self.token):
            return none, none
        lists = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        lists = lists[self.token[lists] == query]
        if len(lists) < t:
            return none, none
        length = self.end[lists] - self.at[lists]
        order = np.argsort(length, kind="stable")
        lists, postings = lists[order], np.cumsum(length[order])
        cut = self._divide(postings, t)
        least = t - (len(lists) - cut)
        members, counts = self._merge(lists[:cut], int(postings[cut - 1]), least)
        size = self.size[members]
        alike = (100 * size >= self.percent * n) & (100 * n >= self.percent * size)
        members, counts = members[alike], counts[alike]
        # Probes of the long lists, from the shorter to the longer, some at a time.
        step = max(1, (1 << 18) // max(1, len(members)))
        for at in range(cut, len(lists), step):
            if not len(members):
                break
            part = lists[at : at + step]
            keys = part[:, None] * self.members + members
            found = np.minimum(np.searchsorted(self.posting, keys), len(self.posting) - 1)
            counts = counts + (self.posting[found] == keys).sum(axis=0)
            may = counts + (len(lists) - at - len(part)) >= t
            members, counts = members[may], counts[may]
        union = n + self.size[members] - counts
        keep = 100 * counts >= self.percent * union
        return members[keep], counts[keep]

    def _divide(self, postings: np.ndarray, t: int) -> int:
        """How many of the lists, shortest first, to merge: the least of what merging and probing cost.

        With L lists left to probe, a member is a candidate from t - L occurrences on.
        """
        probed = np.arange(min(t, len(postings)))
        merged = postings[len(postings) - 1 - probed]
        cost = np.where(merged <= HEAP_MOST, HEAP_COST * merged, ARRAY_COST * merged) + PROBE_COST * probed * np.minimum(self.members, merged // (t - probed))
        return len(postings) - int(np.argmin(cost))

    def _merge(self, lists: np.ndarray, total: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Members in `least` or more of the lists, and in how many."""
        parts = [self.owner[a:b] for a, b in zip(self.at[lists].tolist(), self.end[lists].tolist(), strict=True)]
        if total > HEAP_MOST:
            times = np.bincount(np.concatenate(parts), minlength=self.members)
            found = np.flatnonzero(times >= least)
            return found, times[found]
        found, count, run, times = [], [], -1, 0
        for x in heapq.merge(*(p.tolist() for p in parts)):
            if x == run:
                times += 1
                continue
            if times >= least and run >= 0:
                found.append(run)
                count.append(times)
            run, times = x, 1
        if times >= least and run >= 0:
            found.append(run)
            count.append(times)
        return np.array(found, np.int64), np.array(count, np.int64)


def cell_links(members: list[np.ndarray], searchers: list[np.ndarray] | None, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Searches of one cell: each node's component and linked rows, and the links of a spanning forest.

    Nodes are the members, then the searchers; without searchers the members search each other.
    rows: how many rows each node stands for.
    """
    index, first = Index(members, percent), 0 if searchers is None else len(members)
    component, degree, forest = np.arange(len(rows)), np.zeros(len(rows), np.int64), []
    for i, s in enumerate(members if searchers is None else searchers, first):
        linked, _ = index.search(s)
        linked = linked[linked != i]
        if not len(linked):
            continue
        degree[i] += rows[linked].sum()
        if searchers is not None:
            degree[linked] += rows[i]
        parts, at = np.unique(component[linked], return_index=True)
        other = parts != component[i]
        if other.any():
            forest += [(i, m) for m in linked[at[other]].tolist()]
            parts = np.append(parts, component[i])
            component[np.isin(component, parts)] = parts.min()
    return component, degree, forest


def _sets_of(k: int):
    """(fp, cid, n, rows, block, members, shingles, sets): the whole sets of classes, from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop, words in word_chunks(batch.column(batch.num_columns - 1), True):
                sets = shingle_sets(words, k)
                out = pa.RecordBatch.from_arrays([*(c.slice(at, stop - at) for c in batch.columns[:-1]), pa.array([s.tobytes() for s in sets], pa.binary())], [*batch.schema.names[:-1], "sets"])
                # Another text may have the same key.
                own = [digest(s) == name for s, name in zip(sets, out.column("cid").to_pylist(), strict=True)]
                yield out.filter(pa.array(own, pa.bool_()))

    return run


def _in_block(block: int, shingles: np.ndarray) -> np.ndarray:
    """Hashes of a set's shingles that are other ones in each block; their first bits are the slot."""
    return mix64(shingles ^ np.uint64(block & (1 << 64) - 1))


def _slot_counts(bits: int):
    """(chunk, slots, counts) from (block, sets): how many of a task's sets have a shingle in each slot of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                slot, count = np.unique(np.concatenate(held), return_counts=True)
                chunk, slot, count = (slot >> CHUNK_BITS).astype(np.int64), slot.astype(np.uint16), count.astype(np.uint32)
                at = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
                ranges = list(zip(at.tolist(), [*at[1:].tolist(), len(chunk)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(chunk[at]), *(pa.array([x[a:b].tobytes() for a, b in ranges], pa.binary()) for x in (slot, count))], ["chunk", "slots", "counts"])

        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((_in_block(block, np.frombuffer(raw, np.uint64)) >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(held[-1])
                if size > 1 << 21:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run


def _frequency_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, codes) from (chunk, slots, counts) of whole chunks: a byte a slot that is 0 up to a count of 1 and then rises with its logarithm."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, slots, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk not in total:
                total[chunk] = np.zeros(1 << CHUNK_BITS, np.uint32)
            total[chunk][np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.uint32)
    for chunk, count in total.items():
        code = np.where(count > 1, np.minimum(255, 1 + 12 * np.log2(np.maximum(2, count) / 2)), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([code.tobytes()], pa.binary())], ["chunk", "codes"])


def _rarest_of_sets(percent: int, bits: int, codes_b):
    """(token, fp) from (fp, block, sets): the rarest c - T + 1 of the c shingles that may be shared in the block, if these are T."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codes_b.value
        for batch in batches:
            tokens, owners, lengths = [], [], []
            for fp, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.sort(_in_block(block, np.frombuffer(raw, np.uint64)))
                code = codes[own >> np.uint64(64 - bits)]
                length = np.count_nonzero(code) - least_overlap(len(own), percent) + 1
                if length > 0:
                    own, code = own[code > 0], code[code > 0]
                    tokens.append(own[np.argsort(code, kind="stable")[:length]])
                    owners.append(fp)
                    lengths.append(len(tokens[-1]))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), lengths))], ["token", "fp"])

    return run


SEARCHED = "cid binary, other binary, whole boolean, rows long"


def _search_cells(percent: int):
    """From rows (block, i, j, role, cid, rows, whole, sets) sorted by the first five: what the searches of each cell give.

    Role 0 are members; role 1 search them. Without role 1, members search each other. Gives
    (cid, other, whole, rows): rows linked to cid here; and for a whole block the name of its
    component as other, else links (rows 0) that span components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            members, searchers = cell
            if key is None or not members or (key[2] != key[1] and not searchers):
                return
            nodes = members + searchers
            names, rows, whole = [x[0] for x in nodes], np.array([x[1] for x in nodes], np.int64), nodes[0][2]
            component, degree, forest = cell_links([x[3] for x in members], [x[3] for x in searchers] or None, rows, percent)
            found = np.flatnonzero(degree).tolist()
            out = [(names[i], names[component[i]] if whole else None, whole, int(degree[i])) for i in found]
            out += [] if whole else [(names[a], names[b], False, 0) for a, b in forest]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.bool_(), pa.int64()), strict=True)], ["cid", "other", "whole", "rows"])

        for batch in batches:
            for block, i, j, role, name, rows, whole, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, i, j) != key:
                    yield from close()
                    key, cell = (block, i, j), ([], [])
                cell[role].append((name, rows, whole, np.frombuffer(raw, np.uint64)))
        yield from close()

    return run


def _in_filter(bits_b):
    """Rows (text_key, text) whose key is in the filter, each key once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_b.value
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            place = key.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            inside = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
            if len(inside):
                _, first = np.unique(key[inside], return_index=True)
                yield batch.take(pa.array(np.sort(inside[first])))

    return run


def _texts_of(spark: SparkSession, keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """A text for each of wanted(text_key) from keyed(text_key, text), and few others.

    A filter of 2^FILTER_BITS bits, whatever the number of keys, drops other texts within the scan,
    so the shuffle holds little but the wanted texts.
    """
    place = f"shiftrightunsigned(text_key, {64 - FILTER_BITS})"
    set_bits = wanted.select(F.expr(f"shiftright({place}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({place} & 63 as int))").alias("bit"))
    found = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    held = keyed.mapInArrow(_in_filter(spark.sparkContext.broadcast(bits)), "text_key long, text string")
    return held.groupBy("text_key").agg(F.first("text").alias("text"))


def _shared(posted: DataFrame, parts: int) -> DataFrame:
    """(fp, token, df, ...) of posted(token, fp, ...) for tokens of two classes or more."""
    more = [f"{c} long" for c in posted.columns[2:]]
    return posted.repartition(parts, "token").sortWithinPartitions("token", "fp").mapInArrow(_shared_lists, ", ".join(["fp long, token long, df long", *more]))


def _rarest(space: Workspace, shared: DataFrame, parts: int) -> DataFrame:
    """(token, fp, c, left): the rarest of the lists shared(fp, token, df, need, hot) that a class has to look at."""
    ranked = shared.select("fp", "token", "df", "need", "hot").repartition(parts, "fp").sortWithinPartitions("fp", F.col("df").asc_nulls_first(), "token")
    return space.save(ranked.mapInArrow(_rare_prefix, "token long, fp long, c long, left long"), "prefix")


def _rarest_within(space: Workspace, large: DataFrame, shingles: int, percent: int, parts: int) -> DataFrame:
    """(token, fp): the rarest shingles in its block that each class of large(fp, block, sets) has to look at; the sets have so many in all."""
    bits = min(SKETCH_BITS, max(CHUNK_BITS, (4 * shingles).bit_length()))
    counted = large.select("block", "sets").mapInArrow(_slot_counts(bits), "chunk long, slots binary, counts binary")
    codes = np.zeros((1 << bits - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    for row in counted.repartition(parts, "chunk").mapInArrow(_frequency_codes, "chunk long, codes binary").toArrow().to_pylist():
        codes[row["chunk"]] = np.frombuffer(row["codes"], np.uint8)
    found = space.spark.sparkContext.broadcast(codes.ravel())
    return space.save(large.select("fp", "block", "sets").mapInArrow(_rarest_of_sets(percent, bits, found), "token long, fp long"), "within")


def _meetings(rare: DataFrame) -> DataFrame:
    """(a, b): each class of a list and the least of it."""
    least = rare.where("token is not null").groupBy("token").agg(F.min("fp").alias("leader"), F.count("*").alias("k")).where("k > 1")
    return rare.join(least, "token").where("leader <> fp").select(F.col("fp").alias("a"), F.col("leader").alias("b"))


def _blocks(space: Workspace, met: DataFrame, name: str) -> DataFrame:
    return space.save(connected_components(space, met).select(F.col("node").alias("fp"), F.col("root").alias("block")), name)


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, class_size, n_links, component, text_key.

    component_id is the least doc_id that links reach, class_size the number of rows with an
    equal shingle set, n_links the number of other rows whose similarity reaches the threshold.
    component names the component also where ids repeat or are null (null: the empty set), and
    text_key is xxhash64 of the text. The two bounds change the work of a task, not the result.
    """
    space, docs = Workspace(spark, "ngram-join"), bounded_batches(docs)
    text, key = docs.select("text"), F.xxhash64("text").alias("text_key")
    counts = text.mapInArrow(_heavy_counts(k), "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    top = counts.where(F.col("df") >= HEAVY_DF).orderBy(F.desc("df"), "token").limit(HEAVY_MOST).select("token").collect()
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64)))

    signed = space.save(docs.select("doc_id", key, "text").mapInArrow(_signatures(k, percent, heavy), SIGNED), "signatures")
    first = lambda c: F.first(c).alias(c)
    classes = space.save(signed.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rid"), F.min("text_key").alias("text_key"), *map(first, ("fp", "n", "hot", "need")), F.count("*").alias("class_size")), "classes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = classes.where("need > 0").groupBy("fp").agg(F.min("need").alias("need"), F.sum("hot").alias("hot"))
    shared = _shared(text.mapInArrow(_postings(k, percent, heavy, False), "token long, fp long"), parts)
    rare = _rarest(space, facts.join(shared, "fp", "left").where("token is not null or hot > 0"), parts)
    # Classes that meet on a rare shingle, or on a frequent one if their prefix reaches that far.
    reach = rare.where("left > 0").select("fp").distinct()
    frequent = space.save(text.mapInArrow(_postings(k, percent, heavy, True), "token long, fp long").distinct().join(reach, "fp", "left_semi"), "frequent")
    # At most HEAVY_MOST rows: the frequent table's size bounds this broadcast.
    leaders = F.broadcast(frequent.groupBy("token").agg(F.min("fp").alias("leader")))
    met = _meetings(rare).union(frequent.join(leaders, "token").where("leader <> fp").select("fp", "leader"))
    blocks = _blocks(space, met, "blocks")
    space.drop(rare, frequent)

    totals = lambda df: df.groupBy("block").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    placed = blocks.join(classes.select("fp", "cid", "n", "class_size", "text_key"), "fp")
    placed = space.save(placed.join(totals(placed), "block").select("fp", "cid", "n", F.col("class_size").alias("rows"), "block", "members", "shingles", "text_key"), "placed")
    texts = placed.join(_texts_of(spark, docs.select(key, "text"), placed), "text_key").drop("text_key")
    shape = "fp long, cid binary, n long, rows long, block long, members long, shingles long, sets binary"
    sets = space.save(texts.mapInArrow(_sets_of(k), shape), "sets")
    over = F.greatest(F.ceil(F.col("members") / block_docs), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    work = sets.where(over == 1).withColumn("slices", F.lit(1))
    large = sets.where(over > 1)
    shingles = large.agg(F.sum("n")).first()[0]
    if shingles:
        apart = _blocks(space, _meetings(_rarest_within(space, large, shingles, percent, parts)), "apart")
        large = large.drop("block", "members", "shingles").join(apart, "fp")
        large = large.join(totals(large.drop("sets")), "block").select(sets.columns).withColumn("slices", over)
        work = work.union(large)
    own = F.pmod(F.xxhash64("cid"), F.col("slices")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), (x < own).cast("int").alias("role")))
    spread = work.select("block", F.explode(cells).alias("cell"), "cid", "rows", (F.col("slices") == 1).alias("whole"), "sets").select("block", "cell.i", "cell.j", "cell.role", "cid", "rows", "whole", "sets")
    searched = space.save(spread.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j", "role", "cid").mapInArrow(_search_cells(percent), SEARCHED), "searched")
    space.drop(placed, sets, blocks)

    roots = searched.where("whole").select(F.col("cid").alias("node"), F.col("other").alias("root"))
    links = searched.where("rows = 0").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    if not links.isEmpty():
        roots = roots.union(connected_components(space, links))
    roots = space.save(roots.join(classes.select(F.col("cid").alias("node"), "rid"), "node"), "roots")
    named = roots.groupBy("root").agg(F.min("rid").alias("component_id"))
    degrees = searched.where("rows > 0").groupBy("cid").agg(F.sum("rows").alias("rows"))
    found = roots.join(named, "root").select(F.col("node").alias("cid"), "root", "component_id").join(degrees, "cid")
    ids = classes.select("cid", "rid", "class_size").join(found, "cid", "left")
    ids = space.save(ids.select("cid", F.coalesce("root", "cid").alias("component"), F.when(F.col("root").isNull(), F.col("rid")).otherwise(F.col("component_id")).alias("component_id"), "class_size", (F.col("class_size") - 1 + F.coalesce("rows", F.lit(0))).alias("n_links")), "ids")
    space.drop(classes, searched, roots)
    full = signed.where("n > 0").join(ids, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size", "n_links", "component", "text_key")
    none = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("binary").alias("component"), "text_key")
    return full.union(none)


def oracle(k: int = 5, percent: int = 80) -> str:
    """doc_id, n_shingles, component_id, class_size and n_links in DuckDB SQL: all pairs that share a shingle, links followed to the end."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') l FROM documents),
    g AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(l) >= {k} THEN list_distinct(list_transform(range(1, len(l) - {k - 2}), lambda i: array_to_string(l[i : i + {k - 1}], ' '))) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) s FROM w),
    n AS MATERIALIZED (SELECT r, count(*) n FROM g GROUP BY r),
    p AS (SELECT a.r x, b.r y, count(*) c FROM g a JOIN g b USING (s) WHERE a.r <> b.r GROUP BY ALL),
    links AS MATERIALIZED (SELECT x, y, c = a.n AND c = b.n same FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
    reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    least AS (SELECT x, min(doc_id) least FROM reach JOIN w ON w.r = y GROUP BY x),
    counted AS (SELECT x, count(*) n_links, count(*) FILTER (same) copies FROM links GROUP BY x)
    SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, least(doc_id, least)::BIGINT component_id, (1 + coalesce(copies, 0))::BIGINT class_size, coalesce(n_links, 0)::BIGINT n_links
    FROM w LEFT JOIN n USING (r) LEFT JOIN least ON least.x = r LEFT JOIN counted ON counted.x = r"""
