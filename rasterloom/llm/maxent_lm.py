"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

The words that training holds LEAST times or more, among the LISTED most frequent, are modelled:
they are the leaves of a tree of classes, built over the words by falling count. A node cuts its
words into BRANCH runs of like sums of counts, its children, down to single words,
so frequent words are near the root and a token costs a few softmaxes of BRANCH however large the
vocabulary is; the first two levels make about 1000 classes. The words that are not modelled, the
tail, are one leaf. P(w | h) is the product of P(child | node, h) down the path. Each factor is a
maximum-entropy model over hashed features of the history: at the root the previous word (2-gram),
the previous two (3-gram) and a skip to the last of the ANCHORS most frequent words before; below
it the 2-gram and the skip, each with the node. A feature's weights for the children are a row of
one table; its rows are a power of two that follows the vocabulary, 2^ROW_BITS at most. The
logarithms of the children's training counts are added to the scores, so without features a node
gives unigrams. In the tail, P(w | tail) is the word's training count with half a count added, one
unseen word included, so P sums to one.

Counts cover all training tokens and grow with the corpus. Training goes over all of it once, in
rounds of distributed gradient updates: each task runs AdaGrad, with one rate a row, over its
documents from the present model and sends the rows that it used; ranges of rows are averaged by
use in as many tasks as there are shuffle partitions. Scoring runs in numpy batches. Counts of the
most frequent LISTED words are broadcast (that bound is its size); counts of the others are
joined to the scores by a shuffle, so every count is exact at any size.

Null texts are empty: one end token. Words are known by 64-bit hashes. A null doc_id is not held
out; repeated rows count each. Ties in counts go to the lesser hash. An empty table gives no rows
and a model of the end token alone. A text of any length is read whole, its words in one batch.
Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, bounded_batches
from .words import Words, word_chunks

#: Words whose counts are broadcast, and how often training holds a word that is modelled.
LISTED, LEAST = 1 << 20, 8
BRANCH, ANCHORS, ROW_BITS = 32, 32, 17
ROUNDS, BATCH, RATE = 2, 16384, 1.0
#: Rows of a run of gradients that are added place by place; longer runs are cut into such pieces.
PIECE = 8
#: Ranges of rows that are averaged apart.
RANGES = 256
#: Stand-ins for the end of a text and for what precedes it.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Multipliers that keep features, pairs and nodes apart.
PAIR, NODE, MIX = np.uint64(0xA0761D6478BD642F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each row, and their rows."""
    rows = len(words.offsets) - 1
    out = np.full(len(words.hash) + rows, END, np.uint64)
    out[np.arange(len(words.hash)) + words.row] = words.hash
    count = np.bincount(words.row, minlength=rows) + 1
    return out, np.repeat(np.arange(rows), count)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pd.Series] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            s = pd.concat(held).groupby(level=0, sort=False).sum() if len(held) > 1 else held[0]
            yield pa.RecordBatch.from_arrays([pa.array(s.index.to_numpy().view(np.int64)), pa.array(s.to_numpy().astype(np.int64))], ["word", "n"])

    for batch in batches:
        for _, _, words in word_chunks(batch.column(0), True):
            token, _ = tokens_of(words)
            code, distinct = pd.factorize(token)
            held.append(pd.Series(np.bincount(code, minlength=len(distinct)), index=distinct))
            size += len(distinct)
            if size > 1 << 19:
                yield from flush()
                held, size = [], 0
    yield from flush()


class Tree:
    """Classes of items, given by their counts, which fall.

    node, child: for each level and item, the node on its path and the child it goes to (-1: the path
    has ended). prior: the logarithms of the children's counts by node; places without a child have none.
    """

    def __init__(self, count: np.ndarray):
        size, nodes, priors, levels = len(count), 0, [], []
        mass = np.concatenate([[0.0], np.cumsum(count)])
        runs = [(0, size)]
        while runs:
            node, child, below = np.full(size, -1, np.int32), np.zeros(size, np.int8), []
            prior = np.full((len(runs), BRANCH), -70, np.float32)
            for i, (a, b) in enumerate(runs):
                if b - a <= BRANCH:
                    cuts = np.arange(a, b + 1)
                else:
                    even = mass[a] + (mass[b] - mass[a]) * np.arange(1, BRANCH) / BRANCH
                    cuts = np.unique(np.concatenate([[a], np.clip(np.searchsorted(mass, even), a + 1, b - 1), [b]]))
                node[a:b], child[a:b] = nodes + i, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                held = np.log(mass[cuts[1:]] - mass[cuts[:-1]])
                prior[i, : len(held)] = held - held.max()
                below += [(x, y) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if y - x > 1]
            levels.append((node, child))
            priors.append(prior)
            nodes, runs = nodes + len(runs), below
        self.node, self.child = (np.stack(x) for x in zip(*levels, strict=True))
        self.prior = np.concatenate(priors)


class Vocabulary:
    """Totals, the listed words by hash with their counts, and the tree of the modelled ones.

    Made of words and counts, in any order; total and distinct are of all training tokens.
    """

    def __init__(self, word: np.ndarray, n: np.ndarray, total: int, distinct: int):
        order = np.argsort(word)
        self.total, self.distinct, self.listed, self.listed_count = total, distinct, word[order], n[order]
        ranked = np.lexsort((word, -n))
        ranked = ranked[n[ranked] >= LEAST]
        self.tail_total, self.tail_distinct = total - int(n[ranked].sum()), distinct - len(ranked)
        count = np.append(n[ranked], max(self.tail_total, 0.5))
        falling = np.argsort(-count, kind="stable")
        place = np.empty(len(count), np.int32)
        place[falling] = np.arange(len(count))
        self.tree = Tree(count[falling])
        by_hash = np.argsort(word[ranked])
        self.modelled, self.place, self.tail = word[ranked][by_hash], place[:-1][by_hash], int(place[-1])
        self.anchors = np.sort(word[ranked][word[ranked] != END][:ANCHORS])

    def facts(self) -> dict:
        """What the constructor makes, without a class of this package, for a broadcast."""
        return vars(self) | {"tree": vars(self.tree)}

    @staticmethod
    def of(facts: dict) -> Vocabulary:
        v = Vocabulary.__new__(Vocabulary)
        v.__dict__.update(facts, tree=Tree.__new__(Tree))
        v.tree.__dict__.update(facts["tree"])
        return v

    def no_weights(self) -> np.ndarray:
        """A table of zeros: twice as many rows as modelled words or more, 2^10 at least and 2^ROW_BITS at most."""
        return np.zeros((1 << min(ROW_BITS, max(10, len(self.modelled).bit_length() + 1)), BRANCH), np.float32)

    def places(self, token: np.ndarray) -> np.ndarray:
        """The leaves of tokens."""
        at, found = _find(self.modelled, token)
        return np.where(found, self.place[at], self.tail) if len(self.place) else np.full(len(token), self.tail)

    def counts(self, token: np.ndarray) -> np.ndarray:
        """Counts of listed tokens, else -1."""
        at, found = _find(self.listed, token)
        return np.where(found, self.listed_count[at], -1) if len(self.listed) else np.full(len(token), -1)


def _find(ascending: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values would be, and whether they are there."""
    at = np.minimum(np.searchsorted(ascending, values), max(0, len(ascending) - 1))
    return at, ascending[at] == values if len(ascending) else np.zeros(len(values), bool)


def histories(v: Vocabulary, token: np.ndarray, row: np.ndarray, code: np.ndarray, distinct: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of each token; the word before it, the two before it, and the last anchor before it in its row.

    Rows ascend; token is distinct[code], and leaf holds the leaves of distinct.
    """
    n = len(token)
    back = []
    for k in (1, 2):
        b = np.full(n, START, np.uint64)
        b[k:] = np.where(row[k:] == row[:-k], token[:-k], START)
        back.append(b)
    here = np.arange(n)
    head = np.concatenate([[True], row[1:] != row[:-1]])
    begin = np.maximum.accumulate(np.where(head, here, 0))
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(_find(v.anchors, distinct)[1][code], here, -1)[:-1]]))
    skip = np.where(last >= begin, token[np.maximum(last, 0)], START)
    return leaf[code], back[0], back[0] * PAIR + back[1], skip


def _rows(features: list[np.ndarray], node: np.ndarray | int, rows: int) -> list[np.ndarray]:
    """The table rows of features, which are hashes themselves, at nodes."""
    group, shift = (np.asarray(node).astype(np.uint64) + np.uint64(1)) * NODE, np.uint64(65 - rows.bit_length())
    return [(((f + np.uint64(i + 1)) ^ group) * MIX >> shift).astype(np.int32) for i, f in enumerate(features)]


def _scores(table: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """Scores of the children, the logarithms of their probabilities but for a constant; prior is overwritten with them."""
    for r in rows:
        prior += np.take(table, r, axis=0)
    return np.clip(prior, -80, 80, out=prior)


def _softmax(table: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """Probabilities of the children; prior is overwritten with them."""
    z = _scores(table, rows, prior)
    np.exp(z, out=z)
    z *= (1 / np.einsum("ij->i", z))[:, None]
    return z


def _coded(v: Vocabulary, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of tokens, the distinct ones in ascending order, which finds them sooner, and their leaves."""
    code, distinct = pd.factorize(token)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    distinct = distinct[order]
    return rank[code], distinct, v.places(distinct)


def _paths(v: Vocabulary, table: np.ndarray, token: np.ndarray, row: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Batch by batch and level by level: the tokens whose path goes on, table rows, places of their children in the batch's scores, and priors of their nodes."""
    tree, (leaf, one, pair, skip) = v.tree, histories(v, token, row, *(_coded(v, token) if coded is None else coded))
    for at in range(0, len(token), BATCH):
        on = np.arange(at, min(at + BATCH, len(token)))
        place, a, b = leaf[on], one[on], skip[on]
        for level, (node, child) in enumerate(zip(tree.node, tree.child, strict=True)):
            here = node[place]
            if level:
                go = np.flatnonzero(here >= 0)
                if not len(go):
                    break
                on, place, a, b, here = (x[go] for x in (on, place, a, b, here))
            yield on, _rows([a, b] if level else [a, b, pair[on]], here, len(table)), np.arange(0, len(on) * BRANCH, BRANCH) + child[place], np.take(tree.prior, here, axis=0)


def log_probability(v: Vocabulary, table: np.ndarray, token: np.ndarray, row: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 of the probability of each token's leaf; coded: what _coded gives, if known."""
    out = np.zeros(len(token))
    for on, rows, child, prior in _paths(v, table, token, row, coded):
        z = _scores(table, rows, prior)
        own = np.take(z, child).astype(np.float64)
        np.exp(z, out=z)
        out[on] += np.maximum((own - np.log(np.einsum("ij->i", z))) / np.log(10), -35)
    return out


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows, distinct ones, where the run of each begins in that order, and its size.

    A row and its place share 32 bits (ROW_BITS and those of BATCH), so numbers are sorted and not places.
    """
    bits = (BATCH - 1).bit_length()
    key = rows.astype(np.uint32) << np.uint32(bits) | np.arange(len(rows), dtype=np.uint32)
    key.sort()
    ranked = key >> np.uint32(bits)
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return (key & np.uint32((1 << bits) - 1)).astype(np.int64), ranked[at].astype(np.int64), at, np.diff(np.append(at, len(rows)))


def _place_sums(x: np.ndarray, order: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of runs of PIECE places at most, and their sums of x[order] in it: falling sizes, so each place is one slice."""
    by = np.argsort(-size.astype(np.int8), kind="stable")
    at, upto = at[by], len(size) - np.cumsum(np.bincount(size, minlength=PIECE + 1))
    out = np.take(x, order[at], axis=0)
    for k, more in enumerate(upto[1:PIECE].tolist(), 1):
        out[:more] += np.take(x, order[at[:more] + k], axis=0)
    return by, out


def _run_sums(x: np.ndarray, order: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs and the sums of x[order] over them, which begin at `at`: first all short ones, then the long ones by their pieces."""
    short, long = np.flatnonzero(size <= PIECE), np.flatnonzero(size > PIECE)
    if len(short):
        by, sums = _place_sums(x, order, at[short], size[short])
        yield short[by], sums
    if len(long):
        pieces = -(-size[long] // PIECE)
        first = np.cumsum(pieces) - pieces
        past = PIECE * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
        by, sums = _place_sums(x, order, np.repeat(at[long], pieces) + past, np.minimum(PIECE, np.repeat(size[long], pieces) - past))
        parts = np.empty_like(sums)
        parts[by] = sums
        yield long, np.add.reduceat(parts, first, axis=0)


def learn(v: Vocabulary, table: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Update the table in place from batches of (token, row); gives how often each row was used."""
    square, used, whole = np.ones(len(table), np.float32), np.zeros(len(table), np.float32), np.dtype((np.void, table.itemsize * BRANCH))
    entries = table.view(whole)[:, 0]
    for token, row in batches:
        for on, rows, child, prior in _paths(v, table, token, row):
            slope = _softmax(table, rows, prior)
            slope.reshape(-1)[child] -= 1
            for r in rows:
                order, distinct, at, size = _runs(r)
                used[distinct] += size
                for runs, total in _run_sums(slope, order, at, size):
                    own = distinct[runs]
                    squares = np.take(square, own) + np.einsum("ij,ij->i", total, total)
                    square[own] = squares
                    total *= (RATE / np.sqrt(squares))[:, None]
                    np.subtract(np.take(table, own, axis=0), total, out=total)
                    entries[own] = total.view(whole)[:, 0]
    return used


def _updates(facts_b, table_b):
    """(range, rows, weights, times) of the rows that a task has used: places, weights as half floats, uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = Vocabulary.of(facts_b.value), table_b.value.copy()

        def parts():
            for batch in batches:
                for _, _, words in word_chunks(batch.column(0), True):
                    yield tokens_of(words)

        times = learn(v, table, parts())
        each = len(table) // RANGES
        for i in range(RANGES):
            rows = i * each + np.flatnonzero(times[i * each : (i + 1) * each])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int32), table[rows].astype(np.float16), times[rows]))], ["range", "rows", "weights", "times"])

    return run


def _averages(size: int):
    """From _updates, the mean weights (rows, means) by use; size: rows of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, rows, weights, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i not in total:
                    total[i] = np.zeros((size, BRANCH)), np.zeros(size)
                at, k = np.frombuffer(rows, np.int32) - i * size, np.frombuffer(times, np.float32)
                total[i][0][at] += np.frombuffer(weights, np.float16).reshape(-1, BRANCH) * k[:, None]
                total[i][1][at] += k
        for i, (sums, times) in total.items():
            used = np.flatnonzero(times)
            means = (sums[used] / times[used, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in ((used + i * size).astype(np.int32), means)], ["rows", "means"])

    return run


def train(spark: SparkSession, space: Workspace, docs: DataFrame) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """Vocabulary, weights and the counts (word, n) of all tokens of docs(doc_id, text)."""
    docs = bounded_batches(docs)
    counts = space.save(docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # How many words have each count: about the square root of the tokens, at most, and rows above the cut only.
    least, held = 1, 0
    steep = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n"))
    for r in steep.limit(LISTED).toLocalIterator():
        if held + r.k > LISTED:
            least = r.n + 1
            break
        held += r.k
    listed = counts.where(F.col("n") >= least).toArrow()
    v = Vocabulary(listed.column("word").to_numpy().view(np.uint64), listed.column("n").to_numpy(), total, distinct)
    sent, table = spark.sparkContext.broadcast(v.facts()), v.no_weights()
    parts = min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in range(ROUNDS):
        now = spark.sparkContext.broadcast(table)
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == i).select("text")
        got = part.mapInArrow(_updates(sent, now), "range int, rows binary, weights binary, times binary")
        got = got.repartition(parts, "range").mapInArrow(_averages(len(table) // RANGES), "rows binary, means binary").collect()
        table = table.copy()
        for r in got:
            table[np.frombuffer(r.rows, np.int32)] = np.frombuffer(r.means, np.float32).reshape(-1, BRANCH)
        now.destroy()
    return v, table, counts


def score(spark: SparkSession, space: Workspace, docs: DataFrame, v: Vocabulary, table: np.ndarray, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text)."""
    docs = bounded_batches(docs)
    facts_b, table_b = spark.sparkContext.broadcast(v.facts()), spark.sparkContext.broadcast(table)
    base_log = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    tail_log = float(np.log10(v.tail_total + 0.5 * (v.tail_distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        v, table = Vocabulary.of(facts_b.value), table_b.value
        for batch in batches:
            for at, stop, words in word_chunks(batch.column(1), True):
                token, row = tokens_of(words)
                rows = stop - at
                code, distinct, leaf = _coded(v, token)
                n = v.counts(distinct)
                tail, known = (leaf == v.tail)[code], (n > 0)[code]
                half = np.where(n > 0, np.log10(np.maximum(n, 0) + 0.5), 0.0)[code]
                add = lambda x: np.bincount(row, weights=x, minlength=rows)  # noqa: B023, E731
                size = np.bincount(row, minlength=rows)
                base = add(half) - size * base_log
                model = add(log_probability(v, table, token, row, (code, distinct, leaf)) + tail * (half - tail_log))
                rest = np.flatnonzero(~known)
                cut = np.searchsorted(row[rest], np.arange(rows + 1)).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(cut), pa.array(token[rest].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(rows)), batch.column(0).slice(at, rows), pa.array(size.astype(np.int64)), pa.array(add(known).astype(np.int64)), pa.array(base), pa.array(model), others], ["uid", "doc_id", "n_tokens", "known", "base", "model", "others"])
                uid += rows

    first = space.save(docs.select("doc_id", "text").mapInArrow(run, "uid long, doc_id long, n_tokens long, known long, base double, model double, others array<long>"), "scored")
    # Words beyond the listed ones: their counts, 0 where training has none.
    apart = first.select("uid", F.explode("others").alias("word")).join(counts, "word", "left")
    half = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    rest = apart.groupBy("uid").agg(F.sum(half).alias("half"), F.count("n").alias("more"))
    return first.drop("others").join(rest, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("half", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("half", F.lit(0.0))).alias("score"),
    )
