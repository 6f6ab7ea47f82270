"""The training-data operators against brute force, exact round trips and held-out rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import components, host_reputation, language_id, license_rules, maxent_lm, mixing, ngram_join, packing, quality, token_files, transport_stream
from rasterloom.llm.queries import ORACLES, QUERIES
from rasterloom.llm.shared import Workspace
from rasterloom.llm.words import mix64

DATA = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))
ROWS = [(1, None, None, None, None, 5, "x"), (2, "", "en", "a", 0, 5, "x"), (3, " \n\t ", "en", "a", 4, 5, "x"), (4, "one two", "en", "b", 7, 5, "x"), (4, "one two", "en", "b", 7, 5, "x"), (5, LONG, "fr", "b", len(LONG), 5, "x"), (6, "One  TWO", "de", None, 8, 5, "x"), (7, "Über façade 日本 語 don't\u00a0x 12", "de", "a", 9, 5, "x")]


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1
def brute_components(rows, k=5, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    lists, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        overlap = Counter(j for g in s for j in lists[g])
        for j, c in overlap.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            lists[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block_docs", [1024, 4])
def test_join_matches_brute_force(spark, block_docs):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(f"r{i}x{j}" for j in range(60))) for i in range(20)]
    for i in range(20, 60):  # near copies of one text, some too far
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            w[at] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(60 + i, " ".join(base)) for i in range(5)]
    rows += [(70 + i, " ".join(base[:50] + [f"t{i}_{j}" for j in range(80)])) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, df, block_docs=block_docs).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("block_docs", [1024, 4])
def test_join_counts_links(spark, block_docs):
    rng = np.random.default_rng(6)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(40):  # near copies of one text, some too far, some twice
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 5), replace=False):
            w[at] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(40 + i, rows[i % 5][1]) for i in range(12)] + [(60, "alone"), (61, None), (62, "")]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w := words(t, True)) >= 5 else {tuple(w)} - {()} for i, t in rows}
    want = {i: sum(j != i and 100 * len(a & b) >= 80 * len(a | b) > 0 for j, b in sets.items()) for i, a in sets.items()}
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), block_docs=block_docs).collect()}
    assert got == want and max(want.values()) > 20 and len(set(want.values())) > 3


def test_join_on_the_table_and_on_odd_rows(spark, docs, odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, docs).collect()}
    assert got == brute_components(texts_of(docs))
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, odd).collect())
    assert rows[:5] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4)] and rows[-2:] == [(6, 1, 4), (7, 2, 7)]
    assert ngram_join.jaccard_components(spark, none).count() == 0


def test_divide_skip_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, 40).astype(np.uint64)) for _ in range(80)]
    index = ngram_join.Index(sets, 60)
    for q in sets:
        got = dict(zip(*(x.tolist() for x in index.search(q)), strict=True))
        want = {i: len(np.intersect1d(q, s)) for i, s in enumerate(sets)}
        assert got == {i: c for i, c in want.items() if 100 * c >= 60 * (len(q) + len(sets[i]) - c)}


def test_first_lists_share_enough():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = np.sort(rng.choice(10_000, n, replace=False))
        y = np.unique(np.concatenate([x[rng.random(n) > 0.08], rng.choice(10_000, int(rng.integers(0, 6)))]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (n + len(y) - both):
            shared = np.intersect1d(x[: ngram_join.prefix_length(n, 80)], y[: ngram_join.prefix_length(len(y), 80)])
            assert len(shared) >= max(ngram_join.needed(n, 80), ngram_join.needed(len(y), 80))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(Workspace(spark, "test"), edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 2
def brute_measures(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_measures_and_verdicts(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(spark, docs, labels)
    got = {r.doc_id: r for r in quality.score(docs.unionByName(odd.where("doc_id in (5, 7)").select("doc_id", "text").selectExpr("doc_id + 100000 as doc_id", "text"), allowMissingColumns=True), model).collect()}
    for i, text in [*texts_of(docs), (100005, LONG), (100007, ROWS[-1][1])]:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= quality.THRESHOLD)
    told = [(got[r.doc_id].kept, r.quality) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert np.mean([k == (q == 1) for k, q in told]) > 0.95
    assert not any(r.kept for r in quality.score(odd.where("doc_id < 5"), model).collect())
    assert quality.score(none, model).count() == 0
    empty = quality.train(spark, docs, labels.limit(0))
    assert quality.keep_good(odd, empty).columns == odd.columns


# 3
def brute_padding(lengths, k):
    distinct = sorted(set(lengths))
    count = Counter(lengths)
    best = {(0, 0): 0.0}
    for b in range(1, k + 1):
        for j in range(1, len(distinct) + 1):
            best[b, j] = min((best[b - 1, i] + sum(count[x] * (distinct[j - 1] - x) for x in distinct[i:j]) for i in range(j) if (b - 1, i) in best), default=math.inf)
    return min(best.get((b, len(distinct)), math.inf) for b in range(1, k + 1))


def test_packing_is_optimal_and_within_budget(spark, docs, odd, none):
    got = packing.pack(docs, buckets=4, budget=2000, shard_docs=50).toPandas()
    sizes = {i: len(words(t)) for i, t in texts_of(docs)}
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == sizes
    assert got.padding.sum() == brute_padding(list(sizes.values()), 4)
    short = packing.pack(docs.where(mixing.word_count(F.col("text")) <= 300), buckets=3).toPandas()
    assert short.padding.sum() == brute_padding([s for s in sizes.values() if s <= 300], 3)
    batches = got.groupby(["bucket", "shard", "batch"]).agg(n=("doc_id", "size"), b=("bucket_len", "first"), top=("n_tokens", "max"))
    assert ((batches.n * batches.b <= 2000) | (batches.n == 1)).all() and (batches.top <= batches.b).all()
    assert packing.pack(odd).count() == len(ROWS) and packing.pack(none).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 8])
def test_bounds_are_optimal_at_all_lengths(buckets):
    rng = np.random.default_rng(buckets)
    for top, n in ((12, 9), (3000, 60), (5_000_000, 60)):
        lengths = rng.integers(0, top, n).tolist() + [0, top]
        count = Counter(lengths)
        distinct = sorted(count)
        bounds = packing.optimal_bounds(distinct, [count[x] for x in distinct], buckets)
        padding = sum(min(b for b in bounds if b >= x) - x for x in lengths)
        assert len(bounds) <= buckets and padding == brute_padding(lengths, min(buckets, len(distinct)))


# 4
def test_transport_streams_round_trip(spark, docs, odd, none):
    stored = transport_stream.store(odd)
    back = transport_stream.read(stored).collect()
    assert [bytes(r.payload) for r in back] == [transport_stream.pad((t or "").encode()) for _, t in texts_of(odd)]
    assert all(r.continuity_errors == 0 and r.pts[0] == 0 and r.entry_points[0] == 0 for r in back)
    assert transport_stream.digests(transport_stream.store(none)).count() == 0
    for r, (i, t) in zip(transport_stream.digests(transport_stream.store(docs)).orderBy("doc_id").collect(), sorted(texts_of(docs)), strict=True):
        payload = transport_stream.pad((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.tail_crc32) == (i, len((t or "").encode()), len(payload), zlib.crc32(payload[-16:]))


def test_transport_stream_damage_is_seen():
    media = transport_stream.mux(bytes(range(192)) * 200)
    whole = transport_stream.demux(media)
    assert len(whole.pts) == 4 and whole.entry_points == [0]
    lost = media[: 188 * 20] + media[188 * 21 :]
    for broken in (b"x" + media[1:], media[:-1], lost, media[188:], b""):
        with pytest.raises(ValueError):
            transport_stream.demux(broken)


def packets_of(media):
    return [media[i : i + 188] for i in range(0, len(media), 188)]


def test_transport_stream_checks_every_table_copy():
    payload = bytes(range(192)) * 64 * 20  # 20 units, so three copies of the tables
    parts = packets_of(transport_stream.mux(payload))
    copies = [i for i, p in enumerate(parts) if p[1] & 31 == 0 and p[2] == 0]
    assert len(copies) == 3 and transport_stream.demux(b"".join(parts)).payload == payload
    for i in (*copies, *(c + 1 for c in copies)):
        damaged = [bytes([*p[:10], p[10] ^ 4, *p[11:]]) if k == i else p for k, p in enumerate(parts)]
        with pytest.raises(ValueError):
            transport_stream.demux(b"".join(damaged))


def test_transport_stream_duplicates_and_breaks():
    payload = bytes(range(192)) * 100
    parts = packets_of(transport_stream.mux(payload))
    twice = transport_stream.demux(b"".join([*parts[:9], parts[9], *parts[9:]]))
    assert twice.payload == payload and twice.continuity_errors == 0
    thrice = transport_stream.demux(b"".join([*parts[:9], parts[9], parts[9], *parts[9:]]))
    assert thrice.payload == payload and thrice.continuity_errors == 1
    # An open length: a lost packet shortens the payload and breaks the count once, unless it is announced.
    one = packets_of(transport_stream.mux(payload[: 192 * 10]))
    head = bytearray(one[2])
    at = head.index(b"\0\0\1\xbd")
    head[at + 4 : at + 6] = b"\0\0"
    gone = transport_stream.demux(b"".join([*one[:2], bytes(head), *one[3:5], *one[6:]]))
    assert gone.continuity_errors == 1 and len(gone.payload) == 192 * 10 - 184
    # Packets of other identifiers, null packets and those without payload change nothing.
    other = b"\x47\x1f\xff\x10" + bytes(184)
    empty = b"\x47\x01\x01\x20\xb7\x00" + b"\xff" * 182
    assert transport_stream.demux(b"".join([other, *parts[:5], empty, other, *parts[5:]])).payload == payload
    flagged = [bytes([p[0], p[1] | 0x80, *p[2:]]) if i == 7 else p for i, p in enumerate(parts)]
    with pytest.raises(ValueError):
        transport_stream.demux(b"".join(flagged))


def test_transport_stream_long_sections_and_the_network_entry():
    payload = b"x" * 192
    parts = packets_of(transport_stream.mux(payload))
    entry = bytes([0, 1, 0xE0 | transport_stream.PMT_PID >> 8, transport_stream.PMT_PID & 255])
    network = bytes([0, 0, 0xE0, 0x10])
    pat = transport_stream._section(0, 1, network + entry + bytes([0, 9, 0xE1, 0xF0]) * 60)
    body = bytes([0]) + pat  # the pointer, then a section over two packets
    first = b"\x47\x40\x00\x10" + body[:184]
    rest = body[184:]
    second = b"\x47\x00\x00\x11" + rest + b"\xff" * (184 - len(rest))
    got = transport_stream.demux(b"".join([first, second, *parts[1:]]))
    assert got.payload == payload and got.program == 1
    with pytest.raises(ValueError):
        transport_stream.demux(b"".join([first, *parts[1:]]))


def test_transport_stream_nulls_and_clashing_columns(spark):
    media = transport_stream.mux(b"a" * 192)
    stored = spark.createDataFrame([(1, 5, media, "mine", 7), (2, None, None, None, None)], "doc_id long, n_bytes long, media binary, payload string, pts int")
    rows = transport_stream.digests(stored).orderBy("doc_id").collect()
    assert rows[0].payload_bytes == 192 and rows[1].payload_bytes is None and rows[1].feature is None
    back = transport_stream.read(stored).orderBy("doc_id").collect()
    assert (back[0].stored_payload, back[0].stored_pts, bytes(back[0].payload)) == ("mine", 7, b"a" * 192) and back[1].payload is None


# 5
def test_token_files_equal_the_tokenizer(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    marked = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|>b <|endof text|>"), (None, "<|endof"), (None, "text|>"), (None, "b"), (4, LONG + "<|endoftext|>")], "doc_id long, text string")
    assert plain.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    for df in (docs, odd, marked):
        frames = token_files.write_frames(spark, Workspace(spark, "test"), df, path)
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_frames(spark, *frames).collect()), key=lambda r: r[0])
        want, at = [], 0
        order = [(r.doc_id, r.text) for r in df.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text").collect()]
        for i, t in order:
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
            want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want
    assert token_files.read_frames(spark, *token_files.write_frames(spark, Workspace(spark, "test"), none, path)).count() == 0


def test_checkpoints_decode_alone_and_damage_is_seen():
    rng = np.random.default_rng(6)
    ids = (rng.geometric(0.01, 400_000) % 5000).astype(np.uint32)
    coder = token_files.Coder(token_files.shared_table(dict(Counter(ids.tolist()))))
    frame = coder.encode(ids, np.arange(1), np.array([len(ids)]))
    step = token_files.GAP * token_files.LANES
    assert (coder.decode(frame)[2] == ids).all() and (coder.decode(frame, 2)[2] == ids[2 * step : 3 * step]).all()
    with pytest.raises((ValueError, IndexError)):
        coder.decode(frame[:-2000] + bytes(2000))


def test_stored_frames_are_complete_in_themselves():
    rng = np.random.default_rng(7)
    for ids in (np.zeros(1, np.uint32), np.array([49_999, 0], np.uint32), (rng.geometric(0.001, 300_000) * 7 % 50_000).astype(np.uint32)):
        frame = token_files.coded(ids, np.array([5]), np.array([len(ids)]))
        docs, sizes, got = token_files.decoded(frame)
        assert docs.tolist() == [5] and sizes.tolist() == [len(ids)] and (got == ids).all()
    step = token_files.GAP * token_files.LANES
    assert (token_files.decoded(frame, 1)[2] == ids[step : 2 * step]).all()


def test_token_files_tokenise_each_text_once(spark):
    import public_tokenizers

    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").mapInArrow(passing, "doc_id long, text string")
    frames = token_files.write_frames(spark, Workspace(spark, "test"), df, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_frames(spark, *frames).count() == 50
    # Once for the bounds of the ranges, once for the frames.
    assert seen.value == 100


def test_pieces_cut_only_where_the_vocabulary_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, pieces = Tokenizer.from_file(path), token_files.Pieces(path)
    texts = ["", "  a  b", "a \n b\n\nc d", "é x y z", "\n", "a\n", " a", "x\ny z ", "日本 語 a b", "don't 's 12 3a\tb c.d, (e)'f'.g", "<|endoftext|> x", "a\u0085 b", " ", "x× ÷y ß-ü"]
    got, sizes = pieces.encode(*token_files_buffers(texts))
    want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert sizes.tolist() == list(map(len, want)) and got.tolist() == sum(want, [])


def token_files_buffers(texts):
    from rasterloom.llm.words import buffers

    return buffers(pa.array(texts))


# 6
def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in order}
        full |= over


def test_mixing_meets_its_targets(spark, none):
    rows = [(i, f"s{i % 4 if i % 10 else 9}" if i % 11 else None, " ".join(["w"] * (1 + i * 37 % 90))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.copies(spark, df).toPandas()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    source_of = {i: s for i, s, _ in rows}
    got["source"] = [source_of[i] or "null" for i in got.doc_id]
    for source, part in got.groupby("source"):
        key = None if source == "null" else source
        assert part["target"].iloc[0] == pytest.approx(want[key]) and part["source_size"].iloc[0] == sizes[key]
        assert (part["copies"] * part["size"]).sum() == pytest.approx(want[key], rel=0.01)
    assert got["copies"].between(0, 3).all()
    again = mixing.copies(spark, df.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got["copies"], strict=True)) == dict(zip(again.doc_id, again["copies"], strict=True))
    assert mixing.copies(spark, none).count() == 0


def test_mixing_ranks_many_sources(spark):
    rows = [(i, f"host{i * 7919 % 1000:04d}" if i % 100 else None, "w " * (1 + i % 7)) for i in range(2000)]
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    got = mixing.copies(spark, spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).collect()
    want, source_of = brute_targets(sizes), {i: s for i, s, _ in rows}
    assert all(r.target == pytest.approx(want[source_of[r.doc_id]]) for r in got)


def brute_balance(mass, target, aims, cap, slack):
    """Rates by plain descent on the classes' multipliers, sources by bisection."""
    tilt = np.zeros(len(aims))

    def rates(tilt):
        out = np.zeros_like(mass)
        for s in range(len(mass)):
            lo, hi = -60.0, 60.0
            for _ in range(200):
                mid = (lo + hi) / 2
                r = np.minimum(cap, np.exp(mid + tilt))
                lo, hi = (mid, hi) if (mass[s] * r).sum() < target[s] else (lo, mid)
            out[s] = np.minimum(cap, np.exp(lo + tilt))
        return out

    for _ in range(4000):
        slope = (mass * rates(tilt)).sum(axis=0) - aims + slack * tilt
        tilt -= slope / (mass.sum() + slack)
        if np.abs(slope).max() < 1e-8 * mass.sum():
            break
    return rates(tilt)


def test_balance_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    mass = rng.integers(0, 900, (7, 4)).astype(float)
    mass[2, 1:] = 0
    target = mass.sum(axis=1) * np.array([0.3, 2.9, 1.0, 3.0, 0.7, 2.0, 1.5])
    aims = mass.sum(axis=0) * target.sum() / mass.sum()
    slack = 0.02 * mass.sum()
    df = spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate(zip(mass.tolist(), target.tolist(), strict=True))], "source int, mass array<double>, target double")
    got = np.array([r.rates for r in mixing.balance(df, aims.tolist(), 3.0, slack).orderBy("source").collect()])
    want = brute_balance(mass, target, aims, 3.0, slack)
    assert (mass * got).sum(axis=1) == pytest.approx(target) and got.max() <= 3
    assert np.abs((got - want) * mass).max() < 1e-3 * mass.max()
    assert got[0].std() > 0.001


def test_mixing_odd_rows_and_two_families(spark, odd):
    assert mixing.repeat_copies(spark, odd).columns == odd.columns
    space = Workspace(spark, "test")
    cells = spark.createDataFrame([("a", "en", 60.0), ("a", "fr", 40.0), ("b", "en", 30.0), ("b", "fr", 70.0)], "source string, lang string, mass double")
    families = {"source": spark.createDataFrame([("a", 80.0), ("b", 120.0)], "source string, target double"), "lang": spark.createDataFrame([("en", 110.0), ("fr", 90.0)], "lang string, target double")}
    r = mixing.entropy_balance(space, cells, families).withColumn("m", F.col("mass") * F.col("rate")).toPandas()
    assert r.groupby("source").m.sum().to_dict() == pytest.approx({"a": 80, "b": 120}) and r.groupby("lang").m.sum().to_dict() == pytest.approx({"en": 110, "fr": 90})
    rate = r.set_index(["source", "lang"]).rate
    assert rate["a", "en"] * rate["b", "fr"] == pytest.approx(rate["a", "fr"] * rate["b", "en"])
    clash = spark.createDataFrame([(i, f"s{i % 2}", "a b c", i, 1, "x") for i in range(40)] + [(None, None, None, None, None, None)] * 2, "doc_id long, source string, text string, size int, copies int, `row` string")
    out = mixing.repeat_copies(spark, clash)
    assert out.columns == clash.columns and out.where("doc_id is not null").count() == pytest.approx(40, abs=1)


# 7, 9
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas(), con.execute(ORACLES[name]).df()
    order = lambda df: df[sorted(df)].sort_values(sorted(df)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def wrapped(text, prefix="", width=72):
    import textwrap

    return "\n".join("\n".join(prefix + x for x in textwrap.wrap(p, width)) or prefix for p in text.split("\n\n") for p in (p, ""))


def test_license_notices_wrapped_and_plain(spark):
    rules, rows, want = license_rules, [], {}
    assert all(re.search(rules.HINTS, s) for s in rules.SENTENCES)
    for licence, texts in rules.NOTICES.items():
        for text in texts:
            for title in ("", *(t + "\n\n" for t in rules.TITLES.get(licence, ()))):
                for shape in (text, wrapped(text), wrapped(text, "# "), wrapped(text, " * ", 60), "Copyright (c) 2020 Some One\n" + wrapped(text)):
                    i = len(rows)
                    rows.append((i, "Some prose\n\n" + title + shape + "\n\nint main()"))
                    want[i] = licence
    got = {r.doc_id: (r.n_matches, r.licenses) for r in rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x for i, x in got.items() if x != (1, want[i])} == {}


def test_license_rules(spark, odd, none):
    mit = "MIT License\n\nCopyright (c) 2020 Some One. All rights reserved.\n\n" + wrapped(license_rules.MIT)
    rows = [
        (1, "Hi.\nReleased under the MIT License.\nx"),
        (2, mit),
        (3, mit.replace("The above", "An above").replace("hereby", "there")),
        (4, "Licensed under the Apache License, Version 2.0. All rights reserved."),
        (5, "no stop at this line\nLicensed under CC-BY-4.0\nnor at this one"),
        (6, mit + "\n\n" + wrapped(license_rules.BSD_3, "// ")),
        (7, "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
        (8, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ]
    got = {r.doc_id: (r.n_matches, r.licenses) for r in license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "MIT"), 3: (1, "Proprietary"), 4: (2, "Apache-2.0;Proprietary"), 5: (1, "CC-BY-4.0"), 6: (2, "BSD-3-Clause;MIT"), 7: (1, "Apache-2.0"), 8: (1, "GPL-3.0")}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert {r[0]: (r[3], r[4]) for r in con.execute(license_rules.oracle()).fetchall()} == got
    assert all(r.licenses == "" for r in license_rules.scan(odd).collect()) and license_rules.scan(none).count() == 0


def test_url_filter_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://A.COM/en/x"), (5, "http://a.com?x=/en/"), (6, "x://notexample.com/en/7"), (7, "h://www.example.com/en/77#f"), (7, "h://www.example.com/en/77#f")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in host_reputation.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).fillna("-", ["rule"]).collect())
    assert [g[:4] for g in got] == [(1, "", "", "-"), (2, "", "", "-"), (3, "", "", "-"), (4, "a.com", "/en/x", "com/en/"), (5, "a.com", "", "-"), (6, "notexample.com", "/en/7", "com/en/"), (7, "www.example.com", "/en/77", "example.com/en/7"), (7, "www.example.com", "/en/77", "example.com/en/7")]
    assert host_reputation.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    wide = spark.createDataFrame([(None, "h://a.com/en/1", "own", "own", 5, 6)], "page_id long, url string, host string, verdict string, n int, bad int")
    assert [tuple(r) for r in host_reputation.filter_urls(wide).collect()] == [(None, "a.com", "/en/1", "com/en/", "block")]


def test_url_reputation_from_labels(spark):
    pages = spark.createDataFrame([(1, "h://bad.example/x"), (2, "h://sub.bad.example/x"), (3, "h://good.example/x"), (4, "h://new.test/x")], "page_id long, url string")
    labels = [(f"h://bad.example/{i}", "block") for i in range(40)] + [(f"h://good.example/{i}", "allow") for i in range(40)] + [(f"h://s{i % 9}.bad.example/{i}", "block") for i in range(90)]
    told = spark.createDataFrame(labels, "url string, verdict string")
    got = {r.page_id: r.verdict for r in host_reputation.filter_urls(pages, labels=told).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_url_bounds_equal_brute_force(spark):
    """Posterior bounds by plain sums, level by level."""
    rows = [(r.url or "", r.page_id) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in host_reputation.filter_urls(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    n, bad = Counter(), Counter()
    for _, i in rows:
        host, rule, verdict = got[i]
        n[host] += rule is not None
        bad[host] += rule is not None and verdict == "block"
    up = lambda x: ".".join(x.split(".")[-2:])
    top = lambda x: x.split(".")[-1]

    def level(of):
        a, b = Counter(), Counter()
        for h in {got[i][0] for _, i in rows}:
            a[of(h)] += n[h]
            b[of(h)] += bad[h]
        return a, b

    def strength(a, b):
        units = [(a[x], b[x]) for x in a if a[x]]
        if not units:
            return 1.0
        total, p = sum(x for x, _ in units), sum(y for _, y in units) / sum(x for x, _ in units)
        room = total - sum(x * x for x, _ in units) / total
        spread = sum(y * y / x for x, y in units) - total * p * p - (len(units) - 1) * p * (1 - p)
        v = spread / room if room > 0 else 0
        return min(1000.0, max(1.0, p * (1 - p) / v - 1)) if v > 0 else 1000.0

    hosts, domains, tops = level(lambda h: h), level(up), level(top)
    kh, kd, ks = (strength(*x) for x in (hosts, domains, tops))
    prior = (sum(bad.values()) + 1) / (sum(n.values()) + 2)
    for _, i in rows:
        h, rule, verdict = got[i]
        if rule is None:
            at_top = (tops[1][top(h)] + ks * prior) / (tops[0][top(h)] + ks)
            at_domain = (domains[1][up(h)] + kd * at_top) / (domains[0][up(h)] + kd)
            mean = (bad[h] + kh * at_domain) / (n[h] + kh)
            bound = mean - host_reputation.Z * math.sqrt(mean * (1 - mean) / (n[h] + kh + 1))
            assert verdict == ("block" if bound > host_reputation.THRESHOLD else "allow")


# 8
@pytest.mark.parametrize("listed", [1 << 20, 300])
def test_language_model_counts_and_gain(spark, docs, monkeypatch, listed):
    monkeypatch.setattr(maxent_lm, "LISTED", listed)
    got = {r.doc_id: r for r in QUERIES["op8_maxent_lm"](spark, DATA).collect()}
    rows = texts_of(docs)
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t, True), None])
    total, distinct = sum(c.values()), len(c)
    for i, t in rows:
        w = [*words(t, True), None]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(x in c for x in w), total)
        assert r.base_score == pytest.approx(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_log_probability(v, table, tokens, i):
    """Of token i of one text, path by path, from the description alone."""
    mask = (1 << 64) - 1

    start = int(maxent_lm.START)
    one, two = (tokens[i - k] if i >= k else start for k in (1, 2))
    skip = next((t for t in reversed(tokens[:i]) if t in v.anchors), start)
    at = np.flatnonzero(v.modelled == tokens[i])
    leaf = int(v.place[at[0]]) if len(at) else v.tail
    found = 0.0
    for level in range(len(v.tree.node)):
        node = int(v.tree.node[level][leaf])
        if node < 0:
            break
        z = v.tree.prior[node].astype(float)
        for k, f in enumerate([one, skip, (one * int(maxent_lm.PAIR) + two) & mask] if level == 0 else [one, skip]):
            z = z + table[((f + k + 1 & mask) ^ (node + 1) * int(maxent_lm.NODE) & mask) * int(maxent_lm.MIX) % (1 << 64) * len(table) >> 64]
        p = np.exp(z) / np.exp(z).sum()
        found += math.log10(p[v.tree.child[level][leaf]])
    return found


def vocabulary_of(size, seed=1):
    rng = np.random.default_rng(seed)
    n = np.sort(rng.zipf(1.3, size).clip(maxent_lm.LEAST, 100_000))
    return maxent_lm.Vocabulary(np.arange(1000, 1000 + size, dtype=np.uint64), n, int(n.sum()) + 50, size + 40), rng


@pytest.mark.parametrize("size", [0, 3, 40, 5000])
def test_language_model_sums_to_one_and_equals_brute_force(size):
    v, rng = vocabulary_of(size)
    table = rng.normal(size=v.no_weights().shape).astype(np.float32)
    each = np.append(np.arange(1000, 1000 + size, dtype=np.uint64), np.uint64(7))  # the last is no modelled word
    token = np.stack([np.full(len(each), 1000, np.uint64), np.full(len(each), 6, np.uint64), each], axis=1).ravel()
    row = np.repeat(np.arange(len(each)), 3)
    p = maxent_lm.log_probability(v, table, token, row)
    assert (10 ** p[2::3]).sum() == pytest.approx(1, abs=1e-4)
    text = rng.choice(each, 40)
    got = maxent_lm.log_probability(v, table, text, np.zeros(40, int))
    assert got == pytest.approx([brute_log_probability(v, table, text.tolist(), i) for i in range(40)], abs=1e-4)


def test_language_model_updates_follow_the_gradient():
    v, rng = vocabulary_of(200)
    text = rng.choice(v.modelled, 3000)
    row, before = np.zeros(3000, int), v.no_weights()
    after = before.copy()
    used = maxent_lm.learn(v, after, iter([(text, row)] * 3))
    assert maxent_lm.log_probability(v, after, text, row).sum() > maxent_lm.log_probability(v, before, text, row).sum() + 100
    assert ((used > 0) == (after != 0).any(axis=1)).all()
    levels = (v.tree.node[:, v.places(text)] >= 0).sum(axis=1)
    assert used.sum() == 3 * (3 * levels[0] + 2 * levels[1:].sum())


def test_language_model_tree_is_short_where_the_tokens_are():
    # A token's softmaxes are the levels of its path; no tree of 32 branches has fewer than the entropy in base 32.
    n = 1_000_000 // np.arange(1, 20_001)
    levels, share = (maxent_lm.Tree(n).node >= 0).sum(axis=0), n / n.sum()
    assert (levels * share).sum() < 1.25 * -(share * np.log2(share)).sum() / 5


@pytest.mark.parametrize("most", [1, 3, 200, 16384])
def test_language_model_gradients_of_a_row_are_added_whole(most):
    # Runs of one place, of a few, of one piece exactly, and of many pieces.
    rng = np.random.default_rng(most)
    rows = np.repeat(np.arange(16384), rng.integers(1, most + 1, 16384))[:16384].astype(np.int32) * 8 + 3
    rng.shuffle(rows)
    x = rng.normal(size=(len(rows), maxent_lm.BRANCH)).astype(np.float32)
    order, distinct, at, size = maxent_lm._runs(rows)
    want = np.zeros((1 << 17, maxent_lm.BRANCH))
    np.add.at(want, rows, x)
    got, seen = np.zeros_like(want), np.zeros(1 << 17, int)
    for runs, sums in maxent_lm._run_sums(x, order, at, size):
        got[distinct[runs]] += sums
        seen[distinct[runs]] += 1
    assert (seen == np.isin(np.arange(1 << 17), rows)).all() and got == pytest.approx(want, abs=1e-3)


def test_language_model_odd_rows(spark, odd, none):
    for df in (odd, none):
        space = Workspace(spark, "test")
        got = maxent_lm.score(spark, space, df, *maxent_lm.train(spark, space, df)).collect()
        assert len(got) == df.count() and all(math.isfinite(r.score) for r in got)


def test_language_model_chooses_content_words(spark):
    # 600 words, each followed by the one that only it foretells, and a word too rare for the model.
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"a{i} b{i}" for i in rng.integers(0, 600, 40))
    space, rows = Workspace(spark, "test"), [(i, text()) for i in range(2000)] + [(2000, "once")]
    v, table, counts = maxent_lm.train(spark, space, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(v.modelled) == 1201 and v.tail_total == 1
    asked = spark.createDataFrame([(1, " ".join(f"a{i} b{i}" for i in range(300, 600))), (2, " ".join(f"a{i} b{(i + 7) % 600}" for i in range(300, 600)))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in maxent_lm.score(spark, space, asked, v, table, counts).collect()}
    assert got[1] > got[2] + 300 * 0.5


# 10
def test_language_id(spark, odd, none):
    got = QUERIES["op10_zstd_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200").select("doc_id", "lang").toPandas().merge(got[got.held_out], on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    model = language_id.train(odd, language_id.in_training())
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred in ("en", "fr", "de")
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(none, F.lit(True))).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0 and language_id.keep_reliable(odd, model).columns == odd.columns


def test_language_id_equals_brute_force(spark, docs):
    import zstandard

    learned = docs.where(language_id.in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = learned.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("at"), F.xxhash64("text", "doc_id").alias("place")).collect()
    sample, content = 20, 8000
    each, found = content // sample, defaultdict(set)
    count = Counter(r.lang for r in rows)
    for r in rows:
        if r.at < min(1 << 40, (sample << 40) // count[r.lang]):
            start = r.place % max(1, len(r.text) - each + 1)
            found[r.lang].add((r.at, r.text[start : start + each].lower()))
    dictionaries = {lang: "\n".join(t.encode()[: each - 1].decode("utf-8", "ignore") for _, t in sorted(x)).encode() for lang, x in found.items()}
    model = language_id.train(docs, language_id.in_training(), sample, content)
    assert model.content == dictionaries and min(map(len, dictionaries.values())) > 2000
    got = {r.doc_id: (r.lang_pred, r.score, r.reliable) for r in language_id.predict(docs, model).collect()}
    tools = {x: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=language_id.LEVEL, write_content_size=False, write_dict_id=False) for x, d in dictionaries.items()}
    for i, t in texts_of(docs)[:60]:
        low = (t or "").lower()
        size = sorted((sum(len(c.compress(low[k : k + language_id.PIECE].encode())) for k in range(0, len(low), language_id.PIECE)), x) for x, c in tools.items())
        if re.search(r"[^\W\d_]", low):
            want = size[0][1], 1 - size[0][0] / size[1][0]
            assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=0.02) and got[i][2] == (got[i][1] >= language_id.LEAST_MARGIN)
        else:
            assert got[i] == ("und", 0.0, False)


def test_character_grams_follow_code_points():
    from rasterloom.llm.words import split_words

    texts = ["日本語 x", "", "äb", "abc"]
    data, offsets = token_files_buffers(texts)
    points, row = quality.code_points(data, offsets)
    assert "".join(map(chr, points)) == "".join(texts) and row.tolist() == [i for i, t in enumerate(texts) for _ in t]
    _, (three, four) = quality.grams(split_words(data, offsets, False), 16)
    assert three[1].tolist() == [0, 0, 0, 3] and four[1].tolist() == [0, 0]
    broken = np.frombuffer(b"a\xffbc\xe3\x81", np.uint8)
    points, row = quality.code_points(broken, np.array([0, 3, 6]))
    assert "".join(map(chr, points)) == "a\ufffdbc\ufffd" and row.tolist() == [0, 0, 0, 1, 1]


def test_quality_fit_equals_plain_gradients():
    rng = np.random.default_rng(8)
    columns = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(60)]
    shares = [np.full(6, 1 / 6, np.float32)] * 60
    label = np.array([float(5 in c or 7 in c) for c in columns])
    m = quality.fit_model(columns, shares, label, 5)
    z = np.array([m.weights[c] @ s + m.bias for c, s in zip(columns, shares, strict=True)])
    # Nothing that one coordinate could gain: the fit is at the optimum of a convex loss, nearly.
    assert ((z > 0) == (label > 0))[np.arange(60) % 4 != 3].all() and m.slope > 0


def test_null_ids_repeats_and_long_texts(spark):
    """Null doc_ids, rows that repeat and a text over the chunk size in every operator of documents."""
    schema, long = "doc_id long, text string, lang string, source string, payload string, media int, chain string", " ".join(f"v{i * 31 % 7919}" for i in range(800_000))
    rows = [(None, "one two three four five six", "en", "a", "p", 1, "c")] * 2 + [(None, None, None, None, None, None, None), (7, long, "en", "a", "p", 1, "c"), (7, long, "en", "a", "p", 1, "c"), (8, "one two three four five six", "en", "b", "p", 1, "c")]
    df = spark.createDataFrame(rows, schema)
    assert len(long) > 4 << 20
    joined = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in ngram_join.jaccard_components(spark, df).collect())
    size = len({tuple(w) for w in zip(*(long.split()[k:] for k in range(5)))})
    assert joined == [("7", size, "7", 1), ("7", size, "7", 1), ("8", 2, "8", 2), ("None", 0, "None", 0), ("None", 2, "8", 2), ("None", 2, "8", 2)]
    model = quality.train(spark, df, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int"))
    assert sorted(r.n_words for r in quality.score(df, model).collect()) == [0, 6, 6, 6, 800_000, 800_000]
    assert quality.keep_good(df, model).columns == df.columns
    learned = language_id.train(df, language_id.in_training())
    assert language_id.predict(df, learned).count() == 6 and language_id.keep_reliable(df, learned).columns == df.columns
    assert mixing.copies(spark, df).count() == 6 and packing.pack(df).agg(F.sum("n_tokens")).first()[0] == 1_600_018
    space = Workspace(spark, "test")
    assert maxent_lm.score(spark, space, df, *maxent_lm.train(spark, space, df)).agg(F.sum("n_tokens")).first()[0] == 1_600_024
    back = transport_stream.digests(transport_stream.store(df)).collect()
    assert sorted(r.n_bytes for r in back) == sorted(len((r[1] or "").encode()) for r in rows)
    assert license_rules.scan(df).count() == 6


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_components_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    monkeypatch.setattr(components, "LEAST_DEGREE", 20)
    rng = np.random.default_rng(11)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 3000, (1500, 2))] + [(5000, i) for i in range(5001, 5300)] + [(9000 - i, 9001 - i) for i in range(100)] + [(4, 4)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.root for r in components.connected_components(Workspace(spark, "test"), df).collect()} == want
    named = df.select(F.lpad(F.col("a").cast("string"), 8, "0").cast("binary").alias("a"), F.lpad(F.col("b").cast("string"), 8, "0").cast("binary").alias("b"))
    assert {int(r.node): int(r.root) for r in components.connected_components(Workspace(spark, "test"), named).collect()} == want


def test_join_takes_boilerplate_chains_apart(spark):
    # Texts that share a passage, most of them with one near copy: one block at first.
    rng = np.random.default_rng(12)
    shared, rows = [f"p{i}" for i in range(40)], []
    for i in range(150):
        body = [f"x{i}y{j}" for j in range(60)]
        rows.append((2 * i, " ".join(shared + body)))
        if i % 3:
            body[int(rng.integers(60))] = "z"
            rows.append((2 * i + 1, " ".join(shared + body)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), block_docs=16).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("alike", [40, 92])
def test_join_posts_less_of_large_blocks_than_the_first_lists(spark, monkeypatch, tmp_path, alike):
    """Texts chained by a passage, or near copies: rows of postings that each step makes of texts of 100 words, in groups of two sizes."""
    kind, logs = type(spark.range(0)), []
    plain = kind.mapInArrow

    def counted(self, func, schema, *args, **more):
        if not {"token", "fp"} <= {c.split()[0] for c in str(schema).split(", ")}:
            return plain(self, func, schema, *args, **more)
        log = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        open(log, "w").close()
        logs.append(log)

        def run(batches):
            for batch in func(batches):
                with open(log, "a") as f:
                    f.write(f"{len(batch)}\n")
                yield batch

        return plain(self, run, schema, *args, **more)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    made = []
    for group in (64, 128):
        logs.clear()
        rows = [(i, " ".join([f"p{j}" for j in range(alike)] + [f"x{i}y{j}" for j in range(100 - alike)])) for i in range(group)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), block_docs=16).collect()}
        assert got == brute_components(rows)
        made.append([sum(int(x) for x in open(log)) for log in logs])
        # The first lists hold the first 30 or so of 96 shingles.
        assert 0 < max(made[-1]) <= group * ngram_join.prefix_length(96, 80)
    assert len(made[0]) == len(made[1]) and all(b <= 2 * a + group for a, b in zip(*made, strict=True))


def test_frequency_codes_never_count_too_few():
    rng = np.random.default_rng(14)
    sets = [np.unique(mix64(rng.choice(5000, 60).astype(np.uint64))) for _ in range(200)]
    owners = [int(x) for x in rng.integers(-3, 3, len(sets))]
    batches = [pa.RecordBatch.from_arrays([pa.array(owners[i : i + 50], pa.int64()), pa.array([s.tobytes() for s in sets[i : i + 50]], pa.binary())], ["block", "sets"]) for i in range(0, 200, 50)]
    for bits in (16, 18):
        slots = [x for half in (batches[:2], batches[2:]) for x in ngram_join._slot_counts(bits)(iter(half))]
        codes = np.zeros((1 << bits - 16, 1 << 16), np.uint8)
        for out in ngram_join._frequency_codes(iter(slots)):
            codes[out.column(0)[0].as_py()] = np.frombuffer(out.column(1)[0].as_py(), np.uint8)
        true = Counter((b, int(x)) for b, s in zip(owners, sets, strict=True) for x in s)
        code = {k: int(codes.ravel()[ngram_join._in_block(k[0], np.array([k[1]], np.uint64))[0] >> np.uint64(64 - bits)]) for k in true}
        assert all(code[k] >= (1 + int(12 * np.log2(n / 2)) if n > 1 else 0) for k, n in true.items())
        # Nearly all that nobody shares has a slot of its own.
        alone = [k for k, n in true.items() if n == 1]
        assert sum(code[k] > 0 for k in alone) < 0.2 * len(alone)
