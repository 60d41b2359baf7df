"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import _base, ann, exact, hmm, labelled, mixing, near, packing, quality, queries, repeats, sharding, toxicity

random.seed(3)
WORDS = ["ab", "Cd", "efg", "hij", "kl", "mnop", "qr", "st", "uvw", "xyz", "é", "ñu"]
LONG = " ".join(random.choice(WORDS) for _ in range(3000))
BASE = " ".join(random.choice(WORDS) + str(i % 97) for i in range(120))
ROWS = [
    (1, None, "en", None, 1), (2, "", "en", "b", 2), (3, " \t\n", "en", "b", 3), (4, LONG, "en", "a", 4), (5, BASE, "de", "a", 5), (6, BASE, "de", "a", 6), (6, BASE, "de", "a", 6),
    (7, BASE + " tail words here", "de", "a", 7), (None, "a row without id", "en", "c", 8), (8, "Shti " * 400, "en", "c", 9), (9, "one two", "en", None, 10), (10, "ONE two", "en", "c", 11),
    (11, "x" * 5000, "en", "c", 12), (12, LONG[:900] + " another end", "en", "a", 13), (13, "<|endoftext|> é ß 漢字 " + " " * 300, "en", "a", 14),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, node string, target double, size string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    """With other columns whose names are used inside the operators."""
    return spark.createDataFrame([(*r, 7, "n", 0.5, "s", "l") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 14)] + [(4, None, None), (None, 1, 1), (99, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")


def key(r):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in r)


def test_packing_holds_every_id_once(docs, none):
    t = Tokenizer.from_file(packing.default_ranks().replace(".tiktoken", ".json"))
    got = packing.pack(docs).collect()
    texts = collections.Counter((r[0], r[1] or "") for r in ROWS)
    want = collections.Counter()
    for (i, text), n in texts.items():
        want[i, len(t.encode(text, add_special_tokens=False).ids) + 1] += n
    seen = collections.defaultdict(list)
    for p in got:
        seen[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    assert {k for k in seen} == set(want)
    for (i, text), n in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        parts = sorted(seen[i, len(ids)])
        assert sum(p[1] for p in parts) == n * len(ids)
        assert all(zlib.crc32(ids[a : a + m].tobytes()) == c for a, m, c in parts)
    sequences = collections.defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(itertools.accumulate([0] + [n for _, n in s[:-1]]))
        total = sum(n for _, n in s)
        assert total <= 2048 and total & (total - 1) == 0  # no padding
    assert packing.pack(none).count() == 0
    assert "".join(packing.parts(LONG * 20, 999)) == LONG * 20


def test_mixing_sizes_targets_and_copies(docs, none):
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(ROWS) and sorted(map(key, got)) == sorted(map(key, mixing.mix_sizes(docs.repartition(5)).collect()))
    size = {i: len((t or "").encode().split()) for i, t, *_ in ROWS}
    assert all(r["size"] == size[r.doc_id] and r.taken in [k * r["size"] for k in range(4)] for r in got)
    by = {r.source_size: r.target for r in got}
    assert all(t <= 3 * s + 1e-9 for s, t in by.items())
    assert math.isclose(sum(by.values()), sum(r["size"] for r in got))
    assert mixing.mix_sizes(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.filter("size = 's'").count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).count() == 0


def test_karmarkar_karp_is_tighter_than_greedy():
    rng = random.Random(5)
    x = sorted((rng.randrange(1000, 100000) for _ in range(400)), reverse=True)
    sums = np.zeros((400, 4), np.int64)
    sums[:, 0] = x
    goes, final = sharding.difference(sums)
    load = np.bincount(goes[:, 0], x, 4)
    assert sorted(load) == sorted(final)
    greedy = [0] * 4
    for v in x:
        greedy[greedy.index(min(greedy))] += v
    assert max(load) - min(load) <= max(greedy) - min(greedy)


def test_sharding_keeps_equal_texts_together(docs, none, monkeypatch):
    for groups, fan in ((20_000, 512), (3, 2)):  # the second needs several rounds
        monkeypatch.setattr(sharding, "GROUPS", groups)
        monkeypatch.setattr(sharding, "FAN_IN", fan)
        got = sharding.shard_bytes(docs, 4).collect()
        assert len(got) == len(ROWS) and {r.law for r in got} == {"bytes"}
        where = collections.defaultdict(set)
        for r in got:
            where[r.text_crc32].add(r.shard)
        assert all(len(s) == 1 for s in where.values())
        for s in range(4):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for _, t, *_ in ROWS)
    assert sharding.shard_bytes(none, 4).count() == 0


def brute_near(rows, link):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= link * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min((x for x in (least.get(find(a)), i) if x is not None), default=None)
    return [(i, len(sets[a]), least[find(a)], i == least[find(a)]) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("per_row, alone", [(near.PAIRS_PER_ROW, near.ALONE), (0, 0)])
def test_near_duplicates_as_brute_force(spark, docs, none, monkeypatch, per_row, alone):
    monkeypatch.setattr(near, "PAIRS_PER_ROW", per_row)
    monkeypatch.setattr(near, "ALONE", alone)
    monkeypatch.setattr(near.links_of, "__defaults__", (near.WIDTH, alone, per_row))
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in ROWS]
    words = BASE.split()
    for k in range(40):  # a chain of near copies around the threshold
        w = list(words)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"new{k}{rng.randrange(99)}"
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bands string")
    for link in (85, 80):
        got = [tuple(r) for r in near.near_duplicates(df, link).collect()]
        assert sorted(map(key, got)) == sorted(map(key, brute_near(rows, link)))
    kept = near.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(key, ((r.doc_id,) for r in kept.collect()))) == sorted(map(key, [(i,) for i in (1, 2, 3, 4, 5, None, 8, 9, 11, 12, 13)]))
    assert near.near_duplicates(none).count() == 0 and near.deduplicate(none).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(1, 1 << 62, 60).astype(np.uint64)])
    owner = np.repeat([0, 1, 2], [300, 300, 1])
    s = near.sketches(owner, np.concatenate([a, b, a[:1]]), 4)
    assert (s[:3] != near.NONE).all() and (s[3] == near.NONE).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15


def thue_morse(n):
    """A string over two letters and its complement, which agree in every polynomial hash modulo 2**64 from 1,024 bytes on."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bytes(97 + b for b in bits[:n]).decode(), bytes(98 - b for b in bits[:n]).decode()


def test_arithmetic_modulo_the_prime():
    p = _base.PRIME
    rng = np.random.default_rng(0)
    a, b = (np.append(rng.integers(0, p, 200, dtype=np.uint64), np.array([p - 1, p - 1, 0], np.uint64)) for _ in range(2))
    assert [int(x) for x in _base.times(a, b)] == [int(x) * int(y) % p for x, y in zip(a, b)]
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    got = _base.span_hash(_base.prefix_hash(data, _base.BYTE), np.array([5, 100]), np.array([2900, 100]))
    assert [int(x) for x in got] == [sum(int(_base.BYTE[data[5 + i]]) * pow(_base.BASE, i, p) for i in range(2895)) % p, 0]


@pytest.mark.parametrize("n", [1024, 4096, 65536])
def test_complementary_strings_stay_apart(spark, n):
    a, b = thue_morse(n)
    df = spark.createDataFrame([(0, a), (1, b), (2, f"{a} z"), (3, f"{b} y")], "doc_id long, text string").repartition(2)
    assert [(r.doc_id, r.component_id) for r in near.near_duplicates(df).orderBy("doc_id").collect()] == [(i, i) for i in range(4)]
    words = {w: c for w, c in hmm.counts(df).groupBy("w").agg(F.sum("c")).collect()}
    assert sorted(words.values()) == [1, 1, 2, 2]
    if n <= 4096:
        want = brute_repeats([t.encode() for t in (a, b, f"{a} z", f"{b} y")], 400)
        assert [tuple(r)[1:] for r in repeats.report(df).orderBy("doc_id").collect()] == want


def test_smallest_is_what_ordering_all_rows_gives(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(20).collect()]
    assert [r.id for r in _base.smallest(df, 20, "id").collect()] == want
    assert _base.smallest(df, 20, "g").count() == 20  # two keys: a cut by their hashes may leave none


def brute_repeats(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 240, 61])
def test_repeats_as_brute_force(spark, docs, none, monkeypatch, length):
    rng = random.Random(6)
    passage = " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(150))
    rows = [(r[0], r[1]) for r in ROWS]
    for k in range(12):
        own = " ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(60))
        cut = rng.randrange(200)
        rows.append((100 + k, own[: rng.randrange(300)] + passage[cut : cut + rng.randrange(380, 600)] + own))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    want = sorted(map(key, ((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], length)))))
    assert sorted(map(key, repeats.report(df, length).collect())) == want
    monkeypatch.setattr(repeats, "CHUNK", 2000)  # long texts in parts
    found = repeats.blocks(*_base.texts_of(__import__("pyarrow").array([LONG])), length)
    assert (found[2] - found[1] + 1).sum() == len(LONG.encode()) - length + 1
    out = repeats.cut(docs, length)
    assert out.columns == docs.columns and out.filter("text is null").count() == 1
    assert repeats.report(none, length).count() == 0 and repeats.cut(none, length).count() == 0


def test_op9_returns_what_is_left(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(n))
    long, short, odd = words(110), words(30), "é" * 300
    rows = [(1, f"{words(40)} {long} {words(40)}"), (2, f"{words(9)} {long}"), (3, f"{short} {words(99)}"), (4, f"{words(70)} {short}"), (5, f"è{odd}a"), (6, f"¨{odd}b"), (7, None), (8, ""), (8, words(70))]
    assert len(long.encode()) > 400 > len(short.encode())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_suffix_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = got.collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 400))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert not any(long in r.text for r in got) and sum(short in r.text for r in got) == 2
    assert all(r.text == next(t or "" for i, t in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes) for r in got if not r.n_removed)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got if r.doc_id not in (5, 6))
    (cut,) = (r for r in got if r.doc_id == 6)  # its first character ends with the byte that ends the other text's
    assert cut.text == "b" and cut.kept_sha256 == hashlib.sha256(b"\xc2b").hexdigest()


@pytest.mark.parametrize("op, column", [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_classifiers_on_odd_rows(spark, docs, none, labels, op, column):
    got = op(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert op(none, labels).count() == 0
    assert op(docs, labels.limit(0)).count() == len(ROWS)
    held = labels.filter(labelled.fold() == 0)
    changed = labels.filter(labelled.fold() != 0).unionByName(held.withColumn(column, 1 - F.col(column)))
    assert sorted(map(key, op(docs, changed).collect())) == sorted(map(key, got))  # held-out labels are never read


def test_classifiers_learn(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(WORDS) + rng.choice("abcd") for _ in range(rng.randrange(20, 80))]
        bad, rude = i % 3 == 0, i % 4 == 0
        if rude:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumbo", "flitz"])
        rows.append((i, " ".join(x + "%%%" if bad else x for x in w)))
        marks.append((i, int(not bad), int(rude)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for op, column in ((quality.classify, "quality"), (toxicity.classify, "toxic")):
        held = op(docs, labels).filter("held_out").join(labels, "doc_id").collect()
        assert len(held) > 60 and sum(r.predicted == r[column] for r in held) > 0.9 * len(held)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_learn_off_the_driver(spark, docs, none, labels, module, monkeypatch):
    here, fit = [], module.fit
    monkeypatch.setattr(module, "fit", lambda rows, *more: (here.append(len(rows)), fit(rows, *more))[1])  # a task appends to its own copy
    got, empty = module.train(docs, labels), module.train(none, labels)
    assert not any(here)
    some = labelled.training_rows(docs, labels, {quality: "quality", toxicity: "toxic"}[module]).collect()
    assert len(some) > 1 and np.isclose(empty.bias, 0).all() and np.isfinite(got.bias).all()


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(0, 1, 40), rng.normal(0, 1, (40, 3)), np.zeros((1, 1)))
    ids, x = np.array([3, 7, 20]), np.array([0.5, -1.0, 2.0])
    z, _, _ = m.forward(np.array([0, 3]), ids, x)
    pairs = sum(m.v[a] @ m.v[b] * x[i] * x[j] for (i, a), (j, b) in itertools.combinations(enumerate(ids), 2))
    assert np.isclose(z[0], 0.3 + m.w[ids] @ x + pairs)


def test_recurrent_gradients():
    net = toxicity.Network(0.4)
    for k in toxicity.PARAMETERS:
        setattr(net, k, getattr(net, k).astype(np.float64))
    text = (LONG[:2000] + " " + BASE).encode()
    b = toxicity.batch_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w, y = b.windows[:5], np.array([0, 1, 1, 0, 1.0])

    def loss():
        _, pre = net.inputs(b)
        states = np.concatenate([net.direction(pre, w, net.uf, False), net.direction(pre, w, net.ub, True)], axis=2)
        z = net.pooled(states, w)[0].astype(float)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = net.gradients(b, w, y)
    for k in ("wx", "uf", "ub", "att", "out", "bias"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        p = getattr(net, k)
        p[at] += 1e-2
        up = loss()
        p[at] -= 2e-2
        assert np.isclose(g[k][at], (up - loss()) / 2e-2, rtol=2e-2)
        p[at] += 1e-2


def test_language_model(docs, none):
    rows = [((r[0]), (r[1] or "").encode().lower().split() + [None]) for r in ROWS]
    known = collections.Counter(w for i, ws in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(known.values()), len(known)
    for hot in (hmm.HOT, 5):
        got = hmm.score(docs, passes=1, hot=hot).collect()
        want = [(i, len(ws), sum(known[w] > 0 for w in ws), n, round(sum(math.log10((known[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, ws in rows]
        assert sorted(map(key, [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got])) == sorted(map(key, want))
        assert all(r.score < 0 for r in got)
    assert hmm.score(none).count() == 0


def test_forward_and_expected_counts():
    rng = np.random.default_rng(3)
    m = hmm.Model(rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(hmm.SYMBOLS), 8).T)
    seqs = [rng.integers(0, hmm.SYMBOLS, n) for n in (1, 2, 70)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = hmm.forward(m, np.concatenate(seqs), off)
    for s, g in zip(seqs, got):
        a, log = m.start * m.emit[s[0]], 0.0
        for x in s[1:]:
            log += math.log10(a.sum())
            a = (a / a.sum()) @ m.move * m.emit[x]
        assert math.isclose(log + math.log10(a.sum()), g, rel_tol=1e-9)
    starts, moves, emits, log = hmm.expected(m, np.concatenate(seqs), off, np.ones(3, bool))
    assert math.isclose(starts.sum(), 3) and math.isclose(moves.sum(), off[-1] - 3) and math.isclose(emits.sum(), off[-1])
    want = plain_expectation(m, seqs)
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip((starts, moves, emits, log), want)) and math.isclose(log, got.sum(), rel_tol=1e-9)


def plain_expectation(m, seqs):
    """Forward and backward step by step, without lanes, pieces or scaled sums over texts."""
    starts, moves, emits, log = np.zeros(8), np.zeros((8, 8)), np.zeros((hmm.SYMBOLS, 8)), 0.0
    for s in seqs:
        a, b, c = np.zeros((len(s), 8)), np.ones((len(s), 8)), np.zeros(len(s))
        for t, x in enumerate(s):
            a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * m.emit[x]
            c[t] = a[t].sum()
            a[t] /= c[t]
        for t in range(len(s) - 2, -1, -1):
            b[t] = m.move @ (m.emit[s[t + 1]] * b[t + 1]) / c[t + 1]
        for t, x in enumerate(s):
            emits[x] += a[t] * b[t]
            if t:
                moves += np.outer(a[t - 1], m.emit[x] * b[t] / c[t]) * m.move
        starts += a[0] * b[0]
        log += np.log10(c).sum()
    return starts, moves, emits, log


def test_likelihood_rises_until_it_converges(spark):
    rng = random.Random(4)
    kinds = [[f"{c}{i}" for i in range(30)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3 if j < 20 else (i + 1) % 3]) for j in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = hmm.counts(df.filter(~hmm.held_out()))
    texts = hmm.encoded(df, spark.sparkContext.broadcast(hmm.vocabulary(table, df.filter(~hmm.held_out()).count())))
    _, trace = hmm.fit(texts, passes=20)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and 2 <= len(trace) < 20 and trace[-1] - trace[-2] < hmm.GAIN




@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [1.0, 2.0]), (None, rows[0][1]), (20, rows[20][1])]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, list int").repartition(3), rows


def brute_top(rows, zero, k=20, whole=False):
    ok = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    x = np.floor(64 * x) if whole else x
    out = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        mine = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), int(ids[j]), float(s[j])) for j in mine]
    return out


def test_exact_search(spark, vectors, monkeypatch):
    df, rows = vectors
    rows20 = [r for r in rows if r[0] != 20]
    want = collections.Counter(t for t in brute_top(rows, True, whole=True) if t[0] != 20)
    for leaf, cell in ((256, 4096), (4, 64)):
        monkeypatch.setattr(exact.CoverTree.__init__, "__defaults__", (leaf,))
        monkeypatch.setattr(exact, "CELL", cell)
        got = exact.search(df).filter("query_id <> 20").collect()
        assert collections.Counter((r.query_id, r.vec_id, float(r.score)) for r in got) == want
    assert len(rows20) and exact.search(df.limit(0)).count() == 0


def test_clustered_vectors_meet_few_cells(spark, monkeypatch):
    """Rows go only to the groups of queries that ask for their cell, and results are those of brute force."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 40, (6, 8))
    x = np.concatenate([c + rng.normal(0, 0.4, (150, 8)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for name, value in (("CELL", 150), ("QUERIES", 8)):
        monkeypatch.setattr(exact, name, value)
    whole = np.floor(64 * x)
    s = whole @ whole.T
    want = []
    for q in range(0, len(x), 10):
        order = sorted((-s[q, j], j) for j in range(len(x)) if j != q)[:5]
        want += [(q, r + 1, j, int(-v)) for r, (v, j) in enumerate(order)]
    seen = []
    staged = _base.staged
    monkeypatch.setattr(exact._base, "staged", lambda df, name, *a: seen.append((name, out := staged(df, name, *a))) or out)
    got = sorted(tuple(r) for r in exact.search(df, 10, 5).collect())
    pairs = dict(seen)["exact-pairs"]
    assert got == want and pairs.count() < pairs.select("part").distinct().count() * pairs.select("pivot").distinct().count()


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.05, (300, 4)) for c in (-9, 0, 9)]) * 64 // 1
    q = x[600:640]
    s = exact.Search(q, np.arange(40) + 5000, np.full(40, -np.inf), x, np.arange(900), 5)
    s.run()
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :5]
    assert np.array_equal(s.score[np.argsort(s.qid)], want) and s.pairs < 0.7 * 40 * 900


def test_approximate_search(spark, vectors):
    df, rows = vectors
    got = ann.search(df).collect()
    want = {(a, b) for a, b, _ in brute_top(rows, False)}
    have = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(want & have.keys()) >= 0.9 * len(want)
    at = {i: np.array(v) for i, v in rows if v and i not in (2040, 2060, 2080, 2100)}
    assert all(math.isclose(s, float(at[a] @ at[b]), abs_tol=1e-12) for (a, b), s in have.items())
    assert ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["lengths", "clusters", "near copies", "tails"])
def test_approximate_search_misses_no_nearest_of_other_vectors(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "BLOCK", 1500)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 32))
    if kind == "lengths":
        x *= np.exp(2 * rng.normal(size=(4000, 1)))
    elif kind == "clusters":
        x = rng.normal(size=(25, 32))[rng.integers(0, 25, 4000)] + 0.3 * x
    elif kind == "near copies":
        x[::2] = x[0] + 1e-4 * x[::2]
        x[1000:1400:2] = x[0]
    else:
        x = rng.standard_t(1.5, size=(4000, 32))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    want = {}
    for q in range(0, 4000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want |= {(q, i + 1): (int(j), float(s[j])) for i, j in enumerate(np.lexsort((np.arange(4000), -s))[:20])}
    assert got == want


def test_approximate_search_of_few_vectors_returns_all(spark):
    x = np.random.default_rng(12).normal(size=(12, 8))
    ids = [0, 1, 2, 3, 4, 5, 20, 7, 8, 9, 10, 10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = ann.search(df, every=10).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got if r["query_id"] != 10} == {0: 11, 20: 11}


def test_expectation_over_pieces_is_that_of_whole_texts():
    rng = np.random.default_rng(5)
    m = hmm.Model(rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(hmm.SYMBOLS), 8).T)
    sizes = [1, 16, 17, 90, 300, 5]
    symbols, off = rng.integers(0, hmm.SYMBOLS, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    want = hmm.expected(m, symbols, off, np.ones(len(sizes), bool))
    cut, first = hmm.pieces(off, 16)
    got = hmm.expected(m, symbols, cut, first, *hmm.joined(m, symbols, cut, first))
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(got, want))
    assert math.isclose(got[1].sum(), sum(sizes) - len(sizes))


def test_near_copies_with_null_or_equal_ids_leave_one_row(spark):
    rng = random.Random(7)
    copies = [BASE + f" tail{k}" for k in range(3)]
    other = " ".join(f"w{rng.randrange(999)}" for _ in range(120))
    rows = [(None, t) for t in copies] + [(7, other + f" end{k}") for k in range(3)] + [(7, LONG), (None, "some words of its own here and now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near.deduplicate(df).collect()]
    assert len(got) == 4 and sum(t in copies for _, t in got) == 1 and sum(t.startswith(other) for _, t in got) == 1


def test_differencing_as_a_plain_version():
    """Partitions as lists of parts; the two of the largest spread are combined, the largest part of one with the smallest of the other."""
    rng = random.Random(11)
    for n, k in ((1, 3), (9, 3), (60, 5), (200, 24)):
        sizes = [rng.randrange(1, 10**9) for _ in range(n)]
        parts = [[[s]] + [[] for _ in range(k - 1)] for s in sizes]
        while len(parts) > 1:
            parts.sort(key=lambda p: sum(p[0]) - sum(p[-1]))
            a, b = parts.pop(), parts.pop()
            parts.append(sorted((x + y for x, y in zip(a, b[::-1])), key=sum, reverse=True))
        sums = np.zeros((n, k), np.int64)
        sums[:, 0] = sizes
        goes, final = sharding.difference(sums)
        assert sorted(final.tolist()) == sorted(map(sum, parts[0]))
        got = [sorted(s for s, g in zip(sizes, goes[:, 0]) if g == j) for j in range(k)]
        assert sorted(got) == sorted(map(sorted, parts[0]))


def test_recurrent_network_as_a_plain_version():
    """Each window by itself, step by step, in both directions, and its attention."""
    rng = np.random.default_rng(2)
    net = toxicity.Network(0.3, 5)
    net.words[:] = rng.normal(0, 0.5, net.words.shape)
    text = " ".join(f"w{i % 37}" for i in range(75)).encode()
    b = toxicity.batch_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    x, _ = net.inputs(b)
    h, one = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    want = []
    for window in b.windows:
        words = [w for w in window if w >= 0]
        both = []
        for back, u in ((0, net.uf), (1, net.ub)):
            state, states = np.zeros(h), []
            for w in words[::-1] if back else words:
                a = (x[w] @ net.wx + net.bx)[3 * h * back : 3 * h * (back + 1)]
                r = state @ u
                z, reset = one(a[:h] + r[:h]), one(a[h : 2 * h] + r[h : 2 * h])
                state = (1 - z) * np.tanh(a[2 * h :] + reset * r[2 * h :]) + z * state
                states.append(state)
            both.append(states[::-1] if back else states)
        states = np.concatenate([np.array(s) for s in both], axis=1)
        a = np.exp(states @ net.att)
        want.append((a / a.sum()) @ states @ net.out + net.bias[0])
    assert np.allclose(net.logits(b), want, atol=1e-4) and math.isclose(net.text_logits(b)[0], max(want), abs_tol=1e-4)
    assert len(want) == 1 + -(-(75 - toxicity.WINDOW) // toxicity.STRIDE)


def test_very_long_texts_in_parts(monkeypatch):
    """As the same text at once: windows, and added features; a text's neighbours do not matter."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["x!!", "ABC", "é", "\n", "9"]
    net = toxicity.Network(0.3, 5)
    net.words[:] = rng.normal(0, 0.5, net.words.shape)
    monkeypatch.setattr(toxicity, "LANES", 3)
    for n in (0, 1, 31, 32, 33, 79, 80, 81, 500):
        text = "  " + " ".join(rng.choice(words, n)) + " " * 40
        data = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(data)])
        assert math.isclose(net.long_logit(data), net.text_logits(toxicity.batch_of(data, off))[0], abs_tol=1e-5), n
        whole = labelled.text_features(data, off, 1 << 10)
        for most in (16, 100, len(data)):
            ((part, cut),) = labelled.features_by_parts(data, off, 1 << 10, most)
            assert part == slice(0, 1) and all(np.allclose(a, b) for a, b in zip(whole, cut)), (n, most)
    two = np.frombuffer(b"same word word other", np.uint8)
    assert labelled.text_features(two, np.array([0, 10, 20]), 1 << 10)[3][1][9] == 0


def test_training_rows_are_bounded(spark):
    df = spark.createDataFrame([(i % 40, f"text {i} " * 3) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = labelled.training_rows(df, labels, "quality").collect()
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(rows) == sorted((min(f"text {j} " * 3 for j in range(i, 400, 40)), i % 2) for i in kept)
    assert labelled.training_rows(df, labels, "quality", 7).count() == 7
    assert 0 < labelled.training_rows(df, labels, "quality", 40, 100).count() < 9
