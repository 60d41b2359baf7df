"""The pipeline stage by stage: columns, decisions, odd rows, an empty table."""

import collections
import itertools
import random

import corpus_pipeline
from gridloom.llm import mixing, quality, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_on_odd_rows(spark, tmp_path):
    body = " ".join(f"word{i % 53}x{i % 11}" for i in range(200))
    rows = [(i, f"{body} end{i} {i * 7}", "en", "a" if i % 2 else None, 9) for i in range(6)] + [(7, None, None, "b", None), (8, "", "en", "b", 0), (9, body, "en", "b", 5), (9, body, "en", "b", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "suffix_dedup", "mixing", "packing"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name == "mixing":
            assert counts[-1] == sum(r["copies"] for r in mixing.mix_sizes(before).collect())
    assert counts[0] == len(rows) and 0 < counts[1] < len(rows)
    assert quality.THRESHOLD == 0.3 and counts[-1] > 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def cut(texts, length):
    """Texts without the bytes of strings of some length that start more than once."""
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = {q for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1 for q in range(p, p + length)}
        out.append(bytes(c for q, c in enumerate(t) if q not in gone).decode(errors="ignore"))
    return out


def test_stages_as_plain_versions(spark, tmp_path):
    """Near copies, a passage that documents share, columns whose names are used inside, repeated rows, a long text."""
    rng = random.Random(5)
    words = lambda n, k: [f"{k}{rng.randrange(400)}x" for _ in range(n)]
    passage, rows = " ".join(words(60, "p")), []
    for i in range(30):
        own = words(150, "w")
        rows.append((i, " ".join(own)))
        if i % 3 == 0:
            own[70] = "changed"
            rows.append((100 + i, " ".join(own)))
        if i % 5 == 0:
            rows.append((200 + i, " ".join(words(40, "a")) + " " + passage + " " + " ".join(words(40, "b"))))
    rows += [rows[0], (300, None), (301, ""), (302, "short text"), (None, " ".join(words(3000, "l")))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1_ long, spans_ string, row_ int, score_ int, source_ int"
    docs = spark.createDataFrame([(i, t, "en", "ab"[(i or 0) % 2], len(t or ""), 1, "s", 2, 3, 4) for i, t in rows], schema)
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect()))
    scored = {(r.doc_id, r.predicted) for r in quality.classify(docs, labels).collect()}
    out = stages["quality"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, p in scored if p}

    out = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    best = {}
    for k, r in enumerate(root):
        key = (rows[k][0] is None, rows[k][0] or 0)
        best[r] = min(best.get(r, (key, k)), (key, k))
    want = [rows[k] for _, k in best.values()]
    assert pairs(out) == sorted((i is None, i or 0, t is None, t or "") for i, t in want)

    kept = spark.createDataFrame([(i, t, "en", "ab"[(i or 0) % 2], len(t or ""), 1, "s", 2, 3, 4) for i, t in want], schema)
    out = stages["suffix_dedup"](spark, kept, str(tmp_path))
    assert out.columns == docs.columns
    texts = cut([(t or "").encode() for _, t in want], repeats.STAGE_LENGTH)
    assert pairs(out) == sorted((i is None, i or 0, t is None, c) for (i, t), c in zip(want, texts))
    assert not any(passage in c for c in texts) and sum(len(c) for c in texts) < sum(len(t or "") for _, t in want)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())

    out = stages["mixing"](spark, kept, str(tmp_path))
    assert out.columns == docs.columns
    copies = collections.Counter({r.doc_id: r.copies for r in mixing.mix_sizes(kept).collect() if r.copies})
    assert collections.Counter(r.doc_id for r in out.collect()) == copies

    got = stages["packing"](spark, kept, str(tmp_path)).collect()
    tokens = {i: r.doc_tokens for r in got for i in [r.doc_id]}
    assert collections.Counter({i: sum(r.length for r in got if r.doc_id == i) for i in tokens}) == collections.Counter(tokens)
    assert tokens.keys() == {i for i, _ in want}
