import random

import numpy as np
import xxhash

from pagewise.llm import queries, simhash
from pagewise.llm.components import connected_components

from .helpers import PROSE, docs, odd_rows


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    all_ = sorted(fps)
    for i, a in enumerate(all_):
        for b in all_[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(set(fps))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return [(i, f, least.get(comp[f])) for (i, _), f in zip(rows, fps)]


def test_fingerprint_is_the_definition():
    for _, t, *_ in odd_rows():
        if t is None or len(t) < 100_000:
            assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)
    assert simhash.fingerprint(b"") == 0


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) + 100 * g, " ".join(t)))
    rows += [(r[0], r[1]) for r in odd_rows() if r[1] is None or len(r[1]) < 100_000]
    got = simhash.near_duplicates(docs(spark, rows, clash=True)).collect()
    want = expected(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got), key=key) == sorted(want, key=key)


def test_large_buckets_lose_no_link(spark):
    """Balls of close fingerprints fill buckets far beyond the size that pairs up."""
    rng = random.Random(5)
    fps = set()
    for centre in (0, 0x0123456789ABCDEF, (1 << 64) - 1):
        for _ in range(400):
            f = centre
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(12)
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.near_fingerprints(spark.createDataFrame(signed, "fp long"))
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected_components(edges).collect()}
    want = brute_components(fps)
    groups = lambda m: sorted(sorted(x for x in fps if m.get(x, x) == r) for r in {m.get(x, x) for x in fps})
    assert groups(got) == groups(want)
    for r in edges.collect():
        assert (r["a"] ^ r["b"]).bit_count() <= 2 or (((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2)


def test_any_distance_loses_no_link(spark):
    """One group of over 800 fingerprints, through ever finer segments, at distances 1 and 3."""
    rng = random.Random(6)
    fps = {0}
    while len(fps) < 850:
        f = 0
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(20)
        fps.add(f)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for distance, at_once in ((1, 24), (3, 300)):
        edges = simhash.near_fingerprints(df, distance, at_once=at_once).distinct().collect()
        want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance}
        assert {(r["a"], r["b"]) for r in edges} == want


def test_rows_with_maps_and_equal_rows(spark):
    rows = [(1, PROSE, {"a": 1, "b": 2}, -1), (1, PROSE, {"b": 2, "a": 1}, -1), (1, PROSE, {"a": 1}, -1), (2, "quite another text than that", None, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, t int")
    for similarity in (None, 0.8):
        kept = simhash.keep_one(df, similarity=similarity)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_chain_holds_for_every_near_pair(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(300):
        a, diff = int(rng.integers(0, 1 << 62)), 0
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            diff |= 1 << int(b)
        pairs.append((a, diff - (1 << 64) if diff >> 63 else diff))
    df = spark.createDataFrame(pairs, "a long, d long")
    from pyspark.sql import functions as F

    assert df.where(simhash._chain(F.col("d"), simhash._masks(4), 2)).count() == len(pairs)
    far = spark.createDataFrame([(0x0001000100010001,), (7,)], "d long")
    assert far.where(simhash._chain(F.col("d"), simhash._masks(4), 2)).count() == 0


def test_chain_of_nodes_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (700, 700), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(5, PROSE), (3, PROSE), (3, PROSE), (9, PROSE + " indeed it does"), (4, "something else altogether"), (None, "nobody knows this one"), (8, None), (7, "")]
    df = docs(spark, rows, clash=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    want = [(3, PROSE), (9, PROSE + " indeed it does"), (4, "something else altogether"), (None, "nobody knows this one"), (7, "")]
    linked = (brute_fingerprint(PROSE) ^ brute_fingerprint(PROSE + " indeed it does")).bit_count() <= 2
    assert got == sorted([w for w in want if not (linked and w[0] == 9)], key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_is_brute_force_on_the_tables(spark, sf):
    got = queries.op9_simhash_near_duplicates(spark, sf).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{f:016x}", c) for i, f, c in expected(rows))


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(rows, similarity=0.8):
    """Least ids of what fingerprints within 2 bits, or Jaccard similarity, connect."""
    fps, sets = [brute_fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9
            if alike or (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def test_similar_texts_go_at_any_distance(spark):
    """Near copies beyond 2 bits, a group too large to pair up, and a template that many unlike texts share."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n, edits in ((1, 0), (8, 3), (60, 2), (40, 4)):
        base = rng.choices(words, k=150)
        for _ in range(n):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(t)
    base = rng.choices(words, k=120)
    texts += [base + rng.choices(words, k=45) for _ in range(50)]
    texts += [["a", "b"], ["A", "b"], ["a", "c"], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted(r["doc_id"] for r in simhash.keep_one(docs(spark, rows, clash=True), similarity=0.8).collect())
    assert got == brute_kept(rows)
    assert len(got) < len(simhash.keep_one(docs(spark, rows)).collect())


def test_pipeline_stage_drops_near_copies_of_the_table(spark, sf):
    import corpus_pipeline

    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()) == brute_kept(rows)
