import hashlib

from pagewise.llm import mixing

from .helpers import docs, odd_rows


def size(t):
    t = t or ""
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return sum(1 for w in t.split(" ") if w)


def brute(rows):
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= set(over)
    return sizes, target


def run(spark, rows, clash=False):
    full = [(*r, "a")[:3] if len(r) < 3 else r for r in rows]
    got = mixing.digest(docs(spark, full, clash)).collect()
    sizes, target = brute(full)
    src = {}
    for i, _, s in full:
        src.setdefault(i, set()).add(s)
    taken = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        assert r["taken"] % max(1, r["size"]) == 0
        s = min((s for s in src[r["doc_id"]] if sizes[s] == r["source_size"]), key=repr)
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _ in full)
    return sizes, target, taken, got


def test_targets_and_nearness(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i * i % 11}") for i in range(2000)]
    sizes, target, taken, _ = run(spark, rows, clash=True)
    for s in sizes:
        assert abs(taken.get(s, 0) - target[s]) <= 50


def test_reruns_agree_and_hot_source(spark):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i}") for i in range(900)]
    a, b = (sorted(tuple(r) for r in mixing.digest(docs(spark, rows)).collect()) for _ in range(2))
    assert a == b
    sizes, target, taken, _ = run(spark, rows)
    assert abs(taken["hot"] - target["hot"]) <= 9


def test_odd_rows(spark):
    run(spark, odd_rows(), clash=True)
    run(spark, [(1, None, None), (2, "", "b"), (3, " ", "c")])
    assert mixing.digest(docs(spark, odd_rows()).limit(0)).count() == 0


def test_equal_hashes_stand_together(spark):
    rows = [(7, "a b c", "s")] * 6 + [(8, "a b", "t")]
    _, _, _, got = run(spark, rows)
    assert len({r["taken"] for r in got if r["doc_id"] == 7}) == 1


def test_hash_is_md5(spark):
    from pyspark.sql import functions as F

    got = spark.range(5).select(mixing.hash_of(F.col("id"), F.lit("é t")).alias("h")).collect()
    assert [r["h"] for r in got] == [int(hashlib.md5(f"{i}\né t".encode()).hexdigest()[:15], 16) for i in range(5)]


def test_rows_without_ids_come_near_their_target(spark):
    rows = [(None, f"w{i} x y", "s") for i in range(500)] + [(3, f"v{i} x", "t") for i in range(300)] + [(i, "a b c d", "u") for i in range(400)]
    sizes, target = brute(rows)
    got = mixing.mix(docs(spark, rows)).groupBy("source").sum("__pw_taken").collect()
    for s, taken in got:
        assert abs(taken - target[s]) <= 4


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i}" if i % 5 else None) for i in range(3000)]
    run(spark, rows)


def test_a_mix_can_be_mixed_again(spark):
    df = docs(spark, [(i, "a b c", f"s{i % 3}") for i in range(60)], clash=True)
    once = mixing.taken(df)
    again = mixing.taken(once)
    assert again.columns == once.columns and again.count() <= once.count()


def test_no_python_in_the_plan(spark):
    df = mixing.digest(docs(spark, [(1, "a b", "s"), (2, "c", "t")]))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
