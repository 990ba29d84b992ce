import hashlib
import random
import re

from pagewise.llm import decontamination as d
from pagewise.llm import queries

from .helpers import docs, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for name, t in items:
        iw = words(t)
        for win in {tuple(iw[i : i + 10]) for i in range(max(1, len(iw) - 9))} if iw else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, rows, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:6] for r in d.digest(docs(spark, rows, clash=True), bench).collect() if r["doc_id"] is not None)
    usable = [x for x in items if x[0] is not None]
    assert got == sorted((r[0], *brute(r[1], usable)) for r in rows if r[0] is not None)


def test_windows_overlaps_and_short_items(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "Éa", "c9", "z"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 14)))) for i in range(12)] + [(50, None), (51, "..."), (52, ""), (None, "a b c"), (10, "A,b;  C9")]
    rows = [(i, rng.choice(["", "x "]) + "-".join(rng.choices([*vocab, "x"], k=rng.randint(0, 60)))) for i in range(60)]
    check(spark, rows, items)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 100_000]
    check(spark, rows, [(7, "the quick brown fox jumps over the lazy dog and runs far"), (8, "x"), (100, "b c")])
    check(spark, rows, [])
    assert d.digest(docs(spark, rows).limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_blocks_find_what_one_automaton_finds(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices("abcdef", k=12))) for i in range(30)]
    rows = [(i, " ".join(rng.choices("abcdef", k=20) + items[i % 30][1].split()[: rng.randint(5, 12)])) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows)
    one = d.contamination(df, bench).select("doc_id", "hits").collect()
    old, d.benchmark_blocks = d.benchmark_blocks, lambda b, s, m, f=d.benchmark_blocks: f(b, s, 200)
    try:
        many = d.contamination(df, bench).select("doc_id", "hits").collect()
    finally:
        d.benchmark_blocks = old
    assert sorted(one, key=repr) == sorted(many, key=repr)


def test_spans_are_of_the_original(spark):
    text = "Ünder — ONE,two\tthree four five six seven eight nine ten! rest"
    s = d.Scanner({"one two three four five six seven eight nine ten": ["1"]})
    _, runs, items = s.scan(text.encode())
    assert items == ["1"]
    ((a, b),) = d.source_spans(text.encode(), runs)
    assert text[a:b] == "ONE,two\tthree four five six seven eight nine ten"


def test_query_is_brute_force_on_the_tables(spark, sf):
    got = sorted(tuple(r) for r in queries.op5_benchmark_decontamination(spark, sf).collect())
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    index = {}
    for name, t in items:
        iw = words(t)
        for i in range(max(1, len(iw) - 9)) if iw else ():
            index.setdefault(tuple(iw[i : i + 10]), set()).add(str(name))
    sizes = {len(k) for k in index}
    want = []
    for r in rows:
        w, hit, found = words(r["text"]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := index.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        want.append((r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    assert any(x[5] for x in got)
