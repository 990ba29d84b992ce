import random
import re
from collections import Counter

import numpy as np

from pagewise.llm import divergence, queries
from pagewise.llm.textstats import CLASSES, COMMON_WORDS, base_counts, repeated_words

from .helpers import docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    hit = {i + j for i, x in enumerate(wins) if n[x] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


def prose(rng, n, lang="en"):
    own = COMMON_WORDS[lang].split()
    return " ".join(rng.choice(own) if rng.random() < 0.35 else "".join(rng.choices("etaoinshrdlucm", k=rng.randint(3, 9))) for _ in range(n))


def test_base_counts_are_the_definition(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["\n", " ", "  \n"]).join(rng.choices(["a", "b é", "#*", "c d", "x"], k=rng.randint(0, 40)))) for i in range(80)] + odd_rows()
    got = divergence.digest(docs(spark, rows, clash=True)).collect()
    want = sorted(((i, *brute(t)) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], *r[1:7]) for r in got), key=repr) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert divergence.digest(docs(spark, rows).limit(0)).count() == 0


def test_repeats():
    w = [x.encode() for x in "a b c d e f a b c d e g".split()]
    assert repeated_words(w) == 10
    assert repeated_words(w[:5]) == 0
    assert repeated_words([b"a"] * 9) == 9
    assert base_counts(b"")[2] == (0, 0, 0, 0, 0)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(60, 600))) for i in range(300)]
    rows += [(1000 + i, prose(rng, 200).upper()) for i in range(10)]
    rows += [(2000 + i, " | ".join(prose(rng, 200, "de").split())) for i in range(10)]
    got = {r["doc_id"]: r for r in divergence.digest(docs(spark, rows)).collect()}
    assert sum(got[i]["kept"] for i in range(300)) >= 297
    assert not any(r["kept"] for i, r in got.items() if i >= 1000)


def test_guards(spark):
    """Short texts are not judged; documents of a rare language are, against a reference near themselves."""
    rng = random.Random(3)
    few = [(i, prose(rng, 100)) for i in range(5)] + [(9, "A B C D E F G H I J K L")]
    got = {r["doc_id"]: r for r in divergence.digest(docs(spark, few)).collect()}
    assert all(r["kept"] for r in got.values())
    assert got[9]["word_distance"] is None and got[0]["word_distance"] is not None


CLASS_TESTS = [str.islower, str.isupper, str.isdigit, lambda c: c in " \t\r\x0b\x0c", lambda c: c == "\n", lambda c: c in ".,;:!?'\"()-", lambda c: c in "#*$%&|<>"]


def brute_histograms(t, lang):
    chars = [0] * len(CLASSES)
    for c in t:
        n = ord(c)
        if n < 128:
            i = next((i for i, f in enumerate(CLASS_TESTS) if f(c)), 7)
        else:
            i = 8 if n < 0xC0 else 9 if n < 0x280 else 10 if n < 0x800 else 11 if n < 0x10000 else 12
        chars[i] += 1
    listed = dict.fromkeys(COMMON_WORDS[lang].split()) if lang in COMMON_WORDS else dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws.split())
    words = WORD.findall(t)
    n = Counter(words)
    common = [n[w] for w in listed]
    return chars, [*common, len(words) - sum(common)]


def brute_verdicts(rows):
    """Distances and verdicts by the definition, in plain Python; rows: id, text, language."""
    def js(p, q):
        h = lambda a, b: a * np.log2(2 * a / (a + b)) if a > 0 else 0.0
        return max(0.0, sum(h(a, b) + h(b, a) for a, b in zip(p, q)) / 2)

    share = lambda h: [x / (sum(h) or 1) for x in h]
    seen = []
    for i, t, lang in rows:
        t = t or ""
        lang = lang if lang in COMMON_WORDS else None
        seen.append((i, brute(t), lang, *brute_histograms(t, lang)))
    shaping = [(lang, share(c), share(w)) for _, b, lang, c, w in seen if b[0] >= 40 and not b[5]]
    total = len(shaping)
    refs = {}
    for lang in {x[0] for x in shaping}:
        own = [x for x in shaping if x[0] == lang]
        pool_chars = [sum(x[1][k] for x in shaping) / total for k in range(len(CLASSES))]
        listed = sum(sum(x[2][:-1]) for x in shaping) / total
        size = len(own[0][2])
        prior = [listed / (size - 1)] * (size - 1) + [sum(x[2][-1] for x in shaping) / total]
        k = divergence.POOLED
        refs[lang] = [[(sum(x[f][j] for x in own) + k * pool[j]) / (len(own) + k) for j in range(len(pool))] for f, pool in ((1, pool_chars), (2, prior))]
    out = {}
    for i, b, lang, c, w in seen:
        d = [None, None]
        if b[0] >= 40 and lang in refs:
            for f, h in enumerate((c, w)):
                q = refs[lang][f]
                noise = sum(min(x / 2, 1 / (8 * np.log(2) * max(1, sum(h)))) for x in q)
                d[f] = np.sqrt(max(0.0, js(share(h), q) - divergence.NOISE * noise))
        strange = d[0] is not None and (d[0] > divergence.CHAR_LIMIT or d[1] > divergence.WORD_LIMIT or sum(d) > divergence.SUM_LIMIT)
        out[i] = (b[5], not b[5] and not strange, *d)
    return out


def test_verdicts_are_the_definition(spark, sf):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, prose(rng, 120, "de"), rng.choice(["xx", None])) for i in range(3)] + [(10_010, "é × ß ж 中 😀 " * 30 + prose(rng, 50), "fr"), (10_011, None, "fr"), (10_012, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in divergence.digest(df).collect()}
    near = lambda a, b: a is None and b is None or abs(a - b) < 1e-6
    for i, (failed, kept, c, w) in brute_verdicts(rows).items():
        r = got[i]
        assert (r["base_failed"], r["kept"]) == (failed, kept) and near(r["char_distance"], c) and near(r["word_distance"], w), (i, r, c, w)


def test_distances_are_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    got = df.select(divergence._distance(F.col("p"), F.col("q"))).first()[0]
    assert abs(got - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_query_on_the_tables(spark, sf):
    got = queries.op1_distribution_divergence(spark, sf).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r["doc_id"], *r[1:7]) for r in got) == sorted((i, *brute(t)) for i, t in rows)
