import random

import corpus_pipeline

from .helpers import DOCS
from .test_decontamination import brute as hits
from .test_mixing import brute as mix_targets
from .test_mixing import size
from .test_simhash import expected as components


def tables(spark, at):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfg", k=rng.randint(2, 8)))
    docs, labels = [], []
    item = " ".join(word() for _ in range(15))
    for i in range(400):
        w = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            w[3:3] = ["vexqu" + word()[:2], "vexqu" + word()[:2], "vexqur"]
        if i % 17 == 1:
            w[5:5] = item.split()
        if i % 23 == 2:
            w[2:2] = ["password=4c8f8006a3af39d897"]
        docs.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "copy", 0) for i in range(0, 100, 3)] + [(None, None, None, None, None), (None, "", None, None, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nothing of this kind is there")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs, item


def test_stages_do_what_they_say(spark, tmp_path):
    docs, item = tables(spark, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = got.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r)[:5] for r in got.collect()]
        stage(spark, got, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        got = spark.read.parquet(f"{tmp_path}/out/{name}")
        after = got.collect()
        seen[name] = len(after)
        if name != "source_mixing":
            assert got.columns == columns
        if name == "toxicity":
            assert not any("vexqu" in (r["text"] or "") for r in after)
            assert len(after) == sum("vexqu" not in (d[1] or "") for d in before)
        elif name == "simhash_near_duplicates":
            groups = {}
            for (i, f, _), d in zip(components([(d[0], d[1]) for d in before]), before):
                groups.setdefault(f, []).append(d[0])
            assert {r["doc_id"] for r in after if r["doc_id"] is not None} <= {min(x for x in g if x is not None) for g in groups.values() if any(x is not None for x in g)}
            assert not any((r["doc_id"] or 0) >= 1000 for r in after)
        elif name == "benchmark_decontamination":
            want = [d for d in before if not hits(d[1], [(1, item), (2, "nothing of this kind is there")])[4]]
            assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in after)
        elif name == "secret_scan":
            assert len(after) == len(before) and not any("4c8f8006" in (r["text"] or "") for r in after)
        else:
            sizes, target = mix_targets([(d[0], d[1], d[3]) for d in before])
            for s in target:
                words = sum(r["mix_words"] for r in after if r["source"] == s)
                assert abs(words - target[s]) <= max([size(d[1]) for d in before if d[3] == s])
    run = sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert run == sorted(map(repr, after)) and seen["toxicity"] > seen["benchmark_decontamination"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
