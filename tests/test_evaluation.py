"""Metrics against plain definitions, prompts, readers and writers."""

import difflib
import json
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from pagewise.functions import metrics, text
from pagewise.plans import evaluation
from pagewise.sources import files


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_classes_are_passed_over_as_they_are_removed():
    assert metrics.classification("number", "number", ["num", "numb", "number"]) == 0.5
    assert metrics.classification("num", "number", ["num", "number"]) == 0.0
    assert metrics.classification("x", "y", []) == 0.0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 90)) for _ in range(2))
        assert metrics.lcs_length(a, b) == plain_lcs(a, b)
    assert metrics.rouge_l("", "a") == 0.0 and abs(metrics.rouge_l("a b c", "a x c") - 2 / 3) < 1e-6


def test_scores_by_hand():
    assert metrics.qa_f1("The cat, sat!", "a cat sat down") == 2 * (2 / 2) * (2 / 3) / (2 / 2 + 2 / 3)
    assert metrics.qa_f1("the", "an") == 0.0
    assert metrics.retrieval("It is 3 or 7", "Paragraph 7") == 0.5 and metrics.retrieval_zh("7", "段落7") == 1.0
    assert metrics.count("5 5 6", "5") == 2 / 3 and metrics.count("none", "5") == 0.0
    assert metrics.code_similarity("# c\n`x`\nint a;\n", "int b;") == round(100 * difflib.SequenceMatcher(None, "int a;", "int b;").ratio()) / 100
    assert metrics.qa_f1_zh("你好，世界", "世界") == 2 * 0.5 * 1 / 1.5


def test_columns_follow_the_plain_forms(spark):
    rng = random.Random(2)
    samples = ["", "The  a\tan THE", "An ant's theory; a b-c", "naïve the—an", "x\u00a0the y"] + ["".join(rng.choices(string.printable[:95] + " \n é，。", k=40)) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = df.select("i", text.normalize_answer(F.col("s")).alias("a"), text.normalize_zh_answer(F.col("s")).alias("z")).collect()
    for r in got:
        s = samples[r["i"]]
        assert r["a"] == " ".join(metrics._normal(s)), s
        assert r["z"] == "".join(s.lower().translate(metrics.DROP_WIDE).split()), s


def test_numbers(spark):
    n = lambda s: one(spark, text.last_number(F.lit(s)))
    assert n("so 1,234 then 5.50") == 5.5 and n("-5.5") == 5.5 and n("none") is None and n(".5 a") == 0.5
    assert one(spark, text.last_number_match(F.lit("so 1,234 then 5.50"), F.lit("#### 5.5"))) is True
    assert one(spark, text.last_number_match(F.lit("none"), F.lit("5"))) is False


def test_lines_and_templates(spark):
    assert one(spark, text.first_line(F.lit("\n\na\nb"))) == "a"
    assert one(spark, text.code_line(F.lit("\n# no\n// no\nyes\n"))) == "yes" and one(spark, text.code_line(F.lit("`"))) == ""
    assert one(spark, text.fill_template(F.lit("A {context} B {input}"), F.lit("x {input} y"), F.lit("q"))) == "A x {input} y B q"
    assert one(spark, text.fill_template(F.lit("only {input}"), F.lit("x"), F.lit("q"))) == "only q"
    a, b = text.split_template(F.lit("A {context} B {input}"))
    assert (one(spark, a), one(spark, b)) == ("A {context}", " B {input}")
    words = F.array(*(F.lit(str(i)) for i in range(9)))
    assert one(spark, text.truncate_middle(words, 5)) == ["0", "1", "7", "8"] and len(one(spark, text.truncate_middle(words, 9))) == 9
    assert one(spark, text.chat_prompt(F.lit("p"), "mistral")) == "[INST]p[/INST]" and one(spark, text.chat_prompt(F.lit("p"), "other")) == "p"
    assert one(spark, text.clean_response(F.lit("a<eoa>b"), "internlm")) == "a" and one(spark, text.clean_response(F.lit(" Assistant: hi "), "xgen")) == " hi"


PRED = "dataset string, pred string, answers array<string>, all_classes array<string>, length int"


def test_scores_by_task_and_length(spark):
    rows = [("trec", "\nnumber\nother", ["number", "x"], ["num", "numb", "number"], 10), ("hotpotqa", "the cat", ["a cat", "dog"], None, 5000), ("hotpotqa", "no", [], None, 3999), ("gov_report", "a b", ["a b"], None, 4000)]
    scored = evaluation.row_scores(spark.createDataFrame(rows, PRED))
    got = {(r["dataset"], r["length"]): r["score"] for r in scored.collect()}
    assert got["trec", 10] == 0.5 and got["hotpotqa", 5000] == 1.0 and got["hotpotqa", 3999] == 0.0 and got["gov_report", 4000] > 0.99
    assert {r["dataset"]: r["score"] for r in evaluation.dataset_scores(scored).collect()}["hotpotqa"] == 50.0
    b = {r["bucket"]: r["score"] for r in evaluation.bucket_scores(scored, spark).collect()}
    assert b["4-8k"] == 100.0 and b["8k+"] != b["8k+"] and b["0-4k"] == 25.0
    by = evaluation.bucket_scores(scored, spark, ["dataset"])
    assert by.count() == 9
    odd = spark.createDataFrame([("no such task", "x", ["x"], None, 1), (None, "x", ["x"], None, 1), ("hotpotqa", None, None, None, 1)], PRED)
    assert [r["score"] for r in evaluation.row_scores(odd).collect()] == [None, None, 0.0]


def test_prompts_are_cut_and_wrapped(spark):
    ex = spark.createDataFrame([("trec", "c " * 50, "q"), ("qasper", "c " * 50, "q")], "dataset string, context string, input string")
    t = spark.createDataFrame([("trec", "{context}{input}"), ("qasper", "{context}{input}")], "dataset string, template string")
    got = {r["dataset"]: r["prompt"] for r in evaluation.prompts(ex, t, 10, "mistral").collect()}
    assert got["trec"].split(" ") == ["c"] * 9 + ["q"] and got["qasper"] == f"[INST]{got['trec']}[/INST]"


def test_metrics_in_sql(spark):
    metrics.register(spark)
    assert spark.sql("SELECT qa_f1_score('a cat', 'cat', NULL) AS x").first()["x"] == 1.0
    assert set(m for m, _, _ in metrics.TASKS.values()) == set(metrics.METRICS)


def test_files_round_trip(spark, tmp_path):
    rows = [("hotpotqa", "p1", ["a"], None, 5)]
    df = spark.createDataFrame(rows, PRED).select("length", F.lit(7).alias("token_length"), "pred", "answers", "all_classes")
    for _ in range(2):
        files.append_predictions(df, f"{tmp_path}/run/hotpotqa.jsonl")
    (tmp_path / "run" / "trec.jsonl").write_text('{"pred": "x", "answers": ["y"], "all_classes": ["y"], "length": 3}\n')
    (tmp_path / "run" / "note.txt").write_text("not a prediction")
    got = files.predictions(spark, str(tmp_path / "run"))
    assert sorted((r["dataset"], r["pred"]) for r in got.collect()) == [("hotpotqa", "p1"), ("hotpotqa", "p1"), ("trec", "x")]
    files.write_report(spark.createDataFrame([("b", 2.0), ("a", 1.5)], "dataset string, score double"), f"{tmp_path}/report")
    body = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert json.loads(body) == {"a": 1.5, "b": 2.0}
    (tmp_path / "settings.json").write_text('{\n "a": 64,\n "b": 128}')
    assert {r["key"]: r["value"] for r in files.settings(spark, f"{tmp_path}/settings.json").collect()} == {"a": "64", "b": "128"}
    files.write_transcript(spark.createDataFrame([("q", "g", "a")], "question string, generation string, answer string"), f"{tmp_path}/t")
    assert files.empty_pool(spark).count() == 0
    assert evaluation.same_for_all(got, "dataset") in (True, False)


def test_report_blocks(spark, tmp_path):
    report = "Q: one\nmore\nA_model:\nthe 5\nQuestion: skipped\nalso\nA:\n5\nQ: two\nA_model: 6\nA: 7\ntail\n"
    (tmp_path / "r.txt").write_text(report)
    got = files.blocks(files.text(spark, str(tmp_path / "r.txt"))).orderBy("block").collect()
    assert [(r["question"], r["model_answer"], r["answer"]) for r in got] == [("Q: one\nmore\n", "A_model:\nthe 5\n", "A:\n5\n"), ("Q: two\n", "A_model: 6\n", "A: 7\ntail\n")]
    with pytest.raises(ValueError):
        files.split_blocks("no head\n")
    assert files.split_blocks("") == []


def test_passkeys_stand_where_they_should(spark):
    for r in files.passkeys(spark, [100, 1000], depths=5).collect():
        lines = r["prompt"].split("\n")
        assert lines[0] == files.TASK and len(lines) == 4 and 1 <= r["passkey"] <= files.KEYS
        assert len(lines[1]) == int(r["n_garbage"] * r["loc"]) and lines[3].endswith(files.QUESTION)
        assert len(lines[1]) + len(lines[3]) - len(files.QUESTION) == r["n_garbage"]
        assert re.search(rf"The pass key is {r['passkey']}\. Remember it\. {r['passkey']} is the pass key\.", lines[2])


def test_resume(spark):
    ex, done = (spark.createDataFrame([(x,) for x in xs], "_id string") for xs in ("abc", "b"))
    assert sorted(r[0] for r in evaluation.remaining(ex, done).collect()) == ["a", "c"]
