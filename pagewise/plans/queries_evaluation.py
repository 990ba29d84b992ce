"""Queries of prompts, scores and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics, text
from ..functions.vectors import tidy
from ..operators import paging
from ..session import shared_dir
from ..sources import files
from . import evaluation
from .registry import query, table

MOST_WORDS = 64
TEMPLATES = {
    "en": "Read the text.\n\n{context}\n\nQuestion: {input}\nAnswer:",
    "de": "Lies den Text.\n\n{context}\n\nFrage: {input}\nAntwort:",
    "fr": "Lis le texte.\n\n{context}\n\nQuestion: {input}\nRéponse:",
    "es": "Lee el texto.\n\n{context}\n\nPregunta: {input}\nRespuesta:",
}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a prediction, the next turn of the conversation as its answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("pred"), F.lead("text").over(w).alias("answer"))
    return c.where("answer IS NOT NULL")


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CASE WHEN len(w) > 64 THEN array_to_string(list_concat(w[1:32], w[-32:]), ' ') ELSE array_to_string(w, ' ') END AS text FROM w""")
def truncate_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    cut = text.truncate_middle(words, MOST_WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.array_join(cut, " ").alias("text"))


def _case(templates: dict[str, str], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in templates.items()) + " END"


@query(f"""WITH t AS (SELECT doc_id, replace(string_split({_case(TEMPLATES, "lang")}, '{{context}}')[1], '{{input}}', coalesce(source, '')) || coalesce(text, '')
    || replace(string_split({_case(TEMPLATES, "lang")}, '{{context}}')[2], '{{input}}', coalesce(source, '')) AS f FROM documents),
    w AS (SELECT doc_id, f, string_split(f, ' ') AS w FROM t)
SELECT doc_id, '[INST]' || CASE WHEN len(w) > 128 THEN array_to_string(list_concat(w[1:64], w[-64:]), ' ') ELSE f END || '[/INST]' AS prompt FROM w""")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(list(TEMPLATES.items()), "dataset string, template string")
    d = table(spark, sf_dir, "documents")
    examples = d.select("doc_id", F.col("lang").alias("dataset"), F.col("text").alias("context"), F.col("source").alias("input"))
    return evaluation.prompts(examples, templates, 128, "mistral").select("doc_id", "prompt")


@query(f"""SELECT doc_id, string_split({_case(TEMPLATES, "lang")}, '{{context}}')[1] || '{{context}}' AS first, string_split({_case(TEMPLATES, "lang")}, '{{context}}')[2] AS second FROM documents""")
def two_stage_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates cut behind the context, so that the question can follow later."""
    pairs = [F.lit(x) for kv in TEMPLATES.items() for x in kv]
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(*pairs)[F.col("lang")].alias("t"))
    first, second = text.split_template(F.col("t"))
    return d.select("doc_id", first.alias("first"), second.alias("second"))


@query("""SELECT doc_id, 'internlm' AS family, string_split('<|User|>:' || text || chr(60) || 'eoh>' || chr(10) || '<|Bot|>:', '<eoa>')[1] AS response FROM documents
UNION ALL SELECT doc_id, 'xgen', replace('Assistant:' || text, 'Assistant:', '') FROM documents""")
def clean_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    a = d.select("doc_id", F.lit("internlm").alias("family"), text.clean_response(text.chat_prompt(F.col("text"), "internlm"), "internlm").alias("response"))
    b = d.select("doc_id", F.lit("xgen").alias("family"), text.clean_response(F.concat(F.lit("Assistant:"), "text"), "xgen").alias("response"))
    return a.unionByName(b)


FILL = f"repeat('{files.FILLER} ', CAST(n AS INTEGER) // {len(files.FILLER) + 1} + 2)"


@query(f"""WITH c AS (SELECT n, i, round(i / 19.0::DOUBLE, 6) AS loc FROM (VALUES (380), (760), (1140)) a(n), range(0, 20) r(i)),
    k AS (SELECT *, CAST(('0x' || substr(md5('0/' || n || '/' || i), 1, 8)) AS BIGINT) % 49999 + 1 AS passkey, CAST(floor(n * loc) AS INTEGER) AS h FROM c)
SELECT CAST(n AS BIGINT) AS n_garbage, loc, passkey, CAST(length(p) AS BIGINT) AS prompt_len, md5(p) AS prompt_md5 FROM (SELECT *, '{files.TASK}' || chr(10) || substr({FILL}, 1, h) || chr(10)
    || 'The pass key is ' || passkey || '. Remember it. ' || passkey || ' is the pass key.' || chr(10) || substr({FILL}, 1, n - h) || '{files.QUESTION}' AS p FROM k)""")
def passkey_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = files.passkeys(spark, [380, 760, 1140])
    return p.select("n_garbage", "loc", "passkey", F.length("prompt").cast("long").alias("prompt_len"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


PUNCT = text.ASCII_PUNCTUATION.replace("'", "''")
WIDE = (text.ASCII_PUNCTUATION + text.WIDE_PUNCTUATION).replace("'", "''")


def _normal(c: str) -> str:
    return f"[x FOR x IN regexp_split_to_array(translate(lower({c}), '{PUNCT}', ''), '\\s+') IF x NOT IN ('', 'a', 'an', 'the')]"


@query(f"SELECT conv_id, turn, array_to_string({_normal('text')}, ' ') AS text FROM conversations")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, regexp_replace(translate(lower(text), '{WIDE}', ''), '\\s+', '', 'g') AS text FROM conversations")
def normalize_zh_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_zh_answer(F.col("text")).alias("text"))


LEAD = "l AS (SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)"


@query(f"""WITH {LEAD}, t AS (SELECT conv_id, turn, {_normal("p")} AS a, {_normal("g")} AS b FROM l WHERE g IS NOT NULL),
    ca AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM t) GROUP BY ALL),
    cb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS w FROM t) GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS same FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(2.0 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)), 0.0), 6) + 0.0 AS f1 FROM t LEFT JOIN s USING (conv_id, turn)""")
def qa_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f1 = metrics.metric("qa_f1_score", F.col("pred"), F.col("answer"))
    return turns(spark, sf_dir).select("conv_id", "turn", tidy(f1).alias("f1"))


@query(f"""WITH {LEAD}, t AS (SELECT conv_id, turn, {_normal("p")} AS a, {_normal("g")} AS b FROM l WHERE g IS NOT NULL),
    ca AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM t) GROUP BY ALL),
    cb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS w FROM t) GROUP BY ALL)
SELECT conv_id, turn, CAST(sum(least(ca.n, cb.n)) AS BIGINT) AS n_same FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the intersection of two bags of words, by joins alone."""
    t = turns(spark, sf_dir)
    bag = lambda c: t.select("conv_id", "turn", F.explode(text.tokens(text.normalize_answer(F.col(c)))).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias(c))
    both = bag("pred").join(bag("answer"), ["conv_id", "turn", "w"])
    return both.groupBy("conv_id", "turn").agg(F.sum(F.least("pred", "answer")).alias("n_same"))


NUMBERS = "regexp_extract_all(text, '\\d+')"


@query(f"SELECT doc_id, round(CASE WHEN len({NUMBERS}) = 0 THEN 0.0 ELSE len([x FOR x IN {NUMBERS} IF x = CAST(doc_id % 10 AS VARCHAR)]) / len({NUMBERS}) END, 6) + 0.0 AS score FROM documents")
def count_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tidy(text.count_score(F.col("text"), F.col("doc_id") % 10)).alias("score"))


@query(f"""SELECT doc_id, label, round(CASE WHEN len({NUMBERS}) = 0 THEN 0.0 ELSE len([x FOR x IN {NUMBERS} IF x = CAST(doc_id % 10 AS VARCHAR)]) / len({NUMBERS}) END, 6) + 0.0 AS score
FROM documents, (VALUES ('en'), ('zh')) l(label)""")
def retrieval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    en = text.retrieval_score(F.col("text"), F.concat(F.lit("See Paragraph "), F.col("doc_id") % 10, F.lit(" of Paragraph 99")))
    zh = text.retrieval_zh_score(F.col("text"), F.concat(F.lit("段落"), F.col("doc_id") % 10))
    part = lambda name, c: d.select("doc_id", F.lit(name).alias("label"), tidy(c).alias("score"))
    return part("en", en).unionByName(part("zh", zh))


@query("""WITH n AS (SELECT doc_id, n_chars, regexp_extract_all(replace(text, ',', ''), '\\d*\\.?\\d+') AS x FROM documents)
SELECT doc_id, CAST(x[-1] AS DOUBLE) AS pred, coalesce(CAST(x[-1] AS DOUBLE) = n_chars, false) AS ok FROM n""")
def last_number_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.last_number(F.col("text")).alias("pred"), text.last_number_match(F.col("text"), F.col("n_chars").cast("string")).alias("ok"))


@query("SELECT doc_id, string_split(ltrim(text, chr(10)), chr(10))[1] AS line FROM documents")
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("line"))


@query("SELECT doc_id, coalesce([x FOR x IN string_split(ltrim(text, chr(10)), chr(10)) IF NOT regexp_matches(x, '[`#]|//')][1], '') AS line FROM documents")
def code_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.code_line(F.col("text")).alias("line"))


@query("""WITH RECURSIVE c AS (SELECT doc_id, lang, [x FOR x IN ['en', 'de', 'der', 'fr', 'es', 'le', 'les'] IF contains(coalesce(text, ''), x)] AS f FROM documents),
    st AS (SELECT doc_id, lang, f, 1 AS i FROM c UNION ALL
        SELECT doc_id, lang, CASE WHEN contains(lang, f[i]) AND f[i] <> lang THEN list_concat(f[1:i - 1], f[i + 1:]) ELSE f END, i + 1 FROM st WHERE i <= len(f)),
    z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS b FROM st)
SELECT doc_id, round(CASE WHEN list_contains(f, lang) THEN 1.0 / len(f) ELSE 0.0 END, 6) + 0.0 AS score FROM z WHERE b = 1""")
def classification_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.array(*(F.lit(x) for x in ("en", "de", "der", "fr", "es", "le", "les")))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tidy(metrics.metric("classification_score", F.col("text"), F.col("lang"), classes)).alias("score"))


def _turn_metric(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", tidy(metrics.metric(name, F.col("pred"), F.col("answer"))).alias("score"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_metric(spark, sf_dir, "rouge_score")


@query()
def rouge_l_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_metric(spark, sf_dir, "rouge_zh_score")


def _zh(c: str) -> str:
    return f"[y FOR y IN [regexp_replace(translate(lower(x), '{WIDE}', ''), '\\s+', '', 'g') FOR x IN regexp_extract_all({c}, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')] IF y <> '']"


@query(f"""WITH {LEAD}, t AS (SELECT conv_id, turn, {_zh("p")} AS a, {_zh("g")} AS b FROM l WHERE g IS NOT NULL),
    ca AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM t) GROUP BY ALL),
    cb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS w FROM t) GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS same FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(2.0 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)), 0.0), 6) + 0.0 AS score FROM t LEFT JOIN s USING (conv_id, turn)""")
def qa_f1_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_metric(spark, sf_dir, "qa_f1_zh_score")


@query()
def code_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_metric(spark, sf_dir, "code_sim_score")


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a score: whether quality and toxicity labels differ."""
    l = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") != F.col("toxic")).cast("double").alias("score"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("length")).join(l, "doc_id")


AGREE = "a AS (SELECT doc_id, source, n_chars, CAST(quality <> toxic AS INTEGER)::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {AGREE} SELECT source, round(100 * avg(score), 2) AS score FROM a GROUP BY source")
def dataset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.dataset_scores(_agreement(spark, sf_dir), "source")


@query(f"""WITH {AGREE}, b AS (SELECT CASE WHEN n_chars < 4000 THEN '0-4k' WHEN n_chars < 8000 THEN '4-8k' ELSE '8k+' END AS bucket, round(100 * avg(score), 2) AS score FROM a GROUP BY 1)
SELECT n.bucket, coalesce(score, 'nan'::DOUBLE) AS score FROM (VALUES ('0-4k'), ('4-8k'), ('8k+')) n(bucket) LEFT JOIN b USING (bucket)""")
def length_bucket_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bucket_scores(_agreement(spark, sf_dir), spark)


@query("SELECT doc_id, round(avg(CASE WHEN quality <> toxic THEN 1.0 ELSE 0.0 END) OVER (ORDER BY doc_id), 6) + 0.0 AS acc FROM labels")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") != F.col("toxic")).cast("long").alias("ok"), F.lit(1).cast("long").alias("one"))
    s = paging.prefix_sum(paging.prefix_sum(l, "doc_id", "ok", "good"), "doc_id", "one", "n")
    return s.select("doc_id", tidy((F.col("good") + F.col("ok")) / (F.col("n") + 1)).alias("acc"))


@query("""WITH d AS (SELECT user_id, row_number() OVER w AS i, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(sum(d) FILTER (i <= 3), 4) AS prefill_s, round(avg(d) FILTER (i > 3), 4) AS decode_s FROM d WHERE d IS NOT NULL GROUP BY user_id""")
def step_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    got = evaluation.latency(e, "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return got.select("user_id", F.round("prefill_s", 4).alias("prefill_s"), F.round("decode_s", 4).alias("decode_s"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, '{"k":' || (props ->> 'k') || '}' AS props FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.to_json(p).alias("props"))


@query("""WITH w AS (SELECT doc_id, lang, string_split(lower(text), ' ') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS kinds, w[1] AS first, w[-1] AS last, list_contains(w, 'the') AS has_the FROM w""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split(F.lower("text"), " ")
    d = table(spark, sf_dir, "documents")
    ends = (F.element_at(w, 1).alias("first"), F.element_at(w, -1).alias("last"))
    return d.select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds"), *ends, F.array_contains(w, "the").alias("has_the"))


BEST = f"""{LEAD}, t AS (SELECT conv_id, turn, ['hotpotqa', 'passage_count', 'passage_retrieval_en', 'unknown'][conv_id % 4 + 1] AS dataset, p, unnest([g, 'Paragraph ' || turn]) AS ans, unnest([1, 2]) AS j
        FROM l WHERE g IS NOT NULL),
    w AS (SELECT *, {_normal("p")} AS a, {_normal("ans")} AS b, regexp_extract_all(p, '\\d+') AS nums FROM t),
    ca AS (SELECT conv_id, turn, j, x, count(*) AS n FROM (SELECT conv_id, turn, j, unnest(a) AS x FROM w) GROUP BY ALL),
    cb AS (SELECT conv_id, turn, j, x, count(*) AS n FROM (SELECT conv_id, turn, j, unnest(b) AS x FROM w) GROUP BY ALL),
    s AS (SELECT conv_id, turn, j, sum(least(ca.n, cb.n)) AS same FROM ca JOIN cb USING (conv_id, turn, j, x) GROUP BY ALL),
    r AS (SELECT conv_id, turn, dataset, CASE dataset WHEN 'hotpotqa' THEN coalesce(2.0 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)), 0.0)
        WHEN 'passage_count' THEN CASE WHEN len(nums) = 0 THEN 0.0 ELSE len([x FOR x IN nums IF x = ans]) / len(nums) END
        WHEN 'passage_retrieval_en' THEN CASE WHEN len(nums) = 0 THEN 0.0 ELSE len([x FOR x IN nums IF x = regexp_extract(ans, 'Paragraph (\\d+)', 1)]) / len(nums) END END AS score
        FROM w LEFT JOIN s USING (conv_id, turn, j)),
    best AS (SELECT conv_id, turn, dataset, max(score) AS score FROM r GROUP BY ALL)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as predictions of four datasets, one of them without a metric, with two answers each."""
    names = F.array(*(F.lit(x) for x in ("hotpotqa", "passage_count", "passage_retrieval_en", "unknown")))
    answers = F.array("answer", F.concat(F.lit("Paragraph "), F.col("turn")))
    t = turns(spark, sf_dir).withColumn("dataset", F.get(names, (F.col("conv_id") % 4).cast("int")))
    return t.select("conv_id", "turn", "dataset", "pred", answers.alias("answers"), F.lit(None).cast("array<string>").alias("all_classes"))


@query(f"WITH {BEST} SELECT conv_id, turn, dataset, round(score, 6) + 0.0 AS score FROM best")
def row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prediction by its dataset's metric, the best over its answers."""
    return evaluation.row_scores(_predictions(spark, sf_dir)).select("conv_id", "turn", "dataset", tidy(F.col("score")).alias("score"))


@query(f"WITH {BEST} SELECT dataset, round(100 * avg(score), 2) AS score FROM best GROUP BY dataset")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From predictions to the report's rows."""
    return evaluation.dataset_scores(evaluation.row_scores(_predictions(spark, sf_dir)))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as JSON lines in two goes, and read again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    at = _folder(spark, "jsonl")
    for part in (d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")):
        files.append_predictions(part, at)
    return files.jsonl(spark, at, d.schema)


@query("SELECT lang AS dataset, n_chars AS length, text AS pred, source AS answer FROM documents")
def predictions_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's folder of one file per dataset, read with the names of its files."""
    d = table(spark, sf_dir, "documents")
    at = _folder(spark, "run")
    for lang in TEMPLATES:
        rows = d.where(F.col("lang") == lang).select(F.col("n_chars").alias("length"), F.lit(1).alias("token_length"), F.col("text").alias("pred"), F.array("source").alias("answers"))
        files.append_predictions(rows, f"{at}/{lang}.jsonl")
    got = files.predictions(spark, at)
    return got.select("dataset", F.col("length").cast("long").alias("length"), "pred", F.col("answers")[0].alias("answer"))


@query(f"WITH {AGREE} SELECT source AS key, round(100 * avg(score), 2) AS value FROM a WHERE source IS NOT NULL GROUP BY source")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as one JSON object, and read as settings of numbers."""
    at = _folder(spark, "report")
    files.write_report(dataset_score(spark, sf_dir).where("source IS NOT NULL"), at, "source")
    return files.settings(spark, at, T.DoubleType())


@query("""SELECT item_id, 'Q: ' || item_id || chr(10) AS question, 'A_model:' || chr(10) || regexp_replace(text, '\\s+', ' ', 'g') || chr(10) AS model_answer, 'A:' || chr(10) || length(text) || chr(10) || chr(10) AS answer FROM benchmark""")
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as a transcript, read as whole texts and cut into blocks."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question"), F.regexp_replace("text", r"\s+", " ").alias("generation"), F.length("text").cast("string").alias("answer"))
    at = _folder(spark, "transcript")
    files.write_transcript(b, at)
    got = files.blocks(files.text(spark, at).where("text <> ''"))
    return got.select(F.regexp_extract("question", r"(\d+)", 1).cast("long").alias("item_id"), "question", "model_answer", "answer")


@query("""SELECT CAST(doc_id AS VARCHAR) AS _id, text AS context, source AS input, CAST(n_chars AS INTEGER) AS length, lang AS dataset, true AS balanced FROM documents WHERE n_chars < 8000
UNION ALL SELECT CAST(doc_id AS VARCHAR), text, source, CAST(n_chars AS INTEGER), lang, false FROM documents""")
def dataset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written in the benchmark's schema, and scanned whole and in the balanced variant."""
    d = table(spark, sf_dir, "documents")
    at = _folder(spark, "dataset")
    rows = d.select(F.col("source").alias("input"), F.col("text").alias("context"), F.array("lang").alias("answers"), F.col("n_chars").cast("int").alias("length"), F.col("lang").alias("dataset"), F.lit("x").alias("language"), F.lit(None).cast("array<string>").alias("all_classes"), F.col("doc_id").cast("string").alias("_id"))
    rows.write.parquet(at)
    rows.where("length < 8000").write.parquet(at + "_e")
    part = lambda e: files.dataset(spark, at, e).select("_id", "context", "input", "length", "dataset", F.lit(e).alias("balanced"))
    return part(True).unionByName(part(False))
