"""Answer normalisation, number matching, templates and truncation, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_PUNCTUATION = string.punctuation
# Fixed value: the wide punctuation that normalisation of Chinese answers drops.
WIDE_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."


def without(c: Column, chars: str) -> Column:
    return F.translate(c, "".join(dict.fromkeys(chars)), "")


def squeeze(c: Column) -> Column:
    """Words with one blank between them."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    return squeeze(F.regexp_replace(without(F.lower(c), ASCII_PUNCTUATION), r"(?U)\b(a|an|the)\b", " "))


def normalize_zh_answer(c: Column) -> Column:
    """Lower case, neither punctuation nor blanks."""
    return F.regexp_replace(without(F.lower(c), ASCII_PUNCTUATION + WIDE_PUNCTUATION), r"(?U)\s+", "")


def tokens(c: Column) -> Column:
    """Whitespace tokens; none of an empty text."""
    t = squeeze(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def share_equal(found: Column, wanted: Column) -> Column:
    """Of the strings found, the share equal to the wanted one; 0 if none were found."""
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda x: x == wanted)) / F.size(found)).otherwise(0.0)


def count_score(prediction: Column, answer: Column) -> Column:
    return share_equal(F.regexp_extract_all(prediction, F.lit(r"(\d+)"), 1), answer.cast("string"))


def retrieval_score(prediction: Column, answer: Column, label: str = "Paragraph ") -> Column:
    """Share of numbers that name the paragraph which the answer names first."""
    return count_score(prediction, F.regexp_extract(answer, rf"{label}(\d+)", 1))


def retrieval_zh_score(prediction: Column, answer: Column) -> Column:
    return retrieval_score(prediction, answer, "段落")


def last_number(c: Column) -> Column:
    """The last number of a text as a double, commas and signs passed over; null if there is none."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"(\d*\.?\d+)"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).cast("double")


def last_number_match(prediction: Column, answer: Column) -> Column:
    return F.coalesce(last_number(prediction) == last_number(answer), F.lit(False))


def first_line(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, r"^\n+", ""), "\n"), 1)


def code_line(c: Column) -> Column:
    """The first line with no backtick, hash or double slash; empty if there is none."""
    lines = F.filter(F.split(F.regexp_replace(c, r"^\n+", ""), "\n"), lambda x: ~x.rlike("[`#]|//"))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def fill_template(template: Column, context: Column, question: Column) -> Column:
    """The template with its {context} and {input} filled in; what is filled in is not read as a template."""
    ask = lambda part: F.replace(part, F.lit("{input}"), F.coalesce(question, F.lit("")))
    at = F.instr(template, "{context}")
    before = F.substring(template, F.lit(1), F.greatest(at - 1, F.lit(0)))
    after = F.substring(template, at + len("{context}"), F.length(template))
    return F.when(at > 0, F.concat(ask(before), F.coalesce(context, F.lit("")), ask(after))).otherwise(ask(template))


def split_template(template: Column) -> tuple[Column, Column]:
    """The template in two stages: up to and with {context}, and the question after it."""
    return F.concat(F.substring_index(template, "{context}", 1), F.lit("{context}")), F.substring_index(template, "{context}", -1)


def truncate_middle(words: Column, most: int) -> Column:
    """Of more than ``most`` tokens the first and last halves."""
    half = most // 2
    if half < 1:
        raise ValueError("at least two tokens must be allowed")
    return F.when(F.size(words) > most, F.concat(F.slice(words, 1, half), F.slice(words, -half, half))).otherwise(words)


def chat_prompt(prompt: Column, family: str) -> Column:
    """The prompt in the turn format of a model family; as it is for others."""
    # What each family's format puts before and after a user's turn.
    around = {
        "llama-2": ("[INST]", "[/INST]"),
        "mistral": ("[INST]", "[/INST]"),
        "llama-3": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nYou are a helpful assistant.<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"),
        "qwen": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"),
        "vicuna": ("A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions. USER: ", " ASSISTANT:"),
        "xgen": ("A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.\n\n ### Human: ", "\n###"),
        "chatglm": ("[Round 1]\n\n问：", "\n\n答："),
        "chatglm3": ("<|user|>\n ", "<|assistant|>"),
        "internlm": ("<|User|>:", "<eoh>\n<|Bot|>:"),
    }
    before, after = around.get(family, ("", ""))
    return F.concat(F.lit(before), prompt, F.lit(after))


def clean_response(c: Column, family: str) -> Column:
    """The response without the marks that a model family leaves in it."""
    if family == "xgen":
        return F.replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("Assistant:"), F.lit(""))
    if family == "internlm":
        return F.substring_index(c, "<eoa>", 1)
    return c
