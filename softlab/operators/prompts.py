"""Prompt and response tables.

Prompts are rendered with string expressions over DataFrames: a few-shot
list per prompt is bounded by the shot count k, so collecting it per prompt
is bounded; templates are literals (one per dataset) substituted with
``replace``.  Calling a model (G5/G7/G8/G9) lives in ``inference``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# ---- fixed values: prompt strings that must equal the reference's -------
CHAIN_OF_THOUGHT = ("Before writing your final answer, please think step-by-step.\n"
                    "Ensure that you MUST provide your step-by-step thinking process in the final output.")
EXAMPLES_FOOTER = ("\nYou MUST generate text that significantly differs in presentation, style, tone, "
                   "phrasing, content, and vocabulary from the examples above.\n")
LEARN_INSTRUCTION = (
    "IMPORTANT: Analyze these examples carefully before generating your response!\n\n"
    "What to learn from the examples:\n"
    "- Writing style, vocabulary, and tone\n"
    "- Structure and approach to the task\n"
    "- How they achieve the target sentiment/subjectivity/emotion\n"
    "- Quality and authenticity of expression\n\n"
    "Apply similar techniques and maintain comparable quality in your response.")
IMDB_SYSTEM = "\n".join([
    "You are tasked with generating realistic movie reviews to train a sentiment classifier.",
    "Use a sentiment scale from 0 (negative) to 1 (positive).",
    "Reviews should generally be between 100 and 500 words, avoiding overly short or excessively long responses.",
    "{chain_of_thought_instructions}",
    "{examples_block}",
])
IMDB_HUMAN = "Generate a movie review with a sentiment score of {score}."
SST_SYSTEM = "\n".join([
    "You are tasked with generating realistic movie review snippets to train a sentiment classifier.",
    "Use a sentiment scale from 0 (negative) to 1 (positive)",
    "Each should generally be between 10 and 50 words, usually a single sentence or a short phrase.",
    "Use realistic language that one might find in a movie review.",
    "{chain_of_thought_instructions}",
    "{examples_block}",
])
SST_HUMAN = "Write a movie review with a sentiment score of {score}."
SUBJ_SYSTEM = "\n".join([
    "You are tasked with generating realistic text to train a subjectivity classifier.",
    "Use a subjectivity scale where 0 represents an objective statement (e.g., factual descriptions, neutral "
    "narration) and 1 represents a subjective statement (e.g., personal opinions, emotional expressions, or "
    "evaluative language.)",
    "Use everyday language as if written on some online platform.",
    "Text that you write should generally be between 10 and 50 words.",
    "{chain_of_thought_instructions}",
    "{examples_block}",
])
SUBJ_HUMAN = "Generate text with a subjectivity score of {score}."
EMOTION_SYSTEM = "\n".join([
    "You are an AI language model assistant trained to generate emotionally nuanced text.",
    "You will receive an emotion distribution across six emotions (sadness, joy, love, anger, fear, surprise),",
    "where each value indicates the strength of that emotion and all values sum to 1.",
    "Your task is to generate text that reflects this emotional distribution.",
    "{chain_of_thought_instructions}",
])
EMOTION_HUMAN = "Generate text that reflects the following emotional distribution: {score}"
AGNEWS_SYSTEM = "\n".join([
    "You are an AI language model assistant trained to generate realistic news headlines.",
    "You will receive a topic distribution across four categories: world, sports, business, and science/technology.",
    "Each value represents the proportion of relevance for that topic, and all values sum to 1.",
    "Your task is to write a news headline that reflects this topic distribution.",
    "Headlines should be written in a style typical of online news sources.",
    "Headlines should generally be between 30 and 60 words, but this can vary naturally based on the topic.",
    "Do not mention the categories or percentages directly in the headline.",
    "Avoid generic or unnatural language. Aim for specificity and realism.",
])
AGNEWS_HUMAN = "Generate a realistic and coherent news headline that reflects the following topic distribution: {score}"
TEMPLATES = {
    "imdb": (IMDB_SYSTEM, IMDB_HUMAN), "sst": (SST_SYSTEM, SST_HUMAN), "subj": (SUBJ_SYSTEM, SUBJ_HUMAN),
    "emotion": (EMOTION_SYSTEM, EMOTION_HUMAN), "agnews": (AGNEWS_SYSTEM, AGNEWS_HUMAN),
}
# --------------------------------------------------------------------------


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def examples_block(examples: ColumnOrName) -> Column:
    """G1: header, ``- Example i: text`` lines (newlines removed), footer.
    ``examples`` is an ordered array of strings."""
    ex = _c(examples)
    lines = F.transform(ex, lambda t, i: F.regexp_replace(
        F.concat(F.lit("- Example "), (i + 1).cast("string"), F.lit(": "), t), "\n", ""))
    header = F.concat(F.lit("Here are "), F.size(ex).cast("string"), F.lit(" examples to take advantage of:\n"))
    return F.concat(header, F.array_join(lines, "\n"), F.lit(EXAMPLES_FOOTER))


def examples_block_learn(examples: ColumnOrName) -> Column:
    """The alternative layout; an empty list gives ''."""
    ex = _c(examples)
    body = F.array_join(F.transform(ex, lambda t, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(": "), t, F.lit("\n\n"))), "")
    block = F.concat(F.lit("Here are "), F.size(ex).cast("string"), F.lit(" examples to learn from:\n\n"),
                     body, F.lit(LEARN_INSTRUCTION))
    return F.when(F.size(ex) > 0, block).otherwise(F.lit(""))


def shots_per_prompt(shots: DataFrame, prompt_col: str, order_col: str, text_col: str) -> DataFrame:
    """Ordered example list per prompt (bounded by the shot count k)."""
    return shots.groupBy(prompt_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                         F.col(text_col).alias("t")))),
                    lambda s: s["t"]).alias("examples"))


def render(template: str, values: dict[str, Column]) -> Column:
    """Substitute ``{name}`` placeholders with column values."""
    return render_columns(F.lit(template), values)


def render_prompts(requests: DataFrame, score: str, system: str = IMDB_SYSTEM, human: str = IMDB_HUMAN,
                   cot: bool = False, examples: ColumnOrName | None = None) -> DataFrame:
    """System + human message columns per request."""
    vals = {"chain_of_thought_instructions": F.lit(CHAIN_OF_THOUGHT if cot else ""),
            "examples_block": _c(examples) if examples is not None else F.lit(""),
            "score": F.col(score)}
    return requests.withColumns({"system": render(system, vals), "human": render(human, vals)})


def render_columns(template: ColumnOrName, values: dict[str, Column]) -> Column:
    """G3 with the template itself a column (e.g. joined from the dataset
    config, J5), so requests of several datasets render in one pass."""
    out = _c(template)
    for name, val in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(val.cast("string"), F.lit("")))
    return out


def format_distribution(names: ColumnOrName, probs: ColumnOrName, digits: int = 3) -> Column:
    """``{'name': p, ...}`` with p rounded half-even to ``digits``,
    the way a class -> probability mapping prints in a prompt."""
    pairs = F.zip_with(_c(names), _c(probs), lambda n, p: F.concat(
        F.lit("'"), n, F.lit("': "), F.bround(p, digits).cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def merge_messages(system: ColumnOrName, human: ColumnOrName) -> Column:
    """One human message = system and human joined by a space."""
    return F.concat_ws(" ", _c(system), _c(human))


def judge_with_defaults(requests: DataFrame, judged: DataFrame, key: Sequence[str],
                        k: int | None = None) -> DataFrame:
    """Every request gets a judgement; failed / missing rows get the
    neutral default (0.5, or the uniform 1/K vector), confidence 0 and the
    error kept."""
    j = requests.join(judged.withColumn("_ok", F.lit(True)), list(key), "left")
    if k is None:
        default = F.lit(0.5)
    else:
        default = F.array(*[F.lit(1.0 / k)] * k)
    ok = F.coalesce(F.col("_ok"), F.lit(False)) & F.col("judge_score").isNotNull()
    return j.select(*requests.columns,
                    F.when(ok, F.col("judge_score")).otherwise(default).alias("judge_score"),
                    F.when(ok, F.col("judge_confidence")).otherwise(F.lit(0.0)).alias("judge_confidence"),
                    F.when(ok, F.lit(None).cast("string"))
                    .otherwise(F.coalesce(F.col("error") if "error" in judged.columns else F.lit(None),
                                          F.lit("no judgement"))).alias("error"))


def posthoc_soft_labels(texts: DataFrame, judgements: DataFrame, key: str,
                        label: str = "label") -> DataFrame:
    """Hard-prompt texts relabelled by the judge's score (J1 join)."""
    return texts.drop(label).join(judgements.select(key, F.col("judge_score").alias(label)), key)
