"""Rendered prompts of the generator with feedback and of the judge.
The oracle's strings are typed apart from the library's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prompt_texts as T
from ..operators import prompts as G
from ..operators import reshape as RS
from ..sources import fixtures as X
from .registry import query


def _lit(lines: str) -> str:
    """A SQL string; ``|`` ends a line."""
    return "'" + lines.replace("'", "''").replace("|", "' || chr(10) || '") + "'"


_VARY = "- Vary vocabulary, sentence structure, and "
_SCALE = "|Use a sentiment scale from 0 to 1, where:|- 0 is very negative|- 0.5 is neutral|- 1 is very positive|"
_MOVIE = ("|Guidelines:|- Write natural, conversational movie reviews|" + _VARY + "writing style|- Reviews should be between 50-200 words|"
          "- Focus on movie content, acting, direction, plot, etc.|- Be specific about what you liked or disliked|")
_DAILY = ("|Guidelines:|- Write natural, everyday sentences|" + _VARY + "topics|- Sentences should be between 10-50 words|"
          "- Focus on opinions, feelings, and subjective statements|- Be specific about what makes the sentiment positive or negative|")
_MATCH = "- The sentiment should match the provided score|"
_AI = "You are an AI assistant that generates "
_TASK = "||Your task is to generate "
_SYSTEMS = {
    0: (_AI + "realistic movie reviews for training a sentiment classifier." + _TASK + "movie reviews with the specified sentiment",
        " (positive or negative).|" + _MOVIE + "|", " score.|" + _SCALE + _MOVIE + _MATCH + "|"),
    1: (_AI + "sentences for training a sentiment classifier." + _TASK + "sentences with the specified sentiment",
        " (positive or negative).|" + _DAILY + "|", " score.|" + _SCALE + _DAILY + _MATCH + "|"),
    2: (_AI + "text for training a subjectivity classifier." + _TASK + "text ",
        "that is either subjective (opinionated) or objective (factual).||Guidelines:|- Write natural text that clearly shows "
        "subjectivity or objectivity|" + _VARY + "topics|- Text should be between 20-100 words|- Subjective text should contain "
        "opinions, feelings, judgments|- Objective text should contain facts, descriptions, neutral statements||",
        "with the specified subjectivity score.||Use a subjectivity scale from 0 to 1, where:|- 0 is very objective (factual, neutral)|"
        "- 0.5 is moderately subjective|- 1 is very subjective (opinionated, personal)||Guidelines:|- Write natural text that clearly "
        "shows the level of subjectivity|" + _VARY + "topics|- Text should be between 20-100 words|- Objective text should contain facts, "
        "descriptions, neutral statements|- Subjective text should contain opinions, feelings, judgments|- The subjectivity level "
        "should match the provided score||"),
    3: (_AI + "text expressing ",
        "specific emotions." + _TASK + "text that clearly expresses the specified emotion.||Guidelines:|- Write natural, emotionally "
        "expressive text|" + _VARY + "contexts|- Text should be between 10-50 words|- Focus on expressing the emotion clearly and "
        "naturally|- Use appropriate emotional language and tone||",
        "emotions with specified probability distributions." + _TASK + "text that expresses emotions according to the given probability "
        "distribution across 6 emotions: sadness, joy, love, anger, fear, surprise.||Guidelines:|- Write natural, emotionally expressive "
        "text|" + _VARY + "contexts|- Text should be between 10-50 words|- Focus on expressing the emotions according to the probability "
        "distribution|- Use emotional language and tone that matches the specified probabilities|- Output a 6-dimensional probability "
        "vector: [sadness, joy, love, anger, fear, surprise]||"),
}
_COT = ("||Before writing your final answer, please think step-by-step:||1. Understand the task requirements and constraints|2. Plan your "
        "approach and structure|3. Consider how to achieve the specified sentiment/subjectivity/emotion naturally|4. Think about "
        "vocabulary, tone, and style choices|5. Ensure your response meets all guidelines||Provide your complete step-by-step thinking "
        "process in the final output.")


def _case(which: int) -> str:
    arms = " ".join(f"WHEN {d} THEN {_lit(s[0] + s[which])} || source || {_lit(_COT)}" for d, s in _SYSTEMS.items())
    return f"CASE id % 4 {arms} END"


@query("progen_prompts", ops="G3 J5 (hard and soft prompts with feedback, every dataset)", sql=f"""
SELECT id, md5({_case(1)}) AS hard_system_md5, md5({_case(2)}) AS soft_system_md5,
  CASE id % 4 WHEN 0 THEN 'Generate a imdb text with ' || ['negative', 'positive'][c] || '.'
    WHEN 1 THEN 'Generate a sst text with ' || ['negative', 'positive'][c] || '.'
    WHEN 2 THEN 'Generate a subj text with ' || ['objective', 'subjective'][c] || '.'
    ELSE 'Generate text expressing ' || ['sadness', 'joy', 'love', 'anger', 'fear', 'surprise'][c] || ' emotion.' END AS hard_human,
  CASE WHEN id % 4 < 2 THEN 'Generate a ' || ['imdb', 'sst'][id % 4 + 1] || ' text with a sentiment score of ' || s || '.'
    WHEN id % 4 = 2 THEN 'Generate a subj text with a subjectivity score of ' || s || '.'
    ELSE 'Generate text expressing emotion with probability distribution [' || v || '].' END AS soft_human
FROM (SELECT v.id, d.source, CAST(length(d.text) % (CASE WHEN v.id % 4 = 3 THEN 6 ELSE 2 END) AS INT) + 1 AS c,
             CAST(round_even(label[1], 3) AS VARCHAR) AS s,
             array_to_string(list_transform(label, lambda x: CAST(round_even(x, 3) AS VARCHAR)), ', ') AS v
      FROM soft_vector v JOIN documents d ON d.doc_id = v.id)""")
def progen_prompts(spark, sf_dir):
    """Every document as a request: its dataset by id, its class by length, its
    source as the block of examples."""
    texts = X.texts(spark, sf_dir).select("id", "text", F.col("run").alias("block"))
    req = X.soft_vector(spark, sf_dir).select("id", "label").join(texts, "id")
    name = F.element_at(F.array(*[F.lit(d[0]) for d in T.PROGEN_DATASETS]), (F.col("id") % 4 + 1).cast("int"))
    j = RS.lookup_config(req.withColumn("dataset", name), T.progen_config(spark, cot=True), "dataset")
    cls = F.element_at("class_names", (F.length("text") % F.size("class_names") + 1).cast("int"))
    probs = F.concat(F.lit("["), F.array_join(F.transform("label", lambda p: F.bround(p, 3).cast("string")), ", "), F.lit("]"))
    vals = {"examples_block": F.col("block"), "score": F.bround(F.col("label")[0], 3), "probabilities": probs}
    vals |= dict.fromkeys(sorted({d[3] for d in T.PROGEN_DATASETS}), cls)
    return j.select("id", F.md5(G.render_columns("hard_system", vals)).alias("hard_system_md5"),
                    F.md5(G.render_columns("soft_system", vals)).alias("soft_system_md5"),
                    G.render_columns("hard_human", vals).alias("hard_human"), G.render_columns("soft_human", vals).alias("soft_human"))


_DECIMALS = "with 3 decimal places of precision (e.g., 0.123, 0.456, 0.789)"
_END = "||Be thorough in your analysis and provide clear reasoning for your judgment."
_ONE = ". Do not round to simple fractions like 0.1, 0.2, etc." + _END
_MANY = ". Do not round to simple fractions." + _END
_AND = ", along with your reasoning and confidence level."
_SUM = " where each value is between 0 and 1 and all values sum to 1" + _AND
_RANGE = " a score between 0 and 1"
_LEVELS = "provide" + _RANGE + " for each category, where:|- 0 represents no relevance to the category|- 1 represents very relevant to the category||"
_FEEL = ("You are an expert sentiment analyst. Your task is to evaluate the sentiment of given text and provide" + _RANGE + ", where:|- 0 represents "
         "very negative sentiment|- 0.5 represents neutral sentiment  |- 1 represents very positive sentiment||IMPORTANT: Provide your sentiment "
         "score " + _DECIMALS + _ONE,
         "Please analyze the sentiment of the following text:||Text: ", "||Provide a sentiment score between 0 and 1 " + _DECIMALS + _AND)
_EXPERT = "You are an expert in analyzing "
_JUDGES = [_FEEL, _FEEL, (
    _EXPERT + "text subjectivity. Your task is to evaluate the subjectivity of given text and provide" + _RANGE + ", where:|- 0 represents "
    "objective text (factual descriptions, neutral narration)|- 0.5 represents moderately subjective text|- 1 represents highly subjective "
    "text (personal opinions, emotional expressions, evaluative language)||IMPORTANT: Provide your subjectivity score " + _DECIMALS + _ONE,
    "Please analyze the subjectivity of the following text:||Text: ", "||Provide a subjectivity score between 0 and 1 " + _DECIMALS + _AND), (
    _EXPERT + "emotional content in text. Your task is to evaluate the emotional distribution of given text across six emotions: sadness, joy, "
    "love, anger, fear, and surprise.||For each emotion, provide" + _RANGE + " indicating the strength of that emotion in the text. All six "
    "scores should sum to 1.0.||IMPORTANT: Provide each emotion score " + _DECIMALS + _MANY,
    "Please analyze the emotional content of the following text:||Text: ",
    "||Provide an emotion distribution across six emotions (sadness, joy, love, anger, fear, surprise)" + _SUM), (
    _EXPERT + "question categories. Your task is to evaluate the category distribution of given questions and " + _LEVELS
    + "IMPORTANT: Provide each category score " + _DECIMALS + _MANY, "Please analyze the category distribution of the following question:||Question: ",
    "||Provide a category distribution across ten categories (Society & Culture, Science & Mathematics, Health, Education & Reference, Computers & "
    "Internet, Sports, Business & Finance, Entertainment & Music, Family & Relationships, Politics & Government)" + _SUM), (
    _EXPERT + "news topics. Your task is to evaluate the topic distribution of given news articles and " + _LEVELS
    + "IMPORTANT: Provide each category score " + _DECIMALS + _MANY, "Please analyze the topic distribution of the following news article:||Article: ",
    "||Provide a topic distribution across four categories (World, Sports, Business, Science/Technology)" + _SUM)]


@query("judge_prompts", ops="G3 G4 (the judge's prompts, every dataset)", sql=f"""
SELECT id, CASE id % 6 WHEN 3 THEN 6 WHEN 4 THEN 10 WHEN 5 THEN 4 ELSE 2 END AS k,
  md5(CASE id % 6 {' '.join(f"WHEN {i} THEN {_lit(j[0])}" for i, j in enumerate(_JUDGES))} END) AS system_md5,
  md5(CASE id % 6 {' '.join(f"WHEN {i} THEN {_lit(j[1])} || coalesce(text, '') || {_lit(j[2])}" for i, j in enumerate(_JUDGES))} END) AS human_md5
FROM texts""")
def judge_prompts(spark, sf_dir):
    """Every document's whole text as a text to judge, its dataset by id."""
    name = F.element_at(F.array(*[F.lit(n) for n in T.JUDGE]), (F.col("id") % 6 + 1).cast("int"))
    j = RS.lookup_config(X.texts(spark, sf_dir).select("id", "text").withColumn("dataset", name), T.judge_config(spark), "dataset")
    return j.select("id", "k", F.md5("judge_system").alias("system_md5"),
                    F.md5(G.render_columns("judge_human", {"text": F.col("text")})).alias("human_md5"))
