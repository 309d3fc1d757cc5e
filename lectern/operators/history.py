"""The window of past turns that a follow-up question sees, and the prompt around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import filled, trimmed, window

BUDGET, QUESTION_LIMIT, ANSWER_LIMIT = 8000, 400, 800
RULE = "\n\n---\n\n"
SYSTEM_PROMPT = (
    "You are an assistant for scholarly documents. Answer from the document first and say so where it has no answer. "
    "Earlier questions give context only and never outrank the document. Write formulas as $...$ or $$...$$."
)
CLOSING = "Answer briefly and exactly; for a follow-up keep the thread without repeating long passages."


def turn_section(question: Column, answer: Column) -> Column:
    """One past turn as text, null where both sides are blank."""
    q, a = trimmed(question, QUESTION_LIMIT), trimmed(answer, ANSWER_LIMIT)
    return F.when((q != "") | (a != ""), F.concat(F.lit("Q: "), q, F.lit("\nA: "), a))


def history_blocks(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(session_id, history, n_turns): newest turns first until the next would pass the budget, then
    shown oldest first. ``turns``: session_id, turn, question, answer. Lengths are positive, so what
    fits is where the running sum stays within the budget: no loop."""
    newest = W.partitionBy("session_id").orderBy(F.col("turn").desc()).rowsBetween(W.unboundedPreceding, 0)
    shown = turns.select("session_id", "turn", turn_section(F.col("question"), F.col("answer")).alias("section")).where("section IS NOT NULL")
    fitting = shown.withColumn("used", F.sum(F.length("section")).over(newest)).where(F.col("used") <= budget)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "section")))
    return fitting.groupBy("session_id").agg(
        F.array_join(F.transform(ordered, lambda t: t["section"]), RULE).alias("history"), F.count(F.lit(1)).alias("n_turns")
    )


def answer_prompt(document: Column, history: Column, question: Column) -> Column:
    """The user prompt; null where there is no document to ask about."""
    parts = [
        F.concat(F.lit("Document (excerpt):\n"), window(document, "answer")),
        F.when(filled(history) != "", F.concat(F.lit("Recent questions and answers:\n"), history)),
        F.concat(F.lit("Question:\n"), filled(question)),
        F.lit(CLOSING),
    ]
    return F.when(filled(document) != "", F.concat_ws("\n\n", *parts))


def ask_prompts(requests: DataFrame, sessions: DataFrame, turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """request_id, session_id, prompt, error. ``sessions``: session_id, document."""
    joined = requests.join(sessions, "session_id", "left").join(history_blocks(turns, budget), "session_id", "left")
    prompt = answer_prompt(F.col("document"), F.col("history"), F.col("question"))
    blank = F.btrim(filled(F.col("question"))) == ""
    error = F.when(blank, "no question").when(prompt.isNull(), "no document")
    return joined.select("request_id", "session_id", F.when(error.isNull(), prompt).alias("prompt"), error.alias("error"))
