"""Evaluation: every question is asked, and its retrieval and its answer are scored.

The model is called from the driver, question by question; the scores are plans over all of them at once."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import evaluation, grounding
from larkspur.plans.answer import Answerer
from larkspur.sources.store import export_csv

MODES = ("dense", "sparse", "hybrid")
ANSWER = (
    "question_id string, category string, answerable boolean, n_expected int, expected array<string>, answer string, "
    "faithful boolean, grounded boolean, declined boolean, judged boolean, latency_ms double"
)


@dataclass
class Report:
    """``frame`` has a row for each question, ``summary`` one row."""

    mode: str
    top_k: int
    model: str | None
    frame: DataFrame
    summary: DataFrame
    cost_usd: float
    elapsed_s: float
    retrieval_only: bool

    def by_category(self) -> DataFrame:
        return evaluation.by_category(self.frame)

    def failures(self) -> DataFrame:
        return evaluation.failures(self.frame)


def first_questions(questions: list, limit: int | None) -> list:
    """The first ``limit`` in the order of the file (None or 0: all)."""
    return questions[:limit] if limit else questions


def resolve(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``question_id, chunk_id`` of relevant chunks, ``question_id, problem`` of labels that do not fit the corpus)."""
    q = questions.select(F.col("id").alias("question_id"), F.col("relevance").alias("rule"), "answerable", F.col("relevance").isNotNull().alias("has_rule"))
    relevant = evaluation.resolve_relevance(q.filter("has_rule"), chunks).persist()
    return relevant, evaluation.label_problems(q, relevant)


def evaluate(spark: SparkSession, answerer: Answerer, questions: list, relevant: DataFrame, mode: str = "hybrid", top_k: int = 5, use_judge: bool = True, retrieval_only: bool = False) -> Report:
    """A report over ``questions`` (rows with id, question, category, answerable, filters, expected_figures).
    ``retrieval_only`` asks no model, and has no score of answers. The budget's error ends the run."""
    began, got, answers, spent = time.time(), [], [], 0.0
    judge, answerer.judge = answerer.judge, answerer.judge if use_judge and not retrieval_only else None
    try:
        for q in questions:
            wanted, asked = _wanted(q["filters"]), time.time()
            if retrieval_only:
                a = {"passages": [r.asDict() for r in answerer.retrieve(q["question"], top_k, mode, wanted).collect()], "answer": "", "faithful": None, "is_grounded": None, "declined": None, "judged": None}
                a["latency_ms"] = 1000 * (time.time() - asked)
            else:
                a = answerer.ask(q["question"], top_k, mode, wanted)
                spent += answerer.model.budget.cost + (answerer.judge.budget.cost if answerer.judge and answerer.judge.budget is not answerer.model.budget else 0.0)
            got += [(q["id"], p["chunk_id"], p["rank"]) for p in a["passages"]]
            expected = list(q["expected_figures"] or [])
            answers.append((q["id"], q["category"], q["answerable"], len(expected), expected, a["answer"], a["faithful"], a["is_grounded"], a["declined"], a["judged"], float(a["latency_ms"])))
    finally:
        answerer.judge = judge
    answers = spark.createDataFrame(answers, ANSWER)
    retrieved = spark.createDataFrame(got, "question_id string, chunk_id string, rank int")
    metrics = evaluation.retrieval_metrics(answers.select("question_id"), retrieved, relevant, top_k)
    frame = answers.join(metrics, "question_id").withColumn("quoted", grounding.quotes_expected(F.col("answer"), F.col("expected"))).drop("expected")
    summary = evaluation.summary(frame)
    if retrieval_only:
        summary = summary.withColumns({c: F.lit(None).cast("double") for c in ("faithfulness", "grounding", "correct_declines", "quoted_expected")})
    model = None if retrieval_only else answerer.model.model
    return Report(mode, top_k, model, frame, summary.select(F.lit(mode).alias("mode"), F.lit(top_k).alias("top_k"), "*"), spent, time.time() - began, retrieval_only)


def _wanted(filters) -> dict | None:
    """A question's filter struct without its empty fields."""
    if filters is None:
        return None
    fields = filters.asDict() if hasattr(filters, "asDict") else dict(filters)
    return {k: list(v) for k, v in fields.items() if v} or None


def export(reports: list[Report], out: str) -> None:
    """CSV of each mode's rows, and of all summaries."""
    whole = None
    for r in reports:
        export_csv(r.frame.drop("answer"), f"{out}/results_{r.mode}")
        one = r.summary.withColumns({"cost_usd": F.lit(r.cost_usd), "elapsed_s": F.lit(r.elapsed_s)})
        whole = one if whole is None else whole.unionByName(one)
    if whole is not None:
        export_csv(whole.coalesce(1), f"{out}/summary")
