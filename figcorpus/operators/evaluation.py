"""Votes over several models, answer checks, accuracy and ablation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import parsing as ps
from figcorpus.functions import prompts as pr

LEVELS = ps.CAPABILITIES


def question_answer_join(questions: DataFrame, answers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Answer of each question; the last of several wins."""
    last = answers.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in answers.columns if c not in keys]), order).alias("_a"))
    return questions.join(last, keys).select(*questions.columns, "_a.*")


def majority_vote(
    answers: DataFrame, keys: list[str], answer: str = "answer", voter: str = "model_no", tie_seed: int | None = None
) -> DataFrame:
    """Most frequent answer per question and its count as text.

    Ties go to the answer of the earliest voter, which is also the rule when all differ;
    with ``tie_seed`` a tie of two answers is drawn by a seeded hash instead. Votes are
    counted per (question, answer) first, so both steps merge on the map side.
    """
    votes = answers.groupBy(*keys, answer).agg(F.count("*").alias("n"), F.min(voter).alias("first"))
    if tie_seed is None:
        rank = F.struct(F.col("n"), -F.col("first"))
    else:
        draw = F.when(F.col("n") > 1, F.xxhash64(*keys, answer, F.lit(tie_seed))).otherwise(-F.col("first").cast("bigint"))
        rank = F.struct(F.col("n"), draw)
    return (
        votes.groupBy(*keys)
        .agg(F.max_by(F.struct(F.col(answer).alias("answer"), F.col("n")), rank).alias("_w"))
        .select(*keys, F.col("_w.answer").alias("answer"), F.col("_w.n").cast("string").alias("reliability"))
    )


def judge_latest(log: DataFrame, keys: list[str], time: str, verdict: str = "can_answer") -> DataFrame:
    """Sufficiency judgements per question: how many, the latest, whether any said yes."""
    yes = F.lower(F.col(verdict)) == "yes"
    return log.groupBy(*keys).agg(
        F.count("*").alias("n_judgements"),
        F.max_by(yes, time).alias("latest_yes"),
        F.bool_or(F.coalesce(yes, F.lit(False))).alias("any_yes"),
    )


def checked_answers(answers: DataFrame, raw: str = "raw_answer", options: str = "options", gold: str = "gold") -> DataFrame:
    """Adds answer, valid, correct and the kind of failure."""
    v = ps.validate_answer(raw, options)
    return (
        answers.withColumn("_v", v)
        .withColumn("answer", F.col("_v.answer"))
        .withColumn("valid", F.col("_v.valid"))
        .drop("_v")
        .withColumn("correct", F.coalesce(F.col("answer") == F.col(gold), F.lit(False)))
        .withColumn(
            "error_type",
            F.when(F.col("answer") == "error", "api_error").when(~F.col("valid"), "invalid_format"),
        )
    )


def accuracy_report(answers: DataFrame, model: str = "model", capability: str = "capability") -> DataFrame:
    """Accuracy in percent per model, overall and per capability level.

    One pass with conditional averages; no pivot, so the levels need no extra job.
    """
    right = F.col("correct").cast("double")
    return answers.groupBy(model).agg(
        F.round(100 * F.avg(right), 2).alias("overall"),
        *[F.round(100 * F.avg(F.when(F.col(capability) == c, right)), 2).alias(c.lower()) for c in LEVELS],
    )


def ablation_report(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Processed and failed answers per group and model."""
    return answers.groupBy(*keys).agg(
        F.count("*").alias("processed"), F.count_if(F.col("error_type").isNotNull()).alias("errors")
    )


def field_name(group, model) -> Column:
    """Column of a model's result: its name with both contexts, else group and name."""
    return F.when(F.col(group) == "both_contexts", F.col(model)).otherwise(F.concat_ws("_", F.col(group), F.col(model)))


def wide_answers(
    long: DataFrame, key: str, models: list[str], group: str = "group", model: str = "model", value: str = "answer", latest: str | None = None
) -> DataFrame:
    """One column per group and model, named as result files name them.

    The columns are given, not discovered, so no extra job is needed. Where several answers of
    a group and model meet in a row, that with the largest ``latest`` counts (any, if not given); missing answers never do.
    """
    cols = []
    for g in pr.GROUPS:
        for m in models:
            name = m if g == "both_contexts" else f"{g}_{m}"
            own = F.when((F.col(group) == g) & (F.col(model) == m), F.col(value))
            cols.append((F.first(own, ignorenulls=True) if latest is None else F.max_by(own, F.when(own.isNotNull(), F.col(latest)))).alias(name))
    return long.groupBy(key).agg(*cols)


def append_results(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def answer_matches(answer, gold) -> Column:
    """Exact equality; two missing answers are equal."""
    return F.col(answer).eqNullSafe(F.col(gold))


def prompt_matrix(samples: DataFrame, models: list[str], groups=pr.GROUPS) -> DataFrame:
    """Every sample for every prompt group and model; the two lists are fixed and short,
    so rows are repeated in place and nothing is joined."""
    return samples.withColumn("group", F.explode(F.array(*[F.lit(g) for g in groups]))).withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in models]))
    )
