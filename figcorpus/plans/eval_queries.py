"""Queries of votes, answer checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import parsing as ps
from figcorpus.operators import evaluation as ev
from figcorpus.operators import inference as inf
from figcorpus.plans import fixtures as fx
from figcorpus.plans.registry import query, table

EVAL = f"""ev AS ({fx.EVAL_SQL}),
chk AS (SELECT *, CASE WHEN upper(trim(raw_answer)) IN ('A','B','C','D') THEN upper(trim(raw_answer))
    WHEN lower(raw_answer) LIKE '%error%' THEN 'error' ELSE upper(trim(raw_answer)) END answer,
  coalesce(upper(trim(raw_answer)) IN ('A','B','C','D') OR lower(raw_answer) LIKE '%error%', false) AS valid,
  CASE cap WHEN 0 THEN 'Perception' WHEN 1 THEN 'Data_extraction' WHEN 2 THEN 'Calculation_analysis' WHEN 3 THEN 'Pattern_recognition'
    WHEN 4 THEN 'Logical_reasoning' ELSE 'Decision_support' END capability FROM ev)"""


def _checked(spark, sf):
    names = F.array(*[F.lit(c) for c in ps.CAPABILITIES])
    return ev.checked_answers(fx.with_options(fx.evals(spark, sf))).withColumn(
        "capability", F.get(names, F.col("cap"))
    )


@query("b21_validate_answer", f"WITH {EVAL} SELECT sample_id, answer, valid FROM chk")
def b21(spark, sf):
    return _checked(spark, sf).select("sample_id", "answer", "valid")


@query(
    "b22_needs_retry",
    f"WITH {EVAL} SELECT sample_id, coalesce(raw_answer NOT IN ('A','B','C','D'), false) needs_retry FROM ev",
)
def b22(spark, sf):
    rows = fx.with_options(fx.evals(spark, sf))
    return rows.select("sample_id", ps.needs_retry("raw_answer", "options").alias("needs_retry"))


@query(
    "f05_random_fallback",
    f"WITH {EVAL} SELECT sample_id, coalesce(answer IN ('A','B','C','D'), false) AS kept, true AS is_option FROM chk",
)
def f05(spark, sf):
    rows = _checked(spark, sf).withColumn("final", ps.random_option("answer", "options"))
    return rows.select(
        "sample_id",
        F.coalesce(F.col("final") == F.col("answer"), F.lit(False)).alias("kept"),
        F.array_contains(F.map_keys("options"), F.col("final")).alias("is_option"),
    )


@query(
    "h06_answer_judge",
    f"WITH {EVAL} SELECT sample_id, answer IS NOT DISTINCT FROM gold AS correct FROM chk",
)
def h06(spark, sf):
    return _checked(spark, sf).select("sample_id", ev.answer_matches("answer", "gold").alias("correct"))


@query(
    "d21_accuracy_report",
    f"""WITH {EVAL}, r AS (SELECT *, CASE WHEN coalesce(answer=gold,false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ok FROM chk)
    SELECT model, round(100*avg(ok),2) overall, """
    + ", ".join(f"round(100*avg(ok) FILTER (capability='{c}'),2) {c.lower()}" for c in ps.CAPABILITIES)
    + " FROM r GROUP BY model",
)
def d21(spark, sf):
    return ev.accuracy_report(_checked(spark, sf))


GROUP_SQL = "CASE sample_id%4 WHEN 0 THEN 'image_background_only' WHEN 1 THEN 'analysis_information_only' WHEN 2 THEN 'both_contexts' ELSE 'no_context' END"


@query(
    "d22_ablation_report",
    f"""WITH {EVAL} SELECT {GROUP_SQL} AS "group", model, count(*) processed, count(*) FILTER (answer='error' OR NOT valid) errors FROM chk GROUP BY ALL""",
)
def d22(spark, sf):
    return ev.ablation_report(_checked(spark, sf).withColumn("group", F.expr(GROUP_SQL)), ["group", "model"])


MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _field(g, m):
    return m if g == "both_contexts" else f"{g}_{m}"


@query(
    "d27_wide_answers",
    f"""WITH {EVAL} SELECT sample_id AS sheet, """
    + ", ".join(
        f"""max(answer) FILTER (model='{m}' AND {GROUP_SQL}='{g}') AS "{_field(g, m)}\""""
        for g in ("image_background_only", "analysis_information_only", "both_contexts", "no_context")
        for m in MODELS
    )
    + " FROM chk GROUP BY 1",
)
def d27(spark, sf):
    rows = _checked(spark, sf).withColumn("group", F.expr(GROUP_SQL)).withColumn("sheet", F.col("sample_id"))
    return ev.wide_answers(rows, "sheet", MODELS)


@query(
    "d27_wide_sheets",
    f"""WITH {EVAL} SELECT (sample_id // 64)::BIGINT AS sheet, """
    + ", ".join(
        f"""arg_max(answer, sample_id) FILTER (model='{m}' AND {GROUP_SQL}='{g}' AND answer IS NOT NULL) AS "{_field(g, m)}\""""
        for g in ("image_background_only", "analysis_information_only", "both_contexts", "no_context")
        for m in MODELS
    )
    + " FROM chk GROUP BY 1",
)
def d27_sheets(spark, sf):
    """Sheets of 64 sample numbers: answers of every group and model meet in a row, the latest of each counts."""
    rows = _checked(spark, sf).withColumn("group", F.expr(GROUP_SQL)).withColumn("sheet", F.floor(F.col("sample_id") / 64))
    return ev.wide_answers(rows, "sheet", MODELS, latest="sample_id")


# The lines of an order vote with a letter made from their part.
VOTES = """votes AS (SELECT l_orderkey q, l_linenumber model_no, chr(CAST(65+l_partkey%3 AS INT)) answer FROM
  (SELECT l_orderkey, l_linenumber, min(l_partkey) l_partkey FROM lineitem GROUP BY ALL))"""


@query(
    "d10_majority_vote",
    f"""WITH {VOTES}, c AS (SELECT q, answer, count(*) n, min(model_no) f FROM votes GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, f) k FROM c)
    SELECT q, answer, CAST(n AS VARCHAR) reliability FROM r WHERE k=1""",
)
def d10(spark, sf):
    votes = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("p"))
        .select(
            F.col("l_orderkey").alias("q"),
            F.col("l_linenumber").alias("model_no"),
            F.expr("chr(65 + p % 3)").alias("answer"),
        )
    )
    return ev.majority_vote(votes, ["q"])


@query(
    "c18_question_answer_join",
    """WITH last AS (SELECT l_partkey, max_by(l_returnflag, l_orderkey*1000+l_linenumber) answer FROM
       (SELECT l_partkey, l_orderkey, l_linenumber, max(l_returnflag) l_returnflag FROM lineitem GROUP BY ALL) GROUP BY 1)
    SELECT p_partkey, p_name question, answer FROM part JOIN last ON l_partkey=p_partkey""",
)
def c18(spark, sf):
    q = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("question"))
    a = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
        .agg(F.max("l_returnflag").alias("answer"))
        .withColumn("seq", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    )
    return ev.question_answer_join(q, a.select("p_partkey", "answer", "seq"), ["p_partkey"], "seq").drop("seq")


@query(
    "d26_judge_log",
    """SELECT user_id, count(*) n_judgements, arg_max(event_type='click', event_id) latest_yes, bool_or(event_type='click') any_yes FROM events GROUP BY user_id""",
)
def d26(spark, sf):
    log = table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "click", "Yes").otherwise("no").alias("can_answer")
    )
    return ev.judge_latest(log, ["user_id"], "event_id")


@query(
    "g03_append_results",
    """SELECT doc_id AS id, quality::BIGINT score, NULL::BIGINT n_chars FROM labels UNION ALL SELECT doc_id, NULL, n_chars FROM documents""",
)
def g03(spark, sf):
    old = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("bigint").alias("score"))
    new = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return ev.append_results(old, new)


def stub_model(part):
    """Stands in for a caller's model: counts the letters of each prompt; some rows fail."""
    out = []
    for prompt in part["prompt"]:
        n = len(prompt)
        if n % 13 == 0:
            raise ValueError("service busy")
        out.append("ABCD"[n % 4] if n % 5 else "no idea")
    return out


def _samples(spark, sf):
    return fx.with_options(
        table(spark, sf, "part").select(
            F.col("p_partkey").alias("sample_id"),
            F.col("p_type").alias("image_background"),
            F.col("p_brand").alias("analysis_information"),
            F.col("p_name").alias("question"),
            F.expr("chr(65 + p_partkey % 4)").alias("gold"),
        )
    )


STUB = "CASE WHEN n%13=0 THEN NULL WHEN n%5=0 THEN 'no idea' ELSE ['A','B','C','D'][n%4+1] END"


@query(
    "i01_score_batches",
    f"""SELECT doc_id, {STUB} response, CASE WHEN n%13=0 THEN 'error' ELSE 'ok' END status, CASE WHEN n%13=0 THEN 'ValueError: service busy' END error
    FROM (SELECT doc_id, length(text) n FROM documents)""",
)
def i01(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return inf.score_batches(docs, stub_model, ["doc_id"], batch=16)


PROMPTS = f"""g AS (SELECT unnest(['image_background_only','analysis_information_only','both_contexts','no_context']) grp), m AS (SELECT unnest(['m1','m2']) model),
    p AS (SELECT p_partkey, grp, model, length(CASE WHEN grp IN ('image_background_only','both_contexts') THEN 'image_background: '||p_type||repeat(chr(10),5) ELSE '' END ||
      CASE WHEN grp IN ('analysis_information_only','both_contexts') THEN 'analysis_information: '||p_brand||repeat(chr(10),5) ELSE '' END ||
      'question: '||p_name||repeat(chr(10),5)||'options: {{"A": "rises", "B": "falls", "C": "stays flat", "D": "cannot be told"}}'||repeat(chr(10),5)||
      CASE WHEN grp='no_context' THEN 'Based on the image, ' ELSE 'Based on the image and the provided information, ' END||
      'select the correct option. Output ONLY the single letter corresponding to your choice (A, B, C, D) with no additional text, explanations, or formatting. For example, if the answer is ''A'', you must only output: A.') n
      FROM part, g, m)"""


@query(
    "i02_multi_model_answers",
    f"""WITH {PROMPTS},
    r AS (SELECT *, upper({STUB}) answer FROM p)
    SELECT p_partkey sample_id, grp AS "group", model, answer, coalesce(answer IN ('A','B','C','D'), false) AS valid, coalesce(answer=chr(CAST(65+p_partkey%4 AS INT)), false) correct,
      CASE WHEN answer IS NULL THEN 'api_error' WHEN answer='NO IDEA' THEN 'invalid_format' END error_type FROM r""",
)
def i02(spark, sf):
    out = inf.multi_model_answers(_samples(spark, sf), ["m1", "m2"], stub_model, batch=64)
    return out.select("sample_id", "group", "model", "answer", "valid", "correct", "error_type")


def second_model(part):
    """Stands in for the model of a second pass: always has an answer, and never the first one's."""
    return ["ABCD"[(len(p) + 1) % 4] for p in part["prompt"]]


@query(
    "i02_retry_failed",
    f"""WITH {PROMPTS},
    r AS (SELECT *, ['A','B','C','D'][CASE WHEN n%13=0 OR n%5=0 THEN (n+1)%4+1 ELSE n%4+1 END] answer FROM p)
    SELECT p_partkey sample_id, grp AS "group", model, answer, answer=chr(CAST(65+p_partkey%4 AS INT)) correct, NULL::VARCHAR error_type FROM r""",
)
def i02_retry(spark, sf):
    """Answers that failed or were no option are asked for again, the others stay."""
    samples = _samples(spark, sf)
    first = inf.multi_model_answers(samples, ["m1", "m2"], stub_model, batch=64)
    out = inf.retry_failed(first, samples, second_model, batch=64)
    return out.select("sample_id", "group", "model", "answer", "correct", "error_type")
