"""A caller's function on batches of rows, and answers of several models through it."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import prompts as pr
from figcorpus.operators import evaluation as ev
from figcorpus.session import dealt, durable


class RowError:
    """Stands in a function's replies for a row that failed by itself; its batch's other replies count."""

    def __init__(self, problem: str):
        self.problem = problem


Reply = tuple[str | None, str | None]


def ask(fn: Callable[[pd.DataFrame], list], part: pd.DataFrame, retries: int = 0, delay: float = 0.0) -> list[Reply]:
    """(response, problem) of every row. A part that still fails after its retries is halved.

    One bad row of n so costs about 2 log2(n) calls, and only its neighbours are
    asked again, in ever smaller parts.
    """
    problem = ""
    for k in range(retries + 1):
        try:
            replies = list(fn(part))
            if len(replies) != len(part):
                raise ValueError(f"{len(replies)} replies to {len(part)} rows")
            return [(None, r.problem) if isinstance(r, RowError) else (None if r is None else str(r), None) for r in replies]
        except Exception as e:  # the caller's function may raise anything
            problem = f"{type(e).__name__}: {e}"
            if k < retries and delay:
                time.sleep(delay)
    if len(part) <= 1:
        return [(None, problem)] * len(part)
    half = len(part) // 2
    return ask(fn, part.iloc[:half], retries, delay) + ask(fn, part.iloc[half:], retries, delay)


def score_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], list],
    keys: list[str],
    batch: int = 32,
    workers: int | None = None,
    retries: int = 0,
    delay: float = 0.0,
    carry: tuple[str, ...] = (),
    in_flight: int = 1,
) -> DataFrame:
    """Call ``fn`` on batches of rows: keys, carried columns, response, status, error.

    Tasks take the partitions; ``workers`` bounds how many there are, and each task keeps up
    to ``in_flight`` calls open, in threads, giving answers out in the order of
    the rows. So no more than ``in_flight`` batches are held, however long the
    partition. A batch that raises is halved until the bad rows are alone; a
    function that knows which rows failed puts a :class:`RowError` in
    their place and has no row asked again. ``carry`` names columns that come
    out again without ``fn`` seeing them.
    """
    if workers:
        df = df.repartition(workers)
    columns = [c for c in df.columns if c not in carry]
    kept = [*keys, *carry]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {fields[k]}" for k in kept] + ["response string", "status string", "error string"])

    def told(part: pd.DataFrame, replies: list[Reply]) -> pd.DataFrame:
        out = part[kept].copy()
        out["response"] = [r for r, _ in replies]
        out["status"] = ["error" if p else "ok" for _, p in replies]
        out["error"] = [p for _, p in replies]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (frame.iloc[lo : lo + batch] for frame in frames for lo in range(0, len(frame), batch))
        if in_flight <= 1:
            for part in parts:
                yield told(part, ask(fn, part[columns], retries, delay))
            return
        with ThreadPoolExecutor(in_flight) as pool:
            open_: deque = deque()
            for part in parts:
                if len(open_) >= in_flight:
                    first, replies = open_.popleft()
                    yield told(first, replies.result())
                open_.append((part, pool.submit(ask, fn, part[columns], retries, delay)))
            for first, replies in open_:
                yield told(first, replies.result())

    return df.mapInPandas(run, schema)


def journaled_batches(df: DataFrame, fn, keys: list[str], journal: str, slices: int = 16, again: bool = False, **how) -> DataFrame:
    """As :func:`score_batches`, with all answers kept under the folder ``journal``, by key.

    Rows are dealt into ``slices`` by a hash of their keys, and a slice's answers are
    written when it is done. Whoever calls again, after a job or the driver was lost, asks only for
    keys without an answer, so at most one slice is paid for twice.
    ``again`` asks once more for keys whose last answer is an error; of several answers to a
    key the last attempt counts, a success before an error. ``keys`` name a row;
    several rows of a key are asked once each in one call.
    """
    spark = df.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kept = [*keys, *how.get("carry", ())]
    schema = ", ".join([f"`{k}` {fields[k]}" for k in kept] + ["response string", "status string", "error string", "attempt bigint"])

    def answered() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{journal}/*")
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    before = answered()
    done = before.where("status = 'ok'") if again else before
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    pending = df.join(done.select(*keys).distinct(), keys, "left_anti").withColumn("__slice", F.pmod(F.xxhash64(*keys), F.lit(slices)))
    pending = pending.persist(StorageLevel.DISK_ONLY)
    held = sorted(r[0] for r in pending.select("__slice").distinct().collect())
    for k in held:
        asked = score_batches(pending.where(F.col("__slice") == k).drop("__slice"), fn, keys, **how)
        asked.withColumn("attempt", F.lit(attempt).cast("bigint")).write.mode("overwrite").parquet(f"{journal}/attempt{attempt}-{k}")
    pending.unpersist()
    rest = [c for c in ("response", "status", "error", "attempt") if c != "attempt"]
    carried = [c for c in kept if c not in keys]
    best = F.max_by(F.struct(*carried, *rest), F.struct((F.col("status") == "ok").cast("int"), "attempt"))
    return answered().join(df.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(best.alias("__a")).select(*keys, "__a.*")


def multi_model_answers(
    samples: DataFrame, models: list[str], fn, key: str = "sample_id", groups=pr.GROUPS, **how
) -> DataFrame:
    """Answers of every model for every sample and prompt group, checked and typed.

    Samples are dealt over the tasks before they are repeated, so asking takes all cores.
    """
    asked = ev.prompt_matrix(dealt(samples), models, groups).withColumn(
        "prompt", pr.build_prompt("group", "image_background", "analysis_information", "question", "options")
    )
    return _answers(asked, fn, key, **how)


def _answers(asked: DataFrame, fn, key: str, **how) -> DataFrame:
    rows = asked.select(key, "group", "model", "prompt", "options", "gold")
    replies = score_batches(rows, fn, [key, "group", "model"], carry=("options", "gold"), **how)
    checked = ev.checked_answers(replies, "response")
    return checked.withColumn(
        "error_type", F.when(F.col("status") == "error", F.lit("api_error")).otherwise(F.col("error_type"))
    )


def retry_failed(answers: DataFrame, samples: DataFrame, fn, key: str = "sample_id", **how) -> DataFrame:
    """Ask again for every failed answer; the others stay.

    The answers are computed once, so the model behind them is not asked again to
    tell which failed.
    """
    answers = durable(answers)
    bad = answers.where("error_type IS NOT NULL").select(key, "group", "model")
    prompts = dealt(bad.join(samples, key)).withColumn(
        "prompt", pr.build_prompt("group", "image_background", "analysis_information", "question", "options")
    )
    redone = _answers(prompts, fn, key, **how)
    good = answers.where("error_type IS NULL")
    return good.unionByName(redone.select(*good.columns))
