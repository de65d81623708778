"""Model output to columns: JSON extraction, defaults, answer checks, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figcorpus.functions.draws import draw
from figcorpus.functions.text import _c, strip, to_int, to_ints

# fixed values
SCREEN_SCHEMA = "is_compliant STRING, compliance_level STRING, complexity_level STRING"
CAPABILITIES = (
    "Perception",
    "Data_extraction",
    "Calculation_analysis",
    "Pattern_recognition",
    "Logical_reasoning",
    "Decision_support",
)


def extract_json(col) -> Column:
    """The object in a fenced block, else the trimmed text when braces enclose it, else the text."""
    c = _c(col)
    fenced = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
    bare = strip(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(c.rlike(fenced), F.regexp_extract(c, fenced, 1))
        .when(bare.startswith("{") & bare.endswith("}"), bare)
        .otherwise(c)
    )


def strip_fence(col) -> Column:
    """Remove an opening ```json or ``` and a closing ```, then repair doubled colons."""
    c = F.regexp_replace(_c(col), r"^```json|^```", "")
    c = strip(F.regexp_replace(c, r"```$", ""))
    return F.regexp_replace(c, r'"\s*:\s*:\s*', '": ')


def parse_object(col, schema: str) -> Column:
    """Object of a JSON text, NULL when the text is no JSON object.

    Numbers given for string fields keep their spelling, so levels may come as either.
    """
    c = strip_fence(extract_json(col))
    ok = F.get_json_object(c, "$").isNotNull() & c.startswith("{")
    return F.when(ok, F.from_json(c, schema, {"mode": "PERMISSIVE"}))


def parse_screening(col) -> Column:
    """Screening answer with the default row (null, -1, -1) for anything unreadable."""
    p = parse_object(col, SCREEN_SCHEMA)
    return F.struct(
        F.when(p.isNull(), F.lit("null")).otherwise(p["is_compliant"]).alias("is_compliant"),
        F.when(p.isNull(), F.lit(-1)).otherwise(to_int(p["compliance_level"])).alias("compliance_level"),
        F.when(p.isNull(), F.lit(-1)).otherwise(to_int(p["complexity_level"])).alias("complexity_level"),
        F.when(p.isNull(), F.lit("default")).otherwise(F.lit("ok")).alias("status"),
        F.when(p.isNull(), _c(col)).alias("raw_response"),
    )


def parse_answer(col) -> Column:
    """The answer of a reply, or the whole reply when it is no JSON object."""
    p = parse_object(col, "answer STRING")
    return F.when(p.isNull(), _c(col)).otherwise(p["answer"])


def validate_answer(raw, options) -> Column:
    """struct(answer, valid): an option letter, or "error" when the text speaks of one."""
    r = _c(raw)
    up = F.upper(strip(r))
    return F.struct(
        F.when(F.array_contains(F.map_keys(_c(options)), up), up)
        .when(F.lower(up).contains("error"), F.lit("error"))
        .when(r.isNotNull(), up)
        .alias("answer"),
        F.coalesce(
            F.array_contains(F.map_keys(_c(options)), up) | F.lower(up).contains("error"), F.lit(False)
        ).alias("valid"),
    )


def needs_retry(answer, options, status=None) -> Column:
    """A stored result to ask for again: a failure status, "error", or no option letter.
    Missing results have not been asked at all and stay out."""
    a = _c(answer)
    bad = F.coalesce((a == "error") | ~F.array_contains(F.map_keys(_c(options)), a), F.lit(False))
    return bad if status is None else _c(status).isNotNull() | bad


def map_verdict(col) -> Column:
    up = F.upper(strip(_c(col)))
    return F.when(up.contains("KEEP"), "keep").when(up.contains("DELETE"), "delete").otherwise("uncertain")


def validate_node(col) -> Column:
    """Generated tree node: required fields or the fixed fallback; an unknown capability is
    replaced by one picked from the hash of the text."""
    c = _c(col)
    p = parse_object(
        c, "instruction STRING, question STRING, choices MAP<STRING,STRING>, capability STRING, can_answer_finalq BOOLEAN"
    )
    ok = p.isNotNull() & p["instruction"].isNotNull() & p["question"].isNotNull()
    ok = ok & p["choices"].isNotNull() & p["capability"].isNotNull()
    names = F.array(*[F.lit(x) for x in CAPABILITIES])
    picked = F.element_at(names, (draw(c) % len(CAPABILITIES) + 1).cast("int"))
    known = F.array_contains(names, p["capability"])
    # fixed values: the node used when generation fails
    fallback = F.create_map(
        *[F.lit(x) for x in ("A", "Increasing", "B", "Decreasing", "C", "No clear trend")]
    )
    return F.struct(
        F.when(ok, p["instruction"]).otherwise("Identify the main trend line in the image").alias("instruction"),
        F.when(ok, p["question"]).otherwise("Is the primary trend line increasing or decreasing?").alias("question"),
        F.when(ok, p["choices"]).otherwise(fallback).alias("choices"),
        F.when(ok & known, p["capability"]).when(ok, picked).otherwise("visual recognition").alias("capability"),
        F.coalesce(F.when(ok, p["can_answer_finalq"]), F.lit(False)).alias("can_answer_finalq"),
        ok.alias("generated"),
    )


def random_option(answer, options, seed: int = 0) -> Column:
    """An option letter stays; anything else becomes an option picked from a seeded hash."""
    keys = F.map_keys(_c(options))
    pick = F.element_at(keys, (draw(_c(answer), seed=seed) % F.size(keys) + 1).cast("int"))
    return F.when(F.array_contains(keys, _c(answer)), _c(answer)).otherwise(pick)


def label_ints(col) -> Column:
    """Integer labels of a list given as strings or numbers, unreadable ones dropped."""
    return F.filter(to_ints(col), lambda x: x.isNotNull())
