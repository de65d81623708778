"""Context strings and prompts built from image and question records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from figcorpus.functions.text import _c, bind, is_chinese, trim_to_sentences

# fixed values: the ablation groups and the wording that result files are read back with
GROUPS = ("image_background_only", "analysis_information_only", "both_contexts", "no_context")


def _fit(text: Column) -> Column:
    """Texts over their budget (1000 characters in Chinese, 4000 otherwise) are trimmed."""

    def within(t):
        budget = F.when(is_chinese(t), F.lit(1000)).otherwise(F.lit(4000))
        return F.when(F.length(t) <= 1000, t).otherwise(trim_to_sentences(t, budget))

    return bind(text, within)


def assemble_context(
    classification, image_path, caption, references, surround, repeat_surround: bool = False
) -> Column:
    """Context of an image: its path, then caption and first exact reference for ``normal``
    images, else the text around it.

    ``references`` is an array of struct(is_exact_match, reference_paragraph_extension).
    A result under 500 characters gets the surrounding text added; ``repeat_surround``
    adds it always, also when it is there already.
    """
    head = "\n\nThe context surrounding this image is as follows: "
    exact = F.get(F.filter(_c(references), lambda r: r["is_exact_match"]), F.lit(0))["reference_paragraph_extension"]
    parts = F.struct(
        F.concat(F.lit("The path of this image is: ["), _c(image_path), F.lit("].")).alias("path"),
        (_c(classification) == "normal").alias("normal"),
        F.coalesce(_c(caption), F.lit("")).alias("caption"),
        _fit(F.nullif(exact, F.lit(""))).alias("exact"),
        (F.coalesce(F.size(_c(references)), F.lit(0)) > 0).alias("has_refs"),
        _fit(F.coalesce(_c(surround), F.lit(""))).alias("around"),
    )

    def join(x):
        around = F.concat(F.lit(head), x["around"])
        normal = F.concat(
            x["path"],
            F.when(x["caption"] != "", F.concat(F.lit("\n\nThe caption for this image is: "), x["caption"])).otherwise(""),
            F.when(
                x["exact"].isNotNull(),
                F.concat(F.lit("\n\nThis image is referenced in the following content:- "), x["exact"]),
            )
            .when(x["has_refs"] | (x["around"] != ""), around)
            .otherwise(""),
        )
        other = F.concat(
            x["path"],
            F.lit(" Refer to the context below to locate where this image appears in the document."),
            F.when(x["around"] != "", around).otherwise(""),
        )
        text = F.when(x["normal"], normal).otherwise(other)
        if repeat_surround:
            return F.concat(text, around)
        return bind(
            text, lambda t: F.when((F.length(t) < 500) & ~t.contains(head), F.concat(t, around)).otherwise(t)
        )

    return bind(parts, join)


def select_prompt_context(classification, caption, caption_references, surround) -> Column:
    """``normal`` images with references: caption and first reference if that one is exact,
    else nothing; other images: the surrounding text. Captions nobody refers to do not count."""
    referred = F.filter(_c(caption_references), lambda c: F.size(c["references"]) > 0)
    first = F.get(F.get(referred, F.lit(0))["references"], F.lit(0))
    has_refs = F.coalesce(F.size(referred), F.lit(0)) > 0
    return (
        F.when(
            (_c(classification) == "normal") & has_refs,
            F.when(
                F.coalesce(first["is_exact_match"], F.lit(False)),
                F.concat(
                    F.lit("Context Information:\nCaption: "),
                    F.coalesce(_c(caption), F.lit("")),
                    F.lit("\nReference Text: "),
                    F.coalesce(first["reference_paragraph"], F.lit("")),
                    F.lit("\n\n"),
                ),
            ).otherwise(""),
        )
        .when(
            _c(classification).isNotNull(),
            F.concat(
                F.lit("Context Information:\nSurrounding Text: "), F.coalesce(_c(surround), F.lit("")), F.lit("\n\n")
            ),
        )
        .otherwise("")
    )


def options_json(options) -> Column:
    """Options in the spelling {"A": "x", "B": "y"}."""
    quoted = F.transform(
        F.map_entries(_c(options)),
        lambda e: F.concat(_quote(e["key"]), F.lit(": "), _quote(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ", "), F.lit("}"))


def _quote(c: Column) -> Column:
    q = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    q = F.replace(F.replace(q, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), q, F.lit('"'))


def build_prompt(group, background, analysis, question, options) -> Column:
    """Evaluation prompt of one ablation group; empty parts are left out."""
    g = _c(group)
    bg, an = _c(background), _c(analysis)
    gap = "\n\n\n"

    def part(name, value, groups):
        return F.when(g.isin(*groups) & (F.coalesce(value, F.lit("")) != ""), F.concat(F.lit(f"{name}: "), value, F.lit(gap)))

    letters = F.array_join(F.map_keys(_c(options)), ", ")
    given = F.when(g == "no_context", F.lit("Based on the image,")).otherwise(
        F.lit("Based on the image and the provided information,")
    )
    ask = F.concat(
        given,
        F.lit(" select the correct option. Output ONLY the single letter corresponding to your choice ("),
        letters,
        F.lit(") with no additional text, explanations, or formatting. For example, if the answer is 'A', you must only output: A."),
    )
    return F.concat_ws(
        "\n\n",
        part("image_background", bg, ("image_background_only", "both_contexts")),
        part("analysis_information", an, ("analysis_information_only", "both_contexts")),
        F.concat(F.lit("question: "), _c(question), F.lit(gap)),
        F.concat(F.lit("options: "), options_json(options), F.lit(gap)),
        ask,
    )


def default_fields(*names) -> list[Column]:
    """Missing context fields read "None"."""
    return [F.coalesce(F.col(n), F.lit("None")).alias(n) for n in names]


def fill_template(template: str, **parts) -> Column:
    """A caller's prompt text with its ``{name}`` places filled from columns; missing values
    leave their place empty. Screening, classification and other prompts are given this way."""
    pieces = re.split(r"\{(\w+)\}", template)
    out = [F.lit(pieces[0])]
    for name, rest in zip(pieces[1::2], pieces[2::2]):
        if name in parts:
            out.append(F.coalesce(_c(parts[name]).cast("string"), F.lit("")))
        else:
            out.append(F.lit("{" + name + "}"))
        out.append(F.lit(rest))
    return F.concat(*out)
