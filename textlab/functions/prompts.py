"""Prompt building as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import verbalize_label

# Placeholders and the few-shot example layout
# (number, text, label id, label name).
TEXT_SLOT = "{text}"
EXAMPLES_SLOT = "{examples}"
EXAMPLE_TEMPLATE = "\nExemplo %d:\nTexto: %s\nClasse: %s (%s)\n"

# The instruction template of the prompt-tuning baseline.
INSTRUCTION_TEMPLATE = ("[INST] Determine if the following text contains hate speech. "
                        "Respond strictly with 'Yes' if it DOES contain hate speech, or 'No' if it DOES NOT. "
                        "Output only the single word 'Yes' or 'No'. [/INST]\n\nText: {text}")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def format_prompt_zero(template: str, text_col) -> Column:
    """``{text}`` replaced first, then every ``{examples}`` removed (also inside the text)."""
    c = F.replace(F.lit(template), F.lit(TEXT_SLOT), F.coalesce(_c(text_col), F.lit("")))
    return F.replace(c, F.lit(EXAMPLES_SLOT), F.lit(""))


def examples_block(examples: DataFrame, names: Sequence[str] | None = None,
                   order: Sequence[str] = ("label", "shot")) -> DataFrame:
    """One-row frame ``examples string``: numbered example blocks in label, shot order.

    ``examples`` holds the sampled shots (``label``, ``shot``, ``text``): at most
    shots x classes rows, so the single collect_list is bounded by the caller's n.
    """
    name = F.col("label").cast("string")
    if names:
        m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
        name = F.coalesce(F.element_at(m, F.col("label")), name)
    rows = examples.select(*order, F.coalesce(F.col("text"), F.lit("")).alias("text"),
                           F.col("label").cast("string").alias("lab"), name.alias("lname"))
    agg = rows.agg(F.sort_array(F.collect_list(F.struct(*order, "text", "lab", "lname"))).alias("ex"))
    numbered = F.transform(
        "ex", lambda e, i: F.format_string(EXAMPLE_TEMPLATE, i + 1, e["text"], e["lab"], e["lname"]))
    return agg.select(F.array_join(numbered, "").alias("examples"))


def attach_examples(df: DataFrame, block: DataFrame, name: str = "examples") -> DataFrame:
    """The same example block on every row: a scalar subquery, computed once,
    no join (the block is one row of at most shots x classes texts)."""
    return df.withColumn(name, block.select(F.col("examples")).scalar())


def format_prompt_few(template: str, text_col, examples_col) -> Column:
    """``{examples}`` replaced first, then ``{text}`` (also inside the examples)."""
    c = F.replace(F.lit(template), F.lit(EXAMPLES_SLOT), _c(examples_col))
    return F.replace(c, F.lit(TEXT_SLOT), F.coalesce(_c(text_col), F.lit("")))


def build_instruction_pairs(df: DataFrame, template: str = INSTRUCTION_TEMPLATE,
                            text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(input_text, target_text): template with the text, verbalised label."""
    return df.withColumns({
        "input_text": F.replace(F.lit(template), F.lit(TEXT_SLOT), F.coalesce(F.col(text_col), F.lit(""))),
        "target_text": verbalize_label(label_col),
    })
