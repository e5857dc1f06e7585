"""Prompts, labels and answers of models as column expressions: templates, hints, label letters, JSON and scores in free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a template that take the keyword, and what is asked of an answer.
PLACES = ("{keyword}", "{abx}")
LETTER_ONLY = "Respond ONLY with a single letter, nothing else."
#: Labels that a sentence may carry and still count as unlabelled.
UNLABELLED = ("Other",)


def first_keyword(found: Column) -> Column:
    """The first of an array of keywords; an empty text without one."""
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def fill_keyword(template: Column, keyword: Column) -> Column:
    out = template
    for place in PLACES:
        out = F.replace(out, F.lit(place), keyword)
    return out


def with_hints(df: DataFrame, prompt: str, keyword: str, hints: DataFrame) -> DataFrame:
    """The hint of a row's keyword, from ``hints`` (keyword, hint), behind the prompt; prompts without one stay."""
    own = hints.select(F.lower("keyword").alias("_keyword"), "hint").dropDuplicates(["_keyword"])
    joined = df.join(own, F.lower(F.col(keyword)) == F.col("_keyword"), "left")
    return joined.withColumn(prompt, F.concat_ws("\n", prompt, "hint")).drop("_keyword", "hint")


def instruction_rows(df: DataFrame, template: Column, keywords: str, chunk: str, answer: str, feature: str, ask: str = LETTER_ONLY) -> DataFrame:
    """Tuning rows (instruction, input, output, feature); without ``ask`` rows for evaluation. Date features are left out by the caller."""
    filled = fill_keyword(template, first_keyword(F.col(keywords)))
    return df.select(
        (F.concat_ws(" ", filled, F.lit(ask)) if ask else filled).alias("instruction"), F.coalesce(F.col(chunk), F.lit("")).alias("input"),
        F.coalesce(F.col(answer).cast("string"), F.lit("")).alias("output"), F.col(feature).alias("feature"),
    )


def label_letter(labels: Column, letters: dict[str, str]) -> Column:
    """The letter of a sentence with exactly one label that has one; null otherwise."""
    pairs = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    return F.when(F.size(labels) == 1, F.try_element_at(pairs, F.get(labels, F.lit(0))))


def is_boundary(labels: Column, allowed: Sequence[str] = UNLABELLED) -> Column:
    """True for a sentence with any label beyond those that count as unlabelled."""
    return F.coalesce(F.size(F.array_except(labels, F.array(*map(F.lit, allowed)))) > 0, F.lit(False))


def json_block(text: Column) -> Column:
    """The fenced JSON of an answer, else what lies between its first and last brace; null without either."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def parsed_json(text: Column, schema: str) -> Column:
    """The JSON of an answer by a schema; null where it is not JSON."""
    return F.from_json(json_block(text), schema)


def importance(text: Column) -> Column:
    """The number behind 'important(ce) [score]:', else behind 'score:', else 0."""
    find = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    named = find(r"(?i)(?:important|importance)\s*(?:score)?\s*[:=]\s*(\d+)")
    return F.coalesce(F.coalesce(named, find(r"(?i)score\s*[:=]\s*(\d+)")).try_cast("int"), F.lit(0))


def binary_rows(df: DataFrame, text: str, features: Sequence[str]) -> DataFrame:
    """One row (context, label, category) for every feature column that isn't null."""
    long = df.select(F.col(text).alias("context"), *[F.col(c).cast("int").alias(c) for c in features]).unpivot("context", list(features), "category", "label")
    return long.where("label is not null").select("context", "label", "category")


def as_labelled_chunks(df: DataFrame, context: str, label: str, category: str) -> DataFrame:
    """Rows of another data set in the form of labelled chunks: (chunk, found_keywords, val_unified, feature)."""
    return df.select(F.col(context).alias("chunk"), F.array(F.col(category)).alias("found_keywords"), F.col(label).cast("string").alias("val_unified"), F.col(category).alias("feature"))
