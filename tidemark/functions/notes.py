"""Notes cut into sections and sentences: each line gets a kind by the first rule that fits, and neighbouring kinds decide what belongs together.

All of it is array functions over the lines of one note, so nothing is shuffled and every step takes one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import held

#: Words of a title that need no capital, and a title that is none.
SMALL_WORDS, NO_TITLES = ["of", "on", "or"], ["Disp:"]
_BREAK = "\u0001"


def is_title(line: Column, small: Sequence[str] = SMALL_WORDS, never: Sequence[str] = NO_TITLES) -> Column:
    """A line that ends with a colon and in which all words but small ones and what stands in brackets begin with a capital."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(line, r":$", ""), r"\([^)]*\)", ""), r"\s+"), lambda w: w != "")
    return F.endswith(line, F.lit(":")) & ~line.isin(*never) & F.forall(words, lambda w: w.isin(*small) | w.rlike(r"^\p{Lu}"))


def line_kind(line: Column) -> Column:
    """blank, rule (dashes or underscores), item (a number and a dot), title, inline (a title with text behind it) or text, of a trimmed line."""
    head = F.regexp_extract(line, r"^(\p{Lu}[^:]*:)\s", 1)
    return (
        F.when(line == "", "blank").when(line.rlike(r"^(?:-{3,}|_{3,})$"), "rule").when(line.rlike(r"^[0-9]+\."), "item").when(is_title(line), "title")
        .when((head != "") & is_title(head), "inline").otherwise("text")
    )


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def sections(df: DataFrame, text: str) -> DataFrame:
    """One row for each section: ``section_index``, ``kind`` and ``section`` (its lines, trimmed).

    A section begins at a title, a line with a title, a numbered item or a rule, behind those (but for items and lines with titles, which go on), and behind
    a blank line. A title and a section of one line that another title or the end follows are one section of kind ``answer``.
    Rules that stand within a line are lines of their own. Null and blank texts have no section.
    """
    spread = F.regexp_replace(F.col(text), r"(-{3,}|_{3,})", "\n$1\n")
    lines = F.transform(F.split(spread, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    step = held(df.where(F.col(text).isNotNull()), "_lines", lines)
    step = held(step, "_kinds", F.transform("_lines", line_kind))
    begins = lambda i: (_at("_kinds", i) != "blank") & (
        _at("_kinds", i).isin("title", "inline", "item", "rule") | (i == 0) | F.coalesce(_at("_kinds", i - 1).isin("blank", "rule", "title"), F.lit(True))
    )
    step = held(step, "_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), begins)).where(F.size("_starts") > 0)
    part = lambda s, k: F.struct(
        _at("_kinds", s).alias("kind"),
        F.filter(F.slice(F.col("_lines"), s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - s), lambda x: x != "").alias("lines"),
    )
    step = held(step, "_parts", F.transform("_starts", part))
    kind = lambda k: _at("_parts", k)["kind"]
    answers = lambda k: (
        (k > 0) & F.coalesce(kind(k - 1) == "title", F.lit(False)) & kind(k).isin("text", "item") & (F.size(_at("_parts", k)["lines"]) == 1)
        & F.coalesce(kind(k + 1).isin("title", "inline"), F.lit(True))
    )
    step = held(step, "_answers", F.transform(F.sequence(F.lit(0), F.size("_parts") - 1), answers))
    heads = F.filter(F.sequence(F.lit(0), F.size("_parts") - 1), lambda k: ~_at("_answers", k))
    answered = lambda k: F.coalesce(_at("_answers", k + 1), F.lit(False))
    whole = lambda k: F.struct(
        F.when(answered(k), "answer").otherwise(kind(k)).alias("kind"),
        F.array_join(F.when(answered(k), F.concat(_at("_parts", k)["lines"], _at("_parts", k + 1)["lines"])).otherwise(_at("_parts", k)["lines"]), "\n").alias("section"),
    )
    out = step.select(*df.columns, F.posexplode(F.transform(heads, whole)).alias("section_index", "_s"))
    return out.select(*df.columns, "section_index", F.col("_s.kind").alias("kind"), F.col("_s.section").alias("section"))


def sentences(df: DataFrame, text: str) -> DataFrame:
    """One row for each sentence of :func:`sections`: prose is cut behind ., ! and ? where white space and a capital or a digit follow; other sections stay whole."""
    cut = F.split(F.regexp_replace("section", r"([.!?])\s+([\p{Lu}\p{Nd}])", f"$1{_BREAK}$2"), _BREAK)
    parts = F.when(F.col("kind") == "text", cut).otherwise(F.array("section"))
    return sections(df, text).select(*df.columns, "section_index", "kind", F.posexplode(parts).alias("part_index", "sentence"))
