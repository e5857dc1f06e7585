"""Keyword search, chunks and context in free text, as column expressions over arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A letter, digit or underscore of any script; java's own classes are ASCII-only unless told otherwise.
_INSIDE = r"[\p{L}\p{N}_]"


def _escaped(keyword: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", keyword)


def word_pattern(keyword: str) -> str:
    return rf"(?iu)(?<!{_INSIDE}){_escaped(keyword)}(?!{_INSIDE})"


def keywords(text: Column, words: Sequence[str], mode: str = "word") -> Column:
    """The keywords found, in list order. Modes: word (whole words), substring, delimited (between non-words or ends)."""
    tests = {
        "word": lambda k: text.rlike(word_pattern(k)),
        "substring": lambda k: F.contains(F.lower(text), F.lit(k.lower())),
        "delimited": lambda k: text.rlike(rf"(?iuU)(?:^|\W){_escaped(k)}(?:$|\W)"),
    }
    found = F.array_compact(F.array(*[F.when(tests[mode](k), F.lit(k)) for k in words]))
    return F.when(text.isNotNull(), found)


def require_all(text: Column, groups: Sequence[Sequence[str]], mode: str = "word") -> Column:
    """True where every group has a keyword in the text."""
    out = F.lit(True)
    for group in groups:
        out = out & (F.size(keywords(text, group, mode)) > 0)
    return F.coalesce(out, F.lit(False))


#: Names of months and their short forms, ordinal endings.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]
ORDINALS = ["st", "nd", "rd", "th"]
#: What stands between words, by kind: a mark that can part numbers, a mark behind blanks, a gap that may stand beside a month, such a gap before a short year.
_GAPS = {"-": r"[-/.]\s*", "=": r"\s+[-/.]\s*", "_": r"\s+|,\s*", "'": r"(?:\s+|[-/.,]\s*)'"}
#: Dates as runs of kinds. 1: one digit, 2: two digits, 4: three or four, o: an ordinal, m: a month.
_DATES = ["[124][-=][12][-=][24]", "m[-_][124o]", "m'[24]", "[12o][-_]m"]


def contains_date(text: Column) -> Column:
    """Three numbers with marks between them, or a month by name beside a day or a year; numbers between blanks only are no date.

    The text is cut into words and what stands between them, each becomes a letter for its kind, and dates are looked for in the
    letters. A text without a digit has none; a null text has none.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit(rf"({_INSIDE}+|[^\p{{L}}\p{{N}}_]+)"))
    kind = lambda p: (
        F.when(p.isin(MONTHS), "m").when(p.rlike("^[0-9]$"), "1").when(p.rlike("^[0-9]{2}$"), "2").when(p.rlike("^[0-9]{3,4}$"), "4").when(p.rlike(f"^[0-9]{{1,2}}(?:{'|'.join(ORDINALS)})$"), "o")
    )
    gap = lambda k, p: k.when(p.rlike(rf"(?U)^(?:{_GAPS['-']})$"), "-").when(p.rlike(rf"(?U)^(?:{_GAPS['=']})$"), "=").when(p.rlike(rf"(?U)^(?:{_GAPS['_']})$"), "_").when(p.rlike(rf"(?U)^(?:{_GAPS[chr(39)]})$"), "'")
    letters = F.array_join(F.transform(pieces, lambda p: gap(kind(p), p).otherwise("x")), "")
    return F.when(text.rlike("[0-9]"), letters.rlike("|".join(_DATES))).otherwise(F.lit(False))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once for each row: Spark would put an expression that is named once into a lambda, and work it out for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def word_array(text: Column) -> Column:
    """Words between white space; empty for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunk(df: DataFrame, text: str, size: int = 200, overlap: int = 20) -> DataFrame:
    """One row per chunk of at most ``size`` words; chunk numbers in ``chunk_index``, text in ``chunk``."""
    step = size - overlap
    n = F.size("_words")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s: F.array_join(F.slice("_words", s + 1, F.lit(size)), " "))
    return held(df, "_words", word_array(F.col(text))).where(n > 0).select(*df.columns, F.posexplode(cut).alias("chunk_index", "chunk"))


def _pieces(body: Column, size: int, separators: Sequence[str]) -> Column:
    """The text cut at the first separator, and what is still longer than ``size`` words at the next ones; behind the last, single words."""
    if not separators:
        return F.when(F.size(word_array(body)) <= size, F.array(body)).otherwise(word_array(body))
    cut = F.flatten(F.transform(F.split(body, f"\\Q{separators[0]}\\E"), lambda p: _pieces(p, size, separators[1:])))
    return F.when(F.size(word_array(body)) <= size, F.array(body)).otherwise(cut)


def split_chunks(df: DataFrame, text: str, size: int = 200, overlap: int = 20, separators: Sequence[str] = ("\n\n", "\n", " ")) -> DataFrame:
    """Separator-aware chunks: pieces at the coarsest separator that makes them small enough, packed up to ``size`` words.

    A chunk begins with the last ``overlap`` words of the one before where they and the next piece fit. One fold over the pieces of a text:
    it holds the chunks so far, the open one and its number of words. Null and blank texts have no chunk.
    """
    trimmed = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    pieces = F.filter(F.transform(_pieces(F.col(text), size, separators), lambda p: F.struct(trimmed(p).alias("p"), F.size(word_array(p)).alias("n"))), lambda x: x["n"] > 0)
    state = lambda out, now, n: F.struct(out.alias("out"), now.alias("now"), n.cast("int").alias("n"))
    none = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))

    def put(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & (s["n"] + x["n"] > size)
        kept = F.when(s["n"] + x["n"] > size, F.slice(word_array(s["now"]), -F.least(F.lit(overlap), s["n"]), F.lit(overlap))) if overlap else F.array().cast("array<string>")
        kept = F.when(F.size(kept) + x["n"] <= size, kept).otherwise(F.array().cast("array<string>"))
        lead = F.when(full, F.array_join(kept, " ")).otherwise(s["now"])
        n = F.when(full, F.size(kept)).otherwise(s["n"])
        return state(F.when(full, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]), F.when(lead == "", x["p"]).otherwise(F.concat(lead, F.lit(" "), x["p"])), n + x["n"])

    done = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"])
    return df.select(*df.columns, F.posexplode(F.aggregate(pieces, none, put, done)).alias("chunk_index", "chunk"))


def keyword_in_context(df: DataFrame, text: str, keyword: str, around: int = 200) -> DataFrame:
    """One row for each hit of a keyword of one or more words: the place of its first word and the words around it.

    The words of a phrase are looked for one by one and their places shifted onto the first; where all meet, the phrase is. White
    space between its words may be of any kind.
    """
    span = len(keyword.split())
    out = held(df, "_words", word_array(F.col(text))).where(F.size("_words") > 0).select(*df.columns, "_words", F.explode(phrase_places("_words", keyword)).alias("hit"))
    low = F.greatest(F.col("hit") - around, F.lit(0))
    return out.withColumn("context", F.array_join(F.slice("_words", low + 1, F.col("hit") - low + around + span), " ")).drop("_words")


def phrase_places(words: str, phrase: str) -> Column:
    """Places (from 0) in an array of words at which the phrase begins, in order; at its ends other signs may touch it."""
    parts = phrase.split()

    def places(i: int) -> Column:
        left = rf"(?<!{_INSIDE})" if i == 0 else "^"
        right = rf"(?!{_INSIDE})" if i == len(parts) - 1 else "$"
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.get(words, k).rlike(f"(?iu){left}{_escaped(parts[i])}{right}"))
        return F.transform(at, lambda k: k - i)

    return reduce(F.array_intersect, map(places, range(len(parts))))


def phrases_in_context(df: DataFrame, text: str, phrases: Sequence[str], around: int = 200) -> DataFrame:
    """One row for each stretch of text around hits of any phrase: ``start`` and ``end`` (words, from 0), ``found`` and ``context``.

    The windows of hits that overlap or touch are one stretch. ``found`` has the phrases in list order.
    """

    def windows(i: int) -> Column:
        span = len(phrases[i].split())
        return F.transform(phrase_places("_words", phrases[i]), lambda k: F.struct(F.greatest(k - around, F.lit(0)).alias("a"), F.least(k + span + around, F.size("_words")).alias("b"), F.lit(i).alias("i")))

    hits = F.concat(*map(windows, range(len(phrases))))
    one = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array(x["i"]).alias("i"))
    state = "struct<done:array<struct<a:int,b:int,i:array<int>>>,now:struct<a:int,b:int,i:array<int>>>"
    joined = lambda now, x: F.struct(now["a"].alias("a"), F.greatest(now["b"], x["b"]).alias("b"), F.array_union(now["i"], F.array(x["i"])).alias("i"))
    put = lambda s, x: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), one(x).alias("now"))).when(
        x["a"] <= s["now"]["b"], F.struct(s["done"].alias("done"), joined(s["now"], x).alias("now"))
    ).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), one(x).alias("now"))).cast(state)
    none = F.struct(F.array().alias("done"), F.lit(None).alias("now")).cast(state)
    stretches = F.aggregate(F.array_sort(hits), none, put, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    out = held(df, "_words", word_array(F.col(text))).where(F.size("_words") > 0).select(*df.columns, "_words", F.explode(stretches).alias("_s"))
    named = F.transform(F.array_sort("_s.i"), lambda i: F.get(F.array(*map(F.lit, phrases)), i))
    return out.select(*df.columns, F.col("_s.a").alias("start"), F.col("_s.b").alias("end"), named.alias("found"), F.array_join(F.slice("_words", F.col("_s.a") + 1, F.col("_s.b") - F.col("_s.a")), " ").alias("context"))


def normal_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_|_$", "")


def strip_control(text: Column) -> Column:
    """Control characters that spreadsheets refuse, removed; white space trimmed."""
    return F.trim(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))


def parse_answer(text: Column, kind: str) -> Column:
    """A model's answer: ``date`` takes the last eight digits in a row, ``number`` the first integer or F, ``choice`` a
    capital letter that stands alone or before ``.``, ``)`` or ``:``, else the last one between other signs."""
    body = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    if kind == "date":
        return F.nullif(F.regexp_extract(body, r"(?s).*(?<!\d)(\d{8})(?!\d)", 1), F.lit(""))
    if kind == "number":
        return F.coalesce(F.nullif(F.regexp_extract(body, r"(\d+)", 1), F.lit("")), F.when(body.rlike(r"\bF\b"), "F"))
    marked = F.regexp_extract(body, r"(?:^|[^A-Za-z])([A-Z])(?:[.):]|\s*$)", 1)
    loose = F.regexp_extract(body, r"(?s).*(?:^|[^A-Za-z])([A-Z])(?:[^A-Za-z]|$)", 1)
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(loose, F.lit("")))


def choice_key(answer: Column, choices: dict[str, str]) -> Column:
    """The key of an answer: a key itself (in any case, signs around it), or the text of a choice; null for anything else.

    A text that several choices have gets the first of them.
    """
    body = F.lower(F.trim(answer))
    bare = F.regexp_replace(body, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    keyed = [F.when(bare == k.lower(), F.lit(k)) for k in choices]
    marked = [F.when(body.rlike(rf"^\W*{_escaped(k.lower())}\W+{_escaped(t.lower())}\W*$"), F.lit(k)) for k, t in choices.items()]
    said = [F.when(bare == re.sub(r"^\W+|\W+$", "", t.lower()), F.lit(k)) for k, t in choices.items()]
    return F.coalesce(*keyed, *marked, *said)


def normal_number(text: Column) -> Column:
    """'14.0' and '14' alike as '14'; anything else as it is."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(text)


def option_text(options: Column, letter: Column) -> Column:
    """The description behind a letter in a line such as 'A. Yes, B. No'."""
    parts = F.split(options, r",\s*(?=[A-Z]\.\s)")
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*([A-Z])\.", 1), F.trim(F.regexp_replace(p, r"^\s*[A-Z]\.\s*", ""))))
    return F.try_element_at(F.map_from_entries(pairs), letter)
