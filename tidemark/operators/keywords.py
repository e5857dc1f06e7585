"""Keywords of a table found in texts by equality joins, so the plan does not depend on how many there are.

A text is folded to its different words (or, for substrings, its different strings of three characters), a keyword to those of its own.
Each keyword is filed under the one of them that fewest texts hold, joined on it, and what the join finds is verified in the text.
Keywords that are one word or one such string need no second look. Equal texts are searched once.

The different texts and the keywords as they are filed are written and read again: Spark knows then how few keywords there are, and sends
them to the texts instead of moving every word of every text. So the function runs jobs when it is called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import _INSIDE
from tidemark.sources.tables import written

GRAM = 3
#: Bits of a character in the number of a gram; characters count from 1, so grams of different lengths differ.
_BITS = 21


def _words(c: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({_INSIDE}+)"))), F.lower))


def _gram_numbers(text: str, short: bool) -> np.ndarray:
    """The different strings of three characters as numbers, and with ``short`` those of one and two; a text of one or two characters holds itself anyway."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    out, grams = [], c
    for n in range(1, min(GRAM, len(c)) + 1):
        if n > 1:
            grams = grams[:-1] << _BITS | c[n - 1 :]
        if n == GRAM or short or n == len(c):
            out.append(np.unique(grams))
    return np.concatenate(out) if out else c


def _grams(short: bool):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def grams(low: pa.Array) -> pa.Array:
        found = [_gram_numbers(x, short) for x in low.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))

    return grams


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _inside(low: pa.Array, parts: pa.Array) -> pa.Array:
    """Which of a text's strings (numbered from 0) are in it."""
    return pa.array([[i for i, x in enumerate(xs) if x in t] for t, xs in zip(low.to_pylist(), parts.to_pylist())], pa.list_(pa.int32()))


def keyword_table_hits(df: DataFrame, text: str, dim: DataFrame, keyword: str, mode: str = "word", out: str = "found") -> DataFrame:
    """``df`` with the array ``out`` of the keywords found in the text, in rising order; null for a null text, empty where none is found.

    ``mode`` "word" wants whole words (a keyword may have several, with just the signs between them that it names), "substring" any place; letter case
    does not count: lower-cased, the text holds the keyword. Null and blank keywords and those without a letter or digit in word mode are never found;
    repeated ones are one.
    """
    body, key, low, held, there_is = "_kw_text", "_kw_key", "_kw_low", "_kw_held", "_kw_there"
    words = dim.select(F.col(keyword).alias("keyword")).where(F.trim("keyword") != "").distinct().withColumn("low", F.lower("keyword"))
    marked = df.withColumns({key: F.unhex(F.sha2(F.col(text).cast("binary"), 256)), there_is: F.col(text).isNotNull()})
    texts = marked.where(there_is).groupBy(key).agg(F.first(text).alias(body))  # equal keys have equal texts
    if mode == "word":
        texts = written(texts.select("*", F.lower(body).alias(low), _words(F.col(body)).alias(held)), "keyword-texts")
        grams = F.col(held)
        own, alone = _words(F.col("keyword")), F.col("keyword").rlike(f"^{_INSIDE}+$")
        quoted = lambda k: F.regexp_replace(k, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        there = lambda k: F.regexp_like(body, F.concat(F.lit(f"(?iu)(?<!{_INSIDE})"), quoted(k), F.lit(f"(?!{_INSIDE})")))
    elif mode == "substring":
        texts = written(texts.select(key, F.lower(body).alias(low)), "keyword-texts")
        grams = _grams(words.where(F.length("low") < GRAM).limit(1).count() > 0)(low)
        own, alone = _grams(False)("low"), F.length("low") <= GRAM
        there = None
    else:
        raise ValueError(f"unknown mode {mode}")
    filed = written(words.select("keyword", "low", alone.alias("alone"), F.explode(own).alias("gram")), "keyword-grams")
    seen = texts.select(F.explode(grams).alias("gram")).join(filed.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a keyword with a string that no text holds is in no text
    rarest = filed.join(seen, "gram", "left").groupBy("keyword", "low", "alone").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").drop("n")
    near = texts.select(key, F.explode(grams).alias("gram")).join(written(rarest, "keywords"), "gram")
    asked = near.groupBy(key).agg(F.collect_list(F.when(F.col("alone"), F.col("keyword"))).alias("sure"), F.collect_list(F.when(~F.col("alone"), F.struct("keyword", "low"))).alias("asked"))
    in_text = asked.join(texts, key).withColumn("places", _inside(low, F.col("asked.low")))
    checked = F.transform("places", lambda i: F.get("asked.keyword", i))
    lists = in_text.select(key, F.array_sort(F.concat("sure", F.filter(checked, there) if there else checked)).alias(out))
    found = F.when(F.col(there_is), F.coalesce(out, F.array().cast("array<string>"))).alias(out)
    return marked.join(lists, key, "left").select(*df.columns, found)
