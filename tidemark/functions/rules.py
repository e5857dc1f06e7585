"""Rules over structured records and short free text: drinking, smoking, body mass, demographics, drug classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers that only say that screening happened or was declined.
NO_CONTENT = [
    "", "done", "done today", "done elsewhere", "done here", "completed", "discussed", "discussed today", "see note", "see note today", "see hpi",
    "deferred", "declined", "patient declined", "pt declined", "refused", "n/a", "na", "unknown", "unk", "?", "-", "+", "reviewed",
]
# Whole answers with a meaning of their own.
WHOLE_ANSWERS = {"low risk": "B", "(-)": "B", "no concerns": "B", "moderate": "A", "soc": "A"}
# Words and phrases that deny drinking.
DENYING_WORDS = r"no|none|never|denies|deny|denied|denying|negative|neg|nondrinker|abstinent|abstains?|abstain|teetotal|sober|zero|nil"
DENYING_PHRASES = [
    "no etoh", "no alcohol", "no abuse", "no issues", "no drink", "no use", "does not drink", "doesn't drink", "doesnt drink", "do not drink",
    "non-drinker", "non drinker", "not currently", "no concern", "no problem",
]
# Words that describe a drinker.
DRINKER_WORDS = (
    r"positive|pos|social|socially|occ\w*|ocas\w*|occas\w*|occasion\w*|rare\w*|seldom|minimal|min|moderate|wine|beer|liquor|vodka|whiskey|"
    r"cocktails?|weekend\w*|weekly|monthly|holidays?|binge|yes|drinker|daily|nightly|couple|few|some|little|infrequent\w*|limited"
)
# Numbers in words, and what ties a number to a cadence.
NUMBER_WORDS = {"once": 1, "twice": 2, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
CADENCE = r"week|wk|/mo|month|\bmo\b|\bday\b|night|year|\byr\b|drink|glass|unit|beer|shot|pack|wine|cocktail|time"


def alcohol_text(answer: Column) -> Column:
    """A (drinks), B (does not) or null for a free-text answer: amounts win over words, denials over descriptions."""
    s = F.btrim(F.regexp_replace(F.lower(F.trim(answer)), r"\s+", " "), F.lit(" ."))
    amounts = F.regexp_replace(s, r"\b\d+\s*/\s*\d+\b", " ")
    for word, n in NUMBER_WORDS.items():
        amounts = F.regexp_replace(amounts, rf"\b{word}\b", str(n))
    top = F.array_max(F.transform(F.regexp_extract_all(amounts, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.try_cast("double")))
    by_amount = F.when(top > 0, "A").otherwise("B")
    denies = s.rlike(rf"\b(?:{DENYING_WORDS})\b")
    for phrase in DENYING_PHRASES:
        denies = denies | F.contains(s, F.lit(phrase))
    describes = F.contains(s, F.lit("positive")) | s.rlike(rf"\b(?:{DRINKER_WORDS})\b")
    out = F.when(s.isin(*NO_CONTENT), None)
    for whole, status in WHOLE_ANSWERS.items():
        out = out.when(s == whole, status)
    return out.when(top.isNotNull() & amounts.rlike(CADENCE), by_amount).when(describes & ~denies, "A").when(denies, "B").when(top.isNotNull(), by_amount)


def alcohol_status(records: DataFrame, by: Sequence[str], concept: str = "Concept_Name", result: str = "Result", drinks: Sequence[str] = (), drinks_not: Sequence[str] = (), quantity: Sequence[str] = (), free_text: str = "") -> DataFrame:
    """(by, option): A where any record shows drinking, else B where any shows none, else null. Concept lists are parameters."""
    c, r = F.col(concept), F.trim(F.coalesce(F.col(result), F.lit("")))
    text = F.when(c == free_text, alcohol_text(r))
    yes = c.isin(*drinks) | (text == "A") | (c.isin(*quantity) & ~r.isin("", "0", "0.0"))
    no = c.isin(*drinks_not) | (text == "B") | (c.isin(*quantity) & r.isin("0", "0.0"))
    any_ = lambda x: F.coalesce(F.bool_or(F.coalesce(x, F.lit(False))), F.lit(False))
    return records.groupBy(*by).agg(F.when(any_(yes), "A").when(any_(no), "B").alias("option"))


def smoking_status(records: DataFrame, by: Sequence[str], concept: str = "Concept_Name", result: str = "Result", never: Sequence[str] = (), former: Sequence[str] = (), current: Sequence[str] = (), answers: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(by, option): C current, else B former, else A never, else null. ``answers`` maps (concept, lower-case result) to an option."""
    c, r = F.col(concept), F.lower(F.trim(F.coalesce(F.col(result), F.lit(""))))
    kind = F.when(c.isin(*current), "C").when(c.isin(*former), "B").when(c.isin(*never), "A")
    for (name, value), option in (answers or {}).items():
        kind = kind.when((c == name) & (r == value), option)
    return records.groupBy(*by).agg(F.max(kind).alias("option"))  # C over B over A


def amount_option(records: DataFrame, by: Sequence[str], scales: dict[str, float], concept: str = "Concept_Name", result: str = "Result", cuts: Sequence[float] = (0, 2, 5)) -> DataFrame:
    """(by, option): the largest amount per week as A, B, C ... by upper bounds; ranges count by their upper end.

    ``scales`` maps a concept to what turns its unit into units per week (drinks 1, ounces 1 / 0.6, packs a day 7).
    """
    r = F.trim(F.col(result))
    number = F.element_at(F.split(r, "-"), -1).try_cast("double")
    weekly = None
    for name, k in scales.items():
        test, value = F.col(concept) == name, number * F.lit(float(k))
        weekly = F.when(test, value) if weekly is None else weekly.when(test, value)
    top = F.max(weekly)
    out = F.when(top == cuts[0], "A")
    for i, cut in enumerate(cuts[1:]):
        out = out.when(top <= cut, chr(66 + i))
    return records.groupBy(*by).agg(out.when(top.isNotNull(), chr(65 + len(cuts))).alias("option"))


def bmi(weight_lb: Column, height_in: Column) -> Column:
    """703 lb / in^2, null outside plausible ranges."""
    fine = weight_lb.between(50, 1000) & height_in.between(36, 90)
    value = F.when(fine, F.lit(703.0) * weight_lb / (height_in * height_in))
    return F.when(value.between(10, 100), value)


def bmi_category(value: Column) -> Column:
    return F.when(value < 18.5, "underweight").when(value < 25, "normal weight").when(value < 30, "overweight").when(value.isNotNull(), "obese")


def age_band(age: Column) -> Column:
    low = (F.floor(age / 10) * 10).cast("int")
    return F.when(age.isNull(), None).when(age < 10, "0-9").when(age >= 100, "100+").otherwise(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")))


def sex(at_birth: Column, legal: Column) -> Column:
    first = F.lower(F.trim(at_birth))
    return F.when(first.isin("male", "female"), first).otherwise(F.lower(F.trim(legal)))


def race(group: Column, ethnic: Column) -> Column:
    return F.when(ethnic == "HISPANIC", "hispanic").otherwise(F.coalesce(F.lower(group), F.lit("")))


def drug_class(df: DataFrame, drug: str, dim: DataFrame) -> DataFrame:
    """Adds ``drug_class`` from ``dim`` (keyword, drug_class, order): exact, else a substring either way in table order, else the drug itself.

    Substrings are matched by equality: every substring of a distinct drug name meets the keywords, and every substring of a
    keyword meets the names.
    """
    parts = lambda c: f"array_distinct(flatten(transform(sequence(1, length({c})), i -> transform(sequence(1, length({c}) - i + 1), n -> substring({c}, i, n)))))"
    names = df.select(F.lower(F.trim(drug)).alias("_d")).where("length(_d) > 0").distinct()
    table = dim.select(F.lower("keyword").alias("_k"), "drug_class", "order").where("length(_k) > 0")
    exact = names.join(table, F.col("_d") == F.col("_k")).groupBy("_d").agg(F.min_by("drug_class", "order").alias("_exact"))
    holds = names.selectExpr("_d", f"explode({parts('_d')}) AS _k").join(table, "_k")
    held = table.selectExpr(f"explode({parts('_k')}) AS _d", "drug_class", "order").join(names, "_d")
    near = holds.select("_d", "drug_class", "order").union(held.select("_d", "drug_class", "order")).groupBy("_d").agg(F.min_by("drug_class", "order").alias("_near"))
    out = df.withColumn("_d", F.lower(F.trim(drug))).join(exact, "_d", "left").join(near, "_d", "left")
    return out.withColumn("drug_class", F.coalesce("_exact", "_near", drug)).drop("_d", "_exact", "_near")
