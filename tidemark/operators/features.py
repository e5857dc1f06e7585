"""Feature extraction into long records: one frame per family of features, united by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules, text
from tidemark.functions.dates import days_between

#: Columns of a long feature record; families leave out what they do not have.
RECORD = "entity_id string, feature_name string, keyword string, date timestamp, prediction string, code string, category string"


def record(df: DataFrame, entity: str, name: Column, prediction: Column, **more: Column) -> DataFrame:
    """A frame in the record's columns, missing ones null."""
    from pyspark.sql.types import StructType

    given = {"entity_id": F.col(entity), "feature_name": name, "prediction": prediction} | more
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RECORD).fields])


def coded(facts: DataFrame, entity: str, date: str, code: str, label: str, feature: str) -> DataFrame:
    """Earliest date per (entity, code), then per (entity, label), keeping the code that gave it."""
    per_code = facts.groupBy(entity, label, code).agg(F.min(date).alias(date))
    per_label = per_code.groupBy(entity, label).agg(F.min_by(code, F.struct(date, code)).alias(code), F.min(date).alias(date))
    return record(per_label, entity, F.lit(feature), F.lit("Yes"), keyword=F.col(label), date=F.col(date), code=F.col(code))


def exposures(meds: DataFrame, index: DataFrame, entity: str, date: str, drug: str, classes: DataFrame, feature: str, days: float) -> DataFrame:
    """A record for each exposure in [index, index + days) with its drug class."""
    near = meds.join(index.select(entity, "index_date"), entity)
    gap = days_between(F.col(date), F.col("index_date"))
    named = rules.drug_class(near.where((gap >= 0) & (gap < days)), drug, classes)
    return record(named, entity, F.lit(feature), F.lit("Yes"), keyword=F.col(drug), date=F.col(date), category=F.col("drug_class"))


def options(records: DataFrame, entity: str, option: str, feature: str) -> DataFrame:
    """One record per entity with a non-null option."""
    return record(records.where(F.col(option).isNotNull()), entity, F.lit(feature), F.col(option))


def demographics(dem: DataFrame, entity: str, order: str) -> DataFrame:
    """Sex, race and age of each entity's first row by ``order``."""
    rest = [c for c in dem.columns if c != entity]
    one = dem.groupBy(entity).agg(F.min_by(F.struct(*rest), order).alias("r")).select(entity, "r.*")
    values = F.create_map(F.lit("sex"), rules.sex(F.col("Sex_At_Birth"), F.col("Gender_Legal_Sex")), F.lit("race"), rules.race(F.col("Race_Group"), F.col("Ethnic_Group")), F.lit("age"), F.col("Age").cast("string"))
    long = one.select(entity, F.explode(values).alias("k", "v")).where("v is not null")
    return record(long, entity, F.col("k"), F.col("v"))


def note_chunks(notes: DataFrame, body: str, keywords: Sequence[str], size: int = 200, overlap: int = 20, mode: str = "word") -> DataFrame:
    """Chunks that hold a keyword, with the keywords found; the whole note is filtered before it is cut."""
    hit = notes.where(F.size(text.keywords(F.col(body), keywords, mode)) > 0)
    cut = text.chunk(hit, body, size, overlap)
    return cut.withColumn("found", text.keywords(F.col("chunk"), keywords, mode)).where(F.size("found") > 0)


def best_record(notes: DataFrame, entity: str, body: str, keywords: Sequence[str], order: str) -> DataFrame:
    """Each entity's note with most keyword hits (substring counts), the first of equals; none without a hit."""
    lower = F.lower(F.col(body))
    hits = sum(((F.length(lower) - F.length(F.replace(lower, F.lit(k.lower()), F.lit("")))) / len(k) for k in keywords), F.lit(0.0))
    rest = [c for c in notes.columns if c != entity]
    counted = notes.withColumn("_hits", hits.cast("long")).where("_hits > 0")
    best = counted.groupBy(entity).agg(F.min_by(F.struct(*rest, "_hits"), F.struct(-F.col("_hits"), F.col(order))).alias("r"))
    return best.select(entity, "r.*").withColumnRenamed("_hits", "hits")


def united(*families: DataFrame) -> DataFrame:
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def prevalence(df: DataFrame, feature: str, value: str, valid: DataFrame) -> DataFrame:
    """(feature, option, share) over valid options: zero where unseen, uniform where a feature has no valid value. ``valid`` (feature, option)."""
    counts = df.withColumnRenamed(value, "option").groupBy(feature, "option").agg(F.count("*").alias("n"))
    all_ = valid.join(counts, [feature, "option"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = all_.groupBy(feature).agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    share = F.when(F.col("t") > 0, F.col("n") / F.nullif(F.col("t"), F.lit(0))).otherwise(1.0 / F.col("k"))
    return all_.join(total, feature).select(feature, "option", share.alias("share"))


def summary(records: DataFrame, method: str, feature: str) -> DataFrame:
    """Records, entities and the share of structured rows per feature."""
    return records.groupBy(feature).agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.avg((F.col(method) == "structured").cast("double")).alias("structured_share"))


def last_activity(tables: Sequence[DataFrame], entity: str, date: str, deaths: DataFrame | None = None) -> DataFrame:
    """(entity, last_activity[, death, deceased]): the latest date over all tables, and the earliest death. Tables are reduced before they are united."""
    latest = None
    for t in tables:
        part = t.groupBy(entity).agg(F.max(date).alias("last_activity"))
        latest = part if latest is None else latest.unionByName(part)
    out = latest.groupBy(entity).agg(F.max("last_activity").alias("last_activity"))
    if deaths is None:
        return out
    first = deaths.groupBy(entity).agg(F.min(date).alias("death"))
    return out.join(first, entity, "left").withColumn("deceased", F.col("death").isNotNull())


def activity_records(last: DataFrame, entity: str) -> DataFrame:
    return record(last, entity, F.lit("last_activity"), F.date_format("last_activity", "yyyy-MM-dd"), date=F.col("last_activity"))


def structured_outcomes(facts: DataFrame, index: DataFrame, entity: str, date: str, code: str, dim: DataFrame, days: float) -> DataFrame:
    """Earliest outcome-window record per (entity, label) of codes with a prefix in ``dim`` (prefix, label)."""
    from tidemark.operators.codes import prefix_join

    near = facts.join(index.select(entity, "index_date"), entity).where(days_between(F.col(date), F.col("index_date")) >= days)
    return coded(prefix_join(near, dim, code, "prefix").where("label is not null"), entity, date, code, "label", "outcome")


def outcome_notes(outcomes: DataFrame, notes: DataFrame, entity: str, date: str, body: str, keywords: Sequence[str], order: str, days: float) -> DataFrame:
    """Of each outcome record: the note within ``days`` of its date with most keyword hits."""
    from tidemark.operators.asof import within_days

    cases = outcomes.select(F.col("entity_id").cast(notes.schema[entity].dataType).alias(entity), "keyword", F.col("date").alias("outcome_date"))
    near = within_days(cases, notes, entity, "outcome_date", date, days, days)
    case = near.withColumn("_case", F.struct(entity, "keyword")).drop(entity, "keyword")
    best = best_record(case, "_case", body, keywords, order)
    return best.select("_case.*", *[c for c in best.columns if c != "_case"])


@dataclass(frozen=True)
class Feature:
    """What a feature asks and how its answers are pooled; the registry is a table of these by name."""

    name: str
    query: str
    keywords: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    pooling: tuple[str, tuple] = ("mode", ())
    mode: str = "word"


class Registry:
    """Features by name, with the tables that joins need of them."""

    def __init__(self, features: Sequence[Feature]):
        self.by_name = {f.name: f for f in features}
        if len(self.by_name) != len(features):
            raise ValueError("two features have one name")

    def keywords(self, spark) -> DataFrame:
        """(feature, keyword), a row for each keyword."""
        return spark.createDataFrame([(f.name, k) for f in self.by_name.values() for k in f.keywords], "feature string, keyword string")

    def options(self, spark) -> DataFrame:
        """(feature, option), for :func:`prevalence`."""
        return spark.createDataFrame([(f.name, o) for f in self.by_name.values() for o in f.options], "feature string, option string")

    def pooling_spec(self) -> dict[str, tuple[str, Sequence]]:
        """For :func:`tidemark.operators.pooling.pool`."""
        return {f.name: f.pooling for f in self.by_name.values()}

    def chunk_filter(self, name: str, body: str) -> Column:
        """The predicate that a chunk must pass before it is scored for a feature; without keywords every chunk does."""
        f = self.by_name[name]
        return F.size(text.keywords(F.col(body), f.keywords, f.mode)) > 0 if f.keywords else F.col(body).isNotNull()
