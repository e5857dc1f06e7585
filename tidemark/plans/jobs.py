"""Whole jobs put together from the operators: validation sets, note scoring, evaluation, run analysis, corpora, pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.dates import days_between
from tidemark.operators import cohort, corpus, evalm, features, history, pooling, sampling, scoring
from tidemark.operators.ranks import ranked


def build_cohort(facts: DataFrame, exposure: DataFrame, people: DataFrame, notes: Sequence[DataFrame], key: str, date: str, qualifies: Column, exposed_days: float, coverage_days: float, ages: tuple[float, float], age: str) -> DataFrame:
    """Index dates, arms, age limits [min, max) and note coverage: (key, index_date, exposed, outside_only, people's columns)."""
    index = cohort.index_dates(facts, key, date, qualifies)
    arms = cohort.assign_arms(index, exposure, key, date, exposed_days)
    fit = arms.join(people, key).where((F.col(age) >= ages[0]) & (F.col(age) < ages[1]))
    return cohort.coverage_filter(fit, notes, key, date, coverage_days)


def validation_set(notes: DataFrame, entity: str, note: str, body: str, keywords: Sequence[str], order: Sequence, patients: int) -> DataFrame:
    """One keyword chunk per entity, of the first ``patients`` entities with a hit; ``val_unified`` is left for people to fill in."""
    chunks = features.note_chunks(notes.select(entity, note, body), body, keywords).select(entity, note, "chunk_index", "chunk", "found")
    some = sampling.first_k_keys(chunks, entity, order, patients)
    return sampling.one_per_key(some, entity, order).withColumn("val_unified", F.lit(None).cast("string"))


def score_notes(notes: DataFrame, entity: str, note: str, body: str, keywords: Sequence[str], scorer, positive: str = "Yes") -> DataFrame:
    """(entity, note, chunks, positive): chunks with a keyword are scored, each distinct chunk once; a note is positive if any chunk is."""
    chunks = features.note_chunks(notes.select(entity, note, body), body, keywords).select(entity, note, "chunk")
    scored, _ = scoring.score_with_memo(chunks, None, ["chunk"], scorer, "prediction string")
    return scored.groupBy(entity, note).agg(F.count("*").alias("chunks"), F.bool_or(F.col("prediction") == positive).alias("positive"))


def evaluate(df: DataFrame, by: Sequence[str], gt: str, pred: str, synthetic: str) -> DataFrame:
    """Accuracy combined, natural and synthetic per group in one pass."""
    hit = F.coalesce((F.col(gt) == F.col(pred)).cast("double"), F.lit(0.0))
    return df.where(F.col(gt).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(hit).alias("combined"), F.avg(F.when(~F.col(synthetic), hit)).alias("natural"), F.avg(F.when(F.col(synthetic), hit)).alias("synthetic"))


def run_analysis(runs: DataFrame, method: str, feature: str, order: str, score: str, points: int = 11) -> DataFrame:
    """Mean best-so-far curve of each method: running best per (method, feature), resampled, averaged over features."""
    best = history.running_best(runs, [method, feature], [order], score).select(method, feature, order, "best")
    return history.mean_curve(history.resample(best, [method, feature], order, "best", points), method, "best")


def action_corpus(sentences: DataFrame, spans: DataFrame, doc: str, order: str, header: Column, other: Column) -> DataFrame:
    """Sentences (doc, order, text, start, end) with the types of overlapping spans and whether they lie in an instruction section."""
    labelled = corpus.span_overlap(sentences, spans, doc, [order])
    return corpus.section_state(labelled, doc, order, header, other)


def pooled_wide(records: DataFrame, entity: str, position: str, spec: dict, columns: Sequence[str]) -> DataFrame:
    """Long records pooled by rule, then one row per entity with the given feature columns."""
    long = pooling.pool(records, [entity], "feature_name", "prediction", position, spec)
    return pooling.to_wide(long, entity, "feature_name", "prediction", columns)


def review_by_threshold(df: DataFrame, y: str, score: str, order: Sequence, n: int) -> DataFrame:
    """False negatives and false positives at the threshold of the best F1."""
    cut = evalm.best_threshold(evalm.sweep(df, y, score)).first()["threshold"]
    kinds = [scoring.review_list(df, y, score, cut, k, order, n).withColumn("kind", F.lit(k)) for k in ("false_negative", "false_positive")]
    return kinds[0].unionByName(kinds[1])


def outcome_rates(df: DataFrame, exposed: str, outcome: str) -> DataFrame:
    return df.groupBy(exposed).agg(F.count("*").alias("n"), F.avg(F.col(outcome).cast("double")).alias("rate"))


def keyword_rates(notes: DataFrame, body: str, keywords: Sequence[str], positive: Column) -> DataFrame:
    """Share of texts with a keyword, and of positives among those."""
    hit = F.size(text.keywords(F.col(body), keywords)) > 0
    return notes.agg(F.avg(hit.cast("double")).alias("hit_rate"), F.avg(F.when(hit, positive.cast("double"))).alias("positive_rate"))


def extract(families: Sequence[DataFrame]) -> DataFrame:
    """The records of ready families as one long table."""
    return features.united(*families)


def note_features(notes: DataFrame, index: DataFrame, entity: str, note: str, date: str, body: str, registry: features.Registry, scorer, days: float = 730.0, memo: DataFrame | None = None) -> DataFrame:
    """Records (feature_name, prediction, keyword, date) of every registered feature that has keywords, from notes in [index, index + days).

    Notes are cut to chunks once; a table of (feature, keyword) tells which chunks a feature asks about, so the plan does not depend on how
    many features there are. Each different (query, chunk) is scored once, by ``scorer`` (columns ``query`` and ``chunk`` to ``prediction``).
    """
    from tidemark.operators.keywords import keyword_table_hits

    spark = notes.sparkSession
    near = notes.join(index.select(entity, "index_date"), entity)
    gap = days_between(F.col(date), F.col("index_date"))
    cut = text.chunk(near.where((gap >= 0) & (gap < days)).select(entity, note, date, body), body)
    table = registry.keywords(spark)
    modes = spark.createDataFrame([(f.name, f.mode, f.query) for f in registry.by_name.values()], "feature string, mode string, query string")
    asked = None
    for mode in sorted({f.mode for f in registry.by_name.values() if f.keywords}):
        mine = table.join(modes.where(F.col("mode") == mode), "feature")
        found = keyword_table_hits(cut, "chunk", mine, "keyword", mode).select(entity, note, date, "chunk", F.explode("found").alias("keyword"))
        rows = found.join(mine, "keyword").groupBy(entity, note, date, "chunk", "feature", "query").agg(F.min("keyword").alias("keyword"))
        asked = rows if asked is None else asked.unionByName(rows)
    scored, _ = scoring.score_with_memo(asked, memo, ["query", "chunk"], scorer, "prediction string")
    return features.record(scored, entity, F.col("feature"), F.col("prediction"), keyword=F.col("keyword"), date=F.col(date)).where("prediction is not null")


def extract_features(
    index: DataFrame, entity: str, facts: DataFrame, date: str, code: str, dim: DataFrame, meds: DataFrame, drug: str, classes: DataFrame, people: DataFrame, order: str,
    activity: Sequence[DataFrame], covariates: dict[str, DataFrame], notes: DataFrame | None = None, note: str = "note", body: str = "body", registry: features.Registry | None = None, scorer=None, days: float = 730.0,
) -> DataFrame:
    """Feature extraction as one job: long records of every family for the people of ``index``, with ``method`` (structured or model).

    Families: diagnoses by prefix (earliest date of each label of ``dim``), exposures in [index, index + days) by drug class, demographics, last
    activity over ``activity`` tables, the closest option of each covariate (records with ``option`` up to 90 days behind the index), and, where notes,
    registry and scorer are given, the registered features of notes. Each table is cut to the people of the index before anything else.
    """
    from tidemark.operators.codes import prefix_join

    mine = lambda t: t.join(index.select(entity), entity, "left_semi")
    labelled = prefix_join(mine(facts), dim, code, "prefix").where("label is not null")
    families = [
        features.coded(labelled, entity, date, code, "label", "diagnosis"), features.exposures(mine(meds), index, entity, date, drug, classes, "exposure", days),
        features.demographics(mine(people), entity, order), features.activity_records(features.last_activity([mine(t) for t in activity], entity, date), entity),
        *[features.options(cohort.closest_covariate(mine(t), index, entity, date, "option"), entity, "option", name) for name, t in covariates.items()],
    ]
    out = features.united(*families).withColumn("method", F.lit("structured"))
    if notes is not None and registry is not None:
        out = out.unionByName(note_features(mine(notes), index, entity, note, date, body, registry, scorer, days).withColumn("method", F.lit("model")))
    return out


def study(facts: DataFrame, exposure: DataFrame, people: DataFrame, notes: Sequence[DataFrame], key: str, date: str, qualifies: Column, exposed_days: float, coverage_days: float, ages: tuple[float, float], age: str, exact: Sequence[str], caliper: float = 5.0, covariates: dict[str, DataFrame] | None = None, least: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cohort builder as a whole: (members with arms and covariates, matched pairs, balance of each round).

    ``covariates`` maps a name to records (key, date, option): the option closest to the index becomes a column, which may be one of ``exact``. Rounds go from
    all exact columns down to ``least`` (default: all). With ``path`` members, pairs and counts are written there (``exports.write_cohort``).
    """
    from tidemark.operators import stats
    from tidemark.sources.exports import write_cohort
    from tidemark.sources.tables import written

    members = build_cohort(facts, exposure, people, notes, key, date, qualifies, exposed_days, coverage_days, ages, age).where(~F.col("outside_only"))
    for name, records in (covariates or {}).items():
        closest = cohort.closest_covariate(records, members, key, date, "option").withColumnRenamed("option", name)
        members = members.join(closest, key, "left")
    members = written(members.withColumn("arm", F.col("exposed").cast("int")), "members")
    pairs = written(cohort.match(members.select(key, "arm", *exact, age), key, "arm", exact, age, caliper, least), "pairs")
    if path:
        write_cohort(path, members, pairs, key, "arm", "case", "control")
    return members, pairs, stats.balance_by_round(members, pairs, key, "arm", [age], exact)


def evaluation(df: DataFrame, by: Sequence[str], gt: str, pred: str, synthetic: str, order: Sequence[str], k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy per group, confusion per group, the first ``k`` errors of each group by ``order``)."""
    known = df.where(F.col(gt).isNotNull())
    confusion = known.groupBy(*by, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    wrong = known.where(~F.col(gt).eqNullSafe(F.col(pred)))
    listed = ranked(wrong, by, order, "place").where(F.col("place") <= k)
    return evaluate(df, by, gt, pred, synthetic), confusion, listed


def run_report(runs: DataFrame, name: Sequence[str], stamp: str, method: str, feature: str, order: str, score: str, prompt: str, methods: Sequence[str]) -> dict[str, DataFrame]:
    """Prompt-run analysis: of repeated runs the latest; then the ranking, the score matrix, the consensus, the curve and the prompts' lengths."""
    from tidemark.sources.tables import latest_runs

    latest = latest_runs(runs, name, stamp)
    last = latest.groupBy(method, feature).agg(F.max(score).alias(score))
    return {
        "ranking": history.rank_methods(last, method, score), "matrix": history.score_matrix(last, feature, method, score, methods), "consensus": history.consensus(last, feature, method, score),
        "curve": run_analysis(latest, method, feature, order, score), "lengths": history.prompt_lengths(latest, [method], prompt),
    }


def structured_cases(facts: DataFrame, notes: DataFrame, index: DataFrame, entity: str, date: str, code: str, dim: DataFrame, body: str, keywords: Sequence[str], note: str, scorer, days: float = 730.0, around: float = 91.0) -> DataFrame:
    """Outcome-window cases with the note around each that names most keywords, scored: (entity, keyword, note columns, prediction)."""
    outcomes = features.structured_outcomes(facts, index, entity, date, code, dim, days)
    best = features.outcome_notes(outcomes, notes, entity, "note_date", body, keywords, note, around)
    return scoring.score(best, scorer, "prediction string")
