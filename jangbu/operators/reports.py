"""Aggregations of scores into reports, gates and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest items a cell needs to be reliable.
RELIABLE = 5


def cells(scored: DataFrame, axis: str, score: str) -> DataFrame:
    """Per value of an axis (null as "None"): items, mean score, points an item is worth, whether there are enough."""
    n = F.count("*")
    return scored.groupBy(F.coalesce(F.col(axis).cast("string"), F.lit("None")).alias("axis")).agg(n.alias("n"), F.round(F.avg(score), 4).alias("mean_score"), F.round(100 / n, 4).alias("points_per_item"), (n >= RELIABLE).alias("reliable"))


def weighted_mean(scored: DataFrame, weights: DataFrame, tag: str, score: str) -> DataFrame:
    """One row: mean score weighted by tag; items without tag or weight do not count; null if nothing does."""
    j = scored.where(F.col(tag).isNotNull()).join(F.broadcast(weights), tag).where("weight > 0")
    return j.agg(F.round(F.sum(F.col(score) * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), 6).alias("weighted_mean"), F.count("*").alias("n"))


def gates(cell_report: DataFrame, least: DataFrame) -> DataFrame:
    """Per axis value of ``least`` (``axis, least``): pass, FAIL, or no_items."""
    j = F.broadcast(least).join(cell_report, "axis", "left")
    return j.select("axis", "least", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), "no_items").when(F.col("mean_score") >= F.col("least"), "pass").otherwise("FAIL").alias("gate"))


def rates(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """One row: count of each kind and its rate over all rows (over 1 if there are none)."""
    n = F.count("*")
    out = [n.alias("n")]
    for name, cond in kinds.items():
        out += [F.count_if(cond).alias(f"n_{name}"), F.round(F.count_if(cond) / F.greatest(n, F.lit(1)), 6).alias(f"rate_{name}")]
    return rows.agg(*out)


def confusion(audit: DataFrame, by: str, gold: str, predicted: str) -> DataFrame:
    """Per column, gold state and predicted state, the number of cells."""
    return audit.groupBy(by, gold, predicted).agg(F.count("*").alias("n"))


def variance(runs: DataFrame, metric: str, value: str) -> DataFrame:
    """Per metric with two runs or more: mean, population deviation, range."""
    n = F.count(value)
    g = runs.groupBy(metric).agg(n.alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"), F.round(F.max(value) - F.min(value), 6).alias("spread"))
    return g.where("n >= 2")


def regression(baseline: DataFrame, current: DataFrame, spread: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """``metric, delta, verdict``: ``alarm`` where a metric fell by ``sigmas`` deviations or more, ``skipped`` where the deviation is unknown; metrics on one side only are left out."""
    j = baseline.withColumnRenamed("value", "old").join(current.withColumnRenamed("value", "new"), "metric").join(spread.select("metric", "sd"), "metric", "left")
    delta = F.round(F.col("new") - F.col("old"), 6)
    return j.select("metric", delta.alias("delta"), F.when(F.col("sd").isNull(), "skipped").when(delta <= -sigmas * F.col("sd"), "alarm").otherwise("ok").alias("verdict"))


def nearest_rank(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the values at ranks ``int(n * share)`` (0-based, the last one at most), not interpolated.

    Ranks come from running counts over the distinct values, so that a group
    with very many rows is ranked by its few distinct values.
    """
    from pyspark.sql.window import Window

    hist = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    hist = hist.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    rank = lambda share: F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    at = [F.min(F.when(F.col("upto") > rank(s), F.col(value))).alias(name) for name, s in shares.items()]
    return hist.groupBy(*by).agg(F.first("n").alias("n"), *at)


def flatten(report: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A wide report as ``keys, metric, value`` rows."""
    return report.unpivot(keys, metrics, "metric", "value")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def single_valued(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys for which one of ``values`` is not single, with the number of distinct values each."""
    g = rows.groupBy(key).agg(*(F.countDistinct(v).alias(f"n_{v}") for v in values))
    bad = F.lit(False)
    for v in values:
        bad = bad | (F.col(f"n_{v}") > 1)
    return g.where(bad)


def integrated(cell_report: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: mean of group means (``axis, mean_score``) weighted by ``axis, weight``; groups without weight, and weights without group, do not count; null if nothing does."""
    j = cell_report.join(F.broadcast(weights), "axis").where("weight > 0")
    return j.agg(F.round(F.sum(F.col("mean_score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), 4).alias("integrated"), F.count("*").alias("n_groups"))


def format_report(scored: DataFrame) -> DataFrame:
    """``final_status, n, format_failure_rate``: items per status, and the share of all that fail by their form."""
    h = scored.groupBy("final_status").agg(F.count("*").alias("n"))
    all_ = scored.agg(F.round(F.count_if(F.col("final_status").startswith("FAIL-format")) / F.greatest(F.count("*"), F.lit(1)), 4).alias("format_failure_rate"))
    return h.join(F.broadcast(all_), F.lit(True))  # one row


def zero_split(scored: DataFrame) -> DataFrame:
    """One row: items, zeros of failed runs, zeros of content, and the rate of failed runs; failed runs stay in the denominator."""
    failed = F.coalesce((F.col("final_status") == "FAIL-system") | (F.trim("failure") != ""), F.lit(False))
    n = F.count("*")
    return scored.agg(n.alias("n_items"), F.count_if(failed).alias("system_zero"), F.count_if(~failed & (F.col("score") == 0)).alias("content_zero"), F.round(F.count_if(failed) / F.greatest(n, F.lit(1)), 6).alias("system_rate"))


def stages(graded: DataFrame) -> DataFrame:
    """Per ``stage`` of graded retrievals (``stage, k, recall, precision, mrr, found_all, failure_kind``): means, share with everything found, counts of failures; per cut-off too."""
    return graded.groupBy("stage", "k").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("precision"), 4).alias("precision"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg(F.col("found_all").cast("double")), 4).alias("recall_all_rate"),
        F.count_if(F.col("failure_kind") == "recall_failure").alias("n_recall_failure"), F.count_if(F.col("failure_kind") == "rank_failure").alias("n_rank_failure"),
    )


def circularity(score: DataFrame, accuracy: DataFrame, sources: DataFrame, gap: float = 0.15) -> DataFrame:
    """One row: whether a selection score far above the extraction's accuracy goes with gold taken from the same table."""
    j = score.select(F.col("value").alias("selection_score")).join(F.broadcast(accuracy.select(F.col("value").alias("extraction_accuracy"))), F.lit(True)).join(F.broadcast(sources.agg(F.round(F.count_if(F.col("answer_source") == "table") / F.greatest(F.count("*"), F.lit(1)), 6).alias("table_ratio"))), F.lit(True))
    return j.withColumn("flagged", ((F.col("selection_score") - F.col("extraction_accuracy")) > gap) & (F.col("table_ratio") > 0))


#: Thresholds of the diagnosis.
THRESHOLDS = {"retrieval_recall": 0.70, "faithfulness": 0.80, "extraction_accuracy": 0.90, "selection_score": 0.70, "doc_selection_accuracy": 0.80, "task_score": 0.60}


def diagnose(values: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """``values`` (one row per run; metrics as columns, plus ``extract_score`` and ``score_dropped``) with ``findings``: every rule that fires, in order.

    A metric that was not measured is neither high nor low; a missing task or
    extraction score counts as good.  Without a finding it is ``unclear``.
    """
    t = THRESHOLDS | (thresholds or {})
    low = {k: F.col(k) < v for k, v in t.items()}
    high = {k: F.col(k) >= v for k, v in t.items()}
    wrong, no_extract = F.coalesce(low["task_score"], F.lit(False)), F.coalesce(F.col("extract_score") < t["task_score"], F.lit(False))
    measured = [k for k in t if k != "task_score"]
    normal = F.lit(True)
    for k in measured:
        normal = normal & F.coalesce(high[k], F.lit(True))
    normal = normal & F.coalesce(*measured).isNotNull()
    rules = (
        ("retrieval", low["retrieval_recall"] & high["faithfulness"]),
        ("generation", high["retrieval_recall"] & low["faithfulness"]),
        ("faithful_but_wrong", high["retrieval_recall"] & high["faithfulness"] & wrong),
        ("extraction_table", low["extraction_accuracy"] & low["selection_score"]),
        ("condition_query", high["extraction_accuracy"] & low["selection_score"]),
        ("circularity", low["extraction_accuracy"] & high["selection_score"]),
        ("document_not_found", low["doc_selection_accuracy"] & no_extract),
        ("corpus_or_items_moved", normal & F.coalesce("score_dropped", F.lit(False))),
    )
    fired = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules)), lambda x: x.isNotNull())
    return values.withColumn("findings", F.when(F.size(fired) == 0, F.array(F.lit("unclear"))).otherwise(fired))


def changed_axes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: the provenance axes (``axis, value``) whose values differ, and whether the comparison is clean (one at most); a missing value equals a missing one."""
    a, b = before.select(*keys, "axis", F.col("value").alias("old")), after.select(*keys, "axis", F.col("value").alias("new"))
    j = a.join(b, [*keys, "axis"], "full_outer")
    moved = F.collect_list(F.when(~F.col("old").eqNullSafe(F.col("new")), F.col("axis")))
    return j.groupBy(*keys).agg(F.array_sort(moved).alias("axes")).withColumn("clean", F.size("axes") <= 1)


def contamination(axes: DataFrame, metrics: DataFrame, keys: list[str], targets: list[str], protected: list[str], scorer: str = "scorer") -> DataFrame:
    """Per experiment: REJECT where a target metric (``metric, old, new``) rose while only the scorer changed, or where no target is declared or one is also protected; protected metrics that fell are counted."""
    declared = bool(targets) and not set(targets) & set(protected)
    rose = F.count_if(F.col("metric").isin(*targets) & (F.col("new") > F.col("old"))) if targets else F.lit(0)
    fell = F.count_if(F.col("metric").isin(*protected) & (F.col("new") < F.col("old"))) if protected else F.lit(0)
    m = metrics.groupBy(*keys).agg(rose.alias("n_rose"), fell.alias("n_protected_fell"))
    only = (F.size("axes") == 1) & F.array_contains("axes", scorer)
    return axes.join(m, keys, "left").select(*keys, only.alias("only_scorer_changed"), F.coalesce("n_rose", F.lit(0)).alias("n_rose"), F.coalesce("n_protected_fell", F.lit(0)).alias("n_protected_fell"), F.when(~F.lit(declared) | (only & (F.coalesce("n_rose", F.lit(0)) > 0)), "REJECT").otherwise("OK").alias("verdict"))


def run_summary(runs: DataFrame, axes: list[str], totals: list[str]) -> DataFrame:
    """``axis, value, n, share`` of every axis of a run (route, action, reason, ...), and ``axis`` = total rows with the sums; one pass over the rows."""
    e = runs.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a).cast("string"), F.lit("None")).alias("value")) for a in axes))).alias("x"))
    dist = e.groupBy("x.axis", "x.value").agg(F.count("*").cast("double").alias("amount"))
    sums = runs.agg(F.count("*").cast("double").alias("rows"), *(F.round(F.coalesce(F.sum(F.col(t).cast("double")), F.lit(0.0)), 6).alias(t) for t in totals)).unpivot([], ["rows", *totals], "value", "amount").select(F.lit("total").alias("axis"), "value", "amount")
    return dist.unionByName(sums)


def merge_usage(usages: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Usage of several clients added up per item; a client that recorded nothing counts 0."""
    return usages.groupBy(key).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters))


def layers(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Layers of a run in order (``layer, n_failed``): pass, FAIL, or skipped behind a layer that failed; a layer without outcome has passed nothing and is skipped too."""
    place = F.broadcast(outcomes.sparkSession.createDataFrame([(i, x) for i, x in enumerate(order, 1)], "place int, layer string"))
    j = place.join(outcomes.groupBy("layer").agg(F.sum("n_failed").alias("n_failed")), "layer", "left")
    from pyspark.sql.window import Window

    broken = F.coalesce(F.max(F.when(F.col("n_failed").isNull() | (F.col("n_failed") > 0), 1)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per layer
    return j.select("place", "layer", "n_failed", F.when((broken == 1) | F.col("n_failed").isNull(), "skipped").when(F.col("n_failed") > 0, "FAIL").otherwise("pass").alias("state"))


def score_breakdown(scored: DataFrame, judge: str, ready: bool) -> DataFrame:
    """Per task type: the mean, and which part of it is deterministic, a stub's, or a judge's; ``final`` is null unless a real judge is ready."""
    rule = F.col("kind").isin("document_set", "value", "abstention", "system_failure", "comparison")
    part = lambda c: F.round(F.avg(F.when(c, F.col("score"))), 4)
    mean = F.round(F.avg("score"), 4)
    return scored.groupBy("task_type").agg(F.count("*").alias("n"), mean.alias("score"), part(rule).alias("deterministic"), part(~rule & F.lit(judge == "stub")).alias("provisional_stub"), part(~rule & F.lit(judge == "real")).alias("judged"), (mean if judge == "real" and ready else F.lit(None).cast("double")).alias("final"))


def experiment_diff(old: DataFrame, new: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """One row: items in both runs, those whose score differs, the mean change of the score, and how much the measures (latency, tokens, ...) fell in per cent; items of one run only are counted apart."""
    o = old.select(key, F.col("score").alias("os"), *(F.col(m).alias(f"o_{m}") for m in measures), F.lit(True).alias("_o"))
    n = new.select(key, F.col("score").alias("ns"), *(F.col(m).alias(f"n_{m}") for m in measures), F.lit(True).alias("_n"))
    j = o.join(n, key, "full_outer")
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    fell = [F.round(100 * (1 - F.sum(F.when(both, F.col(f"n_{m}"))) / F.nullif(F.sum(F.when(both, F.col(f"o_{m}"))), F.lit(0.0))), 4).alias(f"{m}_reduction") for m in measures]
    return j.agg(F.count_if(both).alias("n_both"), F.count_if(both & ~F.col("os").eqNullSafe(F.col("ns"))).alias("n_differing"), F.count_if(F.col("_n").isNull()).alias("n_dropped"), F.count_if(F.col("_o").isNull()).alias("n_added"), F.round(F.avg(F.when(both, F.col("ns") - F.col("os"))), 6).alias("mean_change"), *fell)


def listing(items: DataFrame, verdicts: list[str]) -> DataFrame:
    """Items of the given verdicts, with the number of their verdict and of all items; the totals are of the whole, not of what is listed."""
    n = items.groupBy("verdict").agg(F.count("*").alias("n_of_verdict"))
    total = n.agg(F.sum("n_of_verdict").alias("n_all"))
    return items.where(F.col("verdict").isin(*verdicts)).join(F.broadcast(n), "verdict").join(F.broadcast(total), F.lit(True)).select("item_key", "id", "verdict", "n_of_verdict", "n_all")


def retried(attempts: DataFrame, key: str, order: list[str], ok: str, most: int = 2) -> DataFrame:
    """Per ``key``: attempts made, at most ``most``, none behind one that succeeded, and whether one did."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(*order)
    a = attempts.withColumns({"attempt": F.row_number().over(w), "done": F.coalesce(F.max(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    made = a.where((F.col("attempt") <= most) & (F.col("done") == 0))
    return made.groupBy(key).agg(F.max("attempt").cast("long").alias("attempts"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("succeeded"))
