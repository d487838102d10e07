"""Q3 -- screen drug pairs against every side effect.

requests -> validation (rejects kept) -> distinct pairs -> profiles ->
scores of both orientations for every side effect of the catalogue ->
mean, label (``mean < thr``), gap -> flagged only -> per pair: total count and
the top ``k`` by gap with names, rounding and severity -> one response per
request.

Plan shape: the per-pair work (profile lookup, embedding) happens once per
*distinct* pair; the catalogue (offsets or heads, and thresholds) is shipped
once per executor in blocks, every Arrow batch of pairs is scored against it as
dense arrays, and only the ranked rows leave the batch -- the pair x catalogue
product never exists as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import (TOP_RESULTS, gap, json_text, predicted_label, round_places, se_display_name, severity,
                                 summary_sentence)
from ..operators.joins import bounded_broadcast, profile_lookup
import numpy as np

from ..operators.scoring import PairModel, identity_params, score_observations, screen_ranked
from ..operators.thresholds import threshold_mean


@dataclass
class Screen:
    results: DataFrame      # drug1, drug2, rank, se, name, confidence_gap, probability_score, severity, total
    responses: DataFrame    # request_id, drug1, drug2, status, total_predicted_reactions, top_results (JSON text)
    rejects: DataFrame      # request_id, drug1, drug2, reason


def valid_requests(requests: DataFrame, distinct_guard: bool = False):
    """Split requests into valid ones and rejects. Ids are cast like ``int()``;
    a missing, empty or 0 id is rejected as missing (the API's truthiness
    test), a value that is not an integer as invalid (the API's cast error).
    ``distinct_guard`` also rejects ``drug1 = drug2`` (the browser's rule; the
    API accepts it)."""
    raw1, raw2 = F.col("drug1").cast("string"), F.col("drug2").cast("string")
    d1, d2 = F.col("drug1").try_cast("bigint"), F.col("drug2").try_cast("bigint")
    r = requests.select("request_id", d1.alias("drug1"), d2.alias("drug2"),
                        (raw1.isNull() | (raw1 == "")).alias("_m1"), (raw2.isNull() | (raw2 == "")).alias("_m2"))
    zero = lambda c: F.coalesce(F.col(c) == 0, F.lit(False))
    missing = F.col("_m1") | F.col("_m2") | zero("drug1") | zero("drug2")
    invalid = ~missing & (F.col("drug1").isNull() | F.col("drug2").isNull())
    bad = missing | invalid
    if distinct_guard:
        bad = bad | F.coalesce(F.col("drug1") == F.col("drug2"), F.lit(False))
    reason = (F.when(missing, F.lit("missing drug id")).when(invalid, F.lit("invalid drug id"))
              .otherwise(F.lit("same drug twice")))
    return (r.where(~bad).drop("_m1", "_m2"),
            r.where(bad).withColumn("reason", reason).drop("_m1", "_m2"))


def score_identity(rows: DataFrame, profile: DataFrame, r_table: DataFrame, thr: DataFrame) -> DataFrame:
    """Identity-head scores of both orientations of observed ``(drug1, drug2, se)`` rows."""
    se_ids, R, _ = identity_params(r_table, None)
    limits = bounded_broadcast(thr.select("se", "optimal_thr"))
    scored = score_observations(rows, profile, se_ids=se_ids, R=R).join(limits, "se", "left")
    return scored.select(*rows.columns, F.col("score_fwd").alias("predicted_score_x"),
                         F.col("score_rev").alias("predicted_score_y"),
                         ((F.col("score_fwd") + F.col("score_rev")) / 2).alias("mean_predicted_score"), "optimal_thr")


def format_ranked(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """Names (default ``Unknown SE #id``, capitalised), 4-place rounding and
    severity for ranked rows (``rank``, ``gap``, ``mean_predicted_score``)."""
    n = bounded_broadcast(names.select("se", F.col("name").alias("_name")))
    named = ranked.join(n, "se", "left")
    g4 = round_places("gap", 4)
    return named.select("drug1", "drug2", "rank", "se", se_display_name("_name", "se").alias("name"),
                        g4.alias("confidence_gap"), round_places("mean_predicted_score", 4).alias("probability_score"),
                        severity(g4).alias("severity"), "total_predicted_reactions")


def rank_flagged(scored: DataFrame, names: DataFrame, top: int = TOP_RESULTS) -> DataFrame:
    """Flagged rows only, ranked per pair by gap (ties: lower se first) with a
    window -- for scored rows that do not come from the ranking kernel."""
    lab = scored.select("*", predicted_label("mean_predicted_score", "optimal_thr").alias("final_predicted_label"),
                        gap("mean_predicted_score", "optimal_thr").alias("gap"))
    flagged = lab.where(F.col("final_predicted_label") == 1)
    pair = Window.partitionBy("drug1", "drug2")
    w = pair.orderBy(F.col("gap").desc(), F.col("se"))
    ranked = flagged.select("*", F.row_number().over(w).alias("rank"),
                            F.count(F.lit(1)).over(pair).alias("total_predicted_reactions"))
    return format_ranked(ranked.where(F.col("rank") <= top), names)


def responses(valid: DataFrame, results: DataFrame) -> DataFrame:
    """One response per valid request: total and the ranked list as JSON text."""
    item = F.format_string('{"se_id": %d, "name": %s, "confidence_gap": %.4f, "probability_score": %.4f}',
                           "se", json_text("name"), "confidence_gap", "probability_score")
    per_pair = (results.groupBy("drug1", "drug2")
                .agg(F.max("total_predicted_reactions").alias("total_predicted_reactions"),
                     F.array_sort(F.collect_list(F.struct("rank", item.alias("txt")))).alias("_items")))
    j = valid.join(per_pair, ["drug1", "drug2"], "left")
    total = F.coalesce(F.col("total_predicted_reactions"), F.lit(0)).cast("long")
    items = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform("_items", lambda x: x["txt"]), ", "), F.lit("]")),
                       F.lit("[]"))
    doc = F.concat(F.format_string('{"status": "success", "drug1_requested": %d, "drug2_requested": %d, '
                                   '"total_predicted_reactions": %d, "top_results": ', "drug1", "drug2", total),
                   items, F.lit("}"))
    return j.select("request_id", "drug1", "drug2", F.lit("success").alias("status"),
                    total.alias("total_predicted_reactions"), items.alias("top_results"),
                    summary_sentence(total).alias("summary"), doc.alias("response_json"))


def _sorted_model(model: PairModel) -> PairModel:
    order = np.argsort(model.se_ids, kind="stable")
    return PairModel(**{**model.__dict__, "se_ids": model.se_ids[order], "heads": model.heads[order],
                        "tails": model.tails[order], "r": model.r[order]})


def screen(requests: DataFrame, profile: DataFrame, thresholds: DataFrame, names: DataFrame,
           se_catalogue: DataFrame, r_table: DataFrame | None = None, model: PairModel | None = None,
           mode: str = "last5", top: int = TOP_RESULTS, distinct_guard: bool = False) -> Screen:
    """The screen. Pairs are distinct, so every pair is scored against the
    whole catalogue (the side effects of ``se_catalogue`` that have weights)
    inside one task and ranked there (``screen_ranked``), in blocks of side
    effects whatever the catalogue's size."""
    valid, rejects = valid_requests(requests, distinct_guard)
    pairs = valid.select("drug1", "drug2").distinct()
    listed = se_catalogue.select("se").distinct()
    thr = threshold_mean(thresholds, mode).join(listed, "se", "left_semi")
    pv = profile_lookup(pairs, profile)
    if model is None:
        se_ids, R, th = identity_params(r_table.join(listed, "se", "left_semi"), thr)
        ranked = screen_ranked(pv, th, top, se_ids=se_ids, R=R)
    else:
        # thresholds of the model's own side effects; without one nothing is flagged
        thr_map = {int(r["se"]): r["optimal_thr"] for r in thr.where("optimal_thr is not null").toLocalIterator()}
        m = _sorted_model(model)
        th = np.array([thr_map.get(int(x), np.nan) for x in m.se_ids], dtype=float)
        ranked = screen_ranked(pv, th, top, model=m)
    results = format_ranked(ranked, names)
    return Screen(results, responses(valid, results), rejects)
