"""Report text from the metrics documents."""

from __future__ import annotations

from .artifacts import PLACEHOLDER


def number(value: object, digits: int = 3) -> str:
    return "N/A" if value is None else f"{float(value):.{digits}f}"


def _rows(analytics: dict, key: str) -> list[dict]:
    if not analytics.get(key):
        raise RuntimeError(f"the analytics metrics have no {key}")
    return analytics[key]


def genre_sentence(analytics: dict) -> str:
    rows = sorted(_rows(analytics, "genre_summary"), key=lambda r: float(r["rating_change"]))
    low, high = rows[0], rows[-1]
    return f"Of the largest genres, {high['genre']} rose most in median rating ({float(high['rating_change']):+.2f}) from its first to its last qualifying decade, and {low['genre']} fell most or rose least ({float(low['rating_change']):+.2f})."


def runtime_sentence(analytics: dict) -> str:
    p = analytics.get("runtime_profile") or {}
    return f"Most films ({int(p['peak_volume_film_count']):,}) lie in the {int(p['peak_volume_bucket_minutes'])}-minute bucket, with a median rating of {float(p['peak_volume_median_rating']):.2f}; this describes volume, not an optimum."


def lift_sentence(analytics: dict) -> str:
    rows = sorted(_rows(analytics, "pre_release_signal_lift"), key=lambda r: float(r["lift_vs_eligible"]))
    low, high = rows[0], rows[-1]
    return f"Experience band {int(high['signal_band'])} had the highest hit lift, {float(high['lift_vs_eligible']):.2f} times the base rate; band {int(low['signal_band'])} the lowest, {float(low['lift_vs_eligible']):.2f} times."


def values(analytics: dict, hit: dict, awards: dict) -> dict[str, str]:
    """Placeholder names and their text.  RuntimeError unless all documents are of version 2."""
    if any(d.get("schema_version") != 2 for d in (analytics, hit, awards)):
        raise RuntimeError("all metrics must have schema_version 2")
    out = {
        "FINAL_DIRECTOR_CORRELATION": number(analytics["director_prior_rating_corr"]),
        "FINAL_NICHE_CANDIDATE_COUNT": f"{int(analytics['anomaly_count_rating_ge_8_bottom_decile_votes']):,}",
        "FINAL_GENRE_FINDING": genre_sentence(analytics),
        "FINAL_RUNTIME_FINDING": runtime_sentence(analytics),
        "FINAL_SIGNAL_LIFT_FINDING": lift_sentence(analytics),
    }
    for name, m in (("HIT", hit), ("AWARDS", awards)):
        out[f"FINAL_{name}_ALGORITHM"] = str(m["selected_candidate"]["algorithm"])
        out[f"FINAL_{name}_THRESHOLD"] = number(m["threshold_selection"]["selected"]["threshold"])
        for key, metric in (("PR_AUC", "pr_auc"), ("ROC_AUC", "roc_auc"), ("PRECISION", "precision"), ("RECALL", "recall"), ("F1", "positive_f1")):
            out[f"FINAL_{name}_{key}"] = number(m["test_metrics"][metric])
    return out


def resolve(template: str, filled: dict[str, str]) -> str:
    """The template with its placeholders filled; RuntimeError if any is left."""
    text = PLACEHOLDER.sub(lambda m: filled.get(m[0][2:-2], m[0]), template)
    if left := sorted(set(PLACEHOLDER.findall(text))):
        raise RuntimeError("unresolved placeholders: " + ", ".join(left))
    return text
