"""Schemas of the relations, and the rule set of the schema gate."""

from __future__ import annotations

TIERS = "array<struct<level:bigint,level_label:string,remaining:bigint>>"
SNAPSHOT = f"as_of date, source_timestamp string, ordinal int, game_no bigint, name string, price double, percent_unsold double, total_unclaimed double, top_prizes {TIERS}"
META = "game_no bigint, name string, price double, print_run bigint, overall_odds double, top_prize_value bigint, on_sale date, end_date date, last_cash_date date, source string, article_id string"
PANEL = f"game_no bigint, game_key string, obs_date string, capture_ts string, source string, capture_url string, retrieved_at string, content_hash string, parser_version string, percent_unsold double, pu_interval array<double>, total_unclaimed double, top_prizes {TIERS}, price double, name string, lifecycle_status string, has_noncash_prize boolean"
COST_LOG = "task_id string, gate string, verdict string, cost_usd_total double, cost_cap_breached boolean"
VERDICT_FINDING = "id string, severity string, confidence double, issue string, file string, line int, source_models array<string>, disputed boolean, arbiter_ruling string"

#: name -> SQL condition that every row of the latest document meets.
LATEST_RULES = {
    "required": "game_no is not null and name is not null and price is not null and percent_unsold is not null and total_unclaimed is not null and dead_game is not null and flags is not null and rated is not null",
    "confidence": "confidence in ('high', 'medium', 'low')",
    "grade": "grade is null or grade in ('A', 'A-', 'B+', 'B', 'B-', 'C', 'D', 'F')",
    "flags": "forall(flags, f -> f in ('anomaly_candidate', 'ev_out_of_range', 'low_inventory', 'no_print_run', 'sold_out')) and flags = sort_array(flags)",
    "scenarios": "ev_scenarios is null or size(ev_scenarios) = 3",
    "monotone": "ev_scenarios is null or forall(sequence(0, size(ev_scenarios) - 2), k -> ev_scenarios[k].assumed_claimed_share < ev_scenarios[k + 1].assumed_claimed_share and ev_scenarios[k].ev_ratio >= ev_scenarios[k + 1].ev_ratio)",
    "reason": "length(reason) > 0",
    "rated": "rated = (value_score is not null) and rated = (grade is not null)",
    "intervals": "(ev_ratio is null) = (remaining_tickets_min is null) and coalesce(remaining_tickets_min <= remaining_tickets_max, true) and coalesce(ev_ratio_min <= ev_ratio_max, true)",
}
#: Conditions of a panel record; a level is missing only where a label says what the prize is.
PANEL_RULES = {
    "source": "source in ('wayback', 'daily')",
    "lifecycle": "lifecycle_status is null or lifecycle_status in ('active', 'exited_observed', 'exited_unobserved')",
    "interval": "size(pu_interval) = 2 and pu_interval[0] <= pu_interval[1]",
    "labels": "forall(top_prizes, t -> t.level is not null or t.level_label is not null)",
}
