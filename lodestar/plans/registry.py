"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import analytics, checks, decisions, generation, reports, stateful, toolcalls, workloads

#: Columns whose type differs between the dialects, by query: made long as in Spark (DuckDB widens sums to 128 bits), or the type after a colon.
WHOLE = {
    "accounts_paid_over": "total",
    "usage_by_feature": "total",
    "running_payments": "total running",
    "payments_in_window": "total",
    "accounts_above_avg_paid": "total",
    "top_accounts_paid": "total",
    "top_users_usage": "total",
    "reprice_total": "total missing",
    "revenue_by_tier": "revenue",
    "running_usage_for_user": "running",
    "tickets_without_user": "without_user",
    "success_vs_failed": "ok failed",
    "payment_status_pivot": "ok failed returned",
    "gateway_totals": "ok cost comparable counterfactual excluded",
    "telemetry_by_route": "failed p95_ms:DOUBLE",
    "tickets_open_closed_split": "open closed",
    "leakage_counts": "leaked",
    "paraphrase_clean_counts": "empty duplicate kept",
    "paired_counts": "both_right only_a only_b both_wrong",
    "risk_coverage": "score covered errors",
    "selective_evaluation": "served wrong wrong_deferred",
    "deferral_windows": "defers",
    "latency_histogram": "cumulative",
    "reprice": "cost tokens",
    "savings_by_day": "counterfactual actual",
    "spend_by_kind": "spend",
    "cap_breaches": "spent",
    "active_reservations": "held",
    "stream_slots": "peak",
    "parity_table": "agree only_first only_second",
    "throughput_levels": "errors",
    "heartbeat_counters": "views",
    "mean_output_tokens": "excluded",
    "top_ticket_accounts_rank": "rk:INTEGER",
    "rank_accounts_in_country": "rk:INTEGER",
    "few_shot_round_robin": "depth:INTEGER",
    "cost_by_model": "tokens cents",
    "late_cost_updates": "nano",
    "leakage_matrix": "exact_question masked_question exact_sql masked_sql same_template",
    "accuracy_cuts": "correct",
    "prompt_parity": "same",
    "window_stats": "deferred audits disagreements",
    "change_feed": "seq:INTEGER",
    "counterfactual_costs": "counterfactual",
    "spend_lines": "units",
    "finetune_split": "billed ceiling",
    "reservation_fold": "held spent",
    "teacher_stats": "p50_ms:DOUBLE p95_ms:DOUBLE",
    "estimate_totals": "total known",
    "manifest_rows": "place:INTEGER",
    "spend_without_kinds": "spend total",
    "usage_delta": "nano",
    "cap_checks": "spent remaining",
    "ledger_summary": "nano",
    "ledger_differences": "surplus",
    "duplicate_ledger_rows": "duplicates",
    "price_estimates": "tokens cost",
    "stage_tree": "depth:INTEGER",
}
MODULES = (analytics, workloads, toolcalls, stateful, reports, generation, decisions, checks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def narrowed(name: str, sql: str) -> str:
    """The oracle SQL with the types that Spark gives."""
    split = [c.partition(":") for c in WHOLE.get(name, "").split()]
    casts = [f"CAST({c} AS {kind or 'BIGINT'}) AS {c}" for c, _, kind in split]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS whole" if casts else sql


def oracle_sql() -> dict[str, str]:
    return {name: narrowed(name, sql) for m in MODULES for name, sql in m.oracle_sql().items()}
