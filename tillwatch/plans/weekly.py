"""The weekly report tables for one week, computed only from data up to the end of that week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.operators import anomaly, clean, finance, kpis, marketing, metrics, product, weekly
from tillwatch.plans import models

TARGETS = 5000


def build(tickets: DataFrame, week: Column, min_tickets: int = anomaly.MIN_TICKETS) -> dict[str, DataFrame]:
    """All department tables. Pass a stored fact table: every entry reads it with its own columns and filters."""
    end = C.plus_days(week, 7)
    hist = clean.before(tickets, end)
    alerts = anomaly.detect(metrics.weekly_error_rates(hist), min_tickets=min_tickets)
    months = kpis.busy_months(kpis.monthly_kpis(hist))
    changes = product.breakdown_changes(hist, week)
    losses = finance.monthly_losses(hist)
    targets = models.target_list(hist, end)
    by_type, by_id = marketing.campaign_effectiveness(hist), marketing.campaign_effectiveness(hist, "campaign_id", 300)
    return {
        "weekly_facts": weekly.weekly_facts(hist, alerts).where(F.col("week") == week),
        "alerts": alerts.where((F.col("week") == week) & F.col("is_alert")),
        "recovery_list": weekly.recovery_list(hist, week),
        "errors_by_code": metrics.errors_by_code(hist, week),
        "product_breakdown": changes,
        "top_increases": product.top_increases(changes),
        "finance_monthly_losses": losses,
        "latest_losses": finance.latest_losses(losses),
        "marketing_targets": models.best_targets(targets, TARGETS),
        "segment_summary": marketing.segment_summary(targets),
        "campaign_effectiveness": by_type,
        "campaign_ids_effectiveness": by_id,
        "campaign_verdict": marketing.campaign_verdict(by_type, by_id),
        "kpis_monthly": months,
        "kpi_snapshot": kpis.snapshot(months, kpis.last_finished_month(months, end).scalar()),
    }


def export(tables: dict[str, DataFrame], out_dir: str) -> None:
    """Write each table as CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{out_dir.rstrip('/')}/{name}")
