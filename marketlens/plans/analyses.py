"""The twenty analyses by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marketlens.plans import business, experience, fulfillment, operations
from marketlens.schema import Tables

ANALYSES: dict[str, Callable[[Tables], DataFrame]] = {
    # business overview
    "q02_1_coverage": business.coverage,
    "q02_2_status_share": business.status_share,
    "q02_3_delivered_overview": business.delivered_overview,
    "q02_4_monthly": business.monthly,
    "q02_5_mom_growth": business.mom_growth,
    # fulfillment
    "q03_1_overall": fulfillment.overall,
    "q03_2_bands": fulfillment.bands,
    "q03_3_state": fulfillment.state_performance,
    "q03_4_stage": fulfillment.stages,
    "q03_5_stage_late_vs_ontime": fulfillment.stage_late_vs_ontime,
    "q03_6_promise_state": fulfillment.promise_by_state,
    "q03_7_priority_state": fulfillment.priority_by_state,
    # sellers and categories
    "q04_1_top_sellers": operations.top_sellers,
    "q04_2_seller_risk": operations.seller_risk,
    "q04_3_top_categories": operations.top_categories,
    "q04_4_category_risk": operations.category_risk,
    # customer experience
    "q05_1_review_dist": experience.review_distribution,
    "q05_2_late_vs_review": experience.late_vs_review,
    "q05_3_delay_vs_review": experience.delay_vs_review,
    "q05_4_repeat_customers": experience.repeat_customers,
}
