from lexigauge.plans.comparison import Comparison, GroupReport, OverallReport
from lexigauge.plans.detected import profile_detected, profile_detected_datasets
from lexigauge.plans.profile import dataset_features, full_profile
from lexigauge.plans.reports import group_report_lines, overall_report_lines

__all__ = [
    "Comparison",
    "GroupReport",
    "OverallReport",
    "dataset_features",
    "full_profile",
    "group_report_lines",
    "overall_report_lines",
    "profile_detected",
    "profile_detected_datasets",
]
