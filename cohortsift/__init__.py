"""Cohort review on Spark.

Review steps over large Parquet tables are declared as small JSON specs and run
as lazy DataFrames: multi-file scan, joins, filter trees, projection, order,
pages, recurrence counts, search, and an append-only log of review decisions.
"""

from cohortsift.operators.joins import join
from cohortsift.operators.paging import PageView, SortedPages, page, page_after, page_stats, show_page
from cohortsift.operators.recurrence import distinct_values, run_recurrence, with_run_recurrence
from cohortsift.operators.search import search
from cohortsift.operators.selection import deep_page
from cohortsift.plans.review import ReviewSession, ReviewStore
from cohortsift.plans.spec import FieldSpec, FilterNode, JoinSpec, OrderKey, StepSpec, TableRef
from cohortsift.plans.steps import StepPages, run_step, step_page, step_relation
from cohortsift.sources.cohort import Cohort
from cohortsift.sources.csv_report import export_csv
from cohortsift.sources.lake import Lake, scan_files
from cohortsift.sources.manifest import Manifest
from cohortsift.sources.methods import load_method, read_methods
from cohortsift.sources.search_index import SearchIndex
from cohortsift.streaming.snapshot import FoldedLog

__all__ = [
    "Cohort",
    "FieldSpec",
    "FilterNode",
    "FoldedLog",
    "JoinSpec",
    "Lake",
    "Manifest",
    "OrderKey",
    "PageView",
    "ReviewSession",
    "ReviewStore",
    "SearchIndex",
    "SortedPages",
    "StepPages",
    "StepSpec",
    "TableRef",
    "deep_page",
    "distinct_values",
    "export_csv",
    "join",
    "load_method",
    "page",
    "page_after",
    "page_stats",
    "read_methods",
    "run_recurrence",
    "run_step",
    "scan_files",
    "search",
    "show_page",
    "step_page",
    "step_relation",
    "with_run_recurrence",
]
