"""A review step as one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsift.functions.sqltext import qualified, quoted
from cohortsift.operators.joins import LIGHT_KEY_ROWS, KeyProfile, join, profile_keys
from cohortsift.operators.paging import PAGE_SIZE, PageView, SortedPages, page, page_after, show_page
from cohortsift.operators.relational import field_column, order, project, restrict, where
from cohortsift.plans.spec import MAIN, OrderKey, StepSpec
from cohortsift.sources.lake import Lake

SAMPLE_COLUMN = "sample_name"


def step_relation(
    spec: StepSpec,
    lake: Lake,
    main: Sequence[str] | DataFrame,
    samples: Sequence[str] | DataFrame | None = None,
    *,
    sample_column: str = SAMPLE_COLUMN,
    apply_filters: bool = True,
    light_rows: int = LIGHT_KEY_ROWS,
    may_broadcast: bool = True,
) -> DataFrame:
    """The joined and filtered tables of a step, every column still there.

    ``main`` is the list of files under review or a relation to stand for them.
    Filters hold after all joins; Catalyst moves what it can to the scans.
    ``light_rows`` and ``may_broadcast`` are those of :func:`join`.
    """
    base = main.alias(MAIN) if isinstance(main, DataFrame) else lake.main(main)
    # Outer joins that add rows without a main row must come before the choice of samples.
    adds_rows = any(t.join.how in ("right", "full") for t in spec.tables)
    sample = f"{MAIN}.{quoted(sample_column)}"
    df = base if samples is None or adds_rows else restrict(base, sample, samples)
    known = {MAIN: df}

    def profile(table: str, key: str) -> KeyProfile:
        """Looked for in the table itself, of the chosen samples: the chain so far would be run for it.

        The lake remembers it for the pages and steps that follow.
        """
        mark = (known[table].semanticHash(), key, light_rows)
        if mark not in lake.profiles:
            lake.profiles[mark] = profile_keys(known[table], key, light_rows)
        return lake.profiles[mark]

    for table in spec.tables:
        known[table.alias] = lake.table(table)
        left_table = table.join.left_table
        left_on = f"{quoted(left_table)}.{quoted(table.join.left_on)}"
        right_on = f"{quoted(table.alias)}.{quoted(table.join.right_on)}"
        df = join(
            df,
            known[table.alias],
            left_on,
            right_on,
            table.join.how,
            left_profile=partial(profile, left_table, left_on),
            right_profile=partial(profile, table.alias, right_on),
            light_rows=light_rows,
            may_broadcast=may_broadcast,
        )
    if samples is not None and adds_rows:
        df = restrict(df, sample, samples)
    return where(df, spec.filters) if apply_filters else df


def run_step(
    spec: StepSpec,
    lake: Lake,
    main: Sequence[str] | DataFrame,
    samples: Sequence[str] | DataFrame | None = None,
    *,
    sample_column: str = SAMPLE_COLUMN,
    apply_filters: bool = True,
    apply_order: bool = True,
    light_rows: int = LIGHT_KEY_ROWS,
    may_broadcast: bool = True,
) -> DataFrame:
    """The rows a step shows: its relation in its order, its fields only."""
    df = step_relation(
        spec, lake, main, samples, sample_column=sample_column, apply_filters=apply_filters,
        light_rows=light_rows, may_broadcast=may_broadcast,
    )
    if apply_order:
        df = order(df, spec.order)
    return project(df, spec.fields)


@dataclass(frozen=True)
class StepPages:
    """The pages of a step's relation, in the step's order and then by its fields.

    Order columns need not be among the fields, and fields may share a name. With
    ``keep`` the relation is cached for the count and the pages that follow; call
    ``rows.unpersist()`` when done.
    """

    spec: StepSpec
    rows: DataFrame  # fields as f0, f1 ..., order columns as o0, o1 ...
    order: tuple[OrderKey, ...]

    @classmethod
    def of(cls, spec: StepSpec, relation: DataFrame, keep: bool = False) -> StepPages:
        ranks = tuple(OrderKey(f"o{i}", key.direction) for i, key in enumerate(spec.order))
        named = relation.select(
            *[field_column(f).alias(f"f{i}") for i, f in enumerate(spec.fields)],
            *[F.col(key.field).alias(rank.field) for key, rank in zip(spec.order, ranks, strict=True)],
        )
        return cls(spec, named.persist() if keep else named, ranks)

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"f{i}").alias(f.output) for i, f in enumerate(self.spec.fields)])

    def page(self, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        return self._shown(page(self.rows, self.order, number, size))

    def show(self, request: int | str = 1, **options: Any) -> PageView:
        """The page with its number and the counts; a request past the end gets the last page."""
        view = show_page(self.rows, self.order, request, **options)
        return replace(view, rows=self._shown(view.rows))

    def after(self, last: Mapping[str, Any], size: int = PAGE_SIZE) -> DataFrame:
        """The rows that follow one of ``rows``, given by all its values."""
        return self._shown(page_after(self.rows, self.order, last, size))

    def sorted(self) -> StepPages:
        """The same pages over a table sorted once, for pages far in."""
        return SortedStepPages(self.spec, self.rows, self.order, SortedPages.of(self.rows, self.order))


@dataclass(frozen=True)
class SortedStepPages(StepPages):
    table: SortedPages

    def page(self, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        return self._shown(self.table.page(number, size))

    def show(self, request: int | str = 1, **options: Any) -> PageView:
        view = self.table.show(request, **options)
        return replace(view, rows=self._shown(view.rows))


def step_page(spec: StepSpec, relation: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a step's relation; past the end it is empty (:meth:`StepPages.show` turns back)."""
    return StepPages.of(spec, relation).page(number, size)


def decision_report(
    main: DataFrame,
    decided: DataFrame,
    fields: Sequence[str],
    how: str = "left",
    key: str = "validation_hash",
    light_rows: int = LIGHT_KEY_ROWS,
) -> DataFrame:
    """Rows under review beside what was decided on them.

    ``left`` shows undecided rows too; ``inner`` leaves them out.
    """
    left, right = main.alias(MAIN), decided.alias("validation_table")
    rows = join(left, right, f"{MAIN}.{quoted(key)}", f"validation_table.{quoted(key)}", how, light_rows=light_rows)
    verdict = [c for c in decided.columns if c not in fields and c != key]
    return rows.select(
        *[qualified(MAIN, f).alias(f) for f in fields],
        *[qualified("validation_table", c).alias(c) for c in verdict],
    )
