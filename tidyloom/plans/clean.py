"""The cleaning plan: names, noise, text, types, gaps, duplicates, and on request outliers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidyloom.config import CleanConfig
from tidyloom.operators.columns import (
    data_columns,
    drop_noise_named,
    name_mapping,
    normalize_columns,
    typed_voids,
)
from tidyloom.operators.dedup import dedup_full, dedup_subset
from tidyloom.operators.impute import impute
from tidyloom.operators.outliers import clamp_outliers
from tidyloom.operators.profile import STRING, ColumnProfile, apply_types, profile
from tidyloom.storage import materialize, sized_shuffles, stage


@dataclass(frozen=True)
class CleanReport:
    """What a run did: ``full_duplicates`` and ``subset_duplicates`` count removed rows."""

    rows_in: int
    rows_out: int
    full_duplicates: int
    subset_duplicates: int
    inferred: dict[str, str]
    final_types: dict[str, str]
    dropped_columns: list[str]

    def frame(self, spark) -> DataFrame:
        """The counts as a one-row table."""
        return spark.createDataFrame(
            [(self.rows_in, self.full_duplicates, self.subset_duplicates, self.rows_out)],
            "rows_in bigint, full_duplicates bigint, subset_duplicates bigint, rows_out bigint",
        )


@dataclass(frozen=True)
class CleanResult:
    df: DataFrame
    report: CleanReport
    profiles: list[ColumnProfile] = field(repr=False)
    names: dict[str, str] = field(repr=False)


def type_and_fill(df: DataFrame, config: CleanConfig) -> tuple[DataFrame, list[ColumnProfile], list[str]]:
    """Lazy typed and filled frame, the profiles it rests on, and the empty columns it dropped.

    The one profile pass answers everything asked before the fill values: empty columns, types and value counts.
    """
    profiles = profile(df, config)
    rows = profiles[0].rows if profiles else 0
    if rows == 0:
        return df, profiles, []
    empty = [p.column for p in profiles if p.present == 0] if config.drop_empty_columns else []
    kept = [p for p in profiles if p.column not in empty]
    typed = apply_types(df.drop(*empty), kept, config)
    return impute(typed, config, rows, {p.column: p.shown for p in kept}), profiles, empty


def clean(
    df: DataFrame,
    config: CleanConfig = CleanConfig(),
    dedupe_subset: Iterable[str] | None = None,
    remove_outliers: bool = False,
) -> CleanResult:
    """Clean a dataset of unknown schema.

    The result is a written table: whoever reads it later sees the same rows, without paying for the cleaning again.
    """
    names = dict(name_mapping(df.columns))
    frame = typed_voids(drop_noise_named(normalize_columns(df)))
    if config.stage_input is not False:
        frame = stage(frame, always=bool(config.stage_input))
    filled, profiles, empty = type_and_fill(frame, config)

    rows_in = max((p.rows for p in profiles), default=0)
    cleaned, distinct_rows = filled, rows_in
    if filled.columns:
        with sized_shuffles(frame):
            cleaned = materialize(dedup_full(filled), "deduped")
        distinct_rows = cleaned.count()
    rows_out = distinct_rows
    if dedupe_subset:
        with sized_shuffles(frame):
            cleaned = materialize(dedup_subset(cleaned, dedupe_subset), "deduped_subset")
        rows_out = cleaned.count()
    if remove_outliers:
        cleaned = clamp_outliers(cleaned, config=config)

    inferred = {p.column: p.inferred if rows_in else STRING for p in profiles if p.column in cleaned.columns}
    report = CleanReport(
        rows_in=rows_in,
        rows_out=rows_out,
        full_duplicates=rows_in - distinct_rows,
        subset_duplicates=distinct_rows - rows_out,
        inferred=inferred,
        final_types={c: cleaned.schema[c].dataType.simpleString() for c in data_columns(cleaned)},
        dropped_columns=[c for c in names.values() if c not in cleaned.columns],
    )
    return CleanResult(cleaned, report, profiles, names)
