"""Settings of a cleaning run."""

from __future__ import annotations

from dataclasses import dataclass

# These lists and thresholds decide results and must not drift.
ID_NAME_TOKENS = ("id", "order", "invoice", "txn", "match", "ref", "no")
TITLE_EXEMPT_TOKENS = ("id", "code", "no", "ref")
NOISE_NAME_PREFIXES = ("unnamed", "index")
NA_TOKENS = ("nan", "None", "")
PRESENT_SENTINEL = "Unknown"
SPARSE_SENTINEL = "NaN"

ROW_SEQ = "_raw_row_seq"
AUTO_ID = "auto_id"
TECHNICAL_COLS = (ROW_SEQ, AUTO_ID)


@dataclass(frozen=True)
class CleanConfig:
    """Every knob of the cleaner; the defaults are the standard behaviour.

    ``numeric_impute``   ``"median"``, ``"mean"`` or ``"none"``.
    ``quantile_error``   0 gives exact quantiles; above 0, one approximate pass with that relative rank error.
    ``exact_rows``       most values per column that an exact quantile may hold in one task.
    ``lenient_dates``    also accept one-digit day/month fields and text after the date.
    ``force_date_names`` parse every text column whose name holds "date", whatever its content.
    ``date_missing``     ``"sentinel"`` renders dates as text and fills gaps, ``"null"`` keeps the date type.
    ``stage_input``      True writes the input to a table first, False never does; None does so where the input comes
                         in too few pieces to use the cluster.
    ``columns_per_job``  how many columns share one aggregate; wider tables take several.
    """

    date_threshold: float = 0.6
    numeric_threshold: float = 0.8
    numeric_impute: str = "median"
    outlier_iqr_factor: float = 1.5
    drop_empty_columns: bool = True
    id_name_tokens: tuple[str, ...] = ID_NAME_TOKENS
    title_exempt_tokens: tuple[str, ...] = TITLE_EXEMPT_TOKENS
    na_tokens: tuple[str, ...] = NA_TOKENS
    lenient_dates: bool = False
    force_date_names: bool = False
    date_missing: str = "sentinel"
    quantile_error: float = 0.0
    exact_rows: int = 200_000
    relaxed_non_null: float = 0.95
    relaxed_distinct: float = 0.9
    entity_columns: int = 3
    stage_input: bool | None = None
    columns_per_job: int = 100

    def __post_init__(self) -> None:
        choices = {
            "numeric_impute": ("median", "mean", "none"),
            "date_missing": ("sentinel", "null"),
        }
        for field_name, allowed in choices.items():
            if getattr(self, field_name) not in allowed:
                raise ValueError(f"{field_name} must be one of {allowed}")
