"""Plain settings objects shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

# The accepted migration modes and conflict policies.
MODES = ("InsertUpdate", "Mirror", "AppendOnly", "Merge", "SchemaOnly")
POLICIES = ("SourceWins", "TargetWins", "NewestWins", "ManualReview", "CustomRules")


@dataclass(frozen=True)
class CompareConfig:
    """How two tables are matched and when two cells count as equal.

    ``keys`` empty means: the column ``id`` if there is one, else every column.
    ``order_by`` lists the columns that rank several rows of one key; the row
    with the largest values is kept ("last wins").  Where it leaves a tie, a
    hash of the row decides, so that the choice is always repeatable.
    ``keys_unique`` / ``keys_not_null`` are promises by the caller that save the
    duplicate check and let bucketed tables join without a shuffle.
    """

    keys: Sequence[str] = ()
    ignore_columns: Sequence[str] = ()
    normalize_whitespace: bool = False
    case_insensitive: bool = False
    numeric_tolerance: float | None = None
    null_equals_empty: bool = False
    use_hash_mode: bool = False
    order_by: Sequence[str] = ()
    keys_unique: bool = False
    keys_not_null: bool = False


@dataclass(frozen=True)
class MigrationConfig:
    """What to do with the rows of a diff."""

    mode: str = "InsertUpdate"
    policy: str = "SourceWins"
    batch_size: int = 1000
    timestamp_column: str = "updated_at"
    rules: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}, expected one of {MODES}")
        if self.policy not in POLICIES:
            raise ValueError(f"unknown policy {self.policy!r}, expected one of {POLICIES}")
