"""The outcome of a comparison. Field names of the JSON form are a contract."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rowlens.plans.options import allowed, parse_budget
from rowlens.plans.schema import SchemaDiff


@dataclass
class Result:
    schema: SchemaDiff
    left_rows: int = 0
    right_rows: int = 0
    added: int = 0
    removed: int = 0
    changed: int = 0
    unchanged: int = 0
    within_tolerance: int = 0
    aborted: bool = False
    partial_counts: bool = False
    abort_reason: str = ""
    comparison: str = ""
    masked: list[str] = field(default_factory=list)
    keyless: bool = False
    key: list[str] = field(default_factory=list)
    filter: str = ""
    files_pruned: int = 0
    column_stats: dict[str, dict] = field(default_factory=dict)
    dups_left: int = 0
    dups_right: int = 0
    dup_keys: int = 0
    dup_rows: int = 0
    added_examples: list[str] = field(default_factory=list)
    removed_examples: list[str] = field(default_factory=list)
    changed_examples: list[dict] = field(default_factory=list)
    dup_examples: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    rows: DataFrame | None = field(default=None, repr=False)

    @property
    def column_changes(self) -> dict[str, int]:
        return {c: s["changed"] for c, s in self.column_stats.items()}

    @property
    def rows_same(self) -> bool:
        return not (self.added or self.removed or self.changed or self.aborted)

    @property
    def same(self) -> bool:
        return self.schema.same and self.rows_same

    def exit_code(self, max_diff: str | None = None) -> int:
        """0 equal or within budget, 1 different."""
        if self.same:
            return 0
        if self.aborted or max_diff is None or not self.schema.same:
            return 1
        return int(self.added + self.removed + self.changed > allowed(parse_budget(max_diff), self.left_rows, self.right_rows))

    def fold(self, shared_rows: int) -> None:
        """Count rows of files that both sides share and that were not read."""
        compared = self.changed + self.unchanged + self.within_tolerance + shared_rows
        self.left_rows += shared_rows
        self.right_rows += shared_rows
        self.unchanged += shared_rows
        for s in self.column_stats.values():
            s["match_rate"] = 1 - s["changed"] / compared if compared else 1.0

    def as_dict(self) -> dict:
        always = ("left_rows", "right_rows", "added", "removed", "changed", "unchanged", "aborted", "partial_counts")
        out: dict = {"equal": self.same, "schema": self.schema.as_dict()}
        for name in (*always, "abort_reason", "comparison", "masked", "keyless", "filter", "files_pruned", "within_tolerance", "column_changes", "column_stats", "dups_left", "dups_right", "dup_keys", "dup_rows", "added_examples", "removed_examples", "changed_examples", "dup_examples"):
            if name in always or getattr(self, name):
                out[name] = getattr(self, name)
        return out

    def to_json(self) -> str:
        return json.dumps(self.as_dict(), indent=2, ensure_ascii=False)
