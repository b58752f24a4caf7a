"""What a question is parsed to; the executor turns it into one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Question:
    kind: str  # natural_language or sql
    original: str
    types: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    filters: dict[str, str] = field(default_factory=dict)
    period: tuple[str, tuple[str, ...]] | None = None
    limit: int | None = None
    conditions: tuple[tuple[str, str, object], ...] = ()
    select: tuple[str, ...] = ("*",)
    order_by: tuple[tuple[str, bool], ...] = ()
    table: str = "multimodal_data"


def from_dict(held: dict) -> Question:
    """A question given as a dictionary; unknown keys are an error."""
    held = dict(held)
    held.setdefault("kind", held.pop("type", "natural_language"))
    held.setdefault("original", held.pop("original_query", ""))
    names = {"data_types": "types", "semantic_conditions": "terms", "from_table": "table", "select_fields": "select", "where_conditions": "conditions"}
    made = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in held.items()}
    if "time_range" in made:
        t = made.pop("time_range")
        made["period"] = (t["type"], tuple(t["value"]) if not isinstance(t["value"], str) else ()) if t else None
    if isinstance(made.get("filters"), (list, tuple)):
        made["filters"] = {f["type"]: f["value"] for f in made["filters"]}
    return Question(**made)
