"""Settings on the driver: YAML trees with dotted keys, per-persona overrides, and defaults."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The defaults that decide results.
DEFAULTS: dict[str, Any] = {
    "card.max_tokens": 500, "card.max_portrait_tokens": 5000,
    "retrieve.memory_count": 3, "retrieve.region_count": 5, "retrieve.fts_score": 0.6,
    "retrieve.threshold": 0.35, "retrieve.legacy_threshold": 0.55, "retrieve.fallback_threshold": 0.5,
    "review.dedup_threshold": 0.85, "review.buffer_max": 5, "review.staging_trigger": 10,
    "summary.min_df": 5, "summary.min_new": 3, "summary.cards": 50,
}


def merge(base: dict, over: dict) -> dict:
    """Deep merge; ``over`` wins."""
    return {**base, **{k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def flatten(tree: dict, at: str = "") -> dict[str, Any]:
    """Dotted keys; a leaf is a plain value or a mapping with ``value``."""
    out: dict[str, Any] = {}
    for k, v in tree.items():
        key = f"{at}.{k}" if at else str(k)
        if isinstance(v, dict) and "value" in v:
            out[key] = v["value"]
        elif isinstance(v, dict):
            out |= flatten(v, key)
        else:
            out[key] = v
    return out


class Settings:
    """get(key, persona_id): the persona's value, else the general one, else KeyError. Keys outside ``personal`` can't be overridden."""

    def __init__(self, general: dict | None = None, personas: dict[str, dict] | None = None, personal: set[str] | None = None):
        self.general = DEFAULTS | flatten(general or {})
        self.personas = {k: flatten(v) for k, v in (personas or {}).items()}
        self.personal = personal

    @classmethod
    def load(cls, path: str, personas: dict[str, str] | None = None) -> Settings:
        import yaml

        read = lambda p: yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {}
        return cls(read(path), {k: read(p) for k, p in (personas or {}).items()})

    def get(self, key: str, persona_id: str = "") -> Any:
        own = self.personas.get(persona_id, {})
        if key in own and (self.personal is None or key in self.personal):
            return own[key]
        if key not in self.general:
            raise KeyError(key)
        return self.general[key]

    def column(self, key: str, persona: str = "persona_id") -> Column:
        """The value that holds for the persona of each row."""
        general = F.lit(self.get(key))
        own = [F.lit(x) for p in self.personas if (v := self.get(key, p)) != self.get(key) for x in (p, v)]
        return F.coalesce(F.try_element_at(F.create_map(*own), F.col(persona)), general) if own else general

    def enabled(self, feature: str) -> bool:
        """Whether features.<feature> is on; what isn't set is on."""
        value = self.general.get(f"features.{feature}", True)
        return value if isinstance(value, bool) else str(value).strip().lower() not in ("0", "false")

    def missing(self) -> list[str]:
        return sorted(k for k, v in self.general.items() if v is None)
