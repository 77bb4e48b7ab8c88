"""Run settings (S5, K8): JSON in and out, with the precedence of explicit arguments (Q5)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from ..operators.filters import FilterSpec

_RENAMED = {"is_electric": "electric_only"}


@dataclass(frozen=True)
class RunSpec:
    """A filter and where its result goes."""

    filter: FilterSpec = field(default_factory=FilterSpec)
    output_path: str = "cars.csv"
    output_format: str = "auto"
    sites: tuple[str, ...] | None = None
    all_sites: bool = True
    log_level: str = "INFO"
    log_file: str | None = None

    @classmethod
    def from_dict(cls, values: dict | None = None, **explicit) -> RunSpec:
        """Unknown keys are ignored, missing ones take their defaults, explicit ones win."""
        values = {**(values or {}), **{k: v for k, v in explicit.items() if v is not None}}
        wanted = {name: values[_RENAMED.get(name, name)] for name in FilterSpec.names() if _RENAMED.get(name, name) in values}
        own = {f.name: values[f.name] for f in fields(cls) if f.name != "filter" and f.name in values}
        return cls(filter=FilterSpec(**wanted), **own)

    @classmethod
    def from_file(cls, path: str, **explicit) -> RunSpec:
        """FileNotFoundError without the file, ValueError if it is no JSON object."""
        text = Path(path).read_text(encoding="utf-8")
        try:
            values = json.loads(text)
        except json.JSONDecodeError as error:
            raise ValueError(f"{path} is not JSON: {error}") from error
        if not isinstance(values, dict):
            raise ValueError(f"{path} holds no JSON object")
        return cls.from_dict(values, **explicit)

    def to_dict(self) -> dict:
        out = {_RENAMED.get(k, k): v for k, v in asdict(self.filter).items()}
        for name in ("exclude_makes", "exclude_models", "exclude_drivetrains", "exclude_dealers"):
            out[name] = list(out[name] or ())
        out["exclude_status"] = ["sold"] if out["exclude_status"] is None else list(out["exclude_status"])
        return out | {f.name: getattr(self, f.name) for f in fields(self) if f.name != "filter"}

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, ensure_ascii=False), encoding="utf-8")
