"""Settings as an immutable value that is passed on, never a global."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from strandworks.errors import ConfigError


@dataclass(frozen=True)
class Config:
    """Defaults of the operators; :meth:`update_with` returns a changed copy."""

    ligand_min_atoms: int = 6
    ligand_min_atom_connections: int = 5
    ligand_min_res_connections: int = 3
    polymer_min_residues: int = 2
    primary_polymer: str = "auto"
    contact_cutoff: float = 5.0
    interface_cutoff: float = 6.0
    structure_format: str = "mmcif"
    unknown_chain: str = "X"
    unknown_structure: str = "XXXX"
    extra: dict[str, Any] = field(default_factory=dict)

    def update_with(self, values: dict[str, Any]) -> Config:
        """A copy with the known keys changed; unknown keys are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known})

    def validate(self, required: tuple[str, ...] = ()) -> Config:
        empty = [k for k in required if getattr(self, k, None) is None]
        if empty:
            raise ConfigError(f"no value for {', '.join(empty)}")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str, sort_keys=True)

    @classmethod
    def layered(cls, *texts: str) -> Config:
        """Defaults overridden by JSON texts in turn: package, then user."""
        out = cls()
        for t in texts:
            out = out.update_with(json.loads(t))
        return out


@dataclass(frozen=True)
class ConstructorConfig:
    """Settings of a constructor: batch size, what a failure does, where things lie."""

    output: str | None = None
    batch_size: int = 1000
    stop_on_failure: bool = True
    structure_format: str = "mmcif"
    kinds: tuple[str, ...] = ("sequence", "structure", "mapping")

    def validate(self) -> ConstructorConfig:
        """Raises where a setting without a default is missing or out of range."""
        if self.output is None:
            raise ConfigError("no value for output")
        if self.batch_size < 1:
            raise ConfigError("batch_size must be positive")
        return self

    def paths(self) -> dict[str, str]:
        """The folders of a collection below its output."""
        base = self.validate().output.rstrip("/")
        return {"output": base, "sequence_files": f"{base}/sequences", "structure_files": f"{base}/structures", "mapping_files": f"{base}/mappings"}


@contextmanager
def quiet(level: int = logging.CRITICAL) -> Iterator[None]:
    """No log records up to ``level`` inside the block."""
    before = logging.root.manager.disable
    logging.disable(level)
    try:
        yield
    finally:
        logging.disable(before)
