"""What identifies a scorer: model, backend, template and the scoring contract, hashed canonically; and the runtime it ran on."""

from __future__ import annotations

import platform
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from ..schema import ContractError
from .prompts import LABELS, cyclic_orders, require_sha256, sha256

CONTRACT = "equal-bias-cyclic-labels-v1"
#: Added to every label's logit, so that the others have no mass left.
LABEL_BIAS = 100.0
MOST_WORKERS = 64
RUNTIME_FIELDS = ("python", "implementation", "system", "machine", "packages")


@dataclass(frozen=True)
class Fingerprint:
    """A served model: nothing of it may differ between runs that share answers."""

    backend_version: str
    backend_revision: str
    model_repository: str
    model_revision: str
    file_name: str
    file_sha256: str
    quantization: str
    template_sha256: str
    token_ids: tuple[int, ...]

    def __post_init__(self) -> None:
        for name in ("backend_version", "backend_revision", "model_repository", "model_revision", "file_name", "quantization"):
            value = getattr(self, name)
            if not isinstance(value, str) or not value or value != value.strip():
                raise ContractError(f"{name} must be text without blanks at its ends")
        if self.backend_revision not in self.backend_version:
            raise ContractError("the backend's version must hold its revision")
        if "/" in self.file_name or "\\" in self.file_name or not self.file_name.lower().endswith(".gguf"):
            raise ContractError("the model file is a plain .gguf name")
        require_sha256(self.file_sha256, "file_sha256")
        require_sha256(self.template_sha256, "template_sha256")
        ids = self.token_ids
        if len(ids) != len(LABELS) or len(set(ids)) != len(ids) or any(isinstance(i, bool) or not isinstance(i, int) or i < 0 for i in ids):
            raise ContractError("every label needs a token of its own")


def identity(fingerprint: Fingerprint, cache_prompt: bool = False, workers: int = 1) -> dict:
    """All that decides a score, as nested values."""
    if not isinstance(cache_prompt, bool) or isinstance(workers, bool) or not 1 <= workers <= MOST_WORKERS:
        raise ContractError(f"cache_prompt must be a flag, workers lie between 1 and {MOST_WORKERS}")
    return {"contract": CONTRACT, **asdict(fingerprint), "token_ids": list(fingerprint.token_ids), "labels": list(LABELS), "label_bias": LABEL_BIAS,
            "orders": [list(o) for o in cyclic_orders()], "cache_prompt": cache_prompt, "workers": workers}


def identity_sha256(fingerprint: Fingerprint, cache_prompt: bool = False, workers: int = 1) -> str:
    return sha256(identity(fingerprint, cache_prompt, workers))


def runtime_provenance(packages: tuple[str, ...] = ("numpy", "pandas", "pyarrow", "pyspark")) -> dict:
    """Interpreter, machine and versions of packages, with a digest of them all."""
    from importlib import metadata

    versions = {}
    for name in packages:
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = None
    found = {"python": platform.python_version(), "implementation": platform.python_implementation(), "system": platform.system(), "machine": platform.machine(), "packages": versions}
    return {**found, "sha256": sha256(found)}


def require_provenance(value: Mapping) -> None:
    """Raises unless the value has exactly the fields of runtime_provenance and its digest is theirs."""
    if not isinstance(value, Mapping) or set(value) != {*RUNTIME_FIELDS, "sha256"}:
        raise ContractError(f"provenance has exactly {', '.join(RUNTIME_FIELDS)} and sha256")
    if not isinstance(value["packages"], Mapping) or any(not isinstance(value[k], str) or not value[k] for k in RUNTIME_FIELDS[:4]):
        raise ContractError("provenance needs text and a mapping of packages")
    if value["sha256"] != sha256({k: value[k] for k in RUNTIME_FIELDS}):
        raise ContractError("the provenance's digest is not that of its fields")
