"""Dataset hubs: the port, and the adapter that needs two optional packages."""

from __future__ import annotations

import importlib
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any, Protocol

from corploom.errors import MissingDependencyError, RevisionResolutionError


@dataclass(frozen=True, slots=True)
class DatasetRequest:
    dataset: str
    config: str | None
    split: str
    revision: str | None


class DatasetHub(Protocol):
    def resolve_revision(self, dataset: str, revision: str | None) -> str: ...

    def stream_rows(self, request: DatasetRequest) -> Iterable[dict[str, Any]]: ...


def optional(module: str) -> Any:
    try:
        return importlib.import_module(module)
    except ImportError:
        raise MissingDependencyError(f"{module} is not installed; dataset hubs need it") from None


class HuggingFaceHub:
    """Reads public datasets through `datasets` and `huggingface_hub`."""

    def resolve_revision(self, dataset: str, revision: str | None) -> str:
        api = optional("huggingface_hub").HfApi()
        try:
            return str(api.dataset_info(dataset, revision=revision).sha)
        except Exception as e:  # no network, no such dataset, no access
            raise RevisionResolutionError(f"{dataset}@{revision}: {e}") from e

    def stream_rows(self, request: DatasetRequest) -> Iterable[dict[str, Any]]:
        load = optional("datasets").load_dataset
        return load(request.dataset, request.config, split=request.split, revision=request.revision, streaming=True)
