"""Projects as folders of YAML files: meta.yaml, sources/*.yaml, relations.yaml, outputs/*.yaml."""

from __future__ import annotations

import warnings
from pathlib import Path

from weft.errors import ProjectError
from weft.model import Project

FORMAT = "core1.0"
#: Root files that are accepted and not used.
IGNORED = ("variables.yaml", "defaults.yaml")


def _read(path: Path):
    import yaml

    try:
        return yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ProjectError("yaml", f"can't be read: {e}", str(path)) from e


def load(folder: str) -> Project:
    root = Path(folder)
    if not (root / "meta.yaml").is_file() or not (root / "sources").is_dir():
        raise ProjectError("project", "a project needs meta.yaml and a sources folder", folder)
    meta = _read(root / "meta.yaml") or {}
    if str(meta.get("format", "")).replace(" ", "").lower() != FORMAT:
        raise ProjectError("format", f"format must be {FORMAT}, not {meta.get('format')!r}", folder)
    relations = []
    for p in sorted(root.glob("*.yaml")):
        if p.name == "relations.yaml":
            relations = _read(p) or []
        elif p.name != "meta.yaml" and p.name not in IGNORED:
            warnings.warn(f"{p} is skipped", stacklevel=2)
    listed = {k: [_read(p) for p in sorted((root / k).glob("*.yaml"))] if (root / k).is_dir() else [] for k in ("sources", "outputs")}
    for s in listed["sources"]:
        if not isinstance(s, dict):
            raise ProjectError("yaml", "a source file holds one mapping", folder)
    return Project.of([s for s in listed["sources"] if s.get("active_flag", True)], relations, listed["outputs"])
