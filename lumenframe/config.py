"""Validated settings, read from YAML with environment variables expanded."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

#: Extensions by kind of file.
RAW = ["nef", "cr3", "cr2", "arw", "dng", "orf", "raf", "rw2"]
JPEG = ["jpg", "jpeg", "heic", "heif"]
VIDEO = ["mp4", "mov", "avi", "mkv"]
SEARCHED = ("./ingest.yaml", "~/.lumenframe.yaml")


class ConfigurationError(Exception):
    """The settings can't be read or don't hold."""


def expand(text: str) -> str:
    """``${NAME}`` and ``$NAME`` by their values; unknown names stay."""
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: os.environ.get(m[1] or m[2], m[0]), text)


def _need(holds: Any, message: str) -> None:
    if not holds:
        raise ValueError(message)


@dataclass
class DeviceMapping:
    mappings: dict[str, str] = field(default_factory=dict)
    exif_identifiers: dict[str, dict[str, str]] = field(default_factory=dict)
    priority_rules: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for model, folder in self.mappings.items():
            _need(model.strip() and folder.strip(), "a mapping needs a camera model and a folder")
        for code, tags in self.exif_identifiers.items():
            _need(code.strip() and tags, f"device {code!r} needs a code and at least one identifier")
            _need(all(k.strip() and v.strip() for k, v in tags.items()), f"identifiers of device {code!r} need a field and a value")


@dataclass
class FileTypes:
    raw: list[str] = field(default_factory=lambda: list(RAW))
    jpeg: list[str] = field(default_factory=lambda: list(JPEG))
    video: list[str] = field(default_factory=lambda: list(VIDEO))

    def __post_init__(self) -> None:
        for kind in ("raw", "jpeg", "video"):
            bare = [x.strip().lower() for x in getattr(self, kind)]
            _need(bare and all(bare), f"{kind} needs extensions that aren't empty")
            setattr(self, kind, [x[1:] if x.startswith(".") else x for x in bare])

    def all_extensions(self) -> list[str]:
        return self.raw + self.jpeg + self.video


@dataclass
class LLMConfig:
    """Settings of a language model that a describer (``analyze --describe``) may read; the library calls none.

    The provider, its address and the bounds are fixed values.
    """

    enabled: bool = False
    provider: str = "ollama"
    endpoint: str = "http://localhost:11434/api/generate"
    model: str = "llama3.1:8b"
    vision_model: str = "llava:7b"
    prompt_template: str | None = None
    retry_attempts: int = 3
    retry_delay: float = 1.0

    def __post_init__(self) -> None:
        _need(self.provider == "ollama", f"unsupported provider {self.provider!r}")
        _need(self.retry_attempts >= 0 and self.retry_delay >= 0, "retries and their delay can't be negative")


@dataclass
class PeekConfig:
    enabled: bool = True
    include_exif_summary: bool = True
    include_visual_analysis: bool = False
    sample_count: int = 5
    max_resolution: int = 1024
    supported_formats: list[str] = field(default_factory=lambda: ["jpg", "jpeg", "heic", "nef", "cr3", "dng"])
    vision_prompt: str = "Describe the photo's subject, style, setting and notable elements in two or three sentences."

    def __post_init__(self) -> None:
        _need(self.sample_count > 0, "sample_count must be positive")
        _need(256 <= self.max_resolution <= 4096, "max_resolution must lie between 256 and 4096")


@dataclass
class RawBackupConfig:
    enabled: bool = False
    backup_root: str = "${HOME}/Photos/RawBackups"
    preserve_structure: bool = True
    timestamp_format: str = "%Y-%m-%d_%H%M%S"

    def __post_init__(self) -> None:
        self.backup_root = expand(self.backup_root)
        datetime.now().strftime(self.timestamp_format)


@dataclass
class PerformanceConfig:
    """``batch_size`` and ``memory_mapped_hashing`` are accepted and have no effect: Spark deals the rows, and files are hashed as they are read."""

    parallel_workers: int = 4
    batch_size: int = 100
    cache_exif: bool = True
    incremental_processing: bool = True
    memory_mapped_hashing: bool = True

    def __post_init__(self) -> None:
        _need(self.parallel_workers > 0 and self.batch_size > 0, "parallel_workers and batch_size must be positive")


@dataclass
class IngestConfig:
    archive_root: str
    raw_backup: RawBackupConfig = field(default_factory=RawBackupConfig)
    devices: DeviceMapping = field(default_factory=DeviceMapping)
    file_types: FileTypes = field(default_factory=FileTypes)
    llm: LLMConfig = field(default_factory=LLMConfig)
    peek: PeekConfig = field(default_factory=PeekConfig)
    dedupe_store: str = ".hashes.sqlite"
    performance: PerformanceConfig = field(default_factory=PerformanceConfig)

    def __post_init__(self) -> None:
        self.archive_root, self.dedupe_store = expand(self.archive_root), expand(self.dedupe_store)
        _need(self.archive_root, "archive_root can't be empty")
        _need(self.llm.enabled or not self.peek.include_visual_analysis, "visual analysis needs the language model to be enabled")


def build(kind: type, values: dict[str, Any]) -> Any:
    """A settings object from nested dictionaries; unknown keys are ignored."""
    known = {f.name: f for f in fields(kind)}
    parts = {"raw_backup": RawBackupConfig, "devices": DeviceMapping, "file_types": FileTypes, "llm": LLMConfig, "peek": PeekConfig, "performance": PerformanceConfig}
    return kind(**{k: build(parts[k], v or {}) if kind is IngestConfig and k in parts else v for k, v in values.items() if k in known})


def load(path: str | Path | None = None) -> IngestConfig:
    """Settings of ``path``, or of the first searched place that exists."""
    import yaml

    places = [Path(path).expanduser()] if path else [Path(x).expanduser() for x in SEARCHED]
    found = next((p for p in places if p.exists()), None)
    if found is None:
        raise ConfigurationError("no settings found in " + ", ".join(map(str, places)))
    try:
        values = yaml.safe_load(expand(found.read_text(encoding="utf-8")))
        _need(isinstance(values, dict), "the file holds no settings")
        return build(IngestConfig, values)
    except (OSError, TypeError, ValueError, AttributeError, yaml.YAMLError) as e:
        raise ConfigurationError(f"{found}: {e}") from e


def _plain(value: Any) -> Any:
    return {f.name: _plain(getattr(value, f.name)) for f in fields(value)} if is_dataclass(value) else value


def write_example(path: str | Path) -> None:
    """A settings file with defaults and three devices."""
    import yaml

    devices = DeviceMapping(
        {"PENTAX K-3": "Studio", "RICOH GR III": "Pocket"},
        {"Studio": {"Make": "RICOH IMAGING", "Model": "PENTAX K-3"}, "Helmet": {"Make": "GoPro"}},
        ["Studio", "Pocket", "Helmet"],
    )
    values = _plain(IngestConfig("archive", devices=devices)) | {"archive_root": "${HOME}/Photos/Archive"}
    values["raw_backup"]["backup_root"] = "${HOME}/Photos/RawBackups"
    Path(path).write_text(yaml.safe_dump(values, sort_keys=False), encoding="utf-8")


def unique_backup_directory(root: str | Path, layout: str = "%Y-%m-%d_%H%M%S", now: datetime | None = None) -> Path:
    """A directory named by the time, with _01 to _99 where that exists."""
    first = Path(root) / (now or datetime.now()).strftime(layout)
    for place in [first, *(first.with_name(f"{first.name}_{k:02d}") for k in range(1, 100))]:
        if not place.exists():
            return place
    raise RuntimeError(f"no free name for a backup below {root}")


def check_source(path: str | Path) -> tuple[bool, str]:
    """Whether a directory can be scanned, and the first thing that is wrong with it."""
    p = Path(path)
    if not p.exists():
        return False, f"{p} does not exist"
    if not p.is_dir():
        return False, f"{p} is not a directory"
    if not os.access(p, os.R_OK):
        return False, f"{p} can't be read"
    if next(p.iterdir(), None) is None:
        return False, f"{p} is empty"
    return True, ""


def permissions(path: str | Path) -> dict[str, bool]:
    p = Path(path)
    return {"exists": p.exists(), "is_directory": p.is_dir(), "readable": os.access(p, os.R_OK), "writable": os.access(p, os.W_OK), "executable": os.access(p, os.X_OK)}
