"""Reports from the one-row analysis, rendered on the driver."""

from __future__ import annotations

import json
from typing import Any

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(size: float, cap: str = "TB") -> str:
    k = 0
    while size >= 1024 and UNITS[k] != cap:
        size, k = size / 1024, k + 1
    return f"{size:.1f} {UNITS[k]}"


def ordered(counts: dict[str, int] | None) -> list[tuple[str, int]]:
    return sorted((counts or {}).items(), key=lambda x: -x[1])


def as_dict(row: Any) -> dict[str, Any]:
    """A report row as plain values."""
    return row if isinstance(row, dict) else row.asDict(recursive=True)


def as_json(row: Any) -> str:
    return json.dumps(as_dict(row), indent=2, default=str, ensure_ascii=False)


def _range(r: dict, name: str, form: str = "{}") -> str | None:
    lo, hi = r.get(f"{name}_min"), r.get(f"{name}_max")
    if lo is None:
        return None
    lo, hi = form.format(lo), form.format(hi)
    return lo if lo == hi else f"{lo} to {hi}"


def _percent(n: int, of: int) -> str:
    return f"{100 * n / of:.0f} %" if of else "-"


def _table(title: str, rows: list[tuple[str, ...]]) -> list[str]:
    """A titled list whose columns are as wide as they need to be; nothing without rows."""
    if not rows:
        return []
    widths = [max(len(row[k]) for row in rows) for k in range(len(rows[0]))]
    return ["", f"# {title}", *("  ".join([row[0].ljust(widths[0]), *(cell.rjust(w) for cell, w in zip(row[1:], widths[1:]))]).rstrip() for row in rows)]


def _counted(counts: dict[str, int] | None, of: int) -> list[tuple[str, ...]]:
    return [(name, str(n), _percent(n, of)) for name, n in ordered(counts)]


def _leading(pairs: list[dict] | None) -> str:
    return "; ".join(f"{x['n']} x {x['label']}" for x in pairs or []) or "-"


def human_readable(row: Any, detailed: bool = True) -> str:
    """The long text report."""
    r = as_dict(row)
    n = r["image_files_analyzed"]
    facts = [("files", f"{r['total_files']}, {human_size(r['total_size'])}"), ("with metadata", str(n)), ("taken", _range(r, "date"))]
    facts += [(what, f"{r[key]} ({_percent(r[key], n)})" if r[key] else None) for what, key in (("located", "files_with_gps"), ("with an author", "files_with_artist"), ("with a copyright", "files_with_copyright"))]
    lines = ["# Library", *(f"{what}: {text}" for what, text in facts if text)]
    lines += _table("By kind", [(kind, str(r["files_by_type"][kind]), human_size(r["size_by_type"].get(kind, 0))) for kind in sorted(r["files_by_type"]) if r["files_by_type"][kind]])
    lines += _table("Bodies", _counted(r["cameras"], n)) + _table("Glass", _counted(r["lenses"], n))
    lines += _table("Glass by maker", _counted(r["lens_makes"], n)) if detailed else []
    exposure = []
    for what, name, form, tops in (("aperture", "aperture", "f/{:g}", "most_used_apertures"), ("sensitivity", "iso", "ISO {}", "most_used_isos"), ("focal length", "focal", "{:g} mm", "most_used_focal_lengths")):
        if found := _range(r, name, form):
            exposure.append(f"{what}: {found}, mostly {_leading(r[tops])}")
    if r["common_shutter_speeds"]:
        exposure.append(f"shutter: mostly {_leading(r['common_shutter_speeds'])}")
    if detailed and r["exposure_compensation"]:
        exposure.append("compensation: " + "; ".join(f"{count} x {text}" for text, count in ordered(r["exposure_compensation"])[:5]))
    lines += ["", "# Exposure", *exposure] if exposure else []
    if detailed:
        for title, key in (("Programs", "exposure_programs"), ("Metering", "metering_modes"), ("Flash", "flash_usage")):
            lines += _table(title, _counted(r[key], n))
        lines += _table("Sizes in pixels, largest first", _pixels(r["resolutions"] or {}))
    return "\n".join(lines)


def _pixels(counts: dict[str, int], limit: int = 10) -> list[tuple[str, ...]]:
    """The largest sizes: text, megapixels, ratio of the sides, number and share."""
    from math import gcd

    rows, whole = [], sum(counts.values())
    for text, n in counts.items():
        sides = [int(x) if x.isdigit() else 0 for x in text.split("x")] + [0, 0]
        w, h = sides[:2]
        d = gcd(w, h) or 1
        rows.append((w * h, (text, f"{w * h / 1e6:.1f} MP", f"{w // d}:{h // d}", str(n), _percent(n, whole))))
    return [cells for _, cells in sorted(rows, key=lambda x: -x[0])[:limit]]


def one_line(row: Any) -> str:
    r = as_dict(row)
    first = lambda key: f"{ordered(r[key])[0][0]} ({ordered(r[key])[0][1]})" if r[key] else None
    parts = [f"{r['total_files']} files, {human_size(r['total_size'])}", f"{r['image_files_analyzed']} with metadata", _range(r, "date"), first("cameras"), first("lenses"), _range(r, "aperture", "f/{:g}"), _range(r, "iso", "ISO {}"), _range(r, "focal", "{:g} mm")]
    return "; ".join(x for x in parts if x)


def plain(row: Any) -> str:
    """The short text report."""
    r = as_dict(row)
    facts = [("files", f"{r['total_files']:,}"), ("size", human_size(r["total_size"], "PB")), ("with metadata", f"{r['image_files_analyzed']:,}"), ("taken", _range(r, "date")), ("aperture", _range(r, "aperture", "f/{:g}")), ("sensitivity", _range(r, "iso", "ISO {}")), ("located", f"{r['files_with_gps']:,}" if r["files_with_gps"] else None)]
    lines = [f"{what}: {text}" for what, text in facts if text]
    for title, key, limit in (("Bodies", "cameras", None), ("Glass", "lenses", 5)):
        lines += _table(title, [(name, f"{n:,}") for name, n in ordered(r[key])[:limit]])
    return "\n".join(lines)


def plan_text(counts: Any, devices: list[tuple[str, int]], sample: list[Any], dry_run: bool) -> str:
    """Totals, files by device, and the first planned operations."""
    c = as_dict(counts)
    rows = [("files", c["total_files"]), ("new", c["new_files"]), ("known already", c["duplicates"]), ("backup alone", c["raw_only"]), ("archive alone", c["organized_only"]), ("backup and archive", c["both"])]
    lines = ["# What would be done" if dry_run else "# What is to be done", *(f"{what}: {n:,}" for what, n in rows if n)]
    lines += _table("By device", [(name, f"{n:,}") for name, n in devices])
    name = lambda p: (p or "-").rsplit("/", 1)[-1]
    lines += _table("First files", [(name(x["source_path"]), f"to {name(x['dest_path'] or x['raw_backup_path'])}", x["status"]) for x in sample[:5]])
    return "\n".join(lines + ([f"and {c['total_files'] - 5:,} more"] if c["total_files"] > 5 else []))


def result_text(outcome: Any) -> str:
    r = as_dict(outcome)
    rows = [("planned", r["files_processed"]), ("copied", r["files_copied"]), ("moved", r["files_moved"]), ("left out", r["files_skipped"]), ("backed up", r["files_backed_up"])]
    lines = ["# What was done", *(f"{what}: {n:,}" for what, n in rows if n), f"size of the backup: {human_size(r['backup_size'], 'PB')}"]
    return "\n".join(lines + ([f"errors: {r['error_count']:,}, listed in the run's tables"] if r["error_count"] else []))


def peek_text(samples: list[Any]) -> str:
    """A line a sampled file, with what a describer said of it below."""
    lines = ["# Samples"]
    for x in map(as_dict, samples):
        facts = [x["file_type"], human_size(x["size"]), x["camera"], x["taken"]]
        lines += [f"{x['path'].rsplit('/', 1)[-1]}: {', '.join(f for f in facts if f)}", *([f"  {x['note']}"] if x["note"] else [])]
    return "\n".join(lines)
