"""Scalar functions: Column in, Column out, all evaluated in the JVM."""

from .paths import backup_path, extension, file_name, normalised_extension, organized_path, parent, suffix
from .text import aperture_label, bias_label, decode, event_date, exif_timestamp, focal_label, gps_decimal, human_size, iso_label, parse_datetime, safe_float, safe_int, shutter_label, strip
from .images import area, aspect_ratio, resolution
from .binding import let

__all__ = [
    "aperture_label", "area", "aspect_ratio", "backup_path", "bias_label", "decode", "event_date", "exif_timestamp", "extension", "file_name", "focal_label",
    "gps_decimal", "human_size", "iso_label", "let", "normalised_extension", "organized_path", "parent", "parse_datetime", "resolution", "safe_float", "safe_int",
    "shutter_label", "strip", "suffix",
]
