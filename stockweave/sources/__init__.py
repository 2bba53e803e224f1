"""File sources: discovery, layout detection and loading."""

from .files import Layout, find_files, layout_of, read_files
from .loaders import load_devices, load_fact, load_movements, load_warehouses, rejected_lines

__all__ = [
    "Layout", "find_files", "layout_of", "load_devices", "load_fact", "load_movements", "load_warehouses",
    "read_files", "rejected_lines",
]
