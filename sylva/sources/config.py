"""Settings of a run: a frozen value that is passed along, not a process-wide object."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class RunConfig:
    """Names and defaults of the settings. Those without a default in the field are required."""

    image_directory: str
    height_data_path: str
    image_regex: str = r"(\d+)\.tif"
    height_data_regex: str = r"(\d+)\.tif"
    combined_model: str | None = None
    urban_model: str | None = None
    forrest_model: str | None = None
    forrest_outline: str | None = None
    output_directory: str = "./output"
    tiles_path: str = "./tiles"
    tile_width: int = 50
    tile_height: int = 50
    buffer: int = 20
    batch_size: int = 10
    use_overlap: bool = True
    overlapping_tiles_width: int = 3
    overlapping_tiles_height: int = 3
    iou_threshold: float = 0.5
    area_threshold: float = 1.0
    confidence_threshold: float = 0.3
    containment_threshold: float = 0.9
    height_threshold: float = 3.0
    ndvi_mean_threshold: float = 0.1
    ndvi_var_threshold: float = 0.1
    ndvi_scaling_factor: float = 0.2
    height_scaling_factor: float = 1.0
    simplify_tolerance: float = 0.2
    exclude_files: tuple[str, ...] = ()
    keep_intermediate: bool = False
    timestamped_output_directory: bool = False
    crs: int = 25832

    def __post_init__(self) -> None:
        dual = self.urban_model and self.forrest_model and self.forrest_outline
        if not self.combined_model and not dual:
            raise ValueError("name combined_model, or urban_model, forrest_model and forrest_outline")

    @property
    def dual(self) -> bool:
        return bool(self.urban_model and self.forrest_model and self.forrest_outline)


def load_config(path: str) -> RunConfig:
    """From a JSON file, or a YAML file where a YAML reader is installed. Unknown names are errors."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise ValueError("reading YAML needs a YAML reader; use JSON") from error
        values = yaml.safe_load(text)
    unknown = set(values) - {f.name for f in fields(RunConfig)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return RunConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
