"""Settings of a segmentation run: fixed values of the workload, presets, and what a tile may override."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """The defaults of the workload."""

    nucleus_diameter_vox: float = 15.0
    voxel_size: tuple[float, float, float] = (2.0, 0.5616, 0.528)
    threshold_mode: str = "percentile"
    target_foreground_percentile: float = 90.0
    background_floor_sigma: float = 1.5
    mask_smoothing_radius: int = 0
    mask_smoothing_closing: bool = True
    mask_bandpass_um: tuple[float, float] | None = None
    min_seed_distance: int = 17
    seed_prominence: float = 0.15
    seed_landscape_smooth_um: float = 0.0
    min_object_voxels: int = 100
    solidity_thresh: float = 0.15
    volume_zscore_thresh: float = 4.0
    min_volume_fraction_of_expected: float = 0.20
    max_volume_fraction_of_expected: float = 0.0
    accept_big_side_flags: bool = True
    max_extent_um: float = 60.0

    @property
    def expected_volume(self) -> float:
        return 4 / 3 * math.pi * (self.nucleus_diameter_vox / 2) ** 3

    def with_(self, **overrides) -> Settings:
        return replace(self, **overrides)

    def kernel(self) -> dict:
        """Arguments of ``kernels.segment``."""
        return {
            "spacing": self.voxel_size, "mode": self.threshold_mode, "percentile": self.target_foreground_percentile, "floor_k": self.background_floor_sigma, "min_distance": self.min_seed_distance,
            "prominence": self.seed_prominence, "smooth_um": self.seed_landscape_smooth_um, "bandpass_um": self.mask_bandpass_um, "min_voxels": self.min_object_voxels,
            "smoothing_radius": self.mask_smoothing_radius, "smoothing_closing": self.mask_smoothing_closing,
        }

    def screen(self) -> dict:
        """Arguments of ``objects.reasons``."""
        return {
            "expected": self.expected_volume, "z_limit": self.volume_zscore_thresh, "too_small": self.min_volume_fraction_of_expected, "too_big": self.max_volume_fraction_of_expected,
            "long_um": self.max_extent_um, "voxel": self.voxel_size, "solidity": self.solidity_thresh,
        }


#: Named settings for one kind of tissue each.
PRESETS = {"hippocampus": {"mask_bandpass_um": (2.0, 8.0), "target_foreground_percentile": 94.0, "min_seed_distance": 12, "seed_landscape_smooth_um": 1.0}}
