"""Settings of a run: values, passed on, never changed in place."""

from dataclasses import dataclass

# The class names in order, and below the settings of a full-size run.
CLASS_NAMES = ("land", "reservoirs", "sea", "water-bodies")


@dataclass(frozen=True)
class Settings:
    n_chunks: int = 5000
    high_res: bool = True
    compositing: bool = True
    composite: str = "median"  # or mean
    n_images: int = 10
    epochs: int = 150
    learning_rate: float = 0.001
    dropout: float = 0.2
    batch: int = 256
    patch_side: int = 31
    seed: int = 123
    validation_share: float = 0.2
    confidence_threshold: float = 40.0
    max_label_rows: int | None = None  # of the labels that are evaluated; None: all
    river_buffer: float = 20.0  # map units of the raster: metres in UTM
    reservoir_buffer: float = 50.0

    def __post_init__(self):
        for name in ("n_chunks", "n_images", "epochs", "batch", "patch_side", "max_label_rows"):
            value = getattr(self, name)
            if not (value is None and name == "max_label_rows") and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"{name} must be a positive whole number, not {value!r}")
        if self.composite not in ("median", "mean"):
            raise ValueError(f"composite must be median or mean, not {self.composite!r}")
        for name in ("dropout", "validation_share"):
            if not 0 <= getattr(self, name) < 1:
                raise ValueError(f"{name} must be from 0 to below 1, not {getattr(self, name)!r}")
