"""Settings of an analysis, checked on construction."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from ..errors import InvalidConfigurationError

DISTRIBUTION_TESTS = ("shapiro", "ks", "anderson", "dagostino")
SAMPLING_METHODS = ("random", "stratified", "systematic", "adaptive")
CACHE_BACKENDS = ("memory", "disk")
OUTPUT_FORMATS = ("json", "html", "pdf")
OUTLIER_METHODS = ("iqr", "zscore", "modified_zscore", "isolation_forest", "lof", "all")


@dataclass(frozen=True)
class EDAConfig:
    correlation_threshold: float = 0.7
    missing_threshold: float = 0.1
    significance_level: float = 0.05
    confidence_level: float = 0.95
    outlier_method: str = "iqr"
    outlier_contamination: float = 0.1
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    modified_zscore_threshold: float = 3.5
    high_cardinality: int = 50
    max_categories: int = 50
    min_cardinality: int = 100
    normality_tests: bool = True
    #: The test whose p-value decides a column's normality; "majority" lets all vote.
    distribution_test_method: str = "majority"
    include_visualizations: bool = True
    n_samples_viz: int = 10_000
    sample_rows: int = 0
    #: Of percentiles: exact in one buffer a column, approx by a sketch, ranged exact at any size.
    accuracy: str = "exact"
    random_state: int = 42
    #: Tables of more rows are sampled before an analysis; off, as Spark reads whole tables.
    enable_auto_sampling: bool = False
    auto_sample_threshold: int = 100_000
    sampling_method: str = "random"
    #: Results are kept by the table's plan and the settings.
    enable_cache: bool = False
    cache_backend: str = "memory"
    cache_dir: str = "./.plumbline_cache"
    cache_max_size: int = 100
    cache_max_size_mb: float = 500.0
    cache_ttl: float | None = None
    #: A finished analysis is written to the folder.
    save_results: bool = False
    output_dir: str = "./eda_results"
    output_format: str = "json"
    custom_params: dict = field(default_factory=dict)
    verbose: bool = False

    def __post_init__(self) -> None:
        problems = [n for n in ("correlation_threshold", "missing_threshold") if not 0 <= getattr(self, n) <= 1]
        problems += [n for n in ("significance_level", "confidence_level") if not 0 < getattr(self, n) < 1]
        problems += [n for n in ("iqr_multiplier", "zscore_threshold", "modified_zscore_threshold", "high_cardinality", "max_categories", "min_cardinality", "n_samples_viz", "auto_sample_threshold", "cache_max_size", "cache_max_size_mb") if getattr(self, n) <= 0]
        chosen = {"distribution_test_method": ("majority", *DISTRIBUTION_TESTS), "sampling_method": SAMPLING_METHODS, "cache_backend": CACHE_BACKENDS, "output_format": OUTPUT_FORMATS}
        problems += [n for n, allowed in chosen.items() if getattr(self, n) not in allowed]
        if self.cache_ttl is not None and self.cache_ttl <= 0:
            problems.append("cache_ttl")
        if not 0 < self.outlier_contamination <= 0.5:
            problems.append("outlier_contamination")
        if self.outlier_method not in OUTLIER_METHODS:
            problems.append("outlier_method")
        if self.accuracy not in ("exact", "approx", "ranged"):
            problems.append("accuracy")
        if self.sample_rows < 0:
            problems.append("sample_rows")
        if problems:
            raise InvalidConfigurationError("invalid settings", {n: getattr(self, n) for n in problems})

    @classmethod
    def from_dict(cls, values: dict, strict: bool = False) -> EDAConfig:
        """Unknown keys are dropped, or an error if strict."""
        known = {f.name for f in fields(cls)}
        if strict and (unknown := sorted(set(values) - known)):
            raise InvalidConfigurationError("unknown settings", {"keys": unknown})
        return cls(**{k: v for k, v in values.items() if k in known})

    @classmethod
    def from_json(cls, path: str, strict: bool = False) -> EDAConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f), strict)

    @classmethod
    def from_session(cls, spark) -> EDAConfig:
        """Settings from spark.conf keys eda.<name>."""
        values = {}
        for f in fields(cls):
            text = spark.conf.get(f"eda.{f.name}", None)
            if text is not None and f.name != "custom_params":
                kind = float if f.default is None else type(f.default)
                values[f.name] = text.lower() == "true" if isinstance(f.default, bool) else kind(text)
        return cls(**values)

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self, path: str, indent: int = 2) -> None:
        """Writes the settings; folders on the way are made."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=indent)

    def update(self, **changes) -> EDAConfig:
        return replace(self, **changes)

    copy = update

    def summary(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.to_dict().items())


PRESETS = {
    "default": {}, "quick": {"normality_tests": False, "include_visualizations": False, "n_samples_viz": 1_000},
    "thorough": {"correlation_threshold": 0.5, "missing_threshold": 0.05, "outlier_method": "isolation_forest", "n_samples_viz": 50_000},
    "large": {"accuracy": "approx", "sample_rows": 50_000, "n_samples_viz": 5_000},
}


def preset(name: str) -> EDAConfig:
    if name not in PRESETS:
        raise InvalidConfigurationError("unknown preset", {"name": name}, [f"one of {', '.join(PRESETS)}"])
    return EDAConfig(**PRESETS[name])
