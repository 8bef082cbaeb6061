"""The whole analysis: a handful of fused jobs, each section isolated, insights derived from this run's sections."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError, DataValidationError, EDAError
from ..functions.columns import categorical_columns, column_class, normalize, numeric_columns
from ..operators import anomaly, correlation, descriptive, features, hypothesis, outliers, quality
from .config import EDAConfig
from .runtime import DiskCache, MemoryCache, ResultCache

VERSION = "0.1.0"


def records(df: DataFrame) -> list[dict]:
    """Rows of a small result as plain dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def by_column(df: DataFrame) -> dict[str, dict]:
    return {r.pop("column_name"): r for r in records(df)}


def section(run: Callable[[], dict]) -> dict:
    """A failing section reports its error; the others go on."""
    try:
        return run()
    except (EDAError, ValueError, ArithmeticError) as error:
        return {"error": str(error)}


class Analyzer:
    def __init__(self, config: EDAConfig | None = None):
        self.config, self.results, self.cache = config or EDAConfig(), {}, None
        if self.config.enable_cache:
            c = self.config
            backend = MemoryCache(c.cache_max_size, c.cache_ttl) if c.cache_backend == "memory" else DiskCache(c.cache_dir, int(c.cache_max_size_mb * (1 << 20)), c.cache_ttl)
            self.cache = ResultCache(backend)

    def analyze(self, df: DataFrame, quick: bool = False) -> dict:
        """Sections overview, statistics, quality, outliers, correlations, insights, metadata. quick leaves out normality tests and outliers."""
        if not isinstance(df, DataFrame) and not hasattr(df, "sparkSession"):
            raise DataValidationError("a Spark DataFrame is needed")
        if df.isEmpty():
            raise DataValidationError("the table is empty")
        settings = self.config.to_dict() | {"quick": quick}
        if self.cache is not None and (kept := self.cache.get(df, "analyze", settings)) is not None:
            self.results = kept
            return kept
        table, began, df = df, time.time(), self.sampled(normalize(df))
        out = {"overview": section(lambda: self.overview(df)), "statistics": section(lambda: self.statistics(df, quick)), "quality": section(lambda: self.quality(df))}
        if not quick:
            out["outliers"] = section(lambda: self.outliers(df))
        out["correlations"] = section(lambda: self.correlations(df))
        out["insights"] = self.insights(out)
        out["metadata"] = {"timestamp": datetime.now(UTC).isoformat(), "duration_seconds": time.time() - began, "version": VERSION, "config": self.config.to_dict()}
        self.results = out
        if self.cache is not None:
            self.cache.set(table, "analyze", out, settings)
        if self.config.save_results:
            from ..sources.report import write_report

            folder = Path(self.config.output_dir)
            folder.mkdir(parents=True, exist_ok=True)
            write_report(out, table, folder / f"results.{self.config.output_format}", self.config.output_format, title="Data report", include_visualizations=self.config.include_visualizations)
        return out

    def sampled(self, df: DataFrame) -> DataFrame:
        """The table, or a sample by the hash of its rows where the settings ask for one and it has more rows."""
        c = self.config
        if not c.enable_auto_sampling or df.limit(c.auto_sample_threshold + 1).count() <= c.auto_sample_threshold:
            return df
        keyed = df.withColumn("_row_hash", F.xxhash64(*df.columns))
        return features.smart_sample(keyed, ["_row_hash"], c.sample_rows or None, c.sampling_method)[0].drop("_row_hash")

    def overview(self, df: DataFrame) -> dict:
        return records(descriptive.overview(df))[0] | {"column_types": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "column_classes": {f.name: column_class(f) for f in df.schema.fields}}

    def statistics(self, df: DataFrame, quick: bool) -> dict:
        numbers, texts, out = numeric_columns(df), categorical_columns(df), {}
        if numbers:
            description = descriptive.describe_numeric(df, accuracy=self.config.accuracy).persist()
            out["descriptive"] = by_column(description)
            for r in descriptive.mean_interval(description, self.config.confidence_level):
                out["descriptive"][r["column_name"]] |= {"ci_lower": r["lower"], "ci_upper": r["upper"]}
            description.unpersist()
            out["distributions"] = by_column(descriptive.distributions(df))
            if not quick and self.config.normality_tests:
                out["normality_tests"] = {c: section(lambda c=c: self.normality(df, c)) for c in numbers}
        if texts:
            out["categorical"] = by_column(descriptive.categorical_profile(df))
            out["top_values"] = records(descriptive.value_counts(df, texts))
        described = out.get("descriptive", {})
        out["summary"] = {
            "numeric": len(numbers), "categorical": len(texts), "highly_variable": [c for c, r in described.items() if r["std"] is not None and r["mean"] is not None and r["std"] / (r["mean"] + 1e-10) > 1],
            "high_cardinality": [c for c, r in out.get("categorical", {}).items() if r["n_unique"] > self.config.high_cardinality],
        }
        return out

    def normality(self, df: DataFrame, column: str) -> dict:
        """All tests of a column; likely_normal is the vote, or the chosen test's own verdict where it was run."""
        found, method = hypothesis.normality(df, column, self.config.significance_level), self.config.distribution_test_method
        own = found.get(method)
        if own:
            found["likely_normal"] = own["a2"] < own["critical_5"] if method == "anderson" else own["p_value"] > self.config.significance_level
        return found

    def quality(self, df: DataFrame) -> dict:
        lost, duplicates, score = by_column(quality.missing(df, self.config.missing_threshold)), records(quality.duplicates(df))[0], records(quality.quality_score(df))[0]
        above = [c for c, r in lost.items() if r["above_threshold"]]
        rate = 100 - score["completeness"]
        return {
            "missing_values": {"columns": lost, "above_threshold": above, "rate": rate, "patterns": records(quality.row_completeness(df))[0], "recommendation": quality.missing_recommendation(rate, len(above))},
            "duplicates": duplicates | {"recommendation": quality.duplicate_recommendation(duplicates["duplicate_rate"])}, "data_types": records(quality.type_suggestions(df)),
            "consistency": records(quality.consistency_issues(df)), "cardinality": by_column(quality.cardinality(df, high=self.config.high_cardinality)), "quality_score": score,
        }

    def outliers(self, df: DataFrame) -> dict:
        if not numeric_columns(df):
            return {"message": "no numeric columns"}
        method, c = self.config.outlier_method, self.config
        limits = {"iqr": c.iqr_multiplier, "zscore": c.zscore_threshold, "modified_zscore": c.modified_zscore_threshold}
        chosen = [*limits, "isolation_forest"] if method == "all" else [method]
        found = {}
        for m in chosen:
            if m in limits:
                found[m] = by_column(outliers.outliers(df, m, limits[m], accuracy=c.accuracy))
            else:
                key = "_row_hash"
                rows = df.withColumn(key, F.xxhash64(*df.columns))
                scored = anomaly.METHODS[m](rows, [key], numeric_columns(df), c.outlier_contamination)
                found[m] = {"rows": records(scored.agg(F.count_if("is_anomaly").alias("outliers"), F.count(F.lit(1)).alias("n")))[0]}
        totals = {m: sum(r["outliers"] for r in rows.values()) for m, rows in found.items()}
        return {"method": method, "outliers": found, "summary": {"totals": totals, "columns_with_outliers": {m: [n for n, r in rows.items() if r["outliers"]] for m, rows in found.items()}}}

    def correlations(self, df: DataFrame) -> dict:
        if len(numeric_columns(df)) < 2:
            return {"message": "fewer than two numeric columns"}
        pearson = records(correlation.pearson(df))
        strong = [r | {"p_value": correlation.pair_p_value(r["r"], r["n"]), "direction": "positive" if r["r"] > 0 else "negative"} for r in pearson if r["r"] is not None and abs(r["r"]) >= self.config.correlation_threshold]
        strong.sort(key=lambda r: -abs(r["r"]))
        return {
            "correlation_matrix": {"pearson": pearson, "spearman": records(correlation.spearman(df)), "kendall": records(correlation.kendall(df))},
            "strong_correlations": {"threshold": self.config.correlation_threshold, "count": len(strong), "pairs": strong}, "multicollinearity": correlation.vif(df),
        }

    def insights(self, out: dict) -> dict:
        """Rules over this run's sections; empty groups are dropped."""
        over, score = out["overview"], out["quality"].get("quality_score", {})
        groups: dict[str, list[str]] = {"characteristics": [], "quality_issues": [], "statistics": [], "outliers": [], "correlations": [], "recommendations": []}
        if "rows" in over:
            groups["characteristics"].append(f"{over['rows']} rows and {over['columns']} columns, {over['numeric_columns']} of them numeric")
            if over["duplicate_rows"]:
                groups["quality_issues"].append(f"{over['duplicate_rows']} rows repeat an earlier one")
        complete = score.get("completeness", 100.0)
        if complete < 95:
            groups["quality_issues"].append(f"{'low' if complete < 80 else 'moderate'} completeness: {complete:.1f} per cent")
        above = out["quality"].get("missing_values", {}).get("above_threshold", [])
        if above:
            groups["quality_issues"].append("many values are missing in " + ", ".join(above[:5]))
            groups["recommendations"].append("impute or drop the columns with many missing values")
        varied = [c for c, r in out["statistics"].get("descriptive", {}).items() if r["cv"] is not None and abs(r["cv"]) > 100]
        if varied:
            groups["statistics"].append("highly variable: " + ", ".join(varied[:5]))
        for m, rows in out.get("outliers", {}).get("outliers", {}).items():
            many = [c for c, r in rows.items() if r.get("percentage", 0) > 5]
            if many:
                groups["outliers"].append(f"more than 5 per cent outliers ({m}) in " + ", ".join(many[:5]))
        strong = out["correlations"].get("strong_correlations", {})
        if strong.get("count"):
            groups["correlations"].append(f"{strong['count']} strong correlations")
            groups["recommendations"].append("look at strongly correlated columns before fitting a model")
        return {k: v for k, v in groups.items() if v}

    def summary(self) -> str:
        if not self.results:
            raise AnalysisError("nothing has been analysed")
        over, score = self.results["overview"], self.results["quality"].get("quality_score", {})
        lines = [f"rows: {over.get('rows')}", f"columns: {over.get('columns')}", f"duplicate rows: {over.get('duplicate_rows')}", f"quality: {score.get('overall_score', 0.0):.1f} ({score.get('level')})"]
        return "\n".join(lines + [f"- {t}" for g in self.results["insights"].values() for t in g])


class EDA:
    """The façade: analyse, ask, report."""

    def __init__(self, config: EDAConfig | dict | None = None, **settings):
        base = config if isinstance(config, EDAConfig) else EDAConfig.from_dict(config or {})
        self.config = base.update(**settings)
        self.analyzer, self.df = Analyzer(self.config), None

    @classmethod
    def from_config_file(cls, path: str) -> EDA:
        return cls(EDAConfig.from_json(path))

    @property
    def results(self) -> dict:
        return self.analyzer.results

    def analyze(self, df: DataFrame, quick: bool = False) -> dict:
        self.df = df
        return self.analyzer.analyze(df, quick)

    def summary(self) -> str:
        return self.analyzer.summary()

    def insights(self) -> dict:
        return self.results.get("insights", {})

    def quality_score(self) -> float:
        return self.results.get("quality", {}).get("quality_score", {}).get("overall_score", 0.0)

    def correlations(self, threshold: float | None = None) -> list[dict]:
        pairs = self.results.get("correlations", {}).get("strong_correlations", {}).get("pairs", [])
        return [p for p in pairs if threshold is None or abs(p["r"]) >= threshold]

    def update_config(self, **changes) -> EDA:
        self.config = self.config.update(**changes)
        self.analyzer, self.df = Analyzer(self.config), None
        return self

    def save_config(self, path: str) -> None:
        self.config.to_json(path)

    def generate_report(self, path: str | Path, format: str = "html", title: str = "Data report", **options) -> Path:
        from ..sources.report import write_report

        if not self.results:
            raise AnalysisError("nothing has been analysed")
        return write_report(self.results, self.df, path, format, title=title, include_visualizations=options.pop("include_visualizations", self.config.include_visualizations), **options)

    def export_results(self, path: str | Path) -> Path:
        return self.generate_report(path, "json")

    def quick_report(self, df: DataFrame, path: str | Path, format: str = "html", title: str = "Data report") -> Path:
        self.analyze(df, quick=True)
        return self.generate_report(path, format, title)


def quick_analysis(df: DataFrame, path: str = "eda_report.html", **settings) -> dict:
    eda = EDA(**settings)
    eda.quick_report(df, path)
    return eda.results


def analyze_and_report(df: DataFrame, path: str, config: EDAConfig | dict | None = None, format: str = "html", **options) -> tuple[dict, Path]:
    eda = EDA(config)
    eda.analyze(df)
    return eda.results, eda.generate_report(path, format, **options)
