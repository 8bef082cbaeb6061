import importlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import cli
from plumbline.errors import AnalysisError, DataLoadingError, DependencyError, EDAError, InvalidConfigurationError, format_error, wrap_error
from plumbline.plans import runtime
from plumbline.plans.analyzer import EDA, analyze_and_report, quick_analysis
from plumbline.plans.config import EDAConfig, preset
from plumbline.sources import formatters
from plumbline.sources.loader import DataLoader
from plumbline.streaming import profile

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, float(i % 7), float(i % 7) * 2 + (i % 2), "ab"[i % 2], None if i % 9 == 0 else i * 1.0) for i in range(90)], "id int, x double, y double, g string, m double")


def test_analysis_sections_and_reports(people, tmp_path):
    results, path = analyze_and_report(people, str(tmp_path / "r.html"))
    assert set(results) == {"overview", "statistics", "quality", "outliers", "correlations", "insights", "metadata"}
    assert results["overview"]["rows"] == 90 and not any("error" in results[s] for s in ("overview", "statistics", "quality", "outliers", "correlations"))
    assert results["quality"]["missing_values"]["columns"]["m"]["missing"] == 10
    assert any(p["feature1"] == "x" and p["feature2"] == "y" for p in results["correlations"]["strong_correlations"]["pairs"])
    assert results["insights"]["characteristics"] and "<svg" in path.read_text()
    quick = quick_analysis(people, str(tmp_path / "q.html"))
    assert "outliers" not in quick and "normality_tests" not in quick["statistics"]


def test_facade(people, tmp_path):
    eda = EDA(correlation_threshold=0.5, normality_tests=False)
    with pytest.raises(AnalysisError):
        eda.summary()
    eda.analyze(people, quick=True)
    assert 0 < eda.quality_score() <= 100 and "rows: 90" in eda.summary()
    assert all(abs(p["r"]) >= 0.9 for p in eda.correlations(0.9))
    eda.export_results(tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text())["results"]["overview"]["rows"] == 90
    with pytest.raises(DependencyError):
        eda.generate_report(tmp_path / "r.pdf", "pdf")
    with pytest.raises(EDAError):
        eda.generate_report(tmp_path / "r.x", "docx")
    with pytest.raises(EDAError):
        eda.analyze(people.limit(0))


def test_config(tmp_path):
    with pytest.raises(InvalidConfigurationError):
        EDAConfig(correlation_threshold=2)
    path = str(tmp_path / "c.json")
    preset("thorough").to_json(path)
    assert EDAConfig.from_json(path) == preset("thorough")
    assert EDAConfig.from_dict({"no_such": 1}) == EDAConfig()
    with pytest.raises(InvalidConfigurationError):
        EDAConfig.from_dict({"no_such": 1}, strict=True)


def test_cli(people, tmp_path, capsys):
    people.write.parquet(str(tmp_path / "t.parquet"))
    assert cli.main(["analyze", str(tmp_path / "t.parquet"), "-o", str(tmp_path / "o.html"), "-f", "json", "-f", "html", "--quick", "--no-viz"]) == 0
    assert (tmp_path / "o.html").exists() and (tmp_path / "o.json").exists()
    assert cli.main(["init-config", str(tmp_path / "c.json"), "--profile", "quick"]) == 0 and cli.main(["validate-config", str(tmp_path / "c.json")]) == 0
    (tmp_path / "bad.json").write_text('{"x": 1}')
    assert cli.main(["validate-config", str(tmp_path / "bad.json")]) == 1
    assert cli.main(["info"]) == 0 and "pyspark" in capsys.readouterr().out


def test_loader(spark, people, tmp_path):
    loader = DataLoader(spark)
    pdf = people.toPandas()
    pdf.to_csv(tmp_path / "a.csv", index=False)
    pdf.to_csv(tmp_path / "a.tsv", index=False, sep="\t")
    pdf.to_json(tmp_path / "a.json", orient="records")
    pdf.to_feather(tmp_path / "a.feather")
    for name in ("a.csv", "a.tsv", "a.json", "a.feather"):
        df = loader.load(tmp_path / name)
        assert df.count() == 90 and set(df.columns) == set(people.columns), name
    assert loader.load(tmp_path / "a.csv", schema=people.schema).schema == people.schema
    both = loader.load_multiple([tmp_path / "a.csv", tmp_path / "a.feather"])
    assert both.count() == 180 and len(loader.preview(tmp_path / "a.csv", 3)) == 3
    assert loader.info(tmp_path / "a.csv")["estimated_rows"] == 90
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(DataLoadingError):
        loader.load(tmp_path / "e.csv")
    with pytest.raises(FileNotFoundError):
        loader.load(tmp_path / "none.csv")
    with pytest.raises(DataLoadingError):
        loader.load(tmp_path / "a.pkl")
    (tmp_path / "l.csv").write_bytes("name\ncafé\n".encode("latin-1"))
    assert loader.load(tmp_path / "l.csv", detect_encoding=True).first().name == "café"


def test_formatters():
    assert formatters.percentage(0.5) == "50.00%" and formatters.percentage(55) == "55.00%"
    assert formatters.large_number(1_500_000) == "1.5M" and formatters.currency(-5) == "-$5.00" and formatters.file_size(2048) == "2.00 KB"
    assert formatters.duration(3661) == "1h 1m" and formatters.duration(61, verbose=True) == "1 minute, 1 second"
    assert "<td>&lt;b&gt;</td>" in formatters.html_table([{"a": "<b>"}])
    assert formatters.comparison_table({"a": 1}, {"a": 3, "b": 2}).splitlines()[2] == "| a | 1 | 3 | 2 |"
    assert formatters.csv_text([{"a": 1}]) == "a\n1\n" and formatters.to_markdown({"a": {"b": 1}}, "T").startswith("# T")


def test_cache_and_recovery(people, tmp_path):
    for backend in (runtime.MemoryCache(2), runtime.DiskCache(tmp_path / "c")):
        cache, calls = runtime.ResultCache(backend), []

        @cache.cached("count")
        def count(df, calls=calls):
            calls.append(1)
            return df.count()

        assert count(people) == count(people) == 90 and len(calls) == 1 and cache.stats()["hit_rate"] == 0.5
        assert cache.invalidate(operation="other") == 0 and cache.invalidate(people) == 1
    assert runtime.table_hash(people, "full") == runtime.table_hash(people.repartition(3), "full")
    tries = []

    @runtime.retry(3, delay=0)
    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError("no")
        return "yes"

    assert flaky() == "yes"
    assert runtime.degrade_gracefully([lambda: 1 / 0, lambda: 5]) == 5
    assert runtime.execute_partial([1, 0], lambda x: 1 / x).summary()["success_rate"] == 0.5
    assert runtime.with_fallback(7)(lambda: 1 / 0)() == 7 and not runtime.safe_execute(lambda: 1 / 0).ok
    seen = []
    p = runtime.Progress({"a": 1, "b": 3}, callbacks=[lambda n, s: seen.append((n, s))])
    with p.step("a"):
        pass
    assert seen == [("a", 0.25)]
    e = wrap_error(ValueError("x"), DataLoadingError, "cannot read", suggestions=["look"])
    assert "try: look" in format_error(e) and isinstance(e.original, ValueError)
    batches = runtime.process_batches(people.select("x"), lambda pdf: pdf.assign(x=pdf.x + 1), "x double")
    assert batches.agg(F.min("x")).first()[0] == 1.0


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = {}
    q = profile.write_profile(profile.running_profile(stream, "value", ["event_type"]), lambda df, i: batches.__setitem__(i, df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    last = {r.event_type: r for r in batches[max(batches)]}
    want = {r.event_type: r for r in profile.running_profile(events, "value", ["event_type"]).collect()}
    assert len(batches) >= 3 and {k: (r["count"], round(r["mean"], 9)) for k, r in last.items()} == {k: (r["count"], round(r["mean"], 9)) for k, r in want.items()}
    rows = []
    q = profile.write_profile(profile.windowed_profile(stream, "ts", "value"), lambda df, i: rows.extend(df.collect()), str(tmp_path / "cp2"), mode="update")
    q.awaitTermination()
    assert rows and rows[0].window_end > rows[0].window_start


def test_library_does_not_import_the_corpus_operators():
    names = [".".join(p.relative_to(ROOT).with_suffix("").parts) for p in sorted((ROOT / "plumbline").rglob("*.py")) if "llm" not in p.parts and p.stem != "__init__"]
    code = f"import sys, importlib\nfor m in {names!r}: importlib.import_module(m)\nassert not [m for m in sys.modules if m.startswith('plumbline.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry_without_the_corpus_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'profile_numeric' in q and not [k for k in q if k.startswith('op') and '_' in k and k[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_more_settings(tmp_path, spark):
    for bad in ({"distribution_test_method": "x"}, {"output_format": "x"}, {"cache_backend": "x"}, {"sampling_method": "x"}, {"min_cardinality": 0}, {"cache_ttl": -1}, {"max_categories": 0}):
        with pytest.raises(InvalidConfigurationError):
            EDAConfig(**bad)
    path = tmp_path / "a" / "b" / "settings.json"
    EDAConfig(custom_params={"a": 1}).to_json(str(path))
    assert EDAConfig.from_json(str(path)).custom_params == {"a": 1}
    df = spark.createDataFrame([(float(i % 37), f"s{i % 3}") for i in range(600)], "x double, s string")
    eda = EDA(enable_cache=True, save_results=True, output_dir=str(tmp_path / "out"), distribution_test_method="ks", enable_auto_sampling=True, auto_sample_threshold=500, sample_rows=300)
    first = eda.analyze(df)
    assert (tmp_path / "out" / "results.json").exists() and 295 <= first["overview"]["rows"] <= 300
    assert eda.analyze(df) is first
    tests = first["statistics"]["normality_tests"]["x"]
    assert tests["likely_normal"] == (tests["ks"]["p_value"] > 0.05)


def test_chart_tables_and_figures(tmp_path, spark):
    from plumbline.operators import charts

    df = spark.createDataFrame([(i, float(i), float(i % 7), "a" if i % 2 else "b") for i in range(200)], "k long, x double, y double, g string")
    assert charts.scatter_matrix(df, ["x", "y"], 5).agg({"n": "sum"}).first()[0] == 200
    assert charts.scatter_points(df, ["x", "y"], ["k"], 50, "g").count() == 50
    assert charts.violins(df, "x", "g", 10).count() == 20
    assert set(charts.dashboard(df.select("x", "y"))) == {"histograms", "boxes", "correlations"} and set(charts.pair_plot(df, ["x", "y"])) == {"diagonal", "cells", "correlations"}
    figure = charts.svg_bars([("a<b", 1.0)], "t")
    assert "&lt;" in open(charts.save_figure(figure, str(tmp_path / "f.html"))).read() and open(charts.save_figure(figure, str(tmp_path / "f.svg"))).read() == figure
    with pytest.raises(ValueError):
        charts.save_figure(figure, str(tmp_path / "f.png"))
