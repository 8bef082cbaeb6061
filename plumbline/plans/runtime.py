"""Driver-side utilities: result cache, recovery, progress, timing. Data stay in Spark; only small results pass here."""

from __future__ import annotations

import functools
import hashlib
import json
import logging
import math
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError, DependencyError, ResourceError

LOG = logging.getLogger("plumbline")

# Cache -------------------------------------------------------------------------------------------


def table_hash(df: DataFrame, method: str = "plan") -> str:
    """plan: the canonical plan; structure: names and types; full: order-independent hash of all rows in one aggregate."""
    if method == "plan":
        return f"plan:{df.semanticHash()}"
    schema = json.dumps([(f.name, f.dataType.simpleString()) for f in df.schema.fields])
    if method == "structure":
        return hashlib.sha256(schema.encode()).hexdigest()
    if method == "full":
        h = F.xxhash64(*df.columns)
        r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
        return hashlib.sha256(f"{schema}|{r.n}|{r.x}|{r.s}".encode()).hexdigest()
    raise ValueError(f"unknown method {method!r}")


def config_hash(config: dict | None) -> str:
    return hashlib.sha256(json.dumps(config or {}, sort_keys=True, default=str).encode()).hexdigest()


def cache_key(df: DataFrame, operation: str, config: dict | None = None, method: str = "plan") -> str:
    return f"{operation}|{table_hash(df, method)}|{config_hash(config)}"


class MemoryCache:
    """Least recently used entries with a time to live."""

    def __init__(self, size: int = 100, ttl: float | None = None):
        self.size, self.ttl, self.entries = size, ttl, OrderedDict()

    def get(self, key: str) -> Any:
        value, at = self.entries[key]
        if self.ttl is not None and time.time() - at > self.ttl:
            del self.entries[key]
            raise KeyError(key)
        self.entries.move_to_end(key)
        return value

    def set(self, key: str, value: Any) -> None:
        self.entries[key] = (value, time.time())
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def keys(self) -> list[str]:
        return list(self.entries)

    def delete(self, key: str) -> None:
        self.entries.pop(key, None)


class DiskCache:
    """JSON files under a folder, oldest first out beyond the byte limit."""

    def __init__(self, folder: str | Path, max_bytes: int = 100 << 20, ttl: float | None = None):
        self.folder, self.max_bytes, self.ttl = Path(folder), max_bytes, ttl
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, key: str) -> Path:
        return self.folder / f"{hashlib.sha256(key.encode()).hexdigest()}.json"

    def get(self, key: str) -> Any:
        path = self._path(key)
        if not path.exists() or (self.ttl is not None and time.time() - path.stat().st_mtime > self.ttl):
            raise KeyError(key)
        return json.loads(path.read_text())["value"]

    def set(self, key: str, value: Any) -> None:
        self._path(key).write_text(json.dumps({"key": key, "value": value}, default=str))
        files = sorted(self.folder.glob("*.json"), key=lambda p: p.stat().st_mtime)
        total = sum(p.stat().st_size for p in files)
        for p in files[:-1]:
            if total <= self.max_bytes:
                break
            total -= p.stat().st_size
            p.unlink()

    def keys(self) -> list[str]:
        return [json.loads(p.read_text())["key"] for p in self.folder.glob("*.json")]

    def delete(self, key: str) -> None:
        self._path(key).unlink(missing_ok=True)


class ResultCache:
    def __init__(self, backend: MemoryCache | DiskCache | None = None):
        self.backend, self.hits, self.misses = backend or MemoryCache(), 0, 0

    def get(self, df: DataFrame, operation: str, config: dict | None = None, default: Any = None) -> Any:
        try:
            value = self.backend.get(cache_key(df, operation, config))
        except KeyError:
            self.misses += 1
            return default
        self.hits += 1
        return value

    def set(self, df: DataFrame, operation: str, value: Any, config: dict | None = None) -> None:
        self.backend.set(cache_key(df, operation, config), value)

    def cached(self, operation: str, config: dict | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def run(df: DataFrame, *args, **options):
                missing = object()
                value = self.get(df, operation, config, missing)
                if value is missing:
                    value = f(df, *args, **options)
                    self.set(df, operation, value, config)
                return value

            return run

        return wrap

    def invalidate(self, df: DataFrame | None = None, operation: str | None = None) -> int:
        """Entries of the table, of the operation, of both, or all."""
        mark = f"|{table_hash(df)}|" if df is not None else ""
        gone = [k for k in self.backend.keys() if mark in k and (operation is None or k.startswith(f"{operation}|"))]
        for k in gone:
            self.backend.delete(k)
        return len(gone)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0, "size": len(self.backend.keys())}


# Recovery ----------------------------------------------------------------------------------------


def retry(attempts: int = 3, delay: float = 1.0, backoff: float = 2.0, exceptions: tuple[type[Exception], ...] = (Exception,)) -> Callable:
    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **options):
            wait = delay
            for attempt in range(1, attempts + 1):
                try:
                    return f(*args, **options)
                except exceptions as error:
                    if attempt == attempts:
                        raise
                    LOG.warning("attempt %d of %d failed: %s", attempt, attempts, error)
                    time.sleep(wait)
                    wait *= backoff

        return run

    return wrap


def with_fallback(value: Any = None, function: Callable | None = None, exceptions: tuple[type[Exception], ...] = (Exception,)) -> Callable:
    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **options):
            try:
                return f(*args, **options)
            except exceptions as error:
                LOG.warning("%s failed: %s", f.__name__, error)
                return function(*args, **options) if function else value

        return run

    return wrap


@dataclass
class Outcome:
    value: Any = None
    error: Exception | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def safe_execute(f: Callable, *args, default: Any = None, exceptions: tuple[type[Exception], ...] = (Exception,), **options) -> Outcome:
    try:
        return Outcome(f(*args, **options))
    except exceptions as error:
        return Outcome(default, error)


@dataclass
class PartialResults:
    successes: dict = field(default_factory=dict)
    failures: dict = field(default_factory=dict)

    def summary(self) -> dict:
        total = len(self.successes) + len(self.failures)
        return {"total": total, "succeeded": len(self.successes), "failed": len(self.failures), "success_rate": len(self.successes) / total if total else 0.0, "errors": {k: str(e) for k, e in self.failures.items()}}


def execute_partial(items: list, f: Callable, name: Callable = str, raise_on_all_failed: bool = True) -> PartialResults:
    out = PartialResults()
    for item in items:
        r = safe_execute(f, item)
        (out.successes if r.ok else out.failures)[name(item)] = r.value if r.ok else r.error
    if items and raise_on_all_failed and not out.successes:
        raise AnalysisError("every item failed", out.summary())
    return out


def degrade_gracefully(functions: list[Callable], *args, **options) -> Any:
    """The first function that succeeds, e.g. the exact one, then the approximate one."""
    errors = []
    for f in functions:
        r = safe_execute(f, *args, **options)
        if r.ok:
            return r.value
        errors.append(str(r.error))
    raise AnalysisError("every way failed", {"errors": errors})


@contextmanager
def error_context(**details) -> Iterator[None]:
    try:
        yield
    except Exception as error:
        error.add_note("; ".join(f"{k}: {v}" for k, v in details.items()))
        raise


# Progress, timing, logging -------------------------------------------------------------------------


def format_time(seconds: float) -> str:
    minutes, s = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m {s}s" if hours else f"{minutes}m {s}s" if minutes else f"{seconds:.1f}s"


def time_remaining(done: int, total: int, elapsed: float) -> float | None:
    return elapsed / done * (total - done) if done else None


class Progress:
    """Weighted steps; callbacks get (step, share done). Spark jobs of a step carry its name as their group."""

    def __init__(self, steps: dict[str, float], spark=None, callbacks: list[Callable[[str, float], None]] | None = None):
        self.steps, self.spark, self.callbacks, self.done = steps, spark, callbacks or [], 0.0

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        if self.spark is not None:
            self.spark.sparkContext.setJobGroup(name, name)
        try:
            yield
        finally:
            self.done += self.steps[name]
            for f in self.callbacks:
                f(name, self.done / sum(self.steps.values()))


class Timings:
    def __init__(self) -> None:
        self.seconds: dict[str, list[float]] = {}

    @contextmanager
    def measure(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds.setdefault(name, []).append(time.perf_counter() - began)

    def report(self) -> dict[str, dict]:
        return {k: {"calls": len(v), "total": sum(v), "mean": sum(v) / len(v)} for k, v in self.seconds.items()}


def log_execution(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(*args, **options):
        began = time.perf_counter()
        try:
            return f(*args, **options)
        finally:
            LOG.info("%s took %s", f.__name__, format_time(time.perf_counter() - began))

    return run


def configure_logging(level: str = "INFO", file: str | None = None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]
    logging.basicConfig(level=getattr(logging, level.upper()), handlers=handlers, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)


# Columns in parallel -------------------------------------------------------------------------------


def map_columns(df: DataFrame, f: Callable, schema: str, columns: list[str]) -> DataFrame:
    """f(column_name, values of one batch of rows) -> pandas frame with schema, over narrow batches of each column.

    Batches, not whole columns, meet f, so no column is gathered in a task; combine what comes back with an aggregate.
    """
    import pandas as pd

    from ..operators.descriptive import melt

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("column_name", sort=False):
                yield f(name, part["value"])

    return melt(df, columns).mapInPandas(run, schema)


def process_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f over every Arrow batch as a pandas frame: the chunked reader's loop, distributed."""

    def run(batches):
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema)


def batch_rows(row_bytes: int, available_mb: float = 512.0) -> int:
    """Rows of a batch: a tenth of the memory, within 1,000 and 100,000."""
    return max(1_000, min(100_000, int(available_mb * 1e6 * 0.1 / max(1, row_bytes))))


def partitions_for(n_bytes: int, target: int = 128 << 20) -> int:
    return max(1, math.ceil(n_bytes / target))


def memory_info() -> dict:
    try:
        import psutil
    except ImportError as error:
        raise DependencyError("psutil is not installed", original=error) from error
    m = psutil.virtual_memory()
    return {"total_mb": m.total / 1e6, "available_mb": m.available / 1e6, "percent": m.percent}


def check_memory(required_mb: float, margin: float = 0.2) -> bool:
    have = memory_info()["available_mb"]
    if have < required_mb:
        raise ResourceError("not enough memory", {"required_mb": required_mb, "available_mb": have})
    return have >= required_mb * (1 + margin)
