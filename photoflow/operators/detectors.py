"""Callers' detectors over images: in batches of their size, with a model for each worker, and every image accounted for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: models of this worker by the run that made them
_MODELS: dict[str, Any] = {}


def _columns(schema: str) -> list[list[str]]:
    return [c.strip().split(None, 1) for c in schema.split(",")]


def _model(run: str, make: Callable[[dict], Any] | None, config: dict) -> Any:
    """The model that `make` gives for config, made once by a worker for a run; one that failed is not tried again."""
    if make is None:
        return None
    if run not in _MODELS:
        try:
            _MODELS[run] = make(config)
        except Exception as e:  # noqa: BLE001
            _MODELS[run] = RuntimeError(f"no model: {e}")
    if isinstance(_MODELS[run], RuntimeError):
        raise _MODELS[run]
    return _MODELS[run]


def answers(batch: pd.DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], key: str, columns: list[str]) -> list[tuple[dict | None, str | None]]:
    """(result, error) of each row of batch, in its order; one of the two is None.

    A batch that fails is halved until the failing rows are alone; where its first half works, the second is
    halved without being tried whole. Results are matched by key: of an image
    that occurs several times the first result is for the first row and so on, one result alone is for all of
    them. A row without a result and an image with more results than rows are errors.
    """
    out: list[tuple[dict | None, str | None]] = []

    def ask(part: pd.DataFrame, fails: bool) -> bool:
        if not fails or len(part) == 1:
            try:
                got = detect(part)[[key, *columns]]
            except Exception as e:  # noqa: BLE001
                if len(part) == 1:
                    out.append((None, str(e) or type(e).__name__))
                    return False
            else:
                out.extend(_matched(part, got, key))
                return True
        half = len(part) // 2
        ask(part.iloc[half:], ask(part.iloc[:half], False))
        return False

    ask(batch, False)
    return out


def _matched(batch: pd.DataFrame, got: pd.DataFrame, key: str) -> list[tuple[dict | None, str | None]]:
    """(result, error) of each row of a batch that worked."""
    name = lambda k: None if pd.isna(k) else k
    found: dict[Any, list[dict]] = {}
    names = list(got.columns)
    for values in zip(*(got[c].astype(object).tolist() for c in names), strict=True):
        row = dict(zip(names, values, strict=True))
        found.setdefault(name(row[key]), []).append(row)
    keys = [name(k) for k in batch[key]]
    asked: dict[Any, int] = {}
    for k in keys:
        asked[k] = asked.get(k, 0) + 1
    out, seen = [], dict.fromkeys(asked, 0)
    for k in keys:
        rows, n = found.get(k, []), seen[k]
        seen[k] += 1
        if len(rows) > asked[k]:
            out.append((None, f"{len(rows)} results for {asked[k]} rows of one image"))
        elif len(rows) == 1 or n < len(rows):
            out.append((rows[0] if len(rows) == 1 else rows[n], None))
        else:
            out.append((None, "no result"))
    return out


def _parts(batches: Iterator[pd.DataFrame], size: int | None) -> Iterator[pd.DataFrame]:
    """Batches of `size` rows, the last of each task perhaps smaller; as they come without a size."""
    if size is None:
        yield from (b for b in batches if len(b))
        return
    waiting = []
    for b in batches:
        waiting.append(b)
        while sum(map(len, waiting)) >= size:
            whole = pd.concat(waiting, ignore_index=True)
            yield whole.iloc[:size].reset_index(drop=True)
            waiting = [whole.iloc[size:]]
    if waiting and len(last := pd.concat(waiting, ignore_index=True)):
        yield last


def run_detector(
    images: DataFrame, fn: Callable, schema: str, key: str = "image", batch_size: int | None = None, model: Callable[[dict], Any] | None = None, **config
) -> DataFrame:
    """One row for each row of images: schema's columns (the key among them), success and error.

    fn(batch, config) returns a frame with the schema's columns; with `model`, a function of config, it is
    fn(batch, config, model) and each worker makes its model once. A batch has batch_size rows at most.
    What fn leaves out or fails on is a row with success false and its error, see `answers`.
    """
    columns = [c for c, _ in _columns(schema)]
    full, run_name = f"{schema}, success boolean, error string", uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def detect(b: pd.DataFrame) -> pd.DataFrame:
            return fn(b, config) if model is None else fn(b, config, _model(run_name, model, config))

        for b in _parts(batches, batch_size):
            done = answers(b, detect, key, [c for c in columns if c != key])
            results = {c: pd.Series([r and r[c] for r, _ in done], dtype=object) for c in columns if c != key}
            own = {key: b[key].reset_index(drop=True), **results, "success": [e is None for _, e in done], "error": pd.Series([e for _, e in done], dtype=object)}
            yield pd.DataFrame({c: own[c] for c in [*columns, "success", "error"]})

    return images.mapInPandas(run, full)


class Detectors:
    """Named detectors with their default configuration."""

    def __init__(self) -> None:
        self._known: dict[str, tuple] = {}

    def register(self, name: str, fn: Callable, schema: str, batch_size: int | None = None, model: Callable[[dict], Any] | None = None, **config) -> None:
        self._known[name] = (fn, schema, batch_size, model, config)

    def run(self, name: str, images: DataFrame, key: str = "image", **override) -> DataFrame:
        """Unknown settings are gathered in tool_params; an unknown detector gives an error row per image."""
        if name not in self._known:
            return images.select(key, F.lit(False).alias("success"), F.lit(f"unknown detector {name}").alias("error"))
        fn, schema, batch_size, model, config = self._known[name]
        merged = config | {k: v for k, v in override.items() if k in config} | {"tool_params": {k: v for k, v in override.items() if k not in config}}
        return run_detector(images, fn, schema, key, batch_size, model, **merged)


def run_two_detectors(
    images: DataFrame, first: tuple[str, Callable, str], second: tuple[str, Callable, str], key: str = "image", config: dict | None = None, batch_size: int | None = None
) -> DataFrame:
    """Both detectors on one read of every image: (image, success, error, and a struct of each detector's columns).

    A detector is (name, fn(batch, config), schema without the key). One that fails on a row, or leaves it out,
    leaves its struct null there and its error in `error`; success says that both worked. Repeated images
    are a row each, matched as `answers` does.
    """
    parts = [(name, fn, _columns(schema)) for name, fn, schema in (first, second)]
    key_type = images.schema[key].dataType.simpleString()
    out = f"{key} {key_type}, success boolean, error string, " + ", ".join(f"{name} struct<{','.join(f'{c}:{t}' for c, t in cols)}>" for name, _, cols in parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _parts(batches, batch_size):
            done = {name: answers(b, lambda x, fn=fn: fn(x, dict(config or {})), key, [c for c, _ in cols]) for name, fn, cols in parts}
            errors = ["; ".join(f"{n}: {rows[k][1]}" for n, rows in done.items() if rows[k][1] is not None) or None for k in range(len(b))]
            found = {name: [r and {c: r[c] for c, _ in cols} for r, _ in done[name]] for name, _, cols in parts}
            yield pd.DataFrame({key: b[key].to_numpy(), "success": [e is None for e in errors], "error": pd.Series(errors, dtype=object)} | found)

    return images.mapInPandas(run, out)
