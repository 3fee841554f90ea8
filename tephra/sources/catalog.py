"""Lazy catalog queries: an immutable builder over a Parquet table partitioned by facets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import convert
from ..operators import aggregates, geo, joins, subset, warming
from .scan import parquet

FACETS = ("activity", "institution", "gcm", "scenario", "table_id", "grid_label", "member", "variable")
#: Order in which steps run, whatever order they were asked for in.
ORDER = ("clip", "convert_units", "time_slice", "bias_adjusted", "warming_level", "local_time", "derived", "metric_calc")


@dataclass(frozen=True)
class Derived:
    name: str
    depends_on: tuple[str, ...]
    func: Callable[[DataFrame], DataFrame]
    description: str = ""


_REGISTRY: dict[str, Derived] = {}


def register(name: str, depends_on: list[str], func: Callable[[DataFrame], DataFrame], description: str = "") -> None:
    """A derived variable: func takes a frame with a column for each dependency and adds the column `name`."""
    _REGISTRY[name] = Derived(name, tuple(depends_on), func, description)


def registered() -> dict[str, Derived]:
    return dict(_REGISTRY)


@dataclass(frozen=True)
class Query:
    """Each call returns a new query; nothing is read before get() and nothing runs before an action on its frame."""

    source: Callable[[], DataFrame]
    facets: dict = field(default_factory=dict)
    steps: dict = field(default_factory=dict)

    def where(self, **facets) -> Query:
        unknown = set(facets) - set(FACETS)
        if unknown:
            raise ValueError(f"unknown facets {sorted(unknown)}; there are {FACETS}")
        return replace(self, facets=self.facets | facets)

    def __getattr__(self, name: str):
        if name in FACETS:
            return lambda value: self.where(**{name: value})
        raise AttributeError(name)

    def processes(self, steps: dict) -> Query:
        unknown = set(steps) - set(ORDER)
        if unknown:
            raise ValueError(f"unknown steps {sorted(unknown)}; there are {ORDER}")
        return replace(self, steps=self.steps | steps)

    def options(self, facet: str) -> DataFrame:
        """Values of a facet under the facets chosen so far."""
        return self._chosen(skip={facet}).select(facet).distinct()

    def _chosen(self, skip=frozenset()) -> DataFrame:
        df = self.source()
        for name, value in self.facets.items():
            if name not in skip:
                df = df.where(F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value)
        return df

    def get(self) -> DataFrame:
        derived = _REGISTRY.get(self.facets.get("variable")) if isinstance(self.facets.get("variable"), str) else None
        df = replace(self, facets=self.facets | {"variable": list(derived.depends_on)})._chosen() if derived else self._chosen()
        for name in ORDER:
            if name == "derived" and derived:
                keys = [c for c in df.columns if c not in ("variable", "value", "units")]
                wide = df.groupBy(*keys).pivot("variable", list(derived.depends_on)).agg(F.first("value"))
                df = derived.func(wide)
            elif name in self.steps:
                df = _STEPS[name](df, self.steps[name])
        return df


def open_catalog(spark: SparkSession, root: str) -> Query:
    return Query(lambda: parquet(spark, root))


def from_frame(df: DataFrame) -> Query:
    return Query(lambda: df)


def from_file(spark: SparkSession, path: str, needed: tuple[str, ...] = ("sim", "warming_level", "time", "value")) -> Query:
    """A query over a user's own Parquet file in place of the catalog; its columns must be the catalog's, checked here."""
    df = parquet(spark, path)
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"{path} has no {missing}; it needs {list(needed)}")
    return Query(lambda: df)


def from_dict(base: Query, wanted: dict) -> Query:
    """A query from one dictionary of facets and, under `processes`, steps."""
    return base.where(**{k: v for k, v in wanted.items() if k != "processes"}).processes(wanted.get("processes", {}))


def from_selection(base: Query, selection) -> Query:
    """A query from an object whose attributes are named like facets; empty ones don't restrict."""
    return base.where(**{f: v for f in FACETS if (v := getattr(selection, f, None)) not in (None, "", [])})


def get_data(base: Query, variable: str, table_id: str | None = None, grid_label: str | None = None, approach: str = "Time", warming_level: list[float] | None = None, crossings: DataFrame | None = None, keys: list[str] | None = None, window: int = 15) -> DataFrame:
    """One call for a variable: by time, or around warming levels whose crossings are given."""
    q = base.where(**{k: v for k, v in (("variable", variable), ("table_id", table_id), ("grid_label", grid_label)) if v})
    if approach == "Warming Level":
        if crossings is None:
            raise ValueError("the warming level approach needs crossings")
        wanted = crossings.where(F.col("warming_level").isin([float(w) for w in warming_level])) if warming_level else crossings
        q = q.processes({"warming_level": {"crossings": wanted, "keys": keys or ["sim"], "window": window}})
    elif approach != "Time":
        raise ValueError("approach is Time or Warming Level")
    return q.get()


def history_and_warm(base: Query, models: list[str], warm: str, history: str = "historical") -> tuple[DataFrame, DataFrame]:
    """Historical and future rows of those models that have both scenarios."""
    both = base.gcm(models).where(scenario=[history, warm]).get()
    kept = both.join(subset.relational_division(both, "gcm", "scenario", [history, warm]), "gcm", "left_semi")
    return kept.where(F.col("scenario") == history), kept.where(F.col("scenario") == warm)


def _clip(df: DataFrame, area) -> DataFrame:
    """area: {"lat": (a, b), "lon": (a, b)}; {"points": frame, "reach": degrees}; {"polygons": frame}; {"cells": ids}."""
    if "lat" in area:
        return subset.box(df, area["lat"], area["lon"])
    if "cells" in area:
        return df.where(F.col("cell").isin(area["cells"]))
    cells = df.select("cell", "lat", "lon").distinct()
    if "points" in area:
        near = joins.nearest_cell(area["points"], cells, "point", "cell", area.get("reach", 0.5))
        return df.join(near.select("point", "cell"), "cell")
    if "polygons" in area:
        return df.join(geo.regions_of_points(cells, area["polygons"], "cell"), "cell")
    raise ValueError("clip needs lat and lon, points, polygons or cells")


def _units(df: DataFrame, want: str) -> DataFrame:
    from ..functions.numbers import UNITS

    out = F.when(F.col("units") == want, F.col("value"))
    for have, target in UNITS:
        if target == want:
            out = out.when(F.col("units") == have, convert(F.col("value"), have, want))
    return df.withColumn("value", out).withColumn("units", F.lit(want)).withMetadata("value", {"units": want})


_STEPS: dict[str, Callable] = {
    "clip": _clip,
    "convert_units": _units,
    "time_slice": lambda df, span: subset.time_slice(df, span[0], span[1]),
    "bias_adjusted": lambda df, yes: df.where(F.col("bias_adjusted") == F.lit(yes)),
    "warming_level": lambda df, o: warming.window_around(df, o["crossings"], o.get("keys", ["sim"]), o.get("window", 15), "time", o.get("months"), o.get("dummy_time", False)),
    "local_time": lambda df, zone: subset.local_time(df, zone),
    "metric_calc": lambda df, o: aggregates.reduce(df, o["keys"], [o["metric"]] if isinstance(o["metric"], str) else o["metric"]),
}
