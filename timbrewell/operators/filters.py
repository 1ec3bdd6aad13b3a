"""Predicates of the filter panel, searches and look-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrewell.functions.display import cluster_id, is_yes


@dataclass(frozen=True)
class PresetFilter:
    """What the panel holds; empty or None means off."""

    clusters: tuple[int, ...] = ()
    composer: str | None = None
    nationality: str | None = None
    game: str | None = None
    gems: bool | None = None
    brightness: tuple[float, float] = (0.0, 1.0)
    complexity: tuple[float, float] = (0.0, 1.0)
    search: str = ""

    def toggled(self, cluster: int) -> PresetFilter:
        """With the cluster added, or removed if it was there."""
        left = tuple(c for c in self.clusters if c != cluster)
        return PresetFilter(**self.__dict__ | {"clusters": left if cluster in self.clusters else (*self.clusters, cluster)})

    def only(self, cluster: int | None) -> PresetFilter:
        return PresetFilter(**self.__dict__ | {"clusters": () if cluster is None else (cluster,)})

    @property
    def active(self) -> bool:
        """A facet of the panel is on; ranges and search don't show there."""
        return bool(self.clusters or self.composer or self.nationality or self.game or self.gems is not None)

    def predicate(self) -> Column:
        """One conjunction, for the optimizer to push down."""
        out = F.lit(True)
        if self.clusters:
            out &= cluster_id(F.col("Cluster")).isin(*self.clusters)
        for value, name in ((self.composer, "Composer"), (self.nationality, "Nationality"), (self.game, "Game")):
            if value:
                out &= F.col(name).eqNullSafe(value)
        if self.gems is not None:
            out &= is_yes(F.col("Uses_GEMS")) == self.gems
        for (lo, hi), name in ((self.brightness, "Brightness_Index"), (self.complexity, "Complexity_Score")):
            out &= F.coalesce(F.col(name), F.lit(0.0)).between(lo, hi)
        if self.search:
            out &= holds(self.search, "Name", "Game", "Composer")
        return out


def holds(text: str, *columns: str) -> Column:
    """Any of the columns holds the text, whatever its case."""
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return out


def matches(pattern: str, column: str, literal: bool = False) -> Column:
    """Regular expression (or plain text) in a column, whatever its case; null doesn't match."""
    if literal:
        return holds(pattern, column)
    return F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))


def type_ahead(names: DataFrame, column: str, text: str, k: int = 50) -> DataFrame:
    """The first k names that hold the text."""
    return names.where(holds(text, column)).orderBy(column).limit(k)


def point_lookup(rows: DataFrame, preset_id: int | None = None, name: str | None = None, game: str | None = None) -> DataFrame:
    """The preset of an id, else the first of a name and game; never by name alone."""
    by_id = rows.where(F.col("preset_id") == preset_id).withColumn("_p", F.lit(0)) if preset_id is not None else None
    by_name = rows.where((F.col("Name") == name) & (F.col("Game") == game)).withColumn("_p", F.lit(1)) if name and game else None
    found = [x for x in (by_id, by_name) if x is not None]
    if not found:
        return rows.limit(0)
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.orderBy("_p", "preset_id").limit(1).drop("_p")


def names_and_more(rows: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The first k distinct names, and how many more there are."""
    names = rows.where(F.col(column).isNotNull()).select(column).distinct()
    more = F.broadcast(names.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("more")))
    return names.orderBy(column).limit(k).crossJoin(more)
