"""Several metagenes of equal windows under labels: what is done to one is done to all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import saves
from . import metagene
from .metagene import Metagene


@dataclass(frozen=True)
class Samples:
    by_label: dict[str, Metagene]

    def __post_init__(self):
        if len({(m.up, m.body, m.down) for m in self.by_label.values()}) > 1:
            raise ValueError("samples differ in their windows")

    @classmethod
    def of(cls, metagenes: list[Metagene], labels: list[str] | None = None) -> "Samples":
        labels = [str(i) for i in range(len(metagenes))] if labels is None else labels
        if len(labels) != len(metagenes) or len(set(labels)) != len(labels):
            raise ValueError("a label for each sample, all different")
        return cls(dict(zip(labels, metagenes)))

    def each(self, f) -> "Samples":
        return Samples({label: f(m) for label, m in self.by_label.items()})

    def filtered(self, **conditions) -> "Samples":
        return self.each(lambda m: metagene.filtered(m, **conditions))

    def trim_flank(self, upstream: bool = True, downstream: bool = True) -> "Samples":
        return self.each(lambda m: metagene.trim_flank(m, upstream, downstream))

    def resize(self, to: int | None) -> "Samples":
        return self.each(lambda m: metagene.resize(m, to))

    def merged(self) -> Metagene:
        return metagene.merged(list(self.by_label.values()))

    def table(self) -> DataFrame:
        return metagene.labelled(self.by_label)

    def line(self, stat: str = "wmean", **options) -> DataFrame:
        """(label, fragment, density) of all samples."""
        out = None
        for label, m in self.by_label.items():
            d = metagene.line(m, stat, **options).withColumn("label", F.lit(label))
            out = d if out is None else out.unionByName(d)
        return out

    def box(self) -> DataFrame:
        out = None
        for label, m in self.by_label.items():
            d = metagene.box(m).withColumn("label", F.lit(label))
            out = d if out is None else out.unionByName(d)
        return out

    def matrix(self) -> DataFrame:
        return metagene.sample_matrix(self.table(), list(self.by_label))

    def dendrogram_matrix(self, q: float = 0.75) -> DataFrame:
        return metagene.dendrogram_matrix(self.table(), list(self.by_label), q)

    def save(self, path: str, merged: bool = False, gzip: bool = False) -> None:
        saves.save_samples({label: m.df for label, m in self.by_label.items()}, path, merged, gzip)
