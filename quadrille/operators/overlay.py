"""The public entry: Boolean overlay of contours, per group."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import filled, inside
from ..model import FillRule, Options, OverlayRule
from ..tables import scratch_path
from . import boundary, corners, edges, rings, sweep


class Overlay:
    """Contours (subject and clip, by group_id) made ready once; every rule and fill reads the same slabs, swept anew for each action or,
    after stored(), read from a table.

    Invalid rings are set aside in `rejects` with a reason. Nothing runs until a result is acted upon, but for the first pass of the sweep and shapes() and flat_contours(),
    which write intermediate tables to the shared folder when called.
    """

    def __init__(self, contours: DataFrame, options: Options = Options()):
        self.options = options
        self.contours, self.rejects = edges.quarantine(contours)
        self._slabs: DataFrame | None = None
        self._dealt: tuple[DataFrame, DataFrame] | None = None
        self.table: str | None = None

    @classmethod
    def of(cls, subject: DataFrame, clip: DataFrame | None = None, options: Options = Options()) -> "Overlay":
        """From rings (group_id, contour_id, points) per role."""
        both = subject.withColumn("shape_type", F.lit("subject"))
        if clip is not None:
            both = both.unionByName(clip.withColumn("shape_type", F.lit("clip")))
        return cls(both.select("group_id", "shape_type", "contour_id", "points"), options)

    @property
    def slabs(self) -> DataFrame:
        if self._slabs is None:
            self._slabs = sweep.swept(*self._sent).drop("block")
        return self._slabs

    @property
    def _sent(self) -> tuple[DataFrame, DataFrame]:
        if self._dealt is None:
            self._dealt = sweep.sent(self.contours)
        return self._dealt

    def stored(self, buckets: int | None = None, name: str | None = None) -> "Overlay":
        """Sweeps now and keeps the slabs as a table in the shared folder, bucketed by strip: (group_id, x0), sorted by y0.

        Rules filter it and masked_segments() sums along its strips without an exchange of slabs; what is left is the exchange of boundary
        pieces between neighbouring strips. A group is spread over all buckets. reopened() finds the table again, dropped() removes it.
        """
        spark = self.slabs.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = name or f"slabs_{uuid.uuid4().hex}"
        dealt = self.slabs.repartition(buckets, "group_id", "x0").write.bucketBy(buckets, "group_id", "x0").sortBy("group_id", "x0", "y0")
        dealt.option("path", scratch_path(spark, table)).option("compression", "zstd").saveAsTable(table)
        self._slabs, self.table = spark.table(table), table
        return self

    @classmethod
    def reopened(cls, spark: SparkSession, table: str, options: Options = Options()) -> "Overlay":
        """An overlay of the slabs that stored() kept; it has no contours and no rejects."""
        out = cls.__new__(cls)
        out.options, out.contours, out.rejects, out._slabs, out._dealt, out.table = options, None, None, spark.table(table), None, table
        return out

    def dropped(self) -> "Overlay":
        """Without its table and the table's files: swept anew from here on."""
        if self.table is not None:
            spark = self._slabs.sparkSession
            (at,) = (r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {self.table}").collect() if r["col_name"] == "Location")
            spark.sql(f"DROP TABLE {self.table}")
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            self._slabs = self.table = None
        return self

    def region(self, rule: OverlayRule, fill: FillRule = FillRule.NON_ZERO) -> DataFrame:
        """The result as disjoint rectangles, joined sideways where they are of one height: group_id, x0, x1, y0, y1."""
        return sweep.merged(self._kept(rule, fill))

    def _kept(self, rule: OverlayRule, fill: FillRule) -> DataFrame:
        keep = inside(filled(F.col("ws"), fill), filled(F.col("wc"), fill), rule)
        return self.slabs.where(keep).select("group_id", "x0", "x1", "y0", "y1")

    def area(self, rule: OverlayRule, fill: FillRule = FillRule.NON_ZERO) -> DataFrame:
        return self._kept(rule, fill).groupBy("group_id").agg(F.sum(_size()).alias("area"))

    def area_matrix(self) -> DataFrame:
        """Areas of all rules under all fills in one sweep: group_id and a column <fill>_<rule> each."""
        sums = []
        for f in FillRule:
            for r in OverlayRule:
                keep = inside(filled(F.col("ws"), f), filled(F.col("wc"), f), r)
                sums.append(F.sum(F.when(keep, _size()).otherwise(0)).alias(f"{f.value}_{r.value}"))
        return self.slabs.groupBy("group_id").agg(*sums)

    def masked_segments(self, fill: FillRule = FillRule.NON_ZERO) -> DataFrame:
        return boundary.masked_segments(self.slabs, fill)

    def links(self, rule: OverlayRule, fill: FillRule = FillRule.NON_ZERO) -> DataFrame:
        return boundary.links(self.masked_segments(fill), rule)

    def shapes(self, rule: OverlayRule, fill: FillRule = FillRule.NON_ZERO) -> DataFrame:
        return rings.shapes_of(*self._traced(rule, fill), self.options)

    def flat_contours(self, rule: OverlayRule, fill: FillRule = FillRule.NON_ZERO) -> DataFrame:
        return rings.flat_contours_of(*self._traced(rule, fill, bool(self.options.min_output_area)), self.options)

    def _traced(self, rule: OverlayRule, fill: FillRule, bind: bool = True) -> tuple[DataFrame | None, DataFrame | None]:
        if self.options.preserve_output_collinear:
            return None, rings.traced_links(self.masked_segments(fill), rule, self.options)
        found = corners.of_slabs(self.slabs, rule, fill) if self.table is not None else corners.of_horizontals(sweep.in_order(*self._sent), rule, fill)
        return rings.traced(found, self.options, bind)


def _size():
    return (F.col("x1").cast("long") - F.col("x0")) * (F.col("y1").cast("long") - F.col("y0"))
