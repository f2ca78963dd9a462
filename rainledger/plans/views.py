"""The given star-schema tables seen as panel data: shipments per supplier, year and season.

``water_*`` views come from line items, ``nrm_*`` views from suppliers. Everything is a lazy
projection of whole tables, so the work of a query grows with its input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import clean_interventions, clean_observations
from ..operators.merging import merge_interventions
from ..sinks.shared import stored

NRM_FIRST_YEAR, NRM_LAST_YEAR = 1996, 2000


def _place(key: str) -> Column:
    return F.concat(F.lit("V"), F.lpad(F.col(key).cast("string"), 6, "0"))


def _season(ts: str) -> Column:
    month = F.month(ts)
    return (F.when(month.isin(12, 1, 2), "winter").when(month.between(3, 5), "summer")
            .when(month.between(6, 9), "monsoon").otherwise("perennial"))


class Views:
    """Panel views over the tables in one directory."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def stored(self, df: DataFrame, *columns: str) -> DataFrame:
        """The columns of ``df`` as a written table, for operators that read their input repeatedly."""
        return stored(df.select(*columns) if columns else df)

    @cached_property
    def water_raw(self) -> DataFrame:
        return self.table("lineitem").select(
            _place("l_suppkey").alias("location_id"), F.year("l_shipdate").cast("int").alias("year"),
            _season("l_shipdate").alias("season"), (F.col("l_extendedprice") / 9.0).alias("water_area_ha"),
            F.col("l_quantity").cast("int").alias("water_body_count"),
            F.when(F.col("l_returnflag") == "R", "poor").otherwise("good").alias("data_quality"),
        )

    @cached_property
    def water_text(self) -> DataFrame:
        """The same rows as text with damage: bad years, seasons, numbers and missing values."""
        k, year = F.col("l_orderkey"), F.year("l_shipdate").cast("string")
        return self.table("lineitem").select(
            F.when(k % 29 == 0, F.lit(None)).otherwise(_place("l_suppkey")).alias("location_id"),
            F.when(k % 50 == 0, "2020.5").when(k % 50 == 1, "abc").when(k % 50 == 2, "1850")
            .when(k % 50 == 3, F.concat(year, F.lit(".0"))).when(k % 50 == 4, F.concat(F.lit(" "), year))
            .otherwise(year).alias("year"),
            F.when(k % 47 == 0, "Monsoon").otherwise(_season("l_shipdate")).alias("season"),
            F.when(k % 41 == 0, "12d").when(k % 43 == 0, "nan").when(k % 53 == 0, "-0.5")
            .otherwise((F.col("l_extendedprice") / 9.0).cast("string")).alias("water_area_ha"),
            F.when(k % 37 == 0, "-1").when(k % 31 == 0, F.lit(None))
            .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("water_body_count"),
            F.when(F.col("l_returnflag") == "R", "poor").otherwise("good").alias("data_quality"),
        )

    @cached_property
    def nrm_raw(self) -> DataFrame:
        k, nation = F.col("s_suppkey"), F.col("s_nationkey")
        pond = (F.when(k % 8 == 0, "Yes").when(k % 8 == 1, "no").when(k % 8 == 2, " TRUE ")
                .when(k % 8 == 3, "absent").when(k % 8 == 4, "maybe").when(k % 8 == 5, F.lit(None))
                .when(k % 8 == 6, "1").otherwise("0"))
        kind = (F.when(k % 5 == 0, " Pond ").when(k % 5 == 1, "check_dam").when(k % 5 == 2, "Terrace")
                .when(k % 5 == 3, "none").otherwise(F.lit(None)))
        # The observations also have years before and after, which find no record.
        years = self.table("supplier").select(
            "*", F.explode(F.sequence(F.lit(NRM_FIRST_YEAR), F.lit(NRM_LAST_YEAR))).alias("y"))
        damage = (k + F.col("y")) % 23
        return years.select(
            F.when(damage != 3, _place("s_suppkey")).alias("Location ID"),
            F.when(damage == 0, "2020.5").when(damage == 1, "1850").when(damage == 2, "abc")
            .otherwise(F.col("y").cast("string")).alias("Year"),
            pond.alias("Pond-Presence"), kind.alias("Intervention Type"),
            (F.col("s_acctbal") / 1000.0).alias("crop_yield_ton_per_ha"),
            F.when(nation < 8, "low").when(nation < 16, "medium").otherwise("high").alias("drought_sensitivity"),
        )

    @cached_property
    def water(self) -> DataFrame:
        return clean_observations(self.water_raw)

    @cached_property
    def nrm(self) -> DataFrame:
        return clean_interventions(self.nrm_raw)

    @cached_property
    def merged(self) -> DataFrame:
        return merge_interventions(self.water, self.nrm)

    @cached_property
    def merged_text_flag(self) -> DataFrame:
        """The flag as an uncleaned column has it: words, numbers as text, and words that mean nothing."""
        word = F.element_at(F.array(*map(F.lit, ("yes", " TRUE ", "1.0", "no", "absent", "0", "maybe"))),
                            F.col("year") % 7 + 1)
        return self.merged.withColumn("pond_presence", F.when(F.col("pond_presence").isNotNull(), word))

    @cached_property
    def grain(self) -> DataFrame:
        """One row per location, year and season: the shape the unaggregated charts expect."""
        return self.water.groupBy("location_id", "year", "season").agg(
            F.avg("water_area_ha").alias("water_area_ha"), F.sum("water_body_count").alias("water_body_count"))

    @cached_property
    def sparse(self) -> DataFrame:
        """Few rows per place and season, uneven in time and size, with missing places and values."""
        k, price = F.col("o_orderkey"), F.col("o_totalprice") / 1000.0
        return self.table("orders").select(
            F.when(k % 19 != 0, F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))).alias("location_id"),
            F.year("o_orderdate").cast("string").alias("year"), _season("o_orderdate").alias("season"),
            F.when(k % 13 == 0, price * 40).when(k % 17 != 0, price).alias("water_area_ha"),
            (k % 20).alias("water_body_count"))

    @cached_property
    def places(self) -> DataFrame:
        """Region name per location."""
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
            _place("s_suppkey").alias("location_id"), F.col("r_name").alias("region"))

    @cached_property
    def documents(self) -> DataFrame:
        """One irregular JSON series per line item, in twelve shapes."""
        k = F.col("l_orderkey") % 12
        year, area = F.year("l_shipdate").cast("string"), (F.col("l_extendedprice") / 9.0).cast("string")
        count = F.col("l_quantity").cast("int").cast("string")

        def text(*parts: Column | str) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        season = text('"', _season("l_shipdate"), '":')
        full = text('{"year":', year, ',"seasons":{', season, '{"area_ha":', area, ',"count":', count)
        return self.table("lineitem").select(
            text(" ", _place("l_suppkey")).alias("location_id"),
            F.when(k == 0, text('{"data":{"timeseries":[', full, ',"quality":"poor"}}}]}}'))
            .when(k == 1, text('{"timeseries":[{"year":"', year, '","seasons":{', season, '{"area_ha":', area,
                               ',"count":', count, '},"winter ":5}}]}'))
            .when(k == 2, text('{"data":[{"year":', year, ',"seasons":{', season, '{"area_ha":"', area,
                               '","count":', count, '.7,"quality":null}}}]}'))
            .when(k == 3, text('[{"year":', year, ',"seasons":{', season, '{"count":"x"}}}]'))
            .when(k == 4, text('{"data":{"timeseries":[{"year":', year, '.5,"seasons":{', season,
                               '{"area_ha":1,"count":1}}}]}}'))
            .when(k == 5, text('{"data":{"timeseries":[{"year":', year, ',"seasons":{"autumn":{"area_ha":1},',
                               season, '{"area_ha":', area, ',"count":-', count, '}}}]}}'))
            .when(k == 6, text("<html>", count, "</html>"))
            .when(k == 8, text('[{"year":', year, ',"seasons":{', season, '{"area_ha":"nan","count":', count, '}}}]'))
            .when(k == 9, text('[{"year":', year, ',"seasons":{', season, '{"area_ha":1,"area_ha":', area,
                               ',"count":1,"count":', count, '}}}]'))
            .when(k == 10, text('[{"year":1,"seasons":{}},{"year":', year, ',"seasons":{', season,
                                '{"area_ha":NaN,"count":', count, '}}}]'))
            .when(k == 11, text('[{"year":', year, ',"seasons":{', season, '{"area_ha":', area, ',"count":30000000', count, '}}}]'))
            .otherwise(text('{"timeseries":[5,{"seasons":{}},{"year":', year, ',"seasons":[]},{"year":', year,
                            ',"seasons":{', season, '5}}]}'))
            .alias("document"),
        )

    @cached_property
    def unit_documents(self) -> DataFrame:
        """One listing per supplier: a village, its district, and entries that are not units; not all strict JSON."""
        def item(*pairs: tuple[str, Column]) -> Column:
            return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))

        nation = F.concat(F.lit("State "), F.col("s_nationkey").cast("string"))
        village = item(("id", _place("s_suppkey")), ("name", F.col("s_name")), ("type", F.lit("village")),
                       ("state", nation), ("code", F.col("s_suppkey")))
        district = item(("id", F.concat(F.lit("D"), F.col("s_suppkey").cast("string"))),
                        ("name", F.col("s_name")), ("type", F.lit("district")), ("state", nation))
        nameless = item(("id", _place("s_suppkey")), ("type", F.lit("village")), ("state", nation))
        # Some listings hold a bare NaN, a repeated key, or both.
        k = F.col("s_suppkey")
        other = F.when(k % 3 == 0, "NaN").when(k % 3 == 1, '{"id":1,"id":2}').otherwise('{"id":NaN,"id":2}')
        village = F.when(k % 2 == 0, F.concat(F.lit('{"name":"old",'), F.substring(village, F.lit(2), F.length(village)))).otherwise(village)
        return self.table("supplier").select(
            F.concat(F.lit('{"data":['), F.concat_ws(",", village, district, nameless, F.lit("7"), other),
                     F.lit("]}")).alias("document"))

    @cached_property
    def elevation_documents(self) -> DataFrame:
        """A two-by-three grid per part, some with a bare NaN or a repeated key; every third part has none."""
        k = F.col("p_partkey")
        price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
        grid = F.concat(F.lit("[["), F.concat_ws(",", price, size, F.lit("0")), F.lit("],["),
                        F.concat_ws(",", size, F.when(k % 3 == 1, "NaN").otherwise('"x"'), price), F.lit("]]"))
        return self.table("part").select(
            F.concat(F.lit("P"), k.cast("string")).alias("location_id"),
            F.concat(F.lit('{"data":{"elevation_grid":'), F.when(k % 3 == 0, F.lit("5")).otherwise(grid),
                     F.when(k % 2 == 0, ',"resolution":30}}').otherwise(',"resolution":10,"resolution":30}}')).alias("document"))
