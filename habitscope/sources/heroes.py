"""The hero dimension: traits, structural jobs, reviewed records, evidence artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitscope.constants import DEMANDS, FAMILIES, JOB_ALIASES, JOBS, ROLE_POSITIONS
from habitscope.sources.views import TRAITS

POSITIONS = ("1", "2", "3", "4", "5")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def canonical_job(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(JOB_ALIASES), name), name)


def family_of(job: Column) -> Column:
    return F.try_element_at(literal_map({j: f for f, jobs in FAMILIES.items() for j in jobs}), job)


def load_traits(factual: DataFrame, editorial: DataFrame) -> DataFrame:
    """Factual and editorial hero rows on the same ids, with a checksum of the traits."""
    joined = factual.join(editorial, "hero_id", "full_outer")
    return joined.withColumn(
        "checksum", F.sha2(F.to_json(F.array_sort(F.map_entries("traits"))), 256)
    )


def trait_errors(factual: DataFrame, editorial: DataFrame) -> DataFrame:
    """Ids in one snapshot only, incomplete trait sets and values outside [0, 1]."""
    left, right = factual.select("hero_id"), editorial.select("hero_id")
    names = F.array(*[F.lit(t) for t in TRAITS])
    bad = editorial.select(
        "hero_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.array_sort(F.map_keys("traits")) != names, F.lit("incomplete_traits")),
                    F.when(
                        F.exists(F.map_values("traits"), lambda v: (v < 0) | (v > 1)), F.lit("trait_out_of_range")
                    ),
                )
            )
        ).alias("error"),
    )
    return (
        left.join(right, "hero_id", "left_anti")
        .withColumn("error", F.lit("missing_editorial"))
        .unionByName(right.join(left, "hero_id", "left_anti").withColumn("error", F.lit("missing_factual")))
        .unionByName(bad)
    )


def structural(traits: DataFrame) -> DataFrame:
    """Jobs, demands and capabilities that follow from the traits alone."""

    def value(name: str) -> Column:
        return F.coalesce(F.try_element_at("traits", F.lit(name)), F.lit(0.0))

    strong = F.filter(F.array_sort(F.map_entries("traits")), lambda e: e["value"] >= 0.60)
    jobs = F.filter(
        F.transform(strong, lambda e: canonical_job(e["key"])), lambda j: F.array_contains(F.array(*map(F.lit, JOBS)), j)
    )
    frontline, initiation = value("frontline") >= 0.60, value("initiation") >= 0.60
    pressure = F.when(frontline, "high").when(initiation, "medium")
    entries = F.array_compact(
        F.array(
            *[
                F.when(band.isNotNull(), F.struct(F.lit(k).alias("key"), band.alias("value")))
                for k, band in (
                    ("commitment", pressure),
                    ("exposure", pressure),
                    (
                        "access",
                        F.when((value("mobility") < 0.60) & (value("global_presence") < 0.60), F.lit("unknown")),
                    ),
                    ("economy", F.when(value("farm_dependency") >= 0.60, F.lit("high"))),
                    ("micro", F.when(value("micro_intensity") >= 0.60, F.lit("high"))),
                    ("execution", F.when(value("complexity") >= 0.60, F.lit("high"))),
                )
            ]
        )
    )
    role = F.col("role")
    position = F.try_element_at(literal_map(ROLE_POSITIONS), role)
    return traits.withColumn("_jobs", jobs).select(
        "hero_id",
        "traits",
        F.array(role).alias("roles"),
        "available",
        F.slice("_jobs", 1, 3).alias("primary_functions"),
        F.slice(F.array_except("_jobs", F.slice("_jobs", 1, 3)), 1, 4).alias("secondary_functions"),
        F.map_from_entries(entries).alias("demands"),
        F.map_from_arrays(
            F.array(*[F.lit(p) for p in POSITIONS]),
            F.array(*[F.when(position == p, "primary").otherwise("unsupported") for p in POSITIONS]),
        ).alias("position_credibility"),
    )


REVIEWED = T.StructType(
    [
        T.StructField("hero_id", T.LongType()),
        T.StructField("review_status", T.StringType()),
        T.StructField("primary_functions", T.ArrayType(T.StringType())),
        T.StructField("secondary_functions", T.ArrayType(T.StringType())),
        T.StructField("demands", T.MapType(T.StringType(), T.StringType())),
        T.StructField("position_credibility", T.MapType(T.StringType(), T.StringType())),
        T.StructField("empirical_support", T.StringType()),
        T.StructField("confidence", T.StringType()),
    ]
)


def compose(structure: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Full roster: a reviewed record wins, every other hero keeps its structural record.

    Structural records are marked unreviewed with low confidence and unknown positions.
    """
    usable = reviewed.where(F.col("review_status").isin("approved", "reviewed"))
    known = F.array(*[F.lit(j) for j in JOBS])
    demand_names = F.array(*[F.lit(d) for d in DEMANDS])

    def clean(column: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(column, canonical_job), lambda j: F.array_contains(known, j)))

    records = usable.select(
        "hero_id",
        F.lit(True).alias("_reviewed"),
        F.col("review_status").alias("_status"),
        clean(F.col("primary_functions")).alias("_primary"),
        F.array_except(clean(F.col("secondary_functions")), clean(F.col("primary_functions"))).alias("_secondary"),
        F.map_filter("demands", lambda k, _: F.array_contains(demand_names, k)).alias("_demands"),
        F.col("position_credibility").alias("_positions"),
        F.coalesce("empirical_support", F.lit("unknown")).alias("_support"),
        F.when(F.col("confidence") == "moderate", "medium")
        .when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence"))
        .otherwise("low")
        .alias("_confidence"),
    )
    unknown = F.map_from_arrays(
        F.array(*[F.lit(p) for p in POSITIONS]), F.array(*[F.lit("unknown") for _ in POSITIONS])
    )
    ok = F.coalesce("_reviewed", F.lit(False))
    out = structure.join(records, "hero_id", "left").select(
        "hero_id",
        "traits",
        "roles",
        "available",
        F.when(ok, F.col("_primary")).otherwise(F.col("primary_functions")).alias("primary_functions"),
        F.when(ok, F.col("_secondary")).otherwise(F.col("secondary_functions")).alias("secondary_functions"),
        F.when(ok, F.col("_demands")).otherwise(F.col("demands")).alias("demands"),
        F.coalesce("_positions", unknown).alias("position_credibility"),
        F.when(ok, F.col("_status")).otherwise("unreviewed").alias("review_status"),
        F.coalesce("_support", F.lit("unknown")).alias("empirical_support"),
        F.when(ok, F.col("_confidence")).otherwise("low").alias("confidence"),
    )
    functions = F.array_distinct(F.concat("primary_functions", "secondary_functions"))
    return out.withColumns(
        {
            "functions": functions,
            "families": F.array_distinct(F.transform(functions, family_of)),
            "reviewed": F.col("review_status").isin("approved", "reviewed"),
        }
    )


def knowledge(traits: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """The composed dimension; without reviewed records every hero keeps its structural one."""
    structure = structural(traits)
    if reviewed is None:
        reviewed = structure.limit(0)
    return compose(structure, reviewed)


def packed_roster(dimension: DataFrame) -> DataFrame:
    """One row with the sorted ids of the roster."""
    return dimension.agg(F.sort_array(F.collect_set("hero_id")).alias("roster"))


EVIDENCE = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField(
            "records",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, T.StringType())
                        for n in (
                            "hero_id",
                            "related_hero_id",
                            "sample_size",
                            "adjusted_score",
                            "confidence_score",
                            "patch_scope",
                        )
                    ]
                )
            ),
        ),
    ]
)


def evidence_records(artifact: DataFrame, version: str) -> DataFrame:
    """Usable records of an artifact; a file of another version and records with a bad field are skipped."""
    return (
        artifact.where(F.col("version") == version)
        .select(F.explode("records").alias("r"))
        .select(
            F.col("r.hero_id").try_cast("bigint").alias("hero_id"),
            F.col("r.related_hero_id").try_cast("bigint").alias("related_hero_id"),
            F.greatest(F.lit(0), F.coalesce(F.col("r.sample_size"), F.lit("0")).try_cast("bigint")).alias("sample_size"),
            F.coalesce(F.col("r.adjusted_score"), F.lit("0")).try_cast("double").alias("adjusted_score"),
            F.coalesce(F.col("r.confidence_score"), F.lit("0")).try_cast("double").alias("confidence_score"),
            F.coalesce(F.col("r.patch_scope"), F.lit("unknown")).alias("patch_scope"),
        )
        .dropna()
    )


def representative(records: DataFrame, minimum: float = 0.65, limit: int = 3) -> DataFrame:
    """The best related heroes of each hero."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("hero_id").orderBy(
        F.desc("confidence_score"), F.desc("adjusted_score"), F.desc("sample_size"), "related_hero_id"
    )
    ranked = records.where(F.col("confidence_score") >= minimum).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= limit)
