"""Readers with explicit schemas and the tables that jobs write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitscope.functions.digest import content_digest
from habitscope.operators.knowledge import HERO_DETAIL
from habitscope.operators.matches import DETAIL
from habitscope.operators.normalize import RAW_SUMMARY


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Raw history rows of all accounts, one JSON document per line.

    Every field is read as text and typed by the cleaning. Numbers lose their fraction here, while
    it is still known that they are numbers: 12.5 counts as 12, but the text "12.5" is no whole number.
    """
    docs = spark.read.option("singleVariantColumn", "doc").json(path)

    def field(name: str) -> Column:
        place = f"$.{name}"
        kind = F.schema_of_variant(F.try_variant_get("doc", place, "variant"))
        whole = F.try_variant_get("doc", place, "double").cast("bigint").cast("string")
        text = F.try_variant_get("doc", place, "string")
        return F.when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), whole).otherwise(text)

    return docs.select(*[field(f.name).cast(f.dataType).alias(f.name) for f in RAW_SUMMARY.fields])


def read_detail(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Match details, one document per file, or with ``per_line`` one per line, so that files can be split."""
    return spark.read.schema(DETAIL).json(path, multiLine=not per_line)


def read_roster(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    return spark.read.schema(HERO_DETAIL).json(path, multiLine=not per_line)


def read_documents(
    spark: SparkSession, path: str, schema: T.StructType, identity: str, parts: Sequence[str] = ()
) -> DataFrame:
    """Nested documents, one per line, typed by ``schema``, none of them lost: see :func:`typed_documents`."""
    return typed_documents(spark.read.text(path), schema, identity, parts)


def typed_documents(
    lines: DataFrame, schema: T.StructType, identity: str, parts: Sequence[str] = ()
) -> DataFrame:
    """The fields of JSON documents in the column ``value``, their ``problem`` and whether they are ``usable``.

    A document that is blank or null, no JSON, no object, without ``identity`` or without one of the lists ``parts``
    stays as a row that is not usable.  A field of another type than the schema's is null, also inside a list, and
    the document stays usable as ``wrong_type``.  Names that are not in the schema are ignored.
    """
    broken = "_broken"
    typed = F.from_json(
        "value", T.StructType([*schema.fields, T.StructField(broken, T.StringType())]), {"columnNameOfCorruptRecord": broken}
    )
    # A parsed document is a row of its own, so a filter on it does not parse the text again for each field it reads.
    read = lines.select("value", F.explode(F.array(typed)).alias("d"))
    # The text is parsed a second time only where the first time left something open.
    kind = F.schema_of_variant(F.try_parse_json("value"))
    open_ = F.col(f"d.{broken}").isNotNull() | F.col(f"d.{identity}").isNull()
    problem = F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "blank").when(
        open_,
        F.when(kind.isNull(), "not_json")
        .when(~kind.startswith("OBJECT"), "not_an_object")
        .when(F.col(f"d.{identity}").isNull(), f"no_{identity}"),
    )
    for part in parts:
        problem = F.coalesce(problem, F.when(F.col(f"d.{part}").isNull(), f"no_{part}"))
    problem = F.coalesce(problem, F.when(F.col(f"d.{broken}").isNotNull(), "wrong_type"))
    return read.select(
        *[F.col("d")[f.name].alias(f.name) for f in schema.fields], problem.alias("problem")
    ).withColumn("usable", F.col("problem").isNull() | (F.col("problem") == "wrong_type"))


def document_ledger(documents: DataFrame) -> DataFrame:
    """Documents by problem, ``none`` for those without one; with :func:`typed_documents` they sum to all lines."""
    return documents.groupBy(F.coalesce("problem", F.lit("none")).alias("problem"), "usable").agg(
        F.count(F.lit(1)).alias("documents")
    )


_ENDPOINTS = {
    "durations": "duration_bin bigint, games_played bigint, wins bigint",
    "matchups": "hero_id bigint, games_played bigint, wins bigint",
    "itemPopularity": "start_game_items map<string,bigint>, early_game_items map<string,bigint>, "
    "mid_game_items map<string,bigint>, late_game_items map<string,bigint>",
}


def read_aggregates(spark: SparkSession, folder: str, ranks: int = 8) -> dict[str, DataFrame]:
    """Hero statistics and the per-hero files, which carry the hero id in their path."""
    fields = ["id bigint", "localized_name string", "pub_pick bigint", "pub_win bigint", "pro_pick bigint", "pro_win bigint"]
    fields += [f"`{r}_{k}` bigint" for r in range(1, ranks + 1) for k in ("pick", "win")]
    stats = spark.read.schema(", ".join(fields)).json(f"{folder}/heroStats.json", multiLine=True)

    def per_hero(name: str) -> DataFrame:
        frame = spark.read.schema(_ENDPOINTS[name]).json(f"{folder}/heroes/*/{name}.json", multiLine=True)
        hero = F.regexp_extract(F.col("_metadata.file_path"), r"/heroes/(\d+)/", 1).cast("bigint")
        return frame.withColumn("owner_id", hero)

    durations = per_hero("durations").withColumnRenamed("owner_id", "hero_id")
    matchups = per_hero("matchups").select(
        F.col("owner_id").alias("hero_id"),
        F.col("hero_id").alias("opponent"),
        F.col("games_played").alias("games"),
        "wins",
    )
    phases = ("start_game_items", "early_game_items", "mid_game_items", "late_game_items")
    items = per_hero("itemPopularity").select(
        F.col("owner_id").alias("hero_id"),
        F.create_map(
            *[
                x
                for p in phases
                for x in (F.lit(p), F.coalesce(F.col(p), F.create_map().cast("map<string,bigint>")))
            ]
        ).alias("phases"),
    )
    return {
        "stats": stats.withColumnRenamed("id", "hero_id"),
        "durations": durations,
        "matchups": matchups,
        "items": items,
    }


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A source that may be broken: rows keep a status and never fail the job."""
    with_corrupt = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    names = [f.name for f in with_corrupt.fields if f.name != "_corrupt_record"]
    frame = spark.read.schema(with_corrupt).option("mode", "PERMISSIVE").json(path)
    return optional_status(frame, names)


def optional_status(frame: DataFrame, names: list[str]) -> DataFrame:
    """Status of optional rows: broken, empty, partly filled, or available."""
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in frame.columns else F.lit(False)
    status = (
        F.when(corrupt, "invalid_schema")
        .when(known == 0, "unavailable")
        .when(known < len(names), "partial")
        .otherwise("available")
    )
    return frame.withColumn("status", status).drop("_corrupt_record")


# Sinks ---------------------------------------------------------------------------------------


def payload_hash(payload: Column) -> Column:
    """Hash of the canonical text of a payload map: entries sorted by key."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(payload))), 256)


PAYLOAD_KEY = ("endpoint", "source_id", "payload_hash")


def new_payloads(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming payloads that are not stored yet, once each: the earliest fetch."""
    hashed = incoming.withColumn("payload_hash", payload_hash(F.col("payload")))
    once = hashed.groupBy(*PAYLOAD_KEY).agg(
        F.min_by("payload", "fetched_at").alias("payload"), F.min("fetched_at").alias("fetched_at")
    )
    return once.join(stored.select(*PAYLOAD_KEY), list(PAYLOAD_KEY), "left_anti")


def latest_payload(stored: DataFrame, now: int, max_age: int) -> DataFrame:
    return (
        stored.where(F.col("fetched_at") >= now - max_age)
        .groupBy("endpoint", "source_id")
        .agg(F.max(F.struct("fetched_at", "payload_hash")).alias("_last"))
        .select("endpoint", "source_id", "_last.payload_hash", "_last.fetched_at")
    )


def purge(
    reports: DataFrame, evidence: DataFrame, payloads: DataFrame, now: int | Column, retention: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What stays of reports, evidence and payloads, and how many rows go."""
    old = (F.col("expires_at") <= now) | (F.col("created_at") < now - retention)
    old = F.coalesce(old, F.lit(False))
    kept = reports.where(~old)
    kept_evidence = evidence.join(kept.select("report_id"), "report_id", "left_semi")
    kept_payloads = payloads.where(F.col("fetched_at") >= now - retention)
    gone = (
        reports.where(old)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit("reports").alias("table"), "rows")
        .unionByName(
            payloads.where(F.col("fetched_at") < now - retention)
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit("payloads").alias("table"), "rows")
        )
    )
    return kept, kept_evidence, kept_payloads, gone


def history_hash(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """account_id, rows and history_hash: content digest of an account's history, free of order."""
    return content_digest(rows, ["account_id"], columns).withColumnRenamed("digest", "history_hash")


def reusable(wanted: DataFrame, reports: DataFrame, now: int | Column, ttl: int) -> DataFrame:
    """The newest finished report per wanted account, model, mode and unchanged history, young enough.

    ``wanted`` has account_id, fingerprint, mode, history_hash and identity; accounts missing
    from the result are the ones to score again.
    """
    keys = ["account_id", "fingerprint", "mode", "history_hash", "identity"]
    usable = reports.where((F.col("status") == "completed") & (F.col("created_at") >= now - ttl))
    newest = usable.groupBy(*keys).agg(
        F.max_by("report_id", F.struct("created_at", "report_id")).alias("report_id"),
        F.max("created_at").alias("created_at"),
    )
    return wanted.join(newest, keys)


def write_table(df: DataFrame, path: str, partition: str | None = None, files_by: str | None = None) -> None:
    """Partitioned parquet; rows of one partition are spread over tasks by ``files_by``."""
    out = df.repartition(partition, files_by) if partition and files_by else df
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
