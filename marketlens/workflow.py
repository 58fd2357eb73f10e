"""From delivered files to marts: profile, clean, validate, publish."""

from __future__ import annotations

import hashlib
from collections.abc import Collection, Mapping

from pyspark.sql import SparkSession

from marketlens.operators.clean import clean_tables
from marketlens.operators.quality import cast_losses, check_cast_losses, chosen_layouts, table_contents, validate
from marketlens.plans import marts
from marketlens.schema import RawTables, Tables
from marketlens.session import scratch_folder
from marketlens.sources import files, releases


def prepare(
    spark: SparkSession, raw: RawTables, staged: str | None = None, layouts: Mapping[str, Mapping[str, str]] | None = None
) -> Tables:
    """Clean and validate; raises before anything is exported.

    The delivered texts are parsed once and written below ``staged``, by default a new shared scratch folder; checks and
    cleaning read that. So are the cleaned tables: the checks then read key columns only, and a lost executor
    costs no second cleaning. Timestamps have the layout that most texts of their column have, unless ``layouts``
    (per table and column) declares one.
    """
    staged = staged or scratch_folder(spark, "staged")
    for name, df in raw.as_dict().items():
        df.write.mode("overwrite").parquet(f"{staged}/texts/{name}")
    texts = RawTables(**{name: spark.read.parquet(f"{staged}/texts/{name}") for name in RawTables.NAMES})
    known = chosen_layouts(texts.as_dict(), layouts)
    check_cast_losses(cast_losses(texts.as_dict(), known))
    files.write_processed(clean_tables(texts, known), f"{staged}/cleaned")
    tables = files.read_processed(spark, f"{staged}/cleaned")
    validate(tables)
    return tables


def contents_id(tables: Tables) -> str:
    """An id of the contents of all tables, whatever the order of their rows: the digest of a row per column."""
    report = table_contents(tables.as_dict()).orderBy("table_name", "column_name").collect()
    return hashlib.sha256(repr([tuple(row) for row in report]).encode()).hexdigest()


def run(
    spark: SparkSession,
    raw_folder: str,
    out_folder: str,
    *,
    file_names: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    database: str | None = None,
    buckets: int | None = None,
    mode: str = "overwrite",
    batch: str | None = None,
    single_line: Collection[str] = (),
) -> dict[str, int]:
    """Process delivered files and return the rows added to each published table.

    Below ``out_folder`` come ``processed`` (cleaned tables in ``fmt``) and ``marts``; the tables
    are published to the catalog ``database`` or, without one, to ``published``. The marts are
    registered as views over the published tables. Appending names the batch by its contents
    unless ``batch`` does: the same delivery adds nothing when it is appended again. ``single_line``
    declares delivered tables that have a record per line, which many tasks read.
    """
    if buckets and database is None:
        raise ValueError("buckets need a database: files in a folder are not bucketed")
    staged = scratch_folder(spark, "staged")
    tables = prepare(spark, files.read_raw(spark, raw_folder, file_names, single_line), staged)
    files.write_processed(tables, f"{out_folder}/processed", fmt)
    if mode == "append" and batch is None:
        batch = contents_id(tables)
    if database is None:
        folder = f"{out_folder}/published"
        written = files.publish(tables, folder=folder, mode=mode, batch=batch)
        published = files.read_processed(spark, folder)
    else:
        written = files.publish(tables, database=database, mode=mode, buckets=buckets, batch=batch)
        published = files.read_published(spark, database)
    marts.register_views(published)
    marts.write_marts(published, f"{out_folder}/marts")
    # the copies in the scratch folder are kept only if the run failed
    releases.remove_folder(spark, staged)
    return written
