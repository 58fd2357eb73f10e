"""CSV and parquet readers and writers.

Text files are read without type inference, which would scan them an extra time. A table may have
quoted fields with line breaks, so a file of up to ``STREAM_BYTES`` is read as a stream by one task; a
larger one is divided among tasks, once it is known which of its splits begin within a quoted field. A
table that is *declared* to have a record per line is read by as many tasks as its files have blocks,
and stops the run where the declaration does not hold.
"""

from __future__ import annotations

import csv
import re
import warnings
from collections.abc import Collection, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.text import cast_known, missing_to_null
from marketlens.schema import COLUMN_TYPES, LOAD_ORDER, RAW_TABLES, RawTables, Tables
from marketlens.sources import releases
from marketlens.sources.releases import BATCH, Batch, Release

BY_ORDER = frozenset({"orders", "reviews", "order_items"})
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}
#: Largest text file that one task reads as a stream.
STREAM_BYTES = 256 << 20
#: Records of a text file that is written.
FILE_RECORDS = 1_000_000
# A line, from the start of a field, that ends within a quoted one; and what ends a quoted field that is open.
OPENING = re.compile(r'(?:(?:[^",][^,]*+|"(?:[^"]++|"")*+"[^,]*+)?+,)*+"(?:[^"]++|"")*+\Z')
CLOSING = re.compile(r'(?:[^"]++|"")*+"[^,]*+')


def read_csv_table(spark: SparkSession, path: str, single_line: bool = False) -> DataFrame:
    """One table as text columns, with missing-value texts as NULL.

    ``single_line`` declares that every record is one line (see ``read_lines``). It is for the caller
    to say, whatever the size: nothing is guessed from the files.
    """
    if single_line:
        return missing_to_null(read_lines(spark, path))
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]  # lengths only, no content
    if (largest or 0) > STREAM_BYTES:
        return missing_to_null(read_divided(spark, path))
    return missing_to_null(spark.read.csv(path, multiLine=True, **CSV_OPTIONS))


def ends_open(line: str, opened: bool) -> bool:
    """Whether a quoted field is open after a line, if one is before it."""
    if '"' not in line:
        return opened
    if not opened:
        return OPENING.match(line) is not None
    closed = CLOSING.match(line)
    return closed is None or (closed.end() < len(line) and OPENING.match(line, closed.end() + 1) is not None)


def read_divided(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """A table whose quoted fields may hold line breaks; its files are divided among tasks.

    A first pass finds for each split of a file whether a quoted field is open at its end, if one was or
    was not at its begin: one row per split. A record that goes on in the next split is completed by the
    task in whose split it begins. Lines end with ``\\n`` or ``\\r\\n``.
    """
    conf = {"textinputformat.record.delimiter": "\n"}
    if split_bytes:
        conf["mapreduce.input.fileinputformat.split.maxsize"] = str(split_bytes)
    types = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"
    # pairs of offset and line; the splits of one RDD are the same in every pass
    lines = spark.sparkContext.newAPIHadoopFile(path, *types, conf=conf)

    def measure(split: int, rows: Iterator[tuple[int, str]]) -> Iterator[tuple[int, int, bool, bool]]:
        begin, closed, opened = -1, False, True
        for offset, line in rows:
            begin = offset if begin < 0 else begin
            if '"' in line:
                closed, opened = ends_open(line, closed), ends_open(line, opened)
        yield split, begin, closed, opened

    opens: dict[int, bool] = {}
    state = False
    for split, begin, closed, opened in sorted(lines.mapPartitionsWithIndex(measure).collect()):
        opens[split] = state = state and begin != 0
        state = opened if state else closed

    def head(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[list[str], bool]]:
        """The lines that a split holds of the record before it, and whether that ends there."""
        held, opened = [], True
        for _, line in rows:
            held.append(line)
            opened = ends_open(line, opened)
            if not opened:
                break
        yield held, not opened

    late = [split for split, opened in opens.items() if opened]
    heads = dict(zip(late, spark.sparkContext.runJob(lines, head, late) if late else [], strict=True))
    rest: dict[int, list[str]] = {}
    for split in late:
        if not opens.get(split - 1) or heads[split - 1][1]:
            begin = split - 1
        rest.setdefault(begin, []).extend(heads[split][0])

    def records(split: int, rows: Iterator[tuple[int, str]]) -> Iterator[tuple[str]]:
        opened = before = opens[split]
        held: list[str] = []
        header = None
        for offset, line in rows:
            header = offset == 0 if header is None else header
            opened = ends_open(line, opened)
            if before:
                before = opened
                continue
            held.append(line)
            if not opened:
                record, held = "\n".join(held).removesuffix("\r"), []
                if record and not header:
                    yield (record,)
                header = header and not record
        if held:
            record = "\n".join([*held, *rest.get(split, [])]).removesuffix("\r")
            if not header:
                yield (record,)

    given = spark.read.csv(path, multiLine=True, **CSV_OPTIONS).schema
    options = {name: str(value) for name, value in CSV_OPTIONS.items() if name != "header"} | {"multiLine": "true"}
    rows = spark.createDataFrame(lines.mapPartitionsWithIndex(records), "record string", verifySchema=False)
    names = [f"c{i}" for i in range(len(given))]
    fields = F.from_csv("record", F.lit(", ".join(f"{name} string" for name in names)), options)
    return rows.select(fields.alias("r")).select(*(F.col(f"r.{name}").alias(f.name) for name, f in zip(names, given, strict=True)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A table with a record per line; its files, with one header each, are divided among tasks.

    A line with another number of fields than the header or an odd number of quotes, as any line
    break within a field leaves behind, raises an error when it is read. So does a bare quote in a text.
    """
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        return spark.read.csv(path, multiLine=True, **CSV_OPTIONS)
    names = next(csv.reader([header["value"]]))
    corrupt = "_corrupt_record"
    schema = ", ".join("`{}` string".format(name.replace("`", "``")) for name in [*names, corrupt])
    options = {name: str(value) for name, value in CSV_OPTIONS.items() if name != "header"}
    fields = F.from_csv("value", F.lit(schema), options | {"columnNameOfCorruptRecord": corrupt})
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = (quotes % 2 == 1) | F.col("record")[corrupt].isNotNull()
    error = F.raise_error(F.concat(F.lit(f"{path}: no record of {len(names)} fields in one line: "), F.substring("value", 1, 200)))
    records = lines.where((F.col("value") != header["value"]) & (F.col("value") != "")).withColumn("record", fields)
    whole = records.where(F.when(broken, error.cast("boolean")).otherwise(True))
    return whole.select(*(F.col("record")[name].alias(name) for name in names))


def read_raw(
    spark: SparkSession, folder: str, file_names: Mapping[str, str] | None = None, single_line: Collection[str] = ()
) -> RawTables:
    """The seven delivered tables. ``file_names`` maps a table to its file or folder name, ``single_line`` declares tables."""
    names = {table: f"{table}.csv" for table in RAW_TABLES} | dict(file_names or {})
    return RawTables(**{table: read_csv_table(spark, f"{folder}/{names[table]}", table in single_line) for table in RAW_TABLES})


def write_csv_table(df: DataFrame, path: str) -> None:
    """One table as CSV with a header and without an index.

    Empty text is written quoted, NULL as nothing, so the two stay apart for other readers.
    Timestamps are written in the layout the cleaning step reads. No file has more than ``FILE_RECORDS``
    records, so that a table is read by as many tasks as its size asks for.
    """
    texts = {f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    df.withColumns(texts).write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).csv(path, nullValue="", emptyValue='""', **CSV_OPTIONS)


def write_processed(tables: Tables, folder: str, fmt: str = "parquet") -> None:
    """The six cleaned tables, one folder per table; a table is replaced as a whole."""
    for name, df in tables.as_dict().items():
        if fmt == "csv":
            write_csv_table(df, f"{folder}/{name}.csv")
        else:
            df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def read_processed(spark: SparkSession, folder: str, fmt: str = "parquet") -> Tables:
    """The six cleaned tables. CSV text is cast to the declared types; flags keep NULL apart from False.

    A folder of published tables gives the rows of its current release.
    """
    release = releases.read_pointer(spark, folder)
    if release is not None:
        return Tables(**{name: released(spark, release, name, folder=folder) for name in LOAD_ORDER})
    if fmt != "csv":
        return Tables(**{name: spark.read.format(fmt).load(f"{folder}/{name}") for name in LOAD_ORDER})
    return Tables(
        **{
            name: cast_known(read_csv_table(spark, f"{folder}/{name}.csv"), COLUMN_TYPES[name])
            for name in LOAD_ORDER
        }
    )


def buckets_balance(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether no bucket of the key would hold more than four times the average."""
    sizes = df.groupBy(F.pmod(F.hash(key), F.lit(buckets))).agg(F.count(F.lit(1)).alias("rows"))
    row = sizes.agg(F.max("rows").alias("largest"), F.sum("rows").alias("total")).first()
    return row["total"] is not None and row["largest"] * buckets <= 4 * row["total"]


def stored_buckets(spark: SparkSession, table: str) -> int | None:
    """Buckets of a catalog table, or None."""
    described = {row["col_name"]: row["data_type"] for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return int(described["Num Buckets"]) if "Num Buckets" in described else None


def check_same_columns(name: str, batch: DataFrame, stored: DataFrame) -> None:
    """Raise unless the batch can be added to the stored rows."""
    if sorted(batch.dtypes) != sorted(stored.dtypes):
        raise ValueError(f"{name}: cannot append {sorted(batch.dtypes)} to {sorted(stored.dtypes)}")


def publish(
    tables: Tables,
    *,
    database: str | None = None,
    folder: str | None = None,
    mode: str = "overwrite",
    buckets: int | None = None,
    batch: str | None = None,
) -> dict[str, int]:
    """Publish the six tables as one release, parents before children, and return the rows added to each.

    Tables go to a catalog database or, as parquet, to a folder. All six are checked and stored under
    the id of their batch; then one file is replaced, and readers of all six see them (see ``releases``).
    A failure at any time leaves every table as it was, or all of them new.

    ``mode="append"`` adds the batch to the release. ``batch`` names it; a batch that the release holds
    already adds nothing, so a repeated append is harmless. Without a name every append is a new batch.

    With ``buckets`` (catalog only) the three tables keyed by order are stored in buckets of the
    order id, and their joins need no shuffle. A bucket is read by one task, so a new table with a
    heavy bucket is stored without buckets; appending keeps the buckets a table has. Both give a warning.
    """
    if (database is None) == (folder is None):
        raise ValueError("publish to either a database or a folder")
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    batches = tables.as_dict()
    spark = batches["orders"].sparkSession
    home = database_folder(spark, database) if database else folder
    current = releases.read_pointer(spark, home)
    batch = releases.checked_id(batch or releases.new_id())
    adding = mode == "append" and current is not None
    if adding and batch in current.ids:
        if database:
            refresh_views(spark, database)
        return dict.fromkeys(batches, 0)
    if mode == "append" and current is None and any(plain_table_exists(spark, name, database, folder) for name in batches):
        raise ValueError(f"{database or folder} holds tables without a release; overwrite them first")
    for name, df in batches.items():
        if BATCH in df.columns:
            raise ValueError(f"{name}: {BATCH} is the name of the column of batches")
        if adding:
            check_same_columns(name, df, released(spark, current, name, database=database, folder=folder))
    release = current if adding else Release(releases.new_id(), previous=current.generation if current else None)
    layout = bucket_layout(batches, database, buckets, release if adding else None)

    for name, df in batches.items():
        store_batch(df, release, name, batch, database=database, folder=folder, buckets=layout[name])
    release = release.with_batch(Batch(batch, {}))
    written = {name: released(spark, release, name, database=database, folder=folder, only=batch).count() for name in batches}
    release.batches[-1].rows.update(written)
    releases.switch_pointer(spark, home, release)
    if database:
        refresh_views(spark, database)
    remove_old_generations(spark, database=database, folder=folder)
    return written


def bucket_layout(batches: Mapping[str, DataFrame], database: str | None, buckets: int | None, stored: Release | None) -> dict[str, int | None]:
    """Buckets of each table: those it has, or those wanted if no bucket is heavy."""
    layout: dict[str, int | None] = dict.fromkeys(batches)
    for name, df in batches.items():
        wanted = buckets if database and name in BY_ORDER else None
        if stored is not None:
            layout[name] = stored_buckets(df.sparkSession, stored_table(stored, database, name)) if database else None
        elif wanted and buckets_balance(df, "order_id", wanted):
            layout[name] = wanted
        if wanted != layout[name]:
            warnings.warn(f"{name} is stored with {layout[name] or 'no'} buckets instead of {wanted or 'none'}", stacklevel=3)
    return layout


def store_batch(
    df: DataFrame, release: Release, name: str, batch: str, *, database: str | None, folder: str | None, buckets: int | None
) -> None:
    """Store one table's rows of a batch; what an earlier attempt left of it is replaced."""
    if buckets:
        # one bucket per task, so that the number of files does not multiply with the tasks
        df = df.hint("rebalance", buckets, "order_id")
    if folder:
        df.write.mode("overwrite").parquet(f"{folder}/{release.generation}/{name}/{BATCH}={batch}")
        return
    table = stored_table(release, database, name)
    if df.sparkSession.catalog.tableExists(table):
        columns = ", ".join(f"`{c}`" for c in df.sparkSession.table(table).columns if c != BATCH)
        # only this batch's partition is replaced
        df.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = '{batch}') SELECT {columns} FROM {{rows}}", rows=df)
        return
    writer = df.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").format("parquet").partitionBy(BATCH)
    if buckets:
        writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
    writer.saveAsTable(table)


def stored_table(release: Release, database: str, name: str) -> str:
    """The catalog table that holds the batches of a generation."""
    return f"{database}.{name}__{release.generation}"


def database_folder(spark: SparkSession, database: str) -> str:
    return spark.catalog.getDatabase(database).locationUri


def released(
    spark: SparkSession, release: Release, name: str, *, database: str | None = None, folder: str | None = None, only: str | None = None
) -> DataFrame:
    """The rows of a table in a release, or of one of its batches; no other partition is read."""
    ids = [only] if only else release.ids
    if database:
        rows = spark.table(stored_table(release, database, name)).where(F.col(BATCH).isin(ids))
    else:
        base = f"{folder}/{release.generation}/{name}"
        rows = spark.read.option("basePath", base).parquet(*(f"{base}/{BATCH}={i}" for i in ids))
    return rows.drop(BATCH)


def read_published(spark: SparkSession, database: str) -> Tables:
    """The six tables of the current release of a database."""
    release = releases.read_pointer(spark, database_folder(spark, database))
    if release is None:
        raise ValueError(f"nothing is published in {database}")
    return Tables(**{name: released(spark, release, name, database=database) for name in LOAD_ORDER})


def plain_table_exists(spark: SparkSession, name: str, database: str | None, folder: str | None) -> bool:
    """Whether a stored table, no view of a release, has the plain name."""
    if folder:
        return releases.folder_exists(spark, f"{folder}/{name}")
    return spark.catalog.tableExists(f"{database}.{name}") and spark.catalog.getTable(f"{database}.{name}").tableType != "VIEW"


def refresh_views(spark: SparkSession, database: str) -> None:
    """Let the plain names of a database show its current release, for readers by SQL.

    The views follow the pointer one by one; ``read_published`` follows it at once.
    """
    release = releases.read_pointer(spark, database_folder(spark, database))
    listed = ", ".join(f"'{i}'" for i in release.ids)
    for name in LOAD_ORDER:
        if plain_table_exists(spark, name, database, None):
            spark.sql(f"DROP TABLE {database}.{name}")
        table = stored_table(release, database, name)
        columns = ", ".join(f"`{c}`" for c in spark.table(table).columns if c != BATCH)
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT {columns} FROM {table} WHERE {BATCH} IN ({listed})")


def remove_old_generations(spark: SparkSession, *, database: str | None, folder: str | None) -> None:
    """Remove the generations that are neither current nor the one before."""
    release = releases.read_pointer(spark, database_folder(spark, database) if database else folder)
    kept = {release.generation, release.previous}
    if folder:
        for name in releases.folders_in(spark, folder):
            if releases.is_id(name) and name not in kept:
                releases.remove_folder(spark, f"{folder}/{name}")
        return
    for table in spark.catalog.listTables(database):
        name, _, generation = table.name.rpartition("__")
        if name in LOAD_ORDER and releases.is_id(generation) and generation not in kept:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{table.name}")


def load_report(spark: SparkSession, written: Mapping[str, int]) -> DataFrame:
    """The counts of ``publish`` as rows, in the order the tables were loaded."""
    schema = T.StructType(
        [
            T.StructField("load_step", T.IntegerType()),
            T.StructField("table_name", T.StringType()),
            T.StructField("rows_loaded", T.LongType()),
        ]
    )
    return spark.createDataFrame([(i, name, rows) for i, (name, rows) in enumerate(written.items(), 1)], schema)
