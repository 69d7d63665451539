"""File intake: CSV to an all-text layer, all-text to a typed layer, load gates."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.sources.schemas import CORE_TABLES, ISSUE_SCHEMA, PARTITIONS, SCHEMAS, columns

DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


class IntakeError(RuntimeError):
    """A source a production refresh needs is missing or empty."""


BAD_LINE, FILE = "_bad_line", "_file"


def _lines(spark: SparkSession, path: str | list[str], ddl: str, with_file: bool = False) -> DataFrame:
    """Declared columns bound by the names in the header, and the text of lines that do not fit it; if asked, the file's name."""
    declared = StructType.fromDDL(ddl)
    reader = spark.read.option("header", True).option("nullValue", "")
    found = reader.csv(path).columns  # reads the first line alone
    missing, unknown = [c for c in declared.names if c not in found], [c for c in found if c not in declared.names]
    if missing or unknown:
        raise IntakeError(f"{path}: missing columns {missing}, unknown columns {unknown}")
    in_file = StructType([declared[c] for c in found]).add(BAD_LINE, "string")
    reader = reader.schema(in_file).option("enforceSchema", False).option("columnPruning", False)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    # A line is told bad by parsing its fields, so they have to be read; nothing of them is added.
    fields = F.substring(F.concat_ws("", *[F.col(c).cast("string") for c in declared.names]), 1, 0)
    file = [F.col("_metadata.file_name").alias(FILE)] if with_file else []
    return reader.csv(path).select(*declared.names, F.concat(BAD_LINE, fields).alias(BAD_LINE), *file)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header and a declared schema; an empty field is NULL.

    Columns are found by name, so their order in the file is free; a missing or
    unknown one is an error, and so is a file of a folder whose header differs.
    Lines with more or fewer fields than the header are left out here and
    returned by :func:`bad_lines`.
    """
    return _lines(spark, path, ddl).where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def bad_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The text of the lines :func:`read_csv` leaves out, to be kept for inspection."""
    return _lines(spark, path, ddl).where(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("line"))


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def write_text_layer(df: DataFrame, path: str) -> None:
    """Raw copy of a source, every column as text, so that no value is lost before casting."""
    as_text(df).write.mode("overwrite").parquet(path)


def lenient_cast(value: Column, to: str) -> Column:
    """Cast text; a value that does not fit becomes NULL. Dates and times must match the file format."""
    if to == "date":
        return F.when(value.rlike(DATE_TEXT), value.try_cast("date"))
    if to == "timestamp_ntz":
        return F.when(value.rlike(TIMESTAMP_TEXT), value.try_cast("timestamp_ntz"))
    return value if to == "string" else value.try_cast(to)


def typed_layer(text: DataFrame, fields: Iterable[tuple[str, str]]) -> DataFrame:
    """Typed columns in declared order; undeclared columns are kept as they are."""
    declared = dict(fields)
    known = [lenient_cast(F.col(c), t).alias(c) for c, t in declared.items() if c in text.columns]
    extra = [F.col(c) for c in text.columns if c not in declared]
    return text.select(*known, *extra)


MANIFEST = "name string, length long, modified long, lines long, content string"


def delivered(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Length and time of the files of a source, a file or a folder; one small record a file."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return {f.getPath().getName(): (f.getLen(), f.getModificationTime()) for f in found if f.isFile() and f.getPath().getName()[0] not in "._"}


def _known(spark: SparkSession, manifest: str) -> dict[str, tuple]:
    if not exists(spark, manifest):
        return {}
    return {r["name"]: tuple(r)[1:] for r in spark.read.schema(MANIFEST).json(manifest).collect()}


def _contents(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, str]]:
    """Number of lines and a hash of all lines, whatever their order, for each file."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("name"), F.xxhash64("value").alias("h"), F.crc32(F.col("value").cast("binary")).alias("c"))
    sums = lines.groupBy("name").agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"), F.sum("c").alias("c"), F.sum(F.shiftrightunsigned("h", 24)).alias("g"))
    return {r["name"]: (r["n"], f"{r['h']}:{r['c']}:{r['g']}") for r in sums.collect()}


def observed(df: DataFrame, totals: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, object]:
    """Write a frame and return totals of its rows that were counted while they were written: no second scan."""
    seen = Observation()
    write(df.observe(seen, *[value.alias(name) for name, value in totals.items()]))
    return seen.get


def control_totals(fields: Iterable[tuple[str, str]], present: Iterable[str], typed: bool) -> dict[str, Column]:
    """Rows, and for each amount the number and the exact sum of its values, in a text layer as they will be cast or in a typed one."""
    totals = {"rows": F.count(F.lit(1))}
    for name, kind in fields:
        if kind == "double" and name in present:
            value = (F.col(name) if typed else lenient_cast(F.col(name), kind)).cast("decimal(38,6)")
            totals |= {f"{name} values": F.count(value), f"{name} sum": F.coalesce(F.sum(value), F.lit(0)).cast("string")}
    return totals


TOTALS = "table_name string, total string, text_layer string, typed_layer string, equal boolean"


def refresh_table(spark: SparkSession, name: str, csv_path: str, bronze: str, silver: str) -> list[tuple]:
    """New and changed CSV files to the text layer and on to the typed layer of one people table.

    ``csv_path`` is a file or a folder of files. A manifest keeps length, time
    and contents of each file: a file with the same length and time is not
    opened, one that was only touched is hashed but not parsed again, and the
    text layer keeps a part for each file, of which only those of new or changed
    files are rewritten. Parts of files that are gone are removed. If nothing
    changed, nothing is written and the result is empty.

    Lines that do not fit the header go to ``{bronze}/{name}_bad_lines``. Tables
    read by month are partitioned by it and sorted by employee inside. Rows and
    amounts are added up while both layers are written; the totals are returned
    as rows of table, total, text layer, typed layer, equal.
    """
    text_path, manifest = f"{bronze}/{name}.parquet", f"{bronze}/_manifests/{name}"
    found, known = delivered(spark, csv_path), _known(spark, manifest)
    root = csv_path if csv_path.rstrip("/").rsplit("/", 1)[-1] not in found else csv_path.rstrip("/").rsplit("/", 1)[0]
    suspect = sorted(n for n in found if n not in known or known[n][:2] != found[n])
    gone = sorted(set(known) - set(found))
    if not suspect and not gone:
        return []
    contents = _contents(spark, [f"{root}/{n}" for n in suspect]) if suspect else {}
    contents = {n: contents.get(n, (0, "")) for n in suspect}
    changed = [n for n in suspect if n not in known or known[n][2:] != contents[n]]
    ddl = ", ".join(f"{c} string" for c, _ in columns(name))
    if changed:
        lines = _lines(spark, [f"{root}/{n}" for n in changed], ddl, with_file=True)
        good = as_text(lines.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE))
        good.write.options(partitionOverwriteMode="dynamic").mode("overwrite").partitionBy(FILE).parquet(text_path)
        bad = lines.where(F.col(BAD_LINE).isNotNull()).select(F.col(BAD_LINE).alias("line"), FILE)
        bad.write.options(partitionOverwriteMode="dynamic").mode("overwrite").partitionBy(FILE).text(f"{bronze}/{name}_bad_lines")
    for n in gone:
        _remove(spark, f"{text_path}/{FILE}={n}")
        _remove(spark, f"{bronze}/{name}_bad_lines/{FILE}={n}")
    totals: list[tuple] = []
    if changed or gone:
        text = spark.read.parquet(text_path).drop(FILE)
        typed = typed_layer(text, columns(name))
        both = {f"text {k}": v for k, v in control_totals(columns(name), text.columns, typed=False).items()}
        # The text side is counted where rows enter the cast, the typed side where they are written.
        entering = Observation()
        counted = typed_layer(text.observe(entering, *[v.alias(k) for k, v in both.items()]), columns(name))
        written = observed(counted, control_totals(columns(name), typed.columns, typed=True), lambda df: write_typed(df, name, silver))
        totals = [(name, k, str(entering.get[f"text {k}"]), str(v), str(entering.get[f"text {k}"]) == str(v)) for k, v in written.items()]
    rows = [(n, *found[n], *(contents[n] if n in contents else known[n][2:])) for n in sorted(found)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(manifest)
    return totals


def _remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def write_typed(df: DataFrame, name: str, silver: str) -> None:
    period = PARTITIONS.get(name)
    if period is None:
        df.write.mode("overwrite").parquet(f"{silver}/{name}.parquet")
    else:
        # The file of a period is cut by employee, so a heavy period spreads over tasks.
        ordered = df.repartitionByRange(period, "employee_id").sortWithinPartitions(period, "employee_id")
        ordered.write.mode("overwrite").partitionBy(period).parquet(f"{silver}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def stamp(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of what lies in a folder; another text means that its tables were written anew."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return " ".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def read_typed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A typed table with its declared types; those of partition columns are not in the files."""
    table = spark.read.schema(SCHEMAS[name]) if name in PARTITIONS else spark.read
    found = table.parquet(f"{folder}/{name}.parquet")
    known = [c for c, _ in columns(name) if c in found.columns]
    return found.select(*known, *[c for c in found.columns if c not in known])


def write_issues(issues: DataFrame, path: str) -> None:
    """Replace the issue table: six text columns, also where nothing was found."""
    names = StructType.fromDDL(ISSUE_SCHEMA).names
    issues.toDF(*names).select(*[F.col(c).cast("string").alias(c) for c in names]).write.mode("overwrite").parquet(path)


def load_tables(spark: SparkSession, folder: str, production: bool = False, names: Iterable[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """Typed tables found in ``folder``; a missing one is skipped unless production needs it."""
    found = {n: read_typed(spark, folder, n) for n in names if exists(spark, f"{folder}/{n}.parquet")}
    for name in CORE_TABLES if production else ():
        if name not in found or found[name].isEmpty():
            raise IntakeError(f"core source '{name}' is missing or empty in {folder}")
    return found


def register(tables: dict[str, DataFrame]) -> None:
    """Publish frames as named views for SQL users."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Canonical columns from a declared ``target -> SQL expression`` mapping."""
    return df.select(*[F.expr(rule).alias(target) for target, rule in mapping.items()])
