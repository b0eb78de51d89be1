"""Table I/O.

State tables are versioned snapshots. Small ones are directories ``<base>/v=<n>``: a
mutation reads version n and writes n+1 (``errorifexists``), so a job never
overwrites the files it is reading and a failed write leaves the previous
version intact. Large ones are *keyed tables*: rows lie in buckets by a hash of their key, a
mutation writes only the buckets it touches, and a manifest names the folder of every
bucket of a version. Appends (audit rows) go to their own directory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import schema


# S1 ---------------------------------------------------------------------
def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Load a shop table with its declared schema (no inference). For
    ``jdbc`` pass url/dbtable/... as options and no path."""
    r = spark.read.format(fmt).options(**options)
    if fmt in ("json", "csv"):
        r = r.schema(schema(name))
        if fmt == "csv":
            r = r.option("header", options.get("header", "true"))
    df = r.load(path) if path else r.load()
    if fmt == "parquet":
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in schema(name).fields])
    return df


CORRUPT = "_corrupt"


def read_checked(spark: SparkSession, name: str, path: str, fmt: str, **options) -> tuple[DataFrame, DataFrame]:
    """A table with its declared schema, and the rows that do not fit it:
    (good rows, rejected(reason, raw)). Nothing vanishes: every row of the files is in one of the two.

    Fields are read as text and cast one by one. Reasons, the first that holds: ``malformed``
    (no JSON object, or a CSV line of another length), ``cast:<column>`` (text that is not of
    the column's type), ``null:<column>`` (nothing where the schema asks for a value). ``raw``
    is the line as it was read, for Parquet the row as JSON."""
    fields = schema(name).fields
    text = ", ".join(f"`{f.name}` STRING" for f in fields)
    r = spark.read.format(fmt).options(**options)
    if fmt in ("json", "csv"):
        r = r.schema(f"{text}, {CORRUPT} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        if fmt == "csv":
            r = r.option("header", options.get("header", "true"))
    df = r.load(path)
    if fmt in ("json", "csv"):
        given = [F.col(f"`{f.name}`") for f in fields]
        broken = F.col(CORRUPT).isNotNull()
    else:
        given = [F.col(f"`{f.name}`").cast("string") if f.name in df.columns else F.lit(None).cast("string") for f in fields]
        broken = F.lit(False)
    rows = df.select(F.struct(*(c.alias(f.name) for c, f in zip(given, fields, strict=True))).alias("t"), broken.alias("broken"),
                     (F.col(CORRUPT) if fmt in ("json", "csv") else F.to_json(F.struct("*"))).alias("line"))
    cast = {f.name: F.col(f"t.`{f.name}`").try_cast(f.dataType) for f in fields}
    reason = F.when(F.col("broken"), "malformed")
    for f in fields:
        reason = reason.when(F.col(f"t.`{f.name}`").isNotNull() & cast[f.name].isNull(), f"cast:{f.name}")
    for f in fields:
        if not f.nullable:
            reason = reason.when(F.col(f"t.`{f.name}`").isNull(), f"null:{f.name}")
    judged = rows.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(*(cast[f.name].alias(f.name) for f in fields))
    return good, judged.filter("reason IS NOT NULL").select("reason", F.coalesce("line", F.to_json("t")).alias("raw"))


# S5 ---------------------------------------------------------------------
def append_audit(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append audit rows (payment attempts, refund events). Partitioned by
    day when asked, so readers prune by date."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def with_day(df: DataFrame, ts_col: str = "created_at") -> DataFrame:
    return df.withColumn("day", F.to_date(F.col(ts_col)))


# S6 ---------------------------------------------------------------------
def encode_json(df: DataFrame, col: str, fields: list[str]) -> DataFrame:
    """Pack ``fields`` into a JSON text column ``col``."""
    return df.withColumn(col, F.to_json(F.struct(*[F.col(f) for f in fields])))


def decode_json(df: DataFrame, col: str, ddl: str, into: str | None = None) -> DataFrame:
    """Parse a JSON text column with a known schema (``ddl``); text that is
    not JSON gives NULL fields."""
    return df.withColumn(into or f"{col}_parsed", F.from_json(F.col(col), ddl))


def decode_variant(df: DataFrame, col: str, into: str | None = None) -> DataFrame:
    """Raw payloads of unknown shape: VARIANT, queried with variant_get."""
    return df.withColumn(into or f"{col}_v", F.try_parse_json(F.col(col)))


# S7 ---------------------------------------------------------------------
def snapshot_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={version}"


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write the next table state as a new version directory."""
    path = snapshot_path(base, version)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest ``v=<n>`` under ``base`` (a listing of directory names only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    versions = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit():
            versions.append(int(name[2:]))
    return max(versions) if versions else None


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    v = latest_version(spark, base) if version is None else version
    if v is None:
        raise FileNotFoundError(base)
    return spark.read.parquet(snapshot_path(base, v))


class VersionConflict(RuntimeError):
    """Another writer committed the version first."""


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def count_files(spark: SparkSession, path: str) -> int:
    """Data files that lie in a folder itself."""
    p, fs = _hadoop(spark, path)
    return sum(st.getPath().getName().startswith("part-") for st in fs.listStatus(p))


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def _manifest_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/manifests/v={version}.json"


def keyed_version(spark: SparkSession, base: str) -> int:
    """The last committed version of a keyed table; 0 where there is none."""
    p, fs = _hadoop(spark, f"{base.rstrip('/')}/manifests")
    if not fs.exists(p):
        return 0
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return max((int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json")), default=0)


def _manifest(spark: SparkSession, base: str, version: int) -> dict:
    p, fs = _hadoop(spark, _manifest_path(base, version))
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, base: str, version: int, manifest: dict) -> int:
    """Makes a version visible by one rename that fails where the version exists."""
    jvm = spark.sparkContext._jvm
    draft, fs = _hadoop(spark, f"{base.rstrip('/')}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps(manifest).encode())
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(_manifest_path(base, version))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(draft).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise VersionConflict(f"{base} has a version {version} already") from e
        raise
    return version


def _written(df: DataFrame, base: str, key: str, n: int) -> dict[str, str]:
    """Rows written by bucket into a folder of their own: bucket -> its folder under ``base``."""
    folder = f"data/{uuid.uuid4().hex}"
    place = f"{base.rstrip('/')}/{folder}"
    # buckets lie together, and a large one is dealt over several tasks, a file each
    df.withColumn("_bucket", _bucket(key, n)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(place)
    p, fs = _hadoop(df.sparkSession, place)
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}


def create_keyed(df: DataFrame, base: str, key: str, buckets: int = 256) -> int:
    """Version 1 of a keyed table: rows of equal ``key`` share one of ``buckets`` folders."""
    manifest = {"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": _written(df, base, key, buckets)}
    return _commit(df.sparkSession, base, 1, manifest)


def _rows(spark: SparkSession, base: str, manifest: dict, folders: list[str]) -> DataFrame:
    shape = T.StructType.fromJson(json.loads(manifest["schema"]))
    if not folders:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(*(f"{base.rstrip('/')}/{f}" for f in folders))


def read_keyed(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """A version's rows (default: the last): the folders that its manifest names, no others."""
    manifest = _manifest(spark, base, version or keyed_version(spark, base))
    return _rows(spark, base, manifest, sorted(manifest["folders"].values()))


def update_keyed(spark: SparkSession, base: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame],
                 version: int | None = None) -> int:
    """The next version: ``change`` gets the rows of the buckets that hold a key of ``touched``
    (whether they have such a row or not) and returns all rows that these buckets shall have; the
    other buckets keep their folders. Rows of other buckets must not come out of it. Of two writers
    that start from one version, the first to commit wins; the other gets a VersionConflict and
    leaves nothing that a reader sees."""
    version = keyed_version(spark, base) if version is None else version
    old = _manifest(spark, base, version)
    key, n = old["key"], old["buckets"]
    hit = {str(r[0]) for r in touched.select(_bucket(key, n)).distinct().collect()}  # at most ``buckets`` numbers
    held = _rows(spark, base, old, [f for b, f in sorted(old["folders"].items()) if b in hit])
    folders = {b: f for b, f in old["folders"].items() if b not in hit}
    new = _written(change(held), base, key, n) if hit else {}
    if set(new) - hit:
        raise ValueError("the change returned rows of buckets that it was not given")
    return _commit(spark, base, version + 1, old | {"folders": folders | new})
