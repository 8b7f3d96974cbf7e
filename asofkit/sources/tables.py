"""Sources, sinks, a build-or-reuse cache and manifests, through Spark's own file systems."""

from __future__ import annotations

import io
import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*dict.fromkeys(columns)) if columns else df


def json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """JSON lines, plain or gzip; gzip can't be split, so its rows are dealt out after reading."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def zstd_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in zstd files, decompressed as a stream, a file a task; a file that is cut short fails the job."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def lines(batches):
        import zstandard

        for b in batches:
            for content in b.column(0):
                reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(content.as_py(), read_across_frames=True), encoding="utf-8")
                out: list[str] = []
                for line in reader:
                    out.append(line.rstrip("\n"))
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])

    return files.mapInArrow(lines, "line string").where("line <> ''").select(F.from_json("line", schema).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) from the links and sizes of an HTML directory page."""
    page = spark.read.text(path, wholetext=True)
    pairs = F.regexp_extract_all("value", F.lit(r'<a href="([^"?/]+)">[^\n]*?(\d+)\s*(?:\n|$)'), 0)
    one = F.explode(pairs).alias("m")
    return page.select(one).select(F.regexp_extract("m", r'href="([^"]+)"', 1).alias("file"), F.regexp_extract("m", r"(\d+)\s*$", 1).cast("long").alias("bytes"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified, format) of every file under path, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("format"))


def column_statistics(df: DataFrame) -> DataFrame:
    """(column, least, greatest, nulls) as text, one pass over the table."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("bigint", "int", "smallint", "double", "string", "timestamp", "timestamp_ntz", "date")]
    one = df.agg(*[F.struct(F.lit(n).alias("column"), F.min(n).cast("string").alias("least"), F.max(n).cast("string").alias("greatest"), F.count_if(F.col(n).isNull()).alias("nulls")).alias(f"_{i}") for i, n in enumerate(names)])
    return one.select(F.explode(F.array(*[f"_{i}" for i in range(len(names))])).alias("s")).select("s.*")


def write_sorted(df: DataFrame, path: str, keys: list[str], compression: str = "zstd") -> None:
    """Parquet in key order across and within files."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", compression).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; where that is unset a temporary one in local mode, else an error."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="asofkit-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/asofkit/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_or_reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, built first if its commit mark is not there. A build that stops halfway leaves no mark."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str, sources: list[str], note: str) -> dict:
    """What a built table holds and where it comes from."""
    began = time.time()
    df = spark.read.parquet(path)
    files = [{"source": s, "files": (i := inventory(spark, s).agg(F.count("*"), F.sum("bytes")).first())[0], "bytes": i[1]} for s in sources]
    return {"table": path, "rows": df.count(), "columns": df.columns, "sources": files, "note": note, "seconds": round(time.time() - began, 3)}


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document with sorted keys, written whole before it takes its name."""
    text = json.dumps(document, indent=2, sort_keys=True, default=str)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    _put(spark, part, path)


def _put(spark: SparkSession, part, path: str) -> None:
    """Give a finished file its name over any old one, in one step of the file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    mode = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), conf).rename(part, jvm.org.apache.hadoop.fs.Path(path), mode)


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON document, as write_json() writes it."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_csv(df: DataFrame, path: str, keys: list[str], single: bool = False) -> None:
    """CSV with a header in key order; `single` is for reports of a few rows and makes one file."""
    rows = df.coalesce(1).sortWithinPartitions(*keys) if single else df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.mode("overwrite").option("header", True).csv(path)


def column_dictionary(df: DataFrame, notes: dict[str, str]) -> DataFrame:
    """(position, column, type, note) of each column; a note for a column that isn't there is an error."""
    if unknown := set(notes) - set(df.columns):
        raise ValueError(f"no such column: {sorted(unknown)}")
    rows = [(i, f.name, f.dataType.simpleString(), notes.get(f.name)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, note string")


def input_path(name: str, default: str, spark: SparkSession | None = None) -> str:
    """Where an input lies: the session's conf asofkit.input.<name>, else the variable ASOFKIT_<NAME>, else the default."""
    found = spark.conf.get(f"asofkit.input.{name}", None) if spark else None
    return found or os.environ.get(f"ASOFKIT_{name.upper()}") or default


def batched(df: DataFrame, path: str, rows: int = 20_000) -> None:
    """Parquet whose row groups come from Arrow batches of at most so many rows, so that no task holds more."""

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)

    df.mapInArrow(cut, df.schema).write.mode("overwrite").option("compression", "zstd").parquet(path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, groups, writer, column, least, greatest, nulls) from the footers of the Parquet files under path.

    Only the last bytes of a file are fetched, by a positioned read on the executor through the path's own file system where
    that is local to it, else through Spark's file reader, which hands over the whole file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    local = path.startswith(("/", "file:"))
    rows = files.select("path") if local else files.select("path", "content")

    def read(batches):
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for i, name in enumerate(b.column(0).to_pylist()):
                source = name.removeprefix("file://").removeprefix("file:") if local else io.BytesIO(b.column(1)[i].as_py())
                meta = pq.ParquetFile(source).metadata
                for c in range(meta.num_columns):
                    found = [meta.row_group(g).column(c) for g in range(meta.num_row_groups)]
                    known = [x.statistics for x in found if x.statistics is not None]
                    ends = [(x.min, x.max) for x in known if x.has_min_max]
                    least, most = (str(min(e[0] for e in ends)), str(max(e[1] for e in ends))) if ends else (None, None)
                    nulls = sum(x.null_count for x in known) if known and all(x.has_null_count for x in known) else None
                    out.append((name, meta.num_rows, meta.num_row_groups, meta.created_by, meta.schema.column(c).path, least, most, nulls))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            names = ["file", "rows", "groups", "writer", "column", "least", "greatest", "nulls"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return rows.mapInArrow(read, "file string, rows long, groups int, writer string, column string, least string, greatest string, nulls long")
