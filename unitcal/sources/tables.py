"""Message files in, series and report tables out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitcal.functions import high_flag, to_double
from unitcal.operators.series import (
    attach_targets,
    final_messages,
    namespaced_unit,
    order_messages,
    require_targets,
    stack_splits,
)
from unitcal.operators.splits import require_disjoint
from unitcal.roles import CDM_SERIES
from unitcal.session import stage
from unitcal.sources.cdm import CDM_COLUMNS, TEXT_COLUMNS

#: Bytes up to which the manifest reads a file as one value.
WHOLE_FILE = 256 << 20
#: Endings whose files Spark's line reader would unpack.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd", ".passthrough")
MARK = b"\xef\xbb\xbf"


class SchemaError(ValueError):
    """The columns of a table are not the expected ones."""


def require_columns(df: DataFrame, expected: Sequence[str], name: str) -> DataFrame:
    """The columns must be exactly ``expected``, in order."""
    found = df.columns
    if tuple(found) != tuple(expected):
        missing = sorted(set(expected) - set(found))
        extra = sorted(set(found) - set(expected))
        raise SchemaError(
            f"{name}: {len(found)} columns, expected {len(expected)}; missing {missing}, unexpected {extra}"
        )
    return df


def label_columns(columns: Sequence[str] = CDM_COLUMNS) -> tuple[str, ...]:
    """Columns of the private label file: the value column is called true_risk."""
    return tuple("true_risk" if c == "risk" else c for c in columns)


def read_messages(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = CDM_COLUMNS,
    name: str = "messages",
) -> DataFrame:
    """Scan message CSV files as text columns and check their header.

    The header is compared before any cast, so a reordered file fails instead of being
    read into the wrong columns.  Every file must share the header.
    """
    paths = [path] if isinstance(path, str) else list(path)
    header = spark.read.option("header", True).csv(paths)
    require_columns(header, columns, name)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)


def coerce_types(
    df: DataFrame, text: Sequence[str] = TEXT_COLUMNS, keep: Sequence[str] = ()
) -> DataFrame:
    """Every column but the text ones to double; text that is no number becomes NULL.

    Columns in ``keep`` pass unchanged.
    """

    def typed(c: str):
        if c in keep:
            return F.col(c)
        return (F.col(c).cast("string") if c in text else to_double(F.col(c))).alias(c)

    return df.select(*[typed(c) for c in df.columns])


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the tie column that restores the order of the rows in the input files.

    Must be applied straight to a file scan: file, block within the file, row within the
    block.  It does not depend on how the blocks are spread over tasks.
    """
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn(CDM_SERIES.tie, order)


def split_messages(df: DataFrame, split: str) -> DataFrame:
    """Split tag and unit key for one split's raw messages."""
    return df.withColumns({"split": F.lit(split), "event_uid": namespaced_unit(split, "event_id")})


def build_series(
    spark: SparkSession, train: str, test: str, labels: str, threshold: float = -6.0,
    columns: Sequence[str] = CDM_COLUMNS,
) -> DataFrame:
    """Raw files to the series table: typed messages, order, targets, high flag."""
    spec = CDM_SERIES
    parts = {}
    for split, path in (("train", train), ("test", test)):
        ordered = with_file_order(read_messages(spark, path, columns, split))
        typed = coerce_types(ordered, keep=(spec.tie,))
        parts[split] = order_messages(split_messages(typed, split), spec)
    truth = coerce_types(read_messages(spark, labels, label_columns(columns), "labels")).select(
        namespaced_unit("test", "event_id").alias(spec.unit),
        F.col("true_risk").alias("target"),
        F.col(spec.ttr).alias("target_ttr"),
    )
    targets = {"train": final_messages(parts["train"], spec), "test": truth}
    whole = stack_splits(*[
        require_targets(attach_targets(parts[s], targets[s], spec), spec) for s in parts
    ])
    require_disjoint(whole, spec.unit, "split")
    return whole.select(
        *columns,
        spec.unit,
        "split",
        F.col("msg_index").alias("cdm_index"),
        F.col("n_msgs").alias("n_cdms"),
        F.col("target").alias("target_log_risk"),
        F.col("target_ttr").alias("target_time_to_tca"),
        high_flag(F.col("target"), threshold, inclusive=False).alias("is_high_risk"),
    )


def write_series(df: DataFrame, path: str, partition_by: str | None = "split") -> None:
    """Parquet series table, one folder per split so that a split filter prunes files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def load_series(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        raise FileNotFoundError(f"no series table at {path}; build it first") from problem


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result table as one file (CSV), or any result table as Parquet."""
    if fmt == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def file_manifest(
    spark: SparkSession, path: str, expected: DataFrame | None = None, glob: str = "*"
) -> DataFrame:
    """Path, size and md5 of every landed file; with ``expected`` also the comparison.

    ``expected`` has ``file, md5``.  Each file is hashed in the task that reads it; a large
    one passes through that task line by line, so no file must fit in memory.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    whole = min(WHOLE_FILE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    large = [(r["path"], r["length"]) for r in listed.filter(F.col("length") > whole).select("path", "length").collect()]
    packed = [p for p, _ in large if p.lower().endswith(PACKED)]
    streamed = {p: n for p, n in large if p not in packed}
    # this filter alone is pushed into the reader, so that it does not open what it must not read as a value
    values = listed.filter(F.col("length") <= whole)
    if packed:
        values = values.unionByName(spark.read.format("binaryFile").load(packed))
    files = values.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("length").alias("n_bytes"),
        F.md5("content").alias("md5"),
    )
    if streamed:
        files = files.unionByName(streamed_md5(spark, list(streamed), max(streamed.values())))
    if expected is None:
        return files
    wanted = expected.select("file", F.col("md5").alias("expected_md5"))
    return wanted.join(files, "file", "full_outer").withColumn(
        "status",
        F.when(F.col("md5").isNull(), "absent")
        .when(F.col("expected_md5").isNull(), "unlisted")
        .when(F.col("md5") == F.col("expected_md5"), "ok")
        .otherwise("mismatch"),
    )


def streamed_md5(spark: SparkSession, paths: Sequence[str], largest: int) -> DataFrame:
    """Size and md5 of files that are too large for one value: ``file, n_bytes, md5``.

    Lines end at the byte 10 alone and keep their bytes.  A file is one split, as MD5 is a
    chain over its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = name = None
        size = seen = 0
        plain = marked = hashlib.md5()

        def finished() -> pa.RecordBatch:
            # the reader leaves out a byte order mark; the last line may have no end in the file
            missing = size - seen
            if missing not in (-1, 0, 2, 3):
                raise ValueError(f"{name}: {seen} bytes read of {size}")
            sums = marked if missing > 0 else plain
            if missing in (0, 3):
                sums.update(b"\n")
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([size], pa.int64()), pa.array([sums.hexdigest()])], names=["file", "n_bytes", "md5"]
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lines = batch.column(3).cast(pa.large_binary())
            ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:]
            data = memoryview(lines.buffers()[2] or b"")
            starts = [0, *(np.flatnonzero(np.diff(ids)) + 1)] if len(ids) else []
            for first, last in zip(starts, [*starts[1:], len(ids)]):
                if ids[first] != file:
                    if file is not None:
                        yield finished()
                    file, name, size, seen = ids[first], batch.column(1)[first].as_py(), batch.column(2)[first].as_py(), 0
                    plain, marked = hashlib.md5(), hashlib.md5(MARK)
                else:
                    plain.update(b"\n")
                    marked.update(b"\n")
                # the end of the last line waits for the next one
                part = data[ends[first]:ends[last] - 1]
                plain.update(part)
                marked.update(part)
                seen += len(part) + 1
        if file is not None:
            yield finished()

    one_split = {"spark.sql.files.maxPartitionBytes": str(largest), "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in one_split}
    for k, v in one_split.items():
        spark.conf.set(k, v)
    try:
        return stage(
            spark.read.option("lineSep", "\n").text(list(paths)).select(
                F.xxhash64("_metadata.file_path").alias("id"), "_metadata.file_name", "_metadata.file_size",
                F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"),
            ).mapInArrow(run, "file string, n_bytes bigint, md5 string")
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def require_manifest(manifest: DataFrame) -> DataFrame:
    """Fail loudly when a listed file is absent or has another checksum."""
    bad = manifest.filter(F.col("status").isin("absent", "mismatch")).first()
    if bad is not None:
        raise SchemaError(f"file {bad['file']} is {bad['status']}")
    return manifest


def settings_hash(settings: Mapping) -> str:
    """SHA-256 of the settings as canonical JSON."""
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def stamp(
    df: DataFrame, experiment: str, settings: Mapping, seed: int, n_resamples: int,
    at: datetime | None = None,
) -> DataFrame:
    """Provenance of a result table as literal columns."""
    when = (at or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return df.withColumns({
        "experiment": F.lit(experiment),
        "settings_sha256": F.lit(settings_hash(settings)),
        "seed_used": F.lit(seed),
        "n_resamples": F.lit(n_resamples),
        "stamped_utc": F.lit(when),
    })
