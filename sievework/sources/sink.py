"""Sinks: delimited text, named stages, tables split by slug, and text summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import scalars as S
from sievework.sources import scan

# Report headings of the result tables.
REPORT_NAMES = {
    "model": "Model",
    "smote": "SMOTE",
    "accuracy": "Accuracy",
    "precision_w": "Precision",
    "recall_w": "Recall",
    "f1": "F1-Score",
    "roc_auc": "ROC AUC",
    "train_seconds": "Train Time (s)",
    "predict_seconds": "Pred Time (s)",
    "class_name": "Kelas",
    "support": "Support",
    "remark": "Keterangan",
    "n": "Jumlah",
    "pct": "Persentase",
}

# Stage order of a cleaning run.
STAGES = ["00_raw", "01_preprocessed", "02_no_missing", "03_after_outlier", "clean"]


def to_report_names(df: DataFrame, names: Mapping[str, str] = REPORT_NAMES) -> DataFrame:
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def write_delimited(df: DataFrame, path: str, sep: str = ",", escape_breaks: bool = True) -> None:
    """Header row, no index, values with outer spaces kept as they are.

    Line breaks in text are written as backslash escapes (and backslashes doubled), so that a row is
    a line and files stay splittable; an empty file ``_escaped_breaks`` beside them tells ``scan_delimited``
    to undo it. ``escape_breaks=False`` writes them as they are, inside quotes. Like any delimited text it cannot tell a missing cell from an
    empty one: both read back as missing.
    """
    if escape_breaks:
        df = df.withColumns({f.name: S.escape_breaks(f.name) for f in df.schema if f.dataType == T.StringType()})
    (
        df.write.option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if escape_breaks:
        marker = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path, scan.ESCAPED_MARK)
        marker.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).create(marker, True).close()


def write_stage(df: DataFrame, root: str, stage: str) -> DataFrame:
    """Write one named stage as parquet and continue from the written rows."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {STAGES}")
    path = f"{root}/stage_{stage}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_slug(df: DataFrame, path: str, name: str) -> None:
    """One folder per value of ``name``, called by its slug."""
    df.withColumn("model_slug", S.slug(name)).write.partitionBy("model_slug").parquet(path)


def summary_lines(summary: DataFrame) -> DataFrame:
    """The one-row cleaning summary as (line_no, line) text rows."""

    def listing(key: str) -> Column:
        parts = F.transform(
            F.col(key), lambda s: F.format_string("%s: %d outlier", s["column"], s["n"])
        )
        return F.array_join(parts, ", ")

    none_missing = "Tidak ditemukan missing values dalam dataset"
    some_missing = "Missing values telah ditangani"
    def bullet(text: Column) -> Column:
        return F.concat(F.lit("   - "), text)

    duplicates = F.format_string("Deteksi dan hapus duplikasi data (%d duplikat dihapus)", F.col("duplicates"))
    # The wording of the published summary. Step lines come from what was done.
    parts = [
        F.array(
            F.format_string("Dataset: %s", F.col("dataset")),
            F.format_string("Total Sampel Awal: %d", F.col("rows_before")),
            F.format_string("Total Sampel Akhir: %d", F.col("rows_after")),
            F.format_string("Jumlah Kolom: %d", F.col("columns_after")),
            F.lit(""),
            F.lit("TAHAPAN YANG TELAH DILAKUKAN:"),
            F.lit("1. Data Preprocessing:"),
        ),
        F.transform(F.concat(F.col("steps"), F.array(duplicates)), bullet),
        F.array(
            F.lit(""),
            F.lit("2. Handling Missing Values:"),
            bullet(F.when(F.col("missing_before") == 0, none_missing).otherwise(some_missing)),
            F.lit(""),
            F.lit("3. Outlier Detection & Handling:"),
            bullet(F.concat(F.lit("Metode IQR: "), listing("iqr"))),
            bullet(F.concat(F.lit("Metode Z-Score: "), listing("zscore"))),
            bullet(F.lit("Penanganan: Capping/Winsorization (mengganti outlier dengan batas IQR)")),
        ),
    ]
    return summary.select(F.posexplode(F.concat(*parts)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no") + 1
    )


def write_text(lines: DataFrame, path: str) -> None:
    """A handful of ordered lines as one text file."""
    lines.orderBy("line_no").select("line").coalesce(1).write.text(path)
