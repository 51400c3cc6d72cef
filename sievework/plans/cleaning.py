"""The cleaning run: names, values, duplicates, types, missing cells, outliers, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievework.functions import scalars as S
from sievework.operators import dedup, impute, outliers, project
from sievework.session import scratch_path
from sievework.sources import sink


@dataclass(frozen=True)
class CleaningResult:
    clean: DataFrame
    stages: dict[str, DataFrame]
    fences: dict[str, outliers.Fence]
    summary: DataFrame


def standardize(
    df: DataFrame, title: Sequence[str], recodes: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """Standard names, title-cased text columns, and closed-domain recodes. One projection."""
    df = project.standardize_columns(df)
    changes = {c: S.title_case(S.strip(c)) for c in title}
    changes |= {c: S.recode(S.strip(c), mapping) for c, mapping in recodes.items()}
    return df.withColumns(changes)


def clean(
    raw: DataFrame,
    title: Sequence[str],
    recodes: Mapping[str, Mapping[str, str]],
    numeric: Sequence[str],
    dataset: str = "table",
    key: str | None = None,
    add_indicator: bool = True,
    stage_root: str | None = None,
) -> CleaningResult:
    """Run all steps, writing each stage once and continuing from the written rows.

    ``key`` names a row identifier, which takes no part in duplicate removal: of equal rows the
    one with the smallest key stays.
    """
    root = stage_root or scratch_path(raw.sparkSession, "cleaning")
    stages = {"00_raw": sink.write_stage(raw, root, "00_raw")}
    named = standardize(stages["00_raw"], title, recodes)
    content = [c for c in named.columns if c != key]
    unique = (
        dedup.drop_duplicates_first(named, content, [key]) if key else dedup.drop_duplicates(named)
    )
    typed = unique.withColumns({c: S.to_numeric(c) for c in numeric})
    stages["01_preprocessed"] = sink.write_stage(typed, root, "01_preprocessed")

    # Row counts of written stages come from the file footers.
    rows_before, rows_after = stages["00_raw"].count(), stages["01_preprocessed"].count()

    fill = impute.fit_imputer(stages["01_preprocessed"], n_rows=rows_after)
    complete = impute.apply_imputer(stages["01_preprocessed"], fill, add_indicator)
    stages["02_no_missing"] = sink.write_stage(complete, root, "02_no_missing")

    fences = outliers.fit_fences(stages["02_no_missing"], numeric, n_rows=rows_after)
    n_iqr = outliers.fence_table(stages["02_no_missing"], fences)
    n_z = outliers.zscore_table(stages["02_no_missing"], numeric)
    capped = outliers.cap_to_fences(stages["02_no_missing"], fences)
    stages["03_after_outlier"] = sink.write_stage(capped, root, "03_after_outlier")
    # Capping is the last step: the clean table is that stage, not another copy of it.
    result = stages["clean"] = stages["03_after_outlier"]

    iqr = {r["column_name"]: r["n_iqr"] for r in n_iqr.collect()}
    zscore = {r["column_name"]: r["n_zscore"] for r in n_z.collect()}
    listing = T.ArrayType(
        T.StructType([T.StructField("column", T.StringType()), T.StructField("n", T.LongType())])
    )
    schema = T.StructType(
        [
            T.StructField("dataset", T.StringType()),
            T.StructField("steps", T.ArrayType(T.StringType())),
            T.StructField("rows_before", T.LongType()),
            T.StructField("rows_after", T.LongType()),
            T.StructField("columns_after", T.LongType()),
            T.StructField("duplicates", T.LongType()),
            T.StructField("missing_before", T.LongType()),
            T.StructField("iqr", listing),
            T.StructField("zscore", listing),
        ]
    )
    steps = ["Standardisasi nama kolom"] if named.columns != raw.columns else []
    steps += [f"Fix inkonsistensi nilai {c} (spasi, kapitalisasi)" for c in title]
    for c, mapping in recodes.items():
        steps.append(f"Standardisasi kolom {c} ({'/'.join(mapping)} -> {'/'.join(mapping.values())})")
    if numeric:
        steps.append(f"Konversi tipe data numerik: {', '.join(numeric)}")
    row = (
        dataset,
        steps,
        rows_before,
        rows_after,
        len(result.columns),
        rows_before - rows_after,
        sum(fill.n_missing.values()),
        [(c, iqr[c]) for c in numeric],
        [(c, zscore[c]) for c in numeric],
    )
    summary = raw.sparkSession.createDataFrame([row], schema)
    return CleaningResult(result, stages, fences, summary)
