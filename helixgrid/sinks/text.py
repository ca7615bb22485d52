"""TSV and JSON outputs."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(v: object, digits: int = 6) -> str:
    """A missing value is NA, a float has `digits` decimals."""
    return "NA" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)


def write_rows(path: str | Path, header: Iterable[str], rows: Iterable[Iterable[object]]) -> None:
    with open(path, "w") as out:
        out.write("\t".join(header) + "\n")
        for r in rows:
            out.write("\t".join(cell(v) for v in r) + "\n")


def write_table(df: DataFrame, path: str | Path, order: list[str] | None = None) -> None:
    """A small result (histogram, contigs, ranked list) as one TSV."""
    ordered = df.orderBy(*order) if order else df
    write_rows(path, df.columns, (tuple(r) for r in ordered.toLocalIterator()))


def write_metrics(df: DataFrame, path: str | Path) -> None:
    """A one-row result as metric and value lines."""
    row = df.first()
    write_rows(path, ("metric", "value"), ((c, row[c]) for c in df.columns))


def write_frame(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A large result as a folder of TSV parts, range-sorted."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def envelope(module: str, sample: str, metrics: dict) -> dict:
    return {"module": module, "sample": sample, "metrics": metrics}


def write_summary(path: str | Path, module: str, sample: str, metrics: dict) -> None:
    Path(path).write_text(json.dumps(envelope(module, sample, metrics), indent=2, default=str))


def histogram_json(df: DataFrame, key: str, value: str = "count") -> dict[str, int]:
    return {str(r[key]): r[value] for r in df.orderBy(key).toLocalIterator()}


def wide_by_sample(df: DataFrame, key: str, value: str, samples: list[str]) -> DataFrame:
    """key x sample, a column per sample; missing cells are 0. df: sample, key, value."""
    return df.groupBy(key).pivot("sample", samples).agg(F.first(value)).na.fill(0).orderBy(key)


def gene_profiles(genes: DataFrame, percentiles: DataFrame, three_prime: DataFrame, three_bins: int) -> DataFrame:
    """Per gene its counts as comma lists: 100 percentiles and the 3' bins."""

    def lists(df: DataFrame, n: int, name: str) -> DataFrame:
        every = genes.select("gene_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
        full = every.join(df.select("gene_id", F.col("bin").cast("int").alias("bin"), "bases"), ["gene_id", "bin"], "left").na.fill(0, ["bases"])
        return full.groupBy("gene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "bases"))), lambda x: x["bases"].cast("string")), ",").alias(name))

    return genes.join(lists(percentiles, 100, "counts_percentile"), "gene_id").join(lists(three_prime, three_bins, "counts_3p"), "gene_id")
