"""Writing records and result tables; every write is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.session import cut_lineage


def write_jsonl(df: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Gzip JSON lines, a new file every ``max_records`` rows per task."""
    df.write.mode("overwrite").option("compression", "gzip").option(
        "maxRecordsPerFile", max_records).json(path)


def write_list(df: DataFrame, c: str, path: str, field: str) -> None:
    """The column as JSON documents ``{field: [...]}``, one document per output
    file; rows stream through, nothing is gathered."""
    literal = F.to_json(F.array(F.col(c)))
    items = df.filter(F.col(c).isNotNull()).select(
        F.substr(literal, F.lit(2), F.length(literal) - 2).alias("value"))
    opening = '{"' + field + '": ['

    def wrap(batches):
        import pandas as pd

        lead = opening
        for batch in batches:
            for text in batch["value"].iloc[:1]:
                batch["value"] = "," + batch["value"]
                batch.loc[batch.index[0], "value"] = lead + text
                lead = ","
            yield batch
        yield pd.DataFrame({"value": [opening + "]}" if lead == opening else "]}"]})

    items.mapInPandas(wrap, "value string").write.mode("overwrite").text(path)


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_hist(df: DataFrame, path: str) -> None:
    _write_csv(df.select("key", "count"), path)


def write_series(df: DataFrame, c: str, path: str) -> None:
    _write_csv(df.select(F.col(c).alias("value")), path)


def distribution(hist: DataFrame) -> DataFrame:
    """Histogram with each key's share of all rows, by key."""
    hist = cut_lineage(hist.select("key", "count"))
    total = hist.agg(F.sum("count")).scalar()
    share = F.coalesce(F.try_divide("count", total), F.lit(0.0))
    return hist.select("key", "count", share.alias("proportion")).orderBy("key")


def write_distribution(hist: DataFrame, path: str) -> None:
    _write_csv(distribution(hist), path)


def write_results(dfs: dict[str, DataFrame], outdir: str, fmt: str = "csv") -> None:
    """Each named result below ``outdir``, as CSV with header or parquet."""
    for name, df in dfs.items():
        target = f"{outdir.rstrip('/')}/{name}"
        if fmt == "csv":
            _write_csv(df, target)
        else:
            df.write.mode("overwrite").format(fmt).save(target)
