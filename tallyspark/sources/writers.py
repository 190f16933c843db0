"""Sinks: cell tables, guarded audit files, small reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.readers import NULL_MARK


def write_cells(cells: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """A CSV table; empty text and null stay apart, and line breaks are kept inside quotes."""
    cells.write.mode(mode).option("header", True).option("nullValue", NULL_MARK).option("emptyValue", "").option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_audit(rows: DataFrame, path: str, *, force: bool = False, protected: tuple[str, ...] = ("/data/",)) -> None:
    """Files that people fill in by hand: never below a protected folder, and never over existing ones unless forced."""
    if any(p in f"{path.rstrip('/')}/" for p in protected):
        raise ValueError(f"{path} lies in a protected folder")
    write_cells(rows, path, mode="overwrite" if force else "errorifexists")


def write_by_run(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Append rows below one folder per run, so that later reads prune to the runs they need."""
    rows.write.mode("append").partitionBy(run).parquet(path)


def write_json(report: dict, path: str, spark) -> None:
    """A small report as one JSON file, complete or absent: it is written beside its place, then renamed over the old one in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, tmp = hadoop.Path(path), hadoop.Path(path + ".tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(target), overwrite)


def metric_report(metrics: DataFrame, most: int = 10_000) -> dict:
    """``metric, num, den, value`` rows as a dict; more metrics than ``most`` are an error."""
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} metrics")
    return {r.metric: {"num": r.num, "den": r.den, "value": r.value} for r in rows}


def _few(rows: DataFrame, columns: list[str], most: int) -> list:
    few = rows.select(*columns).limit(most + 1).collect()
    if len(few) > most:
        raise ValueError(f"more than {most} rows")
    return few


def text_table(rows: DataFrame, columns: list[str], most: int = 200, show: Callable = str) -> str:
    """A fixed-width table of a small result for people to read; more rows than ``most`` are an error."""
    data = [[("" if r[c] is None else show(r[c])) for c in columns] for r in _few(rows, columns, most)]
    widths = [max(len(x) for x in col) for col in zip(columns, *data)]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, widths)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in widths]), *map(line, data)])


def markdown_table(rows: DataFrame, columns: list[str], most: int = 200) -> str:
    data = [[("" if r[c] is None else str(r[c]).replace("|", "\\|")) for c in columns] for r in _few(rows, columns, most)]
    return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *data])


def zero_filled(counts: DataFrame, names: list[str], key: str, n: str = "n") -> DataFrame:
    """Counts with a zero for every name that has none."""
    all_ = counts.sparkSession.createDataFrame([(x,) for x in names], f"{key} string")
    return F.broadcast(all_).join(counts, key, "left").fillna(0, [n])
