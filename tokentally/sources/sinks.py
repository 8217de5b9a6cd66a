"""Results as CSV, JSON or text."""

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame


def report_name(service: str, key: str, region: str, now: datetime) -> str:
    return f"{service}_{key}_{region}_{now:%Y%m%d_%H%M%S}"


def write_csv(
    frames: Mapping[str, DataFrame], folder: str, service: str, region: str, now: datetime
) -> list[str]:
    """Each analysis as CSV with a header, in a directory of its own; returns the paths.

    Written by all tasks in parallel, so a large result is several part files.
    """
    paths = []
    for key, df in frames.items():
        path = f"{folder.rstrip('/')}/{report_name(service, key, region, now)}.csv"
        df.write.option("header", True).mode("errorifexists").csv(path)
        paths.append(path)
    return paths


def write_json(
    frames: Mapping[str, DataFrame], folder: str, service: str, region: str, now: datetime
) -> str:
    """All analyses as JSON lines under one path, one `analysis=<key>` directory each."""
    path = f"{folder.rstrip('/')}/{report_name(service, 'analysis', region, now)}.json"
    for key, df in frames.items():
        df.write.option("ignoreNullFields", False).mode("errorifexists").json(f"{path}/analysis={key}")
    return path


def preview(df: DataFrame, max_rows: int = 20) -> DataFrame:
    """The first rows of a result."""
    return df.limit(max_rows)


def preview_text(df: DataFrame, title: str, max_rows: int = 20) -> str:
    """The first rows as text, and how many more there are. Only those rows reach the driver."""
    rows = df.take(max_rows)
    if not rows:
        return f"{title}: no data"
    cells = [df.columns] + [["" if v is None else str(v) for v in row] for row in rows]
    widths = [max(len(line[i]) for line in cells) for i in range(len(df.columns))]
    lines = [title]
    for line in cells:
        lines.append("  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip())
    more = df.count() - len(rows) if len(rows) == max_rows else 0
    if more > 0:
        lines.append(f"... ({more} more rows)")
    return "\n".join(lines)


def write_csv_by(df: DataFrame, column: str, path: str) -> None:
    """One CSV directory per value of a column, such as one report per application pattern."""
    df.write.partitionBy(column).option("header", True).mode("errorifexists").csv(path)


def write_day_files(lines: DataFrame, root: str, compression: str = "none") -> None:
    """Lines of text (`value`) as files in `yyyy/MM/dd` directories, by their `day` (a date).

    This is the layout that the log readers take. Days are written in parallel beside the directories and
    their files then moved in, so a directory may hold files of earlier writes.
    """
    spark = lines.sparkSession
    draft = f"{root.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    lines.select("value", "day").write.partitionBy("day").option("compression", compression).text(draft)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = new(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in files.listStatus(new(draft)):
        name = day.getPath().getName()
        if not name.startswith("day="):
            continue
        folder = new(f"{root.rstrip('/')}/{name.removeprefix('day=').replace('-', '/')}")
        files.mkdirs(folder)
        for file in files.listStatus(day.getPath()):
            files.rename(file.getPath(), new(folder, file.getPath().getName()))
    files.delete(new(draft), True)
