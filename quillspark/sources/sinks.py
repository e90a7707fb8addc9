"""Result files: the review CSV, debug JSON and a Markdown table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _three(c: Column) -> Column:
    return F.format_string("%.3f", F.bround(c, 3))


def review_rows(selected: DataFrame) -> DataFrame:
    """Rows of the review CSV, all text: numbered by time in each video, numbers with three places, warnings joined by ';'."""
    n = F.row_number().over(Window.partitionBy("video").orderBy("ts", "sel_seq"))
    source = F.col("output_source") if "output_source" in selected.columns else F.lit("original-frame")
    return selected.select(
        "video", n.cast("string").alias("index"), _three(F.col("ts")).alias("timestamp"), "unit_id", F.format_string("frame-%04d.jpg", n).alias("image"), "transcript",
        F.col("chosen").alias("normalized_text"), _three(F.col("score")).alias("score"), "status", F.array_join("warnings", ";").alias("warnings"), source.alias("output_source"), "page_id",
    )


def write_review(selected: DataFrame, path: str) -> None:
    rows = review_rows(selected)
    rows.write.mode("overwrite").partitionBy("video").option("header", True).csv(f"{path}/review")
    rows.write.mode("overwrite").partitionBy("video").json(f"{path}/debug")
    markdown(rows).write.mode("overwrite").partitionBy("video").text(f"{path}/index")


def markdown(rows: DataFrame) -> DataFrame:
    """video and value: one table line per row, with bars escaped."""
    cells = [F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")) for c in ("index", "timestamp", "transcript", "status", "warnings")]
    return rows.select("video", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def contact_cells(rows: DataFrame, columns: int = 3) -> DataFrame:
    """Row and column of each picture in a contact sheet."""
    k = F.col("index").cast("int") - 1
    return rows.select("video", "image", F.floor(k / columns).cast("int").alias("row"), (k % columns).alias("column"))


def manifest(jobs: DataFrame, path: str) -> None:
    """JSON of the jobs that ended well (video, output_dir, frames, status)."""
    jobs.where("status = 'ok'").drop("status").write.mode("overwrite").json(path)
