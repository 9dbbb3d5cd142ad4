"""Readers and writers of the point file layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAN = float("nan")


def _number(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(NAN))


def _id() -> Column:
    """Ids from the file position: unique, and stable because they depend on the file layout only."""
    return F.monotonically_increasing_id()


def read_clustered_csv(spark: SparkSession, path: str, skip_header_rows: int = 1, sep: str = ",") -> DataFrame:
    """Coordinates, then the cluster id as last column. Header lines (one or two) start every file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                       _id().alias("id"))
    # Headers are the first lines of the first block of a file.
    rank = raw.where("at = 0").groupBy("file").agg(F.min("id").alias("first"))
    body = raw.join(F.broadcast(rank), "file").where(~((F.col("at") == 0) & (F.col("id") < F.col("first") + skip_header_rows)))
    cells = F.split("value", _quoted(sep))
    return body.where(F.trim("value") != "").select("id", cells.alias("c")).select(
        "id", F.transform(F.slice("c", 1, F.size("c") - 1), _number).alias("features"),
        F.element_at("c", -1).try_cast("double").cast("bigint").alias("prediction"))


def _quoted(sep: str) -> str:
    import re

    return re.escape(sep)


def import_clustered_csv(spark: SparkSession, path: str, out: str, fmt: str = "parquet", mode: str = "overwrite",
                         skip_header_rows: int = 1, sep: str = ",") -> None:
    """Parse once and store as `label, features, prediction` rows with an id (parquet, or gzip JSON)."""
    points = read_clustered_csv(spark, path, skip_header_rows, sep).select(
        "id", F.col("id").cast("double").alias("label"), "features", "prediction")
    writer = points.write.mode(mode)
    if fmt == "json":
        writer.option("compression", "gzip").json(out)
    else:
        writer.parquet(out)


def read_points_json(spark: SparkSession, path: str) -> DataFrame:
    """Parsed points, with plain arrays or {type, size, indices, values} vectors as features."""
    sample = spark.read.text(path).where(F.col("value").contains('"features":{')).limit(1).count()
    kind = "struct<type: int, size: int, indices: array<int>, values: array<double>>" if sample else "array<double>"
    raw = spark.read.schema(f"id bigint, label double, features {kind}, prediction bigint").json(path)
    if sample:
        f = F.col("features")
        spots = F.map_from_arrays(F.coalesce(f["indices"], F.array().cast("array<int>")), F.when(f["indices"].isNotNull(), f["values"]).otherwise(F.array().cast("array<double>")))
        dense = F.transform(F.sequence(F.lit(0), F.greatest(f["size"] - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(spots, i), F.lit(0.0)))
        raw = raw.withColumn("features", F.when(f["type"] == 0, dense).otherwise(f["values"]))
    return raw.withColumn("id", F.coalesce("id", F.col("label").cast("bigint")))


def _data_lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    lines = spark.read.text(path).select(_id().alias("id"), "value")
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith(comment))


def _labelled(lines: DataFrame, sep: str, class_column: int | None) -> DataFrame:
    cells = lines.select("id", F.split("value", _quoted(sep)).alias("c"))
    if class_column is None:
        return cells.select("id", F.transform("c", _number).alias("features"), F.lit(None).cast("string").alias("label"))
    kept = F.filter("c", lambda x, i: i != class_column)
    return cells.select("id", F.transform(kept, _number).alias("features"), F.trim(F.get("c", class_column)).alias("label"))


def read_delimited(spark: SparkSession, path: str, class_column: int | None = None, sep: str = "\t") -> DataFrame:
    """Delimited text, gzip included; `#` lines and blanks are skipped, unparsable cells are NaN."""
    return _labelled(_data_lines(spark, path, "#"), sep, class_column)


def read_sparse(spark: SparkSession, path: str, class_column: int | None = None, sep: str = "\t", pair: str = ":",
                default: float = 0.0) -> DataFrame:
    """Tokens `index:value`; the number of attributes is the largest index of the whole input plus one."""
    cells = _data_lines(spark, path, "#").select("id", F.split("value", _quoted(sep)).alias("c"))
    tokens = F.filter("c", lambda x, i: x.contains(pair))
    # An index reaches to the first `pair`, its value from there to the next one or to the end.
    head = lambda x: F.substring_index(x, pair, 1)
    rest = lambda x: F.substring(x, F.char_length(head(x)) + F.lit(len(pair) + 1), F.char_length(x))
    key = lambda x: F.trim(head(x)).try_cast("int")
    entries = F.transform(tokens, lambda x: F.struct(key(x).alias("k"), _number(head(rest(x))).alias("v")))
    label = F.lit(None).cast("string") if class_column is None else F.trim(F.get("c", class_column))
    # The width needs the indices only, not the values.
    width = cells.agg(F.max(F.array_max(F.transform(tokens, key))) + 1).scalar()

    def dense(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(float(default))))

    # As the variable of a lambda the map is built once a row; by its column name it would be built again for every attribute.
    features = F.get(F.transform(F.array(F.map_from_entries(entries)), dense), 0)
    return cells.withColumn("w", width).select("id", features.alias("features"), label.alias("label"))


def read_arff(spark: SparkSession, path: str, class_column: int | None = None, sep: str = ",") -> DataFrame:
    """Data lines of an ARFF file: everything that is not a comment or a declaration."""
    lines = _data_lines(spark, path, "%").where(~F.ltrim("value").startswith("@"))
    return _labelled(lines, sep, class_column)


def export_points(points: DataFrame, path: str, sep: str = "\t", sparse: bool = False, gzip: bool = False,
                  mode: str = "overwrite") -> None:
    """One line per point, the class first if there is one; sparse lines list the non-zero cells."""
    if sparse:
        cells = F.filter(F.transform("features", lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), x.cast("string")))),
                         lambda t: t.isNotNull())
    else:
        cells = F.transform("features", lambda x: x.cast("string"))
    line = F.concat_ws(sep, F.col("label"), F.array_join(cells, sep)) if "label" in points.columns else F.array_join(cells, sep)
    writer = points.select(line.alias("value")).write.mode(mode)
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def export_clustering(points: DataFrame, path: str, dims: int, mode: str = "overwrite") -> None:
    """CSV `element0..element{d-1},cluster`."""
    cols = [F.get("features", i).alias(f"element{i}") for i in range(dims)]
    points.select(*cols, F.col("prediction").alias("cluster")).write.mode(mode).option("header", True).csv(path)


def clusterize(spark: SparkSession, source: str, target: str, k: int, iterations: int = 100, headers: int = 1, seed: int = 1) -> None:
    """Read a CSV of points (its cluster column, if any, is dropped), cluster them and write `element0..,cluster` to `target`."""
    from ..operators.centroids import dims_of
    from ..operators.clustering import kmeans

    points = read_clustered_csv(spark, source, headers).drop("prediction")
    export_clustering(kmeans(points, k, iterations, seed=seed), target, dims_of(points))


def write_report(rows: DataFrame, path: str, append: bool = True) -> None:
    """Result lines `type,n,k,silh,time`, added to or replacing those at `path`."""
    rows.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_series_csv(spark: SparkSession, path: str, first_is_time: bool = True, sep: str = ",") -> DataFrame:
    """(pos, time, values): one row per time point of a multi-column series file."""
    cells = _data_lines(spark, path, "#").select("id", F.transform(F.split("value", _quoted(sep)), _number).alias("v"))
    if first_is_time:
        return cells.select(F.col("id").alias("pos"), F.get("v", 0).alias("time"), F.slice("v", 2, F.size("v") - 1).alias("values"))
    return cells.select(F.col("id").alias("pos"), F.col("id").cast("double").alias("time"), F.col("v").alias("values"))


def write_series_csv(series: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    line = F.concat_ws(sep, F.col("time").cast("string"), F.array_join(F.transform("values", lambda x: x.cast("string")), sep))
    series.sort("pos").select(line.alias("value")).write.mode(mode).text(path)
