"""Readers and writers of series, score and metric trees."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, t, line``: each file is one row first, so that its lines keep their order."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("t", "line")).withColumn("t", F.col("t").cast("long"))


def stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def series_name(path: str = "path"):
    """The entity of a file: the folder ``entity=NAME`` that it lies in, or else its own stem."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "/entity=([^/]+)/", 1), F.lit("")), stem(path))


def write_lines(lines: DataFrame, path: str) -> None:
    """``entity, t, line`` as one text file an entity, its lines in order of t."""
    lines.repartition("entity").sortWithinPartitions("entity", "t").select("entity", "line").write.partitionBy("entity").text(path)


def write_entity_csv(series: DataFrame, root: str) -> None:
    """``entity, split, t, x, label`` as the tree that :func:`read_entity_csv` reads."""
    line = F.array_join(F.transform("x", lambda v: v.cast("string")), ",", "")
    for split in ("train", "test"):
        write_lines(series.where(F.col("split") == split).select("entity", "t", line.alias("line")), f"{root}/{split}")
    write_lines(series.where("split = 'test'").select("entity", "t", F.col("label").cast("string").alias("line")), f"{root}/test_label")


def read_entity_csv(spark: SparkSession, root: str) -> DataFrame:
    """``entity, split, t, x, label`` of a tree of headerless files under train, test and test_label.

    Cells that are no numbers are null; train rows and test rows without a label line have label 0.
    """
    vec = F.transform(F.split("line", ","), lambda c: F.trim(c).try_cast("double"))
    part = lambda name: file_lines(spark, f"{root}/{name}").select(series_name().alias("entity"), "t", vec.alias("x"))
    labels = part("test_label").select("entity", "t", F.get("x", F.lit(0)).cast("int").alias("label"))
    train = part("train").select("entity", F.lit("train").alias("split"), "t", "x", F.lit(0).alias("label"))
    test = part("test").join(labels, ["entity", "t"], "left").select("entity", F.lit("test").alias("split"), "t", "x", F.coalesce("label", F.lit(0)).alias("label"))
    return train.unionByName(test)


def read_feature_csv(spark: SparkSession, path: str, labels: str | None = None) -> DataFrame:
    """``entity, t, x, label`` of headed files; columns that name a time are dropped.

    ``labels``: files of the same names whose last column is the label; without them all labels are 0.
    """
    lines = file_lines(spark, path)
    head = lines.where("t = 0").select("path", F.split("line", ",").alias("names"))  # one row a file, joined where it is small
    cells = F.zip_with("names", F.split("line", ","), lambda n, c: F.struct(F.lower(F.trim(n)).alias("n"), F.trim(c).try_cast("double").alias("c")))
    kept = F.filter(cells, lambda p: ~p["n"].rlike("^(timestamp|date|time)"))
    body = lines.where("t > 0").join(head, "path").select(series_name().alias("entity"), (F.col("t") - 1).alias("t"), F.transform(kept, lambda p: p["c"]).alias("x"))
    if labels is None:
        return body.withColumn("label", F.lit(0))
    told = file_lines(spark, labels).where("t > 0").select(series_name().alias("entity"), (F.col("t") - 1).alias("t"), F.element_at(F.split("line", ","), -1).try_cast("double").cast("int").alias("label"))
    return body.join(told, ["entity", "t"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def parse_archive_series(df: DataFrame, path: str = "path", t: str = "t") -> DataFrame:
    """Adds entity, split and label from a stem that ends in ``_train_start_end``; anomalies lie in [start, end)."""
    parts = F.split(stem(path), "_")
    num = lambda i: F.element_at(parts, i).cast("long")
    return df.select("*", stem(path).alias("entity"), F.when(F.col(t) < num(-3), "train").otherwise("test").alias("split"), F.when((F.col(t) >= num(-2)) & (F.col(t) < num(-1)), 1).otherwise(0).alias("label"))


def eligible_series(df: DataFrame, length: int) -> DataFrame:
    """Entities not named DISTORTED or NOISE, longer than a window in both halves, with both classes in the second."""
    n = F.count("*").over(Window.partitionBy("entity"))
    half = df.withColumn("n", n).withColumn("second", F.col("t") >= F.floor(F.col("n") / 2))
    a = half.groupBy("entity").agg(F.count_if(~F.col("second")).alias("n1"), F.count_if("second").alias("n2"), F.min(F.when(F.col("second"), F.col("label"))).alias("lo"), F.max(F.when(F.col("second"), F.col("label"))).alias("hi"))
    return a.where((F.col("n1") > length) & (F.col("n2") > length) & (F.col("lo") == 0) & (F.col("hi") == 1) & ~F.upper(F.col("entity").cast("string")).rlike("DISTORTED|NOISE")).select("entity")


def to_long(df: DataFrame, keys: list[str], columns: list[str], label: str = "label") -> DataFrame:
    """``keys, value, cols``: features one below the other, the label last."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in [*columns, label]])
    return typed.unpivot(keys, [*columns, label], "cols", "value")


def from_long(df: DataFrame, keys: list[str], columns: list[str], label: str = "label") -> DataFrame:
    """Back to one row a step; any label above 0 is 1."""
    wide = df.groupBy(*keys).pivot("cols", [*columns, label]).agg(F.first("value"))
    return wide.withColumn(label, (F.col(label) > 0).cast("int"))


def concat_entities(df: DataFrame, entity: str = "entity", t: str = "t") -> DataFrame:
    """All entities one after the other in order of name: t moves on by the rows of those before."""
    n = df.groupBy(entity).agg(F.count("*").alias("n"))
    before = n.select(entity, F.coalesce(F.sum("n").over(Window.orderBy(entity).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return df.join(before, entity).withColumn(t, F.col(t) + F.col("offset")).drop("offset")


def write_scores(df: DataFrame, path: str) -> None:
    """Partitioned by window size, if there is one (``win``), and view, so that readers prune."""
    df.write.mode("overwrite").partitionBy(*[c for c in ("win", "view") if c in df.columns]).parquet(path)


def read_scores(spark: SparkSession, path: str, views: list[str] | None = None, sizes: list[int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The ledger, or those of the ``views`` and window ``sizes`` that it has; an error if it has none of them.

    With ``keys``, entities whose labels are all of one class go.
    """
    df = spark.read.parquet(path)
    df = df.where(F.col("view").isin(*views)) if views else df
    df = df.where(F.col("win").isin(*sizes)) if sizes else df
    if df.isEmpty():
        raise ValueError(f"no scores of {views or 'any view'} and {sizes or 'any size'} in {path}")
    if keys:
        df = df.join(df.groupBy(*keys).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = 0 and b = 1").select(*keys), keys, "left_semi")
    return df


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All metric files below a path, with the path of each."""
    return spark.read.schema(schema).json(path, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))


def validate_series(df: DataFrame, keys: list[str], features: int | None = None, labels: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """Violations ``keys, problem``: gaps in t, missing values, labels other than 0 and 1, an empty split.

    With ``features``, also entities of another number of channels ``ch``; with ``labels(keys, n)``,
    entities whose test rows are not as many as their labels, or that only one of both tables has;
    with ``files``, a row of null keys if the entities are not so many, and also if there are none.
    """
    wide = "ch" in df.columns
    steps = F.count_distinct("t") if wide else F.count("*")
    tested = F.count_distinct(F.when(F.col("split") == "test", F.col("t"))) if wide else F.count_if(F.col("split") == "test")
    a = df.groupBy(*keys).agg(
        steps.alias("n"), F.max("t").alias("last"), F.min("t").alias("first"), F.count_if(F.col("v").isNull() | F.isnan("v")).alias("gaps"), F.count_if(~F.col("label").isin(0, 1)).alias("odd"),
        F.count_if(F.col("split") == "train").alias("train"), tested.alias("test"), (F.count_distinct("ch") if wide else F.lit(1)).alias("width"),
    )
    checks = [("steps", (F.col("first") != 0) | (F.col("last") != F.col("n") - 1)), ("missing values", F.col("gaps") > 0), ("labels", F.col("odd") > 0), ("no train rows", F.col("train") == 0)]
    if features is not None:
        checks.append(("channels", F.col("width") != features))
    if labels is not None:
        a = a.join(labels.select(*keys, F.col("n").alias("labelled")), keys, "full")
        checks += [("label length", F.col("test") != F.col("labelled")), ("no labels", F.col("labelled").isNull()), ("no series", F.col("n").isNull())]
    out = a.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))).alias("problem"))
    total = a.where("n is not null" if labels is not None else "true").agg(F.count("*").alias("n"))
    said = F.when(F.col("n") == 0, F.lit("empty")).when(F.lit(files is not None) & (F.col("n") != (files or 0)), F.lit("files"))
    return out.unionByName(total.select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], said.alias("problem")).where("problem is not null"))


def select_by_keyword(files: DataFrame, words: list[str], count: int, name: str = "name") -> DataFrame:
    """The first file (by name) for each keyword in turn, then others by name, up to ``count``."""
    rank = F.coalesce(*[F.when(F.lower(name).contains(w.lower()), F.lit(i)) for i, w in enumerate(words)], F.lit(len(words)))
    r = files.select(name, rank.alias("k")).withColumn("first", (F.row_number().over(Window.partitionBy("k").orderBy(name)) == 1) & (F.col("k") < len(words)))
    return r.orderBy(F.desc("first"), F.when(F.col("first"), F.col("k")).otherwise(0), name).limit(count).select(name)
