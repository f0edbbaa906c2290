"""File sources and sinks: record batches, CSV for spreadsheets, newline-delimited JSON, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarind.functions.frames import frame

BATCH = "source string, version string, records array<struct<key:string,platform:string,post_id:string,record_type:string,parent_post_id:string,permalink:string,container_id:string,container_name:string,matched_keywords:array<string>,match_score:int,author_name:string,text:string,lang:string,created_at:timestamp,captured_at:timestamp,reactions_total:int,comments_count:int,media:array<struct<kind:string,url:string,thumbnail:string>>,hashtags:array<string>>>"


def read_batches(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Records of ingest batches: unknown fields are ignored, broken documents and missing identities go to ``reason``."""
    schema = T.StructType.fromDDL(BATCH + ", _broken string")
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    rows = reader.json(path).select("source", "version", "_broken", F.explode_outer("records").alias("r")).select("source", "version", "_broken", "r.*")
    missing = F.col("key").isNull() | F.col("platform").isNull() | F.col("post_id").isNull()
    return rows.withColumn("reason", F.when(F.col("_broken").isNotNull(), "broken").when(missing, "no identity")).drop("_broken")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    """RFC-quoted CSV in UTF-8 with a byte-order mark before the header.

    Lines are made as text, since the CSV writer can neither prefix a mark nor end lines by two signs;
    each part file has its own header.  Nulls are empty fields.
    """
    made = flat(df)

    def quoted(c):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    lines = made.select(F.concat_ws(",", *(quoted(c) for c in made.columns)).alias("value"))
    head = "\ufeff" + ",".join(made.columns)

    def with_head(batches):
        first = True
        for b in batches:
            if first:
                yield frame(value=[head])
                first = False
            yield frame(value=b["value"])

    lines.mapInPandas(with_head, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_ndjson(df: DataFrame, path: str, newest: str | None = None, limit: int | None = None) -> None:
    """Newline-delimited JSON; with ``newest`` and ``limit`` a report of the newest rows."""
    if newest and limit:
        df = df.orderBy(F.col(newest).desc_nulls_last()).limit(limit)
    df.write.mode("overwrite").json(path)


def write_version(df: DataFrame, path: str, version: str, column: str = "admin_version") -> None:
    """An immutable version of a reference table; an existing version is refused."""
    target = f"{path}/{column}={version}"
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(target)
    if where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where):
        raise ValueError(f"version {version} exists")
    df.drop(column).write.mode("error").parquet(target)


def geojson_units(df: DataFrame, text: str = "geojson", code: str = "code", name: str = "name") -> DataFrame:
    """Rows of a feature collection: code, name and geometry as JSON; features without a code are left out."""
    schema = "features array<struct<properties:map<string,string>,geometry:string>>"
    rows = df.select(F.explode(F.from_json(text, schema)["features"]).alias("f"))
    return rows.select(F.col("f.properties")[code].alias("code"), F.col("f.properties")[name].alias("name"), F.col("f.geometry").alias("geom_geojson")).where("code is not null")
