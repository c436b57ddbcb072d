"""The function index: units in the names that other tools read, one folder a language, read back or taken from whole documents.

An index is JSON lines below `language=<name>`, one function each, so that it is written and read in
parts.  Which languages have one is what the folders say; a language whose last run failed is left
out, for its folder may be of an earlier run.  A missing folder is an empty index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names in the document.
FUNCTION = "struct<name:string,code:string,isExported:boolean,unitType:string,startLine:int,endLine:int,className:string>"
SCHEMA = f"id string, function {FUNCTION}, language string"


def index_rows(units: DataFrame) -> DataFrame:
    """units (language, id, name, code, unit_type, start, end, class_name) -> language, id, function; absent values as in the document."""
    f = F.struct(
        F.coalesce("name", F.lit("")).alias("name"), F.coalesce("code", F.lit("")).alias("code"), F.lit(True).alias("isExported"), F.coalesce("unit_type", F.lit("function")).alias("unitType"),
        F.coalesce("start", F.lit(0)).cast("int").alias("startLine"), F.coalesce("end", F.lit(0)).cast("int").alias("endLine"), F.nullif("class_name", F.lit("")).alias("className"),
    )
    return units.select("language", "id", f.alias("function"))


def write_index(units: DataFrame, folder: str) -> None:
    index_rows(units).write.mode("overwrite").partitionBy("language").json(folder)


def read_index(spark: SparkSession, folder: str, outcomes: DataFrame) -> DataFrame:
    """language, id, function of the languages whose last run is ok (outcomes: language, ok); a null language is one of its own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(SCHEMA).json(folder) if there else spark.createDataFrame([], SCHEMA)
    good = outcomes.where("ok").select(F.col("language").alias("_ok")).distinct()
    return rows.join(good, F.col("language").eqNullSafe(F.col("_ok")), "left_semi").select("language", "id", "function")


def functions_of_documents(documents: DataFrame) -> DataFrame:
    """documents (json) with all functions by id -> id, function; a document without them, or of bad JSON, gives none."""
    read = F.from_json("json", f"functions map<string,{FUNCTION}>")
    return documents.select(F.explode(read["functions"]).alias("id", "function"))
