"""Result tables as JSON lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object a row, nulls included, in one file a partition."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the given schema; a line that does not fit it fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
