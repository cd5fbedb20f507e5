"""JSON records with fixed schemas, the dataset registry, and exports."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from factloom.operators.dataset import positions, seeded_sample
from factloom.session import cut

QA_SAMPLE = "id long, question string, context string, knowledge string, right_answer string, hallucinated_answer string"
FACTOID = "id long, source_id string, fact_id string, context string, question string, factoid string, factoid_type string, context_support boolean, answer_type string, source_answer string, mutations_list struct<synonyms: array<string>, antonyms: array<string>>"


_BROKEN = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: str | StructType = QA_SAMPLE) -> DataFrame:
    """Records of a JSON array or of JSON lines (told apart by the first character), and _corrupt_record: the text of a broken one.

    Lines are split over tasks; an array is one document and is read by one task a file.
    """
    kind = spark.createDataFrame([], schema).schema
    lines = spark.read.text(path)
    first = lines.where(F.trim("value") != "").limit(1).collect()  # one row
    if first and first[0].value.lstrip("\ufeff \t").startswith("["):
        whole = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
        parsed = whole.select("value", F.from_json(F.ltrim(F.col("value"), F.lit("\ufeff")), ArrayType(kind), {"mode": "PERMISSIVE"}).alias("r"))
        broken = parsed.where("r is null").select(F.lit(None).cast(kind).alias("r"), F.col("value").alias(_BROKEN))
        return parsed.select(F.explode("r").alias("r"), F.lit(None).cast("string").alias(_BROKEN)).union(broken).select("r.*", _BROKEN)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", StructType([*kind.fields, StructField(_BROKEN, StringType())]), options).alias("r"))
    return parsed.select("r.*")


def broken_records(spark: SparkSession, path: str, schema: str | StructType = QA_SAMPLE) -> DataFrame:
    """(record): the lines that are no records, or a broken array as a whole; what load_json leaves out."""
    return read_json(spark, path, schema).where(F.col(_BROKEN).isNotNull()).select(F.col(_BROKEN).alias("record"))


def load_json(spark: SparkSession, path: str, schema: str | StructType = QA_SAMPLE, number_ids: bool = True, broken: str = "skip") -> DataFrame:
    """Records of a JSON array or of JSON lines; absent fields are null. A missing path raises.

    Broken records are skipped, and counted in a warning; broken="raise" makes them an error, broken="ignore" does not
    look for them. Missing ids become the 1-based position when number_ids is set and the schema has an id.
    """
    if broken not in ("skip", "raise", "ignore"):
        raise ValueError(f"broken must be 'skip', 'raise' or 'ignore', not {broken!r}")
    if broken != "ignore" and (n := broken_records(spark, path, schema).count()):
        if broken == "raise":
            raise ValueError(f"{n} broken records in {path}")
        warnings.warn(f"{n} broken records in {path} are skipped", stacklevel=2)
    df = read_json(spark, path, schema).where(F.col(_BROKEN).isNull()).drop(_BROKEN)
    if number_ids and "id" in df.columns and not df.where("id is null").isEmpty():
        df = positions(df).withColumn("id", F.coalesce("id", "position")).drop("position")
    return df


def load_sample(spark: SparkSession, path: str, schema: str | StructType = QA_SAMPLE, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """load_json, and of it sample_size rows by a seeded order if there are more."""
    df = load_json(spark, path, schema)
    return df if sample_size is None else seeded_sample(df, "id", sample_size, seed)


class Registry:
    """Logical names of datasets; register() makes them views for SQL."""

    def __init__(self, paths: dict[str, str]) -> None:
        self.paths = dict(paths)

    def load(self, spark: SparkSession, name: str, schema: str | StructType = QA_SAMPLE) -> DataFrame:
        if name not in self.paths:
            raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(self.paths))}")
        path = self.paths[name]
        return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else load_json(spark, path, schema)

    def register(self, spark: SparkSession) -> None:
        for name in self.paths:
            self.load(spark, name).createOrReplaceTempView(name)


def _flat(df: DataFrame) -> DataFrame:
    """Lists and structs as JSON text, for formats without them."""
    return df.select(*[F.to_json(F.col(n)).alias(n) if t.startswith(("array", "struct", "map")) else F.col(n) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, nested columns as JSON, quotes doubled."""
    _flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What write_csv wrote: quoted texts may hold line breaks, nothing is null, and "" is the empty text."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\x00").csv(path)


def write_details(df: DataFrame, path: str, kind: str = "json") -> None:
    """Nested results as JSON lines or parquet."""
    df.write.mode("overwrite").format(kind).save(path)


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A report table as markdown; for reports of categories, at most `rows` lines."""
    lines = [[str(v) for v in r] for r in df.limit(rows).collect()]
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |" for line in lines)])
