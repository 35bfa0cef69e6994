"""Readers and sinks for bars and records in files and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS_SCHEMA = "ts timestamp, open double, high double, low double, close double, volume double"
#: Format and options by file ending.
FORMATS = {
    ".csv": ("csv", {"header": True}), ".tsv": ("csv", {"header": True, "sep": "\t"}), ".parquet": ("parquet", {}), ".jsonl": ("json", {}), ".json": ("json", {"multiLine": True}), ".orc": ("orc", {}), ".txt": ("text", {"wholetext": True}),
}
#: Column names of other makers, folded to lower case.
ALIASES = {
    "date": "ts", "datetime": "ts", "timestamp": "ts", "time": "ts", "tarih": "ts", "acilis": "open", "açılış": "open", "yuksek": "high", "yüksek": "high", "dusuk": "low", "düşük": "low",
    "kapanis": "close", "kapanış": "close", "last": "close", "hacim": "volume", "vol": "volume", "ticker": "symbol", "sembol": "symbol",
}
REQUIRED = ("ts", "open", "high", "low", "close", "volume")


def format_of(path: str) -> tuple[str, dict]:
    """Reader format and options by the file's ending."""
    for ending, found in FORMATS.items():
        if path.rstrip("/").lower().endswith(ending):
            return found
    raise ValueError(f"no reader for {path}")


def read_file(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    kind, own = format_of(path)
    reader = spark.read.format(kind).options(**own | options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_csv_bars(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Bars from CSV files; the symbol is the file's name without its ending, so a folder is read in one go."""
    rows = spark.read.schema(BARS_SCHEMA).csv(path, header=True, sep=delimiter)
    return rows.select(F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(\.[A-Za-z]+)?\.csv$", 1)).alias("symbol"), "*")


def read_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table by JDBC, read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def mapping(columns: list[str]) -> dict[str, str]:
    """Source column -> standard name."""
    return {c: ALIASES.get(c.strip().lower(), c.strip().lower()) for c in columns}


def mapping_confidence(columns: list[str]) -> float:
    """0.4 of the share of known columns and 0.6 of the share of required ones."""
    known = [m for m in mapping(columns).values() if m in (*REQUIRED, "symbol")]
    return 0.4 * len(known) / max(1, len(columns)) + 0.6 * len(set(known) & set(REQUIRED)) / len(REQUIRED)


def renamed(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{a}`").alias(b) for a, b in mapping(df.columns).items()))


def number(column: str):
    """Numbers with either decimal mark: the last of comma and point is the mark."""
    text = F.regexp_replace(F.trim(F.col(column).cast("string")), r"[^0-9,.\-]", "")
    comma, point = F.locate(",", F.reverse(text)), F.locate(".", F.reverse(text))
    marks_comma = (comma > 0) & ((point == 0) | (comma < point))
    return F.when(marks_comma, F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(text, ",", "")).try_cast("double")


def write_bars(bars: DataFrame, folder: str, mode: str = "append") -> None:
    """One store for all symbols, by timeframe; rows of a symbol stand together in a file."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode(mode).partitionBy("timeframe").parquet(folder)


def append_records(records: DataFrame, folder: str) -> None:
    records.write.mode("append").json(folder)


def latest_records(spark: SparkSession, folder: str, schema: str, by: str, n: int) -> DataFrame:
    return spark.read.schema(schema).json(folder).orderBy(F.desc(by)).limit(n)


#: Columns of imported records by kind: (schema, key of a record, columns that must be there).
IMPORTS = {
    "corporate_actions": ("action_id string, symbol string, action_type string, status string, effective_date date, cash_amount double, ratio double", ("symbol", "action_type", "effective_date"), ("symbol", "effective_date")),
    "events": ("event_id string, symbol string, event_type string, title string, event_date date", ("symbol", "event_type", "event_date"), ("event_type", "event_date")),
    "instruments": ("symbol string, name string, sector string, market string, status string", ("symbol",), ("symbol",)),
}


def read_records(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(records, refused) of a CSV or JSON file, or of a folder of one of them. Values that do not fit their type or lack a
    required column are refused with their text; of records with one key the first by all columns stays."""
    schema, key, needed = IMPORTS[kind]
    fields = spark.createDataFrame([], schema).schema
    ending = path.rstrip("/").lower()
    lines = spark.read.option("pathGlobFilter", "*.json*" if ending.endswith(("json", "jsonl")) else "*")
    raw = ", ".join(f"{f.name} string" for f in fields)
    rows = lines.schema(raw).json(path, multiLine=ending.endswith(".json")) if ending.endswith((".json", ".jsonl")) else lines.schema(raw).csv(path, header=True, enforceSchema=False)
    typed = {f.name: F.upper(F.trim(f.name)) if f.name in ("symbol", "status", "action_type", "event_type") else F.col(f.name).try_cast(f.dataType) for f in fields}
    broken = [F.when((F.trim(f.name) != "") & typed[f.name].isNull(), F.lit(f.name)) for f in fields] + [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in needed]
    judged = rows.withColumn("faults", F.array_distinct(F.array_compact(F.array(*broken))))
    good = judged.where(F.size("faults") == 0).select(*(e.alias(c) for c, e in typed.items()))
    first = good.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.min(F.struct(*good.columns)).alias("r"))
    return first.select("r.*"), judged.where(F.size("faults") > 0)


def write_dataset(rows: DataFrame, folder: str, formats: tuple[str, ...] = ("parquet",), part: str = "part") -> dict[str, str]:
    """A data set in each format, one folder for each value of `part` (train, test), and its schema as one JSON record.
    An empty data set is refused. Returns the places written."""
    if not rows.take(1):
        raise ValueError("an empty data set is not written")
    places = {kind: f"{folder}/dataset.{kind}" for kind in formats}
    for kind, place in places.items():
        options = {"header": True} if kind == "csv" else {}
        rows.write.mode("overwrite").partitionBy(part).format(kind).options(**options).save(place)
    described = rows.sparkSession.createDataFrame([(c, t, c == part) for c, t in rows.dtypes], "column string, type string, is_part boolean")
    described.coalesce(1).write.mode("overwrite").json(f"{folder}/schema")
    return places | {"schema": f"{folder}/schema"}


def checksum(df: DataFrame) -> DataFrame:
    """One row: count and an order-free checksum of all columns."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("checksum"))


def schema_drift(df: DataFrame, expected: dict[str, str]) -> dict[str, list[str]]:
    """Columns missing, added and of another type, from metadata alone."""
    own = dict(df.dtypes)
    return {"missing": sorted(expected.keys() - own), "added": sorted(own.keys() - expected), "changed": sorted(c for c in own.keys() & expected if own[c] != expected[c])}
