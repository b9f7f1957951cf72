"""Readers and writers. Spark formats stay distributed; Excel, SPSS and Stata go through the driver, within a limit."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.dataset import SurveyData
from tallyframe.operators.variables import MissingValue, Variable, VariableMap, attach_metadata, metadata_of

#: Most rows that a single-file format may take through the driver.
DRIVER_ROWS = 1_000_000
# Dtypes of metadata as Spark types.
SPARK_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "category": T.StringType(), "datetime": T.TimestampType()}
# Measurement levels of statistics packages.
MEASURES = {"nominal": "nominal", "ordinal": "ordinal", "interval": "scale", "ratio": "scale"}
SCALE_OF_MEASURE = {"nominal": "nominal", "ordinal": "ordinal", "scale": "interval"}


def schema_of(variables: VariableMap) -> T.StructType:
    """Explicit schema from metadata; variables without a dtype are text."""
    return T.StructType([T.StructField(n, SPARK_TYPES.get(v.dtype, T.StringType())) for n, v in variables.items()])


def nan_to_null(df: DataFrame) -> DataFrame:
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in real else F.col(f"`{c}`") for c in df.columns])


def plain_columns(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, for formats that have none."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select([F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def to_driver(frame) -> pd.DataFrame:
    if isinstance(frame, pd.DataFrame):
        return frame
    rows = plain_columns(frame).limit(DRIVER_ROWS + 1).toPandas()
    if len(rows) > DRIVER_ROWS:
        raise ValueError(f"a single file takes at most {DRIVER_ROWS} rows; write CSV or Parquet")
    return rows


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    out = plain_columns(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True)
    return path


class CSVReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str, variables: VariableMap | None = None, **options) -> SurveyData:
        """With metadata the schema is explicit (by position of its variables); without, it is inferred."""
        reader = self.spark.read.options(header=True, **options)
        frame = reader.csv(path, schema=schema_of(variables)) if variables else reader.csv(path, inferSchema=True)
        return SurveyData(nan_to_null(frame), variables or VariableMap())


class CSVWriter:
    def write(self, data: SurveyData, path: str, single: bool = False) -> str:
        return write_csv(data.frame, path, single)


class ParquetReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str) -> SurveyData:
        frame = self.spark.read.parquet(path)
        return SurveyData(frame, metadata_of(frame))


class ParquetWriter:
    def write(self, data: SurveyData, path: str, partition_by: list[str] | None = None) -> str:
        """Metadata travels in the columns."""
        attach_metadata(data.frame, data.variables).write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
        return path


class JSONReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str, variables: VariableMap | None = None) -> SurveyData:
        reader = self.spark.read
        return SurveyData((reader.schema(schema_of(variables)) if variables else reader).json(path), variables or VariableMap())


class ExcelReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str, **options) -> SurveyData:
        return SurveyData(nan_to_null(self.spark.createDataFrame(pd.read_excel(path, **options))))


class ExcelWriter:
    def write(self, data, path: str) -> str:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        to_driver(data.frame if isinstance(data, SurveyData) else data).to_excel(path, index=False)
        return path


def _pyreadstat():
    try:
        import pyreadstat
    except ImportError as e:
        raise RuntimeError("SPSS and Stata files need pyreadstat") from e
    return pyreadstat


def variables_from_stat(meta) -> VariableMap:
    """Registry from a statistics file's metadata: labels without missing codes, only single missing codes, unknown
    measures as interval."""
    out = VariableMap()
    for name, label in zip(meta.column_names, meta.column_labels, strict=True):
        ranges = getattr(meta, "missing_ranges", {}).get(name, [])
        codes = [r["lo"] if isinstance(r, dict) else r for r in ranges if not isinstance(r, dict) or r["lo"] == r["hi"]]
        labels = dict(meta.variable_value_labels.get(name, {}))
        missing = tuple(MissingValue(c, labels.get(c)) for c in codes)
        measure = getattr(meta, "variable_measure", {}).get(name)
        out.add(Variable(name, SCALE_OF_MEASURE.get(measure, "interval"), label or name, {k: v for k, v in labels.items() if k not in codes}, missing))
    return out


def _stat_arguments(variables: VariableMap, columns: list[str]) -> dict:
    labels = {n: {**variables[n].labels, **{m.code: m.label for m in variables[n].missing}} for n in columns if n in variables and (variables[n].labels or variables[n].missing)}
    return {"column_labels": [variables[c].label if c in variables else c for c in columns], "variable_value_labels": labels}


class SPSSReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str) -> SurveyData:
        frame, meta = _pyreadstat().read_sav(path, user_missing=True)
        return SurveyData(nan_to_null(self.spark.createDataFrame(frame)), variables_from_stat(meta))


class SPSSWriter:
    def write(self, data: SurveyData, path: str) -> str:
        frame = to_driver(data.frame)
        known = {n: v for n, v in data.variables.items() if n in frame.columns}
        _pyreadstat().write_sav(
            frame, path, **_stat_arguments(data.variables, list(frame.columns)),
            missing_ranges={n: list(v.missing_values) for n, v in known.items() if v.missing},
            variable_measure={n: MEASURES.get(v.scale, "scale") for n, v in known.items()},
        )
        return path


class StataReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str) -> SurveyData:
        frame, meta = _pyreadstat().read_dta(path, user_missing=True)
        return SurveyData(nan_to_null(self.spark.createDataFrame(frame)), variables_from_stat(meta))


class StataWriter:
    def __init__(self, version: int = 15):
        self.version = version

    def write(self, data: SurveyData, path: str) -> str:
        frame = to_driver(data.frame)
        letters = {n: [c for c in v.missing_values if isinstance(c, str) and len(c) == 1 and "a" <= c <= "z"] for n, v in data.variables.items() if n in frame.columns}
        _pyreadstat().write_dta(frame, path, version=self.version, **_stat_arguments(data.variables, list(frame.columns)), missing_user_values={n: c for n, c in letters.items() if c})
        return path


class RScriptWriter:
    """A folder with the data as CSV, the dictionary as JSON and an R script that puts labels and missing codes on."""

    def write(self, data: SurveyData, path: str) -> str:
        folder = Path(path)
        folder.mkdir(parents=True, exist_ok=True)
        write_csv(data.frame, str(folder / "data"))
        DictionaryWriter().write(data.variables, str(folder / "dictionary.json"))
        (folder / "load.R").write_text(self.script(data), encoding="utf-8")
        return path

    @staticmethod
    def script(data: SurveyData) -> str:
        text = lambda x: json.dumps(str(x), ensure_ascii=False)
        code = lambda x: str(x) if isinstance(x, (int, float)) else text(x)
        lines = ["files <- list.files('data', pattern = '[.]csv$', full.names = TRUE)", "df <- do.call(rbind, lapply(files, read.csv, check.names = FALSE))"]
        for n, v in data.variables.items():
            if n not in data.frame.columns:
                continue
            column = f"df[[{text(n)}]]"
            for m in v.missing:
                lines.append(f"{column}[{column} %in% {code(m.code)}] <- NA")
            if v.labels:
                ordered = "TRUE" if v.scale == "ordinal" else "FALSE"
                lines.append(f"{column} <- factor({column}, levels = c({', '.join(map(code, v.labels))}), labels = c({', '.join(map(text, v.labels.values()))}), ordered = {ordered})")
            if v.label:
                lines.append(f"attr({column}, 'label') <- {text(v.label)}")
        return "\n".join(lines) + "\n"


class DictionaryWriter:
    def write(self, variables: VariableMap, path: str) -> str:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(variables.to_dict(), ensure_ascii=False, indent=2), encoding="utf-8")
        return path


class DictionaryReader:
    def read(self, path: str) -> VariableMap:
        return VariableMap.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))


READERS = {".csv": CSVReader, ".xlsx": ExcelReader, ".xls": ExcelReader, ".sav": SPSSReader, ".dta": StataReader, ".parquet": ParquetReader, ".json": JSONReader}
WRITERS = {"csv": CSVWriter, "xlsx": ExcelWriter, "excel": ExcelWriter, "r": RScriptWriter, "spss": SPSSWriter, "sav": SPSSWriter, "stata": StataWriter, "dta": StataWriter, "parquet": ParquetWriter}


class SurveyDataReader:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str, **options) -> SurveyData:
        """By suffix."""
        kind = READERS.get(Path(path).suffix.lower())
        if kind is None:
            raise ValueError(f"no reader for {Path(path).suffix or path!r}")
        return kind(self.spark).read(path, **options)


def export(data: SurveyData, kind: str, path: str) -> str:
    if kind.lower() not in WRITERS:
        raise NotImplementedError(f"no writer for {kind!r}")
    return WRITERS[kind.lower()]().write(data, path)


def register_reader(suffix: str, reader: type) -> None:
    """Adds a reader class (constructed with the session, with a read method) for a file suffix."""
    READERS[suffix.lower()] = reader


def register_writer(kind: str, writer: type) -> None:
    """Adds a writer class (with a method write(data, path) that returns the path) for a kind of export."""
    WRITERS[kind.lower()] = writer
