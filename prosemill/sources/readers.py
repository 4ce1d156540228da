"""Readers with declared schemas, and parsers of the raw formats."""

from __future__ import annotations

import ast
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions.text import strip
from prosemill.sources.staging import small_batches


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


#: Declared schemas of the raw and cleaned tables.
SCHEMAS = {
    "raw_conversations": "conversations string",
    "raw_ai": "id long, text string, file string",
    "raw_human": "text string, meta string, subject string, file string",
    "raw_labelled": "text string, label int, prompt_name string, source string, RDizzl3_seven string",
    "raw_essays": "id string, text string, file string, subject string, course string",
    "cleaned_conversations": "prompt string, cleaned_text string",
    "cleaned_texts": "id string, text string, file string, subject string",
    "combined": "text string, label int, source string, subject string, group_id string",
}


#: What Spark takes for a null where a quoted field holds it: by default the empty text, which is one of its own here. No text is this one.
NO_TEXT = "no text 5c1f0b7e94d84e6d9a3f2b60c7d1e8a4"


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Quoted CSV with line breaks in fields; quotes are doubled. A field of nothing is null, a quoted one of nothing an empty text."""
    return spark.read.schema(ddl).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", NO_TEXT).csv(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def read_json_arrays(spark: SparkSession, paths: list[str], ddl: str) -> DataFrame:
    """Files that each hold one array of objects; the file's path goes along. Missing files are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).exists(at)

    there = [p for p in paths if exists(p)]
    if not there:
        return spark.createDataFrame([], schema(ddl + ", path string"))
    return spark.read.schema(ddl).option("multiLine", True).json(there).withColumn("path", F.col("_metadata.file_path"))


def read_text_tree(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Whole files below a folder: text, file (name) and subject (its folder)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return files.select(F.col("value").alias("text"), F.regexp_extract(where, "([^/]+)$", 1).alias("file"), F.regexp_extract(where, "([^/]+)/[^/]+$", 1).alias("subject"))


def first_rows(rows: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    return rows.orderBy(order).limit(n)


def require_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def subject_from_file(path: Column) -> Column:
    """Physics_task3_x.txt -> Physics; else unknown."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(name, "([A-Za-z_]+)_task", 1), F.lit("")), F.lit("unknown"))


def subject_of(discipline: Column, group: Column, folder: Column) -> Column:
    """The discipline, or the folder's name; "other" is told apart by its group."""
    wide = F.coalesce(F.nullif(group, F.lit("")), folder)
    other = (F.lower(discipline) == "other") | (F.lower(folder) == "other")
    named = F.when(F.length(wide) > 0, F.concat(wide, F.lit("_other"))).otherwise("other")
    return F.when(other, named).otherwise(F.coalesce(F.nullif(discipline, F.lit("")), F.replace(folder, F.lit("_"), F.lit(" "))))


#: Fixed value: a turn whose text stands in double quotes, for literals that can't be parsed.
_QUOTED_TURN = r"\{{'from':\s*'(?:{roles})',\s*'value':\s*\"\"?(.*?)\"\"?\}}"


def parse_conversation(text: str | None) -> tuple[str, str]:
    """Prompt and response of a list of turns written as a Python literal; a text of another form is a response without prompt.

    The prompt is the first human turn that says something, the response all the others' turns. A literal that can't be
    parsed, or with values that are no text, gives its first turns in double quotes; without such, the raw text is the response.
    """
    text = text or ""
    plain = text.strip()
    if not (plain.startswith("[") and "'from'" in text and "'value'" in text):
        return "", plain
    try:
        turns = [t for t in ast.literal_eval(text) if isinstance(t, dict)]
        asked = [t.get("value", "") for t in turns if t.get("from") == "human"]
        said = [t.get("value", "") for t in turns if t.get("from") in ("gpt", "assistant")]
        return next(filter(None, asked), asked[-1] if asked else "").strip(), " ".join(said).strip()
    except Exception:  # noqa: BLE001  any text may stand here
        found = [re.search(_QUOTED_TURN.format(roles=roles), text, re.DOTALL) for roles in ("human", "gpt|assistant")]
        return (found[0][1] if found[0] else "").strip(), (found[1][1] if found[1] else text).strip()


def conversation_parts(text: Column) -> Column:
    """struct<prompt, response> of parse_conversation, in Arrow batches: only Python knows its own literals."""

    small_batches()

    @F.pandas_udf("prompt string, response string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_conversation(v) for v in values], columns=["prompt", "response"], index=values.index)

    return run.asNondeterministic()(text)


def turns_parts(turns: Column) -> Column:
    """The same from array<struct<from, value>>."""
    asked = F.filter(turns, lambda t: (t["from"] == "human") & (F.length(t["value"]) > 0))
    said = F.transform(F.filter(turns, lambda t: t["from"].isin("gpt", "assistant")), lambda t: F.coalesce(t["value"], F.lit("")))
    return F.struct(strip(F.coalesce(F.get(asked, F.lit(0))["value"], F.lit(""))).alias("prompt"), strip(F.coalesce(F.array_join(said, " "), F.lit(""))).alias("response"))


# --- TEI XML -------------------------------------------------------------------------------------------------------


def parse_tei(raw: bytes, textless: bool = False) -> dict[str, str | None] | None:
    """discipline, disciplinary group, course and the body's text with plain spacing; None if there is no such text.

    textless: a file that can be parsed counts without text too; its text is empty, or null if it has no body.
    """
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", raw.decode("utf-8"), count=1))
    except (ET.ParseError, UnicodeDecodeError):
        return None

    def noted(path: str, name: str) -> str:
        parent = root.find(path)
        found = [p for p in parent.findall("p") if p.get("n") == name] if parent is not None else []
        return "".join(found[0].itertext()).strip() if found else ""

    body = root.find(".//body")
    text = " ".join("".join(body.itertext()).split()) if body is not None else None
    if not text and not textless:
        return None
    return {"text": text, "discipline": noted(".//sourceDesc", "discipline"), "disciplinary_group": noted(".//sourceDesc", "disciplinary group"), "course": noted(".//person", "course")}


def _parse_files(textless: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_tei(bytes(x), textless) for x in batch["content"]]
            out = pd.DataFrame([p or {} for p in parsed], columns=["text", "discipline", "disciplinary_group", "course"], dtype=object)
            yield pd.concat([batch[["path"]].reset_index(drop=True), out.where(out.notna(), None)], axis=1).assign(readable=[p is not None for p in parsed])

    return run


def tei_parsed(contents: DataFrame, root: str = "", textless: bool = False) -> DataFrame:
    """id, text, file, subject, course, readable of all files; readable: it can be parsed and holds text, or no text if `textless` says so. contents: path, content (binary)."""
    small_batches(contents.sparkSession)
    parsed = contents.select("path", "content").mapInPandas(_parse_files(textless), "path string, text string, discipline string, disciplinary_group string, course string, readable boolean")
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/") + "/") if root else "^$", "")
    parts = F.split(relative, "/")
    folder = F.when(F.size(parts) > 2, parts[1]).otherwise(F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("")))
    group = F.coalesce(F.nullif("disciplinary_group", F.lit("")), F.when(F.size(parts) > 0, parts[0]))
    name = F.element_at(parts, -1)
    return parsed.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), "text", relative.alias("file"), subject_of(F.col("discipline"), group, folder).alias("subject"), "course", "readable")


def tei_rows(contents: DataFrame, root: str = "", textless: bool = False) -> DataFrame:
    """The files that could be read."""
    return readable(tei_parsed(contents, root, textless))


def readable(parsed: DataFrame) -> DataFrame:
    return parsed.where("readable").drop("readable")


def tei_summary(parsed: DataFrame) -> DataFrame:
    """Metric, Count of tei_parsed: files found, rows, files skipped, subjects."""
    there = F.col("readable")
    counts = parsed.agg(F.count("*").alias("a"), F.count_if(there).alias("b"), F.count_if(~there).alias("c"), F.count_distinct(F.when(there, F.col("subject"))).alias("d"))
    names = {"a": "XML files found", "b": "Rows written", "c": "Skipped (unreadable)", "d": "Unique subjects"}
    return counts.select(F.inline(F.array(*(F.struct(F.lit(v).alias("Metric"), F.col(k).alias("Count")) for k, v in names.items()))))


def tei_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path).select("path", "content")


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    return tei_rows(tei_files(spark, path), path)
