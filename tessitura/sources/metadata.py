"""Metadata tables of recordings: reading, renaming, typing."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


# The sheets of the first database's workbook and their labels.
SHEETS = {"Normales": "healthy", "Patológicos": "pathological"}


def read_overviews(spark: SparkSession, folder: str, name: str = "overview.csv") -> DataFrame:
    """All overview files below the folder in one scan, with the path of each row's file."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(folder)
    return rows.withColumn("metadata_path", F.col("_metadata.file_path"))


def typed_metadata(raw: DataFrame) -> DataFrame:
    """Columns renamed, ids trimmed, dates, age and sex derived where their columns exist."""
    rows = raw.withColumnsRenamed({k: v for k, v in T.COLUMNS_2.items() if k in raw.columns})
    absent = {"recording_id", "speaker_id"} - set(rows.columns)
    if absent:
        raise ValueError(f"missing columns: {sorted(absent)}")
    more = {"recording_id": T.normalize_recording_id(F.col("recording_id")), "speaker_id": T.normalize_recording_id(F.col("speaker_id"))}
    if {"recording_date", "birth_date"} <= set(rows.columns):
        more["age"] = T.age_at(F.col("recording_date"), F.col("birth_date"))
    if "sex" in rows.columns:
        more["sex"] = T.recode(F.col("sex"), T.SEX_CODES_2, ignore_case=True)
    if "metadata_path" in rows.columns:
        group = F.element_at(F.split("metadata_path", "/"), -2)
        more |= {"pathology_group": group, "pathology_group_key": T.normalize_text(group), "label": T.label_from_group(T.normalize_text(group))}
    return rows.withColumns(more)


def read_sheet(spark: SparkSession, path: str, label: str, sheet: str | None = None) -> DataFrame:
    """One sheet of a workbook whose second row is the header (or a CSV export of it): renamed, trimmed, labelled."""
    if path.lower().endswith(".xlsx"):
        raw = sheet_rows(read_workbook(spark, path), sheet)
    else:
        raw = spark.read.option("header", True).csv(path)
    rows = raw.dropna(how="all").withColumnsRenamed({k: v for k, v in T.COLUMNS_1.items() if k in raw.columns})
    numbers = {"age", "metadata_fs"} | {c for c in rows.columns if c.startswith(("grbas_", "f0_", "f1_", "f2_", "f3_"))}
    values = {c: T.to_number(F.col(c)) if c in numbers else F.trim(F.col(c).cast("string")) for c in rows.columns}
    values["label"] = F.lit(label)
    values["metadata_sheet"] = F.lit(sheet).cast("string")
    if "sex" in rows.columns:
        values["sex"] = T.recode(F.trim("sex"), T.SEX_CODES_1, ignore_case=True)
    if "metadata_filename" in rows.columns:
        values["metadata_file_key"] = T.normalize_filename_key(F.col("metadata_filename"))
    return rows.withColumns(values)


def sheet_rows(cells: DataFrame, sheet: str | None = None, header: int = 2) -> DataFrame:
    """A sheet as a table: columns named by the header row (as many as it has cells), one row for each row below it."""
    own = cells.filter(F.col("sheet") == sheet) if sheet is not None else cells.filter(F.col("sheet_number") == 0)
    names = own.filter(F.col("row") == header).select(F.explode("cells").alias("column", "name")).collect()
    if not names:
        raise ValueError(f"sheet {sheet} has no row {header}")
    below = own.filter(F.col("row") > header)
    return below.select(*[F.col("cells")[r["column"]].alias(r["name"].strip()) for r in sorted(names, key=lambda r: (len(r["column"]), r["column"]))])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, sheet_number, row, cells (column letters to text): all cells of the workbooks that the path names.

    A workbook is a zip of XML parts; a task opens it and parses its sheets as streams, a row at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, sheet string, sheet_number int, row int, cells map<string,string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                held: list[tuple] = []
                for one in _cells(bytes(content)):
                    held.append((name, *one))
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=WORKBOOK)
                        held = []
                yield pd.DataFrame(held, columns=WORKBOOK)

    return files.mapInPandas(run, schema)


WORKBOOK = ["path", "sheet", "sheet_number", "row", "cells"]
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(content: bytes) -> Iterator[tuple[str, int, int, dict[str, str]]]:
    """sheet, its number, row, text by column letters; formulas give their stored values, empty cells are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
    shared = [text(e) for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")) if e.tag == f"{_MAIN}si"] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    for number, sheet in enumerate(ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet")):
        target = targets[sheet.get(_RELATION)]
        place = 0
        for _, e in ElementTree.iterparse(book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}")):
            if e.tag != f"{_MAIN}row":
                continue
            place = int(e.get("r") or place + 1)
            found: dict[str, str] = {}
            for c in e.iter(f"{_MAIN}c"):
                value = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    held = text(c)
                elif value is None or value.text is None:
                    continue
                else:
                    held = shared[int(value.text)] if c.get("t") == "s" else value.text
                if held.strip():
                    found[re.sub("[0-9]+$", "", c.get("r"))] = held
            e.clear()
            if found:
                yield sheet.get("name"), number, place, found


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """key, value: the entries of a JSON object in a file, values that are no text as JSON."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>"))).select("key", "value")


def join_metadata(audio: DataFrame, metadata: DataFrame, keys: dict[str, str], one_to_one: bool = False) -> DataFrame:
    """Left join on audio column = metadata column; metadata columns that clash get ``_metadata``.

    The metadata's keys must be unique, for one_to_one the audio's too.
    """
    from ..operators.cohort import assert_empty, repeated

    assert_empty(repeated(metadata, *keys.values()), "repeated metadata keys")
    if one_to_one:
        assert_empty(repeated(audio, *keys), "repeated audio keys")
    clash = {c: f"{c}_metadata" for c in metadata.columns if c in audio.columns}
    held = metadata.withColumnsRenamed(clash)
    condition = None
    for a, m in keys.items():
        one = audio[a] == held[clash.get(m, m)]
        condition = one if condition is None else condition & one
    return audio.join(held, condition, "left")


def unrepeated(metadata: DataFrame, physical: Sequence[str] = ("metadata_path",)) -> DataFrame:
    """Rows that differ only in where they stand count once; other rows with one key are an error of join_metadata()."""
    return metadata.dropDuplicates([c for c in metadata.columns if c not in physical])


def first_manifest(spark: SparkSession, audio: DataFrame, workbook: str) -> DataFrame:
    """The indexed recordings of the first database with the metadata of both sheets, one row of it for each file."""
    parts = [read_sheet(spark, workbook, label, sheet) for sheet, label in SHEETS.items()]
    metadata = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return join_metadata(audio, metadata, {"file_key": "metadata_file_key", "label": "label"}, one_to_one=True)


def second_manifest(spark: SparkSession, audio: DataFrame, folder: str) -> DataFrame:
    """The indexed recordings of the second database with the overviews below the folder, one row of them for many files."""
    keys = ("pathology_group_key", "recording_id", "label")
    metadata = unrepeated(typed_metadata(read_overviews(spark, folder)))
    rows = join_metadata(audio, metadata, {k: k for k in keys})
    pathology = F.coalesce("pathology", "pathology_group") if "pathology" in metadata.columns else F.col("pathology_group")
    return rows.withColumns({"pathology": pathology, "speaker_id_source": F.lit("metadata")})
