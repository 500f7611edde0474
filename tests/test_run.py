"""Runs that start at files: the command line, all stages, killed and resumed."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.__main__ import main
from tessitura.ml import nested, search
from tessitura.plans.journal import Journal
from tessitura.plans.settings import TrainingConfig
from tessitura.sources import audio, metadata, sinks

GRID = [(0, "svm_linear", 25, 0.1, None, None, None, None, None, 0, 0), (1, "mlp", 25, None, None, [4], 0.001, 0.0, 3, 4, 1)]
CONFIG = TrainingConfig(cv_folds=2, bootstrap_iterations=40, test_size=0.25, nested=True, curves=True, nested_folds=2, nested_repeats=1, fractions=(0.5, 1.0))


def workbook(path, sheets):
    """A workbook whose cells are shared strings, inline strings and numbers."""
    shared, parts = [], {}
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    for n, (name, rows) in enumerate(sheets.items(), 1):
        xml = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        for r, row in enumerate(rows, 1):
            xml += f'<row r="{r}">'
            for c, v in enumerate(row):
                at = f"{chr(65 + c)}{r}"
                if isinstance(v, (int, float)):
                    xml += f'<c r="{at}"><v>{v}</v></c>'
                elif v is not None and c % 2:
                    xml += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
                elif v is not None:
                    shared.append(v)
                    xml += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
            xml += "</row>"
        parts[f"xl/worksheets/sheet{n}.xml"] = xml + "</sheetData></worksheet>"
        rel += f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>'
        book += f'<sheet name="{name}" sheetId="{n}" r:id="r{n}"/>'
    parts |= {"xl/workbook.xml": book + "</sheets></workbook>", "xl/_rels/workbook.xml.rels": rel + "</Relationships>"}
    parts["xl/sharedStrings.xml"] = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{v}</t></si>" for v in shared) + "</sst>"
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)


def tone(rng, pathological):
    t = np.arange(9600) / 16000
    return 0.3 * np.sin(2 * np.pi * (120 + 90 * pathological) * t) + (0.02 + 0.05 * pathological) * rng.normal(size=len(t))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Both databases: 20 files of the first, 16 speakers with vowels a and i of the second."""
    at, rng = tmp_path_factory.mktemp("data"), np.random.default_rng(0)
    header = ["Archivo", "edad", "sexo", "Patología"]
    sheets = {"Normales": [["title"], header], "Patológicos": [["title"], header]}
    for i in range(20):
        bad = i % 2
        folder = at / "d1" / "raw" / ("Pathol" if bad else "Normal")
        os.makedirs(folder, exist_ok=True)
        (folder / f"v{i:02d}.wav").write_bytes(audio.encode_wav(tone(rng, bad), 16000))
        sheets["Patológicos" if bad else "Normales"].append([f"v{i:02d}.wav", 30 + i, "H" if i % 4 < 2 else "M", "nodule" if bad else None])
    workbook(at / "d1" / "raw" / "metadata.xlsx", sheets)
    for group, bad in (("Gesund", 0), ("Dysphonie", 1)):
        lines = ["AufnahmeID,AufnahmeTyp,AufnahmeDatum,Diagnose,SprecherID,Geburtsdatum,Geschlecht,Pathologien"]
        for i in range(8):
            n = 100 * (bad + 1) + i
            folder = at / "d2" / "raw" / group / str(n) / "vowels"
            os.makedirs(folder)
            for vowel in "ai":
                (folder / f"{n}-{vowel}_n.nsp").write_bytes(audio.encode_nsp(tone(rng, bad), 16000))
            lines.append(f"{n},n,2000-01-0{i + 1},,s{n},1960-01-01,{'w' if i % 2 else 'm'},{'dysphonia' if bad else ''}")
        (at / "d2" / "raw" / group / "overview.csv").write_text("\n".join(lines) + "\n")
    return at


@pytest.fixture
def at_root(root, monkeypatch):
    monkeypatch.setenv("DATA_ROOT", str(root))
    return root


def test_workbook_sheets(spark, root):
    path = f"file://{root}/d1/raw/metadata.xlsx"
    rows = metadata.read_sheet(spark, path, "pathological", "Patológicos").orderBy("metadata_filename").collect()
    assert len(rows) == 10 and rows[0]["metadata_filename"] == "v01.wav" and rows[0]["age"] == 31.0
    assert {r["sex"] for r in rows} == {"male", "female"} and {r["pathology"] for r in rows} == {"nodule"} and rows[0]["metadata_sheet"] == "Patológicos"
    assert metadata.read_sheet(spark, path, "healthy", "Normales").filter("pathology IS NULL").count() == 10
    with pytest.raises(ValueError, match="no row"):
        metadata.read_sheet(spark, path, "healthy", "absent")


def test_prepare_from_the_command_line(spark, at_root):
    folder = main(["--dataset", "d1", "--stage", "prepare"])
    held = spark.read.parquet(f"{folder.manifests}/training_manifest.parquet")
    assert held.count() == 20 and held.filter("age IS NOT NULL AND pathology = 'nodule'").count() == 10
    assert {r["label"]: r["count"] for r in held.groupBy("label").count().collect()} == {"healthy": 10, "pathological": 10}


def test_multi_vowel_run_is_killed_and_resumed(spark, at_root, monkeypatch):
    """The second database with two vowels: the run dies in the search, and goes on without fitting a unit again."""
    arguments = ["--dataset", "d2", "--vowels", "a", "i", "--stage", "train", "--experiment-name", "multi"]
    whole = Journal.add

    def dying(self, rows):
        if self.path.endswith("/search"):
            whole(self, rows.filter("fold = 0"))
            raise KeyboardInterrupt
        whole(self, rows)

    monkeypatch.setattr(Journal, "add", dying)
    with pytest.raises(KeyboardInterrupt):
        main(arguments, CONFIG, GRID)
    monkeypatch.setattr(Journal, "add", whole)
    root = next((at_root / "D2" / "experiments").iterdir())
    log = f"file://{root}/training/journal/search"
    before = spark.read.parquet(log)
    fitted, runs = before.count(), {r["run"] for r in before.select("run").distinct().collect()}
    folder = main([*arguments, "--resume", f"file://{root}"], CONFIG, GRID)
    after = spark.read.parquet(log)
    again = after.filter(~F.col("run").isin(list(runs)))
    assert fitted > 0 and after.filter(F.col("run").isin(list(runs))).count() == fitted
    assert again.filter("fold = 0").count() == 0 and again.count() == fitted
    at = f"{folder.root}/training"
    metrics = {r["evaluation_scope"] for r in spark.read.parquet(f"{at}/metrics.parquet").collect()}
    assert {"overall", "vowel:a", "vowel:i", "vowel:macro"} <= metrics
    protocol = json.loads(sinks.read_text(spark, f"{at}/protocol.json"))
    assert {r[0] for r in spark.read.parquet(f"{at}/metrics.parquet").select("protocol").collect()} == {protocol["sha256"]}
    assert sinks.read_text(spark, f"{at}/protocol.md").startswith("# Protocol")
    for name in ("cv_results", "fold_scores", "selected", "intervals", "secondary", "split_assignments", "learning_curve", "nested_results", "nested_assignments", "nested_summary", "nested_stability"):
        assert spark.read.parquet(f"{at}/{name}.parquet").count() > 0, name
    families = {r["family"] for r in spark.read.parquet(f"{at}/secondary.parquet").collect()}
    assert families == {"svm", "mlp"} and spark.read.parquet(f"{at}/models").filter("name = 'primary'").count() == 1
    assert spark.read.parquet(f"{at}/predictions").count() == spark.read.parquet(f"{at}/split_assignments.parquet").filter("partition = 'test'").count()
    with pytest.raises(ValueError, match="protocol"):
        main([*arguments, "--resume", f"file://{root}"], TrainingConfig(**{**CONFIG.__dict__, "seed": 1}), GRID)


def test_cross_run_takes_features_of_finished_runs(spark, at_root):
    small = TrainingConfig(cv_folds=2, bootstrap_iterations=20)
    first = main(["--dataset", "d1", "--stage", "features", "--experiment-name", "one"])
    second = main(["--dataset", "d2", "--stage", "features", "--experiment-name", "two"])
    sources = ["--first-source", first.root, "--second-source", second.root]
    folder = main(["--dataset", "cross", "--stage", "train", "--direction", "d1_to_d2", *sources], small, GRID[:1])
    at = f"{folder.root}/training/d1_to_d2"
    assert spark.read.parquet(f"{at}/predictions").count() == 16
    assert not os.path.exists(f"{folder.root.removeprefix('file://')}/d1/features")
    with pytest.raises(ValueError, match="is a run of d2"):
        main(["--dataset", "cross", "--stage", "train", "--first-source", second.root], small, GRID[:1])


def nested_rows(spark, n=48):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"g{i // 2}", (i // 2) % 2, [float(v) for v in rng.normal((i // 2) % 2, 1, 6)]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, group string, target int, x array<double>")


def test_outer_rows_never_enter_inner_fits(spark):
    """Outer rows are given features that make a fit fail loudly: labels that their features contradict, far away."""
    rows = nested_rows(spark)
    out = nested.nested_search(rows, search.configurations(spark, GRID), {"all": list(range(6)), "few": [0, 1, 2]}, outer=3, repeats=2, inner=2)
    parts = out.assignments.toPandas()
    assert len(parts) == 48 * 6 and (parts.groupby(["split", "group"]).part.nunique() == 1).all()
    assert (parts[parts.part < 0].groupby(["repeat", "sample_id"]).size() == 1).all()
    results = {r["split"]: r for r in out.results.collect()}
    assert len(results) == 6 and all(r["n_outer_train_samples"] + r["n_outer_validation_samples"] == 48 for r in results.values())
    assert {r["metric"]: r["n"] for r in out.summary.collect()}["balanced_accuracy"] == 6 and sum(r["n"] for r in out.stability.collect()) == 6
    # Other outer rows of split 0, same inner ones: the same inner scores and choice.
    held = {r.sample_id for r in parts[(parts.split == 0) & (parts.part < 0)].itertuples()}
    far = rows.withColumn("x", F.when(F.col("sample_id").isin(list(held)), F.transform("x", lambda v: v * 1e6)).otherwise(F.col("x")))
    again = {r["split"]: r for r in nested.nested_search(far, search.configurations(spark, GRID), {"all": list(range(6)), "few": [0, 1, 2]}, outer=3, repeats=2, inner=2).results.collect()}
    same = ("scenario", "candidate", "inner_score", "inner_std", "inner_train_score", "outer_train_balanced_accuracy")
    assert [results[0][c] for c in same] == pytest.approx([again[0][c] for c in same])


def test_journal_counts_a_unit_once_and_belongs_to_one_protocol(spark, tmp_path):
    units = spark.createDataFrame([(i,) for i in range(10)], "unit int")
    one = Journal(spark, f"file://{tmp_path}/log", "p", ["unit"])
    assert one.left(units).count() == 10
    for _ in range(2):
        one.add(units.filter("unit < 4").withColumn("value", F.lit(1.0)))
    assert one.rows().count() == 4 and sorted(r[0] for r in one.left(units).collect()) == [4, 5, 6, 7, 8, 9]
    made = []
    out = one.completed(units, lambda todo: made.append(todo.count()) or todo.withColumn("value", F.lit(2.0)))
    assert made == [6] and out.count() == 10 and out.agg(F.sum("value")).first()[0] == 16
    with pytest.raises(ValueError, match="belongs to protocol p"):
        Journal(spark, f"file://{tmp_path}/log", "q", ["unit"]).completed(units, lambda todo: todo)
