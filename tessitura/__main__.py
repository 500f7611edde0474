"""python -m tessitura --dataset d1 ...: run a plan over a folder of recordings (DATA_ROOT, default the current one).

<root>/d1/raw has WAV files and metadata.xlsx; <root>/d2/raw has <group>/overview.csv and <group>/<recording>/vowels/.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .plans.runner import run
from .plans.settings import Dataset, Request, RunFolder, TrainingConfig, parse
from .sources import audio, metadata

WORKBOOK = "metadata.xlsx"


def manifests(spark: SparkSession, request: Request, root: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Raw manifests, and signals by path, of the databases that the request needs.

    Manifests come from headers and hashes; a signal is decoded only for rows that reach the features stage.
    """
    wanted = {Dataset.FIRST: ("d1",), Dataset.SECOND: ("d2",)}.get(request.dataset, ("d1", "d2"))
    raw, signals = {}, {}
    for name in wanted:
        folder = f"{root}/{name}/raw"
        files = audio.read_audio(spark, folder, keep_signal=False).drop("signal")
        if name == "d1":
            raw[name] = metadata.first_manifest(spark, audio.index_by_path(files, name), f"{folder}/{WORKBOOK}")
        else:
            raw[name] = metadata.second_manifest(spark, audio.index_by_recording(files, name), folder)
        signals[name] = audio.read_audio(spark, folder).select(audio.F.col("path").alias("filepath"), "signal", "sr")
    return raw, signals


def main(arguments: Sequence[str] | None = None, config: TrainingConfig | None = None, grid: Sequence[tuple] | None = None) -> RunFolder:
    request = parse(arguments)
    spark = SparkSession.builder.appName("tessitura").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = os.environ.get("DATA_ROOT", ".")
    root = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
    raw, signals = manifests(spark, request, root)
    done = run(spark, request, raw, root, config, grid, signals)
    print(done["folder"].root)
    return done["folder"]


if __name__ == "__main__":
    main()
