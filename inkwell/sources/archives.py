"""Sinks: base64 images and ZIP archives of them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = "_translated"


def encoded(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def listed(jobs: DataFrame) -> DataFrame:
    """Images of a JSON list (job, images): (job, i, name, data); images without a name are numbered from 1."""
    rows = jobs.select("job", F.posexplode(F.from_json("images", "array<struct<name:string,data:string>>")).alias("i", "v"))
    name = F.coalesce("v.name", F.concat(F.lit("image_"), (F.col("i") + 1).cast("string")))
    return rows.select("job", "i", name.alias("name"), F.unbase64("v.data").alias("data"))


def zipped(images: DataFrame, extension: str = "jpg", folder: str = "") -> DataFrame:
    """One archive a job, its images in order: (job, archive). A job is one upload, so it fits a task."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for name, data in frame.sort_values("i")[["name", "data"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(f"{folder}{name}{SUFFIX}.{extension}", (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"job": [frame["job"].iloc[0]], "archive": [out.getvalue()]})

    return images.groupBy("job").applyInPandas(pack, "job long, archive binary")


def decoded(text: Column) -> Column:
    """The bytes of one base64 image, as a single download takes them."""
    return F.unbase64(text)


def contents(archives: DataFrame) -> DataFrame:
    """What is in archives (job, archive): (job, i, name, data) in their order. Frames hold few archives at a time."""

    def unpack(frames):
        for frame in frames:
            for job, archive in zip(frame["job"], frame["archive"]):
                with zipfile.ZipFile(io.BytesIO(archive)) as z:
                    names = z.namelist()
                    yield pd.DataFrame({"job": job, "i": range(len(names)), "name": names, "data": [z.read(n) for n in names]})

    return archives.mapInPandas(unpack, "job long, i int, name string, data binary")
