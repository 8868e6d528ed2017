"""Styles of text regions read from their image's pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import raster


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of Spark's image source (blue, green, red) as red, green, blue."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, 2::-1]


def region_styles(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, image_id, id, background_kind, color, size) for regions, from images (doc_id, image_id, image) of Spark's image source.

    An image's regions travel with it, so its pixels are decoded once.
    """
    r = regions.groupBy("doc_id", "image_id").agg(F.collect_list(F.struct("id", "bbox")).alias("regions"))
    j = images.select("doc_id", "image_id", "image.data", "image.height", "image.width", "image.nChannels").join(r, ["doc_id", "image_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples():
                img = pixels(x.data, x.height, x.width, x.nChannels)
                for reg in x.regions:
                    box = dict(reg["bbox"]) if isinstance(reg["bbox"], dict) else reg["bbox"].asDict()
                    out.append((x.doc_id, x.image_id, reg["id"], raster.background_kind(img, box), raster.text_colour(img, box), raster.font_size(box["h"])))
            yield pd.DataFrame(out, columns=["doc_id", "image_id", "id", "background_kind", "color", "size"])

    return j.mapInPandas(run, "doc_id string, image_id string, id string, background_kind string, color string, size double")


def erased_images(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, image_id, height, width, data): red, green and blue bytes of each image with its regions' erase boxes filled by the colour around them."""
    r = regions.groupBy("doc_id", "image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "erase_boxes"))), lambda x: x["erase_boxes"])).alias("boxes"))
    j = images.select("doc_id", "image_id", "image.data", "image.height", "image.width", "image.nChannels").join(r, ["doc_id", "image_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples():
                boxes = [v if isinstance(v, dict) else v.asDict() for v in (x.boxes if x.boxes is not None else [])]
                out.append((x.doc_id, x.image_id, x.height, x.width, raster.erased(pixels(x.data, x.height, x.width, x.nChannels), boxes).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "image_id", "height", "width", "data"])

    return j.mapInPandas(run, "doc_id string, image_id string, height int, width int, data binary")


def fitted_sizes(regions: DataFrame, largest: int = 72) -> DataFrame:
    """(doc_id, image_id, id, size, fits): the size at which a region's target, or else its source, fits its box."""
    from lexloom.functions.fonts import fits, fitted_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = [fitted_size(t or "", int(w), int(h), largest) if w > 0 and h > 0 else 0 for t, w, h in zip(b.text, b.w, b.h, strict=True)]
            ok = [s > 0 and fits(t or "", int(w), int(h), s) for t, w, h, s in zip(b.text, b.w, b.h, size, strict=True)]
            yield b[["doc_id", "image_id", "id"]].assign(size=size, fits=ok)

    r = regions.select("doc_id", "image_id", "id", F.coalesce("target_text", "source_text").alias("text"), F.coalesce("bbox.w", F.lit(0)).alias("w"), F.coalesce("bbox.h", F.lit(0)).alias("h"))
    return r.mapInPandas(run, "doc_id string, image_id string, id string, size int, fits boolean")
