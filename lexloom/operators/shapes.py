"""Shapes on a slide: how wide a text may be beside pictures and inside filled shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _box(p: str):
    return tuple(F.col(f"{p}.{k}") for k in ("x", "y")) + (F.col(f"{p}.x") + F.col(f"{p}.w"), F.col(f"{p}.y") + F.col(f"{p}.h"))


def visible_width(texts: DataFrame, pictures: DataFrame) -> DataFrame:
    """(doc_id, id, width): the width of a text before a later picture covers its right side.

    texts, pictures: (doc_id, slide, z, id, box). Pictures that overlap a quarter of the smaller height count; less than a quarter of the width
    left counts as nothing covered. A join on the slide, reduced to the leftmost edge per text.
    """
    p = pictures.select("doc_id", "slide", F.col("z").alias("pz"), F.col("box").alias("p"))
    j = texts.join(p, ["doc_id", "slide"], "left")
    l, t, r, b = _box("box")
    pl, pt, _, pb = _box("p")
    overlap = F.greatest(F.lit(0), F.least(b, pb) - F.greatest(t, pt))
    covers = (F.col("pz") > F.col("z")) & (overlap >= F.least(F.col("box.h"), F.col("p.h")) * 0.25) & (pl > l) & (pl < r)
    m = j.groupBy("doc_id", "id").agg(F.min(F.when(covers, pl)).alias("edge"), F.first("box").alias("box"))
    seen = F.coalesce(F.col("edge"), F.col("box.x") + F.col("box.w")) - F.col("box.x")
    return m.select("doc_id", "id", F.when(seen >= F.col("box.w") * 0.25, seen).otherwise(F.col("box.w")).alias("width"))


def container_width(texts: DataFrame, fills: DataFrame) -> DataFrame:
    """(doc_id, id, width): the inner width of the nearest earlier filled shape that holds a text's left, top and bottom and cuts its right side."""
    f = fills.select("doc_id", "slide", F.col("z").alias("fz"), F.col("box").alias("f"))
    j = texts.join(f, ["doc_id", "slide"], "left")
    l, t, r, b = _box("box")
    fl, ft, fr, fb = _box("f")
    inner = fr - (l - fl) - l
    holds = (F.col("fz") < F.col("z")) & (fl <= l) & (ft <= t) & (fb >= b) & (fr > l) & (fr < r) & (inner >= F.col("box.w") * 0.25)
    m = j.groupBy("doc_id", "id").agg(F.max_by(F.when(holds, inner), F.when(holds, F.col("fz"))).alias("inner"), F.first("box").alias("box"))
    return m.select("doc_id", "id", F.coalesce("inner", F.col("box.w")).alias("width"))
