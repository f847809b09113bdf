"""Vectors, probabilities and geometry on array columns. Sums run in double, in array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at length one; a zero vector stays as it is."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def backoff(attempt: Column, base: float = 2.0, most: float = 10.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def level(score: Column, high: float, medium: float, names=("high", "medium", "low")) -> Column:
    return F.when(score >= high, names[0]).when(score >= medium, names[1]).otherwise(names[2])


def lookup(key: Column, table: dict, default) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def order_corners(points: Column) -> Column:
    """Four (x, y) points as top left, top right, bottom right, bottom left."""
    pick = lambda key, largest: (F.array_max if largest else F.array_min)(
        F.transform(points, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))
    )
    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    corners = [pick(total, False), pick(slope, False), pick(total, True), pick(slope, True)]
    return F.array(*[F.struct(c["x"].alias("x"), c["y"].alias("y")) for c in corners])


def expand_quad(corners: Column, width: Column, height: Column, margin: float) -> Column:
    """Corners moved away from their centre by a share of the distance and clipped to the image."""
    mean = lambda f: F.aggregate(corners, F.lit(0.0), lambda s, p: s + p[f]) / 4
    cx, cy = mean("x"), mean("y")
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top - 1.0)
    return F.transform(
        corners,
        lambda p: F.struct(
            clip(p["x"] + (p["x"] - cx) * margin, width).alias("x"), clip(p["y"] + (p["y"] - cy) * margin, height).alias("y")
        ),
    )


def target_size(corners: Column) -> Column:
    """(width, height) of the upright page: the longer of each pair of opposite edges, rounded down."""
    p = [F.get(corners, F.lit(i)) for i in range(4)]
    edge = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    return F.struct(
        F.greatest(edge(p[2], p[3]), edge(p[1], p[0])).cast("int").alias("width"),
        F.greatest(edge(p[1], p[2]), edge(p[0], p[3])).cast("int").alias("height"),
    )


def scaled_size(width: Column, height: Column, most: int) -> Column:
    """(width, height) scaled down, never up, so that neither is above most."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct((width * ratio).cast("int").alias("width"), (height * ratio).cast("int").alias("height"))


def safe_quad(area: Column, image_area: Column, corners: Column, least: float = 0.1, longest_side: float = 5.0) -> Column:
    """A detected page is used if it is large enough, not too narrow, and its top is above its bottom."""
    size = target_size(corners)
    upright = F.get(corners, F.lit(0))["y"] <= F.get(corners, F.lit(3))["y"]
    narrow = F.greatest(size["width"], size["height"]) > longest_side * F.greatest(F.least(size["width"], size["height"]), F.lit(1))
    return (area >= image_area * least) & upright & ~narrow
