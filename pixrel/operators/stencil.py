"""Pixel features by windows over rows and columns of an image; a pass along each axis, so two shuffles a stencil."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pixrel.functions import color


def by_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def by_col() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def sobel(p: DataFrame, value: str = "gray") -> DataFrame:
    """Adds gx and gy: 3x3 Sobel sums; beyond the border the picture is mirrored at its outer pixels."""
    before = lambda c, w: F.coalesce(F.lag(c).over(w), F.lead(c).over(w), F.col(c))
    after = lambda c, w: F.coalesce(F.lead(c).over(w), F.lag(c).over(w), F.col(c))
    p = p.withColumns({"__d": after(value, by_row()) - before(value, by_row()), "__s": before(value, by_row()) + 2 * F.col(value) + after(value, by_row())})
    p = p.withColumns({"gx": before("__d", by_col()) + 2 * F.col("__d") + after("__d", by_col()), "gy": after("__s", by_col()) - before("__s", by_col())})
    return p.drop("__d", "__s")


def box5(value: Column, name: str, w: object) -> Column:
    """Sum of five neighbours in line; beyond the border the picture is mirrored with its outer pixels repeated."""
    lag, lead = (lambda k: F.lag(name, k).over(w)), (lambda k: F.lead(name, k).over(w))
    left1, right1 = F.coalesce(lag(1), value), F.coalesce(lead(1), value)
    left2, right2 = F.coalesce(lag(2), lag(1), lead(1), value), F.coalesce(lead(2), lead(1), lag(1), value)
    return left2 + left1 + value + right1 + right2


def box_sums(p: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds the 5x5 box sum of each expression, all in the same two passes."""
    p = p.withColumns({f"__{n}": c for n, c in sums.items()})
    p = p.withColumns({f"__r_{n}": box5(F.col(f"__{n}"), f"__{n}", by_row()) for n in sums})
    p = p.withColumns({n: box5(F.col(f"__r_{n}"), f"__r_{n}", by_col()) for n in sums})
    return p.drop(*(f"__{n}" for n in sums), *(f"__r_{n}" for n in sums))


def local_variance(p: DataFrame) -> DataFrame:
    """Adds local_variance of brightness 0..1 in a 5x5 box, from exact integer sums."""
    p = box_sums(p, {"__b1": F.col("gray"), "__b2": F.col("gray") * F.col("gray")})
    v = (25 * F.col("__b2") - F.col("__b1") * F.col("__b1")) / (625.0 * 255.0 * 255.0)
    return p.withColumn("local_variance", F.greatest(v, F.lit(0.0))).drop("__b1", "__b2")


def local_entropy(p: DataFrame) -> DataFrame:
    """Adds local_entropy: of 16 brightness levels in a 5x5 box, in quarters of a bit so that 16 equal levels give 1."""
    p = p.withColumn("__level", F.expr("gray * 15 div 255"))
    p = box_sums(p, {f"__n{k}": (F.col("__level") == k).cast("int") for k in range(16)})
    h = sum((F.when(F.col(f"__n{k}") > 0, F.col(f"__n{k}") / 25.0 * F.log2(F.col(f"__n{k}") / 25.0)).otherwise(0.0) for k in range(16)), F.lit(0.0))
    return p.withColumn("local_entropy", -h / 4.0).drop("__level", *(f"__n{k}" for k in range(16)))


def robust(p: DataFrame, fields: list[str], epsilon: float = 1e-6) -> DataFrame:
    """Adds robust_<field>: distance to the image's median in scaled median deviations, clipped to 3 and divided by 3."""
    med = p.groupBy("image_id").agg(*(F.median(c).alias(f"__m_{c}") for c in fields))
    p = p.join(med, "image_id")
    mad = p.groupBy("image_id").agg(*(F.median(F.abs(F.col(c) - F.col(f"__m_{c}"))).alias(f"__d_{c}") for c in fields))
    p = p.join(mad, "image_id")
    scaled = lambda c: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(c) - F.col(f"__m_{c}")) / F.greatest(1.4826 * F.col(f"__d_{c}"), F.lit(epsilon)))) / 3.0
    return p.withColumns({f"robust_{c}": scaled(c) for c in fields}).drop(*(f"__m_{c}" for c in fields), *(f"__d_{c}" for c in fields))


def unit(p: DataFrame, fields: dict[str, str], epsilon: float = 1e-9) -> DataFrame:
    """Adds fields (new name to old): the range of an image stretched to 0..1, 0 where there is no range."""
    ends = p.groupBy("image_id").agg(*(f(c).alias(f"__{n}_{c}") for c in fields.values() for n, f in (("lo", F.min), ("hi", F.max))))
    p = p.join(ends, "image_id")
    span = lambda c: F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
    out = {n: F.when(span(c) <= epsilon, 0.0).otherwise((F.col(c) - F.col(f"__lo_{c}")) / span(c)) for n, c in fields.items()}
    return p.withColumns(out).drop(*(f"__{n}_{c}" for c in fields.values() for n in ("lo", "hi")))


def base_fields(p: DataFrame) -> DataFrame:
    """Adds gray and CIELAB."""
    light, a, b = color.lab(F.col("r"), F.col("g"), F.col("b"))
    return p.withColumns({"gray": color.gray(F.col("r"), F.col("g"), F.col("b")), "lab_l": light, "lab_a": a, "lab_b": b})


def edges(p: DataFrame, percentile: float = 0.99) -> DataFrame:
    """Adds gx, gy, magnitude (brightness 0..1) and edge_strength: magnitude over the image's percentile, at most 1."""
    p = sobel(p)
    p = p.withColumn("magnitude", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")) / 255.0)
    top = p.groupBy("image_id").agg(F.greatest(F.percentile("magnitude", percentile), F.lit(1e-6)).alias("__top"))
    return p.join(top, "image_id").withColumn("edge_strength", F.least(F.col("magnitude") / F.col("__top"), F.lit(1.0))).drop("__top")


def features(p: DataFrame, weights: dict[str, float], size: tuple[int, int] | None = None) -> DataFrame:
    """The dense feature columns of each pixel, and the fields that regions are measured by.

    size: width and height of the images, where rows may be missing; else an image ends at its last pixels.
    """
    last = [F.lit(n - 1) if size else F.max(c).over(Window.partitionBy("image_id")) for c, n in zip("xy", size or (0, 0), strict=True)]
    p = local_entropy(local_variance(edges(base_fields(p))))
    p = robust(p, ["gx", "gy", "magnitude", "local_variance"])
    p = unit(p, {"__ug": "robust_magnitude", "__uv": "robust_local_variance"})
    mixed = weights["gradient"] * F.col("__ug") + weights["variance"] * F.col("__uv") + weights["edge"] * F.col("edge_strength") + weights["texture"] * F.col("local_entropy")
    h, s, _ = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    return p.withColumns({
        "complexity": F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)), "hue": h / 179.0, "saturation": s / 255.0, "gradient_orientation": F.atan2("gy", "gx") / F.lit(3.141592653589793),
        "x_normalized": F.col("x") / F.greatest(last[0], F.lit(1)), "y_normalized": F.col("y") / F.greatest(last[1], F.lit(1)),
    }).drop("__ug", "__uv")
