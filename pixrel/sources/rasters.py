"""Rasters as relations: one row a pixel (image_id, y, x, r, g, b), from tables, generators and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an image made from the embeddings table.
ROWS = 50


def from_embeddings(embeddings: DataFrame, rows: int = ROWS) -> DataFrame:
    """A vector is a line of an image: rows vectors by id make one image, its elements the columns."""
    e = embeddings.select(F.expr(f"vec_id div {rows}").alias("image_id"), (F.col("vec_id") % rows).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    g = F.floor((F.col("v").cast("double") + 1.0) * 127.5).cast("int")
    return e.withColumn("v0", F.least(F.greatest(g, F.lit(0)), F.lit(255))).select("image_id", "y", "x", F.col("v0").alias("r"), ((F.col("v0") * 3 + F.col("x")) % 256).alias("g"), ((F.col("v0") * 7 + F.col("y")) % 256).alias("b"))


def from_events(events: DataFrame) -> DataFrame:
    """Hours by days of the month; channels count clicks, views and purchases, empty cells are 0."""
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    cells = events.groupBy(F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y")).agg(count("click").alias("r"), count("view").alias("g"), count("purchase").alias("b"))
    grid = events.sparkSession.range(31 * 24).select((F.col("id") % 24).cast("int").alias("x"), F.expr("cast(id div 24 as int)").alias("y"))
    return grid.join(F.broadcast(cells), ["x", "y"], "left").select(F.lit(0).cast("long").alias("image_id"), "y", "x", *(F.least(F.coalesce(c, F.lit(0)), F.lit(255)).cast("int").alias(c) for c in "rgb"))  # 744 cells at most


def from_lineitem(lineitem: DataFrame, width: int = 256, height: int = 192) -> DataFrame:
    """A full grid; a cell sums the quantities of the items whose part and order fall on it."""
    cells = lineitem.groupBy((F.col("l_partkey") % width).cast("int").alias("x"), (F.col("l_orderkey") % height).cast("int").alias("y")).agg((F.sum(F.col("l_quantity").cast("int")) % 256).cast("int").alias("v"))
    grid = lineitem.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"))
    full = grid.join(cells, ["x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    return full.select(F.lit(0).cast("long").alias("image_id"), "y", "x", F.col("v").alias("r"), ((F.col("v") * 3 + F.col("x")) % 256).alias("g"), ((F.col("v") * 7 + F.col("y")) % 256).alias("b"))


def generated(spark: SparkSession, width: int, height: int, colour: Column, image_id: int = 0) -> DataFrame:
    """A raster from an array(r, g, b) expression over x and y."""
    grid = spark.range(width * height).select(F.lit(image_id).cast("long").alias("image_id"), F.expr(f"cast(id div {width} as int)").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return grid.withColumn("c", colour).select("image_id", "y", "x", *(F.col("c")[i].cast("int").alias(n) for i, n in enumerate("rgb")))


def rgb(r: int | Column, g: int | Column, b: int | Column) -> Column:
    return F.array(*(c if isinstance(c, Column) else F.lit(c) for c in (r, g, b)))


def bands(width: int = 64, perturbed: bool = False) -> Column:
    """Three vertical bands, and with perturbed a small pattern on each channel."""
    x, y = F.col("x"), F.col("y")
    third = width // 3
    base = F.when(x < third, rgb(210, 50, 40)).when(x < width - third, rgb(40, 180, 70)).otherwise(rgb(50, 80, 210))
    return F.zip_with(base, rgb(y % 4, x % 3, (x + y) % 2), lambda a, b: a + b) if perturbed else base


def fixtures(spark: SparkSession, width: int = 128, height: int = 96) -> DataFrame:
    """Made images by number: shapes, gradients, flat illustration, logo, pixel art, texture, bands."""
    x, y = F.col("x"), F.col("y")
    disc = lambda cx, cy, r: (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r
    images = [
        F.when((x >= 12) & (x < 48) & (y >= 14) & (y < 50), rgb(220, 60, 50)).when(disc(88, 36, 20), rgb(50, 110, 220)).when((y >= 60) & (x + y > 120) & (x - y < 10), rgb(60, 170, 90)).otherwise(rgb(240, 240, 235)),
        rgb(F.expr(f"cast(x * 255 div {width - 1} as int)"), F.expr(f"cast(y * 255 div {height - 1} as int)"), F.expr(f"cast((x + y) * 255 div {width + height - 2} as int)")),
        F.when(disc(100, 20, 12), rgb(250, 220, 80)).when(y < 40, rgb(120, 190, 240)).when(y < 66, rgb(90, 160, 80)).otherwise(rgb(140, 100, 60)),
        F.when(disc(64, 48, 30) & ~disc(64, 48, 18), rgb(20, 40, 120)).when(disc(64, 48, 10), rgb(230, 90, 30)).otherwise(rgb(255, 255, 255)),
        rgb(F.expr("cast((x div 8 * 37 + y div 8 * 11) % 256 as int)"), F.expr("cast((x div 8 * 17 + y div 8 * 53) % 256 as int)"), F.expr("cast((x div 8 * 71 + y div 8 * 29) % 256 as int)")),
        rgb(*(F.pmod(F.xxhash64(x, y, F.lit(k)), F.lit(256)).cast("int") for k in range(3))),
        bands(width, perturbed=True),
    ]
    out = generated(spark, width, height, images[0], 0)
    for i, c in enumerate(images[1:], 1):
        out = out.unionByName(generated(spark, width, height, c, i))
    return out


def from_files(spark: SparkSession, path: str, max_pixels: int) -> DataFrame:
    """PNG and JPEG files as (path, y, x, r, g, b), alpha over black; undecodable and oversized files are left out.

    The built-in image source decodes on the executors; a file's bytes become rows there too.
    """
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").filter(F.col("width").cast("long") * F.col("height") <= max_pixels)
    at = F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)
    p = i.select("origin", "width", "nChannels", "data", F.explode(at).alias("k"))
    byte = lambda c: F.conv(F.hex(F.substring("data", F.col("k") * F.col("nChannels") + c + 1, F.lit(1))), 16, 10).cast("int")
    alpha = F.when(F.col("nChannels") == 4, byte(3)).otherwise(255)
    channel = lambda c: F.when(F.col("nChannels") == 1, byte(0)).otherwise(F.rint(byte(c) * alpha / 255.0).cast("int"))
    return p.select(F.col("origin").alias("path"), F.expr("cast(k div width as int)").alias("y"), (F.col("k") % F.col("width")).alias("x"), channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def preflight(uploads: DataFrame, max_bytes: int) -> DataFrame:
    """uploads (name, mime, body as base64) gain ext, bytes, canonical, signature_ok and accepted."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    u = uploads.withColumn("ext", F.when(ext == "jpg", "jpeg").otherwise(ext))
    u = u.withColumn("canonical", (F.length("body") % 4 == 0) & F.col("body").rlike(r"^[A-Za-z0-9+/]+={0,2}$"))
    u = u.withColumn("raw", F.when(F.col("canonical"), F.unbase64("body"))).withColumn("canonical", F.coalesce(F.regexp_replace(F.base64("raw"), r"\s", "") == F.col("body"), F.lit(False)))
    head = F.hex(F.substring("raw", 1, 12))
    kind = F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    u = u.withColumn("bytes", F.coalesce(F.octet_length("raw"), F.lit(0))).withColumn("signature_ok", F.coalesce((kind == F.col("ext")) & (F.concat(F.lit("image/"), kind) == F.col("mime")), F.lit(False)))
    accepted = F.col("canonical") & F.col("signature_ok") & F.col("ext").isin("png", "jpeg", "webp") & (F.col("bytes") <= max_bytes)
    return u.select("name", "mime", "ext", "bytes", "canonical", "signature_ok", accepted.alias("accepted"))


def downscale(pixels: DataFrame, factor: int, width: int, height: int) -> DataFrame:
    """Area average onto max(2, size div factor) cells a side; where that does not divide, by overlap, in exact integers."""
    w, h = max(2, width // factor), max(2, height // factor)

    def covers(axis: str, size: int, cells: int) -> Column:
        """Cells that the pixel reaches, with the overlap in units of 1 / (size * cells)."""
        a, b = F.col(axis) * cells, (F.col(axis) + 1) * cells
        first = F.floor(a / size).cast("int")
        last = F.floor((b - 1) / size).cast("int")
        return F.transform(F.sequence(first, last), lambda c: F.struct(c.alias("c"), (F.least(b, (c + 1) * size) - F.greatest(a, c * size)).alias("n")))

    p = pixels.withColumn("cx", F.explode(covers("x", width, w))).withColumn("cy", F.explode(covers("y", height, h)))
    share = (F.col("cx.n") * F.col("cy.n")).cast("long")
    mean = lambda c: F.floor((2 * F.sum(F.col(c) * share) + F.lit(width * height)) / (2.0 * width * height)).cast("int").alias(c)
    return p.groupBy("image_id", F.col("cy.c").alias("y"), F.col("cx.c").alias("x")).agg(*(mean(c) for c in "rgb"))
