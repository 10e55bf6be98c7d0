"""Band algebra and colour channels as column expressions over pixels with columns b1..b7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-4
# The band triples that colour channels are made of.
TRIPLES = [(4, 3, 2), (5, 4, 3), (6, 5, 2), (5, 6, 2), (7, 5, 3), (7, 5, 4), (6, 5, 4), (5, 7, 1)]


def nan_to(c: Column, default: float = 0.0) -> Column:
    """NaN and null as the NoData value."""
    return F.coalesce(F.nanvl(c, F.lit(default)), F.lit(default))


def ratio(a: Column, b: Column) -> Column:
    """a / b by IEEE 754, whatever spark.sql.ansi.enabled is: over zero an infinity of a's sign, NaN for 0 / 0."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def band_shifts(pixels: DataFrame, bands: range = range(1, 8)) -> dict[int, float]:
    """|min(smallest valid value, 0)| of each band: one row of seven numbers."""
    row = pixels.agg(*[F.min(F.when(F.col(f"b{i}") != 0, F.col(f"b{i}"))).alias(f"b{i}") for i in bands]).first()
    return {i: abs(min(row[f"b{i}"] or 0.0, 0.0)) for i in bands}


def indices(shift: dict[int, float]) -> dict[str, Column]:
    """The 17 variables: seven shifted bands and ten indices, 0 where the mask band is NoData."""
    b = {i: F.col(f"b{i}") + shift[i] + 1 for i in range(1, 8)}  # in this order: differences of two bands are then the same doubles as in SQL
    raw4, raw5, soil = F.col("b4"), F.col("b5"), 0.5
    out = {str(i): (b[i], i) for i in range(1, 8)}
    out |= {
        "ndvi": (ratio(b[5] - b[4], b[5] + b[4] + EPS), 4),
        "rvi": (ratio(b[5], b[4] + EPS), 4),
        "dvi": (b[5] - b[4], 4),
        "evi": (ratio(2.5 * (b[5] - b[4]), b[5] + 6 * b[4] - 7.5 * b[2] + 1 + EPS), 4),
        "vi01": (ratio(b[4] - b[3], b[5] + EPS), 4),
        "vi02": (ratio(b[5], b[3] + EPS), 3),
        "vi03": (ratio(b[7], b[4] + EPS), 4),
        "savi": (ratio(raw5 - raw4, raw5 + raw4 + soil) * (1 + soil), 4),
        "ndsi": (ratio(b[4] - b[5], b[4] + b[5] + EPS), 4),
        "si03": (ratio(b[3] * b[4], b[2] + EPS), 4),
    }
    return {k: F.when(F.col(f"b{mask}") == 0, 0.0).otherwise(e) for k, (e, mask) in out.items()}


def with_indices(pixels: DataFrame) -> DataFrame:
    """pixel and the 17 variables, named v_1..v_7, v_ndvi and so on."""
    return pixels.select("pixel", *[c.alias(f"v_{k}") for k, c in indices(band_shifts(pixels)).items()])


def stretched(pixels: DataFrame, triple: tuple[int, int, int]) -> DataFrame:
    """pixel, r, g, b in 0..255: min-max over valid pixels of the first channel; null where a channel is constant."""
    live = F.col(f"b{triple[0]}") != 0
    ends = pixels.agg(*[f(F.when(live, F.col(f"b{i}"))).alias(f"{n}{k}") for k, i in enumerate(triple) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def channel(k: int, i: int) -> Column:
        lo, hi = ends[f"lo{k}"] or 0.0, ends[f"hi{k}"] or 0.0
        return F.lit(None).cast("double") if hi == lo else 255 * (F.col(f"b{i}") - lo) / (hi - lo)

    return pixels.select("pixel", live.alias("live"), *[channel(k, i).alias(n) for (k, i), n in zip(enumerate(triple), "rgb", strict=True)])


def hsv(df: DataFrame) -> list[Column]:
    """Hue and saturation in 0..1, value as large as the channels are."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d) / 6
    return [F.when(h < 0, h + 1).otherwise(h), F.when(top == 0, 0.0).otherwise(d / top), top]


def _matrix(rows: list[tuple[float, float, float]], offset: tuple[float, float, float] = (0, 0, 0)) -> list[Column]:
    return [a * F.col("r") + b * F.col("g") + c * F.col("b") + o for (a, b, c), o in zip(rows, offset, strict=True)]


def ycbcr(df: DataFrame) -> list[Column]:
    """ITU-R BT.601 in studio range, for channels in 0..255."""
    return _matrix([(65.481 / 255, 128.553 / 255, 24.966 / 255), (-37.797 / 255, -74.203 / 255, 112.0 / 255), (112.0 / 255, -93.786 / 255, -18.214 / 255)], (16, 128, 128))


def yiq(df: DataFrame) -> list[Column]:
    return _matrix([(0.299, 0.587, 0.114), (0.595716, -0.274453, -0.321263), (0.211456, -0.522591, 0.311135)])


def yuv(df: DataFrame) -> list[Column]:
    return _matrix([(0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001)])


def xyz(df: DataFrame) -> list[Column]:
    """sRGB (0..255) to CIE XYZ, D65."""
    lin = []
    for n in "rgb":
        c = F.greatest(F.col(n) / 255, F.lit(0.0))
        lin.append(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    rows = [(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)]
    return [a * lin[0] + b * lin[1] + c * lin[2] for a, b, c in rows]


def lab(df: DataFrame) -> list[Column]:
    f = []
    for c, white in zip(xyz(df), (0.95047, 1.0, 1.08883), strict=True):
        t = c / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116))
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lch(df: DataFrame) -> list[Column]:
    light, a, b = lab(df)
    return [light, F.sqrt(a * a + b * b), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))]


SPACES = {"hsv": hsv, "ycbcr": ycbcr, "yiq": yiq, "yuv": yuv, "xyz": xyz, "lab": lab, "lch": lch}


def colour(pixels: DataFrame, triple: tuple[int, int, int], space: str, strict: bool = True) -> DataFrame:
    """pixel, c1, c2, c3. NoData (of the first channel's band) is put back in the first channel only, or in all with strict=False."""
    if space not in SPACES:
        raise ValueError(f"unknown colour space: {space}")
    df = stretched(pixels, triple)
    chans = SPACES[space](df)
    return df.select("pixel", *[(F.when(~F.col("live"), 0.0).otherwise(c) if k == 0 or not strict else c).alias(f"c{k + 1}") for k, c in enumerate(chans)])


def colour_features(pixels: DataFrame, spaces: tuple[str, ...] = ("hsv", "ycbcr")) -> DataFrame:
    """All triples in all spaces: 48 columns named like hsv_432_1, in one pass over the pixels."""
    live = {i: F.col(f"b{i}") != 0 for i in range(1, 8)}
    ends = pixels.agg(*[f(F.when(live[t[0]], F.col(f"b{i}"))).alias(f"{n}_{t[0]}_{i}") for t0, i in sorted({(t[0], i) for t in TRIPLES for i in t}) for t in [(t0,)] for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = pixels
    for t in TRIPLES:
        tag = "".join(map(str, t))
        chans = []
        for i in t:
            lo, hi = ends[f"lo_{t[0]}_{i}"] or 0.0, ends[f"hi_{t[0]}_{i}"] or 0.0
            chans.append(F.lit(None).cast("double") if lo == hi else 255 * (F.col(f"b{i}") - lo) / (hi - lo))
        out = out.withColumns(dict(zip("rgb", chans, strict=True)))
        out = out.withColumns({f"{s}_{tag}_{k + 1}": F.when(~live[t[0]], 0.0).otherwise(c) if k == 0 else c for s in spaces for k, c in enumerate(SPACES[s](out))})
    return out.drop("r", "g", "b", *[f"b{i}" for i in range(1, 8)])


def band_statistics(pixels: DataFrame) -> DataFrame:
    """band, min, max, mean, std over valid cells: what a statistics side-car holds."""
    long = pixels.select(F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("v")) for i in range(1, 8)])).alias("x")).select("x.*").where("v <> 0")
    return long.groupBy("band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
