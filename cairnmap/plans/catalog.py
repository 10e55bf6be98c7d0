"""Registered queries of the library, keyed by the operators they show, and the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.functions import arrays, bands
from cairnmap.operators import boosting, focal, glcm, lookup, mapping, metrics, sampling, selection, votes
from cairnmap.sources import geotiff, tables
from cairnmap.sources.scratch import scratch

from . import views
from .views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Focal statistics

_FOCAL = """
with a as (select row, col, v, sum(case when v <> 0 then 1.0::double else 0 end) over w as n, sum(v) over w as s1, sum(v*v) over w as s2, sum(v*v*v) over w as s3, sum(v*v*v*v) over w as s4
  from v_raster window w as (partition by row order by col range between 3 preceding and 3 following)),
b as (select row, col, v, sum(n) over w as n, sum(s1) over w as s1, sum(s2) over w as s2, sum(s3) over w as s3, sum(s4) over w as s4
  from a window w as (partition by col order by row range between 3 preceding and 3 following)),
m as (select row, col, v, s1/n as m, s2/n as m2, s3/n as m3, s4/n as m4 from b),
st as (select *, sqrt(greatest(m2 - m*m, 0) + 1e-4::double) as std from m),
f as (select row, col, case when v = 0 then 0 else std end as std, case when v = 0 then 0 else std/(m + 1e-4::double) end as cv,
  case when v = 0 then 0 else (m3 - 3*m*m2 + 2*m*m*m)/(std*std*std) end as skew, case when v = 0 then 0 else (m4 - 4*m*m3 + 6*m*m*m2 - 3*m*m*m*m)/(std*std*std*std) end as kurt from st)
"""


@query("W1_W2_W3_W4_W5_focal_stats", sql(_FOCAL + "select row, col, round(std, 6) as std, round(cv, 6) as cv, round(skew, 6) as skew, round(kurt, 6) as kurt from f", "v_raster"))
def focal_stats(spark, d):
    return rounded(focal.focal_stats(views.raster(spark, d)))


@query("W1_C11_focal_resampled", sql(_FOCAL + """, n as (select max(row) + 1 as nr, max(col) + 1 as nc from v_raster),
t as (select (i - 1) as row, ceil((i - 0.5) * nr / floor(nr / 10.0 + 0.5))::bigint - 1 as src from n, range(1, 100000) x(i) where i <= floor(nr / 10.0 + 0.5)),
u as (select (i - 1)::integer as col, ceil((i - 0.5) * nc / floor(nc / 10.0 + 0.5))::bigint - 1 as src from n, range(1, 1000) x(i) where i <= floor(nc / 10.0 + 0.5))
select t.row, u.col, round(std, 6) as std, round(cv, 6) as cv from t join u on true join f on f.row = t.src and f.col = u.src""", "v_raster"))
def focal_resampled(spark, d):
    return entry(spark, d)


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Raster, 7 x 7 statistics, resampled to a tenth."""
    return rounded(focal.resample(focal.focal_stats(views.raster(spark, d)).select("row", "col", "std", "cv"), 10))


_KERNEL = ", ".join(f"({dy}, {dx}, {w!r})" for (dy, dx), w in focal.disk_kernel(5).items())
_GAUSS = ", ".join(f"({k}, {w!r})" for k, w in focal.gaussian_kernel(25, 3.5).items())


@query("W10_W13_disk_filter", sql(f"with k(dy, dx, w) as (values {_KERNEL}) select a.row, a.col, round(sum(b.v * w), 6) as v from v_raster a join k on true join v_raster b on b.row = a.row + dy and b.col = a.col + dx group by a.row, a.col", "v_raster"))
def disk(spark, d):
    return rounded(focal.disk_filter(views.raster(spark, d), 5))


@query("W8_gaussian_filter", sql(f"""with k(o, w) as (values {_GAUSS}), a as (select x.row, x.col, sum(b.v * w) as v from v_raster x join k on true join v_raster b on b.row = x.row and b.col = x.col + o group by x.row, x.col)
select p.row, p.col, round(sum(a.v * w), 6) as v from v_raster p join k on true join a on a.row = p.row + o and a.col = p.col group by p.row, p.col""", "v_raster"))
def gauss(spark, d):
    return rounded(focal.gaussian_filter(views.raster(spark, d)))


@query("W7_median_filter", sql("""with o as (select i - 2 as dy, j - 2 as dx from range(0, 5) a(i), range(0, 5) b(j))
select p.row, p.col, round(median(coalesce(b.v, 0)), 6) as v from v_raster p join o on true left join v_raster b on b.row = p.row + dy and b.col = p.col + dx group by p.row, p.col""", "v_raster"))
def median(spark, d):
    return rounded(focal.median_filter(views.raster(spark, d), 5))


def _step(name: str, source: str, kind: str, size: float) -> str:
    """One filter of a chain in SQL, as common table expressions; absent cells read as 0."""
    if kind == "median":
        r = (int(size) - 1) // 2
        return f"""{name} as materialized (select p.row, p.col, median(coalesce(b.v, 0)) as v from {source} p, range({-r}, {r + 1}) y(dy), range({-r}, {r + 1}) x(dx)
  left join {source} b on b.row = p.row + dy and b.col = p.col + dx group by p.row, p.col)"""
    if kind == "disk":
        cells = ", ".join(f"({dy}, {dx}, {w!r})" for (dy, dx), w in focal.disk_kernel(int(size)).items())
        return f"{name} as materialized (select a.row, a.col, sum(b.v * w) as v from {source} a join (values {cells}) k(dy, dx, w) on true join {source} b on b.row = a.row + dy and b.col = a.col + dx group by a.row, a.col)"
    taps = ", ".join(f"({k}, {w!r})" for k, w in focal.gaussian_kernel(25, size).items())
    return f"""{name}x as materialized (select x.row, x.col, sum(b.v * w) as v from {source} x join (values {taps}) k(o, w) on true join {source} b on b.row = x.row and b.col = x.col + o group by x.row, x.col),
{name} as materialized (select x.row, x.col, sum(b.v * w) as v from {name}x x join (values {taps}) k(o, w) on true join {name}x b on b.row = x.row + o and b.col = x.col group by x.row, x.col)"""


_LONG = ", ".join([_step("s1", "v_raster", "median", 11), _step("s2", "s1", "gauss", 3.5), _step("s3", "s2", "median", 5), _step("s4", "s3", "disk", 5)])
_SHORT = ", ".join([_step("s1", "v_raster", "median", 15), _step("s2", "s1", "disk", 5)])


@query("W11_smooth_long", sql(f"with {_LONG} select row, col, round(v, 6) as v from s4", "v_raster"))
def smooth_long(spark, d):
    return rounded(focal.smooth_long(views.raster(spark, d)))


@query("W12_smooth_short", sql(f"with {_SHORT} select row, col, round(v, 6) as v from s2", "v_raster"))
def smooth_short(spark, d):
    return rounded(focal.smooth_short(views.raster(spark, d)))


@query("C11_resample", sql("""with n as (select max(row) + 1 as nr, max(col) + 1 as nc from v_raster),
t as (select (i - 1) as row, ceil((i - 0.5) * nr / floor(nr / 4.0 + 0.5))::bigint - 1 as src from n, range(1, 100000) x(i) where i <= floor(nr / 4.0 + 0.5)),
u as (select (i - 1)::integer as col, ceil((i - 0.5) * nc / floor(nc / 4.0 + 0.5))::bigint - 1 as src from n, range(1, 1000) x(i) where i <= floor(nc / 4.0 + 0.5))
select t.row, u.col, v from t join u on true join v_raster f on f.row = t.src and f.col = u.src""", "v_raster"))
def resample(spark, d):
    return focal.resample(views.raster(spark, d), 4)


@query("L23_P7_distance", sql("""with s as (select row, col from v_raster where v > 0.35)
select r.row, r.col, round(0.2::double * min(sqrt((r.row - s.row) * (r.row - s.row) + (r.col - s.col) * (r.col - s.col))), 6) as dist from v_raster r join s on true group by r.row, r.col""", "v_raster"))
def distance(spark, d):
    r = views.raster(spark, d)
    return rounded(focal.nearest_distance(r.withColumn("v", (F.col("v") > 0.35).cast("double")), 0.2))


@query("P7_water_masks", sql("select row, col, (v > 0)::integer as fresh, (not v > 0)::integer as sea from v_raster", "v_raster"))
def masks(spark, d):
    return focal.water_masks(views.raster(spark, d))


@query("P10_live_tiles", sql("select row // 16 as ty, (col // 16)::bigint as tx from v_raster group by all having max(abs(v)) > 0", "v_raster"))
def live_tiles(spark, d):
    return focal.skip_empty_tiles(views.raster(spark, d), 16)


@query("P6_nodata_mask", sql("select row, col, v <> (select v from v_raster where row = 0 and col = 0) as live from v_raster", "v_raster"))
def nodata(spark, d):
    return lookup.nodata_mask(views.raster(spark, d))


# Textures

THRESHOLDS = [round(-0.3 + 0.02 * k, 2) for k in range(31)]
_LEVEL = "(" + " + ".join(f"(v > {t!r}::double)::integer" for t in THRESHOLDS) + ")"
_DIRS = "(0, 0, 1), (1, -1, 1), (2, 1, 0), (3, 1, 1)"
#: Windows in sliding form: each pair of neighbours is counted for the 9 x 9 windows around it; matrices are symmetric, so half of each is kept.
_PAIRS = f"""
with small as materialized (select row, col, v from v_raster),
box as (select i as row, j as col from (select max(row) as nr, max(col) as nc from small), range(-4, 100000) a(i), range(-4, 1000) b(j) where i <= nr + 4 and j <= nc + 4),
q as materialized (select box.row, box.col, {_LEVEL} as q from (select box.row, box.col, coalesce(v, 0) as v from box left join small using (row, col)) box),
dirs(d, dy, dx) as (values {_DIRS}),
pr as materialized (select d, dy, dx, a.row, a.col, a.q as i, b.q as j from dirs join q a on true join q b on b.row = a.row + dy and b.col = a.col + dx),
ctr as (select row + oy as y, col + ox as x, row, col, oy, ox from small, range(-4, 5) a(oy), range(-4, 5) b(ox) where v <> 0),
w as (select d, ctr.row, ctr.col, i, j, 1 / (2.0::double * (9 - abs(dy)) * (9 - abs(dx))) as p from ctr join pr on pr.row = y and pr.col = x where oy + dy between -4 and 4 and ox + dx between -4 and 4),
e as (select row, col, d, least(i, j) as i, greatest(i, j) as j, sum(p) as p from w group by all),
p as materialized (select row, col, d, i, j, case when i = j then 2 * p else p end as p, case when i = j then 1 else 2 end as n from e)"""
_TEXTURE = _PAIRS + """,
k as (select row, col, sum(k * p) as sum_average, -sum(p * ln(p + 1e-8::double)) as sum_entropy from (select d, row, col, i + j + 2 as k, sum(n * p) as p from p group by all) group by row, col),
m as (select row, col, sum(n * p * p) as asm, sum(n * (i - j) * (i - j) * p) as contrast, sum(n * p / (1 + (i - j) * (i - j))) as idm, -sum(n * p * ln(p + 1e-8::double)) as entropy from p group by row, col)
select row::bigint as row, col::integer as col, round(asm, 6) as asm, round(contrast, 6) as contrast, round(idm, 6) as idm, round(sum_average, 6) as sum_average, round(sum_entropy, 6) as sum_entropy, round(entropy, 6) as entropy from m join k using (row, col)"""
#: The measures made of marginals, in the reference mode: means and deviations of the marginal vector, doubled diagonal.
_MARGINAL = _PAIRS + """,
x as materialized (select row, col, d, l, sum(p) as x from (select row, col, d, i as l, p from p union all select row, col, d, j, p from p where i <> j) group by all),
xs as (select row, col, d, sum(x) as total, sum(x * x) as squares, 32 * sum(x * l) as mu, -sum(x * ln(x + 1e-8::double)) as hx from x group by all),
var as (select row, col, d, sum(x * (l - mu) * (l - mu)) as variance from x join xs using (row, col, d) group by all),
c as (select row, col, d, sum(n * p * i * j) as cross_sum, -sum(n * p * ln(p + 1e-8::double)) as entropy from p group by all),
k as (select row, col, d, i + j + 2 as k, sum(n * p) as s from p group by all),
ke as (select row, col, d, -sum(s * ln(s + 1e-8::double)) as centre from k group by all),
sv as (select row, col, d, sum(s * (k - centre) * (k - centre)) as sum_variance from k join ke using (row, col, d) group by all),
g as (select row, col, d, j - i as g, sum(n * p) * case when i = j then 2 else 1 end as s from p group by row, col, d, j - i, case when i = j then 2 else 1 end),
gv as (select row, col, d, sum(s * s) / 32 - (sum(s) / 32) * (sum(s) / 32) as diff_variance, -sum(s * ln(s + 1e-8::double)) as diff_entropy from g group by all),
h1 as (select p.row, p.col, p.d, -sum(n * p * ln(a.x * b.x + 1e-8::double)) as hxy1 from p join x a on a.row = p.row and a.col = p.col and a.d = p.d and a.l = p.i join x b on b.row = p.row and b.col = p.col and b.d = p.d and b.l = p.j group by p.row, p.col, p.d),
h2 as (select a.row, a.col, a.d, -sum(a.x * b.x * ln(a.x * b.x + 1e-8::double)) as hxy2 from x a join x b using (row, col, d) group by a.row, a.col, a.d),
t as (select row, col, (cross_sum - 1 / 1024.0::double * total * total) / (squares / 32 - (total / 32) * (total / 32)) as correlation, variance, sum_variance, diff_variance, diff_entropy, (entropy - hxy1) / hx as imc1, sqrt(greatest(0, 1 - exp(-2 * (hxy2 - entropy)))) as imc2
  from xs join var using (row, col, d) join c using (row, col, d) join sv using (row, col, d) join gv using (row, col, d) join h1 using (row, col, d) join h2 using (row, col, d))
select row::bigint as row, col::integer as col, round(sum(correlation), 4) as correlation, round(sum(variance), 1) as variance, round(sum(sum_variance), 4) as sum_variance, round(sum(diff_variance), 6) as diff_variance, round(sum(diff_entropy), 6) as diff_entropy,
  round(sum(imc1), 6) as imc1, round(sum(imc2), 6) as imc2 from t group by row, col"""


@query("W6_J11_J12_G1_G2_G5_G6_G8_G9_textures", sql(_TEXTURE, "v_raster"))
def textures_tile(spark, d):
    return rounded(glcm.textures(views.raster(spark, d), THRESHOLDS).where("asm > 0").select("row", "col", "asm", "contrast", "idm", "sum_average", "sum_entropy", "entropy"))


@query("G3_G4_G7_G10_G11_G12_G13_textures", sql(_MARGINAL, "v_raster"))
def textures_marginal(spark, d):
    t = glcm.textures(views.raster(spark, d), THRESHOLDS).where("asm > 0")
    names = dict(zip(["correlation", "variance", "sum_variance", "diff_variance", "diff_entropy", "imc1", "imc2"], (glcm.MEASURES[i] for i in (2, 3, 6, 9, 10, 11, 12)), strict=True))
    return t.select("row", "col", *[F.round(c, {"correlation": 4, "variance": 1, "sum_variance": 4}.get(k, 6)).alias(k) for k, c in names.items()])


@query("J11_textures_relational", sql(_TEXTURE, "v_raster"))
def textures_join(spark, d):
    return rounded(glcm.textures_relational(views.raster(spark, d), THRESHOLDS).select(F.col("row").cast("long"), F.col("col").cast("int"), "asm", "contrast", "idm", "sum_average", "sum_entropy", "entropy"))


@query("G1_to_G13_textures_all")
def textures_all(spark, d):
    r = views.raster(spark, d)
    return rounded(glcm.textures(r, glcm.quantile_thresholds(r)), 4)


@query("A21_quantiles", sql("""with s as (select v, row_number() over (order by v) as r, count(*) over () as n from v_raster where v <> 0),
k as (select k::integer as k, least(greatest(n * k / 32.0::double + 0.5, 1), n) as x from range(1, 32) t(k), (select count(*) as n from v_raster where v <> 0))
select k, round(a.v + (b.v - a.v) * (x - floor(x)), 6) as q from k join s a on a.r = floor(x) join s b on b.r = least(floor(x) + 1, b.n)""", "v_raster"))
def quantiles(spark, d):
    q = glcm.quantile_thresholds(views.raster(spark, d))
    return rounded(spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(q)], "k int, q double"))


# Bands and colours

_SHIFT = ", ".join(f"abs(least(min(case when b{i} <> 0 then b{i} end), 0)) as m{i}" for i in range(1, 8))
_B = ", ".join(f"b{i} + m{i} + 1 as s{i}" for i in range(1, 8))
_IDX = {f"v_{i}": (f"s{i}", i) for i in range(1, 8)} | {
    "v_ndvi": ("(s5 - s4) / (s5 + s4 + 1e-4::double)", 4), "v_rvi": ("s5 / (s4 + 1e-4::double)", 4), "v_dvi": ("s5 - s4", 4), "v_evi": ("2.5::double * (s5 - s4) / (s5 + 6 * s4 - 7.5::double * s2 + 1 + 1e-4::double)", 4),
    "v_vi01": ("(s4 - s3) / (s5 + 1e-4::double)", 4), "v_vi02": ("s5 / (s3 + 1e-4::double)", 3), "v_vi03": ("s7 / (s4 + 1e-4::double)", 4), "v_savi": ("(b5 - b4) / (b5 + b4 + 0.5::double) * 1.5::double", 4),
    "v_ndsi": ("(s4 - s5) / (s4 + s5 + 1e-4::double)", 4), "v_si03": ("s3 * s4 / (s2 + 1e-4::double)", 4),
}


@query("B1_to_B17_A19_P8_indices", sql(f"with m as (select {_SHIFT} from v_bands), s as (select v_bands.*, {_B} from v_bands, m) select pixel, " + ", ".join(f"round(case when b{m} = 0 then 0 else {e} end, 6) as {k}" for k, (e, m) in _IDX.items()) + " from s", "v_bands"))
def band_indices(spark, d):
    return rounded(bands.with_indices(views.bands(spark, d)))


_RGB = "with e as (select " + ", ".join(f"{f}(case when b4 <> 0 then b{i} end) as {n}{i}" for i in (4, 3, 2) for n, f in (("lo", "min"), ("hi", "max"))) + " from v_bands), c as (select pixel, b4 <> 0 as live, 255 * (b4 - lo4) / (hi4 - lo4) as r, 255 * (b3 - lo3) / (hi3 - lo3) as g, 255 * (b2 - lo2) / (hi2 - lo2) as b from v_bands, e)"


@query("C1_C2_A20_C9_hsv", sql(_RGB + """, x as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from c),
h as (select pixel, live, hi, lo, case when hi = lo then 0 when hi = r then (g - b) / (hi - lo) / 6 when hi = g then (2 + (b - r) / (hi - lo)) / 6 else (4 + (r - g) / (hi - lo)) / 6 end as h from x)
select pixel, round(case when not live then 0 when h < 0 then h + 1 else h end, 6) as c1, round(case when hi = 0 then 0 else (hi - lo) / hi end, 6) as c2, round(hi, 6) as c3 from h""", "v_bands"))
def colour_hsv(spark, d):
    return rounded(bands.colour(views.bands(spark, d), (4, 3, 2), "hsv"))


@query("C3_ycbcr", sql(_RGB + """ select pixel, round(case when not live then 0 else 16 + (65.481::double * r + 128.553::double * g + 24.966::double * b) / 255 end, 6) as c1,
round(128 + (-37.797::double * r - 74.203::double * g + 112 * b) / 255, 6) as c2, round(128 + (112 * r - 93.786::double * g - 18.214::double * b) / 255, 6) as c3 from c""", "v_bands"))
def colour_ycbcr(spark, d):
    return rounded(bands.colour(views.bands(spark, d), (4, 3, 2), "ycbcr"))


_MIX = {
    "yiq": ((0.299, 0.587, 0.114), (0.595716, -0.274453, -0.321263), (0.211456, -0.522591, 0.311135)),
    "yuv": ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001)),
}
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def _mixed(row: tuple[float, ...], names: tuple[str, ...] = ("r", "g", "b")) -> str:
    return "(" + " + ".join(f"{w!r}::double * {n}" for w, n in zip(row, names, strict=True)) + ")"


def _channels(space: str, source: str, one: str, two: str, three: str) -> str:
    return f"select '{space}' as space, pixel, round(case when not live then 0 else {one} end, 6) as c1, round({two}, 6) as c2, round({three}, 6) as c3 from {source}"


_LINEAR = ", ".join(f"case when greatest({n} / 255, 0) <= 0.04045::double then greatest({n} / 255, 0) / 12.92::double else pow((greatest({n} / 255, 0) + 0.055::double) / 1.055::double, 2.4::double) end as l{n}" for n in "rgb")
_WHITE = (0.95047, 1.0, 1.08883)
_CURVE = ", ".join(f"case when {c} / {w!r}::double > 216 / 24389.0::double then cbrt({c} / {w!r}::double) else (24389 / 27.0::double * ({c} / {w!r}::double) + 16) / 116 end as f{c}" for c, w in zip("xyz", _WHITE, strict=True))
_SPACES = (
    f", li as (select *, {_LINEAR} from c), xz as (select *, " + ", ".join(f"{_mixed(row, ('lr', 'lg', 'lb'))} as {n}" for n, row in zip("xyz", _XYZ, strict=True)) + f" from li), cu as (select *, {_CURVE} from xz), "
    "la as (select pixel, live, 116 * fy - 16 as light, 500 * (fx - fy) as aa, 200 * (fy - fz) as bb from cu), hu as (select *, degrees(atan2(bb, aa)) as h from la) "
    + " union all ".join([_channels(k, "c", *map(_mixed, rows)) for k, rows in _MIX.items()] + [_channels("xyz", "xz", "x", "y", "z"), _channels("lab", "la", "light", "aa", "bb"), _channels("lch", "hu", "light", "sqrt(aa * aa + bb * bb)", "case when h < 0 then h + 360 else h end")])
)


@query("C4_to_C8_lab_xyz_yiq_yuv_lch", sql(_RGB + _SPACES, "v_bands"))
def colour_rest(spark, d):
    px = views.bands(spark, d)
    out = None
    for s in ("lab", "xyz", "yiq", "yuv", "lch"):
        one = rounded(bands.colour(px, (4, 3, 2), s)).withColumn("space", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def _all_triples() -> str:
    """All triples in both spaces: 48 columns."""
    ends, cols = {}, []
    for t in bands.TRIPLES:
        tag, c = "".join(map(str, t)), []
        for i in t:
            lo, hi = f"lo_{t[0]}_{i}", f"hi_{t[0]}_{i}"
            ends |= {lo: f"min(case when b{t[0]} <> 0 then b{i} end) as {lo}", hi: f"max(case when b{t[0]} <> 0 then b{i} end) as {hi}"}
            c.append(f"(255 * (b{i} - {lo}) / ({hi} - {lo}))")
        r, g, b = c
        top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
        gap = f"({top} - {low})"
        h = f"(case when {gap} = 0 then 0 when {top} = {r} then ({g} - {b}) / {gap} when {top} = {g} then 2 + ({b} - {r}) / {gap} else 4 + ({r} - {g}) / {gap} end / 6)"
        dead = f"b{t[0]} = 0"
        cols += [f"case when {dead} then 0 when {h} < 0 then {h} + 1 else {h} end as hsv_{tag}_1", f"case when {top} = 0 then 0 else {gap} / {top} end as hsv_{tag}_2", f"{top} as hsv_{tag}_3"]
        cols += [f"case when {dead} then 0 else 16 + (65.481::double * {r} + 128.553::double * {g} + 24.966::double * {b}) / 255 end as ycbcr_{tag}_1"]
        cols += [f"128 + (-37.797::double * {r} - 74.203::double * {g} + 112 * {b}) / 255 as ycbcr_{tag}_2", f"128 + (112 * {r} - 93.786::double * {g} - 18.214::double * {b}) / 255 as ycbcr_{tag}_3"]
    named = [c.rsplit(" as ", 1) for c in cols]
    return f"with e as (select {', '.join(ends.values())} from v_bands) select pixel, {', '.join(f'round({x}, 6) as {n}' for x, n in named)} from v_bands, e"


@query("C10_colour_features", sql(_all_triples(), "v_bands"))
def colour_all(spark, d):
    return rounded(bands.colour_features(views.bands(spark, d)))


@query("S12_band_statistics", sql("with l as (" + " union all ".join(f"select {i}::integer as band, b{i} as v from v_bands" for i in range(1, 8)) + ") select band, round(min(v), 6) as lo, round(max(v), 6) as hi, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from l where v <> 0 group by band", "v_bands"))
def band_stats(spark, d):
    return rounded(bands.band_statistics(views.bands(spark, d)))


@query("C12_nan_default", sql("select pixel, case when b1 < -0.2 then 0 else b1 end as v from v_bands", "v_bands"))
def nan_default(spark, d):
    return views.bands(spark, d).select("pixel", bands.nan_to(F.when(F.col("b1") < -0.2, float("nan")).otherwise(F.col("b1"))).alias("v"))


# Lookups, hierarchies, predicates

_CLASSES = "classes(class_id, name) as (values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(SEGMENTS[:4])) + ")"


@query("J1_name_to_id", sql(f"with {_CLASSES} select id, v_names.name, coalesce(class_id, 0)::integer as class_id from v_names left join classes using (name)", "v_names"))
def name_to_id(spark, d):
    return lookup.name_to_id(views.names(spark, d), lookup.classes_of(SEGMENTS[:4], spark)).select("id", "name", "class_id")


@query("J2_id_to_name", sql(f"with {_CLASSES} select id, y::integer as class_id, name from v_pred join classes on y = class_id", "v_pred"))
def id_to_name(spark, d):
    return lookup.id_to_name(views.pred(spark, d).select("id", F.col("y").alias("class_id")), lookup.classes_of(SEGMENTS[:4], spark)).select("id", "class_id", "name")


@query("P3_in_list", sql("select id, (name in ('BUILDING', 'MACHINERY'))::integer as hit from v_names", "v_names"))
def in_list(spark, d):
    return views.names(spark, d).select("id", lookup.in_list(F.col("name"), ["BUILDING", "MACHINERY"]).alias("hit"))


@query("P4_P5_U2_U6_drop_ids", sql("select id, name from v_names where name = 'BUILDING' and id not in (select o_custkey from orders where o_totalprice > 300000)", "v_names"))
def drop_ids(spark, d):
    return lookup.drop_ids(views.names(spark, d).where("name = 'BUILDING'"), views.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").cast("long").alias("id")))


@query("J4_T7_U1_hierarchy", sql("select upper, string_agg(lower::varchar, ',' order by pos) as lowers from v_hier group by upper", "v_hier"))
def hierarchy(spark, d):
    return lookup.hierarchy(views.hierarchy(spark, d)).select("upper", F.array_join(F.transform("lowers", lambda x: x.cast("string")), ",").alias("lowers"))


@query("J5_map_up", sql("select id, b.lower, coalesce(upper, 0)::integer as upper from v_base b left join (select * from v_hier where lower < 20) h on b.lower = h.lower", "v_hier", "v_base"))
def map_up(spark, d):
    return lookup.map_up(views.base_map(spark, d), views.hierarchy(spark, d).where("lower < 20")).select("id", "lower", "upper")


@query("J6_T1_map_down", sql("""with u as (select id, upper from v_base join v_hier using (lower)), o as (select u.id, u.upper, h.lower, (u.id * (h.lower + 3) * 7919 % 97) / 97.0::double as p from u join v_hier h using (upper)),
r as (select *, row_number() over (partition by id order by p desc, lower) as k from o) select id, lower, p from r where k = 1""", "v_hier", "v_base"))
def map_down(spark, d):
    base = lookup.map_up(views.base_map(spark, d), views.hierarchy(spark, d)).select("id", "upper")
    rel = views.hierarchy(spark, d)
    probs = base.join(rel, "upper").select("id", "lower", ((F.col("id") * (F.col("lower") + 3) * 7919 % 97) / 97).alias("p"))
    return lookup.map_down(base, probs, rel).select("id", "lower", "p")


@query("J8_J9_class_expansion", sql("select id, y, k::integer as class_id, (k = y)::integer as hit from v_samples, range(0, 10) t(k)", "v_samples"))
def expansion(spark, d):
    return lookup.class_expansion(views.samples(spark, d).select("id", "y"), 10).select("id", "y", "class_id", "hit")


@query("J13_L22_joint_uncertainty", sql("select a.row, a.col, round(1 - (1 - abs(a.v)) * (1 - abs(b.v)), 6) as u from v_raster a join v_raster b on a.row = b.row and a.col = b.col + 1", "v_raster"))
def joint(spark, d):
    a = views.raster(spark, d)
    b = a.select("row", (F.col("col") + 1).alias("col"), F.col("v").alias("w"))
    return rounded(a.join(b, ["row", "col"]).select("row", "col", arrays.joint_uncertainty(F.abs("v"), F.abs("w")).alias("u")))


@query("J14_rows_of_parent", sql("select id, lower from v_base where lower in (select lower from v_hier where upper = 2)", "v_hier", "v_base"))
def rows_of_parent(spark, d):
    return views.base_map(spark, d).join(views.hierarchy(spark, d).where("upper = 2").select("lower"), "lower", "left_semi").select("id", "lower")


@query("S4_J3_F3_stack", sql("select vec_id::bigint as row, " + ", ".join(f"round(embedding[{i + 1}]::double, 3) as c{i}" for i in range(64)) + " from embeddings"))
def stacked(spark, d):
    r = views.raster(spark, d).select(F.concat(F.lit("c"), F.col("col")).alias("band"), "row", F.lit(0).alias("col"), "v")
    return lookup.stack(r, [f"c{i}" for i in range(64)]).drop("col")


@query("S7_mosaic", sql("select row, col, v from v_raster", "v_raster"))
def mosaic(spark, d):
    r = views.raster(spark, d)
    blocks = r.select(F.when(F.col("row") >= 100, 1).otherwise(0).alias("ylabel"), F.when(F.col("col") >= 20, 1).otherwise(0).alias("xlabel"), F.when(F.col("row") >= 100, F.col("row") - 100).otherwise(F.col("row")).alias("r"), F.when(F.col("col") >= 20, F.col("col") - 20).otherwise(F.col("col")).alias("c"), "v")
    return lookup.mosaic(blocks).select("row", "col", "v")


@query("P9_threshold", sql("select id, (s >= 0.5)::integer as hit from v_pred", "v_pred"))
def threshold(spark, d):
    return views.pred(spark, d).select("id", (F.col("s") >= 0.5).cast("int").alias("hit"))


@query("P11_suppress_low", sql("select id, round(case when s < 0.6::double * (select max(s) from v_pred) then 0 else s end, 6) as p from v_pred", "v_pred"))
def suppress(spark, d):
    return rounded(lookup.suppress_low(views.pred(spark, d).select("id", F.col("s").alias("p")), 0.6))


@query("P12_drop_repeated", sql("""select p_partkey::bigint as id, p_brand, p_size from part where not (p_brand in (select p_brand from part where p_partkey % 7 = 0 and p_size < 10) and p_size in (select p_size from part where p_partkey % 7 = 0 and p_size < 10))"""))
def drop_repeated(spark, d):
    p = views.table(spark, d, "part")
    out = lookup.drop_repeated(p, p.where("p_partkey % 7 = 0 and p_size < 10"), ["p_brand", "p_size"])
    return out.select(F.col("p_partkey").cast("long").alias("id"), "p_brand", "p_size")


@query("P1_P2_S3_projection", sql("select id, y, x[1] as x0, x[6] as x5 from v_samples", "v_samples"))
def projection(spark, d):
    return views.wide(views.samples(spark, d), 6).select("id", "y", "x0", "x5")


# Sources and sinks

@query("S4_S5_K1_K2_K3_geotiff", sql("select 'v' as band, row, col, v from v_raster", "v_raster"))
def tiff(spark, d):
    cells = views.raster(spark, d).select(F.lit("v").alias("band"), "row", "col", "v")
    return geotiff.decoded(geotiff.encoded(cells, geotiff.Georeference(10, 45, 0.5, -0.5), "Float64"))


@query("K6_K7_report_ids", sql("select row_number() over (order by metric desc, iter) as id, iter, metric from v_series", "v_series"))
def report_ids(spark, d):
    s = views.series(spark, d).withColumn("down", -F.col("metric"))
    return tables.with_row_id(s, ["down", "iter"]).select(F.col("ID").cast("long").alias("id"), "iter", "metric")


@query("K8_ragged", sql("select i::integer as pos, case when i < 2 then 'x' || i end as run1, 'x' || (i * 2) as run2 from range(0, 4) t(i)"))
def ragged(spark, d):
    runs = spark.createDataFrame([(1, ["x0", "x1"]), (2, ["x0", "x2", "x4", "x6"])], "run int, features array<string>")
    return tables.ragged(runs).select("pos", F.col("1").alias("run1"), F.col("2").alias("run2"))


@query("S6_raster_bounds", sql("select 'v' as band, max(row)::integer + 1 as n_rows, max(col)::integer + 1 as n_cols, 45.0::double as top, 10.0::double as left_x, 10 + (max(col) + 1) * 0.5::double as right_x, 45 - (max(row) + 1) * 0.5::double as bottom from v_raster", "v_raster"))
def bounds(spark, d):
    cells = views.raster(spark, d).select(F.lit("v").alias("band"), "row", "col", "v")
    m = geotiff.described(geotiff.encoded(cells, geotiff.Georeference(10, 45, 0.5, -0.5)))
    return m.select("band", "n_rows", "n_cols", "top", F.col("left").alias("left_x"), F.col("right").alias("right_x"), "bottom")


# Metrics

@query("A1_histogram", sql("select k::integer as class_id, count(y)::bigint as n from range(0, 10) t(k) left join v_pred on y = k group by k", "v_pred"))
def hist(spark, d):
    return metrics.histogram(views.pred(spark, d), 10)


@query("A2_K12_confusion", sql("select y, p, count(*) as n, round(count(*) / sum(count(*)) over (partition by y), 6) as share from v_pred group by y, p", "v_pred"))
def confusion(spark, d):
    return rounded(metrics.normalised_confusion(views.pred(spark, d)))


_CLASS = "c as (select y, count(*) as n, avg((y = p)::integer::double) as a from v_pred group by y)"


@query("A3_A4_A9_A10_A11_K11_report", sql(f"""with {_CLASS}, t as (select sum(n) as t, count(*) as k from c),
k as (select (select avg((y = p)::integer::double) from v_pred) as po, (select sum(a.n::double * b.n) from (select y, count(*) as n from v_pred group by y) a join (select p, count(*) as n from v_pred group by p) b on a.y = b.p) / (select t * t from t) as pe)
select 'accuracy' as metric, round(po, 6) as value from k union all select 'kappa', round((po - pe) / (1 - pe), 6) from k
union all select 'balanced-accuracy', round(avg(a), 6) from c union all select 'linear-accuracy', round(sum((0.25::double + 0.75::double * n / t) * a) / max(0.25::double * k + 0.75::double), 6) from c, t""", "v_pred"))
def report(spark, d):
    return rounded(metrics.report(views.pred(spark, d)))


@query("A5_A6_A7_K10_binary", sql("""with b as (select (y >= 5)::integer as y, (p >= 5)::integer as p from v_pred), s as (select sum((y = 1 and p = 1)::integer) as tp, sum(y) as pos, sum(p) as said from b)
select 'recall' as metric, round(tp / pos, 6) as value from s union all select 'precision', round(tp / said, 6) from s union all select 'f1score', round(2 * tp / (pos + said), 6) from s""", "v_pred"))
def binary(spark, d):
    b = views.pred(spark, d).select("id", (F.col("y") >= 5).cast("int").alias("y"), (F.col("p") >= 5).cast("int").alias("p"))
    return rounded(metrics.report(b, ("recall", "precision", "f1score")))


@query("A8_auc", sql("""with r as (select (y >= 5)::integer as y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from v_pred)
select round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * sum(1 - y)), 6) as value from r""", "v_pred"))
def auc(spark, d):
    return rounded(metrics.auc(views.pred(spark, d).select((F.col("y") >= 5).cast("int").alias("y"), "s")))


@query("A12_raster_accuracy", sql("select round(avg((floor(a.v * 10) = floor(b.v * 10))::integer::double), 6) as value from v_raster a join v_raster b on a.row = b.row and a.col = b.col + 1", "v_raster"))
def raster_accuracy(spark, d):
    r = views.raster(spark, d).withColumn("v", F.floor(F.col("v") * 10))
    return rounded(metrics.raster_evaluate(r, r.withColumn("col", F.col("col") + 1), "accuracy"))  # the map against itself moved by a cell


@query("A13_instance_weights", sql("select id, y, round((n0 - n) / n0 / (sum((n0 - n) / n0) over ()), 9) as w from (select id, y, count(*) over (partition by y)::double as n, count(*) over ()::double as n0 from v_pred)", "v_pred"))
def weights(spark, d):
    return rounded(votes.instance_weights(views.pred(spark, d).select("id", "y")), 9)


_W = "w as (select run, case when e < 0.6 then 0 else e * e end as w from v_metrics), ww as (select run, w / (select sum(w) from w) as weight from w)"


@query("A14_ensemble_weights", sql(f"with {_W} select run, round(weight, 9) as weight from ww", "v_metrics"))
def ensemble_weights(spark, d):
    return rounded(votes.ensemble_weights(views.metrics(spark, d), 2, 0.6), 9)


@query("A15_positive_ratio", sql("select round(sum((y < 5)::integer) / sum((y >= 5)::integer), 6) as value from v_pred", "v_pred"))
def positive(spark, d):
    return rounded(votes.positive_ratio(views.pred(spark, d).select((F.col("y") >= 5).cast("int").alias("y"))))


_HARD = f"with {_W}, s as (select id, pred, sum(weight) as v from v_votes join ww using (run) where weight > 0 group by id, pred), r as (select id, pred, v, row_number() over (partition by id order by round(v, 12) desc, pred) as k from s)"


@query("A16_L12_L13_hard_vote", sql(_HARD + " select id, pred, round(v, 6) as votes from r where k = 1", "v_metrics", "v_votes"))
def hard_vote(spark, d):
    return rounded(votes.hard_vote(views.votes(spark, d).select("run", "id", "pred"), votes.ensemble_weights(views.metrics(spark, d), 2, 0.6)))


@query("A18_M6_partial_votes", sql(_HARD + " select id, pred from r where k = 1", "v_metrics", "v_votes"))
def partial(spark, d):
    return votes.combine_votes(votes.partial_votes(views.votes(spark, d).select("run", "id", "pred"), votes.ensemble_weights(views.metrics(spark, d), 2, 0.6), 3))


@query("A17_P9_L15_L16_soft_vote", sql(f"with {_W} select id, round(sum(weight * prob), 6) as p, (sum(weight * prob) >= 0.5)::integer as pred from v_votes join ww using (run) where weight > 0 group by id", "v_metrics", "v_votes"))
def soft_vote(spark, d):
    return rounded(votes.soft_vote(views.votes(spark, d).select("run", "id", "prob"), votes.ensemble_weights(views.metrics(spark, d), 2, 0.6)))


@query("A25_stretch", sql("select id, class_id, round(p / max(p) over (partition by class_id), 6) as p from (select id, run::integer as class_id, prob as p from v_votes)", "v_votes"))
def stretch(spark, d):
    return rounded(votes.stretch_probabilities(views.votes(spark, d).select("id", F.col("run").alias("class_id"), F.col("prob").alias("p"))))


@query("F4_F5_T1_cube_argmax", sql("select id, arg_max(run, struct_pack(a := prob, b := -run))::integer - 1 as best from v_votes group by id", "v_votes"))
def cube(spark, d):
    c = votes.to_cube(views.votes(spark, d).select("id", F.col("run").alias("class_id"), F.col("prob").alias("p")))
    return c.select("id", arrays.argmax(F.col("probs")).alias("best"))


@query("T2_confusion_index", sql("with r as (select id, prob, row_number() over (partition by id order by prob desc) as k from v_votes) select id, round(1 - (max(case when k = 1 then prob end) - max(case when k = 2 then prob end)), 6) as u from r group by id", "v_votes"))
def confusion_index(spark, d):
    c = votes.to_cube(views.votes(spark, d).select("id", F.col("run").alias("class_id"), F.col("prob").alias("p")))
    return rounded(c.select("id", arrays.confusion_index(F.col("probs")).alias("u")))


# Arrays and numbers

@query("F1_F2_one_hot", sql("select id, array_to_string([ (case when k = y then 1 else 0 end)::varchar for k in range(0, 10)], '') as hot, y as back from v_pred", "v_pred"))
def one_hot(spark, d):
    h = views.pred(spark, d).select("id", arrays.one_hot(F.col("y"), 10).alias("h"))
    return h.select("id", F.array_join(F.transform("h", lambda x: x.cast("string")), "").alias("hot"), arrays.from_one_hot(F.col("h")).alias("back"))


@query("F6_F7_S8_paths", sql("select id, 'maps/' || name || '.tif' as path, round(sqrt(id) + exp(-id) + ln(id + 1) + abs(id - 50), 6) as x from v_names", "v_names"))
def paths(spark, d):
    i = F.col("id")
    return rounded(views.names(spark, d).select("id", arrays.raster_path("maps", F.col("name")).alias("path"), (F.sqrt(i) + F.exp(-i) + F.log(i + 1) + F.abs(i - 50)).alias("x")))


@query("F8_due_time", sql("select id, (m // 1440)::bigint as days, (m % 1440 // 60)::bigint as hours, (m % 60)::bigint as minutes from (select id, floor(floor(7200.0::double / (id % 9 + 1) * (500 - (id % 9 + 1)) / 60))::bigint as m from v_names)", "v_names"))
def due(spark, d):
    done = F.col("id") % 9 + 1
    return views.names(spark, d).select("id", *arrays.due_time(F.lit(0.0), F.lit(7200.0), done, F.lit(500)))


@query("F9_smote_targets", sql("""with n as (select y, count(*) as n from v_pred where id % 3 <> 0 or y > 2 group by y), t as (select max(n) as hi, min(n) as lo from n)
select y, n, ceil((n - lo) / (hi - lo)::double * (hi - round_even(hi / 16.0, 0)) + round_even(hi / 16.0, 0))::bigint as target from n, t""", "v_pred"))
def targets(spark, d):
    return sampling.smote_targets(views.pred(spark, d).where("id % 3 <> 0 or y > 2"), 16)


# Sampling

_KEY = "((id + 1) * 2654435761) % 4294967296"


@query("M1_random_split", sql(f"select id, y from v_pred where {_KEY} < {int(0.7 * 4294967296)}", "v_pred"))
def split(spark, d):
    return sampling.random_split(views.pred(spark, d).select("id", "y"), 0.7)[0]


@query("M2_stratified_split", sql(f"select id, y, row_number() over (partition by y order by {_KEY}, id) <= floor(count(*) over (partition by y) * 0.7) as train from v_pred", "v_pred"))
def stratified(spark, d):
    return sampling.stratified_split(views.pred(spark, d).select("id", "y"), 0.7).select("id", "y", "train")


@query("M3_U3_folds", sql(f"select id, y, 0 as repeat, ((row_number() over (partition by y order by {_KEY}, id) - 1) % 5)::integer as fold from v_pred", "v_pred"))
def folds(spark, d):
    return sampling.stratified_folds(views.pred(spark, d).select("id", "y"), 5).select("id", "y", "repeat", "fold")


@query("M5_A29_draw_columns", sql("""with c as (select 'x' || i as var, i as pos, i % 4 as cluster from range(0, 64) t(i)), n as (select cluster, count(*) as n from c group by cluster),
t as (select cluster, least(ceil(round(n * ((64 - n) / (64.0::double * 3)) * 0.5::double * 4, 9)), n) as take from n),
r as (select run, c.*, row_number() over (partition by run, cluster order by ((pos + 1 + run * 1000003 + 1) * 2654435761) % 4294967296, pos) as k from c, range(0, 7) u(run))
select run::integer as run, r.cluster::integer as cluster, var from r join t using (cluster) where k <= take"""))
def draws(spark, d):
    c = spark.createDataFrame([(f"x{i}", i, i % 4) for i in range(64)], "var string, pos int, cluster int")
    return sampling.draw_columns(c, 0.5, [-2], 7)


@query("J10_neighbours", sql("""with p as (select a.id, b.id as other, sqrt(list_sum([ (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]) for i in range(1, 65)])) as dist from v_samples a join v_samples b on a.y = b.y and a.id <> b.id),
r as (select *, row_number() over (partition by id order by dist, other) as k from p) select id, k::integer as k, other, round(dist, 6) as dist from r where k <= 5""", "v_samples"))
def neighbours(spark, d):
    nn = sampling.neighbours(views.samples(spark, d), 5).select("id", F.posexplode("nn").alias("k", "n"))
    return rounded(nn.select("id", (F.col("k") + 1).cast("int").alias("k"), F.col("n.id").alias("other"), F.col("n.d").alias("dist")))


@query("M4_U4_U5_smote")
def smote(spark, d):
    s = views.samples(spark, d).where("y > 2 or id % 4 = 0")
    return sampling.smote(s, 16).select("id", "y", "synthetic", F.round(F.element_at("x", 1), 6).alias("x0"))


# Features

@query("A22_correlation", sql("select a.f as i, b.f as j, round(corr(a.v, b.v), 6) as r from v_long a join v_long b on a.id = b.id and a.f < b.f group by a.f, b.f", "v_long"))
def correlation(spark, d):
    return rounded(selection.correlation_pairs(views.samples(spark, d), 64))


@query("A23_drop_redundant")
def redundant(spark, d):
    names = [f"x{i}" for i in range(64)]
    kept = selection.drop_redundant(selection.correlation(views.samples(spark, d), 64), names, 0.2)
    return spark.createDataFrame([(n,) for n in kept], "var string")


@query("W9_A27_U1_strong_maxima", sql("""with s as (select *, lag(metric) over (order by iter) as a, lead(metric) over (order by iter) as b, max(metric) over () as top from v_series),
t as (select min(iter) as first_at from s where metric = top) select iter, metric from s, t where metric > a and metric > b and metric > 0.85::double * top and iter <= first_at""", "v_series"))
def maxima(spark, d):
    return selection.strong_maxima(views.series(spark, d), 0.85)


@query("T6_T3_ordered_series", sql("select iter, metric from v_series order by metric desc, iter", "v_series"))
def ordered(spark, d):
    return views.series(spark, d).orderBy(F.col("metric").desc(), "iter")


@query("T4_T5_without_weakest", sql("select pos, score from (select iter as pos, metric as score, row_number() over (order by metric, iter) as k from v_series) where k > 1 and pos <> 3", "v_series"))
def without_weakest(spark, d):
    s = views.series(spark, d).select(F.col("iter").alias("pos"), F.col("metric").alias("score"))
    return selection.without_weakest(s).where("pos <> 3").select("pos", "score")


@query("U2_pool", sql("select i::integer as pos, 'x' || i as var from range(0, 64) t(i) where i % 5 <> 0"))
def pool(spark, d):
    names = spark.createDataFrame([(i, f"x{i}") for i in range(64)], "pos int, var string")
    return selection.pool(names, names.where("pos % 5 = 0")).select("pos", "var")


@query("L17_A26_cluster_sizes")
def clusters(spark, d):
    return selection.cluster_sizes(selection.cluster_variables(views.samples(spark, d), [f"x{i}" for i in range(64)], 5))


# Models

_P = boosting.Params(objective="softmax", n_classes=10, depth=3, rounds=12)


@query("L1_L2_L4_L6_L11_ensemble")
def ensemble(spark, d):
    s = views.samples(spark, d)
    e = boosting.train_ensemble(s, 64, 4, _P, metric="accuracy")
    return rounded(metrics.report(boosting.predict_ensemble(s, e, 10).join(s.select("id", "y"), "id").select("y", F.col("pred").alias("p"))), 4)


@query("L5_L7_L9_category_ensemble")
def category(spark, d):
    s = views.samples(spark, d)
    e = boosting.train_ensemble(s, 64, 2, boosting.Params(n_classes=10, depth=3, rounds=8), "category", "accuracy")
    return rounded(metrics.report(boosting.predict_ensemble(s, e, 10, "category").join(s.select("id", "y"), "id").select("y", F.col("pred").alias("p"))), 4)


@query("L3_L14_L15_binary_ensemble")
def binary_ensemble(spark, d):
    s = views.samples(spark, d).withColumn("y", (F.col("y") >= 5).cast("int"))
    e = boosting.train_ensemble(s, 64, 3, boosting.Params(depth=3, rounds=12), "binary", "accuracy")
    return rounded(boosting.predict_binary_ensemble(s, e), 4)


@query("A24_K13_feature_scores")
def scores(spark, d):
    e = boosting.train_ensemble(views.samples(spark, d), 64, 2, boosting.Params(objective="softmax", n_classes=10, depth=2, rounds=6), metric="accuracy", column_rate=1.0)
    return tables.importance(boosting.feature_scores(e, [f"x{i}" for i in range(64)]))


@query("J7_hierarchical")
def hierarchical(spark, d):
    s = views.samples(spark, d).withColumnRenamed("y", "lower").withColumn("upper", F.when(F.col("lower") == 9, 3).otherwise(F.floor(F.col("lower") / 3)).cast("int"))
    rel = s.select("upper", "lower").distinct()
    return rounded(boosting.hierarchical(s, s.select("id", "upper", "x"), rel, 64, boosting.Params(objective="softmax", n_classes=3, depth=2, rounds=6), runs=2), 4)


@query("L18_L19_A28_sweep")
def sweep(spark, d):
    return rounded(selection.sweep(views.samples(spark, d, 6), [0, 1], [2, 3, 4, 5], boosting.Params(objective="softmax", n_classes=10, depth=2, rounds=4), k=3), 4)


@query("L20_L21_selection")
def floating(spark, d):
    series, _ = selection.floating_selection(views.samples(spark, d, 5), [f"x{i}" for i in range(5)], boosting.Params(objective="softmax", n_classes=10, depth=2, rounds=3), max_iterations=4, every=3, k=3)
    return rounded(series, 4)


# Maps

#: Three runs of stumps over three classes: weight, variables, and for each class (place among these, cut, value below, value above).
_RUNS = [
    (0.5, [0, 1, 2], [(0, 0.01, -1.0, 1.0), (1, 0.05, -0.5, 1.5), (2, -0.02, 0.25, 0.0)]),
    (0.3, [3, 4], [(0, 0.0, 0.5, -0.5), (1, 0.03, -1.0, 0.75), (0, 0.08, 0.125, 1.25)]),
    (0.2, [5, 6, 0], [(0, -0.05, 0.0, 0.625), (1, 0.02, 0.375, 0.0), (2, 0.04, -0.25, 0.875)]),
]
_PARTS = [(0.6, [2, 5], [(0, 0.0, 0.5, -0.5), (1, 0.0, -0.125, 0.25)]), (0.4, [6, 1], [(1, 0.02, 0.75, 0.0), (0, -0.01, 0.0, 0.375)])]
_BANDS = [f"b{i}" for i in range(1, 8)]
_WIDTH = 10


def _stumps(spark: SparkSession, runs: list) -> DataFrame:
    """The runs as an ensemble table, models as they are saved."""
    rows = []
    for k, (weight, feats, cuts) in enumerate(runs):
        model = boosting.Booster(boosting.Params(objective="softmax", n_classes=len(cuts)))
        model.trees, model.weight = [[boosting.Tree([f, -1, -1], [cut, 0.0, 0.0], [1, -1, -1], [0.0, low, high]) for f, cut, low, high in cuts]], [1.0]
        rows.append((k, 0.9, feats, model.dump(), weight))
    return spark.createDataFrame(rows, "run int, e double, features array<int>, model binary, weight double")


def _map_sql(runs: list, tag: str, least: float = 0.0) -> str:
    """Votes of the same stumps in SQL: common table expressions that end in <tag>map."""
    n, z = len(runs[0][2]), []
    for k, (_, feats, cuts) in enumerate(runs):
        z += [f"case when b{feats[f] + 1} > {cut!r}::double then {high!r}::double else {low!r}::double end as z{k}{c}" for c, (f, cut, low, high) in enumerate(cuts)]
    won = lambda k, c: " and ".join([f"z{k}{c} > z{k}{o}" for o in range(c)] + [f"z{k}{c} >= z{k}{o}" for o in range(c + 1, n)])
    share = [" + ".join(f"case when {won(k, c)} then {runs[k][0]!r}::double else 0 end" for k in range(len(runs))) for c in range(n)]
    soft = [" + ".join(f"{runs[k][0]!r}::double * exp(z{k}{c}) / ({' + '.join(f'exp(z{k}{o})' for o in range(n))})" for k in range(len(runs))) for c in range(n)]
    return f"""{tag}z as (select pixel, b1, {', '.join(z)} from v_bands),
{tag}s as (select pixel, b1, [{', '.join(f'round({x}, 12)' for x in share)}] as s, [{', '.join(soft)}] as q from {tag}z),
{tag}w as (select pixel, b1, list_position(s, list_max(s)) as k, list_max(s) as share, q, 1 - (list_max(s) - list_reverse_sort(s)[2]) as u from {tag}s),
{tag}m as (select max(share) as top from {tag}w where b1 <> 0),
{tag}map as (select (pixel // {_WIDTH})::bigint as row, (pixel % {_WIDTH})::integer as col, case when b1 = 0 or share < {least!r}::double * top then 0 else k end::integer as class,
  round(case when b1 = 0 or share < {least!r}::double * top then 0 else share end, 6) as share, round(case when b1 = 0 then 0 else q[k] end, 6) as p, round(case when b1 = 0 then 0 else u end, 6) as u from {tag}w, {tag}m)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The pixels as a scene of ten columns."""
    return views.bands(spark, d).select(F.floor(F.col("pixel") / _WIDTH).cast("long").alias("row"), (F.col("pixel") % _WIDTH).cast("int").alias("col"), *_BANDS)


def _shown(cells: DataFrame) -> DataFrame:
    return rounded(cells.select("row", "col", F.col("class").cast("int").alias("class"), "share", "p", "u"))


@query("L8_L9_L10_L12_L13_L16_P11_map", sql(f"with {_map_sql(_RUNS, 'one_', 0.7)} select row, col, class, share, p, u from one_map", "v_bands"))
def predicted_map(spark, d):
    return _shown(mapping.class_map(_cells(spark, d), _BANDS, _stumps(spark, _RUNS), 3, _WIDTH, least_share=0.7))


@query("S4_S5_S9_S10_K1_K2_K9_map_of_files", sql(f"with {_map_sql(_RUNS, 'one_')} select row, col, class, share, p, u from one_map", "v_bands"))
def map_of_files(spark, d):
    """Bands to GeoTIFF files, the ensemble to a table, both read again, the map written and read again."""
    folder = scratch(spark, "scene")
    bands_long = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in _BANDS])).alias("b")
    geotiff.write(_cells(spark, d).select("row", "col", bands_long).select("b.band", "row", "col", "b.v"), f"{folder}/bands", geotiff.Georeference(10, 45, 0.5, -0.5), "Float64", outside=math.nan)
    tables.save_ensemble(_stumps(spark, _RUNS), f"{folder}/ensemble")
    got = mapping.map_files(spark, f"{folder}/bands", _BANDS, tables.load_ensemble(spark, f"{folder}/ensemble"), 3)
    mapping.write_map(got, f"{folder}/map")
    return _shown(lookup.stack(geotiff.read(spark, f"{folder}/map", inside=True), ["class", "share", "p", "u"]))


@query("L22_J13_joint_map", sql(f"with {_map_sql(_RUNS, 'one_')}, {_map_sql(_PARTS, 'two_')} select row, col, one_map.class as upper, two_map.class, round(1 - (1 - one_map.u) * (1 - two_map.u), 6) as u from one_map join two_map using (row, col)", "v_bands"))
def joint_map(spark, d):
    cells = _cells(spark, d)
    parent, child = (mapping.class_map(cells, _BANDS, _stumps(spark, runs), len(runs[0][2]), _WIDTH) for runs in (_RUNS, _PARTS))
    return rounded(mapping.joint_map(parent, child).select("row", "col", "upper", "class", "u"))


@query("L18_L20_selected_map")
def selected_map(spark, d):
    """Selection by held-out rounds, its best set refitted, and the scene mapped with it."""
    params = boosting.Params(objective="softmax", n_classes=10, depth=2, rounds=3)
    s, names = views.samples(spark, d, 7), _BANDS  # the scene has seven bands
    series, sets = selection.floating_selection(s, names, params, max_iterations=3, every=3, k=3, metric="accuracy")
    return _shown(mapping.selected_map(_cells(spark, d), s, names, sets, series, params, _WIDTH))


@query("A27_U1_T7_final_set", sql("""with s as (select *, lag(metric) over (order by iter) as a, lead(metric) over (order by iter) as b, max(metric) over () as top from v_series),
t as (select min(iter) as first_at from s where metric = top), m as (select iter from s, t where metric > a and metric > b and metric > 0.85::double * top and iter <= first_at)
select distinct 'x' || (iter * k % 7) as var from m, range(1, 4) r(k)""", "v_series"))
def final_set(spark, d):
    series = views.series(spark, d)
    sets = series.select("iter", F.explode(F.array(*[F.concat(F.lit("x"), (F.col("iter") * k % 7).cast("string")) for k in (1, 2, 3)])).alias("var"))
    return selection.final_set(sets, series, 0.85)


@query("S1_S2_csv", sql("select id, name from v_names", "v_names"))
def csv(spark, d):
    folder = scratch(spark, "names")
    views.names(spark, d).write.option("header", True).csv(folder)
    return tables.read_csv(spark, folder, "id long, name string")
