"""Horizontal references: axes, wrap and pole flags, cell dimensions, bounding boxes and sameness of grids, as columns of a ``grids`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.functions import expr

#: Flags of a grid.
FLAGS = {"sparse": 1, "regular": 2, "tile": 4, "wrap": 8, "repeat": 16, "north": 32, "vertical": 64, "radial": 128, "negative_lon": 256}


def uniform_axis(start: Column, step: Column, n: Column) -> Column:
    """n values from start in steps of step."""
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: start + step * k)


def rotated_axes(centre_lon: Column, centre_lat: Column, dx: Column, dy: Column, ni: Column, nj: Column, extension: int) -> tuple[Column, Column]:
    """Axes of a limited-area grid round a centre, with ``extension`` more points on every side."""
    x = uniform_axis(centre_lon - dx * ((ni - 1) / 2 + extension), dx, ni + 2 * extension)
    y = uniform_axis(centre_lat - dy * ((nj - 1) / 2 + extension), dy, nj + 2 * extension)
    return x, y


def _cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def rotation(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The rotated system of two points, as an array of nine numbers: the first point is its origin (0, 0), the second lies on its equator to the east, and its pole is that of their great circle. Null if they are one or opposite."""
    p, q = _unit(lat1, lon1), _unit(lat2, lon2)
    pole = _cross(p, q)
    size = F.sqrt(pole[0] * pole[0] + pole[1] * pole[1] + pole[2] * pole[2])
    pole = tuple(c / size for c in pole)
    return F.when(size > 1e-9, F.array(*p, *_cross(pole, p), *pole))


def _angles(v: list[Column]) -> tuple[Column, Column]:
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[2])))), F.degrees(F.atan2(v[1], v[0]))


def turned_to(m: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(lat, lon) in a rotated system (rotation) of a point on the earth."""
    v = _unit(lat, lon)
    return _angles([m[3 * k] * v[0] + m[3 * k + 1] * v[1] + m[3 * k + 2] * v[2] for k in range(3)])


def turned_back(m: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(lat, lon) on the earth of a point of a rotated system: the inverse."""
    v = _unit(lat, lon)
    return _angles([m[k] * v[0] + m[3 + k] * v[1] + m[6 + k] * v[2] for k in range(3)])


def rotated_grid(df: DataFrame, ni: str, nj: str, dx: str, dy: str, points: tuple[str, str, str, str], max_cfl: int = 0, lon_r: float = 0.0, lat_r: float = 0.0) -> DataFrame:
    """df with the grid that its parameters give: ``rotation`` from two points (lat1, lon1, lat2, lon2), the axes ``lons`` and ``lats`` in the rotated system round (lon_r, lat_r), of ni x nj core points dx and dy apart and the extension on every side that max_cfl asks for, and ``border``, its points a side."""
    n = extension(max_cfl)
    x, y = rotated_axes(F.lit(lon_r), F.lit(lat_r), F.col(dx), F.col(dy), F.col(ni), F.col(nj), n)
    return df.withColumns({"rotation": rotation(*(F.col(c) for c in points)), "lons": x, "lats": y, "border": F.lit(n)})


def extension(max_cfl: int, yin_yang: bool = False) -> int:
    """Points a side that a grid needs beyond its core."""
    return max_cfl + 5 + int(yin_yang) + 2


def wrap_kind(lons: Column) -> Column:
    """0 no wrap, 1 the axis goes round without repeating its start, 2 it repeats it."""
    n, first, last = F.size(lons), F.element_at(lons, 1), F.element_at(lons, -1)
    step = F.when(n > 1, F.element_at(lons, 2) - first)
    gap = first + 360 - last
    return F.when(F.abs(gap) <= 0.25 * step, 2).when(F.abs(gap) <= 1.5 * step, 1).otherwise(0)


def turned(first: tuple[Column, Column], last: tuple[Column, Column]) -> Column:
    """North is not up: the longitude changes by a step along the second axis, at the first or the last corner (each the longitudes at its ends)."""
    return (F.abs(first[0] - first[1]) > 0.0001) | (F.abs(last[0] - last[1]) > 0.0001)


def flags(grtyp: Column, lons: Column, not_up: Column | None = None) -> Column:
    """Bit mask of a grid by its type and longitudes, and whether north is not up (turned)."""
    w = wrap_kind(lons)
    bit = lambda c, f: F.when(c, FLAGS[f]).otherwise(0)
    return bit(grtyp.isin("Y", "X", "O", "M", "P"), "sparse") + bit(~grtyp.isin("Y", "X", "O", "M", "P"), "regular") + bit(grtyp == "#", "tile") + bit(w > 0, "wrap") + bit(w == 2, "repeat") + (bit(not_up & (grtyp != "V"), "north") if not_up is not None else F.lit(0)) + bit(grtyp == "V", "vertical") + bit(grtyp == "R", "radial") + bit(F.array_min(lons) < 0, "negative_lon")


def limits(coords: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bounding box of each grid's coordinates."""
    return coords.groupBy(*keys).agg(F.min(lat).alias("lat0"), F.min(lon).alias("lon0"), F.max(lat).alias("lat1"), F.max(lon).alias("lon1"))


def valid(lat0: Column, lat1: Column) -> Column:
    return (F.abs(lat0) <= 91) & (F.abs(lat1) <= 91)


def same(a: str, b: str, columns: list[str]) -> Column:
    """Null-safe equality of two references; point clouds are never the same."""
    out = F.col(f"{a}.grtyp") != "Y"
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def cells(grids: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each cell of grids with axis arrays ``lons`` and ``lats``: i, j, lon, lat."""
    g = grids.select(*keys, "lons", F.posexplode("lats").alias("j", "lat"))
    return g.select(*keys, "j", "lat", F.posexplode("lons").alias("i", "lon"))


def cell_dims(cells_: DataFrame, dlon: float, dlat: float, inverse: bool = False) -> DataFrame:
    """dx, dy and area in metres of cells (lat, lon) of a regular grid, or their inverses; in a row at the pole, where dx would be 0, it is pi dy over the number of cells of a row."""
    dx = expr.column(expr.haversine_rad("radians(lat)", f"radians(lon - {dlon / 2})", "radians(lat)", f"radians(lon + {dlon / 2})")) * expr.EARTH_RADIUS
    dy = expr.column(expr.haversine_rad(f"radians(lat - {dlat / 2})", "0E0", f"radians(lat + {dlat / 2})", "0E0")) * expr.EARTH_RADIUS
    c = cells_.withColumns({"dx": dx, "dy": dy}).withColumn("dx", F.when(F.abs("lat") >= 90 - 1e-9, F.col("dy") * (3.141592653589793 * dlon / 360)).otherwise(F.col("dx")))
    c = c.withColumn("area", F.col("dx") * F.col("dy"))
    return c.withColumns({k: F.lit(1.0) / F.nullif(F.col(k), F.lit(0.0)) for k in ("dx", "dy", "area")}) if inverse else c


def mesh_areas(triangles: DataFrame) -> DataFrame:
    """vertex and area: a third of the area on the sphere of each triangle (v0 to v2, their lon x0.. and lat y0..) for each of its vertices, summed."""
    a = expr.column(expr.spherical_triangle_area([(f"x{k}", f"y{k}") for k in range(3)])) / 3
    return triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex"), a.alias("a")).groupBy("vertex").agg(F.sum("a").alias("area"))


def axis_value(axis: Column, x: Column) -> Column:
    """The axis at a place between its points, from 0; its end steps go on outside."""
    k = F.greatest(F.lit(0), F.least(F.floor(x).cast("int"), F.size(axis) - 2))
    low = F.element_at(axis, k + 1)
    return low + (x - k) * (F.element_at(axis, k + 2) - low)


def axis_place(axis: Column, value: Column) -> Column:
    """The place on an ascending axis of a value: the inverse of axis_value."""
    k = F.greatest(F.lit(0), F.least(F.size(F.filter(axis, lambda a: a <= value)) - 1, F.size(axis) - 2))
    low = F.element_at(axis, k + 1)
    return k + (value - low) / F.nullif(F.element_at(axis, k + 2) - low, F.lit(0.0))


def project(df: DataFrame, x: str = "x", y: str = "y", rotation: tuple[float, float] | None = None) -> DataFrame:
    """df (axes lons and lats, a place x, y) with lat and lon; in a rotated grid's, turned back by rotation (theta, phi)."""
    d = df.withColumns({"_lon": axis_value(F.col("lons"), F.col(x)), "_lat": axis_value(F.col("lats"), F.col(y))})
    lat, lon = expr.unrotate("_lat", "_lon", *rotation) if rotation else ("_lat", "_lon")
    return d.withColumns({"lat": expr.column(lat), "lon": expr.column(lon)}).drop("_lat", "_lon")


def unproject(df: DataFrame, lat: str = "lat", lon: str = "lon", rotation: tuple[float, float] | None = None) -> DataFrame:
    """df (axes lons and lats, a point) with its place x, y and whether that is on the grid, half a cell round it included."""
    a, b = expr.rotate(lat, lon, *rotation) if rotation else (lat, lon)
    d = df.withColumns({"_lat": expr.column(a), "_lon": expr.column(b)})
    d = d.withColumns({"x": axis_place(F.col("lons"), F.col("_lon")), "y": axis_place(F.col("lats"), F.col("_lat"))}).drop("_lat", "_lon")
    return d.withColumn("on_grid", F.col("x").between(-0.5, F.size("lons") - 0.5) & F.col("y").between(-0.5, F.size("lats") - 0.5))


def index_box(df: DataFrame, keys: list[str], rotation: tuple[float, float] | None = None) -> DataFrame:
    """keys with i0, j0, i1, j1: the box of places of the corners of a box (lat0, lon0, lat1, lon1), held within the grid (axes lons and lats); the whole of an axis where the box goes round it."""
    corners = F.array(*[F.struct(F.col(a).alias("lat"), F.col(o).alias("lon")) for a in ("lat0", "lat1") for o in ("lon0", "lon1")])
    u = unproject(df.withColumn("_p", F.explode(corners)).withColumns({"_a": F.col("_p.lat"), "_o": F.col("_p.lon")}), "_a", "_o", rotation)
    g = u.groupBy(*keys).agg(
        *[F.min(c).alias(f"{n}0") for c, n in (("x", "i"), ("y", "j"))], *[F.max(c).alias(f"{n}1") for c, n in (("x", "i"), ("y", "j"))],
        F.first(F.size("lons") - 1).alias("ni"), F.first(F.size("lats") - 1).alias("nj"), F.max(F.abs(F.col("lon0") - F.col("lon1")) >= 359.99999999).alias("all_i"), F.max(F.abs(F.col("lat0") - F.col("lat1")) >= 179.99999999).alias("all_j"),
    )
    low = lambda n: F.when(F.col(f"all_{n}"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col(f"{n}0"))).alias(f"{n}0")
    high = lambda n: F.when(F.col(f"all_{n}"), F.col(f"n{n}").cast("double")).otherwise(F.least(F.col(f"n{n}").cast("double"), F.col(f"{n}1"))).alias(f"{n}1")
    return g.select(*keys, low("i"), low("j"), high("i"), high("j"))


def overlap(border: DataFrame, keys: list[str], rotation: tuple[float, float] | None = None) -> DataFrame:
    """keys with x0, y0, x1, y1: the window of whole places of a grid (axes lons and lats) that covers another, whose border points (lat, lon) are given; only points on the grid count, and no row means that none are."""
    u = unproject(border, rotation=rotation).filter("on_grid")
    inside = lambda c, axis: F.greatest(F.lit(0), F.least(c, F.size(axis) - 1)).cast("int")
    ends = {"x0": F.min(inside(F.floor("x"), "lons")), "y0": F.min(inside(F.floor("y"), "lats")), "x1": F.max(inside(F.ceil("x"), "lons")), "y1": F.max(inside(F.ceil("y"), "lats"))}
    return u.groupBy(*keys).agg(*[v.alias(k) for k, v in ends.items()])


def grid_bearing(lat: str, lon: str, lat_up: str, lon_up: str) -> Column:
    """Bearing of a grid's own north at a point: the course to the point one step up its axis, in degrees."""
    return -F.degrees(expr.column(expr.course(lat, lon, lat_up, lon_up)))


def quad_contains(x: str, y: str, corners: list[tuple[str, str]]) -> Column:
    """Point in a quadrilateral, by its two triangles."""
    out = F.lit(False)
    for t in ((0, 1, 2), (0, 2, 3)):
        b = [expr.column(w) for w in expr.barycentric(x, y, [corners[k] for k in t])]
        out = out | ((b[0] >= -1e-5) & (b[1] >= -1e-5) & (b[2] >= -1e-5))
    return out


def encode_text(text: Column) -> Column:
    """Codes of a text's characters."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def decode_text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.chr(c)), "")
