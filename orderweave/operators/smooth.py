"""Robust local regression of y on x, per group, without meeting every row at every grid point."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame

from orderweave.operators.distribution import quantiles, rank_values
from orderweave.operators.scan import Chunks, attach
from orderweave.session import pin, sql

#: Cells of a group at most, each with about the same number of rows, and rows of a cell at least.
CELLS, CELL_ROWS = 1_000, 32
# powers of the distance that the tricube weights (degree 9) and the squares of the regression need
_X, _Y = 12, 11


def _nearest(ranked: DataFrame, by, frac: float, points: int) -> DataFrame:
    """Per group and grid point the distance ``h`` within which ``frac`` of the rows lie.

    A window of k rows in order of x, from its first value to its last, holds the k rows nearest to a point in its middle.
    So a point needs the last window whose middle is not beyond it and the first whose middle is: the extremes of the
    windows per grid interval, carried on over the grid."""
    keys = ", ".join(by)
    share = f"greatest(2, floor({frac}D * total + 1e-10D))"
    starts = ranked.selectExpr(*by, "below as place", "0 as kind", "x", "x as first", "total")
    ends = ranked.where(f"below + {share} <= total").selectExpr(*by, f"below + {share} - 1 as place", "1 as kind", "cast(null as double) as x", "x as first", "total")
    found = Chunks(starts.unionByName(ends), by, ["place", "kind", "first"], "windows").scan(lasts={"last": "x"}).where("kind = 1")
    spans = pin(sql(f"select {keys}, min(x) as low, max(x) as high, max(total) as total, count(*) as n_values from {{r}} group by {keys} having max(x) > min(x)", r=ranked), "spans")
    windows = attach(found, spans.selectExpr(*by, "low", "high", "total as n_rows"), by, ["low", "high"], "first").where("low is not null")
    step = f"((high - low) / {points - 1})"
    return sql(
        f"""
        with marked as (
          select {keys}, cast(ceil(((first + last) / 2 - low) / {step}) as int) as after,
            cast(floor(((first + last) / 2 - low) / {step}) as int) as upto, first, last from {{windows}}
        ), sides as (
          select {keys}, after as point, max(first) as first, cast(null as double) as last from marked group by {keys}, after
          union all select {keys}, upto, null, min(last) from marked group by {keys}, upto
        ), grid as (
          select {keys}, low, total, low + point * {step} as g, point, {step} as step
          from {{spans}} lateral view explode(sequence(0, {points - 1})) as point
        ), edges as (
          select g.*, max(s.first) as first, min(s.last) as last
          from grid g left join sides s on {" and ".join(f"g.{k} <=> s.{k}" for k in by)} and g.point = s.point
          group by {", ".join(f"g.{k}" for k in by)}, g.low, g.total, g.g, g.point, g.step
        )
        select {keys}, point, low, step, total, g, greatest(1e-9D * step, least(
            coalesce(g - max(first) over (partition by {keys} order by point), double('Infinity')),
            coalesce(min(last) over (partition by {keys} order by point desc) - g, double('Infinity')))) as h
        from edges
        """,
        windows=windows,
        spans=spans,
    )


def _cells(ranked: DataFrame, by) -> DataFrame:
    """Distinct values with their cell, its centre and half its width."""
    keys = ", ".join(by)
    placed = ranked.selectExpr(*by, "x", f"cast(floor(below * greatest(1, least({CELLS}, total div {CELL_ROWS})) / total) as int) as cell")
    spans = sql(f"select {keys}, cell, min(x) as left_x, max(x) as right_x, count(*) as n_values from {{p}} group by {keys}, cell", p=placed)
    return attach(placed, spans, [*by, "cell"], ["left_x", "right_x"], "x", rows="n_values")


def _shifted(moments: str, n: int, name: str) -> str:
    """Sums of q**m for q = a + b u, from the sums of u**j."""
    return ", ".join(" + ".join(f"{comb(m, j)} * a{m - j} * b{j} * {moments}{j}" for j in range(m + 1)) + f" as {name}{m}" for m in range(n))


def _tricube(name: str, m: int) -> str:
    """(1 - t**3)**3 times q**m, where t is q to the right (side 1) and -q to the left (side -1)."""
    return f"({name}{m} - 3 * side * {name}{m + 3} + 3 * {name}{m + 6} - side * {name}{m + 9})"


def _fit(points_of: DataFrame, geometry: DataFrame, grid: DataFrame, by) -> DataFrame:
    """The curve at each grid point from rows (x, y, n, weight). Whole cells on one side of a point enter by their moments,
    exactly, as the weight is a polynomial there; only rows of the cells that a window or its middle cuts are met singly."""
    keys = ", ".join(by)
    on_cell = " and ".join([*[f"g.{k} <=> r.{k}" for k in by], "g.cell = r.cell"])
    own = ", ".join(f"g.{k}" for k in by)
    x_moments = [f"sum(w * pow(u, {j})) as m{j}" for j in range(_X)]
    y_moments = [f"sum(w * y * pow(u, {j})) as v{j}" for j in range(_Y)]
    moments = sql(
        f"""
        select {keys}, cell, {", ".join(x_moments + y_moments)}
        from (select *, n * weight as w, if(right_x > left_x, (x - (left_x + right_x) / 2) / ((right_x - left_x) / 2), 0D) as u from {{r}})
        group by {keys}, cell
        """,
        r=points_of,
    )
    powers = ", ".join(f"pow(a, {j}) as a{j}, pow(b, {j}) as b{j}" for j in range(_X))
    sums = sql(
        f"""
        with whole as (
          select {own}, g.point, g.h, g.side, ((g.left_x + g.right_x) / 2 - g.g) / g.h as a, (g.right_x - g.left_x) / 2 / g.h as b, r.*
            except ({keys}, cell)
          from {{geometry}} g join {{moments}} r on {on_cell} where g.side <> 0
        ), raised as (select *, {powers} from whole),
        shifted as (select {keys}, point, h, side, {_shifted("m", _X, "q")}, {_shifted("v", _Y, "z")} from raised),
        singly as (
          select {own}, g.point, g.h, r.y, r.x - g.g as dx, r.n * r.weight * pow(1 - pow(abs(r.x - g.g) / g.h, 3), 3) as w
          from {{geometry}} g join {{rows}} r on {on_cell} where g.side = 0 and abs(r.x - g.g) < g.h
        ), parts as (
          select {keys}, point, {_tricube("q", 0)} as sw, h * {_tricube("q", 1)} as sx, h * h * {_tricube("q", 2)} as sxx,
            {_tricube("z", 0)} as sy, h * {_tricube("z", 1)} as sxy from shifted
          union all select {keys}, point, w, w * dx, w * dx * dx, w * y, w * dx * y from singly
        )
        select {keys}, point, sum(sw) as sw, sum(sx) as sx, sum(sxx) as sxx, sum(sy) as sy, sum(sxy) as sxy from parts group by {keys}, point
        """,
        geometry=geometry,
        moments=moments,
        rows=points_of,
    )
    same = " and ".join([*[f"g.{k} <=> s.{k}" for k in by], "g.point = s.point"])
    return sql(
        f"""select {own}, g.point, g.g as grid_x, g.low, g.step, case when sw > 1e-12D then
              if(sw * sxx - sx * sx > 1e-9D * sw * sxx, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx), sy / sw) end as smooth
            from {{grid}} g left join {{sums}} s on {same}""",
        grid=grid,
        sums=sums,
    )


def _reweighted(rows: DataFrame, curve: DataFrame, by) -> DataFrame:
    """Rows with bisquare weights of their residuals from the curve, on the scale of six times the median one."""
    keys = ", ".join(by)
    lines = sql(
        f"""select {keys}, min(low) as low, min(step) as step, transform(array_sort(collect_list(struct(point, smooth))), p -> p.smooth) as line
            from {{c}} group by {keys}""",
        c=curve,
    )
    sizes = sql(f"select {keys}, count(*) as n_points from {{r}} group by {keys}", r=rows)
    lines = lines.join(sizes, [lines[k].eqNullSafe(sizes[k]) for k in by]).select(*[lines[k] for k in by], "low", "step", "line", "n_points")
    placed = attach(rows.drop("weight"), lines, by, ["low", "step", "line"], "x, y", rows="n_points")
    kept = [c for c in rows.columns if c != "weight"]
    residuals = sql(
        f"""
        select {", ".join(kept)}, abs(y - (line[i] + (line[i + 1] - line[i]) * ((x - low) / step - i))) as residual
        from (select *, cast(least(size(line) - 2, floor((x - low) / step)) as int) as i from {{p}} where line is not null)
        """,
        p=placed,
    )
    residuals = pin(residuals, "residuals")
    values = sql(f"select {keys}, residual as x, sum(n) as n from {{r}} where residual is not null group by {keys}, residual", r=residuals)
    ranked = Chunks(values, by, ["x"], "residual-values").scan(sums={"upto": "n"}, totals={"total": "n"}).selectExpr(*by, "x", "n", "upto - n as below", "total")
    scale = quantiles(ranked, by, {"middle": 0.5})
    found = attach(residuals, scale, by, ["middle"], "x, y", rows="total")
    weight = "case when residual is null or middle <= 1e-12D then 1D when residual < 6 * middle then pow(1 - pow(residual / (6 * middle), 2), 2) else 0D end"
    return found.selectExpr(*kept, f"{weight} as weight")


def local_smooth(pairs: DataFrame, by, frac: float = 0.3, points: int = 100, passes: int = 3) -> DataFrame:
    """Local-linear curve on an even grid: tricube weights over the ``frac`` of all rows nearest in x, refitted ``passes`` times
    with bisquare weights of the residuals. Rows with a null x or y, and groups with one x only, are left out.

    Work beyond sorting is that of distinct points, cells and grid: a row is met singly at the few grid points whose window begins,
    ends or has its middle in the row's cell."""
    keys = ", ".join(by)
    known = pairs.where("x is not null and y is not null")
    ranked = pin(rank_values(known, by, "x"), "ranked")
    grid = pin(_nearest(ranked, by, frac, points), "grid")
    cells = pin(_cells(ranked, by), "cells")
    distinct = pin(sql(f"select {keys}, x, y, count(*) as n from {{p}} group by {keys}, x, y", p=known), "points")
    values = sql(f"select {keys}, x, count(*) as n_points from {{d}} group by {keys}, x", d=distinct)
    on_x = [cells[k].eqNullSafe(values[k]) for k in by] + [cells["x"] == values["x"]]
    placed = cells.join(values, on_x).select(*[cells[c] for c in [*by, "x", "cell", "left_x", "right_x"]], values["n_points"])
    rows = attach(distinct, placed, [*by, "x"], ["cell", "left_x", "right_x"], "y", rows="n_points")
    rows = pin(rows.selectExpr("*", "1D as weight"), "rows")
    same = " and ".join(f"g.{k} <=> c.{k}" for k in by)
    geometry = pin(
        sql(
            f"""
            select {", ".join(f"g.{k}" for k in by)}, g.point, g.g, g.h, c.cell, c.left_x, c.right_x,
              case when left_x >= g and right_x <= g + h then 1 when right_x <= g and left_x >= g - h then -1 else 0 end as side
            from (select distinct {keys}, cell, left_x, right_x from {{cells}}) c join {{grid}} g on {same}
            where right_x > g.g - g.h and left_x < g.g + g.h
            """,
            cells=cells,
            grid=grid,
        ),
        "geometry",
    )
    curve = pin(_fit(rows, geometry, grid, by), "curve")
    for _ in range(passes):
        rows = pin(_reweighted(rows, curve, by), "rows")
        curve = pin(_fit(rows, geometry, grid, by), "curve")
    return curve.where("smooth is not null").select(*by, "point", "grid_x", "smooth")
