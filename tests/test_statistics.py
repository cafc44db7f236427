"""Scans and statistics against plain Python, with several chunks and forced hot groups."""

import math
import random
import statistics

import pytest

from orderweave.functions.columns import kolmogorov_tail, normal_cdf, normal_quantile
from orderweave.operators import dependence as dep
from orderweave.operators import distribution as dist
from orderweave.operators import lifetime, quality, scan
from orderweave.operators import microstructure as micro
from orderweave.session import CHUNKS_CONF

BY = ["g"]


@pytest.fixture(autouse=True)
def chunked(spark, monkeypatch):
    monkeypatch.setattr(scan, "HOT_ROWS", 5)
    monkeypatch.setattr(scan, "HOT_GROUPS", 3)
    spark.conf.set(CHUNKS_CONF, "6")
    yield
    spark.conf.unset(CHUNKS_CONF)


def points(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "big" if rng.random() < 0.7 else rng.choice("ab")
        x = 1.0 if rng.random() < 0.33 else rng.randrange(1, 60) / 4  # one value holds a third of the rows
        rows.append((g, i, x, rng.choice([0.0, 0.25, 0.5, 0.75]) + (0.25 if x > 8 else 0.0)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, row_no bigint, x double, y double").repartition(5)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_scan(spark):
    rows = points()
    chunks = scan.Chunks(frame(spark, rows), BY, ["row_no"])
    got = chunks.scan(
        sums={"run": "x"}, lasts={"seen": "if(y > 0.5, y, null)"}, lags={"prev": "row_no"}, totals={"whole": "x"}
    ).collect()
    want = {}
    for g, part in grouped(rows).items():
        run, seen, prev, whole = 0.0, None, None, sum(r[2] for r in part)
        for r in part:
            run += r[2]
            seen = r[3] if r[3] > 0.5 else seen
            want[r[1]] = (run, seen, prev, whole)
            prev = r[1]
    assert {r.row_no: (r.run, r.seen, r.prev, r.whole) for r in got} == want


def test_runs(spark):
    rows = points()
    got = scan.Chunks(frame(spark, rows), BY, ["row_no"]).runs("x = 1", "opens", "number").collect()
    want = {}
    for part in grouped(rows).values():
        inside, number = False, 0
        for r in part:
            opens = r[2] == 1 and not inside
            number += opens
            inside = r[2] == 1
            want[r[1]] = (opens, number)
    assert {r.row_no: (r.opens, r.number) for r in got} == want


def test_attach_keeps_every_row(spark):
    rows = points()
    df = frame(spark, rows)
    groups = df.groupBy("g", "x").count().selectExpr("g", "x", "count as n_rows", "x * 2 as twice")
    got = scan.attach(df, groups, ["g", "x"], ["twice"], "row_no", "x <> 1").collect()
    assert len(got) == len(rows)
    assert all(r.twice == (r.x * 2 if r.x != 1 or r.twice is not None else None) for r in got)
    assert all(r.twice == r.x * 2 for r in got if r.x != 1)


def test_quantiles_and_numbers(spark):
    rows = points()
    df = frame(spark, rows)
    got = dist.quantiles(dist.rank_values(df, BY, "x"), BY, {"a": 0.0, "b": 0.37, "c": 0.995, "d": 1.0}).collect()
    for r in got:
        values = sorted(v[2] for v in grouped(rows)[r.g])
        for q, v in ((0.0, r.a), (0.37, r.b), (0.995, r.c), (1.0, r.d)):
            at = q * (len(values) - 1)
            low = math.floor(at)
            high = min(low + 1, len(values) - 1)
            assert v == pytest.approx(values[low] + (values[high] - values[low]) * (at - low))
    numbered = dist.number_rows(df.withColumnRenamed("row_no", "i"), BY, ["x", "i"]).collect()
    for g, part in grouped(rows).items():
        order = sorted(part, key=lambda r: (r[2], r[1]))
        mine = sorted((r for r in numbered if r.g == g), key=lambda r: r.row_no)
        assert [r.x for r in mine] == [r[2] for r in order]


def sign(v):
    return (v > 0) - (v < 0)


def test_kendall_and_spearman(spark):
    rows = points()
    pairs = frame(spark, rows)
    tau = {r.g: r.kendall for r in dep.kendall(pairs, BY).collect()}
    rho = {r.g: r.spearman for r in dep.spearman(dep.average_ranks(pairs, BY), BY).collect()}
    for g, part in grouped(rows).items():
        net = x_pairs = y_pairs = 0
        for i, a in enumerate(part):
            for b in part[:i]:
                net += sign(a[2] - b[2]) * sign(a[3] - b[3])
                x_pairs += a[2] != b[2]
                y_pairs += a[3] != b[3]
        assert tau[g] == pytest.approx(net / math.sqrt(x_pairs * y_pairs))

        def ranks(values):
            return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

        rx, ry = ranks([r[2] for r in part]), ranks([r[3] for r in part])
        assert rho[g] == pytest.approx(statistics.correlation(rx, ry))


def test_constant_side_has_no_correlation(spark):
    pairs = spark.createDataFrame([("a", i, float(i), 1.0) for i in range(9)], "g string, row_no bigint, x double, y double")
    assert dep.kendall(pairs, BY).first().kendall is None
    assert dep.spearman(dep.average_ranks(pairs, BY), BY).first().spearman is None


def test_rolling_rate_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(dep, "_BLOCK", 20)
    rng = random.Random(3)
    rows = [("a", i, f"o{i}", 0, 1.0, 1.0, 1.0, rng.randrange(2)) for i in range(90)]
    orders = spark.createDataFrame(
        rows, "g string, ts bigint, order_id string, session_id int, price double, size double, abs_dist double, filled int"
    )
    got = dep.rolling_fill_rate(orders, BY, window=10, min_rows=7).orderBy("row_no").collect()
    for i, r in enumerate(got):
        near = [v[7] for v in rows[max(0, i - 5) : i + 5]]
        assert r.fill_prob == (pytest.approx(sum(near) / len(near)) if len(near) >= 7 else None)


def test_trimmed_mean_and_axes(spark):
    rows = points()
    df = frame(spark, rows)
    trimmed = {r.g: r.trimmed for r in dep.trimmed_mean(df, BY, "x", 0.05).collect()}
    axes = {r.g: r for r in dep.pca_2d(dep.mean_cov(df, BY, "x", "y"), BY).collect()}
    for g, part in grouped(rows).items():
        values = sorted(r[2] for r in part)
        k = int(0.05 * len(values))
        assert trimmed[g] == pytest.approx(statistics.fmean(values[k : len(values) - k]))
        a, b = statistics.variance(r[2] for r in part), statistics.variance(r[3] for r in part)
        c = statistics.covariance([r[2] for r in part], [r[3] for r in part])
        r = axes[g]
        assert r.eig1 + r.eig2 == pytest.approx(a + b) and r.eig1 * r.eig2 == pytest.approx(a * b - c * c)
        assert a * r.pc1_a + c * r.pc1_b == pytest.approx(r.eig1 * r.pc1_a)
        assert c * r.pc1_a + b * r.pc1_b == pytest.approx(r.eig1 * r.pc1_b)


def test_hill_counts_ties(spark):
    rows = points()
    got = {r.g: r for r in dist.hill_index(dist.rank_values(frame(spark, rows), BY, "x"), BY).collect()}
    for g, part in grouped(rows).items():
        top = sorted((r[2] for r in part), reverse=True)
        k = max(50, int(0.05 * len(top)))
        if len(top) <= k:
            assert got[g].hill_alpha is None
        else:
            mean = statistics.fmean(math.log(v) for v in top[:k]) - math.log(top[k])
            assert got[g].hill_alpha == pytest.approx(1 / mean)


def test_normal_functions(spark):
    normal = statistics.NormalDist()
    zs = [-38.5, -8.2, -7.0, -3.3, -1.0, -1e-3, 0.0, 0.4, 2.5, 6.9, 7.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.selectExpr("z", f"{normal_cdf('z')} as p").collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-8, abs=1e-15)
    ps = [1e-9, 1e-4, 0.02, 0.024, 0.3, 0.5, 0.8, 0.976, 0.99999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.selectExpr("p", f"{normal_quantile('p')} as q").collect():
        assert r.q == pytest.approx(normal.inv_cdf(r.p), rel=2e-9, abs=1e-9)
    # known points of the Kolmogorov distribution
    df = spark.createDataFrame([(1.3581,), (1.6276,), (0.1,)], "t double")
    tails = [r.p for r in df.selectExpr(f"{kolmogorov_tail('t')} as p").collect()]
    assert tails == pytest.approx([0.05, 0.01, 1.0], abs=2e-5)


EV = (
    "order_id string, session_id int, symbol string, source string, side string, event_type string, event_seq int,"
    " ts bigint, price double, size double, remaining_size double, reason string"
)


def ev(seq, kind="ADD", oid="1", size=1.0, remaining=0.0, ts=None, side="BID", symbol="X", reason=None):
    return (oid, 0, symbol, "S", side, kind, seq, 1000 + (seq if ts is None else ts), 100.0, size, remaining, reason)


def life_of(spark, *rows):
    return lifetime.lifetimes(spark.createDataFrame(list(rows), EV)).collect()


def test_lifetime_cases(spark):
    filled = life_of(
        spark, ev(0, size=5.0), ev(1, "FILL", size=2.0, reason="PARTIAL_FILL"), ev(2, "FILL", size=3.0, reason="FULL_FILL")
    )[0]
    assert (filled.outcome, filled.fill_count, filled.partial_fill_count, filled.total_filled_size) == ("FILLED", 2, 1, 5.0)
    assert (filled.duration_ns, filled.cancel_size, filled.anomalies) == (2, 0.0, "")
    cancelled = life_of(spark, ev(0), ev(1, "MODIFY"), ev(2, "CANCEL", size=4.0))[0]
    assert (cancelled.outcome, cancelled.cancel_size, cancelled.modify_count) == ("CANCELLED", 4.0, 1)
    alive = life_of(spark, ev(0))[0]
    assert (alive.outcome, alive.died_ts, alive.duration_ns) == ("OPEN_AT_EOD", None, None)
    assert life_of(spark, ev(1, "FILL")) == []
    odd = life_of(spark, ev(0), ev(0, "ADD", ts=5), ev(3, "FILL", size=9.0, remaining=-1.0))[0]
    assert odd.anomalies == "MULTI_ADD|OVERFILL|NEG_REMAINING|BAD_SEQ"
    swapped = [ev(s, "MODIFY") for s in (0, 0, 3, 4, 4, 5, 5, 7)]  # same sums as 0..7
    assert life_of(spark, ev(0), *swapped[1:])[0].anomalies == "BAD_SEQ"


def test_checks_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(quality, "_SEQ_BLOCK", 4)
    rows = [ev(s, "MODIFY" if s else "ADD") for s in range(12)]
    late = [ev(s, "MODIFY" if s else "ADD", oid="2", ts=2 if s == 8 else s) for s in range(12)]
    clean = spark.createDataFrame(rows, EV)
    assert quality.validation_report(clean).where("not passed").count() == 0
    found = quality.violations(spark.createDataFrame(rows + late, EV)).collect()
    assert [(r.check, r.order_id) for r in found] == [("CHECK_TS_ORDER", "2")]
    empty = quality.validation_report(clean.where("false")).collect()
    assert len(empty) == 9 and all(r.passed and r.total_rows == 0 for r in empty)


def test_midprice_carries_forward(spark):
    rows = [ev(0, ts=1), ev(0, oid="2", ts=2, side="ASK"), ev(1, "FILL", ts=3), ev(0, oid="3", ts=2, side=None)]
    events = spark.createDataFrame(rows, EV)
    line = {r.ts: r.midprice for r in micro.midprice_timeline(events, ["symbol"]).collect()}
    assert line == {1001: None, 1002: 100.0, 1003: 100.0}
    orders = micro.placed_orders(events, ["symbol"]).collect()
    assert sorted((r.order_id, r.filled) for r in orders) == [("2", 0), ("3", 0)]


def test_sample_is_stable(spark):
    df = frame(spark, points())
    one = {r.row_no for r in dep.sample_rows(df, 50, ["row_no"]).collect()}
    two = {r.row_no for r in dep.sample_rows(df.repartition(3), 50, ["row_no"]).collect()}
    assert one == two and len(one) == 50


@pytest.mark.parametrize("spread,outlier", [(1.0, None), (1e-6, None), (1.0, 1e9), (1.0, -1e5)])
def test_density_from_cell_moments(spark, spread, outlier):
    """The series gives what a sum over all values gives, also far from the bulk and on a coarse grid."""
    import numpy as np

    rng = random.Random(8)
    x = [rng.gauss(0, spread) + (5 * spread if i % 7 == 0 else 0) for i in range(900)] + [0.25 * spread] * 50 + ([outlier] if outlier else [])
    df = spark.createDataFrame([("g", v) for v in x], "g string, x double")
    for low_q, high_q, points in ((None, None, 60), (0.9, None, 40), (None, 0.995, 200)):
        got = dist.kde(dist.rank_values(df, ["g"], "x"), ["g"], points, high_q=high_q, low_q=low_q).orderBy("point").collect()
        used = np.array([v for v in x if low_q is None or v > np.quantile(x, low_q)])
        h = used.std(ddof=1) * len(used) ** -0.2
        grid = np.linspace(np.quantile(x, low_q or 0), np.quantile(x, high_q or 1), points)
        want = np.exp(-0.5 * ((grid[:, None] - used) / h) ** 2).sum(1) / (len(used) * h * np.sqrt(2 * np.pi))
        assert np.allclose([r.grid_x for r in got], grid, rtol=1e-12, atol=1e-12 * np.abs(grid).max())
        assert np.allclose([r.density * h for r in got], want * h, rtol=0, atol=1e-9 if outlier is None else 1e-7)
        reference = dist.normal_on_grid(dist.rank_values(df, ["g"], "x"), ["g"], points, high_q=high_q, low_q=low_q).orderBy("point").collect()
        assert np.allclose([r.normal_density for r in reference], [r.normal_density for r in got], rtol=1e-9)


def test_density_of_one_repeated_end(spark):
    """The quantiles that end the grid coincide: every point is the same."""
    df = spark.createDataFrame([("g", v) for v in [1.0] * 500 + [9.0]], "g string, x double")
    got = dist.kde(dist.rank_values(df, ["g"], "x"), ["g"], 5, high_q=0.5).collect()
    assert len(got) == 5 and len({(r.grid_x, round(r.density, 9)) for r in got}) == 1 and got[0].density > 0


@pytest.mark.parametrize("most", [20_000, 2])
def test_rare_flags_are_looked_up(spark, monkeypatch, most):
    """Numbers from sorted marks equal those of a scan in ranges, which takes over beyond the limit."""
    monkeypatch.setattr(scan, "MOST_MARKS", most)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.random() < 0.06) for i in range(400)] + [("c", 1000, False)]
    rows += [("d", i, i < 3) for i in range(2000, 2006)]
    df = spark.createDataFrame(rows, "k string, at long, f boolean").repartition(5)
    found = scan.run_numbers(df, "f", ["k"], ["at"], "opens", "number")
    if most == 2:
        assert found is None and scan.marks_so_far(df, "f", ["k"], ["at"], "n") is None
        return
    want = scan.Chunks(df, ["k"], ["at"]).runs("f", "opens", "number")
    columns = ["k", "at", "opens", "number"]
    assert sorted(map(repr, found.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    sums = scan.Chunks(df, ["k"], ["at"]).scan(sums={"n": "if(f, 1, 0)"}).select("k", "at", "n").collect()
    assert sorted(map(repr, scan.marks_so_far(df, "f", ["k"], ["at"], "n").select("k", "at", "n").collect())) == sorted(map(repr, sums))
    assert "RangePartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_lifetimes_by_bitmap_and_by_distinct_count(spark, monkeypatch):
    """One exchange while numbers are small; the same table either way."""
    rng = random.Random(12)
    kinds = ["ADD", "FILL", "MODIFY", "CANCEL"]
    rows = [(str(rng.randrange(60)), 0, "X", "S", "BID", rng.choice(kinds), rng.randrange(rng.choice([3, 70, 500])), i, 1.0, 1.0, 1.0, None) for i in range(900)]
    rows += [("clean", 0, "X", "S", "BID", kinds[0] if i == 0 else "FILL", i, i, 1.0, 0.0, 1.0, None) for i in range(512)]
    schema = "order_id string, session_id int, symbol string, source string, side string, event_type string, event_seq int, ts bigint, price double, size double, remaining_size double, reason string"
    events = spark.createDataFrame(rows, schema)
    short = lifetime.lifetimes(events)
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    monkeypatch.setattr(lifetime, "SEQ_BITS", 64)
    longer = lifetime.lifetimes(events)
    assert longer._jdf.queryExecution().executedPlan().toString().count("Exchange ") > 1
    got = sorted(map(repr, short.collect()))
    assert got == sorted(map(repr, longer.collect()))
    bad = {r.order_id: r.anomalies for r in short.collect()}
    assert bad["clean"] == "" and any("BAD_SEQ" in a for a in bad.values())


@pytest.mark.parametrize("window", [1, 2, 7, 30])
def test_rolling_rate_by_running_counts(spark, monkeypatch, window):
    monkeypatch.setattr(dep, "_BLOCK", 40)
    rng = random.Random(window)
    rows = [("a" if i % 3 else None, i, "o", 0, 1.0, 1.0, rng.choice([0, 1, 1, None]), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts long, order_id string, session_id int, price double, size double, filled int, abs_dist double")
    got = dep.rolling_fill_rate(df, ["symbol"], window, 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # frames that slide go through the whole window again for each row
    assert not any(f"specifiedwindowframe(RowFrame, -{n}, {m})" in plan for n in range(1, 40) for m in range(40))
    want = {}
    for symbol in ("a", None):
        mine = [r for r in rows if r[0] == symbol]
        for i, r in enumerate(mine):
            near = [x[6] for x in mine[max(0, i - window // 2) : i + window - window // 2] if x[6] is not None]
            want[symbol, r[1]] = sum(near) / len(near) if near else None
    assert {(r.symbol, r.ts): r.fill_prob for r in got.collect()} == want
