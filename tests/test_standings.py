"""Standings operators: worked examples, identity and filter cases, and SQL twins."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from podium.functions import metrics, rating, text
from podium.operators import cells as C, export, fixedpoint as fp, identity as ident, irt, queries, registry, validate
from podium.plans import iterate
from podium.plans.components import connected_components
from podium.plans.ranks import numbered
from podium.plans.scratch import Scratch
from podium.sources import reference_ratings, standings, views

FIELD = [2400.0, 2200.0, 2000.0, 1800.0, 1600.0]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def array(values):
    return F.array(*[F.struct(F.lit(v).alias("theta"), F.lit(1.0).alias("w")) for v in values])


@pytest.mark.parametrize("target, want", [(3, 1887.92442), (1, 2361.33431), (5, 800.0), (0, 4000.0)])
def test_weighted_rating(spark, target, want):
    got = spark.range(1).select(rating.weighted_rating(array(FIELD), F.lit(float(target))).alias("b")).first()["b"]
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("rank, want", [(2, 2349.66489), (1, 4000.0), (6, 800.0)])
def test_performance_rating(spark, rank, want):
    rivals = [t for t in FIELD if t != 1800.0]
    got = spark.range(1).select(rating.performance_rating(F.lit(rank), array(rivals)).alias("b")).first()["b"]
    assert got == pytest.approx(want, abs=1e-4)


def exact_inversion(theta, rank, halvings=25):
    """The same bisection on the sum over all rivals."""
    lo, hi = np.full(len(theta), rating.LO), np.full(len(theta), rating.HI)
    places = lambda b: fp.expected(theta[None, :], b[:, None]).sum(1) - fp.expected(theta, b)
    at_lo, at_hi = places(lo) <= rank - 1, places(hi) >= rank - 1
    for _ in range(halvings):
        mid = (lo + hi) / 2
        above = places(mid) > rank - 1
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(at_lo, rating.LO, np.where(at_hi, rating.HI, (lo + hi) / 2))


@pytest.mark.parametrize("n", [1, 5, 200, 900])
def test_field_inversion_is_exact_at_every_size(n):
    rng = np.random.default_rng(n)
    theta, rank = rng.normal(2000, 300, n), rng.permutation(n) + 1
    assert fp.invert_field(theta, rank) == pytest.approx(exact_inversion(theta, rank), abs=2e-4)
    fine = fp.invert_curve(fp.field_curve(theta, np.ones(n)), rank - 1.0, lambda b: -fp.expected(theta, b), halvings=45)
    assert fine == pytest.approx(exact_inversion(theta, rank, halvings=45), abs=1e-6)


def test_a_large_field_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(fp, "SALT_ROWS", 100)
    monkeypatch.setattr(fp, "HELD", 1)
    rng = np.random.default_rng(0)
    rows = [(c, t, t, r + 1) for c, n in ((1, 700), (2, 3)) for t, r in enumerate(rng.permutation(n).tolist())]
    theta = rng.normal(2000, 300, 700)
    got = fp.performance_ratings(spark.createDataFrame(rows, "contest_id long, team long, row long, rank int").repartition(5), spark.createDataFrame(list(enumerate(theta.tolist())), "team long, theta double"))
    got = {(r.contest_id, r.team): r.perf for r in got.collect()}
    for c, n in ((1, 700), (2, 3)):
        rank = np.array([r for k, _, _, r in rows if k == c])
        assert [got[(c, t)] for t in range(n)] == pytest.approx(exact_inversion(theta[:n], rank), abs=2e-4)


def test_identity_cases(spark):
    rows = spark.createDataFrame(
        [
            (1, "acc-1", ["B", "A"]), (2, "$DEFAULT_7", ["A", "B"]), (3, "acc-1", None), (1, "$DEFAULT_7", None), (3, "$DEFAULT_7", None),
            (1, "$DEFAULT_8", ["A"]), (1, "x", ["A", "A"]), (4, "acc-2", ["A", "B"]), (5, "acc-2", ["C", "D"]), (6, "acc-9", None),
        ],
        "contest_id long, team_id string, members array<string>",
    )
    got = {(r.contest_id, r.team_id): r.team_key for r in ident.with_team_key(rows, ident.identities(ident.identity_edges(rows))).collect()}
    same = {got[k] for k in ((1, "acc-1"), (2, "$DEFAULT_7"), (3, "acc-1"), (4, "acc-2"), (5, "acc-2"))}
    assert same == {"mem:A|B"}
    assert got[(1, "$DEFAULT_7")] == "dj:1::$DEFAULT_7" and got[(3, "$DEFAULT_7")] == "dj:3::$DEFAULT_7"
    assert got[(1, "$DEFAULT_8")] == "dj:1::$DEFAULT_8" and got[(1, "x")] == "mem:A|A" and got[(6, "acc-9")] == "id:acc-9"


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    extra = spark.createDataFrame([(1000, 1001), (1001, 1001), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(chain.unionByName(extra)).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert connected_components(chain.where("false")).count() == 0


def test_contest_components_of_all_kept_rows(spark, sf):
    rows = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (13, 8), (4, 9), (15, 9), (6, 5)], "contest_id long, team long")
    got = {r.contest_id: (r.component, r["size"]) for r in ident.contest_components(rows, ident.contest_pairs(rows, "team")).collect()}
    assert got == {1: (0, 3), 2: (0, 3), 13: (0, 3), 4: (1, 2), 15: (1, 2), 6: (2, 1)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    kept = {(r.contest_id, r.team) for r in queries.kept_rows(queries.v1(spark, sf)).collect()}
    first = {}
    for c, t in sorted(kept):
        root[find(c)] = find(first.setdefault(t, c))
    groups = {}
    for c in {c for c, _ in kept}:
        groups.setdefault(find(c), []).append(c)
    want = {c: (k, len(g)) for k, g in enumerate(sorted(groups.values(), key=lambda g: (-len(g), min(g)))) for c in g}
    got = {r.contest_id: (r.component, r["size"]) for r in registry.queries()["contest_components"](spark, sf).collect()}
    assert got == want


def plain_survival(obs, prior, eps=0.5):
    """(theta, b) by key of (contest, team, label, y, rho), by the same Newton steps in numpy."""
    teams, probs = sorted({o[1] for o in obs}), sorted({(o[0], o[2]) for o in obs})
    t, p = np.array([teams.index(o[1]) for o in obs]), np.array([probs.index((o[0], o[2])) for o in obs])
    y, rho = np.array([float(o[3]) for o in obs]), np.array([o[4] for o in obs])
    scale, prec = 400 / np.log(10), 1 / 400**2
    mu = np.array([prior.get(k, 2000.0) for k in teams])
    theta, b = np.full(len(teams), 2000.0), np.full(len(probs), 2000.0)
    for _ in range(500):
        was = theta, b
        h = np.log(2) * np.exp((theta[t] - b[p]) / scale) * rho
        theta = np.clip(theta + (np.bincount(t, y - h) / scale - prec * (theta - mu)) / (np.bincount(t, h) / scale**2 + prec), 800, 4000)
        h = np.log(2) * np.exp((theta[t] - b[p]) / scale) * rho
        b = np.clip(b + (-np.bincount(p, y - h) / scale - prec * (b - 2000)) / (np.bincount(p, h) / scale**2 + prec), 800, 4000)
        if max(np.abs(theta - was[0]).max(), np.abs(b - was[1]).max()) < eps:
            return dict(zip(teams, theta)), dict(zip(probs, b))
    raise AssertionError("no convergence")


def test_season_trial(spark):
    rng = np.random.default_rng(6)
    # contests 4, 5, 7 share teams, 10 stands alone; teams 1 and 2 are one key
    cells = [(c, t, k, int(rng.random() < 0.75 - 0.15 * k), float(rng.integers(60, 9000))) for c, ts in ((4, (1, 3, 5)), (5, (2, 3, 6)), (7, (1, 2, 6)), (10, (8, 9))) for t in ts for k in range(4)]
    cells = [(c, t, k, 1 if k == 0 else y, tau if y or k == 0 else None) for c, t, k, y, tau in cells]
    key = {t: "mem:1|2" if t < 3 else f"id:{t}" for t in range(1, 10)}
    rows = sorted({(c, t, key[t]) for c, t, *_ in cells})
    rating = {(c, k): 800.0 + (c * 7 + k * 131) % 2400 for c, _, k, *_ in cells}
    got = queries.trial(
        spark.createDataFrame(rows, "contest_id long, team long, team_key string"), spark.createDataFrame(cells, "contest_id long, team long, label long, y int, tau double"),
        spark.createDataFrame([(*p, v) for p, v in rating.items()], "contest_id long, label long, rating double"),
    ).first()
    length = {c: max(x[4] for x in cells if x[0] == c and x[3]) for c in (4, 5, 7, 10)}
    obs = [(c, key[t], k, y, tau / length[c] if y else 1.0) for c, t, k, y, tau in cells]
    _, b = plain_survival(obs, plain_survival([o for o in obs if o[0] % 4 == 0], {})[0])
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"))
    probs = sorted(b)
    x, y = np.array([b[p] for p in probs]), np.array([rating[p] for p in probs])
    out = []
    for c in length:
        left = np.array([p[0] != c for p in probs])
        out.append(np.polyval(np.polyfit(x[left], y[left], 1), x[~left]) - y[~left])
    lab = [(sum(p) % 7, b[p]) for p in probs if p[0] % 3 and sum(p) % 7 < 5]
    assert (got.teams, got.contests, got.components, got.largest) == (6, 4, 2, 3)
    assert got.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-4)
    assert got.loco_rmse == pytest.approx(np.sqrt(np.mean(np.concatenate(out) ** 2)), abs=0.05)
    assert got.level_spearman == pytest.approx(np.corrcoef(rank([v for v, _ in lab]), rank([v for _, v in lab]))[0, 1], abs=1e-4)


def plain_fixedpoint(rows, prior=None, eps=0.5):
    """Team to theta of (contest, team, rank), to convergence."""
    teams = sorted({t for _, t, _ in rows})
    c, t, rank = np.array([x[0] for x in rows]), np.array([teams.index(x[1]) for x in rows]), np.array([float(x[2]) for x in rows])
    n = np.bincount(t)
    w = 1 - 0.9**n
    mu, strength = (np.array([(prior or {}).get(k, (2000.0, 1.0))[i] for k in teams]) for i in (0, 1))
    theta = np.full(len(teams), 2000.0)
    for _ in range(100):
        perf = np.zeros(len(rows))
        for k in np.unique(c):
            perf[c == k] = exact_inversion(theta[t[c == k]], rank[c == k])
        was, theta = theta, np.clip((w * np.bincount(t, perf) + strength * mu) / (w * n + strength), 800, 4000)
        if np.abs(theta - was).max() < eps:
            return dict(zip(teams, theta)), dict(zip(teams, w * n))
    raise AssertionError("no convergence")


def test_fixedpoint_queries_converge(spark, sf):
    rows = [(r.contest_id, r.team, r["rank"]) for r in queries.kept_rows(queries.v1(spark, sf)).collect()]
    theta, _ = plain_fixedpoint(rows)
    got = {r.team: r.theta for r in registry.queries()["fixedpoint_theta"](spark, sf).collect()}
    assert got == pytest.approx(theta, abs=0.02)
    first, s = plain_fixedpoint([x for x in rows if x[0] % 4 == 0])
    theta, _ = plain_fixedpoint([x for x in rows if x[0] % 4], {t: ((2000 + s[t] * v) / (1 + s[t]), 1 + s[t]) for t, v in first.items()})
    got = {r.team: r.theta for r in registry.queries()["fixedpoint_anchored"](spark, sf).collect()}
    assert got == pytest.approx(theta, abs=0.02)


def test_twopl_queries_converge(spark, sf):
    obs = [(r.contest_id, r.team, r.label, r.y) for r in queries.kept(spark, sf).collect()]
    teams, probs = sorted({o[1] for o in obs}), sorted({(o[0], o[2]) for o in obs})
    t_at, p_at = {k: i for i, k in enumerate(teams)}, {k: i for i, k in enumerate(probs)}
    t, p, y = np.array([t_at[o[1]] for o in obs]), np.array([p_at[(o[0], o[2])] for o in obs]), np.array([float(o[3]) for o in obs])
    theta, b, g, scale, prec = np.full(len(teams), 2000.0), np.full(len(probs), 2000.0), np.zeros(len(probs)), 400 / np.log(10), 1 / 400**2
    for it in range(400):
        was = theta, b, g
        d = np.exp(g)[p] / scale
        q = lambda: 1 / (1 + np.exp(-d * (theta[t] - b[p])))
        theta = np.clip(theta + (np.bincount(t, d * (y - q())) - prec * (theta - 2000)) / (np.bincount(t, d * d * q() * (1 - q())) + prec), 800, 4000)
        b = np.clip(b + (-np.bincount(p, d * (y - q())) - prec * (b - 2000)) / (np.bincount(p, d * d * q() * (1 - q())) + prec), 800, 4000)
        if it >= 15:
            eta = d * (theta[t] - b[p])
            g = np.clip(g + (np.bincount(p, (y - q()) * eta) - 4 * g) / (np.bincount(p, q() * (1 - q()) * eta**2) + 4), -1.5, 1.5)
            if max(np.abs(theta - was[0]).max(), np.abs(b - was[1]).max()) < 0.5 and np.abs(g - was[2]).max() < 0.005:
                break
    got = {(r.contest_id, r.label): (r.b, r.alpha) for r in registry.queries()["twopl_alpha"](spark, sf).collect()}
    assert it > 15 and set(got) == set(probs)
    assert [got[k][0] for k in probs] == pytest.approx(b, abs=0.01) and [got[k][1] for k in probs] == pytest.approx(np.exp(g), abs=1e-3)
    names = ("North", "South", "East", "West", "Centre")
    for r in registry.queries()["twopl_region_quantiles"](spark, sf).collect():
        alpha = np.exp(g)[[names[c % 5] == r.region for c, _ in probs]]
        assert r.n == len(alpha) and [r.q25, r.q50, r.q75, r.q90] == pytest.approx(np.quantile(alpha, [0.25, 0.5, 0.75, 0.9]), abs=1e-3)


def test_a_stopped_fit_is_an_error(spark):
    cells = spark.createDataFrame([(1, t, k, int(t > k)) for t in range(5) for k in range(4)], "contest_id long, team long, label long, y int")
    with pytest.raises(RuntimeError, match="not converged after 1 steps"):
        queries.converged(irt.fit)(cells, "rasch", max_iter=1)


def test_whole_fits_take_as_many_steps_as_they_need(spark):
    rng = np.random.default_rng(3)
    y = (rng.random((100, 20)) < 0.4).astype(int)
    cells = spark.createDataFrame([(1, t, p, int(y[t, p])) for t in range(100) for p in range(20)], "contest_id long, team long, label long, y int")
    theta, b, history, _ = queries.converged(irt.fit_2pl)(cells, eps=1e-7, eps_g=1e-9)
    assert len(history) > 400
    # the posterior is flat there
    theta = np.array([r.theta for r in theta.orderBy("team").collect()])
    b, alpha = np.array([(r.b, r.alpha) for r in b.orderBy("label").collect()]).T
    eta = alpha / rating.S * (theta[:, None] - b)
    res = y - 1 / (1 + np.exp(-eta))
    assert (res * alpha).sum(1) / rating.S == pytest.approx((theta - 2000) / 400**2, abs=1e-8)
    assert -res.sum(0) * alpha / rating.S == pytest.approx((b - 2000) / 400**2, abs=1e-8)
    slope, inner = (res * eta).sum(0) - np.log(alpha) / 0.5**2, np.abs(np.log(alpha)) < irt.G_BOUND - 1e-9
    assert slope[inner] == pytest.approx(0, abs=1e-5) and (slope * np.log(alpha))[~inner].min(initial=0) >= 0


def test_only_stalled_fits_are_given_up(monkeypatch):
    changes = [*np.linspace(9, 2, 700), *np.linspace(5, 0.1, 700)]  # they rise on the way
    step = lambda it, state: ({"n": it}, changes[it])
    assert iterate.repeat(step, {}, None, 0.5)[2]
    monkeypatch.setattr(iterate, "STALLED", 5)
    state, history, converged = iterate.repeat(lambda it, state: ({"n": it}, 2.0 if it > 3 else 3.0), {}, None, 0.5)
    assert not converged and state["n"] == 9 and len(history) == 10


def contest(cid, times, name="Round", year=2024, problems=None):
    cell = lambda t: {"solved": t is not None, "time_seconds": t}
    return {"contest_id": cid, "contest_name": name, "year": year, "problems": problems if problems is not None else [{"problem_label": "A", "problem_id": "1", "problem_name": "a"}], "standings": [{"rank": i + 1, "team_id": f"t{i}", "problems": {"A": cell(t), "Z": cell(5.0)} if t != "none" else None} for i, t in enumerate(times)]}


def test_scan_filter_and_flatten(spark, tmp_path):
    one, two = tmp_path / "a.json", tmp_path / "b.json"
    one.write_text(json.dumps([contest(1, [12599.0]), contest(2, [12600.0, None, "none"])]))
    two.write_text(json.dumps([contest(2, [5.0], problems=[]), contest(3, [0.0], "World Finals", 2026)]))
    raw = standings.dedupe_contests(standings.scan_contests(spark, [str(one), str(two)]))
    assert {r.contest_id: len(r.problems) for r in raw.collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.contest_id for r in C.short_contests_out(raw, 3.5).collect()} == {2}
    rows, problems = C.row_table(raw), C.problem_table(raw)
    flat = C.cell_table(rows, problems).collect()
    assert {(r.contest_id, r.row, r.label, r.y) for r in flat} == {(1, 0, "A", 1), (2, 0, "A", 1), (2, 1, "A", 0), (3, 0, "A", 1)}
    assert {r.contest_id: r.s for r in raw.select("contest_id", text.season_of("year", "contest_name").alias("s")).collect()} == {1: 2024, 2: 2024, 3: 2025}
    bad = tmp_path / "c.json"
    bad.write_text(json.dumps([{**contest(9, [1.0]), "standings": [{"team_id": "t", "problems": {"A": {"solved": True}}}]}]))
    with pytest.raises(Exception, match="no rank"):
        C.row_table(standings.scan_contests(spark, str(bad))).collect()


def test_auxiliary_inputs(spark, tmp_path):
    (tmp_path / "cf.json").write_text(json.dumps([{"contestId": 1, "name": "A b!", "rating": 900}, {"contestId": 1, "name": "a B", "rating": 1000}, {"contestId": 1, "name": "x"}]))
    (tmp_path / "u.txt").write_text("https://x/contest/12/problem\nnothing\n")
    (tmp_path / "k.json").write_text(json.dumps({"k1": {"name": "Foo  Bar", "difficulty": 2.5}, "k2": {"name": "foo-bar", "difficulty": 3.0}}))
    assert [tuple(r) for r in standings.cf_problemset(spark, str(tmp_path / "cf.json")).collect()] == [(1, "ab", 1000)]
    assert [r[0] for r in standings.url_list(spark, str(tmp_path / "u.txt")).collect()] == [12]
    assert [tuple(r) for r in standings.kattis_map(spark, str(tmp_path / "k.json")).collect()] == [("foobar", 3.0)]
    with pytest.raises(FileNotFoundError):
        standings.ratings(spark, {"m": str(tmp_path / "none.json")})


def test_metric_toys(spark):
    df = spark.createDataFrame([(i, float(i), float(6 - i), 1.0) for i in range(1, 6)], "k long, x double, y double, c double")
    assert metrics.spearman(df, "x", "y", ties=["k"]).first().rho == pytest.approx(-1)
    assert metrics.spearman(df, "c", "y", ties=["k"]).first().rho is None
    assert metrics.spearman(df.where("k < 4"), "x", "y", ties=["k"], least=4).first().rho is None
    p = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert metrics.holdout_metrics(p, "y", "p").first().auc == pytest.approx(0.75)
    sure = spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, p double")
    assert metrics.holdout_metrics(sure, "y", "p").first().log_loss == pytest.approx(1e-6, rel=1e-2)
    assert [r.bin for r in metrics.calibration_bins(spark.createDataFrame([(1, 0.3)], "y int, p double"), "y", "p").collect()] == [2]


def test_times_order_survival_but_not_binary(spark):
    rows = []
    for t in range(12):
        for label, late in (("J", 0.2), ("K", 0.9)):
            rows.append((1, t, label, int(t < 6), 10000.0 * late if t < 6 else None))
        rows.append((1, t, "L", int(t == 0), 10000.0 if t == 0 else None))
    obs = C.exposure(spark.createDataFrame(rows, "contest_id long, team long, label string, y int, tau double"))
    binary = {r.label: r.b for r in irt.fit(obs, "rasch", eps=0.5)[1].collect()}
    theta, b, history, converged = irt.fit(obs, "survival", eps=0.5)
    b = {r.label: r.b for r in b.collect()}
    assert converged and history[-1] < 0.5
    assert binary["J"] == pytest.approx(binary["K"], abs=1e-6) and b["K"] > b["J"] + 20 and b["L"] > b["J"]


def test_fixedpoint_converges_and_flat_prior_is_neutral(spark):
    rows = spark.createDataFrame([(c, t, t, t + 1) for c in range(6) for t in range(8)], "contest_id long, team long, row long, rank int")
    theta, _, history, converged = fp.estimate(rows, eps=0.5)
    got = [r.theta for r in theta.orderBy("team").collect()]
    assert converged and history[-1] < 0.5 and got == sorted(got, reverse=True)


def test_rate_problems_without_field(spark):
    problems = spark.createDataFrame([(1, "A"), (2, "A")], "contest_id long, label string")
    rows = spark.createDataFrame([(1, 7)], "contest_id long, team long")
    cells = spark.createDataFrame([(1, 7, "A", 1)], "contest_id long, team long, label string, y int")
    theta = spark.createDataFrame([(7, 2000.0)], "team long, theta double")
    got = {r.contest_id: r.b for r in fp.rate_problems(problems, rows, cells, theta).collect()}
    assert got[2] == 4000.0 and 800 < got[1] < 2000


def test_text_functions(spark):
    df = spark.createDataFrame([("  A  b-C\t1 ", "日本"), (None, "")], "a string, b string")
    got = df.select(text.norm_alnum("a").alias("x"), text.norm_space("a").alias("y"), text.norm_alnum("b").alias("z"), text.or_default("b", "(unnamed)").alias("d")).collect()
    assert tuple(got[0]) == ("abc1", "a b-c 1", "", "日本") and tuple(got[1]) == ("", "", "", "(unnamed)")
    assert spark.range(1).select(text.html_escape(F.lit("<a&'\">"))).first()[0] == "&lt;a&amp;&#39;&quot;&gt;"


def test_exports(spark):
    contests = spark.createDataFrame([(1, "a </script>")], "contest_id long, name string")
    html = export.html_page(contests, "T").first().html
    assert "/*__DATA__*/null" not in html and html.count("</script>") == 1
    bundle = export.viewer_bundle(contests, spark.createDataFrame([(1, "B", 2.0), (1, "A", 1.0)], "contest_id long, label string, b double"), spark.createDataFrame([(1, 1, "t")], "contest_id long, rank int, team string"))
    assert [p["label"] for p in json.loads(bundle.first().json)["problems"]] == ["A", "B"]
    assert export.round_trip(contests).count() == 1


def test_numbers_run_over_the_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("g")).repartition(7)
    got = {(r.x, r.g): r.n for r in numbered(df, [F.desc("g"), F.col("x")], "n").collect()}
    want = sorted(got, key=lambda k: (-k[1], k[0]))
    assert [got[k] for k in want] == list(range(1, 1001))
    assert numbered(df.where("false"), [F.col("x")], "n").count() == 0
    one = metrics.spearman(df.withColumn("y", F.col("x") * F.col("x")), "x", "y", ["g"], spread=True)
    assert [r.rho for r in one.collect()] == pytest.approx([1.0] * 3)


def test_validation_joins(spark):
    names = [(1, "A", "p1", "Two  Sum!", 100.0), (1, "B", "p2", "\u5c71", 200.0), (2, "A", "p3", "two sum", 300.0), (2, "B", None, "Tree", 400.0), (2, "C", "p5", "graph", 500.0)]
    rated = spark.createDataFrame(names, "contest_id long, label string, problem_id string, name string, b double")
    labelled = spark.createDataFrame([(1, "A", "p1", "Two  Sum!", "easy", " x ", "http://x"), (1, "B", "p2", "other", "very_easy", "y", None), (2, "A", "p3", "TWO SUM", "hard", "  ", "u"), (2, "B", None, "Tree", "hard", "z", "u")], "contest_id long, label string, problem_id string, name string, difficulty_estimate string, editorial string, editorial_url string")
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    five, four = validate.with_editorial(labelled), validate.with_editorial_url(labelled)
    assert rows(five, "contest_id", "label", "level") == [(1, "A", 1), (1, "B", 0), (2, "B", 3)] and rows(four, "contest_id", "label", "level") == [(1, "A", 0), (2, "A", 2), (2, "B", 2)]
    assert rows(validate.label_pairs(rated, five, "id"), "b", "level") == [(100.0, 1), (200.0, 0)]
    assert rows(validate.label_pairs(rated, four, "name"), "b", "level") == [(100.0, 0), (400.0, 2)]
    assert rows(validate.label_pairs(rated, four), "b", "level") == [(100.0, 0), (300.0, 2), (400.0, 2)]
    outside = spark.createDataFrame([(1, " two sum! ", 900), (2, "two  sum", 950), (2, "none", 1)], "contest_id long, name string, rating int")
    assert rows(validate.anchor_pairs(rated, outside), "contest_id", "b", "rating") == [(1, 100.0, 900.0), (2, 300.0, 950.0)]
    problem_set = spark.createDataFrame([(70, "twosum", 800), (70, "tree", 900), (70, "graph", 1000), (71, "twosum", 1), (71, "x", 2), (71, "y", 3)], "contest long, key string, rating int")
    mirrors = validate.mirror_contests(problem_set, rated)
    assert rows(mirrors, "mirror", "contest_id", "hits", "n") == [(70, 2, 3, 3)]
    pairs = validate.mirror_pairs(rated, mirrors, problem_set)
    assert rows(pairs, "label", "b", "outside") == [("A", 300.0, 800.0), ("B", 400.0, 900.0), ("C", 500.0, 1000.0)]
    detail = validate.contest_detail(pairs, 70, {"m": rated, "half": rated.where("label <> 'B'")}).collect()
    assert [tuple(r) for r in detail] == [("A", 800.0, 300.0, 300.0), ("B", 900.0, 400.0, None), ("C", 1000.0, 500.0, 500.0)]
    titles = spark.createDataFrame([("twosum", 2.5), ("", 9.0)], "key string, difficulty double")
    assert rows(validate.title_pairs(rated, titles), "contest_id", "label", "outside") == [(1, "A", 2.5), (2, "A", 2.5)]
    places = spark.createDataFrame([(2, "North")], "contest_id long, region string")
    got = {r.region: (r.rho, r.n) for r in validate.agreement(pairs.select("contest_id", "label", "b", "outside"), places, least=3).collect()}
    assert got == {"North": (pytest.approx(1.0), 3), "pooled": (pytest.approx(1.0), 3)}
    assert {r.region: r.rho for r in validate.agreement(pairs, places).collect()} == {"North": None, "pooled": None}
    assert validate.compare_fits(rated, rated.withColumn("b", F.col("b") + 3)).first()[:] == (pytest.approx(1.0), pytest.approx(3.0), 5)
    assert {r.contest_id: r.n for r in reference_ratings.reference_ratings(spark).groupBy("contest_id").agg(F.count("*").alias("n")).collect()} == {3747: 13, 2785: 13, 2657: 14}


def test_graph_and_viewer_order(spark):
    contests = spark.createDataFrame([(1, "One", 2020), (2, "", None), (3, None, 2021)], "contest_id long, contest_name string, year int")
    pairs = spark.createDataFrame([(1, 2, 1), (2, 3, 4)], "a long, b long, weight long")
    nodes = validate.graph_nodes(contests, ident.contest_components(contests, pairs))
    assert sorted(tuple(r) for r in nodes.collect()) == [(1, "One", "2020", 0), (2, "2", "?", 0), (3, "3", "2021", 0)]
    bundle = [(r.part, json.loads(r.json)) for r in validate.graph_bundle(nodes, {"A": pairs}).collect()]
    assert [e for p, e in bundle if p == "edge A"] == [{"a": 2, "b": 3, "weight": 4}] and sum(p == "node" for p, _ in bundle) == 3
    t = spark.createDataFrame([(1, "b"), (2, "A"), (3, None), (4, "C")], "k long, name string")
    order = lambda down: [r.k for r in numbered(t, validate.viewer_order(t, "name", down, ("k",)), "n").orderBy("n").collect()]
    assert order(False) == [2, 1, 4, 3] and order(True) == [4, 1, 2, 3]


LIGHT = ["contest_dedupe_first", "zero_solve_drop", "survival_cells", "team_identity", "contest_components", "weighted_rating", "performance_rating", "rasch_difficulty", "twopl_alpha", "spearman_by_contest", "region_model_matrix", "loco_rmse", "holdout_metrics", "viewer_teams", "fixedpoint_theta", "season_experiment", "label_agreement", "outside_agreement", "mirrored_contest", "run_report", "data_summary", "graph_nodes", "viewer_sorted"]


@pytest.mark.parametrize("name", LIGHT)
def test_queries_match_sql(spark, sf, name):
    got = registry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name]).df()[cols]
    norm = lambda row: tuple(None if v is None or v != v else round(float(v), 3) if isinstance(v, (float, np.floating)) else str(v) if not isinstance(v, (int, np.integer)) else int(v) for v in row)
    same = lambda a: sorted([tuple(float(v) if isinstance(v, (int, float)) else v for v in norm(r)) for r in a], key=repr)
    assert same(got.select(*cols).toPandas().itertuples(index=False)) == same(want.itertuples(index=False))


def _jobs(spark, group, run):
    """The result of ``run`` and the number of stages of each of its jobs."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return got, [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group)]


def test_2pl_steps_are_two_passes_without_shuffle_and_equal_the_tables(spark, sf, monkeypatch):
    obs = C.kept_cells(Scratch(spark, "jobs").table(views.v1_cells(spark, sf)))
    few, more = ((lambda n=n: irt.fit_2pl(obs, warmup=2, eps=None, max_iter=n)) for n in (4, 10))
    _, short = _jobs(spark, "2pl-4", few)
    (theta, b, *_), long = _jobs(spark, "2pl-10", more)
    assert len(long) - len(short) <= 12  # six more steps; with tables a step takes three jobs and their broadcasts
    monkeypatch.setattr(irt, "HELD_TEAMS", 0)
    theta2, b2, *_ = more()
    for x, y, keys in ((theta, theta2, ["team"]), (b, b2, ["contest_id", "label"])):
        x, y = (t.toPandas().sort_values(keys).reset_index(drop=True) for t in (x, y))
        pd.testing.assert_frame_equal(x, y, rtol=1e-9)


def test_2pl_blocks_take_text_keys_priors_null_and_cut_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"c{c}", f"t{t}", f"p{p}", None if rng.random() < 0.1 else int(rng.random() < 0.4)) for c in range(3) for t in range(30) for p in range(4)] + [(None, "t1", "p1", 1), ("c1", None, "p1", 1)]
    obs = spark.createDataFrame(rows, "contest_id string, team string, label string, y int")
    prior = spark.createDataFrame([("t3", 2400.0), ("t4", None)], "team string, theta double")
    monkeypatch.setattr("podium.plans.blocks.BLOCK_CELLS", 25)
    got = irt.fit_2pl(obs, prior, warmup=2, eps=None, max_iter=6)
    monkeypatch.setattr(irt, "HELD_TEAMS", 0)
    want = irt.fit_2pl(obs, prior, warmup=2, eps=None, max_iter=6)
    for x, y, keys in ((got[0], want[0], ["team"]), (got[1], want[1], ["contest_id", "label"])):
        x, y = (t.toPandas().sort_values(keys).reset_index(drop=True) for t in (x, y))
        pd.testing.assert_frame_equal(x, y, rtol=1e-9)
    assert got[0].count() == 30


def _one_pass_a_step(spark, sf, monkeypatch, model):
    obs = C.exposure(C.kept_cells(Scratch(spark, "jobs").table(views.v1_cells(spark, sf))))
    few, more = ((lambda n=n: irt.fit(obs, model, eps=None, max_iter=n)) for n in (3, 9))
    _, short = _jobs(spark, f"{model}-3", few)
    (theta, b, *_), long = _jobs(spark, f"{model}-9", more)
    assert len(long) - len(short) <= 6  # six more steps; with tables a step takes two jobs and their broadcasts
    monkeypatch.setattr(irt, "HELD_TEAMS", 0)
    theta2, b2, *_ = more()
    for x, y, keys in ((theta, theta2, ["team"]), (b, b2, ["contest_id", "label"])):
        x, y = (t.toPandas().sort_values(keys).reset_index(drop=True) for t in (x, y))
        pd.testing.assert_frame_equal(x, y, rtol=1e-9)


def test_rasch_steps_are_one_pass_and_equal_the_tables(spark, sf, monkeypatch):
    _one_pass_a_step(spark, sf, monkeypatch, "rasch")


def test_survival_steps_are_one_pass_and_equal_the_tables(spark, sf, monkeypatch):
    _one_pass_a_step(spark, sf, monkeypatch, "survival")


@pytest.mark.parametrize("model, passes", [("rasch", 1), ("survival", 1), ("2pl", 2)])
def test_blocks_held_by_the_driver_take_no_jobs_and_equal_those_in_jobs(spark, sf, monkeypatch, model, passes):
    obs = Scratch(spark, "held").table(C.exposure(C.kept_cells(views.v1_cells(spark, sf))))
    run = lambda n: irt.fit_2pl(obs, warmup=2, eps=None, max_iter=n) if model == "2pl" else irt.fit(obs, model, eps=None, max_iter=n)
    monkeypatch.setattr("podium.plans.blocks.BLOCK_CELLS", 500)
    got, tables = {}, {}
    for held in (4_000_000, 0):
        monkeypatch.setattr("podium.plans.blocks.HELD_CELLS", held)
        _, short = _jobs(spark, f"held-{model}-{held}-4", lambda: run(4))
        (theta, b, *_), long = _jobs(spark, f"held-{model}-{held}-10", lambda: run(10))
        got[held] = len(long) - len(short)
        tables[held] = [t.toPandas().sort_values(keys).reset_index(drop=True) for t, keys in ((theta, ["team"]), (b, ["contest_id", "label"]))]
    assert got == {4_000_000: 0, 0: 6 * passes}
    for x, y in zip(tables[4_000_000], tables[0]):
        pd.testing.assert_frame_equal(x, y, rtol=1e-9)


def test_held_out_models_share_one_deal_and_one_ranking(spark, sf, monkeypatch):
    dealt, ranked = [], []
    blocks, number = irt.TeamBlocks, metrics.numbered
    monkeypatch.setattr(irt, "TeamBlocks", lambda *a: dealt.append(1) or blocks(*a))
    monkeypatch.setattr(metrics, "numbered", lambda *a: ranked.append(1) or number(*a))
    got = {r.model: r for r in registry.queries()["holdout_models"](spark, sf).collect()}
    assert (len(dealt), len(ranked)) == (1, 1)
    # each model as fitted and ranked by itself
    obs = Scratch(spark, "apart").table(C.exposure(queries.kept(spark, sf)))
    train, test = obs.where(f"not ({queries._SPLIT})"), obs.where(queries._SPLIT)
    for model in ("rasch", "survival", "2pl"):
        theta, b, *_ = irt.fit_2pl(train) if model == "2pl" else irt.fit(train, model)
        t = test.join(theta.select("team", "theta"), "team").join(b, ["contest_id", "label"]).withColumn("p", F.round(irt.predicted(model), 9))
        want = metrics.holdout_metrics(t, "y", "p", ["contest_id", "team", "label"]).first()
        assert got[model].n == want.n and [got[model][c] for c in ("log_loss", "brier", "auc")] == pytest.approx([want[c] for c in ("log_loss", "brier", "auc")], abs=1e-5)
