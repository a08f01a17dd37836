"""SQL twins of the registered queries, generated where they iterate."""

from __future__ import annotations

import math

S = 400.0 / math.log(10)
LN2 = math.log(2)

CELLS = """cells AS MATERIALIZED (SELECT CAST(year(o_orderdate)*100+month(o_orderdate) AS BIGINT) AS contest_id, o_custkey AS team, l_suppkey % 8 AS label,
 max(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS y,
 CAST(min(CASE WHEN l_returnflag='A' THEN ((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 300) + 300) % 300 * 60 END) AS DOUBLE) AS tau
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1,2,3)"""
ROWS = """allrows AS MATERIALIZED (SELECT contest_id, team, solved, penalty, rank() OVER (PARTITION BY contest_id ORDER BY solved DESC, penalty) AS rank FROM
 (SELECT contest_id, team, CAST(sum(y) AS BIGINT) AS solved, coalesce(sum(tau), 0) AS penalty FROM cells GROUP BY 1,2))"""
KEPT = """keptrows AS MATERIALIZED (SELECT * FROM allrows WHERE solved > 0),
kept AS MATERIALIZED (SELECT c.* FROM cells c JOIN keptrows USING (contest_id, team))"""
LENGTH = """lengths AS (SELECT contest_id, CASE WHEN max(tau) > 0 THEN max(tau) ELSE 18000.0 END AS length FROM kept GROUP BY 1),
obs AS MATERIALIZED (SELECT k.*, length, CASE WHEN y = 1 THEN tau / length ELSE 1.0 END AS rho FROM kept k JOIN lengths USING (contest_id))"""
CONTESTS = """contests AS MATERIALIZED (SELECT contest_id, CASE WHEN contest_id % 100 % 6 = 0 THEN 'World Finals ' || (contest_id // 100) ELSE 'Round ' || contest_id END AS contest_name,
 CASE WHEN contest_id % 9 <> 0 THEN CAST(contest_id // 100 AS INT) END AS year,
 CASE contest_id % 5 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' WHEN 3 THEN 'West' ELSE 'Centre' END AS region FROM (SELECT DISTINCT contest_id FROM cells))"""
COUNTS = "counts AS MATERIALIZED (SELECT contest_id, label, count(*) AS field, CAST(sum(y) AS BIGINT) AS solved, sum(y) / count(*) AS rate FROM kept GROUP BY 1,2)"
BASE = f"{CELLS},\n{ROWS},\n{KEPT}"
#: Difficulties from solve rates, and a made-up outside rating for each problem.
QUICK = f"""quick AS MATERIALIZED (SELECT contest_id, label, solved, 2000 - {S!r} * ln(greatest(least(rate, 0.99), 0.01) / (1 - greatest(least(rate, 0.99), 0.01))) AS b,
 CAST(800 + (contest_id * 7 + label * 131) % 2400 AS DOUBLE) AS rating FROM counts)"""
CLIP = "greatest(least({}, 4000.0), 800.0)"


def select(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


def newton(model: str, steps: int, obs: str, tag: str, prior: str | None = None, eps: float = 0.5) -> str:
    """CTEs t{tag}_k (team, mu, theta) and b{tag}_k (contest_id, label, b): steps that change nothing once the fit has converged."""
    join = f"LEFT JOIN {prior} p USING (team)" if prior else ""
    mu = "coalesce(p.theta, 2000.0)" if prior else "2000.0"
    out = [f"t{tag}_0 AS MATERIALIZED (SELECT team, {mu} AS mu, 2000.0 AS theta FROM (SELECT DISTINCT team FROM {obs}) {join})", f"b{tag}_0 AS MATERIALIZED (SELECT DISTINCT contest_id, label, 2000.0 AS b FROM {obs})", f"e{tag}_0 AS MATERIALIZED (SELECT false AS done)"]
    if model == "rasch":
        p = "1 / (1 + pow(10, (b - theta) / 400))"
        res, cur = f"y - {p}", f"({p}) * (1 - {p})"
    else:
        h = f"{LN2!r} * exp((theta - b) / {S!r}) * rho"
        res, cur = f"y - {h}", h
    prec = 1 / 400.0**2
    for k in range(steps):
        live = f"(SELECT * FROM {obs} WHERE NOT (SELECT done FROM e{tag}_{k}))"
        new = CLIP.format(f"theta + (g / {S!r} - {prec!r} * (theta - mu)) / (h / {S * S!r} + {prec!r})")
        out.append(f"t{tag}_{k + 1} AS MATERIALIZED (SELECT o.team, o.mu, coalesce(n.theta, o.theta) AS theta FROM t{tag}_{k} o LEFT JOIN (SELECT team, {new} AS theta FROM (SELECT team, mu, theta, sum({res}) AS g, sum({cur}) AS h FROM {live} JOIN t{tag}_{k} USING (team) JOIN b{tag}_{k} USING (contest_id, label) GROUP BY team, mu, theta)) n USING (team))")
        new = CLIP.format(f"b + (-g / {S!r} - {prec!r} * (b - 2000.0)) / (h / {S * S!r} + {prec!r})")
        out.append(f"b{tag}_{k + 1} AS MATERIALIZED (SELECT contest_id, label, coalesce(n.b, o.b) AS b FROM b{tag}_{k} o LEFT JOIN (SELECT contest_id, label, {new} AS b FROM (SELECT contest_id, label, b, sum({res}) AS g, sum({cur}) AS h FROM {live} JOIN t{tag}_{k + 1} USING (team) JOIN b{tag}_{k} USING (contest_id, label) GROUP BY contest_id, label, b)) n USING (contest_id, label))")
        out.append(f"e{tag}_{k + 1} AS MATERIALIZED (SELECT (SELECT max(abs(a.theta - b.theta)) FROM t{tag}_{k} a JOIN t{tag}_{k + 1} b USING (team)) < {eps!r} AND (SELECT max(abs(a.b - b.b)) FROM b{tag}_{k} a JOIN b{tag}_{k + 1} b USING (contest_id, label)) < {eps!r} AS done)")
    return ",\n".join(out)


def twopl(steps: int, warmup: int, obs: str, tag: str = "d", sigma_g: float = 0.5, eps: float = 0.5, eps_g: float = 0.005) -> str:
    """CTEs t{tag}_k (team, mu, theta) and b{tag}_k (contest_id, label, b, g): steps that change nothing once the fit has converged."""
    out = [f"t{tag}_0 AS MATERIALIZED (SELECT DISTINCT team, 2000.0 AS mu, 2000.0 AS theta FROM {obs})", f"b{tag}_0 AS MATERIALIZED (SELECT DISTINCT contest_id, label, 2000.0 AS b, 0.0 AS g FROM {obs})", f"e{tag}_0 AS MATERIALIZED (SELECT false AS done)"]
    d = f"exp(g) / {S!r}"
    p = f"1 / (1 + exp(-({d} * (theta - b))))"
    prec, prec_g = 1 / 400.0**2, 1 / sigma_g**2
    for k in range(steps):
        live = f"(SELECT * FROM {obs} WHERE NOT (SELECT done FROM e{tag}_{k}))"
        new = CLIP.format(f"theta + (gr - {prec!r} * (theta - mu)) / (h + {prec!r})")
        out.append(f"t{tag}_{k + 1} AS MATERIALIZED (SELECT o.team, o.mu, coalesce(n.theta, o.theta) AS theta FROM t{tag}_{k} o LEFT JOIN (SELECT team, {new} AS theta FROM (SELECT team, mu, theta, sum({d} * (y - {p})) AS gr, sum({d} * {d} * ({p}) * (1 - {p})) AS h FROM {live} JOIN t{tag}_{k} USING (team) JOIN b{tag}_{k} USING (contest_id, label) GROUP BY team, mu, theta)) n USING (team))")
        new = CLIP.format(f"b + (gr - {prec!r} * (b - 2000.0)) / (h + {prec!r})")
        mid = f"x{tag}_{k + 1}" if k >= warmup else f"b{tag}_{k + 1}"
        out.append(f"{mid} AS MATERIALIZED (SELECT contest_id, label, coalesce(n.b, o.b) AS b, o.g FROM b{tag}_{k} o LEFT JOIN (SELECT contest_id, label, {new} AS b FROM (SELECT contest_id, label, b, g, sum(-{d} * (y - {p})) AS gr, sum({d} * {d} * ({p}) * (1 - {p})) AS h FROM {live} JOIN t{tag}_{k + 1} USING (team) JOIN b{tag}_{k} USING (contest_id, label) GROUP BY contest_id, label, b, g)) n USING (contest_id, label))")
        if k >= warmup:
            eta = f"({d} * (theta - b))"
            new = f"greatest(least(g + (gr - {prec_g!r} * g) / (h + {prec_g!r}), 1.5), -1.5)"
            out.append(f"b{tag}_{k + 1} AS MATERIALIZED (SELECT contest_id, label, o.b, coalesce(n.g, o.g) AS g FROM {mid} o LEFT JOIN (SELECT contest_id, label, {new} AS g FROM (SELECT contest_id, label, b, g, sum((y - {p}) * {eta}) AS gr, sum(({p}) * (1 - {p}) * {eta} * {eta}) AS h FROM {live} JOIN t{tag}_{k + 1} USING (team) JOIN {mid} USING (contest_id, label) GROUP BY contest_id, label, b, g)) n USING (contest_id, label))")
            out.append(f"e{tag}_{k + 1} AS MATERIALIZED (SELECT (SELECT max(abs(a.theta - b.theta)) FROM t{tag}_{k} a JOIN t{tag}_{k + 1} b USING (team)) < {eps!r} AND (SELECT max(abs(a.b - b.b)) < {eps!r} AND max(abs(a.g - b.g)) < {eps_g!r} FROM b{tag}_{k} a JOIN b{tag}_{k + 1} b USING (contest_id, label)) AS done)")
        else:
            out.append(f"e{tag}_{k + 1} AS MATERIALIZED (SELECT false AS done)")
    return ",\n".join(out)


def performance(field: str, tag: str) -> str:
    """CTE perf{tag} (contest_id, team, perf) of a field (contest_id, team, rank, theta), by 25 halvings, two a CTE."""
    def places(src: str, **points: str) -> str:
        sums = ", ".join(f"sum(CASE WHEN r.team <> p.team THEN 1 / (1 + pow(10, ({at} - r.theta) / 400)) ELSE 0 END) AS {name}" for name, at in points.items())
        return f"SELECT p.contest_id, p.team, {sums} FROM {src} p JOIN {field} r USING (contest_id) GROUP BY p.contest_id, p.team"

    mid, first, third = "((p.lo + p.hi) / 2)", "((p.lo + (p.lo + p.hi) / 2) / 2)", "(((p.lo + p.hi) / 2 + p.hi) / 2)"
    out = [f"q{tag}_0 AS MATERIALIZED (SELECT contest_id, team, theta, rank - 1 AS target, 800.0 AS lo, 4000.0 AS hi FROM {field})"]
    for k in range(12):
        low = f"CASE WHEN m > target THEN CASE WHEN t > target THEN {third} ELSE {mid} END ELSE CASE WHEN f > target THEN {first} ELSE p.lo END END"
        high = f"CASE WHEN m > target THEN CASE WHEN t > target THEN p.hi ELSE {third} END ELSE CASE WHEN f > target THEN {mid} ELSE {first} END END"
        out.append(f"q{tag}_{k + 1} AS MATERIALIZED (SELECT p.contest_id, p.team, p.theta, target, {low} AS lo, {high} AS hi FROM q{tag}_{k} p JOIN ({places(f'q{tag}_{k}', m=mid, f=first, t=third)}) z USING (contest_id, team))")
    out.append(f"q{tag}_13 AS MATERIALIZED (SELECT p.contest_id, p.team, target, CASE WHEN m > target THEN {mid} ELSE p.lo END AS lo, CASE WHEN m > target THEN p.hi ELSE {mid} END AS hi FROM q{tag}_12 p JOIN ({places(f'q{tag}_12', m=mid)}) z USING (contest_id, team))")
    out.append(f"perf{tag} AS MATERIALIZED (SELECT contest_id, team, CASE WHEN l <= target THEN 800.0 WHEN h >= target THEN 4000.0 ELSE (lo + hi) / 2 END AS perf FROM q{tag}_13 JOIN ({places(f'q{tag}_0', l='800.0', h='4000.0')}) z USING (contest_id, team))")
    return ",\n".join(out)


def fixedpoint(rows: str, tag: str, steps: int, prior: str | None = None, eps: float = 0.5) -> str:
    """CTEs f{tag}_k (team, theta): steps of the fixed point, which change nothing once it has converged."""
    join = f"LEFT JOIN {prior} p USING (team)" if prior else ""
    mu, st = ("coalesce(p.mu, 2000.0)", "coalesce(p.strength, 1.0)") if prior else ("2000.0", "1.0")
    out = [f"w{tag} AS MATERIALIZED (SELECT team, n, 1 - pow(0.9, n) AS w, {mu} AS mu, {st} AS strength FROM (SELECT team, count(*) AS n FROM {rows} GROUP BY 1) {join})", f"f{tag}_0 AS MATERIALIZED (SELECT team, 2000.0 AS theta FROM w{tag})", f"e{tag}_0 AS MATERIALIZED (SELECT false AS done)"]
    for k in range(steps):
        out.append(f"field{tag}_{k} AS MATERIALIZED (SELECT contest_id, team, rank, theta FROM {rows} JOIN f{tag}_{k} USING (team) WHERE NOT (SELECT done FROM e{tag}_{k}))")
        out.append(performance(f"field{tag}_{k}", f"{tag}_{k}"))
        out.append(f"f{tag}_{k + 1} AS MATERIALIZED (SELECT o.team, coalesce(n.theta, o.theta) AS theta FROM f{tag}_{k} o LEFT JOIN (SELECT team, {CLIP.format('(w * s + strength * mu) / (w * n + strength)')} AS theta FROM w{tag} JOIN (SELECT team, sum(perf) AS s FROM perf{tag}_{k} GROUP BY 1) USING (team)) n USING (team))")
        out.append(f"e{tag}_{k + 1} AS MATERIALIZED (SELECT max(abs(a.theta - b.theta)) < {eps!r} AS done FROM f{tag}_{k} a JOIN f{tag}_{k + 1} b USING (team))")
    return ",\n".join(out)


def rate(theta: str, tag: str = "r", halvings: int = 32) -> str:
    """CTE rated{tag} (contest_id, label, b) from kept rows, kept cells and a theta table."""
    total = lambda at, src: f"SELECT z.contest_id, z.label, sum(w / (1 + pow(10, ({at} - theta) / 400))) + 0.5 / (1 + pow(10, ({at} - 4000.0) / 400)) + 0.5 / (1 + pow(10, ({at} - 800.0) / 400)) AS s FROM {src} z JOIN fld{tag} USING (contest_id) GROUP BY z.contest_id, z.label, {at}"
    out = [
        f"wt{tag} AS MATERIALIZED (SELECT team, 1 - pow(0.9, count(*)) AS w FROM keptrows GROUP BY 1)",
        f"fld{tag} AS MATERIALIZED (SELECT contest_id, team, w, theta FROM keptrows JOIN wt{tag} USING (team) JOIN {theta} USING (team))",
        f"z{tag}_0 AS MATERIALIZED (SELECT p.contest_id, p.label, coalesce(sum(w * y), 0) + 0.5 AS target, 800.0 AS lo, 4000.0 AS hi FROM (SELECT DISTINCT contest_id, label FROM cells) p LEFT JOIN (SELECT * FROM kept JOIN wt{tag} USING (team)) k USING (contest_id, label) GROUP BY 1,2)",
    ]
    for k in range(halvings):
        out.append(f"z{tag}_{k + 1} AS MATERIALIZED (SELECT q.contest_id, q.label, target, CASE WHEN s > target THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN s > target THEN hi ELSE (lo + hi) / 2 END AS hi FROM z{tag}_{k} q JOIN ({total('(z.lo + z.hi) / 2', f'z{tag}_{k}')}) t USING (contest_id, label))")
    out.append(f"rated{tag} AS MATERIALIZED (SELECT p.contest_id, p.label, CASE WHEN z.lo IS NULL THEN 4000.0 WHEN e.s <= z.target THEN 800.0 WHEN e2.s >= z.target THEN 4000.0 ELSE (z.lo + z.hi) / 2 END AS b FROM z{tag}_0 p LEFT JOIN z{tag}_{halvings} z USING (contest_id, label) LEFT JOIN ({total('800.0', f'z{tag}_0')}) e USING (contest_id, label) LEFT JOIN ({total('4000.0', f'z{tag}_0')}) e2 USING (contest_id, label))")
    return ",\n".join(out)


def identity(season: bool, tag: str = "i") -> str:
    """CTEs ident{tag} (rows with tokens) and keyed{tag} (rows with team_key)."""
    scope = "|| coalesce('|s' || season, '')" if season else ""
    half = "CAST(team // 2 AS VARCHAR)"
    return f"""ident{tag} AS MATERIALIZED (SELECT contest_id, team, solved, CASE WHEN team % 5 = 0 THEN '$DEFAULT_' || (team % 7) ELSE 'acc-' || team END AS team_id,
 CASE WHEN team % 5 <> 0 THEN 'id:acc-' || team END AS idt,
 CASE WHEN team % 3 <> 0 AND team % 11 <> 0 THEN 'mem:a' || {half} || '|b' || {half} {scope} END AS ros
 FROM allrows JOIN (SELECT contest_id, CASE WHEN contest_name LIKE '%World Final%' THEN year - 1 ELSE year END AS season FROM contests) USING (contest_id)),
edges{tag} AS MATERIALIZED (SELECT DISTINCT idt AS a, ros AS b FROM ident{tag} WHERE idt IS NOT NULL AND ros IS NOT NULL),
both{tag} AS MATERIALIZED (SELECT a, b FROM edges{tag} UNION SELECT b, a FROM edges{tag}),
reach{tag} AS (SELECT a AS node, a AS other FROM both{tag} UNION SELECT r.node, e.b FROM reach{tag} r JOIN both{tag} e ON r.other = e.a),
tok{tag} AS MATERIALIZED (SELECT node, coalesce(min(CASE WHEN other LIKE 'mem:%' THEN other END), min(other)) AS key FROM reach{tag} GROUP BY 1),
keyed{tag} AS MATERIALIZED (SELECT i.contest_id, i.team, i.solved, coalesce(t.key, i.ros, i.idt, 'dj:' || i.contest_id || '::' || i.team_id) AS team_key FROM ident{tag} i LEFT JOIN tok{tag} t ON coalesce(i.ros, i.idt) = t.node)"""


def spearman(src: str, x: str, y: str, keys: str, ties: str, least: int = 2) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""(SELECT {k}CASE WHEN count(*) >= {least} AND min(_x) < max(_x) AND min(_y) < max(_y) THEN corr(rx, ry) END AS rho, count(*) AS n FROM
 (SELECT {k}{x} AS _x, {y} AS _y, row_number() OVER ({part}ORDER BY {x}, {ties}) AS rx, row_number() OVER ({part}ORDER BY {y}, {ties}) AS ry FROM {src}) {'GROUP BY ' + keys if keys else ''})"""


def linked(tag: str, pairs: str, nodes: str) -> str:
    """CTE labels{tag} (contest_id, least, size): components of contests linked by pairs (a, b)."""
    return f"""links{tag} AS MATERIALIZED (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
span{tag} AS (SELECT DISTINCT contest_id AS node, contest_id AS other FROM {nodes} UNION SELECT r.node, e.b FROM span{tag} r JOIN links{tag} e ON r.other = e.a),
least{tag} AS MATERIALIZED (SELECT node AS contest_id, min(other) AS least FROM span{tag} GROUP BY 1),
labels{tag} AS MATERIALIZED (SELECT contest_id, least, size FROM least{tag} JOIN (SELECT least, count(*) AS size FROM least{tag} GROUP BY 1) USING (least))"""


def pairs(tag: str, key: str, rows: str) -> str:
    """CTE pairs{tag} (a, b, weight) of contests that share a key."""
    one = f"(SELECT DISTINCT contest_id, {key} AS k FROM {rows})"
    return f"pairs{tag} AS MATERIALIZED (SELECT a.contest_id AS a, b.contest_id AS b, count(*) AS weight FROM {one} a JOIN {one} b ON a.k = b.k AND a.contest_id < b.contest_id GROUP BY 1,2)"


def loco(src: str) -> str:
    """(fit_rmse, loco_rmse, n) of rating on b in ``src`` (contest_id, b, rating)."""
    return f"""(SELECT sqrt(avg(pow(fa * b + fc - rating, 2))) AS fit_rmse, sqrt(avg(pow(a * b + c - rating, 2))) AS loco_rmse, count(*) AS n FROM {src} JOIN
 (SELECT g.contest_id, regr_slope(rating, b) AS a, regr_intercept(rating, b) AS c FROM (SELECT DISTINCT contest_id FROM {src}) g JOIN {src} q ON q.contest_id <> g.contest_id GROUP BY 1) USING (contest_id),
 (SELECT regr_slope(rating, b) AS fa, regr_intercept(rating, b) AS fc FROM {src}))"""


def trial(tag: str, rows: str, steps: int) -> tuple[list[str], str]:
    """CTEs for an anchored survival fit over rows (contest_id, team, team_key), and the selection of its figures."""
    ctes = [
        f"cells{tag} AS MATERIALIZED (SELECT k.contest_id, team_key AS team, label, y, tau FROM kept k JOIN {rows} USING (contest_id, team))",
        f"obs{tag} AS MATERIALIZED (SELECT c.*, CASE WHEN y = 1 THEN tau / length ELSE 1.0 END AS rho FROM cells{tag} c JOIN (SELECT contest_id, CASE WHEN max(tau) > 0 THEN max(tau) ELSE 18000.0 END AS length FROM cells{tag} GROUP BY 1) USING (contest_id))",
        f"early{tag} AS MATERIALIZED (SELECT * FROM obs{tag} WHERE contest_id % 4 = 0)",
        newton("survival", steps, f"early{tag}", f"m{tag}"), newton("survival", steps, f"obs{tag}", f"n{tag}", f"tm{tag}_{steps}"),
        f"rated{tag} AS MATERIALIZED (SELECT contest_id, label, f.b, rating FROM bn{tag}_{steps} f JOIN quick USING (contest_id, label))",
        f"levels{tag} AS MATERIALIZED (SELECT contest_id, label, b, (contest_id + label) % 7 AS level FROM bn{tag}_{steps} WHERE contest_id % 3 <> 0 AND (contest_id + label) % 7 < 5)",
        pairs(tag, "team_key", rows), linked(tag, f"pairs{tag}", rows),
    ]
    return ctes, f"""SELECT (SELECT count(DISTINCT team_key) FROM {rows}) AS teams, (SELECT count(DISTINCT contest_id) FROM {rows}) AS contests, (SELECT count(DISTINCT least) FROM labels{tag}) AS components, (SELECT max(size) FROM labels{tag}) AS largest,
 (SELECT round(rho, 5) FROM {spearman(f'rated{tag}', 'b', 'rating', '', 'contest_id, label')}) AS spearman, (SELECT round(loco_rmse, 3) FROM {loco(f'rated{tag}')}) AS loco_rmse, (SELECT round(rho, 5) FROM {spearman(f'levels{tag}', 'level', 'b', '', 'contest_id, label')}) AS level_spearman"""
