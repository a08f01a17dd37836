"""The registered queries: operators applied to the standings-shaped views, each with its SQL twin.

All fits run until they converge, and raise an error if they don't.  Their SQL
twins make a number of steps that is enough at the sizes they are compared at;
steps after convergence change nothing.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window, functions as F

from podium.functions import metrics, rating, text
from podium.operators import anchor, cells as C, export, fixedpoint as fp, identity as ident, irt, oracle as O, validate
from podium.operators.registry import query
from podium.plans.ranks import numbered
from podium.plans.scratch import Scratch
from podium.sources import standings, views

#: Steps of the SQL twins.
STEPS, FP_STEPS, TWO_STEPS = 40, 18, 120
PROBLEM = ["contest_id", "label"]


def r(c, places: int = 4):
    return F.round(c, places)


def v1(spark, sf) -> DataFrame:
    """The cells of V1, written once for all uses in a query."""
    return Scratch(spark, "v1").table(views.v1_cells(spark, sf), "cells")


def kept(spark, sf):
    return C.kept_cells(v1(spark, sf))


def kept_rows(cells: DataFrame) -> DataFrame:
    return views.v1_rows(cells).where("solved > 0").withColumn("row", F.col("team"))


def quick(cells: DataFrame) -> DataFrame:
    """Difficulties from solve rates, and a made-up outside rating, by problem."""
    c = C.solve_counts(cells)
    return c.select(*PROBLEM, "solved", (rating.MU0 - rating.S * rating.logit("rate")).alias("b"), (800 + (F.col("contest_id") * 7 + F.col("label") * 131) % 2400).cast("double").alias("rating"))


def with_level(q: DataFrame) -> DataFrame:
    """Adds the made-up label's ``level``, where the contest has an editorial; leaves out problems without one."""
    q = q.withColumn("lab", F.element_at(F.array(*map(F.lit, (*text.FIVE_LEVELS, "unknown", "unknown"))), ((F.col("contest_id") + F.col("label")) % 7 + 1).cast("int")))
    q = q.withColumn("editorial", F.when(F.col("contest_id") % 3 != 0, F.lit(" see notes "))).where("trim(editorial) <> ''")
    return q.withColumn("level", text.level("lab")).where("level is not null")


def converged(fit):
    """``fit`` in as many steps as it needs, raising an error where it stops short of its eps."""

    def whole(*args, **options):
        got = fit(*args, **{"max_iter": None, **options})
        if not got[-1]:
            raise RuntimeError(f"not converged after {len(got[-2])} steps: the last change was {got[-2][-1]}")
        return got

    return whole


# --- sources, flattening, filters -------------------------------------------------

@query(O.select("SELECT contest_id, team, CAST(label AS VARCHAR) AS label, y, tau FROM kept", O.BASE))
def json_standings_scan(spark, sf):
    """V1 as nested JSON in the scratch folder, read back and flattened."""
    cells = v1(spark, sf)
    rows = views.v1_rows(cells).join(
        cells.groupBy("contest_id", "team").agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("string"), F.struct((F.col("y") == 1).alias("solved"), F.lit(0.0).alias("score"), F.col("tau").alias("time_seconds"), F.lit(0).alias("wrong_attempts"))))).alias("problems")), ["contest_id", "team"])
    st = rows.groupBy("contest_id").agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("team").cast("string").alias("team_id"), "problems")).alias("standings"))
    pr = cells.groupBy("contest_id").agg(F.transform(F.array_sort(F.collect_set("label")), lambda x: F.struct(x.cast("string").alias("problem_label"), x.cast("string").alias("problem_id"))).alias("problems"))
    path = Scratch(spark, "standings").root
    st.join(pr, "contest_id").write.json(path)
    contests = standings.dedupe_contests(standings.scan_contests(spark, path, lines=True))
    problems = C.problem_table(contests)
    rows = C.row_table(contests)
    flat = C.cell_table(rows, problems)
    return flat.join(rows.select("contest_id", "row", F.col("team_id").cast("long").alias("team")), ["contest_id", "row"]).select("contest_id", "team", "label", "y", "tau")


@query("SELECT o_custkey AS contest_id, o_orderkey AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS n FROM orders) WHERE n = 1")
def contest_dedupe_first(spark, sf):
    """Two files' worth of entries (even and odd keys): the first of each id stays."""
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("contest_id"), "o_orderkey", (F.col("o_orderkey") % 2).alias("file_ord"), F.col("o_orderkey").alias("pos"))
    both = o.where("file_ord = 0").unionByName(o.where("file_ord = 1"))
    return standings.dedupe_contests(both).select("contest_id", F.col("o_orderkey").alias("first_key"))


@query(O.select("SELECT contest_id, max(CASE WHEN y = 1 THEN tau END) AS last_solve FROM cells GROUP BY 1 HAVING max(CASE WHEN y = 1 THEN tau END) >= 3.5 * 3600", O.CELLS))
def short_contest_filter(spark, sf):
    c = v1(spark, sf)
    return c.groupBy("contest_id").agg(F.max(F.when(F.col("y") == 1, F.col("tau"))).alias("last_solve")).where(F.col("last_solve") >= 3.5 * 3600)


@query(O.select("SELECT contest_id, team, solved, penalty, rank FROM keptrows", O.BASE))
def zero_solve_drop(spark, sf):
    return views.v1_rows(v1(spark, sf)).where("solved > 0").select("contest_id", "team", "solved", "penalty", "rank")


@query(O.select("SELECT contest_id, contest_name, CASE WHEN contest_name LIKE '%World Final%' THEN year - 1 ELSE year END AS season FROM contests", O.CELLS, O.CONTESTS))
def season_of(spark, sf):
    c = views.v1_contests(v1(spark, sf))
    return c.select("contest_id", "contest_name", text.season_of("year", "contest_name").alias("season"))


@query(O.select("SELECT contest_id, team, label, y, tau FROM kept", O.BASE))
def cells_long(spark, sf):
    return kept(spark, sf).select("contest_id", "team", "label", "y", "tau")


@query(O.select("SELECT contest_id, team, label, y, length, round(rho, 6) AS rho FROM obs", O.BASE, O.LENGTH))
def survival_cells(spark, sf):
    return C.exposure(kept(spark, sf)).select("contest_id", "team", "label", "y", "length", r("rho", 6).alias("rho"))


@query("""SELECT year(ts)*10000+month(ts)*100+day(ts) AS contest_id, user_id AS team, event_type AS label, max(CASE WHEN value >= 35 THEN 1 ELSE 0 END) AS y,
 CAST(min(CASE WHEN value >= 35 THEN hour(ts)*3600+minute(ts)*60+second(ts) END) AS DOUBLE) AS tau FROM events GROUP BY 1,2,3""")
def event_cells(spark, sf):
    return views.v2_cells(spark, sf)


@query(O.select("SELECT contest_id, label, field, solved, round(rate, 6) AS rate, coalesce(CASE WHEN label % 3 = 0 THEN NULL ELSE solved END, -1) AS reported FROM counts", O.BASE, O.COUNTS))
def problem_solve_counts(spark, sf):
    c = C.solve_counts(kept(spark, sf))
    return c.select(*PROBLEM, "field", "solved", r("rate", 6).alias("rate"), F.coalesce(F.when(F.col("label") % 3 != 0, F.col("solved")), F.lit(-1)).alias("reported"))


@query(O.select("SELECT coalesce(r_name, '?') AS region, label, count(*) AS field, round(avg(y), 6) AS rate FROM kept JOIN customer ON team = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1,2", O.BASE))
def solve_rate_by_region(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("team"), "c_nationkey")
    n, g = views.table(spark, sf, "nation"), views.table(spark, sf, "region")
    j = kept(spark, sf).join(c, "team").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy(F.coalesce("r_name", F.lit("?")).alias("region"), "label").agg(F.count("*").alias("field"), r(F.avg("y"), 6).alias("rate"))


@query(O.select("SELECT team, count(*) AS n, round(1 - pow(0.9, count(*)), 6) AS w FROM keptrows GROUP BY 1", O.BASE))
def team_reliability(spark, sf):
    return fp.team_weights(kept_rows(v1(spark, sf))).select("team", "n", r("w", 6).alias("w"))


# --- identity and graph -----------------------------------------------------------

@query(O.select("SELECT DISTINCT team, ros AS token FROM identi", O.CELLS, O.ROWS, O.CONTESTS, O.identity(False), recursive=True))
def roster_token(spark, sf):
    rows = views.v1_identity(views.v1_rows(v1(spark, sf)))
    return rows.select("team", ident.roster_token("members").alias("token")).distinct()


def _keyed(spark, sf, season: bool):
    cells = v1(spark, sf)
    rows = views.v1_identity(views.v1_rows(cells))
    scope = None
    if season:
        rows = rows.join(views.v1_contests(cells).select("contest_id", text.season_of("year", "contest_name").alias("season")), "contest_id")
        scope = "season"
    known = ident.identities(ident.identity_edges(rows, scope))
    return ident.with_team_key(rows, known, scope)


@query(O.select("SELECT contest_id, team, team_key FROM keyedi", O.CELLS, O.ROWS, O.CONTESTS, O.identity(False), recursive=True))
def team_identity(spark, sf):
    return _keyed(spark, sf, False).select("contest_id", "team", "team_key")


@query(O.select("SELECT contest_id, team, team_key FROM keyedi", O.CELLS, O.ROWS, O.CONTESTS, O.identity(True), recursive=True))
def team_identity_season(spark, sf):
    return _keyed(spark, sf, True).select("contest_id", "team", "team_key")


@query(O.select("SELECT * FROM pairsp", O.CELLS, O.ROWS, O.CONTESTS, O.identity(False), O.pairs("p", "team_key", "keyedi"), recursive=True))
def contest_pairs(spark, sf):
    return ident.contest_pairs(_keyed(spark, sf, False))


@query(O.select("SELECT a, b, weight FROM pairsp WHERE weight >= 2", O.CELLS, O.ROWS, O.CONTESTS, O.pairs("p", "team || '@' || coalesce(CAST(year AS VARCHAR), 'None')", "(SELECT * FROM allrows JOIN contests USING (contest_id))")))
def contest_pairs_by_year(spark, sf):
    """Teams count as another in each year; display edges have weight 2 or more."""
    cells = v1(spark, sf)
    rows = views.v1_rows(cells).join(views.v1_contests(cells).select("contest_id", "year"), "contest_id")
    rows = rows.withColumn("team_id", F.col("team").cast("string")).withColumn("members", F.lit(None).cast("array<string>"))
    known = ident.identities(ident.identity_edges(rows, suffix="year"))
    return ident.contest_pairs(ident.with_team_key(rows, known, suffix="year"), min_weight=2)


@query(O.select("SELECT a, b, weight FROM pairsp WHERE weight >= 20", O.BASE, O.pairs("p", "team", "keptrows")))
def edges_min_weight(spark, sf):
    return ident.contest_pairs(kept_rows(v1(spark, sf)), "team", 20)


@query(O.select("SELECT contest_id, dense_rank() OVER (ORDER BY size DESC, least) - 1 AS component, size FROM labelsc", O.BASE, O.pairs("c", "team", "keptrows"), O.linked("c", "pairsc", "keptrows"), recursive=True))
def contest_components(spark, sf):
    """Components over the links of all kept rows."""
    rows = kept_rows(v1(spark, sf))
    return ident.contest_components(rows, ident.contest_pairs(rows, "team"))


# --- primitives and the fixed point -----------------------------------------------

@query("SELECT c_custkey AS team, p.b AS b, round(1 / (1 + pow(10, (p.b - (1500 + c_custkey * 37 % 1000)) / 400)), 6) AS p FROM customer, (VALUES (1200.0), (2000.0), (2800.0)) p(b)")
def elo_pi(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("team"), F.explode(F.array(F.lit(1200.0), F.lit(2000.0), F.lit(2800.0))).alias("b"))
    return c.select("team", "b", r(rating.pi(1500 + F.col("team") * 37 % 1000, "b"), 6).alias("p"))


_FLAT = "flat AS MATERIALIZED (SELECT DISTINCT team, 1500.0 + team * 37 % 1000 AS theta FROM keptrows)"


def _flat(rows):
    return rows.select("team", (1500.0 + F.col("team") * 37 % 1000).alias("theta")).distinct()


@query(O.select("SELECT contest_id, label, round(b, 3) AS b FROM ratedr", O.BASE, _FLAT, O.rate("flat")))
def weighted_rating(spark, sf):
    cells = v1(spark, sf)
    rows = kept_rows(cells)
    return fp.rate_problems(cells.select(*PROBLEM).distinct(), rows, C.kept_cells(cells), _flat(rows)).select(*PROBLEM, r("b", 3).alias("b"))


@query(O.select("SELECT contest_id, team, round(perf, 2) AS perf FROM perfp", O.BASE, _FLAT, "pfield AS MATERIALIZED (SELECT contest_id, team, rank, theta FROM keptrows JOIN flat USING (team))", O.performance("pfield", "p")))
def performance_rating(spark, sf):
    rows = kept_rows(v1(spark, sf))
    return fp.performance_ratings(rows, _flat(rows)).select("contest_id", "team", r("perf", 2).alias("perf"))


@query(O.select(f"SELECT team, round(theta, 2) AS theta FROM fa_{FP_STEPS}", O.BASE, O.fixedpoint("keptrows", "a", FP_STEPS)))
def fixedpoint_theta(spark, sf):
    theta, *_ = converged(fp.estimate)(kept_rows(v1(spark, sf)))
    return theta.select("team", r("theta", 2).alias("theta"))


@query(O.select("SELECT contest_id, label, round(b, 2) AS b FROM ratedr", O.BASE, O.fixedpoint("keptrows", "a", FP_STEPS), O.rate(f"fa_{FP_STEPS}")))
def fixedpoint_difficulty(spark, sf):
    cells = v1(spark, sf)
    rows = kept_rows(cells)
    theta, *_ = converged(fp.estimate)(rows)
    return fp.rate_problems(cells.select(*PROBLEM).distinct(), rows, C.kept_cells(cells), theta).select(*PROBLEM, r("b", 2).alias("b"))


@query(O.select(f"SELECT team, round(theta, 2) AS theta FROM fb_{FP_STEPS}", O.BASE, "trusted AS MATERIALIZED (SELECT * FROM keptrows WHERE contest_id % 4 = 0)", O.fixedpoint("trusted", "a", FP_STEPS),
    f"prior AS MATERIALIZED (SELECT team, (2000.0 + w * n * theta) / (1 + w * n) AS mu, 1 + w * n AS strength FROM wa JOIN fa_{FP_STEPS} USING (team))", "later AS MATERIALIZED (SELECT * FROM keptrows WHERE contest_id % 4 <> 0)", O.fixedpoint("later", "b", FP_STEPS, "prior")))
def fixedpoint_anchored(spark, sf):
    rows = kept_rows(v1(spark, sf))
    theta, *_ = anchor.anchored_fixedpoint(rows.where("contest_id % 4 = 0"), rows.where("contest_id % 4 <> 0"), fit_fn=converged(fp.estimate))
    return theta.select("team", r("theta", 2).alias("theta"))


# --- item response ----------------------------------------------------------------

def _fit(spark, sf, model):
    obs = C.exposure(kept(spark, sf))
    return obs, converged(irt.fit)(obs, model)


@query(O.select(f"SELECT team, round(theta, 3) AS theta FROM tm_{STEPS}", O.BASE, O.newton("rasch", STEPS, "kept", "m")))
def rasch_theta(spark, sf):
    return _fit(spark, sf, "rasch")[1][0].select("team", r("theta", 3).alias("theta"))


@query(O.select(f"SELECT contest_id, label, round(b, 3) AS b FROM bm_{STEPS}", O.BASE, O.newton("rasch", STEPS, "kept", "m")))
def rasch_difficulty(spark, sf):
    return _fit(spark, sf, "rasch")[1][1].select(*PROBLEM, r("b", 3).alias("b"))


def _se_sql(model):
    p = "1 / (1 + pow(10, (b - theta) / 400))"
    cur = f"({p}) * (1 - {p})" if model == "rasch" else f"{O.LN2!r} * exp((theta - b) / {O.S!r}) * rho"
    return O.select(f"SELECT contest_id, label, round(1 / sqrt(sum({cur}) / {O.S**2!r} + {1 / 400.0**2!r}), 3) AS se FROM obs JOIN tm_{STEPS} USING (team) JOIN bm_{STEPS} USING (contest_id, label) GROUP BY 1,2", O.BASE, O.LENGTH, O.newton(model, STEPS, "obs", "m"))


@query(_se_sql("rasch"))
def rasch_se(spark, sf):
    obs, (theta, b, *_) = _fit(spark, sf, "rasch")
    return irt.standard_errors(obs, theta, b, "rasch").select(*PROBLEM, r("se", 3).alias("se"))


@query(O.select(f"SELECT contest_id, label, round(b, 3) AS b FROM bm_{STEPS}", O.BASE, O.LENGTH, O.newton("survival", STEPS, "obs", "m")))
def survival_difficulty(spark, sf):
    return _fit(spark, sf, "survival")[1][1].select(*PROBLEM, r("b", 3).alias("b"))


@query(_se_sql("survival"))
def survival_se(spark, sf):
    obs, (theta, b, *_) = _fit(spark, sf, "survival")
    return irt.standard_errors(obs, theta, b, "survival").select(*PROBLEM, r("se", 3).alias("se"))


def _anchored(spark, sf, model):
    obs = C.exposure(kept(spark, sf))
    return anchor.anchored_fit(obs.where("contest_id % 4 = 0"), obs.where("contest_id % 4 <> 0"), fit_fn=converged(irt.fit), model=model)[1].select(*PROBLEM, r("b", 3).alias("b"))


def _anchored_sql(model):
    return O.select(f"SELECT contest_id, label, round(b, 3) AS b FROM bn_{STEPS}", O.BASE, O.LENGTH, "early AS MATERIALIZED (SELECT * FROM obs WHERE contest_id % 4 = 0)", "late AS MATERIALIZED (SELECT * FROM obs WHERE contest_id % 4 <> 0)", O.newton(model, STEPS, "early", "m"), O.newton(model, STEPS, "late", "n", f"tm_{STEPS}"))


@query(_anchored_sql("rasch"))
def rasch_anchored(spark, sf):
    return _anchored(spark, sf, "rasch")


@query(_anchored_sql("survival"))
def survival_anchored(spark, sf):
    return _anchored(spark, sf, "survival")


@query(O.select(f"SELECT contest_id, label, round(b, 3) AS b, round(exp(g), 5) AS alpha FROM bd_{TWO_STEPS}", O.BASE, O.twopl(TWO_STEPS, 15, "kept")))
def twopl_alpha(spark, sf):
    return converged(irt.fit_2pl)(kept(spark, sf))[1].select(*PROBLEM, r("b", 3).alias("b"), r("alpha", 5).alias("alpha"))


# --- metrics and validation -------------------------------------------------------

@query(O.select(f"SELECT contest_id, round(rho, 5) AS rho, n FROM {O.spearman('quick', 'b', 'solved', 'contest_id', 'label')}", O.BASE, O.COUNTS, O.QUICK))
def spearman_by_contest(spark, sf):
    return metrics.spearman(quick(kept(spark, sf)), "b", "solved", ["contest_id"], ["label"]).select("contest_id", r("rho", 5).alias("rho"), "n")


@query(O.select(f"SELECT round(median(rho), 5) AS median_rho, count(*) AS contests FROM {O.spearman('quick', 'b', 'rating', 'contest_id', 'label')} WHERE n >= 3 AND rho IS NOT NULL", O.BASE, O.COUNTS, O.QUICK))
def median_spearman(spark, sf):
    s = metrics.spearman(quick(kept(spark, sf)), "b", "rating", ["contest_id"], ["label"])
    return s.where("n >= 3 and rho is not null").agg(r(F.median("rho"), 5).alias("median_rho"), F.count("*").alias("contests"))


_LEVEL = "CASE (contest_id + label) % 7 WHEN 0 THEN 'very_easy' WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' WHEN 3 THEN 'hard' WHEN 4 THEN 'very_hard' ELSE 'unknown' END"


@query(O.select(f"""SELECT CASE lab WHEN 'very_easy' THEN 0 WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END AS level, count(*) AS n, round(median(b), 3) AS median_b, round(avg(b), 3) AS mean_b
 FROM (SELECT *, {_LEVEL} AS lab FROM quick WHERE contest_id % 3 <> 0) WHERE lab <> 'unknown' GROUP BY 1""", O.BASE, O.COUNTS, O.QUICK))
def llm_bucket_report(spark, sf):
    """Difficulty by label level, where the contest has an editorial."""
    return with_level(quick(kept(spark, sf))).groupBy("level").agg(F.count("*").alias("n"), r(F.median("b"), 3).alias("median_b"), r(F.avg("b"), 3).alias("mean_b"))


@query("SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS alnum, trim(regexp_replace(lower('  ' || p_name || '   X'), '\\s+', ' ', 'g')) AS spaced FROM part")
def name_norms(spark, sf):
    p = views.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), text.norm_alnum("p_name").alias("alnum"), text.norm_space(F.concat(F.lit("  "), "p_name", F.lit("   X"))).alias("spaced"))


@query("""WITH own AS (SELECT p_partkey % 40 AS mirror, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part), n AS (SELECT mirror, count(*) AS n FROM own GROUP BY 1),
 theirs AS (SELECT DISTINCT (p_partkey // 2) % 50 AS contest, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part WHERE p_partkey % 3 <> 0),
 votes AS (SELECT mirror, contest, count(*) AS hits FROM own JOIN theirs USING (k) GROUP BY 1,2), best AS (SELECT *, row_number() OVER (PARTITION BY mirror ORDER BY hits DESC, contest) AS r FROM votes)
 SELECT mirror, contest, hits, n FROM best JOIN n USING (mirror) WHERE r = 1 AND hits >= 0.05 * n""")
def mirror_vote(spark, sf):
    """Each mirror's contest by a vote of problem names, if enough of them agree."""
    p = views.table(spark, sf, "part").withColumn("k", text.norm_alnum("p_name"))
    own = p.select((F.col("p_partkey") % 40).alias("mirror"), "k")
    theirs = p.where("p_partkey % 3 <> 0").select((F.floor(F.col("p_partkey") / 2) % 50).alias("contest"), "k").distinct()
    votes = own.join(theirs, "k").groupBy("mirror", "contest").agg(F.count("*").alias("hits"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("mirror").orderBy(F.desc("hits"), "contest"))).where("r = 1")
    return best.join(own.groupBy("mirror").agg(F.count("*").alias("n")), "mirror").where("hits >= 0.05 * n").select("mirror", "contest", "hits", "n")


_MODELS = "models AS MATERIALIZED (SELECT region, 'quick' AS model, contest_id, label, b AS x, rating FROM quick JOIN contests USING (contest_id) UNION ALL SELECT region, 'solves', contest_id, label, -CAST(solved AS DOUBLE), rating FROM quick JOIN contests USING (contest_id))"


@query(O.select(f"SELECT region, model, round(rho, 5) AS rho, n FROM {O.spearman('models', 'x', 'rating', 'region, model', 'contest_id, label', 4)} UNION ALL SELECT 'pooled', model, round(rho, 5), n FROM {O.spearman('models', 'x', 'rating', 'model', 'contest_id, label', 4)}", O.BASE, O.COUNTS, O.QUICK, O.CONTESTS, _MODELS))
def region_model_matrix(spark, sf):
    """Rank correlation with the outside rating by region and model, and pooled; null below four problems."""
    cells = v1(spark, sf)
    q = quick(C.kept_cells(cells)).join(views.v1_contests(cells).select("contest_id", F.coalesce("region", F.lit("?")).alias("region")), "contest_id", "left")
    m = q.select("region", *PROBLEM, "rating", F.explode(F.array(F.struct(F.lit("quick").alias("model"), F.col("b").alias("x")), F.struct(F.lit("solves").alias("model"), (-F.col("solved").cast("double")).alias("x")))).alias("m")).select("region", *PROBLEM, "rating", "m.*")
    pooled = m.withColumn("region", F.lit("pooled"))
    return metrics.spearman(m.unionByName(pooled), "x", "rating", ["region", "model"], PROBLEM, 4, spread=True).select("region", "model", r("rho", 5).alias("rho"), "n")


@query(O.select("SELECT round(regr_slope(rating, b), 6) AS slope, round(regr_intercept(rating, b), 3) AS intercept, round(corr(b, rating), 6) AS pearson, count(*) AS n FROM quick", O.BASE, O.COUNTS, O.QUICK))
def affine_fit(spark, sf):
    slope, inter = metrics.affine("b", "rating")
    return quick(kept(spark, sf)).agg(r(slope, 6).alias("slope"), r(inter, 3).alias("intercept"), r(F.corr("b", "rating"), 6).alias("pearson"), F.count("*").alias("n"))


@query(O.select("""SELECT round(sqrt(avg(pow(fa * b + fc - rating, 2))), 3) AS fit_rmse, round(sqrt(avg(pow(a * b + c - rating, 2))), 3) AS loco_rmse, count(*) AS n FROM quick JOIN
 (SELECT g.contest_id, regr_slope(rating, b) AS a, regr_intercept(rating, b) AS c FROM (SELECT DISTINCT contest_id FROM quick) g JOIN quick q ON q.contest_id <> g.contest_id GROUP BY 1) USING (contest_id),
 (SELECT regr_slope(rating, b) AS fa, regr_intercept(rating, b) AS fc FROM quick)""", O.BASE, O.COUNTS, O.QUICK))
def loco_rmse(spark, sf):
    got = metrics.loco_rmse(quick(kept(spark, sf)), "b", "rating", "contest_id")
    return got.select(r("fit_rmse", 3).alias("fit_rmse"), r("loco_rmse", 3).alias("loco_rmse"), "n")


@query(O.select("SELECT contest_id, label, round(greatest(least(a * b + c, 4000.0), 800.0), 2) AS calibrated, round(a * 80, 4) AS se FROM quick, (SELECT regr_slope(rating, b) AS a, regr_intercept(rating, b) AS c FROM quick)", O.BASE, O.COUNTS, O.QUICK))
def calibrated(spark, sf):
    q = quick(kept(spark, sf))
    return export.apply_calibration(q.withColumn("se", F.lit(80.0)), q, "b", "rating").select(*PROBLEM, r("calibrated", 2).alias("calibrated"), r("calibrated_se", 4).alias("se"))


_SPLIT = "(team * 31 + label * 17 + contest_id) % 100 < 20"
_TEST = f"test AS MATERIALIZED (SELECT y, 1 / (1 + pow(10, (b - theta) / 400)) AS p, contest_id, team, label FROM kept JOIN tm_{STEPS} USING (team) JOIN bm_{STEPS} USING (contest_id, label) WHERE {_SPLIT})"
_TRAIN = f"train AS MATERIALIZED (SELECT * FROM kept WHERE NOT ({_SPLIT}))"


def _held_out(spark, sf):
    obs = kept(spark, sf)
    theta, b, *_ = converged(irt.fit)(obs.where(f"not ({_SPLIT})"), "rasch")
    return obs.where(_SPLIT).join(theta.select("team", "theta"), "team").join(b, PROBLEM).withColumn("p", irt.predicted("rasch"))


@query(O.select("""SELECT round(avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))), 5) AS log_loss, round(avg(pow(pc - y, 2)), 5) AS brier, round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 5) AS auc, count(*) AS n
 FROM (SELECT y, pc, row_number() OVER (ORDER BY pc, contest_id, team, label) AS rk FROM (SELECT *, greatest(least(round(p, 9), 0.999999), 0.000001) AS pc FROM test))""", O.BASE, _TRAIN, O.newton("rasch", STEPS, "train", "m"), _TEST))
def holdout_metrics(spark, sf):
    t = _held_out(spark, sf).withColumn("p", F.round("p", 9))
    m = metrics.holdout_metrics(t, "y", "p", ["contest_id", "team", "label"])
    return m.select(*(r(c, 5).alias(c) for c in ("log_loss", "brier", "auc")), "n")


@query(O.select("""SELECT CASE WHEN p < 0.1 THEN 0 WHEN p < 0.3 THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.7 THEN 3 WHEN p < 0.9 THEN 4 ELSE 5 END AS bin, count(*) AS n, round(avg(p), 5) AS mean_pred, round(avg(y), 5) AS rate FROM test GROUP BY 1""", O.BASE, _TRAIN, O.newton("rasch", STEPS, "train", "m"), _TEST))
def calibration_bins(spark, sf):
    return metrics.calibration_bins(_held_out(spark, sf), "y", "p").select("bin", "n", r("mean_pred", 5).alias("mean_pred"), r("rate", 5).alias("rate"))


@query(O.select(f"""SELECT region, count(*) AS n, round(quantile_cont(alpha, 0.25), 4) AS q25, round(median(alpha), 4) AS q50, round(quantile_cont(alpha, 0.75), 4) AS q75, round(quantile_cont(alpha, 0.9), 4) AS q90, round(sqrt(avg(e * e)), 3) AS resid_sd, median(field) AS med_field
 FROM (SELECT region, alpha, field, b - (a * x + c) AS e FROM two JOIN (SELECT region, regr_slope(b, x) AS a, regr_intercept(b, x) AS c FROM two GROUP BY 1) USING (region)) GROUP BY 1""",
    O.BASE, O.COUNTS, O.CONTESTS, O.twopl(TWO_STEPS, 15, "kept"), f"two AS MATERIALIZED (SELECT region, b, exp(g) AS alpha, field, ln(greatest(least(rate, 0.99), 0.01) / (1 - greatest(least(rate, 0.99), 0.01))) AS x FROM bd_{TWO_STEPS} JOIN counts USING (contest_id, label) JOIN contests USING (contest_id))"))
def twopl_region_quantiles(spark, sf):
    """Discrimination by region, and how tightly difficulty follows the solve rate."""
    cells = v1(spark, sf)
    obs = C.kept_cells(cells)
    b = converged(irt.fit_2pl)(obs)[1]
    t = b.join(C.solve_counts(obs), PROBLEM).join(views.v1_contests(cells).select("contest_id", "region"), "contest_id").withColumn("x", rating.logit("rate"))
    w = Window.partitionBy("region")
    t = t.withColumn("e", F.col("b") - (F.regr_slope("b", "x").over(w) * F.col("x") + F.regr_intercept("b", "x").over(w)))
    q = lambda p: r(F.percentile("alpha", F.lit(p)), 4)
    return t.groupBy("region").agg(F.count("*").alias("n"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), q(0.9).alias("q90"), r(F.stddev_pop("e"), 3).alias("resid_sd"), F.median("field").alias("med_field"))


@query(O.select("SELECT team, count(*) AS contests FROM keptrows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", O.BASE))
def top_recurring_teams(spark, sf):
    return kept_rows(v1(spark, sf)).groupBy("team").agg(F.count("*").alias("contests")).orderBy(F.desc("contests"), "team").limit(5)


@query(O.select("SELECT round(min(b), 3) AS least, round(max(b), 3) AS most, round(avg(b), 3) AS mean, count(*) AS n FROM quick", O.BASE, O.COUNTS, O.QUICK))
def rating_summary(spark, sf):
    return quick(kept(spark, sf)).agg(r(F.min("b"), 3).alias("least"), r(F.max("b"), 3).alias("most"), r(F.avg("b"), 3).alias("mean"), F.count("*").alias("n"))


# --- outside yardsticks --------------------------------------------------------------

def named(cells: DataFrame) -> DataFrame:
    """Quick difficulties with made-up titles, some of which several contests share, ids, labels and editorials."""
    q = quick(cells).withColumn("code", (F.col("contest_id") * 8 + F.col("label")) % 97)
    q = q.withColumn("name", F.concat(F.lit("Task "), F.expr("char(65 + label)"), F.lit(" "), F.col("code").cast("string")))
    q = q.withColumn("problem_id", F.concat(F.lit("p"), F.col("contest_id").cast("string"), F.lit("-"), F.col("label").cast("string")))
    q = q.withColumn("difficulty_estimate", F.element_at(F.array(*map(F.lit, (*text.FIVE_LEVELS, "unknown", "unknown"))), ((F.col("contest_id") + F.col("label")) % 7 + 1).cast("int")))
    url = F.when(F.col("contest_id") % 4 == 0, F.lit("")).when(F.col("contest_id") % 4 != 1, F.lit("http://notes/"))
    return q.withColumn("editorial", F.when(F.col("contest_id") % 3 != 0, F.lit(" see notes "))).withColumn("editorial_url", url)


_ALNUM, _SPACED = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')", "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_NAMED = """named AS MATERIALIZED (SELECT *, 'Task ' || chr(CAST(65 + label AS INT)) || ' ' || code AS name, 'p' || contest_id || '-' || label AS problem_id,
 (contest_id + label) % 7 AS five, CASE WHEN (contest_id + label) % 7 BETWEEN 1 AND 4 THEN (contest_id + label) % 7 - 1 END AS four FROM (SELECT *, (contest_id * 8 + label) % 97 AS code FROM quick))"""
_LABELLED = """labelled AS MATERIALIZED (SELECT 'editorial' AS definition, contest_id, label, CASE WHEN label <> 7 THEN problem_id END AS problem_id, CASE WHEN contest_id % 5 = 0 THEN upper(name) ELSE name END AS name, five AS level FROM named WHERE contest_id % 3 <> 0 AND five < 5
 UNION ALL SELECT 'url', contest_id, label, CASE WHEN label <> 7 THEN problem_id END, CASE WHEN contest_id % 5 = 0 THEN upper(name) ELSE name END, four FROM named WHERE contest_id % 4 IN (2, 3) AND four IS NOT NULL)"""


@query(O.select("SELECT definition, key, round(rho, 5) AS rho, n FROM " + O.spearman("""(SELECT definition, 'id' AS key, contest_id, label, b, l.level FROM named JOIN labelled l USING (contest_id, problem_id, label)
 UNION ALL SELECT definition, 'label', contest_id, label, b, l.level FROM named JOIN labelled l USING (contest_id, label) UNION ALL SELECT definition, 'name', contest_id, label, b, l.level FROM named JOIN labelled l USING (contest_id, name, label))""", "level", "b", "definition, key", "contest_id, label"),
    O.BASE, O.COUNTS, O.QUICK, _NAMED, _LABELLED))
def label_agreement(spark, sf):
    """Difficulties against label levels: two definitions of a labelled problem, three keys to match by."""
    p = Scratch(spark, "named").table(named(kept(spark, sf)), "named")
    # labels come from elsewhere: some ids are unknown there, some titles are written in capitals
    theirs = p.withColumn("problem_id", F.when(F.col("label") != 7, F.col("problem_id"))).withColumn("name", F.when(F.col("contest_id") % 5 == 0, F.upper("name")).otherwise(F.col("name")))
    out = None
    for definition, labelled in (("editorial", validate.with_editorial(theirs)), ("url", validate.with_editorial_url(theirs))):
        for key in validate.LABEL_KEYS:
            one = validate.label_pairs(p, labelled, key).select(F.lit(definition).alias("definition"), F.lit(key).alias("key"), "*")
            out = one if out is None else out.unionByName(one)
    return metrics.spearman(out, "level", "b", ["definition", "key"], PROBLEM, spread=True).select("definition", "key", r("rho", 5).alias("rho"), "n")


@query(O.select(f"""SELECT o.contest_id, o.label, round(o.b, 3) AS b, o.rating FROM named o JOIN (SELECT contest_id, {_SPACED.format("'  ' || replace(upper(name), ' ', '   ')")} AS k FROM named WHERE contest_id % 7 = 0) t ON o.contest_id = t.contest_id AND {_SPACED.format('o.name')} = t.k""", O.BASE, O.COUNTS, O.QUICK, _NAMED))
def calibration_anchors(spark, sf):
    """Anchors matched by contest and spaced name; the outside table writes names in capitals and wide."""
    p = named(kept(spark, sf))
    outside = p.where("contest_id % 7 = 0").select("contest_id", F.concat(F.lit("  "), F.replace(F.upper("name"), F.lit(" "), F.lit("   "))).alias("name"), "rating")
    return validate.anchor_pairs(p.drop("rating"), outside).select(*PROBLEM, r("b", 3).alias("b"), "rating")


def _outside(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A made-up problem set that mirrors every fourth contest, and a table of titles."""
    mirrored = p.where("contest_id % 4 = 1 and label <> 7").select((F.col("contest_id") + 100_000).alias("contest"), text.norm_alnum(F.concat(F.upper("name"), F.lit(" !"))).alias("key"), "rating")
    titles = p.where("code % 2 = 0").select(text.norm_alnum("name").alias("key"), ((F.col("code") + F.col("label") * 10) / 10).alias("difficulty")).distinct()
    return mirrored, titles


_MIRRORED = f"""cfset AS MATERIALIZED (SELECT contest_id + 100000 AS mirror, {_ALNUM.format("upper(name) || ' !'")} AS key, rating AS outside FROM named WHERE contest_id % 4 = 1 AND label <> 7),
titles AS MATERIALIZED (SELECT DISTINCT {_ALNUM.format('name')} AS key, (code + label * 10) / 10 AS outside FROM named WHERE code % 2 = 0),
votes AS (SELECT mirror, n.contest_id, count(*) AS hits FROM cfset c JOIN (SELECT DISTINCT contest_id, {_ALNUM.format('name')} AS key FROM named) n USING (key) GROUP BY 1,2),
mirrors AS MATERIALIZED (SELECT mirror, contest_id FROM (SELECT *, row_number() OVER (PARTITION BY mirror ORDER BY hits DESC, contest_id) AS r FROM votes) JOIN (SELECT mirror, count(*) AS n FROM cfset GROUP BY 1) USING (mirror) WHERE r = 1 AND hits >= 0.6 * n),
mpairs AS MATERIALIZED (SELECT mirror, contest_id, label, name, b, solved, outside FROM named JOIN mirrors USING (contest_id) JOIN cfset c USING (mirror) WHERE c.key = {_ALNUM.format('name')}),
tpairs AS MATERIALIZED (SELECT contest_id, label, b, outside FROM named JOIN titles t ON t.key = {_ALNUM.format('name')})"""


@query(O.select(" UNION ALL ".join(f"SELECT '{source}' AS source, region, round(rho, 5) AS rho, n FROM {O.spearman(f'(SELECT * FROM {pairs} JOIN contests USING (contest_id))', 'b', 'outside', 'region', 'contest_id, label', 4)} UNION ALL SELECT '{source}', 'pooled', round(rho, 5), n FROM {O.spearman(f'(SELECT * FROM {pairs} JOIN contests USING (contest_id) WHERE {where})', 'b', 'outside', '', 'contest_id, label', 4)}" for source, pairs, where in (("mirror", "mpairs", "true"), ("titles", "tpairs", "region IN ('North', 'East')"))),
    O.BASE, O.COUNTS, O.QUICK, O.CONTESTS, _NAMED, _MIRRORED))
def outside_agreement(spark, sf):
    """Difficulties against a mirrored problem set and a table of titles, by region and pooled."""
    cells = v1(spark, sf)
    p = Scratch(spark, "named").table(named(C.kept_cells(cells)), "named")
    contests, (mirrored, titles) = views.v1_contests(cells), _outside(p)
    pairs = validate.mirror_pairs(p, validate.mirror_contests(mirrored, p), mirrored)
    by_mirror = validate.agreement(pairs.select(*PROBLEM, "b", "outside"), contests).withColumn("source", F.lit("mirror"))
    by_title = validate.agreement(validate.title_pairs(p, titles), contests, pooled=["North", "East"]).withColumn("source", F.lit("titles"))
    return by_mirror.unionByName(by_title).select("source", "region", r("rho", 5).alias("rho"), "n")


@query(O.select("SELECT label, outside, round(b, 3) AS quick, -CAST(solved AS DOUBLE) AS solves FROM mpairs WHERE mirror = 299301 ORDER BY label", O.BASE, O.COUNTS, O.QUICK, _NAMED, _MIRRORED))
def mirrored_contest(spark, sf):
    """One mirrored contest's problems by label, with the outside rating and two models."""
    p = Scratch(spark, "named").table(named(kept(spark, sf)), "named")
    mirrored, _ = _outside(p)
    pairs = validate.mirror_pairs(p, validate.mirror_contests(mirrored, p), mirrored)
    models = {"quick": p.withColumn("b", r("b", 3)), "solves": p.withColumn("b", -F.col("solved").cast("double"))}
    return validate.contest_detail(pairs, 299301, models).select("label", "outside", "quick", "solves")


@query(O.select(f"SELECT round(corr(x.b, y.b), 5) AS pearson, round(sqrt(avg(pow(x.b - y.b, 2))), 3) AS spread, count(*) AS n FROM bd_{TWO_STEPS} x JOIN bm_{STEPS} y USING (contest_id, label)", O.BASE, O.twopl(TWO_STEPS, 15, "kept"), O.newton("rasch", STEPS, "kept", "m")))
def twopl_vs_rasch(spark, sf):
    obs = kept(spark, sf)
    got = validate.compare_fits(converged(irt.fit_2pl)(obs)[1], converged(irt.fit)(obs, "rasch")[1])
    return got.select(r("pearson", 5).alias("pearson"), r("spread", 3).alias("spread"), "n")


def _models_sql() -> str:
    p = {"rasch": "1 / (1 + pow(10, (b - theta) / 400))", "survival": f"1 - exp(-{O.LN2!r} * exp((theta - b) / {O.S!r}))", "2pl": f"1 / (1 + exp(-(exp(g) / {O.S!r} * (theta - b))))"}
    tables = {"rasch": (f"tr_{STEPS}", f"br_{STEPS}"), "survival": (f"ts_{STEPS}", f"bs_{STEPS}"), "2pl": (f"td_{TWO_STEPS}", f"bd_{TWO_STEPS}")}
    test = " UNION ALL ".join(f"SELECT '{m}' AS model, y, contest_id, team, label, greatest(least(round({p[m]}, 9), 0.999999), 0.000001) AS pc FROM obs JOIN {t} USING (team) JOIN {b} USING (contest_id, label) WHERE {_SPLIT}" for m, (t, b) in tables.items())
    return O.select(f"""SELECT model, round(avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))), 5) AS log_loss, round(avg(pow(pc - y, 2)), 5) AS brier, round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 5) AS auc, count(*) AS n
 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pc, contest_id, team, label) AS rk FROM ({test})) GROUP BY 1""", O.BASE, O.LENGTH, f"train AS MATERIALIZED (SELECT * FROM obs WHERE NOT ({_SPLIT}))",
        O.newton("rasch", STEPS, "train", "r"), O.newton("survival", STEPS, "train", "s"), O.twopl(TWO_STEPS, 15, "train"))


@query(_models_sql())
def holdout_models(spark, sf):
    """Log loss, Brier score and AUC of all three models on held-out cells; contest lengths are those of all cells."""
    obs = Scratch(spark, "holdout").table(C.exposure(kept(spark, sf)), "obs")
    train, test, out = obs.where(f"not ({_SPLIT})"), obs.where(_SPLIT), None
    models = ("rasch", "survival", "2pl")
    dealt = irt.deal(train)  # once for all three

    def fitted(model):
        return converged(irt.fit_2pl)(train, dealt=dealt) if model == "2pl" else converged(irt.fit)(train, model, dealt=dealt)

    with ThreadPoolExecutor(1 if dealt is None else len(models)) as pool:  # a pass over blocks is mostly waiting
        # each with local properties of its own, which hold the id of the execution that a thread is in
        fits = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fitted), m) for m in models]]
    for model, (theta, b, *_) in zip(models, fits):
        t = test.join(theta.select("team", "theta"), "team").join(b, PROBLEM)
        t = t.select(F.lit(model).alias("model"), *PROBLEM, "team", "y", F.round(irt.predicted(model), 9).alias("p"))
        out = t if out is None else out.unionByName(t)
    if dealt is not None:
        dealt[0].release()
    got = metrics.holdout_metrics(out, "y", "p", ["contest_id", "team", "label"], ["model"])
    return got.select("model", *(r(c, 5).alias(c) for c in ("log_loss", "brier", "auc")), "n")


@query(O.select(f"""SELECT figure, round(value, 4) AS value FROM (SELECT 'least difficulty' AS figure, min(b) AS value FROM quick UNION ALL SELECT 'greatest difficulty', max(b) FROM quick UNION ALL SELECT 'mean difficulty', avg(b) FROM quick UNION ALL SELECT 'problems', count(*) FROM quick
 UNION ALL SELECT 'least ability', min(theta) FROM flat UNION ALL SELECT 'greatest ability', max(theta) FROM flat UNION ALL SELECT 'mean ability', avg(theta) FROM flat UNION ALL SELECT 'teams', count(*) FROM flat
 UNION ALL SELECT 'median rank correlation', median(rho) FROM own UNION ALL SELECT 'contests', count(*) FROM own)""", O.BASE, O.COUNTS, O.QUICK, _FLAT, f"own AS MATERIALIZED (SELECT rho FROM {O.spearman('quick', 'b', 'solved', 'contest_id', 'label')} WHERE n >= 3 AND rho IS NOT NULL)"))
def run_report(spark, sf):
    cells = v1(spark, sf)
    return validate.run_report(quick(C.kept_cells(cells)), _flat(kept_rows(cells))).select("figure", r("value").alias("value"))


@query(O.select("""SELECT (SELECT count(DISTINCT contest_id) FROM live) AS contests, (SELECT count(*) FROM live) AS rows, (SELECT count(*) FROM byteam) AS teams, (SELECT count(*) FROM byteam WHERE team_key LIKE 'mem:%') AS roster_teams,
 (SELECT count(*) FROM byteam WHERE n > 1) AS multi_contest_teams, (SELECT count(*) FROM byteam WHERE team_key LIKE 'dj:%') AS isolated_teams, (SELECT count(*) FROM (SELECT DISTINCT contest_id, label FROM cells)) AS problems""",
    O.CELLS, O.ROWS, O.CONTESTS, O.identity(False), "live AS MATERIALIZED (SELECT * FROM keyedi WHERE solved > 0)", "byteam AS MATERIALIZED (SELECT team_key, count(*) AS n FROM live GROUP BY 1)", recursive=True))
def data_summary(spark, sf):
    rows = Scratch(spark, "summary").table(_keyed(spark, sf, False).where("solved > 0").select("contest_id", "team_key"), "rows")
    return validate.data_summary(rows, v1(spark, sf).select(*PROBLEM).distinct())


@query(O.select("SELECT contest_id, contest_name AS name, coalesce(CAST(year AS VARCHAR), '?') AS year, dense_rank() OVER (ORDER BY size DESC, least) - 1 AS component FROM labelsc JOIN contests USING (contest_id)", O.CELLS, O.ROWS, O.CONTESTS, O.pairs("c", "team", "allrows"), O.linked("c", "pairsc", "allrows"), recursive=True))
def graph_nodes(spark, sf):
    cells = v1(spark, sf)
    rows = views.v1_rows(cells)
    return validate.graph_nodes(views.v1_contests(cells), ident.contest_components(rows, ident.contest_pairs(rows, "team")))


@query(O.select("SELECT contest_id, team, name, affiliation, row_number() OVER (ORDER BY lower(affiliation) DESC NULLS LAST, lower(name) NULLS LAST, contest_id, team) AS place FROM (SELECT contest_id, team, c_name AS name, c_mktsegment AS affiliation FROM keptrows LEFT JOIN customer ON team = c_custkey)", O.BASE))
def viewer_sorted(spark, sf):
    """The viewer's table by affiliation, falling, then by name; strings by lower case."""
    rows = kept_rows(v1(spark, sf))
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("team"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("affiliation"))
    t = rows.join(c, "team", "left").select("contest_id", "team", "name", "affiliation")
    return numbered(t, validate.viewer_order(t, "affiliation", True) + validate.viewer_order(t, "name", ties=("contest_id", "team")), "place")


# --- export -----------------------------------------------------------------------

@query(O.select("SELECT contest_id, contest_name AS name, coalesce(CAST(year AS VARCHAR), '?') AS year, region, teams, mean_theta, row_number() OVER (ORDER BY coalesce(year, 0) DESC, contest_name, contest_id) AS place FROM contests JOIN (SELECT contest_id, count(*) AS teams, round(avg(1500.0 + team * 37 % 1000), 0) AS mean_theta FROM keptrows GROUP BY 1) USING (contest_id)", O.BASE, O.CONTESTS))
def viewer_contests(spark, sf):
    cells = v1(spark, sf)
    rows = kept_rows(cells)
    return export.contest_list(views.v1_contests(cells), rows.join(_flat(rows), "team"))


@query(O.select("SELECT contest_id, team, coalesce(nullif(c_name, ''), '(unnamed)') AS name, coalesce(c_mktsegment, '') AS affiliation, rank, solved FROM keptrows LEFT JOIN customer ON team = c_custkey WHERE lower(concat_ws(' ', c_name, c_mktsegment)) LIKE '%build%'", O.BASE))
def viewer_teams(spark, sf):
    rows = kept_rows(v1(spark, sf))
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("team"), "c_name", "c_mktsegment")
    named = rows.join(c, "team", "left").select("contest_id", "team", text.or_default("c_name", "(unnamed)").alias("name"), text.or_default("c_mktsegment", "").alias("affiliation"), "rank", "solved")
    return named.where(text.text_filter("Build", "name", "affiliation"))


_TRIALS = {"baseline": ("s", "SELECT * FROM keyedi"), "filtered": ("t", "SELECT k.* FROM keyedi k JOIN long USING (contest_id)"), "season filtered": ("u", "SELECT k.* FROM keyedj k JOIN long USING (contest_id)")}


def _season_sql() -> str:
    ctes, rows = [], []
    for name, (tag, source) in _TRIALS.items():
        own, body = O.trial(tag, f"rows{tag}", STEPS)
        ctes += [f"rows{tag} AS MATERIALIZED (SELECT contest_id, team, team_key FROM ({source}) WHERE solved > 0)", *own]
        rows.append(f"SELECT '{name}' AS cfg, * FROM ({body})")
    long = "long AS MATERIALIZED (SELECT contest_id FROM cells GROUP BY 1 HAVING max(tau) >= 3.5 * 3600)"
    return O.select(" UNION ALL ".join(rows), O.BASE, O.COUNTS, O.QUICK, O.CONTESTS, O.identity(False, "i"), O.identity(True, "j"), long, *ctes, recursive=True)


@query(_season_sql())
def season_experiment(spark, sf):
    """Three configurations of identity and filter: what they leave, how it hangs together, and how well the anchored survival fit agrees with outside ratings and label levels."""
    plain, season = _keyed(spark, sf, False), _keyed(spark, sf, True)
    long = short_contest_filter(spark, sf).select("contest_id")
    parts = [("baseline", plain), ("filtered", plain.join(long, "contest_id", "left_semi")), ("season filtered", season.join(long, "contest_id", "left_semi"))]
    cells = kept(spark, sf)
    ratings = quick(cells).select(*PROBLEM, "rating")
    scratch, out = Scratch(spark, "season"), None
    for name, rows in parts:
        rows = scratch.table(rows.where("solved > 0").select("contest_id", "team", "team_key"), "rows")
        one = scratch.table(trial(rows, cells, ratings).select(F.lit(name).alias("cfg"), "*"), "trial")
        out = one if out is None else out.unionByName(one)
    return out


def trial(rows: DataFrame, cells: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row of figures for kept rows (contest_id, team, team_key), kept cells and outside ratings by problem.

    Abilities belong to team keys.  Contests that stand for the trusted seasons
    are fitted first and give the prior means of the fit of all.
    """
    keyed = cells.join(rows, ["contest_id", "team"]).drop("team").withColumnRenamed("team_key", "team")
    obs = Scratch(cells.sparkSession, "trial").table(C.exposure(keyed), "obs")
    b = anchor.anchored_fit(obs.where("contest_id % 4 = 0"), obs, fit_fn=converged(irt.fit), model="survival")[1]
    comps = ident.contest_components(rows, ident.contest_pairs(rows)).agg(F.countDistinct("component").alias("components"), F.max("size").alias("largest"))
    rated = b.join(ratings, PROBLEM)
    counts = rows.agg(F.countDistinct("team_key").alias("teams"), F.countDistinct("contest_id").alias("contests"))
    outside = metrics.spearman(rated, "b", "rating", ties=PROBLEM).select(r("rho", 5).alias("spearman"))
    loco = metrics.loco_rmse(rated, "b", "rating", "contest_id").select(r("loco_rmse", 3).alias("loco_rmse"))
    levels = metrics.spearman(with_level(b), "level", "b", ties=PROBLEM).select(r("rho", 5).alias("level_spearman"))
    # counts has exactly one row, and so has the result
    return counts.join(comps).join(outside, F.lit(True), "left").join(loco, F.lit(True), "left").join(levels, F.lit(True), "left")


@query(None)
def json_export(spark, sf):
    """Ratings as records, written and read back."""
    return export.round_trip(quick(kept(spark, sf)).select(*PROBLEM, F.bround("b", 1).alias("difficulty"), "solved"))


@query(None)
def html_export(spark, sf):
    """One HTML page with the contests' data embedded."""
    cells = v1(spark, sf)
    rows = kept_rows(cells)
    contests = export.contest_list(views.v1_contests(cells), rows.join(_flat(rows), "team"))
    return export.html_page(contests, "Contests")

