"""Evaluation queries over the out-of-fold predictions table."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketwise.functions.ranking import md5_order, spread_rank
from basketwise.functions.skew import join_to_rows
from basketwise.operators import agreement, ensemble, features, folds, interpret, metrics, ranktests, selection
from basketwise.plans import tables as t
from basketwise.plans.q_features import base_features, feats_cte
from basketwise.plans.registry import Registry, rounded
from basketwise.session import materialize

R = Registry()

PC = """conf AS (SELECT model_id, representation, algorithm, repeat_seed, outer_fold, fold_id, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL),
pc AS (SELECT model_id, fold_id, label, coalesce(sum(n) FILTER (WHERE y_true = label AND y_pred = label), 0) AS tp,
    coalesce(sum(n) FILTER (WHERE y_true = label), 0) AS support, coalesce(sum(n) FILTER (WHERE y_pred = label), 0) AS predicted
  FROM conf, (SELECT CAST(unnest([2, 3, 4]) AS BIGINT) AS label) GROUP BY ALL),
prf AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM pc),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM prf),
fs AS (SELECT model_id, fold_id, any_value(substr(model_id, 1, 2)) AS representation, any_value(substr(model_id, 4)) AS algorithm,
    CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy, avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f1) AS macro_f1
  FROM f GROUP BY model_id, fold_id),
ms AS (SELECT model_id, any_value(representation) AS representation, any_value(algorithm) AS algorithm, count(*) AS n_folds,
    avg(macro_f1) AS m, coalesce(stddev_samp(macro_f1), 0) AS s, avg(accuracy) AS acc FROM fs GROUP BY model_id)"""
SCORED = f"{t.PREDS}, {PC}"


def fold_table(spark, sf):
    """Fold scores with the model's representation and algorithm, stored: one row per model and fold, used many times."""
    scored = materialize(metrics.fold_scores(t.predictions(spark, sf)), "fold-scores")
    pattern = "^(df|bc)_(.*)$"
    return scored.withColumn("representation", F.regexp_extract("model_id", pattern, 1)).withColumn(
        "algorithm", F.regexp_extract("model_id", pattern, 2))


def summary_table(spark, sf):
    return metrics.mean_std(fold_table(spark, sf), ["model_id", "representation", "algorithm"])


@R.query("metrics_fold", f"""WITH {SCORED}
SELECT model_id, fold_id, n, round(accuracy, 6) AS accuracy, round(precision_macro, 6) AS precision_macro,
  round(recall_macro, 6) AS recall_macro, round(macro_f1, 6) AS macro_f1 FROM fs""")
def metrics_fold(spark, sf):
    return rounded(metrics.fold_scores(t.predictions(spark, sf)))


@R.query("metrics_per_class", f"""WITH {SCORED}, m AS (SELECT model_id, label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM pc GROUP BY ALL),
x AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM m)
SELECT model_id, label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, round(p, 6) AS "precision",
  round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x""")
def metrics_per_class(spark, sf):
    return rounded(metrics.per_class(metrics.confusion(t.predictions(spark, sf), ["model_id"]), ["model_id"]))


@R.query("metrics_confusion", f"""WITH {SCORED}
SELECT m.model_id, a.v AS y_true, b.v AS y_pred, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
FROM models m, (SELECT CAST(unnest([2,3,4]) AS BIGINT) AS v) a, (SELECT CAST(unnest([2,3,4]) AS BIGINT) AS v) b
LEFT JOIN conf ON conf.model_id = m.model_id AND y_true = a.v AND y_pred = b.v GROUP BY ALL""")
def metrics_confusion(spark, sf):
    return metrics.confusion_cells(metrics.confusion(t.predictions(spark, sf), ["model_id"]), ["model_id"])


@R.query("metrics_mean_std", f"""WITH {SCORED}
SELECT model_id, count(*) AS n_folds, {", ".join(f"round(avg({c}), 6) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_std" for c in metrics.SCORES)}
FROM fs GROUP BY model_id""")
def metrics_mean_std(spark, sf):
    return rounded(metrics.mean_std(metrics.fold_scores(t.predictions(spark, sf)), ["model_id"]))


@R.query("model_ranking", f"""WITH {SCORED}
SELECT model_id, representation, row_number() OVER (ORDER BY m DESC, s, model_id) AS "rank",
  row_number() OVER (PARTITION BY representation ORDER BY m DESC, s, model_id) AS side_rank FROM ms""")
def model_ranking(spark, sf):
    ranked = metrics.rank_models(summary_table(spark, sf))
    return metrics.rank_models(ranked, ["representation"], out="side_rank").select(
        "model_id", "representation", "rank", "side_rank")


# every fold read as one spot-check run: the repeat is the seed, the fold picks min_df
SPOT = f"""{SCORED}, spot AS (
  SELECT algorithm, representation, [5, 10, 20][CAST(substr(fold_id, 5) AS BIGINT) % 3 + 1] AS min_df,
    CAST(substr(fold_id, 2, 1) AS BIGINT) AS seed, macro_f1, accuracy,
    CASE WHEN algorithm = 'tree' AND fold_id = 'r1_f1' THEN 'error' ELSE 'ok' END AS status FROM fs),
ss AS (SELECT algorithm, representation, CAST(min_df AS BIGINT) AS min_df, count(*) FILTER (WHERE status = 'ok') AS n_ok,
    count(*) FILTER (WHERE status <> 'ok') AS n_error, avg(macro_f1) FILTER (WHERE status = 'ok') AS m,
    coalesce(stddev_samp(macro_f1) FILTER (WHERE status = 'ok'), 0) AS s,
    avg(accuracy) FILTER (WHERE status = 'ok') AS acc FROM spot GROUP BY ALL)"""


def spot_results(spark, sf):
    fold_no = F.substring("fold_id", 5, 5).cast("bigint")
    return fold_table(spark, sf).select(
        "algorithm", "representation",
        F.element_at(F.array(*[F.lit(x).cast("bigint") for x in (5, 10, 20)]), (fold_no % 3 + 1).cast("int")).alias("min_df"),
        F.substring("fold_id", 2, 1).cast("bigint").alias("seed"), "macro_f1", "accuracy",
        F.lit(0.0).alias("fit_seconds"),
        F.when((F.col("algorithm") == "tree") & (F.col("fold_id") == "r1_f1"), "error").otherwise("ok").alias("status"))


@R.query("spot_summary", f"""WITH {SPOT}
SELECT algorithm, representation, min_df, n_ok, n_error, round(m, 6) AS macro_f1_mean, round(s, 6) AS macro_f1_std, round(acc, 6) AS accuracy_mean FROM ss""")
def spot_summary(spark, sf):
    return rounded(metrics.spot_summary(spot_results(spark, sf)).drop("values", "fit_seconds_mean"))


@R.query("spot_rank", f"""WITH {SPOT}, b AS (SELECT algorithm, representation, avg(m) AS macro_f1_mean, sum(n_error) = 0 AS eligible FROM ss GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY representation ORDER BY eligible DESC, macro_f1_mean DESC, algorithm) AS "rank" FROM b)
SELECT algorithm, representation, eligible, "rank", eligible AND "rank" <= 2 AS selected FROM r""")
def spot_rank(spark, sf):
    """Algorithms without failures first, the best two of each representation selected."""
    per = metrics.spot_summary(spot_results(spark, sf)).groupBy("algorithm", "representation").agg(
        F.avg("macro_f1_mean").alias("macro_f1_mean"), F.sum("n_error").alias("errors"))
    return metrics.rank_per_representation(per, F.col("errors") == 0, keep=2).select(
        "algorithm", "representation", "eligible", "rank", "selected")


@R.query("selected_union", f"""WITH {SPOT}, b AS (SELECT algorithm, representation, avg(m) AS macro_f1_mean, sum(n_error) = 0 AS eligible FROM ss GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY representation ORDER BY eligible DESC, macro_f1_mean DESC, algorithm) AS rk FROM b),
u AS (SELECT DISTINCT algorithm FROM r WHERE eligible AND rk <= 2)
SELECT p.representation, algorithm, p.representation || '_' || algorithm AS model_id FROM u, (SELECT unnest(['df', 'bc']) AS representation) p""")
def selected_union(spark, sf):
    """The union of both selections, planned for both representations."""
    chosen = metrics.selected_union(spot_rank(spark, sf))
    everything = metrics.model_plan(spark, ["df", "bc"], [m.split("_")[1] for m in t.MODELS])
    return everything.join(F.broadcast(chosen), "algorithm", "left_semi").distinct().select(  # one row per algorithm
        "representation", "algorithm", "model_id")


@R.query("best_min_df", f"""WITH {SPOT} SELECT min_df, round(avg(m), 6) AS mean_score FROM ss GROUP BY min_df ORDER BY avg(m) DESC, min_df LIMIT 1""")
def best_min_df(spark, sf):
    return rounded(metrics.best_setting(metrics.spot_summary(spot_results(spark, sf))))


# every repeat read as one grid search: the fold is the configuration, models are splits
GRID = f"""{SCORED}, cv AS (SELECT representation AS model_id, substr(fold_id, 1, 2) AS fold_id, CAST(substr(fold_id, 5) AS BIGINT) AS config_index, macro_f1 FROM fs),
g AS (SELECT model_id, fold_id, config_index, avg(macro_f1) AS m, stddev_pop(macro_f1) AS s, count(*) AS n_splits FROM cv GROUP BY ALL)"""


def grid_results(spark, sf):
    return fold_table(spark, sf).select(
        F.col("representation").alias("model_id"), F.substring("fold_id", 1, 2).alias("fold_id"),
        F.substring("fold_id", 5, 5).cast("bigint").alias("config_index"), "macro_f1")


@R.query("grid_rank", f"""WITH {GRID}
SELECT model_id, fold_id, config_index, round(m, 6) AS mean_score, round(s, 6) AS std_score, n_splits,
  rank() OVER (PARTITION BY model_id, fold_id ORDER BY round(m, 12) DESC) AS "rank",
  row_number() OVER (PARTITION BY model_id, fold_id ORDER BY round(m, 12) DESC, config_index) = 1 AS is_best FROM g""")
def grid_rank(spark, sf):
    return rounded(metrics.grid_summary(grid_results(spark, sf)))


@R.query("modal_params", f"""WITH {GRID}, b AS (SELECT *, row_number() OVER (PARTITION BY model_id, fold_id ORDER BY round(m, 12) DESC, config_index) AS rn FROM g),
p AS (SELECT model_id, '{{"depth":"' || config_index % 3 || '","rate":"0.' || config_index % 2 || '"}}' AS params, CAST(substr(fold_id, 2) AS BIGINT) AS o FROM b WHERE rn = 1),
c AS (SELECT model_id, params, count(*) AS n, min(o) AS first_seen FROM p GROUP BY ALL)
SELECT model_id, params, n FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY n DESC, first_seen) AS rn FROM c) WHERE rn = 1""")
def modal_params(spark, sf):
    """The configuration picked most often over the searches of a model."""
    best = metrics.grid_summary(grid_results(spark, sf)).filter("is_best")
    params = F.create_map(F.lit("rate"), F.concat(F.lit("0."), F.col("config_index") % 2),
                          F.lit("depth"), (F.col("config_index") % 3).cast("string"))
    named = best.select("model_id", metrics.canonical_params(params).alias("params"),
                        F.substring("fold_id", 2, 5).cast("bigint").alias("fold_ordinal"))
    return metrics.modal_params(named)


@R.query("completeness", f"""WITH {SCORED}, part AS (SELECT * FROM fs WHERE NOT (model_id = 'bc_tree' AND fold_id LIKE 'r3%') AND model_id <> 'bc_bayes'),
e AS (SELECT model_id FROM models UNION ALL SELECT 'df_knn')
SELECT e.model_id, count(part.fold_id) AS n_present, CASE WHEN count(part.fold_id) >= 15 THEN 'COMPLETE' WHEN count(part.fold_id) > 0 THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS status
FROM e LEFT JOIN part USING (model_id) GROUP BY e.model_id""")
def completeness(spark, sf):
    """Folds per expected model, with one model short of a repeat, one missing and one never run."""
    have = fold_table(spark, sf).filter(
        ~((F.col("model_id") == "bc_tree") & F.col("fold_id").startswith("r3")) & (F.col("model_id") != "bc_bayes"))
    expected = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in [*t.MODELS, "df_knn"]])).alias("model_id"))
    return metrics.completeness(have, expected)


@R.query("fold_consistency", f"""WITH {SCORED}, s AS (SELECT model_id, list_sort(list(DISTINCT fold_id)) AS f FROM fs
  WHERE NOT (model_id = 'bc_tree' AND fold_id = 'r3_f5') GROUP BY model_id), ref AS (SELECT f FROM s ORDER BY model_id LIMIT 1)
SELECT model_id, CAST(len(s.f) AS BIGINT) AS n_folds, s.f = ref.f AS consistent FROM s, ref""")
def fold_consistency(spark, sf):
    have = fold_table(spark, sf).filter(~((F.col("model_id") == "bc_tree") & (F.col("fold_id") == "r3_f5")))
    return metrics.fold_consistency(have)


@R.query("complete_cases", f"""WITH {SCORED}, part AS (SELECT * FROM fs WHERE NOT (model_id = 'bc_tree' AND fold_id LIKE 'r3%'))
SELECT model_id, fold_id, round(macro_f1, 6) AS score FROM part WHERE fold_id IN (
  SELECT fold_id FROM part GROUP BY fold_id HAVING count(*) = (SELECT count(DISTINCT model_id) FROM part))""")
def complete_cases(spark, sf):
    have = fold_table(spark, sf).filter(~((F.col("model_id") == "bc_tree") & F.col("fold_id").startswith("r3")))
    return rounded(metrics.complete_cases(have))


@R.query("merge_results", f"""WITH {SCORED}
SELECT model_id, fold_id, round(CASE WHEN fold_id LIKE 'r1%' THEN macro_f1 ELSE accuracy END, 6) AS score FROM fs
WHERE fold_id LIKE 'r1%' OR fold_id LIKE 'r2%'""")
def merge_results(spark, sf):
    """Saved results of repeats 1 and 2, repeat 1 replaced by the current run."""
    scored = fold_table(spark, sf)
    current = scored.filter(F.col("fold_id").startswith("r1")).select("model_id", "fold_id", F.col("macro_f1").alias("score"))
    saved = scored.filter(F.substring("fold_id", 1, 2).isin("r1", "r2")).select("model_id", "fold_id", F.col("accuracy").alias("score"))
    return rounded(metrics.merge_results(current, saved, ["model_id", "fold_id"]))


# ---------------------------------------------------------------- ensembles

TOP = ("df_forest", "df_logit", "df_tree")
VOTED = """st AS (SELECT model_id, m AS strength FROM ms),
pl AS (SELECT fold_id, entity_id, y_true, y2, y_pred, count(*) AS votes, round({pick}(strength), 12) AS support
  FROM preds JOIN st USING (model_id) WHERE model_id IN {members} GROUP BY ALL),
voted AS (SELECT fold_id, entity_id, y_true, y2, y_pred, votes FROM (SELECT *, sum(votes) OVER w AS nv,
    row_number() OVER (PARTITION BY fold_id, entity_id ORDER BY votes DESC, support DESC, y_pred) AS rn
  FROM pl WINDOW w AS (PARTITION BY fold_id, entity_id)) WHERE rn = 1 AND nv = {n})"""


def _strength(spark, sf):
    return summary_table(spark, sf).select("model_id", F.col("macro_f1_mean").alias("strength"))


def _voted_sql(pick, members):
    return VOTED.format(pick=pick, members=members, n=len(members))


@R.query("vote_mean_f1", f"WITH {SCORED}, {_voted_sql('avg', TOP)} SELECT fold_id, entity_id, y_pred, votes FROM voted")
def vote_mean_f1(spark, sf):
    voted = ensemble.vote(t.predictions(spark, sf), _strength(spark, sf), TOP, "mean")
    return voted.select("fold_id", "entity_id", "y_pred", "votes")


FOUR = ("bc_logit", "bc_tree", "df_bayes", "df_forest")


@R.query("vote_max_f1", f"WITH {SCORED}, {_voted_sql('max', FOUR)} SELECT fold_id, entity_id, y_pred, votes FROM voted")
def vote_max_f1(spark, sf):
    voted = ensemble.vote(t.predictions(spark, sf), _strength(spark, sf), FOUR, "max")
    return voted.select("fold_id", "entity_id", "y_pred", "votes")


def _voted_all(spark, sf):
    """Three ensembles stacked with their id."""
    preds, strength = t.predictions(spark, sf), _strength(spark, sf)
    parts = [ensemble.vote(preds, strength, members, "mean").withColumn("voting_id", F.lit(name))
             for name, members in ENSEMBLES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ENSEMBLES = {"top3": TOP, "mixed4": FOUR, "bc3": ("bc_bayes", "bc_logit", "bc_tree")}
_ENS_ROWS = ", ".join(f"('{v}', '{m}')" for v, ms in ENSEMBLES.items() for m in ms)
_ENS_SQL = f"""{SCORED}, ens AS (SELECT * FROM (VALUES {_ENS_ROWS}) AS x(voting_id, model_id)),
en AS (SELECT voting_id, count(*) AS k FROM ens GROUP BY ALL),
epl AS (SELECT voting_id, fold_id, entity_id, y_true, y2, y_pred, count(*) AS votes, round(avg(m), 12) AS support
  FROM preds JOIN ens USING (model_id) JOIN ms USING (model_id) GROUP BY ALL),
ev AS (SELECT * FROM (SELECT *, sum(votes) OVER (PARTITION BY voting_id, fold_id, entity_id) AS nv, row_number() OVER (
    PARTITION BY voting_id, fold_id, entity_id ORDER BY votes DESC, support DESC, y_pred) AS rn FROM epl) JOIN en USING (voting_id) WHERE rn = 1 AND nv = k),
ec AS (SELECT voting_id, fold_id, label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp,
  count(*) FILTER (WHERE y_true = label) AS support, count(*) FILTER (WHERE y_pred = label) AS predicted
  FROM ev, (SELECT CAST(unnest([2,3,4]) AS BIGINT) AS label) GROUP BY ALL),
ef AS (SELECT voting_id, fold_id, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END) AS macro_f1 FROM ec GROUP BY ALL),
es AS (SELECT voting_id, count(*) AS n_folds, avg(macro_f1) AS m, stddev_samp(macro_f1) AS s, avg(accuracy) AS a FROM ef GROUP BY ALL),
er AS (SELECT voting_id, array_to_string(list_sort(list_distinct(list(upper(substr(model_id, 1, 2))))), '+') AS representation FROM ens GROUP BY ALL)"""


@R.query("vote_metrics", f"""WITH {_ENS_SQL}
SELECT voting_id, representation, n_folds, round(m, 6) AS macro_f1_mean, round(s, 6) AS macro_f1_std, round(a, 6) AS accuracy_mean FROM es JOIN er USING (voting_id)""")
def vote_metrics(spark, sf):
    _, summary = ensemble.ensemble_scores(_voted_all(spark, sf))
    return rounded(summary.join(_representations(spark), "voting_id").select(
        "voting_id", "representation", "n_folds", "macro_f1_mean", "macro_f1_std", "accuracy_mean"))


def _representations(spark):
    pairs = F.array(*[F.struct(F.lit(v).alias("voting_id"), F.lit(m[:2]).alias("representation"))
                      for v, ms in ENSEMBLES.items() for m in ms])
    return ensemble.representation_of(spark.range(1).select(F.inline(pairs)))


@R.query("vote_members", f"""WITH {t.PREDS}
SELECT fold_id, entity_id, string_agg(model_id || '=' || y_pred, ',' ORDER BY model_id) AS members
FROM preds WHERE model_id IN {TOP} GROUP BY ALL""")
def vote_members(spark, sf):
    """Per row the member predictions as text."""
    maps = ensemble.member_predictions(t.predictions(spark, sf), TOP)
    pairs = F.transform(F.array_sort(F.map_entries("per_member")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("fold_id", "entity_id", F.array_join(pairs, ",").alias("members"))


@R.query("shared_keys", f"""WITH {t.PREDS}, part AS (SELECT * FROM preds WHERE NOT (model_id = 'df_tree' AND fold_id LIKE 'r2%'))
SELECT fold_id, entity_id FROM part WHERE model_id = 'df_forest' INTERSECT SELECT fold_id, entity_id FROM part WHERE model_id = 'df_logit'
INTERSECT SELECT fold_id, entity_id FROM part WHERE model_id = 'df_tree'""")
def shared_keys(spark, sf):
    """Rows that all members predicted, one member lacking a repeat."""
    part = t.predictions(spark, sf).filter(~((F.col("model_id") == "df_tree") & F.col("fold_id").startswith("r2")))
    return ensemble.shared_keys(part, TOP)


MAJ = f"""{t.PREDS}, mc AS (SELECT model_id, entity_id, y_true, y2, y_pred, count(*) AS c FROM preds GROUP BY ALL),
maj AS (SELECT model_id, entity_id, y_true, y2, arg_max(y_pred, c * 10 - y_pred) AS majority, max(c) / sum(c) AS confidence,
  coalesce(sum(c) FILTER (WHERE y_pred = 2), 0) || '/' || coalesce(sum(c) FILTER (WHERE y_pred = 3), 0) || '/' || coalesce(sum(c) FILTER (WHERE y_pred = 4), 0) AS counts
  FROM mc GROUP BY ALL)"""


@R.query("majority_repeat", f"WITH {MAJ} SELECT model_id, entity_id, majority, round(confidence, 6) AS confidence, counts FROM maj")
def majority_repeat(spark, sf):
    voted = ensemble.majority(t.predictions(spark, sf))
    return rounded(voted.select("model_id", "entity_id", "majority", "confidence",
                                F.array_join(F.transform("counts", lambda c: c.cast("string")), "/").alias("counts")))


@R.query("majority_metrics", f"""WITH {MAJ}, lab AS (SELECT CAST(unnest([2,3,4]) AS BIGINT) AS label),
c AS (SELECT model_id, label, count(*) FILTER (WHERE y_true = label AND majority = label) AS tp, count(*) FILTER (WHERE y_true = label) + count(*) FILTER (WHERE majority = label) AS sp,
  count(*) FILTER (WHERE y2 = label AND majority = label) AS tp2, count(*) FILTER (WHERE y2 = label) + count(*) FILTER (WHERE majority = label) AS sp2 FROM maj, lab GROUP BY ALL),
f AS (SELECT model_id, avg(CASE WHEN sp > 0 THEN 2 * tp / sp ELSE 0 END) AS f1, avg(CASE WHEN sp2 > 0 THEN 2 * tp2 / sp2 ELSE 0 END) AS f2 FROM c GROUP BY ALL)
SELECT model_id, count(*) AS n, round(avg(CAST(majority = y_true AS INT)), 6) AS accuracy_y1, round(any_value(f1), 6) AS macro_f1_y1,
  round(avg(CAST(majority = y2 AS INT)), 6) AS exact_y2, round(any_value(f2), 6) AS macro_f1_y2 FROM maj JOIN f USING (model_id) GROUP BY model_id""")
def majority_metrics(spark, sf):
    """One label per entity and model against both labels."""
    voted = ensemble.majority(t.predictions(spark, sf)).withColumnRenamed("majority", "y_pred")
    a = agreement.agreement_scores(voted, ["model_id"], "y_true").select(
        "model_id", "n", F.col("exact").alias("accuracy_y1"), F.col("macro_f1").alias("macro_f1_y1"))
    b = agreement.agreement_scores(voted, ["model_id"], "y2").select(
        "model_id", F.col("exact").alias("exact_y2"), F.col("macro_f1").alias("macro_f1_y2"))
    return rounded(a.join(b, "model_id"))


# ---------------------------------------------------------------- agreement

_AG = """count(*) AS n, round(avg(CAST(y_pred = y2 AS INT)), 6) AS exact, round(avg(CAST(abs(y_pred - y2) <= 1 AS INT)), 6) AS within_1,
  round(avg(abs(y_pred - y2)), 6) AS mean_abs_delta"""


def _macro(by: str, ref: str, src: str = "preds") -> str:
    return f"""mf AS (SELECT {by}, avg(CASE WHEN sp > 0 THEN 2 * tp / sp ELSE 0 END) AS macro_f1 FROM (
  SELECT {by}, label, count(*) FILTER (WHERE {ref} = label AND y_pred = label) AS tp,
    count(*) FILTER (WHERE {ref} = label) + count(*) FILTER (WHERE y_pred = label) AS sp
  FROM {src}, (SELECT CAST(unnest([2,3,4]) AS BIGINT) AS label) GROUP BY ALL) GROUP BY ALL)"""


@R.query("agree_metrics", f"""WITH {t.PREDS}, {_macro("model_id", "y2")}
SELECT model_id, {_AG}, round(any_value(macro_f1), 6) AS macro_f1 FROM preds JOIN mf USING (model_id) GROUP BY model_id""")
def agree_metrics(spark, sf):
    return rounded(agreement.agreement_scores(t.predictions(spark, sf), ["model_id"]))


@R.query("agree_subsets", f"""WITH {t.PREDS}, sp AS (SELECT *, CASE WHEN y_true = y2 THEN 'concordant' ELSE 'discordant' END AS subset FROM preds),
{_macro("model_id, subset", "y2", "sp")}
SELECT model_id, subset, {_AG}, round(any_value(macro_f1), 6) AS macro_f1 FROM sp JOIN mf USING (model_id, subset) GROUP BY model_id, subset""")
def agree_subsets(spark, sf):
    return rounded(agreement.agreement_by_subset(t.predictions(spark, sf), ["model_id"]))


@R.query("agree_triadic", f"""WITH {t.PREDS}, fl AS (SELECT *, CASE WHEN y_pred = y_true AND y_pred = y2 THEN 'both' WHEN y_pred = y_true THEN 'y1'
    WHEN y_pred = y2 THEN 'y2' ELSE 'other' END AS follows FROM preds),
sc AS (SELECT model_id, follows, 'cell' AS scope, y_true AS y1, y2 FROM fl
  UNION ALL SELECT model_id, follows, CASE WHEN y_true = y2 THEN 'equal' ELSE 'different' END, NULL, NULL FROM fl
  UNION ALL SELECT model_id, follows, 'all', NULL, NULL FROM fl)
SELECT model_id, scope, y1, y2, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE follows = '{f}') AS n_{f}, round(100.0 * count(*) FILTER (WHERE follows = '{f}') / count(*), 6) AS pct_{f}" for f in ("both", "y1", "y2", "other"))}
FROM sc GROUP BY model_id, scope, y1, y2""")
def agree_triadic(spark, sf):
    return rounded(agreement.triadic(t.predictions(spark, sf), ["model_id"]))


@R.query("agree_baseline", f"""WITH {t.PREDS}, b AS (SELECT fold_id, y_true AS y_pred, y2 FROM preds WHERE model_id = 'df_forest'),
{_macro("fold_id", "y2", "b")}
SELECT fold_id, {_AG}, round(any_value(macro_f1), 6) AS macro_f1 FROM b JOIN mf USING (fold_id) GROUP BY fold_id""")
def agree_baseline(spark, sf):
    """The target label read as a prediction of the reference label, on the rows of one model."""
    rows = t.predictions(spark, sf).filter(F.col("model_id") == "df_forest")
    return rounded(agreement.agreement_scores(rows, ["fold_id"], "y2", "y_true"))


@R.query("agree_extremes", f"""WITH {t.PREDS}, a AS (SELECT model_id, avg(CAST(y_pred = y2 AS INT)) AS e FROM preds GROUP BY ALL)
SELECT arg_max(model_id, e) AS best_model, round(max(e), 6) AS best, arg_min(model_id, e) AS worst_model, round(min(e), 6) AS worst FROM a""")
def agree_extremes(spark, sf):
    return rounded(agreement.extremes(agreement.agreement_scores(t.predictions(spark, sf), ["model_id"])))


@R.query("comparable_rows", f"""WITH {t.ENT} SELECT entity_id, y1, y2 FROM ent WHERE y1 IN (2, 3, 4) AND y2 IN (2, 3, 4)""")
def comparable_rows(spark, sf):
    """All orders whose two labels are both known classes."""
    return agreement.comparable(t.entities(spark, sf), y_pred="y1").select("entity_id", "y1", "y2")


@R.query("hits_by_source", f"""WITH {t.PREDS}, h AS (SELECT entity_id, repeat_seed, count(*) FILTER (WHERE y_pred = y_true) AS y1_hits,
  count(*) FILTER (WHERE y_pred = y2) AS y2_hits, count(*) FILTER (WHERE y_pred <> y_true AND y_pred <> y2) AS other_hits FROM preds GROUP BY ALL)
SELECT *, CASE WHEN y1_hits > y2_hits THEN 'y1' WHEN y1_hits < y2_hits THEN 'y2' ELSE 'none' END AS leaning FROM h""")
def hits_by_source(spark, sf):
    return ensemble.hits_by_source(t.predictions(spark, sf), ["entity_id", "repeat_seed"])


@R.query("dataset_manifest", f"""WITH {t.BASE} SELECT count(*) AS n, round(avg(CAST(y1 = y2 AS INT)), 6) AS exact, round(avg(abs(y2 - y1)), 6) AS mean_abs_delta FROM base""")
def dataset_manifest(spark, sf):
    return rounded(agreement.manifest(t.modelling_base(spark, sf)))


# ---------------------------------------------------------------- comparisons


@R.query("compare_representations", f"""WITH {SCORED}
SELECT algorithm, round(max(m) FILTER (WHERE representation = 'df'), 6) AS df, round(max(m) FILTER (WHERE representation = 'bc'), 6) AS bc,
  round(max(m) FILTER (WHERE representation = 'df') - max(m) FILTER (WHERE representation = 'bc'), 6) AS difference FROM ms GROUP BY algorithm""")
def compare_representations(spark, sf):
    return rounded(metrics.by_representation(summary_table(spark, sf)))


@R.query("gain_vs_single", f"""WITH {_ENS_SQL}, bs AS (SELECT upper(representation) AS representation, arg_max(model_id, m) AS bm, max(m) AS bv FROM ms GROUP BY 1),
ov AS (SELECT arg_max(model_id, m) AS om, max(m) AS ovv FROM ms)
SELECT voting_id, er.representation, coalesce(bm, om) AS reference_model, round(m, 6) AS macro_f1_mean,
  round(coalesce(bv, ovv), 6) AS reference_score, round(m - coalesce(bv, ovv), 6) AS gain
FROM es JOIN er USING (voting_id) LEFT JOIN bs USING (representation), ov""")
def gain_vs_single(spark, sf):
    """Ensembles against the best single model of the same kind of members."""
    _, summary = ensemble.ensemble_scores(_voted_all(spark, sf))
    singles = summary_table(spark, sf).withColumn("representation", F.upper("representation"))
    return rounded(metrics.gain_over_single(summary.join(_representations(spark), "voting_id"), singles))


@R.query("group_gap", f"""WITH {SCORED}, g AS (SELECT group_id, count(*) AS n FROM base GROUP BY ALL),
p AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5(concat_ws(':', '0', group_id)), group_id) - 1 AS pos FROM g),
gf AS (SELECT group_id, CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END + 1 AS fold FROM p),
gp AS (SELECT model_id, repeat_seed * 10 + gf.fold AS fold, y_true, y_pred FROM preds JOIN gf USING (group_id)),
gc AS (SELECT model_id, fold, label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_true = label) + count(*) FILTER (WHERE y_pred = label) AS sp
  FROM gp, (SELECT CAST(unnest([2,3,4]) AS BIGINT) AS label) GROUP BY ALL),
gm AS (SELECT model_id, avg(f1) AS m FROM (SELECT model_id, fold, avg(CASE WHEN sp > 0 THEN 2 * tp / sp ELSE 0 END) AS f1 FROM gc GROUP BY ALL) GROUP BY ALL)
SELECT model_id, round(ms.m, 6) AS stratified, round(gm.m, 6) AS grouped, round(ms.m - gm.m, 6) AS gap FROM ms JOIN gm USING (model_id)""")
def group_gap(spark, sf):
    """Stratified against group-wise fold means of the same predictions."""
    preds = t.predictions(spark, sf)
    group = folds.group_folds(t.modelling_base(spark, sf), "group_id", 5).select("group_id", F.col("fold").cast("string").alias("fold_id"))
    regrouped = join_to_rows(preds.drop("fold_id"), group, ["group_id"], F.col("entity_id")).withColumn(
        "fold_id", F.concat_ws("_", "repeat_seed", "fold_id"))
    return rounded(metrics.generalisation_gap(
        metrics.mean_std(metrics.fold_scores(preds), ["model_id"]),
        metrics.mean_std(metrics.fold_scores(regrouped), ["model_id"])))


# ---------------------------------------------------------------- rank tests

RANKS = f"""{SCORED}, rk AS (SELECT model_id, fold_id, rank() OVER (PARTITION BY fold_id ORDER BY macro_f1 DESC)
  + (count(*) OVER (PARTITION BY fold_id, macro_f1) - 1) / 2 AS r, count(*) OVER (PARTITION BY fold_id, macro_f1) AS tied FROM fs)"""
_K, _N = len(t.MODELS), t.REPEATS * t.FOLDS


@R.query("rank_average", f"WITH {RANKS} SELECT model_id, round(avg(r), 6) AS average_rank, count(*) AS n_folds FROM rk GROUP BY model_id")
def rank_average(spark, sf):
    return rounded(ranktests.average_ranks(ranktests.fold_ranks(fold_table(spark, sf))))


@R.query("friedman", f"""WITH {RANKS}, s AS (SELECT model_id, sum(r) AS s, sum(tied * tied - 1) AS t FROM rk GROUP BY ALL),
x AS (SELECT (12.0 / ({_N} * {_K} * ({_K} + 1)) * sum(s * s) - 3.0 * {_N} * ({_K} + 1)) / (1 - sum(t) / ({_N} * {_K} * ({_K} * {_K} - 1))) AS q FROM s)
SELECT 'ok' AS status, CAST({_K} AS BIGINT) AS n_models, CAST({_N} AS BIGINT) AS n_folds, round(q, 6) AS statistic,
  round(exp(-q / 2) * (1 + q / 2 + q * q / 8), 6) AS p_value FROM x""")
def friedman(spark, sf):
    return rounded(ranktests.friedman(ranktests.fold_ranks(fold_table(spark, sf))))


@R.query("nemenyi", f"""WITH {RANKS}, a AS (SELECT model_id, avg(r) AS ar FROM rk GROUP BY ALL), c AS (SELECT 2.949 * sqrt({_K} * ({_K} + 1) / (6.0 * {_N})) AS cd)
SELECT x.model_id AS model_a, y.model_id AS model_b, round(abs(x.ar - y.ar), 6) AS rank_diff, round(cd, 6) AS critical_difference,
  abs(x.ar - y.ar) > cd AS significant FROM a x JOIN a y ON x.model_id < y.model_id, c""")
def nemenyi(spark, sf):
    return rounded(ranktests.nemenyi(ranktests.fold_ranks(fold_table(spark, sf))))


@R.query("wilcoxon", f"""WITH {SCORED}, d AS (SELECT x.model_id AS model_a, y.model_id AS model_b, x.macro_f1 - y.macro_f1 AS d
  FROM fs x JOIN fs y ON x.fold_id = y.fold_id AND x.model_id < y.model_id WHERE x.macro_f1 <> y.macro_f1),
r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2 AS r,
  row_number() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) AS i FROM d),
w AS (SELECT model_a, model_b, count(*) AS n, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)) AS w0,
  coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS wm FROM r GROUP BY ALL),
u AS (SELECT r.model_a, r.model_b, s.s, sum(CASE WHEN (s.s >> (r.i - 1)) & 1 = 1 THEN r.r ELSE 0 END) AS t
  FROM r, (SELECT unnest(range(CAST(pow(2, {_N}) AS BIGINT))) AS s) s GROUP BY ALL)
SELECT w.model_a, w.model_b, n, round(least(wp, wm), 6) AS statistic, round(least(1, 2 * count(*) FILTER (WHERE t <= least(wp, wm)) / pow(2, n)), 6) AS p_value
FROM w JOIN u USING (model_a, model_b) GROUP BY w.model_a, w.model_b, n, wp, wm""")
def wilcoxon(spark, sf):
    return rounded(ranktests.wilcoxon(fold_table(spark, sf)))


# ---------------------------------------------------------------- interpretation

LIFT = f"""{t.PREDS}, {t.LINES}, bag AS (SELECT DISTINCT entity_id, item_id FROM lines),
oof AS (SELECT entity_id, y_pred, y2 FROM preds WHERE model_id = 'df_forest' AND entity_id IN (SELECT entity_id FROM bag))"""


def _oof(spark, sf):
    return t.predictions(spark, sf).filter(F.col("model_id") == "df_forest")


def _names(spark, sf):
    return t.items(spark, sf).select("item_id", F.col("name").alias("item_name"))


@R.query("lift_by_class", f"""WITH {LIFT}, tot AS (SELECT y_pred AS label, count(*) AS tot FROM oof GROUP BY ALL),
h AS (SELECT item_id, y_pred AS label, count(*) AS hits FROM oof JOIN bag USING (entity_id) GROUP BY ALL),
o AS (SELECT item_id, count(*) AS hits, count(DISTINCT entity_id) AS n_entities FROM oof JOIN bag USING (entity_id) GROUP BY ALL),
l AS (SELECT h.label, item_id, n_entities, h.hits, h.hits / tot.tot AS fc, o.hits / (SELECT sum(tot) FROM tot) AS fo FROM h JOIN tot USING (label) JOIN o USING (item_id) WHERE n_entities >= 10),
r AS (SELECT *, round(fc / fo, 12) AS lift, row_number() OVER (PARTITION BY label ORDER BY round(fc / fo, 12) DESC, item_id) AS "rank" FROM l)
SELECT label, item_id, p_name AS item_name, n_entities, hits, round(fc, 6) AS freq_in_class, round(fo, 6) AS freq_overall, round(lift, 6) AS lift, "rank"
FROM r JOIN part ON item_id = p_partkey WHERE "rank" <= 20""")
def lift_by_class(spark, sf):
    bag = features.bag_long(t.lines(spark, sf))
    return rounded(interpret.class_lift(_oof(spark, sf), bag, _names(spark, sf)))


_DIR = {"divergent_vs_concordant": ("div", "con"), "concordant_vs_divergent": ("con", "div"), "over_vs_under": ("ov", "un"), "under_vs_over": ("un", "ov")}
_COND = {"con": "y_pred = y2", "div": "y_pred <> y2", "ov": "y_pred > y2", "un": "y_pred < y2"}


@R.query("lift_divergence", f"""WITH {LIFT}, tot AS (SELECT {", ".join(f"count(*) FILTER (WHERE {c}) AS t_{g}" for g, c in _COND.items())} FROM oof),
i AS (SELECT item_id, count(DISTINCT entity_id) AS n_entities, {", ".join(f"count(*) FILTER (WHERE {c}) AS {g}" for g, c in _COND.items())} FROM oof JOIN bag USING (entity_id) GROUP BY ALL HAVING count(DISTINCT entity_id) >= 10),
l AS ({" UNION ALL ".join(f"SELECT '{n}' AS direction, item_id, n_entities, {a} / t_{a} AS b, {b} / t_{b} AS o FROM i, tot" for n, (a, b) in _DIR.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY round((b + 0.0005) / (o + 0.0005), 12) DESC, item_id) AS "rank" FROM l WHERE b >= 0.0005)
SELECT direction, item_id, p_name AS item_name, n_entities, round(b, 6) AS freq_base, round(o, 6) AS freq_other, round((b + 0.0005) / (o + 0.0005), 6) AS lift, "rank"
FROM r JOIN part ON item_id = p_partkey WHERE "rank" <= 20""")
def lift_divergence(spark, sf):
    bag = features.bag_long(t.lines(spark, sf))
    return rounded(interpret.divergence_lift(_oof(spark, sf), bag, _names(spark, sf)))


IMP = ["land_count", "creature_count", "game_changer_count", "unique_card_count"]
IMP_GROUPS = ["structure", "mana", "types", "flags"]
IMP_SQL = f"""{feats_cte(["structure", "mana", "types", "flags"])}, base AS (SELECT * FROM fbase),
{t.FOLDED_PREDS}, oof AS (SELECT entity_id, y_pred, y2 FROM preds WHERE model_id = 'df_forest')"""


@R.query("means_by_prediction", f"""{IMP_SQL}, jj AS (SELECT y_pred, {", ".join(IMP)} FROM oof JOIN feats USING (entity_id))
SELECT label, n, col AS "column", round(v, 6) AS "mean" FROM (
{" UNION ALL ".join(f"SELECT y_pred AS label, count(*) AS n, '{c}' AS col, CASE WHEN count(*) >= 5 THEN avg({c}) END AS v FROM jj GROUP BY y_pred UNION ALL SELECT NULL, count(*), '{c}', avg({c}) FROM jj" for c in IMP)})""")
def means_by_prediction(spark, sf):
    return rounded(interpret.means_by_prediction(_oof(spark, sf), base_features(spark, sf, IMP_GROUPS), IMP))


@R.query("means_divergent", f"""{IMP_SQL}, jj AS (SELECT oof.y_pred <> oof.y2 AS dv, {", ".join(IMP)} FROM oof JOIN feats USING (entity_id)),
u AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, avg({c}) FILTER (WHERE dv) AS d, avg({c}) FILTER (WHERE NOT dv) AS c, stddev_pop({c}) AS s FROM jj" for c in IMP)})
SELECT col AS "column", round(d, 6) AS mean_divergent, round(c, 6) AS mean_concordant, round(s, 6) AS std, round(d - c, 6) AS difference, round((d - c) / s, 6) AS effect FROM u""")
def means_divergent(spark, sf):
    return rounded(interpret.divergent_differences(_oof(spark, sf), base_features(spark, sf, IMP_GROUPS), IMP))


# ---------------------------------------------------------------- selection


@R.query("scenario_pick", f"""{feats_cte(["flags"])}, k AS (SELECT entity_id, views, delta, game_changer_count,
  row_number() OVER (PARTITION BY delta = 0 ORDER BY views DESC, entity_id) AS a, row_number() OVER (PARTITION BY delta > 0 ORDER BY views DESC, entity_id) AS b,
  row_number() OVER (PARTITION BY delta < 0 ORDER BY views DESC, entity_id) AS c, row_number() OVER (PARTITION BY abs(delta) = 2 ORDER BY views DESC, entity_id) AS d,
  row_number() OVER (PARTITION BY game_changer_count >= 5 ORDER BY views DESC, entity_id) AS e FROM fbase),
p AS (SELECT *, CASE WHEN delta = 0 AND a = 1 THEN 0 WHEN delta > 0 AND b = 1 THEN 1 WHEN delta < 0 AND c = 1 THEN 2
  WHEN abs(delta) = 2 AND d = 1 THEN 3 WHEN game_changer_count >= 5 AND e = 1 THEN 4 ELSE 5 END AS pr FROM k)
SELECT entity_id, views, delta, ['agree', 'above', 'below', 'large', 'flagged', 'fill'][pr + 1] AS kind FROM p ORDER BY pr, views DESC, entity_id LIMIT 12""")
def scenario_pick(spark, sf):
    picked = selection.scenario_pick(base_features(spark, sf, ["flags"]))
    return picked.select("entity_id", "views", "delta", "kind")


@R.query("scenario_above", f"""WITH {t.BASE} SELECT entity_id, views, y2 - y1 AS delta FROM base WHERE y2 > y1 ORDER BY views DESC, entity_id LIMIT 12""")
def scenario_above(spark, sf):
    base = t.modelling_base(spark, sf).withColumn("delta", F.col("y2") - F.col("y1"))
    return selection.by_delta(base, F.col("delta") > 0).select("entity_id", "views", "delta")


@R.query("search_entities", """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_custkey, c_mktsegment)), 'mach')""")
def search_entities(spark, sf):
    people = t.table(spark, sf, "customer")
    return selection.search(people, ["c_name", "c_custkey", "c_mktsegment"], " MACH ").select("c_custkey", "c_name", "c_mktsegment")


@R.query("first_n_lines", f"""WITH {t.LINES}, {t.ITEMS}, q AS (SELECT entity_id, line_id, item_id, quantity, name,
  row_number() OVER (PARTITION BY entity_id ORDER BY line_id, item_id, quantity) AS line_rank
  FROM lines JOIN items USING (item_id) WHERE NOT is_lead AND NOT is_basic_land)
SELECT * FROM q WHERE line_rank <= 3""")
def first_n_lines(spark, sf):
    """First three lines per basket that are neither lead nor basic."""
    items = t.items(spark, sf)
    plain = items.filter(~features.is_basic(F.col("name"), F.col("super_types"), F.col("types"))).select("item_id", "name")
    lines = t.lines(spark, sf).filter(~F.col("is_lead")).join(plain, "item_id")
    return selection.first_lines(lines, ["line_id", "item_id", "quantity"], 3).select(
        "entity_id", "line_id", "item_id", "quantity", "name", "line_rank")


@R.query("entity_order", f"WITH {t.BASE} SELECT entity_id, views FROM base ORDER BY views DESC, entity_id")
def entity_order(spark, sf):
    """The display order, most viewed first, of every entity."""
    return selection.capped(t.modelling_base(spark, sf).select("entity_id", "views"), [F.col("views").desc(), F.col("entity_id")], None)


@R.query("entity_queue", f"WITH {t.BASE} SELECT entity_id, views FROM base ORDER BY views DESC, entity_id LIMIT 500")
def entity_queue(spark, sf):
    """The rows that one capped run takes from the head of the order."""
    return selection.capped(t.modelling_base(spark, sf).select("entity_id", "views"), [F.col("views").desc(), F.col("entity_id")], 500)


@R.query("ordered_semi_join", f"""WITH {t.BASE}, ids AS (SELECT entity_id, row_number() OVER (ORDER BY md5(concat_ws(':', '5', entity_id)), entity_id) AS ordinal FROM base)
SELECT ordinal, entity_id, status FROM ids JOIN ent USING (entity_id)""")
def ordered_semi_join(spark, sf):
    """Rows of a list of ids, each with its position in the list."""
    base = t.modelling_base(spark, sf).select("entity_id").withColumn("digest", md5_order(5, "entity_id"))
    ids = spread_rank(base, [], "digest", ["entity_id"], "ordinal").drop("digest")
    return t.entities(spark, sf).join(ids, "entity_id").select("ordinal", "entity_id", "status")
