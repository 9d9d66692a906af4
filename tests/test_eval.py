import pytest
from pyspark.sql import functions as F

from basketwise.operators import agreement, divergence, ensemble, metrics, profile, quality, ranktests
from conftest import rows

# Macro-F1 per fold (three repeats of five) of twelve published models, in fold order.
FOLD_F1 = {
    "bc_decision_tree": [0.550352333804916, 0.5480640067814867, 0.5385344894956681, 0.5628165558076313, 0.5483453741753571, 0.5526696281474504, 0.5657389614982773, 0.5327241228256177, 0.5445924724259815, 0.5471813295245632, 0.5602915387596025, 0.5396951366535069, 0.5369072266659248, 0.5596833883394701, 0.525301517920916],
    "bc_gradient_boosting": [0.631257305569782, 0.6388599745362293, 0.6389581755469972, 0.6441701405161181, 0.6610998565839855, 0.6210903028422672, 0.6563953137428729, 0.6486713316558628, 0.6355318418759429, 0.6337871436902905, 0.6464879927916242, 0.6540738515486596, 0.6587529888539446, 0.6526669093095264, 0.6271483519521251],
    "bc_linear_svc": [0.6280421735996959, 0.6116621257771656, 0.6158632261942816, 0.614912741596029, 0.62754542856046, 0.5924206198165671, 0.6214513993100922, 0.6095423480729111, 0.5961100083092851, 0.6223265708812755, 0.6103738375486844, 0.6120018159865853, 0.6327734213500179, 0.6240329207775871, 0.6009915780565092],
    "bc_logistic_regression": [0.6306870577726228, 0.6146523989629712, 0.6212784887831617, 0.6205192920113167, 0.6271519442537853, 0.6117176706078725, 0.6322698541834112, 0.6231603776537545, 0.6243447494559478, 0.6145464639129213, 0.6220542404813759, 0.6325069901125088, 0.6389424618758516, 0.6357149270372674, 0.6041379099892195],
    "bc_naive_bayes": [0.5634615256029963, 0.5422842875923363, 0.5480386932290403, 0.5480989056114023, 0.572049081019366, 0.5534286257992839, 0.5605355603629343, 0.5551317520101388, 0.552068359140025, 0.5538388412555375, 0.5341759478276484, 0.5609539167995797, 0.5506928751705288, 0.5564549552814062, 0.5515650436179631],
    "bc_random_forest": [0.6262134084413101, 0.6355144371712829, 0.6224233476904125, 0.634999350301002, 0.6457892041076739, 0.6264846248417969, 0.654753341740741, 0.6259585874084876, 0.6372454569863709, 0.6293433310840203, 0.607464099100377, 0.6512000790316216, 0.6390304522318587, 0.6316567222329622, 0.6206258259045184],
    "df_decision_tree": [0.6770257726172174, 0.6633258261823315, 0.6739352674518129, 0.6682959918184842, 0.678974431301559, 0.6789052613467293, 0.6790964339919333, 0.6533908102356193, 0.6629456522968369, 0.6911843654106359, 0.686099263883524, 0.6746852525896481, 0.6745675847723908, 0.6639516515727539, 0.6634014725973255],
    "df_gradient_boosting": [0.6955070323948679, 0.6828904039187496, 0.6836404609350719, 0.6908831172560337, 0.6927954871171442, 0.6819598543881827, 0.6957954047606639, 0.6878262903471253, 0.6890387296814794, 0.7055847947636321, 0.688774823363504, 0.6916648247129444, 0.7116539485820965, 0.6901701016749424, 0.6736107870642402],
    "df_linear_svc": [0.6640912917217455, 0.6486332125601305, 0.656381252504911, 0.6531627252039879, 0.6568370770270096, 0.6492467369161252, 0.6632447028037293, 0.6457857807745967, 0.6630042374009096, 0.6600010476183447, 0.644250153588509, 0.6592552050065187, 0.6681888205801503, 0.66329202122623, 0.6400311921991545],
    "df_logistic_regression": [0.6707827158167312, 0.6671521463584149, 0.6759122169395475, 0.6765127033957171, 0.6609882532750277, 0.6626939232352563, 0.6768890845189063, 0.6693456169473113, 0.6583407992076723, 0.6780577053178325, 0.6612968943128319, 0.6830517637545265, 0.673949818999935, 0.6947020233982683, 0.6508074920546604],
    "df_naive_bayes": [0.6037003895795154, 0.5783399354936467, 0.5915891834900432, 0.5828521722479341, 0.6036724049164155, 0.5987563818093229, 0.58729875238312, 0.5960417747981721, 0.5823914241282497, 0.5804558318989413, 0.5814591115590791, 0.5869721150037636, 0.6004368840516041, 0.6011970416060002, 0.5818907867501723],
    "df_random_forest": [0.6812957847842208, 0.6645463093118902, 0.682328645280497, 0.6751463882653986, 0.6745926818223958, 0.6688914017719391, 0.6857160144310148, 0.6697577753827998, 0.6651727057398907, 0.6719469086605997, 0.6674004374620061, 0.6692183927751607, 0.6838062630614877, 0.6779197773501235, 0.6613866871184305],
}


@pytest.fixture(scope="module")
def folds(spark):
    data = [(m, f"r{i // 5 + 1}_f{i % 5 + 1}", v) for m, vs in FOLD_F1.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "model_id string, fold_id string, macro_f1 double").coalesce(1).cache()


def matrix(spark, m, labels=(2, 3, 4)):
    return spark.createDataFrame([(a, b, m[i][j]) for i, a in enumerate(labels) for j, b in enumerate(labels)],
                                 "y_true long, y_pred long, n long")


def test_published_rank_tests(spark, folds):
    ranks = ranktests.fold_ranks(folds)
    f = ranktests.friedman(ranks).first()
    assert f["statistic"] == pytest.approx(158.83589743589744) and f["p_value"] == pytest.approx(2.3173653163241833e-28, rel=1e-6)
    average = dict(rows(ranktests.average_ranks(ranks), "model_id", "average_rank"))
    assert average["df_gradient_boosting"] == pytest.approx(1.0666666667) and average["bc_decision_tree"] == pytest.approx(11.6666666667)
    pairs = ranktests.nemenyi(ranks)
    assert pairs.count() == 66 and pairs.first()["critical_difference"] == pytest.approx(4.302527, abs=1e-3)
    w = {(r["model_a"], r["model_b"]): r for r in ranktests.wilcoxon(folds).collect()}
    assert len(w) == 66
    zero = [r for r in w.values() if r["statistic"] == 0]
    assert zero and all(r["p_value"] == pytest.approx(6.103515625e-05) for r in zero)
    assert any(r["statistic"] == 33 and r["p_value"] == pytest.approx(0.1353759765625) for r in w.values())
    few = folds.filter(F.col("model_id").isin("df_naive_bayes", "bc_naive_bayes"))
    assert ranktests.friedman(ranktests.fold_ranks(few)).first()["status"] == "insufficient_data"


def test_published_matrices(spark):
    gb = matrix(spark, [[5303, 1530, 130], [4086, 12715, 1850], [440, 2967, 7384]])
    s = metrics.scores(gb, []).first()
    assert s["n"] == 36405 and s["accuracy"] == pytest.approx(0.697761, abs=1e-6)
    base = matrix(spark, [[1014, 1153, 154], [769, 3909, 1539], [128, 997, 2472]])
    labelled = base.select(F.col("y_true").alias("y1"), F.col("y_pred").alias("y2"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    a = divergence.agreement(labelled).first()
    assert (a["n"], a["n_exact"], a["n_within_1"]) == (12135, 7395, 11853) and a["mean_abs_delta"] == pytest.approx(0.414, abs=5e-4)
    macro = agreement.agreement_scores(labelled, [], "y2", "y1").first()
    assert macro["macro_f1"] == pytest.approx(0.5843, abs=5e-5)
    cells = {r["y1"]: (r["n_2"], r["n_3"], r["n_4"]) for r in divergence.crosstab(labelled, "y1", "y2", (2, 3, 4)).collect()}
    assert cells == {2: (1014, 1153, 154), 3: (769, 3909, 1539), 4: (128, 997, 2472)}


def test_zero_division_and_unseen_labels(spark):
    counts = spark.createDataFrame([(2, 2, 3), (3, 2, 1)], "y_true long, y_pred long, n long")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.per_class(counts, []).collect()}
    assert got[4] == (0.0, 0.0, 0.0) and got[3] == (0.0, 0.0, 0.0) and got[2][0] == 0.75
    fixed, seen = metrics.scores(counts, []).first(), metrics.scores(counts, [], seen_only=True).first()
    assert fixed["macro_f1"] == pytest.approx(seen["macro_f1"] * 2 / 3)
    one = spark.createDataFrame([("m", 0.5)], "model_id string, macro_f1 double")
    assert metrics.mean_std(one, ["model_id"], ["macro_f1"]).first()["macro_f1_std"] == 0.0


def _votes(spark, preds, f1, tie):
    members = [f"m{i}" for i in range(len(preds))]
    df = spark.createDataFrame([(m, "f", 1, p, 3, 3) for m, p in zip(members, preds)],
                               "model_id string, fold_id string, entity_id long, y_pred long, y_true long, y2 long")
    strength = spark.createDataFrame(list(zip(members, f1)), "model_id string, strength double")
    return ensemble.vote(df, strength, members, tie).first()["y_pred"]


def test_vote_ties(spark):
    assert _votes(spark, [2, 3, 4], [.6, .7, .7], "mean") == 3
    assert _votes(spark, [2, 2, 3, 3], [.9, .1, .6, .6], "mean") == 3
    assert _votes(spark, [2, 2, 3, 3], [.9, .1, .6, .6], "max") == 2


def test_majority_and_partial_members(spark):
    df = spark.createDataFrame([("m", 1, 3, 3, 2), ("m", 1, 3, 3, 2), ("m", 1, 4, 3, 2), ("m", 2, 2, 3, 2), ("m", 2, 4, 3, 2)],
                               "model_id string, entity_id long, y_pred long, y_true long, y2 long")
    got = {r["entity_id"]: r for r in ensemble.majority(df).collect()}
    assert (got[1]["majority"], got[1]["counts"]) == (3, [0, 2, 1]) and got[1]["confidence"] == pytest.approx(2 / 3)
    assert got[2]["majority"] == 2


def test_modal_completeness_merge(spark):
    best = spark.createDataFrame([("m", "a", 1), ("m", "b", 2), ("m", "b", 3), ("m", "a", 4)], "model_id string, params string, fold_ordinal long")
    assert rows(metrics.modal_params(best), "params", "n") == [("a", 2)]
    folds = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f1")], "model_id string, fold_id string")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "model_id string")
    assert rows(metrics.completeness(folds, expected, 2), "model_id", "status") == [("a", "COMPLETE"), ("b", "PARTIAL"), ("c", "INCOMPLETE")]
    assert rows(metrics.fold_consistency(folds), "model_id", "consistent") == [("a", True), ("b", False)]
    x, y = spark.createDataFrame([(1, "new")], "k int, v string"), spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    assert rows(metrics.merge_results(x, y, ["k"])) == [(1, "new"), (2, "old")]
    params = spark.createDataFrame([({"b": "1", "a": "2"},)], "p map<string,string>")
    assert params.select(metrics.canonical_params(F.col("p"))).first()[0] == '{"a":"2","b":"1"}'
    plan = metrics.model_plan(spark, ["df", "bc"], ["x", "y"])
    assert rows(plan, "model_id") == [("bc_x",), ("bc_y",), ("df_x",), ("df_y",)]


def test_quality_and_profile_pieces(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, None, "z")], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, 2.5, None), (4, 1.0, "q")], "id int, v double, s string")
    diff = quality.recompute_diff(a, b, ["id"], ["v", "s"])
    assert rows(diff, "id", "column", "problem") == [
        (2, "s", "different"), (2, "v", "different"), (3, "s", "not_recomputed"), (4, "s", "not_stored"), (4, "v", "not_stored")]
    checks = spark.createDataFrame([("a", True), ("b", False)], "check_name string, ok boolean")
    assert tuple(quality.overall_status(checks).first()) == ("issues", 1)
    binned = spark.createDataFrame([(float(i), i % 2) for i in range(10)] + [(None, 1)], "x double, delta int")
    got = rows(divergence.by_quantile(binned, "x"), "bin", "low", "high", "n")
    assert got[0] == (1, 0.0, 1.8, 2) and sum(r[3] for r in got) == 10
    same = spark.createDataFrame([(1.0, 0)] * 5, "x double, delta int")
    assert rows(divergence.by_quantile(same, "x"), "bin", "n") == [(1, 5)]
    c = profile.correlation(spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 0.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert {tuple(sorted((r["column_a"], r["column_b"]))): round(r["r"], 6) for r in c.collect()}[("a", "b")] == 1.0
