"""Queries of the evaluation operators over fixed scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import evaluation as E
from prosemill.operators.detect import weighted_score
from prosemill.plans.registry import query
from prosemill.plans.tables import SCORES, TIED, scores, table, tied_scores


def rounded(rows, places: int = 9):
    return rows.select(*(F.round(c, places).alias(c) if kind == "double" else c for c, kind in rows.dtypes))


def _counts(threshold: str = "0.5") -> str:
    return (
        f"count(*) FILTER (y_true = 0 AND y_prob < {threshold}) AS tn, count(*) FILTER (y_true = 0 AND y_prob >= {threshold}) AS fp, "
        f"count(*) FILTER (y_true = 1 AND y_prob < {threshold}) AS fn, count(*) FILTER (y_true = 1 AND y_prob >= {threshold}) AS tp"
    )


_RATES = """tn, fp, fn, tp,
    round(coalesce((tp + tn) / nullif(CAST(tn + fp + fn + tp AS DOUBLE), 0), 0), 9) AS accuracy,
    round((coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) + 1 - coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0)) / 2, 9) AS balanced_accuracy,
    round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 9) AS "precision",
    round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 9) AS recall,
    round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 9) AS f1,
    round(coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0), 9) AS fpr"""


def _auc(view: str, by: str = "") -> str:
    """ROC-AUC by average ranks; `by`: a column."""
    part, group, lead = (f"PARTITION BY {by}", f"GROUP BY {by}", f"{by}, ") if by else ("", "", "")
    return f"""SELECT {lead}coalesce((sum(r) FILTER (y_true = 1) - CAST(count(*) FILTER (y_true = 1) AS DOUBLE) * (count(*) FILTER (y_true = 1) + 1) / 2)
        / nullif(CAST(count(*) FILTER (y_true = 1) AS DOUBLE) * count(*) FILTER (y_true = 0), 0), 0) AS roc_auc
        FROM (SELECT *, rank() OVER ({part} ORDER BY y_prob) + (count(*) OVER (PARTITION BY {lead}y_prob) - 1) / 2.0 AS r FROM {view}) {group}"""


@query(f"WITH {SCORES}, c AS (SELECT {_counts()} FROM scores), a AS ({_auc('scores')}) SELECT {_RATES}, round(roc_auc, 9) AS roc_auc FROM c, a")
def class_report(spark, sf_dir):
    return rounded(E.classification_report(scores(spark, sf_dir)))


@query(f"WITH {SCORES}, t AS (SELECT unnest([0.45, 0.5, 0.55]::DOUBLE[]) AS threshold), c AS (SELECT threshold, {_counts('threshold')} FROM scores, t GROUP BY threshold) SELECT threshold, {_RATES} FROM c")
def thresholds_side_by_side(spark, sf_dir):
    return rounded(E.at_thresholds(scores(spark, sf_dir), [0.45, 0.5, 0.55]))


@query(f"WITH {SCORES} SELECT CASE WHEN y_true = 0 THEN 'human' ELSE 'AI' END AS actual, count(*) FILTER (y_prob < 0.5) AS called_human, count(*) FILTER (y_prob >= 0.5) AS called_ai FROM scores GROUP BY 1")
def confusion(spark, sf_dir):
    rows = scores(spark, sf_dir).select(F.when(F.col("y_true") == 0, "human").otherwise("AI").alias("actual"), F.when(F.col("y_prob") >= 0.5, "called_ai").otherwise("called_human").alias("called"))
    return rows.groupBy("actual").pivot("called", ["called_human", "called_ai"]).count().na.fill(0)


@query(f"WITH {TIED}, a AS ({_auc('tied')}) SELECT round(roc_auc, 9) AS roc_auc FROM a")
def roc_auc(spark, sf_dir):
    return rounded(E.roc_auc(tied_scores(spark, sf_dir)))


@query(f"WITH {TIED}, a AS ({_auc('tied', 'source')}), c AS (SELECT source, {_counts()} FROM tied GROUP BY source) SELECT source, round(roc_auc - coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0), 9) AS auc_minus_fpr FROM a JOIN c USING (source)")
def auc_minus_fpr(spark, sf_dir):
    return rounded(E.hybrid_score(tied_scores(spark, sf_dir), ["source"]))


_PER_SOURCE = f"""WITH {SCORES}, s AS (SELECT y_true, y_prob, CASE WHEN y_true = 0 THEN 'human' || CAST(row_id % 2 AS VARCHAR) ELSE 'ai' || CAST(row_id % 3 AS VARCHAR) END AS source FROM scores),
    g AS (SELECT source, count(*) FILTER (y_true = 1) AS ai, count(*) AS n_rows, count(*) FILTER (y_prob >= 0.5) AS called, count(*) FILTER (y_prob >= 0.5 AND y_true = 1) AS caught FROM s GROUP BY source),
    b AS (SELECT g.source, s.y_true, s.y_prob FROM s, g WHERE g.ai > 0 AND (s.y_true = 0 OR s.source = g.source)), a AS ({_auc('b', 'source')})
    SELECT g.source, CASE WHEN ai = 0 THEN 'human' ELSE 'AI' END AS class, CASE WHEN ai = 0 THEN n_rows ELSE ai END AS n, CASE WHEN ai = 0 THEN round(called / CAST(n_rows AS DOUBLE), 9) END AS fpr,
    CASE WHEN ai > 0 THEN round(caught / CAST(ai AS DOUBLE), 9) END AS recall, CASE WHEN ai > 0 THEN round(roc_auc, 9) END AS roc_auc FROM g LEFT JOIN a USING (source)"""


@query(_PER_SOURCE)
def per_source(spark, sf_dir):
    s = scores(spark, sf_dir)
    name = F.when(F.col("y_true") == 0, F.concat(F.lit("human"), (F.col("row_id") % 2).cast("string"))).otherwise(F.concat(F.lit("ai"), (F.col("row_id") % 3).cast("string")))
    return rounded(E.per_source(s.withColumn("source", name)))


@query(f"""WITH {SCORES}, c AS (SELECT source, count(*) FILTER (y_prob >= 0.5) AS fp, count(*) AS n FROM scores WHERE y_true = 0 GROUP BY source),
    d AS (SELECT *, fp / CAST(n AS DOUBLE) AS p, 1.96 * 1.96 AS z2 FROM c),
    e AS (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS mid, (1.96 / (1 + z2 / n)) * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) AS margin FROM d)
    SELECT source, fp, n, round(greatest(0, mid - margin), 9) AS low, round(least(1, mid + margin), 9) AS high FROM e""")  # fmt: skip
def wilson_ci(spark, sf_dir):
    c = scores(spark, sf_dir).where("y_true = 0").groupBy("source").agg(F.count(F.when(F.col("y_prob") >= 0.5, 1)).alias("fp"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("fp"), F.col("n"))
    return rounded(c.select("source", "fp", "n", low.alias("low"), high.alias("high")))


@query(f"WITH {SCORES} SELECT group_id, count(*) FILTER (y_prob >= 0.5) AS fp, count(*) AS n FROM scores WHERE y_true = 0 GROUP BY group_id")
def cluster_agg(spark, sf_dir):
    return E.cluster_counts(scores(spark, sf_dir))


@query()
def cluster_bootstrap_ci(spark, sf_dir):
    return E.cluster_interval(scores(spark, sf_dir))


_LENGTH = f"""WITH r AS (SELECT doc_id, quality AS y_true, source, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS DOUBLE) AS words FROM documents JOIN labels USING (doc_id)),
    train AS (SELECT * FROM r WHERE doc_id % 3 > 0), test AS (SELECT * FROM r WHERE doc_id % 3 = 0),
    v AS (SELECT y_true, -words AS y_prob FROM train), d AS (SELECT CASE WHEN roc_auc >= 0.5 THEN -1.0 ELSE 1.0 END AS sign FROM ({_auc('v')})),
    s AS (SELECT y_true, sign * words AS score FROM train, d),
    q AS (SELECT DISTINCT unnest(quantile_cont(score, [{', '.join(str(i / 200) for i in range(201))}])) AS cut FROM s),
    b AS (SELECT cut, (count(*) FILTER (y_true = 1 AND score >= cut) / CAST(count(*) FILTER (y_true = 1) AS DOUBLE) + 1 - count(*) FILTER (y_true = 0 AND score >= cut) / CAST(count(*) FILTER (y_true = 0) AS DOUBLE)) / 2 AS bal FROM s, q GROUP BY cut),
    best AS (SELECT cut FROM b ORDER BY round(bal, 12) DESC, cut LIMIT 1),
    o AS (SELECT 'all AI sources' AS scope, y_true, sign * words AS y_prob FROM test, d UNION ALL
          SELECT a.source, t.y_true, sign * t.words FROM test t, d, (SELECT DISTINCT source FROM test WHERE y_true = 1) a WHERE t.y_true = 0 OR t.source = a.source),
    u AS ({_auc('o', 'scope')}),
    g AS (SELECT scope, count(*) FILTER (y_true = 0) AS n_human, count(*) FILTER (y_true = 1) AS n_ai, count(*) FILTER (y_true = 0 AND y_prob >= cut) AS fp, count(*) FILTER (y_true = 1 AND y_prob >= cut) AS tp FROM o, best GROUP BY scope)
    SELECT scope, CASE WHEN sign < 0 THEN 'AI if words <= ' || CAST(CAST(round_even(-cut, 0) AS BIGINT) AS VARCHAR) ELSE 'AI if words >= ' || CAST(CAST(round_even(cut, 0) AS BIGINT) AS VARCHAR) END AS rule, round(roc_auc, 9) AS roc_auc,
    round((coalesce(tp / nullif(CAST(n_ai AS DOUBLE), 0), 0) + 1 - coalesce(fp / nullif(CAST(n_human AS DOUBLE), 0), 0)) / 2, 9) AS balanced_accuracy,
    round(coalesce(fp / nullif(CAST(n_human AS DOUBLE), 0), 0), 9) AS fpr, round(coalesce(tp / nullif(CAST(n_ai AS DOUBLE), 0), 0), 9) AS recall, n_human, n_ai FROM g JOIN u USING (scope), best, d"""


@query(_LENGTH)
def length_baseline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select("doc_id", F.col("quality").alias("y_true"), "source", F.regexp_count("text", F.lit(r"\S+")).alias("words"))
    return rounded(E.length_baseline(rows.where("doc_id % 3 > 0"), rows.where("doc_id % 3 = 0")))


_FOLDS = f"""WITH {SCORES}, h AS (SELECT *, CAST((row_id * 104729) % 1000 AS DOUBLE) / 1000 AS other FROM scores WHERE y_true = 0),
    f AS (SELECT group_id, CAST((row_number() OVER (ORDER BY md5(group_id || ':42'), group_id) - 1) % 5 + 1 AS INTEGER) AS fold FROM (SELECT DISTINCT group_id FROM h)),
    folds AS (SELECT fold, avg(CASE WHEN y_prob >= 0.5 THEN 1.0 ELSE 0.0 END) AS hybrid, avg(CASE WHEN other >= 0.5 THEN 1.0 ELSE 0.0 END) AS other, count(*) AS n_human FROM h JOIN f USING (group_id) GROUP BY fold)"""


def _fold_table(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumnRenamed("y_prob", "hybrid").withColumn("other", (F.col("row_id") * 104729 % 1000).cast("double") / 1000)
    return E.fold_fpr(rows, ["hybrid", "other"], 5)


@query(_FOLDS + " SELECT fold, round(hybrid, 9) AS hybrid, round(other, 9) AS other, n_human FROM folds")
def fold_fpr(spark, sf_dir):
    return rounded(_fold_table(spark, sf_dir))


@query(_FOLDS + """ SELECT 'other' AS baseline, round(avg(hybrid), 9) AS hybrid_mean_fpr, round(avg(other), 9) AS baseline_mean_fpr, round(avg(hybrid - other), 9) AS mean_diff,
    round(avg(hybrid - other) / (stddev_samp(hybrid - other) / sqrt(count(*))), 6) AS t, count(*) AS n_folds FROM folds""")  # fmt: skip
def paired_t(spark, sf_dir):
    return rounded(E.paired_t(_fold_table(spark, sf_dir), "hybrid", ["other"])).withColumn("t", F.round("t", 6))


@query(f"WITH {SCORES}, c AS (SELECT count(*) FILTER (y_true = 0) AS fp, count(*) FILTER (y_true = 1) AS tp, 0::BIGINT AS tn, 0::BIGINT AS fn FROM scores) SELECT 'always AI' AS model, {_RATES} FROM c")
def always_ai_baseline(spark, sf_dir):
    return rounded(E.always_ai(scores(spark, sf_dir)))


@query(f"""WITH {TIED}, a AS ({_auc('tied', 'source')}), c AS (SELECT source, {_counts()} FROM tied GROUP BY source), r AS (SELECT source, roc_auc, coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0) AS fpr FROM a JOIN c USING (source)),
    w AS (SELECT max(CASE WHEN source = 'F' THEN roc_auc END) AS ta, max(CASE WHEN source = 'F' THEN fpr END) AS tf, max(CASE WHEN source = 'O' THEN roc_auc END) AS va, max(CASE WHEN source = 'O' THEN fpr END) AS vf FROM r)
    SELECT CASE WHEN ta < 0.9 AND va < 0.9 THEN 'underfit' WHEN vf - tf >= 0.03 OR ta - va >= 0.02 THEN 'overfit' WHEN abs(tf - vf) >= 0.03 THEN 'noisy' ELSE 'right' END AS verdict FROM w""")  # fmt: skip
def fit_verdict(spark, sf_dir):
    r = E.classification_report(tied_scores(spark, sf_dir), 0.5, ["source"])

    def of(source, column):
        return F.max(F.when(F.col("source") == source, F.col(column)))

    w = r.agg(of("F", "roc_auc").alias("ta"), of("F", "fpr").alias("tf"), of("O", "roc_auc").alias("va"), of("O", "fpr").alias("vf"))
    return w.select(E.fit_verdict(F.col("ta"), F.col("tf"), F.col("va"), F.col("vf"), F.col("tf")).alias("verdict"))


_CANDIDATES = "c AS (SELECT CAST(p_partkey AS INTEGER) AS idx, CAST(1 + p_partkey % 2 AS INTEGER) AS depth, p_size / 1000.0::DOUBLE AS fpr, p_retailprice AS score FROM part)"


@query(f"""WITH {_CANDIDATES}, b AS (SELECT fpr AS best FROM c ORDER BY score DESC, idx LIMIT 1)
    SELECT idx, depth, round(fpr, 9) AS fpr, score FROM c, b ORDER BY (depth = 1 AND fpr <= best + 0.005) DESC, score DESC, idx LIMIT 1""")
def stump_rule(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    c = part.select(F.col("p_partkey").cast("int").alias("idx"), (1 + F.col("p_partkey") % 2).cast("int").alias("depth"), (F.col("p_size") / 1000).alias("fpr"), F.col("p_retailprice").alias("score"))
    return E.stump_rule(c).withColumn("fpr", F.round("fpr", 9))


@query("""SELECT doc_id, CASE WHEN p <= 20 THEN 'Likely Human-Written' WHEN p >= 80 THEN 'Highly Likely AI-Generated' ELSE 'Possible AI Assistance / Mixed Content' END AS band
    FROM (SELECT doc_id, round_even(CAST((doc_id * 7919) % 1000 AS DOUBLE) / 10, 0) AS p FROM documents)""")
def score_bands(spark, sf_dir):
    p = F.bround((F.col("doc_id") * 7919 % 1000).cast("double") / 10)
    return table(spark, sf_dir, "documents").select("doc_id", T.score_band(p).alias("band"))


@query("SELECT conv_id, round(sum(len(text) * ((conv_id * 31 + turn * 7) % 100) / 100.0) / nullif(sum(len(text)), 0), 9) AS score FROM conversations GROUP BY conv_id")
def weighted_score_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.length("text").alias("word_count"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % 100 / 100).alias("ai_probability")).alias("p"))
    return turns.groupBy("conv_id").agg(F.collect_list("p").alias("ps")).select("conv_id", F.round(weighted_score(F.col("ps")), 9).alias("score"))


_GAIN = "i AS (SELECT CAST(p_partkey AS INTEGER) AS idx, p_name AS feature, p_retailprice AS gain FROM part)"


@query(f"WITH {_GAIN}, t AS (SELECT sum(gain) FILTER (idx < 100) AS a, sum(gain) FILTER (idx >= 100) AS b FROM i) SELECT round(a, 4) AS first_gain, round(b, 4) AS second_gain, round(a / (a + b), 9) AS first_share, round(b / (a + b), 9) AS second_share FROM t")
def gain_shares(spark, sf_dir):
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("idx"), F.col("p_name").alias("feature"), F.col("p_retailprice").alias("gain"))
    return rounded(E.gain_shares(i, 100)).withColumns({c: F.round(c, 4) for c in ("first_gain", "second_gain")})


@query(f"WITH {_GAIN} SELECT feature, gain FROM i ORDER BY gain DESC, idx LIMIT 10")
def top_gain_features(spark, sf_dir):
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("idx"), F.col("p_name").alias("feature"), F.col("p_retailprice").alias("gain"))
    return E.top_features(i, 10)
