"""Queries over embeddings: search, ranking, verification, heads, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.functions.vectors import cosine_similarity as cosine
from pelage.functions.vectors import l2_normalize as normalized
from pelage.operators import evaluation as E
from pelage.operators import heads as H
from pelage.operators import retrieval as R
from pelage.operators import verification as V
from pelage.operators.dataset import dedupe_pairs as unordered
from pelage.operators.negatives import draw_sql
from pelage.operators.pruned import topk_neighbors_pruned
from pelage.plans.bindings import with_views
from pelage.plans.registry import query
from pelage.session import scratch_dir

c = F.col

# ---- SQL building blocks ----------------------------------------------------

VECTORS = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


SIMS = f"""sims AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, round({_cos('a.v', 'b.v')}, 9) AS s
FROM e a JOIN e b ON a.id <> b.id)"""
DETECTED = """g AS (SELECT id, identity_gt AS label, CAST(embedding AS DOUBLE[]) AS v FROM fx_probes WHERE has_pred)"""
DETECTED_SIMS = SIMS.replace("sims AS", "gsims AS").replace("FROM e a JOIN e b", "FROM g a JOIN g b")
RANKED = """ranked AS (SELECT a, b, la, lb, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM sims)"""
RANKS = "ranks AS (SELECT a AS id, min(rn) AS identity_rank FROM ranked WHERE la = lb GROUP BY a)"
GRANKED = RANKED.replace("ranked AS", "granked AS").replace("FROM sims", "FROM gsims")
RESULTS = """results AS (SELECT p.id, p.identity_gt IS NOT NULL AS gt, p.has_pred AS pred, p.identity_gt,
  (p.identity_gt IS NOT NULL) = p.has_pred AS detection_correct, r.identity_rank
FROM fx_probes p LEFT JOIN (SELECT a AS id, min(rn) AS identity_rank FROM granked WHERE la = lb GROUP BY a) r
  ON p.id = r.id)"""
EVALUATED = (DETECTED, DETECTED_SIMS, GRANKED, RESULTS)


def pairs_sql(body: str, *more: str) -> str:
    return with_views(body, VECTORS, SIMS, *more)


# ---- vectors ----------------------------------------------------------------

@query("cosine_similarity", with_views(
    f"SELECT a.id, round({_cos('a.v', 'b.v')}, 9) AS similarity FROM e a JOIN e b ON b.id = a.id + 1", VECTORS))
def cosine_similarity(t):
    """Each vector with the next one."""
    following = t.items.select((c("id") - 1).alias("id"), c("embedding").alias("next"))
    return t.items.join(following, "id").select(
        "id", F.round(cosine(c("embedding"), c("next")), 9).alias("similarity"))


@query("l2_normalize", with_views("""
SELECT id, round(list_sum(u), 9) AS total, round(list_dot_product(u, u), 9) AS squared,
  round(list_dot_product(u, list_transform(range(1, len(u) + 1), lambda i: CAST(i AS DOUBLE))), 7) AS weighted
FROM (SELECT id, list_transform(v, lambda x: x / n) AS u
  FROM (SELECT id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM e) x) y""", VECTORS))
def l2_normalize(t):
    """Sums over every component of the unit vector, one of them by position."""
    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    unit = t.items.select("id", normalized(c("embedding")).cast("array<double>").alias("u"))
    return unit.select(
        "id", F.round(total(c("u")), 9).alias("total"),
        F.round(total(F.transform("u", lambda x: x * x)), 9).alias("squared"),
        F.round(total(F.transform("u", lambda x, i: x * (i + 1))), 7).alias("weighted"))


# ---- search -----------------------------------------------------------------

@query("gallery_pairs", pairs_sql("""
SELECT a AS probe_id, count(*) AS n_pairs, round(avg(s), 6) AS mean_similarity,
  round(min(s), 6) AS min_similarity, round(max(s), 6) AS max_similarity FROM sims GROUP BY a"""))
def gallery_pairs(t):
    df = R.gallery_pairs(t.items)
    return df.select("probe_id", "n_pairs", *[
        F.round(k, 6).alias(k) for k in ("mean_similarity", "min_similarity", "max_similarity")])


@query("topk_neighbors", pairs_sql("""
SELECT a AS probe_id, rn AS rank, b AS gallery_id, s AS similarity, la = lb AS is_match FROM ranked WHERE rn <= 5""",
                                   RANKED))
def topk_neighbors(t):
    return R.topk_neighbors(t.items, 5)


@query("ann_topk", pairs_sql("""
SELECT a AS probe_id, rn AS rank, b AS gallery_id, s AS similarity FROM ranked WHERE rn <= 5""", RANKED))
def ann_topk(t):
    """Search by cells with exact bounds: the recall is 1."""
    return topk_neighbors_pruned(t.items, 5)


# Tight groups: a unit vector per label and id class, the given vector as small noise.
_GROUPED = """e AS (SELECT vec_id AS id, label, list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * 0.02e0
  + CASE WHEN i = 1 + vec_id % 48 THEN 1.0e0 ELSE 0.0e0 END) AS v FROM embeddings)"""


def grouped(t):
    noise = F.transform(c("embedding"), lambda x, i: x.cast("double") * 0.02 + F.when(i == c("id") % 48, 1.0).otherwise(0.0))
    return t.items.withColumn("embedding", noise)


@query("ann_topk_grouped", with_views("""
SELECT a AS probe_id, rn AS rank, b AS gallery_id, s AS similarity FROM ranked WHERE rn <= 5""", _GROUPED, SIMS, RANKED))
def ann_topk_grouped(t):
    """The same over vectors in tight groups, where the cells are used."""
    return topk_neighbors_pruned(grouped(t), 5)


_RANK_GALLERY = """
SELECT p.id AS probe_id, p.has_pred AS has_animal, m.rn AS rank, m.b AS gallery_id, m.s AS similarity
FROM fx_probes p LEFT JOIN (SELECT * FROM granked WHERE rn <= 10) m ON p.id = m.a"""


@query("rank_gallery", with_views(_RANK_GALLERY, *EVALUATED[:3]))
def rank_gallery(t):
    scored = t.probes.withColumn("embedding", F.when(c("has_pred"), c("embedding")))
    return R.rank_gallery(scored, scored, 10)


@query("identify_stream", pairs_sql("""
SELECT a AS probe_id, rn AS rank, b AS gallery_id, s AS similarity FROM ranked WHERE rn <= 5""", RANKED))
def identify_stream(t):
    from pelage.streaming.identify import identify_stream as start

    source = t.read("embeddings")
    # The table may be one file or a folder of them; a stream takes a single file only by a pattern.
    probes = t.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(
        f"{t.sf_dir}/embeddings.parque[t]").select(c("vec_id").alias("id"), "embedding")
    output = scratch_dir(t.spark, "identified")
    start(probes, t.items, output, scratch_dir(t.spark, "identify-state"), 5).awaitTermination()
    return t.spark.read.parquet(output).drop("batch")


@query("identity_rank", with_views("""
SELECT id, identity_gt, gt AS has_animal_gt, pred AS has_animal_pred, detection_correct, identity_rank FROM results""",
                                   *EVALUATED))
def identity_rank(t):
    return E.evaluate(t.probes)


@query("mrr", pairs_sql("""
SELECT round(coalesce(avg(1.0e0 / identity_rank), 0.0e0), 6) AS mrr, count(identity_rank) AS n_ranked FROM ranks""",
                        RANKED, RANKS))
def mrr(t):
    return R.mean_reciprocal_rank(R.identity_rank(t.items)).select(F.round("mrr", 6).alias("mrr"), "n_ranked")


@query("topk_accuracy", pairs_sql("""
SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN identity_rank <= k THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy,
  count(*) AS n_ranked FROM ranks, (VALUES (1), (3), (5), (10)) ks(k) GROUP BY k""", RANKED, RANKS))
def topk_accuracy(t):
    return R.topk_accuracy(R.identity_rank(t.items)).withColumn("accuracy", F.round("accuracy", 6))


def _map_sql(self_counts: bool) -> str:
    own = "UNION ALL SELECT id, 1.0e0, 0 FROM e" if self_counts else ""
    return pairs_sql(f"""
SELECT round(coalesce(avg(ap), 0.0e0), 6) AS map, count(*) AS n_queries FROM (
  SELECT a, avg(hits * 1.0e0 / n) AS ap FROM (
    SELECT a, rel, sum(rel) OVER w AS hits, count(*) OVER w AS n
    FROM (SELECT a, s, CASE WHEN la = lb THEN 1 ELSE 0 END AS rel FROM sims {own}) r
    WINDOW w AS (PARTITION BY a ORDER BY s DESC RANGE UNBOUNDED PRECEDING)) x
  WHERE rel = 1 GROUP BY a) y""")


@query("mean_average_precision", _map_sql(True))
def mean_average_precision(t):
    return R.mean_average_precision(t.items).withColumn("map", F.round("map", 6))


@query("mean_average_precision_without_self", _map_sql(False))
def mean_average_precision_without_self(t):
    return R.mean_average_precision(t.items, exclude_self=True).withColumn("map", F.round("map", 6))


# ---- verification -----------------------------------------------------------

@query("positive_pairs", pairs_sql("""
SELECT la AS label, count(*) AS n_pairs, round(avg(s), 6) AS mean_similarity, round(min(s), 6) AS min_similarity,
  round(max(s), 6) AS max_similarity FROM sims WHERE la = lb AND a < b GROUP BY la"""))
def positive_pairs(t):
    df = V.positive_pairs(t.items)
    return df.select("label", "n_pairs", *[
        F.round(k, 6).alias(k) for k in ("mean_similarity", "min_similarity", "max_similarity")])


def _negatives_sql(weighting: str) -> str:
    """The first slots' pairs; four slots for each of the largest sample that is asked for."""
    if weighting == "identity":
        sides = f"""
  SELECT slot, x.first + {draw_sql(42, "slot || '|1'", 0, 'x.n')} AS p, y.first + {draw_sql(42, "slot || '|1'", 1, 'y.n')} AS q
  FROM (SELECT slot, a, b + (b >= a)::INT AS b FROM (SELECT slot, {draw_sql(42, "slot || '|0'", 0, 'labels')} AS a,
    {draw_sql(42, "slot || '|0'", 1, '(labels - 1)')} AS b FROM slots, (SELECT count(*) AS labels FROM groups))) d
  JOIN groups x ON x.code = a JOIN groups y ON y.code = b"""
    else:
        sides = f"""
  SELECT slot, a AS p, b + (b >= a)::INT AS q FROM (SELECT slot, {draw_sql(42, "slot || '|0'", 0, 'items')} AS a,
    {draw_sql(42, "slot || '|0'", 1, '(items - 1)')} AS b FROM slots, (SELECT count(*) AS items FROM places))"""
    return f"""places AS (SELECT id, label, row_number() OVER (ORDER BY label, id) - 1 AS place,
  dense_rank() OVER (ORDER BY label) - 1 AS code FROM e WHERE label IS NOT NULL),
groups AS (SELECT code, count(*) AS n, min(place) AS first FROM places GROUP BY code),
slots AS (SELECT unnest(range(0, (4 * greatest(20 * (SELECT count(*) FROM e), (SELECT sum(n * (n - 1)) FROM groups)))::BIGINT)) AS slot),
negatives AS (SELECT a, b, s, row_number() OVER (ORDER BY slot) AS place FROM (
  SELECT least(x.id, y.id) AS low, greatest(x.id, y.id) AS high, min(slot) AS slot FROM ({sides}) t
  JOIN places x ON x.place = p JOIN places y ON y.place = q WHERE x.label <> y.label GROUP BY ALL) f JOIN sims ON a = low AND b = high)"""


NEGATIVES = _negatives_sql("identity")


@query("negative_pairs", pairs_sql(
    "SELECT a AS id_a, b AS id_b FROM negatives WHERE place <= 20 * (SELECT count(*) FROM e)", NEGATIVES))
def negative_pairs(t):
    """Twenty negatives per item, drawn identity-uniformly."""
    return V.negative_pairs(t.items, 20 * t.items.count())


@query("negative_pairs_by_pair", pairs_sql(
    "SELECT a AS id_a, b AS id_b FROM negatives WHERE place <= 20 * (SELECT count(*) FROM e)", _negatives_sql("pair")))
def negative_pairs_by_pair(t):
    """The same number, every pair equally likely."""
    return V.negative_pairs(t.items, 20 * t.items.count(), weighting="pair")


@query("dedupe_pairs", pairs_sql("""
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM ranked WHERE rn <= 5""", RANKED))
def dedupe_pairs(t):
    """Neighbour lists as unordered pairs."""
    lists = R.topk_neighbors(t.items, 5)
    return unordered(lists.select(c("probe_id").alias("id_a"), c("gallery_id").alias("id_b")))


def _tar_union(negatives: str, *fars: float) -> str:
    parts = [f"""
SELECT CAST({far} AS DOUBLE) AS far, round(avg(CASE WHEN p.s >= threshold THEN 1.0e0 ELSE 0.0e0 END), 6) AS tar,
  round(max(threshold), 6) AS threshold, count(*) AS n_genuine, max(n_impostor) AS n_impostor
FROM (SELECT s FROM sims WHERE a < b AND la = lb) p,
  (SELECT quantile_cont(s, CAST({1 - far} AS DOUBLE)) AS threshold, count(*) AS n_impostor FROM ({negatives}) n) th"""
             for far in fars]
    return " UNION ALL ".join(parts)


def _rounded_tar(df):
    return df.withColumn("tar", F.round("tar", 6)).withColumn("threshold", F.round("threshold", 6))


@query("tar_at_far", pairs_sql(_tar_union("SELECT s FROM sims WHERE a < b AND la <> lb", 0.001, 0.01, 0.1)))
def tar_at_far(t):
    return _rounded_tar(V.tar_at_far(t.items))


SAMPLED = "SELECT s FROM negatives WHERE place <= 2 * (SELECT count(*) FROM sims WHERE a < b AND la = lb)"


@query("tar_at_far_sampled", pairs_sql(_tar_union(SAMPLED, 0.01), NEGATIVES))
def tar_at_far_sampled(t):
    return _rounded_tar(V.tar_at_far_sampled(t.items))


@query("embedding_report", pairs_sql(f"""
SELECT m.map, a.tar AS tar_far_1pct, b.tar AS tar_far_0_1pct, a.threshold AS threshold_1pct,
  b.threshold AS threshold_0_1pct, (SELECT count(DISTINCT label) FROM e) AS num_identities
FROM ({_map_sql(True)}) m, ({_tar_union(SAMPLED, 0.01)}) a, ({_tar_union(SAMPLED, 0.001)}) b""", NEGATIVES))
def embedding_report(t):
    df = V.embedding_report(t.items)
    return df.select(*[c(k) if k == "num_identities" else F.round(k, 6).alias(k) for k in df.columns])


# ---- evaluation -------------------------------------------------------------

_COUNTS = """SELECT count(*) AS total_images, count(*) FILTER (WHERE gt) AS animal_images,
  count(*) FILTER (WHERE NOT gt) AS non_animal_images, count(*) FILTER (WHERE gt = pred) AS hits,
  count(*) FILTER (WHERE gt AND pred) AS true_positives, count(*) FILTER (WHERE NOT gt AND pred) AS false_positives,
  count(*) FILTER (WHERE gt AND NOT pred) AS false_negatives
FROM (SELECT identity_gt IS NOT NULL AS gt, has_pred AS pred FROM fx_probes) r"""
_DETECTION = f"""SELECT round(hits * 1.0e0 / total_images, 6) AS accuracy,
  round(true_positives * 1.0e0 / (true_positives + false_positives), 6) AS precision,
  round(true_positives * 1.0e0 / (true_positives + false_negatives), 6) AS recall,
  true_positives, false_positives, false_negatives, total_images, animal_images, non_animal_images
FROM ({_COUNTS}) k"""


@query("detection_metrics", with_views(_DETECTION))
def detection_metrics(t):
    flags = t.probes.select(
        c("identity_gt").isNotNull().alias("has_animal_gt"), c("has_pred").alias("has_animal_pred"))
    df = E.detection_metrics(flags)
    return df.select(*[F.round(k, 6).alias(k) if k in ("accuracy", "precision", "recall") else c(k) for k in df.columns])


GENUINE = "SELECT s FROM gsims WHERE a < b AND la = lb"
IMPOSTOR = "SELECT s FROM gsims WHERE a < b AND la <> lb"
REPORT = f"""report AS (
  SELECT metric, CAST(NULL AS DOUBLE) AS k, value FROM (
    SELECT unnest(['detection_accuracy', 'detection_precision', 'detection_recall', 'total_images', 'animal_images',
        'non_animal_images']) AS metric,
      unnest([accuracy, precision, recall, CAST(total_images AS DOUBLE), CAST(animal_images AS DOUBLE),
        CAST(non_animal_images AS DOUBLE)]) AS value FROM ({_DETECTION}) d) x
  UNION ALL SELECT 'mean_reciprocal_rank', NULL, round(avg(1.0e0 / identity_rank), 6) FROM results
  UNION ALL SELECT 'n_ranked', NULL, CAST(count(identity_rank) AS DOUBLE) FROM results
  UNION ALL SELECT 'top_k_accuracy', CAST(n AS DOUBLE), round(avg(CASE WHEN identity_rank <= n THEN 1.0e0 ELSE 0.0e0 END), 6)
    FROM results, (VALUES (1), (3), (5), (10)) ks(n) WHERE identity_rank IS NOT NULL GROUP BY n
  UNION ALL SELECT 'tar_at_far', far, tar FROM tars UNION ALL SELECT 'threshold_at_far', far, threshold FROM tars)"""
TARS = "tars AS (" + _tar_union(IMPOSTOR, 0.001, 0.01, 0.1).replace("sims", "gsims").replace("ggsims", "gsims") + ")"


@query("benchmark_report", with_views("SELECT metric, k, value FROM report", *EVALUATED, TARS, REPORT))
def benchmark_report(t):
    return E.benchmark_report(t.probes).withColumn("value", F.round("value", 6))


@query("metrics_log", with_views("""
SELECT 'run1' AS run, concat('test_', name) AS metric, value FROM (
  SELECT CASE WHEN metric IN ('detection_accuracy', 'detection_precision', 'detection_recall', 'mean_reciprocal_rank',
      'total_images') THEN metric
    WHEN metric = 'top_k_accuracy' AND k IN (1, 3, 5) THEN concat('top_', CAST(k AS INT), '_accuracy')
    WHEN metric = 'tar_at_far' THEN concat('tar_at_far_', replace(CAST(k AS VARCHAR), '.', '_')) END AS name, value
  FROM report) x WHERE name IS NOT NULL""", *EVALUATED, TARS, REPORT))
def metrics_log(t):
    return E.metrics_log(E.benchmark_report(t.probes), "run1", "test_").withColumn("value", F.round("value", 6))


@query("pair_identity_lookup", with_views("""
SELECT m.a AS probe_id, m.rn AS rank, m.b AS gallery_id, m.la AS probe_identity, m.lb AS gallery_identity,
  m.la = m.lb AS same_identity FROM granked m WHERE m.rn <= 5 AND m.la IS NOT NULL AND m.lb IS NOT NULL""",
                                          *EVALUATED[:3]))
def pair_identity_lookup(t):
    matches = R.topk_neighbors(E.gallery_of(t.probes).select("id", "embedding"), 5)
    return E.pair_identity_lookup(matches, t.probes).drop("similarity")


PREDICTED = """predicted AS (SELECT a AS id, coalesce(CAST(lb AS VARCHAR), '?') AS predicted, s AS similarity
FROM granked WHERE rn = 1)"""


@query("prediction_identity", with_views("SELECT id, predicted, similarity FROM predicted", *EVALUATED[:3], PREDICTED))
def prediction_identity(t):
    return E.prediction_identity(t.probes)


@query("query_subset", with_views("""
SELECT m.a AS probe_id, m.rn AS rank, m.b AS gallery_id, m.s AS similarity, m.la AS probe_identity,
  m.lb AS match_identity, coalesce(m.la = m.lb, false) AS is_correct
FROM granked m WHERE m.rn <= 5 AND m.la IS NOT NULL""", *EVALUATED[:3]))
def query_subset(t):
    """Matches of every probe with a known identity."""
    requested = t.probes.filter(c("identity_gt").isNotNull()).select("id")
    return E.query_subset(t.probes, requested)


FAILED = """failed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS position FROM (
  SELECT *, CASE WHEN gt AND NOT pred THEN 'missed_detections' WHEN NOT gt AND pred THEN 'false_positives'
    WHEN gt AND pred AND identity_rank IS DISTINCT FROM 1 THEN 'wrong_identities' END AS category FROM results) r
  WHERE category IS NOT NULL)"""


@query("failure_tables", with_views("""
SELECT category, position, id, identity_gt, identity_rank FROM failed WHERE position <= 20""", *EVALUATED, FAILED))
def failure_tables(t):
    return E.failure_tables(E.evaluate(t.probes)).drop("caption")


@query("failure_caption", with_views("""
SELECT category, f.id, concat(CASE category WHEN 'missed_detections' THEN 'Missed Detection'
    WHEN 'false_positives' THEN 'False Positive' ELSE 'Wrong Identity (Rank != 1)' END,
  chr(10), 'GT: ', coalesce(CAST(identity_gt AS VARCHAR), 'None'),
  CASE WHEN identity_rank <= 5 THEN concat(' | Rank: ', identity_rank)
    WHEN identity_rank IS NOT NULL OR (pred AND identity_gt IS NOT NULL) THEN ' | Rank: >5' ELSE '' END,
  CASE WHEN p.similarity IS NOT NULL THEN
    concat(chr(10), 'Pred: ', p.predicted, ' (', printf('%.3f', p.similarity), ')') ELSE '' END) AS caption
FROM failed f LEFT JOIN predicted p ON f.id = p.id WHERE position <= 20""", *EVALUATED, FAILED, PREDICTED))
def failure_caption(t):
    failures = E.failure_tables(E.evaluate(t.probes), E.prediction_identity(t.probes))
    return failures.select("category", "id", "caption")


# ---- heads ------------------------------------------------------------------

def _prototypes_sql(centers: int) -> str:
    center = f"vec_id % {centers}" if centers > 1 else "0"
    return f"""x AS (SELECT label, {center} AS center, unnest(CAST(embedding AS DOUBLE[])) AS x,
  generate_subscripts(embedding, 1) AS pos FROM embeddings),
p AS (SELECT label AS class, center, list(x ORDER BY pos) AS v FROM (
  SELECT label, center, pos, avg(x) AS x FROM x GROUP BY label, center, pos) y GROUP BY label, center),
cosines AS (SELECT e.id, e.label, p.class, max({_cos('e.v', 'p.v')}) AS cs FROM e, p GROUP BY e.id, e.label, p.class)"""


def _arc(cs: str) -> str:
    return f"""CASE WHEN {cs} > cos(pi() - 0.5e0)
  THEN {cs} * cos(0.5e0) - sqrt(greatest(0, 1 - {cs} * {cs})) * sin(0.5e0) ELSE {cs} - sin(pi() - 0.5e0) * 0.5e0 END"""


def _logits_sql(target: str, scale: str, centers: int = 1) -> str:
    return with_views(f"""SELECT id, class, label = class AS is_target,
  round((CASE WHEN label = class THEN {target} ELSE cs END) * {scale}, 6) AS logit FROM cosines""",
                      VECTORS, _prototypes_sql(centers))


def _prototypes(t, centers: int = 1):
    if centers == 1:
        return H.class_means(t.items)
    return H.class_means(t.items, c("id") % centers)


def _logits(t, head):
    return H.head_logits(t.items, _prototypes(t, head.centers), head).withColumn("logit", F.round("logit", 6))


@query("prototype_logits", _logits_sql("cs", "1"))
def prototype_logits(t):
    return H.prototype_logits(t.items, _prototypes(t)).withColumn("logit", F.round("logit", 6))


@query("arcface_logits", _logits_sql(_arc("cs"), "30"))
def arcface_logits(t):
    return _logits(t, H.ARCFACE)


@query("subcenter_arcface_logits", _logits_sql(_arc("cs"), "30", 3))
def subcenter_arcface_logits(t):
    return _logits(t, H.SUBCENTER_ARCFACE)


@query("cosface_logits", _logits_sql("cs - 0.35e0", "30"))
def cosface_logits(t):
    return _logits(t, H.COSFACE)


def _summary_sql(target: str, scale: str, centers: int = 1) -> str:
    """Target, log-sum-exp, loss and the three best classes of each item, a row per class."""
    return with_views(f"""SELECT id, round(max(z) FILTER (own) OVER w, 6) AS target, round(ln(sum(exp(z)) OVER w), 6) AS lse,
  round(ln(sum(exp(z)) OVER w) - max(z) FILTER (own) OVER w, 6) AS loss, class, round(z, 6) AS logit, place AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC, class) AS place FROM (
  SELECT id, class, label = class AS own, (CASE WHEN label = class THEN {target} ELSE cs END) * {scale} AS z FROM cosines) a) b
WINDOW w AS (PARTITION BY id) QUALIFY place <= 3""", VECTORS, _prototypes_sql(centers))


def _summary(t, head):
    rows = H.head_summary(t.items, _prototypes(t, head.centers), head, 3)
    numbers = [F.round(k, 6).alias(k) for k in ("target", "lse", "loss")]
    return rows.select("id", *numbers, F.posexplode("best").alias("rank", "b")).select(
        "id", "target", "lse", "loss", c("b.class").alias("class"), F.round("b.logit", 6).alias("logit"), (c("rank") + 1).cast("long").alias("rank"))


@query("prototype_summary", _summary_sql("cs", "1"))
def prototype_summary(t):
    return _summary(t, H.PLAIN)


@query("arcface_summary", _summary_sql(_arc("cs"), "30"))
def arcface_summary(t):
    return _summary(t, H.ARCFACE)


@query("subcenter_arcface_summary", _summary_sql(_arc("cs"), "30", 3))
def subcenter_arcface_summary(t):
    return _summary(t, H.SUBCENTER_ARCFACE)


@query("cosface_summary", _summary_sql("cs - 0.35e0", "30"))
def cosface_summary(t):
    return _summary(t, H.COSFACE)


@query("smoothed_cross_entropy", with_views(f"""
SELECT round(avg(0.9e0 * (lse - target) + 0.1e0 * (lse - mean)), 6) AS loss, count(*) AS n_items FROM (
  SELECT id, ln(sum(exp(z))) AS lse, avg(z) AS mean, sum(CASE WHEN label = class THEN z ELSE 0 END) AS target FROM (
    SELECT id, label, class, (CASE WHEN label = class THEN {_arc('cs')} ELSE cs END) * 30 AS z FROM cosines) a
  GROUP BY id) b""", VECTORS, _prototypes_sql(1)))
def smoothed_cross_entropy(t):
    return H.smoothed_cross_entropy(t.items, _prototypes(t)).withColumn("loss", F.round("loss", 6))


@query("triplet_loss", pairs_sql("""
SELECT round(avg(greatest(0, sqrt(list_sum(list_transform(list_zip(a.v, p.v), lambda q: (q[1] - q[2] + 1e-6) * (q[1] - q[2] + 1e-6))))
  - sqrt(list_sum(list_transform(list_zip(a.v, n.v), lambda q: (q[1] - q[2] + 1e-6) * (q[1] - q[2] + 1e-6)))) + 1)), 6) AS loss,
  count(*) AS n_triplets
FROM (SELECT a, arg_min(b, rn) FILTER (WHERE la = lb) AS pos, arg_min(b, rn) FILTER (WHERE la <> lb) AS neg
  FROM ranked GROUP BY a) t JOIN e a ON a.id = t.a JOIN e p ON p.id = t.pos JOIN e n ON n.id = t.neg""", RANKED))
def triplet_loss(t):
    """Hardest triplets: nearest item of the same and of another label."""
    return H.triplet_loss(H.triplets(t.items), t.items).withColumn("loss", F.round("loss", 6))
