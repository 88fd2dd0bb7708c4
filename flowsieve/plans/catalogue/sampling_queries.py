"""Splits and samples over the flow and event stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import sampling as S
from flowsieve.operators.windows import add_window
from flowsieve.plans.catalogue import Query
from flowsieve.plans.stand_in import event_cte, event_records, flow_cte, flow_table
from flowsieve.session import cut_lineage

SEED = 42
KEY = {"label": "Label", "key": "row_key"}


def rank_sql(seed: int, key: str = "row_key") -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT, {key}"


def unit_sql(seed: int, text: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {text}), 1, 15))::BIGINT) % 1000000) / 1000000.0"


def _keyed_flows(spark, sf_dir):
    """Flow rows with their key as a stored column; sampling passes over it several times."""
    return cut_lineage(flow_table(spark, sf_dir).select("row_key", "Label", "l_quantity"), "keyed-flows")


def _windowed(spark, sf_dir):
    events = add_window(event_records(spark, sf_dir), 5)
    return events.withColumn("application", F.lower(F.coalesce("app_proto", F.lit(""))))


def _group_split(spark, sf_dir):
    return S.group_hash_split(_windowed(spark, sf_dir), seed=SEED).select("row_id", "split")


def _row_split(spark, sf_dir):
    out = S.row_hash_split(event_records(spark, sf_dir), seed=SEED, parts=("src_ip", "row_id"))
    return out.select("row_id", "split")


def _time_hash(spark, sf_dir):
    out = S.time_hash_split(event_records(spark, sf_dir), seed=SEED, parts=("row_id",))
    return out.select("row_id", "split")


def _time(spark, sf_dir):
    return S.time_split(event_records(spark, sf_dir)).select("row_id", "split")


def _stratified(spark, sf_dir):
    return S.stratified_split(_keyed_flows(spark, sf_dir), **KEY, seed=SEED).select("row_key", "split")


def _under(spark, sf_dir):
    return S.undersample(_keyed_flows(spark, sf_dir), **KEY, seed=SEED).select("row_key", "Label")


def _uniform(spark, sf_dir):
    return S.uniform_sample(_keyed_flows(spark, sf_dir), 1234, key="row_key", seed=SEED).select("row_key")


def _quota(strategy):
    def run(spark, sf_dir):
        return S.quota_sample(_keyed_flows(spark, sf_dir), 3000, **KEY, strategy=strategy, seed=SEED).select("row_key", "Label")

    return run


def _report(spark, sf_dir):
    rows = _keyed_flows(spark, sf_dir)
    sample = S.quota_sample(rows, 0, **KEY, per_class=15_000, seed=SEED)
    return S.sample_report(rows, sample, label="Label", requested=15_000)


def _balanced(spark, sf_dir):
    return S.class_sample(_keyed_flows(spark, sf_dir), **KEY, per_class=2500, seed=SEED).select("row_key", "Label")


def _dual(spark, sf_dir):
    out = S.dual_holdout(_keyed_flows(spark, sf_dir), **KEY, natural_rows=5000, per_class_rows=2000, seed=SEED)
    return out.where("in_natural OR in_balanced").select("row_key", "in_natural", "in_balanced")


def _split_flow(spark, sf_dir):
    return S.stratified_split(_keyed_flows(spark, sf_dir), **KEY, seed=SEED)


def _distribution(spark, sf_dir):
    out = S.distribution(_split_flow(spark, sf_dir), "Label")
    return out.withColumn("ratio_percent", F.round("ratio_percent", 6))


def _coverage(spark, sf_dir):
    return S.coverage_warnings(_split_flow(spark, sf_dir), "Label")


def _summary(spark, sf_dir):
    out = S.class_summary(_split_flow(spark, sf_dir), "Label")
    return out.withColumns({c: F.round(c, 9) for c in ("benign_ratio", "attack_ratio")})


# Class share of the test side: whole parts first, the remainder to the larger fraction.
SPLIT_CTE = f"""{flow_cte()}, cls AS (SELECT Label, count(*) AS n, count(*) * 0.3 AS x FROM fl GROUP BY Label),
tot AS (SELECT CAST(ceil(sum(n) * 0.3 - 1e-9) AS BIGINT) AS t, CAST(sum(floor(x + 1e-9)) AS BIGINT) AS whole FROM cls),
quo AS (SELECT Label, floor(x + 1e-9) + CASE WHEN row_number() OVER (ORDER BY x - floor(x + 1e-9) DESC, CAST(Label AS VARCHAR))
        <= t - whole THEN 1 ELSE 0 END AS q FROM cls, tot),
spl AS (SELECT fl.*, CASE WHEN row_number() OVER (PARTITION BY fl.Label ORDER BY {rank_sql(SEED)}) <= q THEN 'test' ELSE 'train' END
        AS split FROM fl JOIN quo ON fl.Label = quo.Label)"""

_RANKED = f"WITH {flow_cte()}, r AS (SELECT row_key, Label, row_number() OVER (PARTITION BY Label ORDER BY {rank_sql(SEED)}) AS n, "
_RANKED += f"row_number() OVER (ORDER BY {rank_sql(SEED)}) AS g, count(*) OVER (PARTITION BY Label) AS size FROM fl)"

_GROUP_KEY = "coalesce(nullif(key, ''), nullif(dest_ip, ''), CAST(row_id AS VARCHAR))"

QUERIES = [
    Query(
        "h1_group_hash_split",
        _group_split,
        f"WITH {event_cte()}, k AS (SELECT row_id, dest_ip, concat_ws('|', nullif(lower(coalesce(app_proto, '')), ''), "
        "strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%dT%H:%M:%SZ'), nullif(trim(src_ip), '')) AS key FROM ev) "
        f"SELECT row_id, CASE WHEN {unit_sql(SEED, _GROUP_KEY)} < 0.8 THEN 'train' ELSE 'test' END AS split FROM k",
    ),
    Query(
        "h2_row_hash_split",
        _row_split,
        f"WITH {event_cte()} SELECT row_id, CASE WHEN {unit_sql(SEED, '''src_ip || ':' || CAST(row_id AS VARCHAR)''')} < 0.8 "
        "THEN 'train' ELSE 'test' END AS split FROM ev",
    ),
    Query(
        "h3_time_split",
        _time,
        f"WITH {event_cte()}, c AS (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.8) AS cut FROM ev WHERE ts IS NOT NULL) "
        "SELECT row_id, CASE WHEN epoch_us(ts) < cut THEN 'train' ELSE 'test' END AS split FROM ev, c",
    ),
    Query(
        "h3_time_hash_split",
        _time_hash,
        f"WITH {event_cte()} SELECT row_id, CASE WHEN {unit_sql(SEED, '''('time:' || CAST(row_id AS VARCHAR))''')} < 0.8 "
        "THEN 'train' ELSE 'test' END AS split FROM ev",
    ),
    Query("h4_stratified_split", _stratified, f"WITH {SPLIT_CTE} SELECT row_key, split FROM spl"),
    Query(
        "h5_undersample",
        _under,
        f"{_RANKED} SELECT row_key, Label FROM r WHERE n <= (SELECT min(size) FROM r)",
    ),
    Query("h6_uniform_sample", _uniform, f"{_RANKED} SELECT row_key FROM r WHERE g <= 1234"),
    Query("h7_quota_sample_balanced", _quota("balanced"), f"{_RANKED} SELECT row_key, Label FROM r WHERE n <= 1500"),
    Query("h7_quota_sample_natural", _quota("natural"), f"{_RANKED} SELECT row_key, Label FROM r WHERE g <= 3000"),
    Query(
        "h7_sample_report",
        _report,
        f"WITH {flow_cte()}, c AS (SELECT Label, count(*) AS seen FROM fl GROUP BY Label) SELECT Label, 15000 AS requested, seen, "
        "least(seen, 15000) AS kept, greatest(0, 15000 - seen) AS shortfall, seen >= 15000 AS quota_satisfied FROM c",
    ),
    Query("h8_balanced_sample", _balanced, f"{_RANKED} SELECT row_key, Label FROM r WHERE n <= 2500"),
    Query(
        "h9_natural_sample",
        lambda spark, sf_dir: S.uniform_sample(_keyed_flows(spark, sf_dir), 4000, key="row_key", seed=SEED + 1)
        .groupBy("Label")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")),
        f"WITH {flow_cte()}, r AS (SELECT *, row_number() OVER (ORDER BY {rank_sql(SEED + 1)}) AS g FROM fl) "
        "SELECT Label, count(*) AS rows, sum(l_quantity) AS quantity FROM r WHERE g <= 4000 GROUP BY Label",
    ),
    Query(
        "h10_dual_holdout",
        _dual,
        f"WITH {flow_cte()}, r AS (SELECT row_key, row_number() OVER (ORDER BY {rank_sql(SEED)}) <= 5000 AS in_natural, "
        f"row_number() OVER (PARTITION BY Label ORDER BY {rank_sql(SEED + 1000)}) <= 2000 AS in_balanced FROM fl) "
        "SELECT * FROM r WHERE in_natural OR in_balanced",
    ),
    Query(
        "h11_split_distribution",
        _distribution,
        f"WITH {SPLIT_CTE}, c AS (SELECT split, Label, count(*) AS n FROM spl GROUP BY ALL UNION ALL SELECT 'all', Label, count(*) "
        "FROM spl GROUP BY ALL) SELECT split, CASE Label WHEN 1 THEN 'attack' ELSE 'benign' END AS label, n AS count, "
        "round(n * 100.0 / sum(n) OVER (PARTITION BY split), 6) AS ratio_percent FROM c",
    ),
    Query(
        "h12_split_coverage",
        _coverage,
        f"WITH {SPLIT_CTE}, c AS (SELECT split, count(*) AS rows, count(DISTINCT Label) AS classes FROM spl GROUP BY split UNION ALL "
        "SELECT 'all', count(*), count(DISTINCT Label) FROM spl) SELECT split, rows, classes, classes = 2 AS coverage_ok, "
        "CASE WHEN classes < 2 THEN 'one_class' ELSE '' END AS warning FROM c",
    ),
    Query(
        "h13_class_summary",
        _summary,
        f"WITH {SPLIT_CTE}, c AS (SELECT split AS role, count(*) AS data_rows, count(*) FILTER (Label = 0) AS benign, "
        "count(*) FILTER (Label = 1) AS attack FROM spl GROUP BY split UNION ALL SELECT 'dataset_total', count(*), "
        "count(*) FILTER (Label = 0), count(*) FILTER (Label = 1) FROM spl) SELECT *, round(benign / data_rows, 9) AS benign_ratio, "
        "round(attack / data_rows, 9) AS attack_ratio FROM c",
    ),
]
