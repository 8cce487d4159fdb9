"""Registered queries over three overlapping record sources made from whole tables.

S1 are the customers, S2 the orders and S3 the events, each described with
the customer's balance, segment, number and region in spellings that differ
by order status, priority and event type. A true match is the customer's own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import similarity as sim
from kinmatch.functions.scoring import ranking_score, sigmoid
from kinmatch.functions.text import SCRIPTS, id_list, scripts
from kinmatch.operators import blocking, blockwise, diagnostics, features, metrics, model, profile, ranking, records, truth, validate
from kinmatch.shipping import ship

S1, TARGET = "source1_entity_id", "target_entity_id"

#: A linear model for the scoring queries.
PARTS = {
    "mean": {f: 0.5 for f in features.FEATURES},
    "scale": {f: 0.25 for f in features.FEATURES},
    "coefficient": {f: round(0.4 + 0.05 * i, 2) for i, f in enumerate(features.FEATURES)},
    "intercept": -2.0,
}
K = 10


# --- sources ------------------------------------------------------------------


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw S1, S2, S3 records."""
    place = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = _table(spark, d, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    cents, whole = F.round(F.col("c_acctbal") * 100).cast("long").cast("string"), F.floor("c_acctbal").cast("string")
    people = people.select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name", cents.alias("acct"), whole.alias("bal"))
    number, segment, label, bal = F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.col("c_name"), F.col("bal")
    s1 = people.select(
        F.concat(F.lit("S1-"), number).alias("entity_id"),
        F.concat(bal, F.lit(" "), segment, F.lit(" "), number, F.lit(" & Co.")).alias("business_name"),
        F.concat("acct", F.lit(" "), label, F.lit(", "), "n_name").alias("business_address"),
        F.col("r_name").alias("country"),
    )
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    met = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    s2 = met.select(
        F.concat(F.lit("S2-"), F.col("o_orderkey").cast("string")).alias("entity_id"),
        F.when(status == "F", F.concat(bal, F.lit(" "), F.lower(segment), F.lit(" "), number, F.lit(" co"))).when(status == "O", F.concat(bal, F.lit("  "), segment, F.lit(", "), number, F.lit(" Co"))).otherwise(F.concat(segment, F.lit(" "), bal, F.lit(" "), number)).alias("business_name"),
        F.when(priority == "1-URGENT", F.concat("acct", F.lit(" "), label, F.lit(" "), "n_name")).when(priority == "2-HIGH", F.lit("")).when(priority == "3-MEDIUM", F.concat("acct", F.lit("-"), label)).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "n_name")).alias("business_address"),
        F.concat(F.lit(" "), F.lower("r_name")).alias("country"),
    )
    events = _table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    seen = events.join(people, F.col("user_id") == F.col("c_custkey"), "left")
    user, kind = F.coalesce(bal, F.col("user_id").cast("string")), F.col("event_type")
    s3 = seen.select(
        F.concat(F.lit("S3-"), F.col("event_id").cast("string")).alias("entity_id"),
        F.when(kind.isin("click", "purchase"), F.concat(user, F.lit(" "), F.coalesce(segment, F.lit("")))).otherwise(F.concat(user, F.lit(" "), kind)).alias("business_name"),
        F.when(kind == "view", F.concat(F.coalesce("acct", F.lit("0")), F.lit(" "), F.coalesce(label, F.lit("")))).otherwise(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), "props")).alias("business_address"),
        F.coalesce("r_name", F.lit("")).alias("country"),
    )
    return s1, s2, s3


PEOPLE_SQL = """people AS (SELECT c_custkey, c_name, c_mktsegment, n_name, r_name, CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS acct, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SOURCES_SQL = f"""{PEOPLE_SQL},
r1 AS (SELECT 'S1-' || c_custkey AS entity_id, bal || ' ' || c_mktsegment || ' ' || c_custkey || ' & Co.' AS business_name,
  acct || ' ' || c_name || ', ' || n_name AS business_address, r_name AS country FROM people),
r2 AS (SELECT 'S2-' || o_orderkey AS entity_id,
  CASE o_orderstatus WHEN 'F' THEN bal || ' ' || lower(c_mktsegment) || ' ' || c_custkey || ' co' WHEN 'O' THEN bal || '  ' || c_mktsegment || ', ' || c_custkey || ' Co'
    ELSE c_mktsegment || ' ' || bal || ' ' || c_custkey END AS business_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN acct || ' ' || c_name || ' ' || n_name WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN acct || '-' || c_name
    ELSE o_orderkey || ' ' || n_name END AS business_address, ' ' || lower(r_name) AS country
  FROM orders JOIN people ON o_custkey = c_custkey),
r3 AS (SELECT 'S3-' || event_id AS entity_id,
  CASE WHEN event_type IN ('click', 'purchase') THEN coalesce(bal, user_id::VARCHAR) || ' ' || coalesce(c_mktsegment, '') ELSE coalesce(bal, user_id::VARCHAR) || ' ' || event_type END AS business_name,
  CASE WHEN event_type = 'view' THEN coalesce(acct, '0') || ' ' || coalesce(c_name, '') ELSE coalesce(c_name, '') || ' ' || props END AS business_address,
  coalesce(r_name, '') AS country FROM events LEFT JOIN people ON user_id = c_custkey)"""


def _norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _keyed_sql(name: str, source: str) -> str:
    def key(c: str, n: int) -> str:
        part = c if n == 0 else f"substr({c}, 1, {n})"
        return f"CASE WHEN {c} <> '' THEN country_norm || '|' || {part} ELSE '' END"

    def block(c: str, n: int) -> str:
        return f"CASE WHEN {c} <> '' THEN country_norm || '|' || substr(regexp_replace({c}, '[^a-z0-9]', '', 'g'), 1, {n}) ELSE '' END"

    return f"""{name}n AS (SELECT *, {_norm_sql("business_name")} AS name_norm, {_norm_sql("business_address")} AS address_norm,
  lower(trim(coalesce(country, ''))) AS country_norm FROM {source}),
{name} AS (SELECT *, {key("name_norm", 0)} AS name_exact_key, {key("address_norm", 0)} AS address_exact_key, {key("name_norm", 4)} AS name4, {key("name_norm", 6)} AS name6,
  {key("address_norm", 8)} AS address8, {key("address_norm", 10)} AS address10, {block("name_norm", 4)} AS name_block, {block("address_norm", 8)} AS address_block FROM {name}n)"""


RECORDS_SQL = f"{SOURCES_SQL},\n{_keyed_sql('a', 'r1')},\nrt AS (SELECT * FROM r2 UNION ALL SELECT * FROM r3),\n{_keyed_sql('t', 'rt')}"


def keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Normalized and keyed S1, and S2 with S3."""
    s1, s2, s3 = sources(spark, d)
    make = lambda r: records.with_training_keys(records.with_keys(records.normalized(r)))
    return make(s1), make(s2.unionByName(s3))


def true_pairs(spark: SparkSession, d: str) -> DataFrame:
    orders, events = _table(spark, d, "orders"), _table(spark, d, "events")
    people = _table(spark, d, "customer").select("c_custkey")
    pair = lambda own, tag, key, s: (F.concat(F.lit("S1-"), F.col(own).cast("string")).alias(S1), F.concat(F.lit(tag), F.col(key).cast("string")).alias(TARGET), F.lit(s).alias("target_source"))
    two = orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(*pair("o_custkey", "S2-", "o_orderkey", "S2"))
    three = events.join(people, F.col("user_id") == F.col("c_custkey"), "left_semi").select(*pair("user_id", "S3-", "event_id", "S3"))
    return two.unionByName(three)


TRUE_SQL = """tp AS (SELECT 'S1-' || o_custkey AS source1_entity_id, 'S2-' || o_orderkey AS target_entity_id, 'S2' AS target_source FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'S1-' || user_id, 'S3-' || event_id, 'S3' FROM events WHERE user_id IN (SELECT c_custkey FROM customer))"""


def truth_lists(spark: SparkSession, d: str) -> DataFrame:
    people = _table(spark, d, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return ranking.id_lists(people, true_pairs(spark, d).withColumn("p", F.lit(1.0)), "p", "matched_entity_ids")


LISTS_SQL = f"""{TRUE_SQL}, tl AS (SELECT 'S1-' || c_custkey AS source1_entity_id, coalesce(m, '') AS matched_entity_ids FROM customer
  LEFT JOIN (SELECT source1_entity_id AS s, string_agg(target_entity_id, ',' ORDER BY target_entity_id) AS m FROM tp GROUP BY 1) ON s = 'S1-' || c_custkey)"""


# --- pieces shared by queries ---------------------------------------------------


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """True pairs with both records' texts: the fixture of the pairwise measures."""
    a, t = keyed(spark, d)
    return features.attach(true_pairs(spark, d), a, t)


PAIRS_SQL = f"""{RECORDS_SQL}, {TRUE_SQL}, p AS (SELECT tp.*, a.name_norm AS s_name_norm, a.address_norm AS s_address_norm, a.country_norm AS s_country_norm,
  t.name_norm AS t_name_norm, t.address_norm AS t_address_norm, t.country_norm AS t_country_norm
  FROM tp JOIN a ON a.entity_id = source1_entity_id JOIN t ON t.entity_id = target_entity_id)"""


def _tok(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"


def _num(c: str) -> str:
    return f"list_distinct(regexp_extract_all({c}, '[0-9]+'))"


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _min(a: str, b: str, both: float) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {both} WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


def _len(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) END"


def _exact(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {a} = {b} THEN 1 ELSE 0 END"


def _lcs(a: str, b: str) -> str:
    """Bit-parallel longest common subsequence for texts of at most 60 characters."""
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i::BIGINT, 1) = ch THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0::BIGINT END))::BIGINT"
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    row = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    lcs = f"(length({a}) - bit_count({row}))"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * {lcs} / (length({a}) + length({b})) END"


def _jw(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({a}, {b}) END"


_SN, _TN, _SA, _TA = "s_name_norm", "t_name_norm", "s_address_norm", "t_address_norm"


def _features_sql() -> dict[str, str]:
    out = {}
    for field, s, t in (("name", _SN, _TN), ("address", _SA, _TA)):
        a, b = _tok(s), _tok(t)
        out |= {f"{field}_similarity": _lcs(s, t), f"{field}_jaccard": _jac(a, b), f"{field}_token_overlap": _min(a, b, 0.0), f"{field}_containment": _min(a, b, 1.0), f"{field}_exact": _exact(s, t), f"{field}_length_ratio": _len(s, t)}
    out |= {"numeric_overlap": _jac(_num(_SA), _num(_TA)), "country_same": _exact("s_country_norm", "t_country_norm")}
    return out | {f"{f}_missing_{w}": f"CASE WHEN {c} = '' THEN 1 ELSE 0 END" for f, w, c in (("name", "s1", _SN), ("name", "target", _TN), ("address", "s1", _SA), ("address", "target", _TA))}


FEATURES_SQL = _features_sql()
FAST_SQL = {**{f: FEATURES_SQL[f] for f in features.FAST}, "name_similarity": _jw(_SN, _TN), "address_similarity": _jw(_SA, _TA)}


def _logit_sql(columns: dict[str, str]) -> str:
    terms = [f"{PARTS['coefficient'][f]!r}::DOUBLE * ((({c})::DOUBLE - {PARTS['mean'][f]!r}::DOUBLE) / {PARTS['scale'][f]!r}::DOUBLE)" for f, c in columns.items()]
    return " + ".join([f"({PARTS['intercept']!r})::DOUBLE", *terms])


def _probability_sql(columns: dict[str, str]) -> str:
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({_logit_sql(columns)}))), 6)"


def _route_sql(r: blocking.Route) -> str:
    on = " AND ".join(f"a.{k} <> '' AND a.{k} = t.{k}" for k in r.on)
    guard = f"JOIN (SELECT {r.guard} AS g, count(*) AS n FROM a WHERE {r.guard} <> '' GROUP BY 1) ca ON ca.g = a.{r.guard} JOIN (SELECT {r.guard} AS g, count(*) AS n FROM t WHERE {r.guard} <> '' GROUP BY 1) ct ON ct.g = t.{r.guard} WHERE ca.n * ct.n <= {r.limit}" if r.guard else ""
    return f"SELECT a.entity_id AS source1_entity_id, t.entity_id AS target_entity_id FROM a JOIN t ON {on} {guard}"


CANDIDATES_SQL = f"{RECORDS_SQL}, cand AS (" + " UNION ".join(_route_sql(r) for r in blocking.ROUTES) + ")"


def _attach_sql(source: str) -> str:
    return f"""SELECT {source}.*, a.name_norm AS s_name_norm, a.address_norm AS s_address_norm, a.country_norm AS s_country_norm, t.name_norm AS t_name_norm,
  t.address_norm AS t_address_norm, t.country_norm AS t_country_norm FROM {source} JOIN a ON a.entity_id = source1_entity_id JOIN t ON t.entity_id = target_entity_id"""


APPROX_SQL = f"{CANDIDATES_SQL}, q AS (SELECT source1_entity_id, target_entity_id, substr(target_entity_id, 1, 2) AS target_source, {_probability_sql(FAST_SQL)} AS approx_probability FROM ({_attach_sql('cand')}))"
TRAIN_SQL = f"""{RECORDS_SQL}, {TRUE_SQL}, cand AS (SELECT a.entity_id AS source1_entity_id, t.entity_id AS target_entity_id FROM a JOIN t ON a.name_block <> '' AND a.name_block = t.name_block
  UNION SELECT a.entity_id, t.entity_id FROM a JOIN t ON a.address_block <> '' AND a.address_block = t.address_block),
m AS (SELECT source1_entity_id, target_entity_id, substr(target_entity_id, 1, 2) AS target_source, round({FEATURES_SQL["name_similarity"]}, 6) AS name_similarity,
  round({FEATURES_SQL["address_similarity"]}, 6) AS address_similarity, round({FEATURES_SQL["numeric_overlap"]}, 6) AS numeric_overlap FROM ({_attach_sql("cand")})),
sc AS (SELECT *, round(0.6 * name_similarity + 0.3 * address_similarity + 0.1 * numeric_overlap, 7) AS ranking_score FROM m)"""


def _approx(spark: SparkSession, d: str) -> DataFrame:
    a, t = keyed(spark, d)
    met = features.attach(blocking.candidates(a, t), a, t)
    p = F.round(model.linear_probability(PARTS, features.fast_features()), 6)
    return met.select(S1, TARGET, F.substring(TARGET, 1, 2).alias("target_source"), p.alias("approx_probability"))


def _blocked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame] | None:
    """S1 and S2 with S3 for the operators that work block by block; None where keys repeat."""
    keys = {"c_custkey": "customer", "o_orderkey": "orders", "event_id": "events", "n_nationkey": "nation", "r_regionkey": "region"}
    if blockwise.repeated({k: _table(spark, d, name) for k, name in keys.items()}):
        return None
    s1, s2, s3 = sources(spark, d)
    return blockwise.records(s1), blockwise.records(s2.unionByName(s3))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    a, t = keyed(spark, d)
    met = features.attach(blocking.name_or_address(a, t), a, t)
    measured = met.select(S1, TARGET, F.substring(TARGET, 1, 2).alias("target_source"), F.round(sim.lcs_ratio(_SN, _TN), 6).alias("name_similarity"), F.round(sim.lcs_ratio(_SA, _TA), 6).alias("address_similarity"), F.round(features.numeric_overlap(), 6).alias("numeric_overlap"))
    return measured.withColumn("ranking_score", F.round(ranking_score(), 7))


_ORDER_SQL = "ranking_score DESC, name_similarity DESC, address_similarity DESC, numeric_overlap DESC, target_entity_id"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs with labels from whole tables: lineitems, returned or not, by price, discount and quantity."""
    item = _table(spark, d, "lineitem")
    z = F.col("l_discount") * 10 + F.col("l_tax") * 5 - F.col("l_quantity") / 40
    p = F.round(sigmoid(z), 4)
    return item.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pair_id"), p.alias("probability"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


SCORED_SQL = "s AS (SELECT l_orderkey || '-' || l_linenumber AS pair_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(l_discount * 10 + l_tax * 5 - l_quantity / 40))), 4) AS probability, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"
_DIV = "CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END"


def _div(a: str, b: str) -> str:
    return _DIV.format(a=a, b=b)


def _fb(p: str, r: str, beta: float) -> str:
    b = beta * beta
    return f"CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE {1 + b} * {p} * {r} / ({b} * {p} + {r}) END"


_CELLS = "sum((probability >= th AND y = 1)::INT) AS tp, sum((probability >= th AND y = 0)::INT) AS fp, sum((probability < th AND y = 1)::INT) AS fn, sum((probability < th AND y = 0)::INT) AS tn"
SWEEP_SQL = f"""{SCORED_SQL}, g AS (SELECT unnest({list(metrics.THRESHOLDS)!r})::DOUBLE AS th), c AS (SELECT th AS threshold, {_CELLS} FROM s, g GROUP BY th),
e AS (SELECT *, {_div("tp", "(tp + fp)")} AS precision, {_div("tp", "(tp + fn)")} AS recall FROM c),
sweep AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_fb("precision", "recall", 1.0)}, 6) AS f1,
  round({_fb("precision", "recall", 0.5)}, 6) AS f05, round({_div("(tp + tn)", "(tp + fp + fn + tn)")}, 6) AS accuracy, round({_div("fp", "(fp + tn)")}, 6) AS false_positive_rate,
  (tp + fp)::BIGINT AS predicted_positive, round({_div("(tp + fp)", "tp")}, 6) AS candidates_per_true_match FROM e)"""

_MEASURES = ("name_similarity", "name_jaccard", "address_similarity", "address_jaccard", "numeric_overlap")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    made = features.exact_features()
    return _pairs(spark, d).select(S1, TARGET, "target_source", *(F.round(made[m].cast("double"), 6).alias(m) for m in _MEASURES))


MEASURED_SQL = f"{PAIRS_SQL}, ms AS (SELECT source1_entity_id, target_entity_id, target_source, " + ", ".join(f"round(({FEATURES_SQL[m]})::DOUBLE, 6) AS {m}" for m in _MEASURES) + " FROM p)"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """What exact names with an equal address prefix predict."""
    a, t = keyed(spark, d)
    return blocking.route(a, t, blocking.BY_NAME["name_addr8"])


PREDICTIONS_SQL = f"{RECORDS_SQL}, {LISTS_SQL}, pr AS ({_route_sql(blocking.BY_NAME['name_addr8'])})"
F05_SQL = f"""{PREDICTIONS_SQL}, pn AS (SELECT source1_entity_id, count(DISTINCT target_entity_id) AS said FROM pr GROUP BY 1),
wn AS (SELECT source1_entity_id, count(DISTINCT target_entity_id) AS true_n FROM tp GROUP BY 1), hn AS (SELECT source1_entity_id, count(*) AS hit FROM (SELECT DISTINCT source1_entity_id, target_entity_id FROM pr) JOIN tp USING (source1_entity_id, target_entity_id) GROUP BY 1),
z AS (SELECT tl.source1_entity_id, coalesce(said, 0) AS said, coalesce(true_n, 0) AS true_n, coalesce(hit, 0) AS hit FROM tl LEFT JOIN pn USING (source1_entity_id) LEFT JOIN wn USING (source1_entity_id) LEFT JOIN hn USING (source1_entity_id)),
y AS (SELECT *, {_div("hit", "said")} AS pre, {_div("hit", "true_n")} AS rec FROM z),
f AS (SELECT source1_entity_id, CASE WHEN true_n = 0 THEN CASE WHEN said = 0 THEN 1.0 ELSE 0.0 END ELSE {_fb("pre", "rec", 0.5)} END::DOUBLE AS f05 FROM y)"""


def _lists(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(S1).agg(F.collect_set(TARGET).alias("ids"))


# --- the catalogue ----------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def take(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return take


def _measure(name: str, columns: dict[str, Callable], sql: dict[str, str]) -> None:
    """A pairwise measure over the true pairs."""
    _add(name, f"WITH {PAIRS_SQL} SELECT source1_entity_id, target_entity_id, " + ", ".join(f"round(({s})::DOUBLE, 6) AS {c}" for c, s in sql.items()) + " FROM p")(
        lambda spark, d: _pairs(spark, d).select(S1, TARGET, *(F.round(f().cast("double"), 6).alias(c) for c, f in columns.items()))
    )


@_add("q_flagship", f"WITH {APPROX_SQL} SELECT source1_entity_id, target_entity_id, approx_probability, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY approx_probability DESC, target_entity_id) AS r FROM q) WHERE r <= 3")
def q_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Normalize, block, score, and keep the best three candidates of each record."""
    return ranking.top_k(_approx(spark, d), 3, [F.desc("approx_probability")]).select(S1, TARGET, "approx_probability", "rank")


@_add("q_norm_ascii", f"WITH {RECORDS_SQL} SELECT entity_id, name_norm, address_norm, country_norm FROM a UNION ALL SELECT entity_id, name_norm, address_norm, country_norm FROM t")
def q_norm_ascii(spark, d):
    s1, s2, s3 = sources(spark, d)
    return records.normalized(s1.unionByName(s2).unionByName(s3)).select("entity_id", "name_norm", "address_norm", "country_norm")


@_add("q_norm_documents", f"SELECT doc_id, {_norm_sql('text')} AS norm FROM documents")
def q_norm_documents(spark, d):
    from kinmatch.functions.text import normalize

    return _table(spark, d, "documents").select("doc_id", normalize("text").alias("norm"))


#: On texts of composed Latin letters compatibility normalization changes nothing, and of their case folding lower() lacks the sharp s only.
_UNICODE_SQL = r"trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '&', ' and '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@_add("q_norm_unicode", f"SELECT doc_id, {_UNICODE_SQL} AS norm FROM documents")
def q_norm_unicode(spark, d):
    from kinmatch.functions.text import normalize

    return _table(spark, d, "documents").select("doc_id", normalize("text", "unicode").alias("norm"))


@_add("q_block_keys", f"WITH {RECORDS_SQL} SELECT entity_id, name_exact_key, address_exact_key, name4, name6, address8, address10, name_block, address_block FROM (SELECT * FROM a UNION ALL SELECT * FROM t)")
def q_block_keys(spark, d):
    a, t = keyed(spark, d)
    return a.unionByName(t).select("entity_id", "name_exact_key", "address_exact_key", "name4", "name6", "address8", "address10", "name_block", "address_block")


@_add("q_numeric_tokens", f"WITH {RECORDS_SQL} SELECT entity_id, array_to_string(list_sort({_num('address_norm')}), ',') AS numbers FROM (SELECT * FROM a UNION ALL SELECT * FROM t)")
def q_numeric_tokens(spark, d):
    a, t = keyed(spark, d)
    return a.unionByName(t).select("entity_id", F.array_join(F.array_sort("numeric_tokens"), ",").alias("numbers"))


_A, _B = lambda c: sim.tokens(f"s_{c}_norm"), lambda c: sim.tokens(f"t_{c}_norm")
_measure("q_token_jaccard", {"name": lambda: sim.jaccard(_A("name"), _B("name")), "address": lambda: sim.jaccard(_A("address"), _B("address"))}, {"name": _jac(_tok(_SN), _tok(_TN)), "address": _jac(_tok(_SA), _tok(_TA))})
_measure("q_token_overlap", {"name": lambda: sim.token_overlap(_A("name"), _B("name")), "address": lambda: sim.token_overlap(_A("address"), _B("address"))}, {"name": _min(_tok(_SN), _tok(_TN), 0.0), "address": _min(_tok(_SA), _tok(_TA), 0.0)})
_measure("q_containment", {"name": lambda: sim.containment(_A("name"), _B("name")), "address": lambda: sim.containment(_A("address"), _B("address"))}, {"name": _min(_tok(_SN), _tok(_TN), 1.0), "address": _min(_tok(_SA), _tok(_TA), 1.0)})
_measure("q_numeric_overlap", {"overlap": features.numeric_overlap}, {"overlap": _jac(_num(_SA), _num(_TA))})
_measure("q_length_ratio", {"name": lambda: sim.length_ratio(_SN, _TN), "address": lambda: sim.length_ratio(_SA, _TA)}, {"name": _len(_SN, _TN), "address": _len(_SA, _TA)})
_measure(
    "q_exact_flags",
    {"present": lambda: sim.exact_present(_SA, _TA), "normalized": lambda: sim.exact_normalized(_SA, _TA), "raw": lambda: sim.exact_raw(_SN, _TN), "country": features.same_country},
    {"present": _exact(_SA, _TA), "normalized": f"({_SA} = {_TA})::INT", "raw": f"(trim({_SN}) = trim({_TN}))::INT", "country": _exact("s_country_norm", "t_country_norm")},
)
_measure("q_lcs_ratio", {"name": lambda: sim.lcs_ratio(_SN, _TN), "address": lambda: sim.lcs_ratio(_SA, _TA)}, {"name": _lcs(_SN, _TN), "address": _lcs(_SA, _TA)})
_measure("q_jaro_winkler", {"name": lambda: sim.jaro_winkler(_SN, _TN), "address": lambda: sim.jaro_winkler(_SA, _TA)}, {"name": _jw(_SN, _TN), "address": _jw(_SA, _TA)})


@_add("q_block_counts", " UNION ALL ".join(f"(WITH {RECORDS_SQL} SELECT '{k}' AS key, {k} AS block, count(*) AS n FROM t WHERE {k} <> '' GROUP BY 2)" for k in ("name4", "name6", "address8", "address10")))
def q_block_counts(spark, d):
    _, t = keyed(spark, d)
    keys = ("name4", "name6", "address8", "address10")
    long = t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("block")) for k in keys))).alias("x")).select("x.*")
    return long.filter("block <> ''").groupBy("key", "block").agg(F.count("*").alias("n"))


@_add("q_block_guard", f"WITH {RECORDS_SQL}, x AS (SELECT name4 AS block, count(*) AS n1 FROM a WHERE name4 <> '' GROUP BY 1), y AS (SELECT name4 AS block, count(*) AS n2 FROM t WHERE name4 <> '' GROUP BY 1) SELECT block, n1, n2 FROM x JOIN y USING (block) WHERE n1 * n2 <= {blocking.MAX_SHORT}")
def q_block_guard(spark, d):
    return blocking.open_blocks(*keyed(spark, d), "name4", blocking.MAX_SHORT)


for _r in blocking.ROUTES:
    _name = {"exact_name": "q_route_exact_name", "exact_address": "q_route_exact_address"}.get(_r.name, f"q_route_{_r.name}")
    _add(_name, f"WITH {RECORDS_SQL} {_route_sql(_r)}")(lambda spark, d, r=_r: blocking.route(*keyed(spark, d), r))


@_add("q_candidates_union", f"WITH {CANDIDATES_SQL} SELECT * FROM cand")
def q_candidates_union(spark, d):
    return blocking.candidates(*keyed(spark, d))


@_add("q_candidate_routes", f"WITH {RECORDS_SQL}, u AS (" + " UNION ALL ".join(f"SELECT *, '{r.name}' AS route FROM ({_route_sql(r)})" for r in blocking.ROUTES) + ") SELECT source1_entity_id, target_entity_id, string_agg(route, ',' ORDER BY route) AS routes FROM u GROUP BY 1, 2")
def q_candidate_routes(spark, d):
    return blocking.candidates(*keyed(spark, d), with_routes=True).withColumn("routes", F.array_join("routes", ","))


@_add("q_name_or_address_block", f"WITH {RECORDS_SQL} SELECT a.entity_id AS source1_entity_id, t.entity_id AS target_entity_id FROM a JOIN t ON a.name_block <> '' AND a.name_block = t.name_block UNION SELECT a.entity_id, t.entity_id FROM a JOIN t ON a.address_block <> '' AND a.address_block = t.address_block")
def q_name_or_address_block(spark, d):
    return blocking.name_or_address(*keyed(spark, d))


@_add("q_approx_probability", f"WITH {APPROX_SQL} SELECT * FROM q")
def q_approx_probability(spark, d):
    return _approx(spark, d)


@_add("q_topk_per_source", f"WITH {APPROX_SQL} SELECT *, row_number() OVER (PARTITION BY source1_entity_id, target_source ORDER BY approx_probability DESC, target_entity_id) AS rank FROM q QUALIFY rank <= {K}")
def q_topk_per_source(spark, d):
    return ranking.top_k(_approx(spark, d), K, [F.desc("approx_probability")], (S1, "target_source"))


@_add("q_topk_combined", f"WITH {APPROX_SQL} SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY approx_probability DESC, target_entity_id) AS rank FROM q QUALIFY rank <= {K}")
def q_topk_combined(spark, d):
    return ranking.top_k(_approx(spark, d), K, [F.desc("approx_probability")])


@_add("q_weighted_rank_topk", f"WITH {TRAIN_SQL} SELECT *, row_number() OVER (PARTITION BY source1_entity_id, target_source ORDER BY {_ORDER_SQL}) AS rank FROM sc QUALIFY rank <= 50")
def q_weighted_rank_topk(spark, d):
    if (sides := _blocked(spark, d)) is None:
        return ranking.top_k(_weighted(spark, d), 50, ranking.by_rank_score(), (S1, "target_source"))
    return blockwise.best_pairs(*sides, 50)


@_add(
    "q_recall_at_k",
    f"""WITH {TRAIN_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY {_ORDER_SQL}) AS rank FROM sc QUALIFY rank <= 50),
ks AS (SELECT unnest({list(ranking.TOP_K)!r})::INT AS top_k), has AS (SELECT DISTINCT source1_entity_id FROM rk), tot AS (SELECT count(*) AS true_pairs FROM tp WHERE source1_entity_id IN (SELECT source1_entity_id FROM has)),
h AS (SELECT top_k, sum((tp.target_entity_id IS NOT NULL)::INT)::BIGINT AS recovered_true_pairs, count(*) AS candidate_pairs FROM ks JOIN rk ON rank <= top_k LEFT JOIN tp ON tp.source1_entity_id = rk.source1_entity_id AND tp.target_entity_id = rk.target_entity_id GROUP BY 1)
SELECT top_k, true_pairs, recovered_true_pairs, round({_div("recovered_true_pairs", "true_pairs")}, 6) AS recall, candidate_pairs, round(candidate_pairs::DOUBLE / (SELECT count(*) FROM has), 6) AS average_candidates_per_s1 FROM h, tot""",
)
def q_recall_at_k(spark, d):
    true = true_pairs(spark, d).select(S1, TARGET)
    if (sides := _blocked(spark, d)) is None:
        return rounded(ranking.recall_at_k(ranking.top_k(_weighted(spark, d), 50, ranking.by_rank_score()), true))
    return rounded(ranking.recall_by_rank(blockwise.best_pairs(*sides, 50, true, each_source=False, output="recall")))


@_add("q_hard_negatives", f"WITH {TRAIN_SQL} SELECT sc.*, row_number() OVER (PARTITION BY sc.source1_entity_id, sc.target_source ORDER BY {_ORDER_SQL.replace('target_entity_id', 'sc.target_entity_id')}) AS rank FROM sc ANTI JOIN tp ON tp.source1_entity_id = sc.source1_entity_id AND tp.target_entity_id = sc.target_entity_id WHERE name_similarity >= 0.45 QUALIFY rank <= 5")
def q_hard_negatives(spark, d):
    true = true_pairs(spark, d).select(S1, TARGET)
    if (sides := _blocked(spark, d)) is None:
        return ranking.hard_negatives(_weighted(spark, d), true)
    return blockwise.best_pairs(*sides, 5, true, least_name=0.45, without_true=True)


@_add("q_training_pairs", f"WITH {TRAIN_SQL}, b AS (SELECT source1_entity_id, target_entity_id, target_source, 0 AS y FROM sc QUALIFY row_number() OVER (PARTITION BY source1_entity_id, target_source ORDER BY {_ORDER_SQL}) <= 50 UNION ALL SELECT source1_entity_id, target_entity_id, target_source, 1 FROM tp) SELECT source1_entity_id, target_entity_id, target_source, max(y) AS y FROM b GROUP BY 1, 2, 3")
def q_training_pairs(spark, d):
    if (sides := _blocked(spark, d)) is None:
        return ranking.training_pairs(ranking.top_k(_weighted(spark, d), 50, ranking.by_rank_score(), (S1, "target_source")), true_pairs(spark, d))
    return blockwise.best_pairs(*sides, 50, true_pairs(spark, d), output="labels")


@_add("q_features18", f"WITH {PAIRS_SQL} SELECT source1_entity_id, target_entity_id, target_source, " + ", ".join(f"round(({s})::DOUBLE, 6) AS {f}" for f, s in FEATURES_SQL.items()) + " FROM p")
def q_features18(spark, d):
    a, t = keyed(spark, d)
    table = features.feature_table(true_pairs(spark, d), a, t)
    return rounded(table.select(S1, TARGET, "target_source", *(F.col(f).cast("double").alias(f) for f in features.FEATURES)))


@_add("q_linear_score", f"WITH {PAIRS_SQL} SELECT source1_entity_id, target_entity_id, round({_logit_sql(FEATURES_SQL)}, 6) AS logit, {_probability_sql(FEATURES_SQL)} AS probability FROM p")
def q_linear_score(spark, d):
    from kinmatch.functions.scoring import logit

    made = features.exact_features()
    z = logit(made, PARTS["mean"], PARTS["scale"], PARTS["coefficient"], PARTS["intercept"])
    return _pairs(spark, d).select(S1, TARGET, z.alias("z")).select(S1, TARGET, F.round("z", 6).alias("logit"), F.round(sigmoid(F.col("z")), 6).alias("probability"))


@_add("q_threshold_sweep", f"WITH {SWEEP_SQL} SELECT * FROM sweep")
def q_threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(_scored(spark, d)))


@_add("q_best_f1", f"WITH {SWEEP_SQL} SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1")
def q_best_f1(spark, d):
    return metrics.best_f1(rounded(metrics.threshold_sweep(_scored(spark, d))))


@_add("q_recall_thresholds", f"WITH {SWEEP_SQL} SELECT threshold, precision, recall FROM sweep WHERE recall >= 0.9")
def q_recall_thresholds(spark, d):
    return rounded(metrics.threshold_sweep(_scored(spark, d))).filter("recall >= 0.9").select("threshold", "precision", "recall")


@_add("q_roc_auc", f"WITH {SCORED_SQL}, l AS (SELECT probability, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), w AS (SELECT *, sum(neg) OVER (ORDER BY probability) AS cn FROM l) SELECT round((sum(pos * (cn - neg + neg / 2.0)) / sum(pos) / sum(neg))::DOUBLE, 6) AS roc_auc FROM w")
def q_roc_auc(spark, d):
    return rounded(metrics.roc_auc(_scored(spark, d)))


@_add("q_average_precision", f"WITH {SCORED_SQL}, l AS (SELECT probability, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), w AS (SELECT *, sum(pos) OVER (ORDER BY probability DESC) AS cp, sum(pos + neg) OVER (ORDER BY probability DESC) AS ca FROM l) SELECT round((sum(pos * cp::DOUBLE / ca) / sum(pos))::DOUBLE, 6) AS average_precision FROM w")
def q_average_precision(spark, d):
    return rounded(metrics.average_precision(_scored(spark, d)))


@_add("q_confusion", f"WITH {SCORED_SQL}, c AS (SELECT {_CELLS.replace('th ', '0.5 ')} FROM s), e AS (SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {_div('tp', '(tp + fp)')} AS p, {_div('tp', '(tp + fn)')} AS r FROM c) SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round({_div('(tp + tn)', '(tp + fp + fn + tn)')}, 6) AS accuracy, round({_fb('p', 'r', 1.0)}, 6) AS f1 FROM e")
def q_confusion(spark, d):
    return rounded(metrics.confusion(_scored(spark, d), 0.5))


_REPORT_SQL = f"{SCORED_SQL}, k AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, sum(((probability >= 0.5)::INT = label AND y = label)::INT) AS hit, sum(((probability >= 0.5)::INT = label)::INT) AS said, sum((y = label)::INT) AS sup FROM s, k GROUP BY 1), e AS (SELECT *, {_div('hit', 'said')} AS p, {_div('hit', 'sup')} AS r FROM c), rep AS (SELECT label, p AS precision, r AS recall, {_fb('p', 'r', 1.0)} AS f1, sup::BIGINT AS support FROM e)"


@_add("q_classification_report", f"WITH {_REPORT_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def q_classification_report(spark, d):
    return rounded(metrics.classification_report(_scored(spark, d), 0.5))


@_add("q_report_averages", " UNION ALL ".join(f"(WITH {_REPORT_SQL} SELECT '{label}' AS average, " + ", ".join(f"round({f}, 6) AS {c}" for c, f in cells.items()) + ", sum(support)::BIGINT AS support FROM rep)" for label, cells in (("macro", {c: f"avg({c})" for c in ("precision", "recall", "f1")}), ("weighted", {c: f"sum({c} * support) / sum(support)" for c in ("precision", "recall", "f1")}))))
def q_report_averages(spark, d):
    return rounded(metrics.report_averages(metrics.classification_report(_scored(spark, d), 0.5)))


@_add("q_probability_range", f"WITH {SCORED_SQL} SELECT min(probability) AS lowest, max(probability) AS highest, round(avg(probability), 6) AS mean, y FROM s GROUP BY y")
def q_probability_range(spark, d):
    return rounded(_scored(spark, d).groupBy("y").agg(F.min("probability").alias("lowest"), F.max("probability").alias("highest"), F.avg("probability").alias("mean")))


@_add("q_explode_truth", f"WITH {LISTS_SQL} SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS target_entity_id, substr(target_entity_id, 1, 2) AS target_source FROM tl WHERE matched_entity_ids <> ''")
def q_explode_truth(spark, d):
    return truth.explode_truth(truth_lists(spark, d))


@_add("q_source_resolution", f"WITH {SOURCES_SQL}, {TRUE_SQL} SELECT tp.source1_entity_id, tp.target_entity_id, h.s AS target_source FROM tp JOIN (SELECT entity_id, min(s) AS s FROM (SELECT entity_id, 'S2' AS s FROM r2 UNION ALL SELECT entity_id, 'S3' FROM r3) GROUP BY 1) h ON h.entity_id = tp.target_entity_id")
def q_source_resolution(spark, d):
    _, s2, s3 = sources(spark, d)
    return truth.resolve_source(true_pairs(spark, d).select(S1, TARGET), s2, s3).select(S1, TARGET, "target_source")


_COUNTS_SQL = f"{LISTS_SQL}, ct AS (SELECT tl.source1_entity_id, count(target_entity_id) AS n_matches, coalesce(sum((target_source = 'S2')::INT), 0)::BIGINT AS n_s2, coalesce(sum((target_source = 'S3')::INT), 0)::BIGINT AS n_s3 FROM tl LEFT JOIN tp USING (source1_entity_id) GROUP BY 1)"


@_add("q_source_match_counts", f"WITH {_COUNTS_SQL} SELECT * FROM ct")
def q_source_match_counts(spark, d):
    return truth.match_counts(truth_lists(spark, d))


@_add("q_match_count_dist", f"WITH {_COUNTS_SQL} SELECT least(n_matches, 5) AS match_group, count(*) AS n FROM ct GROUP BY 1")
def q_match_count_dist(spark, d):
    return profile.match_count_distribution(truth.match_counts(truth_lists(spark, d)))


@_add("q_match_summary", f"WITH {_COUNTS_SQL} SELECT count(*) AS entities, sum((n_matches = 0)::INT)::BIGINT AS no_match, sum((n_matches >= 1)::INT)::BIGINT AS one_or_more, sum((n_matches > 1)::INT)::BIGINT AS several, sum(n_s2)::BIGINT AS s2_matches, sum(n_s3)::BIGINT AS s3_matches, sum((n_s2 > 0)::INT)::BIGINT AS with_s2, sum((n_s3 > 0)::INT)::BIGINT AS with_s3 FROM ct")
def q_match_summary(spark, d):
    return profile.match_summary(truth.match_counts(truth_lists(spark, d)))


_RECALL = {
    "total_pairs": "count(*)", "missing_target": "sum((t.entity_id IS NULL)::INT)", "name_recovered": "sum(nm::INT)", "address_recovered": "sum(am::INT)", "union_recovered": "sum((nm OR am)::INT)",
    "both": "sum((nm AND am)::INT)", "name_only": "sum((nm AND NOT am)::INT)", "address_only": "sum((am AND NOT nm)::INT)", "neither": "sum((NOT am AND NOT nm AND t.entity_id IS NOT NULL)::INT)",
}


def _recall_sql(columns: tuple[str, ...]) -> str:
    made = ", ".join(f"({_RECALL[c]})::BIGINT AS {c}" for c in columns)
    flags = "SELECT tp.*, coalesce(a.name_block <> '' AND a.name_block = t.name_block, false) AS nm, coalesce(a.address_block <> '' AND a.address_block = t.address_block, false) AS am, t.entity_id"
    return f"WITH {RECORDS_SQL}, {TRUE_SQL}, fl AS ({flags} FROM tp JOIN a ON a.entity_id = source1_entity_id LEFT JOIN t ON t.entity_id = target_entity_id) SELECT target_source, {made.replace('t.entity_id', 'entity_id')} FROM fl GROUP BY 1"


for _n, _c in (("name", ("total_pairs", "missing_target", "name_recovered")), ("address", ("total_pairs", "missing_target", "address_recovered")), ("union", tuple(_RECALL))):
    _add(f"q_blocking_recall_{_n}", _recall_sql(_c))(lambda spark, d, c=_c: blocking.blocking_recall(true_pairs(spark, d), *keyed(spark, d)).select("target_source", *c))


@_add("q_entity_f05", f"WITH {F05_SQL} SELECT source1_entity_id, round(f05, 6) AS f05 FROM f")
def q_entity_f05(spark, d):
    want = truth_lists(spark, d).select(S1, id_list("matched_entity_ids").alias("ids"))
    return rounded(metrics.entity_f05(_lists(_predictions(spark, d)), want))


@_add("q_macro_f05", f"WITH {F05_SQL} SELECT round(avg(f05), 6) AS macro_f05, count(*) AS entities FROM f")
def q_macro_f05(spark, d):
    want = truth_lists(spark, d).select(S1, id_list("matched_entity_ids").alias("ids"))
    return rounded(metrics.macro_f05(_lists(_predictions(spark, d)), want))


_BEST_SQL = f"{APPROX_SQL}, best AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY approx_probability DESC, target_entity_id) <= {K})"


def _list_sql(name: str, where: str) -> str:
    return f"WITH {_BEST_SQL} SELECT a.entity_id AS source1_entity_id, coalesce(l, '') AS {name} FROM a LEFT JOIN (SELECT source1_entity_id, string_agg(target_entity_id, ',' ORDER BY approx_probability DESC, target_entity_id) AS l FROM best {where} GROUP BY 1) x ON x.source1_entity_id = a.entity_id"


@_add("q_candidate_list", _list_sql("candidate_entity_ids", ""))
def q_candidate_list(spark, d):
    a, _ = keyed(spark, d)
    return ranking.id_lists(a, ranking.top_k(_approx(spark, d), K, [F.desc("approx_probability")]), "approx_probability", "candidate_entity_ids")


@_add("q_match_list", _list_sql("matched_entity_ids", "WHERE approx_probability >= 0.99"))
def q_match_list(spark, d):
    a, _ = keyed(spark, d)
    best = ranking.top_k(_approx(spark, d), K, [F.desc("approx_probability")]).filter("approx_probability >= 0.99")
    return ranking.id_lists(a, best, "approx_probability", "matched_entity_ids")


@_add("q_subset_violations", f"WITH {CANDIDATES_SQL}, {TRUE_SQL} SELECT source1_entity_id, target_entity_id FROM tp EXCEPT SELECT * FROM cand")
def q_subset_violations(spark, d):
    return validate.outside(true_pairs(spark, d), blocking.candidates(*keyed(spark, d)))


@_add(
    "q_validate_rules",
    f"""WITH {LISTS_SQL}, e AS (SELECT l_orderkey, 'S1-' || l_orderkey AS s1, string_agg('S' || l_linenumber || '-' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem GROUP BY 1),
x AS (SELECT s1, unnest(list_distinct(string_split(ids, ','))) AS id FROM e), need AS (SELECT 'S1-' || c_custkey AS s1 FROM customer),
o AS (SELECT 'repeated_id' AS rule, s1 AS offender FROM e WHERE len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ',')))
 UNION ALL SELECT DISTINCT 'self_match', id FROM x WHERE id LIKE 'S1-%' UNION ALL SELECT DISTINCT 'wrong_prefix', id FROM x WHERE NOT regexp_matches(id, '^S[123]-')
 UNION ALL SELECT DISTINCT 'unknown_id', id FROM x WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT 'S2-' || s_suppkey FROM supplier)
 UNION ALL SELECT 'missing_entity', s1 FROM need WHERE s1 NOT IN (SELECT s1 FROM e) UNION ALL SELECT 'extra_entity', s1 FROM e WHERE s1 NOT IN (SELECT s1 FROM need)),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY offender) AS n FROM o)
SELECT rule, count(*) AS offenders, string_agg(offender, ',' ORDER BY offender) FILTER (WHERE n <= 5) AS examples FROM r GROUP BY 1""",
)
def q_validate_rules(spark, d):
    """Lists made of lineitems break most rules."""
    item = _table(spark, d, "lineitem")
    one = F.struct("l_linenumber", "l_suppkey")
    ids = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(F.lit("S"), x["l_linenumber"].cast("string"), F.lit("-"), x["l_suppkey"].cast("string")))
    rows = item.groupBy("l_orderkey").agg(ids.alias("ids")).select(F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("s1"), F.lit(True).alias("tabbed"), "ids")
    need = _table(spark, d, "customer").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"))
    known = _table(spark, d, "supplier").select(F.concat(F.lit("S2-"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    return validate.report(validate.offenders(rows, need, known))


_ALL_SQL = f"{SOURCES_SQL}, allr AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"


def _all(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, sources(spark, d))


@_add("q_profile_empty", " UNION ALL ".join(f"(WITH {_ALL_SQL} SELECT '{c}' AS column_name, count(*) AS rows, sum((trim(coalesce({c}, '')) = '')::INT)::BIGINT AS empty_rows, round(100.0::DOUBLE * sum((trim(coalesce({c}, '')) = '')::INT) / count(*), 6) AS empty_percent FROM allr)" for c in records.COLUMNS))
def q_profile_empty(spark, d):
    return rounded(profile.empty_counts(_all(spark, d), records.COLUMNS))


@_add("q_profile_duplicates", f"WITH {_ALL_SQL}, g AS (SELECT business_name, count(*) AS n FROM allr GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_ids, sum(n - 1)::BIGINT AS extra_rows, sum((n > 1)::INT)::BIGINT AS duplicated_ids FROM g")
def q_profile_duplicates(spark, d):
    return profile.duplicates(_all(spark, d), "business_name")


@_add("q_country_dist", f"WITH {_ALL_SQL} SELECT country, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM allr GROUP BY 1")
def q_country_dist(spark, d):
    return rounded(profile.value_counts(_all(spark, d), "country"))


@_add("q_country_profile", f"WITH {_ALL_SQL}, g AS (SELECT country, count(*) AS n, sum((trim(business_name) = '')::INT)::BIGINT AS blank_names, count(DISTINCT business_name) AS distinct_names FROM allr GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n DESC, country) AS rank FROM g")
def q_country_profile(spark, d):
    return profile.country_profile(_all(spark, d), "country", "business_name")


@_add("q_length_describe", f"WITH {_ALL_SQL}, v AS (SELECT length(business_name)::DOUBLE AS v FROM allr) SELECT 'business_name' AS measure, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v)::INT AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v)::INT AS max FROM v")
def q_length_describe(spark, d):
    return rounded(profile.describe(_all(spark, d), F.length("business_name"), "business_name"))


@_add("q_quantiles", " UNION ALL ".join(f"(WITH {MEASURED_SQL} SELECT '{m}' AS measure, unnest({list(profile.QUANTILES)!r})::DOUBLE AS quantile, unnest(list_transform(quantile_cont({m}, {list(profile.QUANTILES)!r}), lambda x: round(x, 6))) AS value FROM ms)" for m in _MEASURES))
def q_quantiles(spark, d):
    return rounded(profile.quantiles(_measured(spark, d), _MEASURES))


@_add("q_grouped_means", " UNION ALL ".join(f"(WITH {MEASURED_SQL} SELECT target_source, '{m}' AS measure, round(avg({m}), 6) AS value FROM ms GROUP BY 1)" for m in _MEASURES))
def q_grouped_means(spark, d):
    return rounded(profile.grouped_means(_measured(spark, d), _MEASURES, "target_source"))


_RATES = (0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95)


@_add("q_rate_thresholds", " UNION ALL ".join(f"(WITH {MEASURED_SQL}, g AS (SELECT unnest({list(_RATES)!r})::DOUBLE AS threshold) SELECT target_source, '{m}' AS measure, threshold, round(avg(({m} >= threshold)::INT), 6) AS rate FROM ms, g GROUP BY 1, 3)" for m in _MEASURES))
def q_rate_thresholds(spark, d):
    return rounded(profile.rate_above(_measured(spark, d), _MEASURES, _RATES, "target_source"))


@_add("q_script_pairs", f"WITH {PAIRS_SQL}, x AS (SELECT CASE WHEN regexp_matches(s_name_norm, '[a-z]') THEN 'Latin' ELSE 'None' END AS script_s1, CASE WHEN regexp_matches(t_address_norm, '[a-z]') THEN 'Latin' ELSE 'None' END AS script_target FROM p) SELECT *, count(*) AS n FROM x GROUP BY 1, 2")
def q_script_pairs(spark, d):
    return profile.script_pairs(_pairs(spark, d), _SN, _TA)


_KNOWN_SQL = "".join(rf"\p{{{s}}}" for s in SCRIPTS)
_SCRIPTS_SQL = ", ".join([rf"CASE WHEN regexp_matches(text, '\p{{{s}}}') THEN '{s}' END" for s in SCRIPTS] + [rf"CASE WHEN regexp_matches(regexp_replace(text, '[{_KNOWN_SQL}]', '', 'g'), '\p{{L}}') THEN 'Other' END"])


@_add("q_scripts", f"SELECT doc_id, coalesce(nullif(array_to_string(list_sort(list_filter([{_SCRIPTS_SQL}], lambda x: x IS NOT NULL)), '+'), ''), 'None') AS scripts FROM documents")
def q_scripts(spark, d):
    return _table(spark, d, "documents").select("doc_id", scripts("text").alias("scripts"))


@_add("q_stratified_sample", f"WITH {_COUNTS_SQL}, g AS (SELECT *, least(n_matches, 5) AS match_group FROM ct WHERE n_matches > 0) SELECT source1_entity_id, match_group FROM g QUALIFY row_number() OVER (PARTITION BY match_group ORDER BY md5(source1_entity_id || ':42'), source1_entity_id) <= 100")
def q_stratified_sample(spark, d):
    counts = truth.match_counts(truth_lists(spark, d)).filter("n_matches > 0").withColumn("match_group", F.least("n_matches", F.lit(5)))
    return truth.stratified_sample(counts, "match_group", 100).select(S1, "match_group")


@_add("q_sample", f"WITH {LISTS_SQL} SELECT source1_entity_id FROM tl ORDER BY md5(source1_entity_id || ':42'), source1_entity_id LIMIT 1000")
def q_sample(spark, d):
    return truth.sample(truth_lists(spark, d), 1000).select(S1)


@_add("q_stratified_split", f"WITH {SCORED_SQL}, r AS (SELECT pair_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(pair_id || ':42'), pair_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM s) SELECT pair_id, y, rn <= floor(n * 0.8) AS is_train FROM r")
def q_stratified_split(spark, d):
    return truth.stratified_split(_scored(spark, d), "y").select("pair_id", "y", "is_train")


@_add("q_semi_join_records", f"WITH {SOURCES_SQL}, {TRUE_SQL} SELECT * FROM r1 WHERE entity_id IN (SELECT source1_entity_id FROM tp)")
def q_semi_join_records(spark, d):
    return records.retrieve(sources(spark, d)[0], true_pairs(spark, d), S1)


@_add("q_not_found", f"WITH {SOURCES_SQL}, {TRUE_SQL} SELECT DISTINCT target_entity_id AS entity_id FROM tp WHERE target_entity_id NOT IN (SELECT entity_id FROM r2)")
def q_not_found(spark, d):
    return records.not_found(sources(spark, d)[1], true_pairs(spark, d), TARGET)


@_add("q_longest_names", f"WITH {_ALL_SQL} SELECT business_address, length(business_address)::INT AS n_chars FROM allr ORDER BY n_chars DESC, business_address LIMIT 20")
def q_longest_names(spark, d):
    return profile.longest(_all(spark, d), "business_address")


@_add("q_short_values", f"WITH {_ALL_SQL} SELECT entity_id, business_address FROM allr WHERE length(trim(business_address)) <= 3")
def q_short_values(spark, d):
    return profile.short_values(_all(spark, d), "business_address").select("entity_id", "business_address")


@_add("q_capped_blocks", f"WITH {RECORDS_SQL} SELECT entity_id, name_block FROM t WHERE name_block <> '' QUALIFY row_number() OVER (PARTITION BY name_block ORDER BY md5(entity_id), entity_id) <= 500")
def q_capped_blocks(spark, d):
    return ranking.capped_blocks(keyed(spark, d)[1], "name_block").select("entity_id", "name_block")


@_add("q_fitted_model", None)
def q_fitted_model(spark, d):
    """A model trained on labelled pairs, as one row a feature."""
    true = true_pairs(spark, d).select(S1, TARGET)
    if (sides := _blocked(spark, d)) is None:
        a, t = keyed(spark, d)
        pairs = blocking.name_or_address(a, t).join(true.withColumn("y", F.lit(1)), [S1, TARGET], "left").withColumn("y", F.coalesce("y", F.lit(0)))
        parts = model.linear_parts(model.fit(features.feature_table(pairs, a, t)))
    else:
        parts = model.fit_counts(blockwise.feature_counts(*sides, true))
    rows = [(f, parts["mean"][f], parts["scale"][f], parts["coefficient"][f]) for f in features.FEATURES]
    return spark.createDataFrame([*rows, ("intercept", 0.0, 1.0, parts["intercept"])], "feature string, mean double, scale double, coefficient double")


_TEXTS_SQL = "JOIN a ON a.entity_id = source1_entity_id JOIN t ON t.entity_id = target_entity_id"
_MEASURES_SQL = {
    "name_similarity": f"CASE WHEN {_SN} = '' AND {_TN} = '' THEN 0.0 ELSE {FEATURES_SQL['name_similarity']} END",
    "address_similarity": f"CASE WHEN {_SA} = '' AND {_TA} = '' THEN 0.0 ELSE {FEATURES_SQL['address_similarity']} END",
    **{m: FEATURES_SQL[m] for m in diagnostics.MEASURES[2:]},
}
_NEGATIVE_SQL = f"""{RECORDS_SQL}, {TRUE_SQL}, cap AS (SELECT * FROM t WHERE name_block <> '' QUALIFY row_number() OVER (PARTITION BY name_block ORDER BY md5(entity_id), entity_id) <= 20),
met AS (SELECT a.entity_id AS source1_entity_id, cap.entity_id AS target_entity_id, substr(cap.entity_id, 1, 2) AS target_source, a.name_norm AS {_SN}, cap.name_norm AS {_TN},
  a.address_norm AS {_SA}, cap.address_norm AS {_TA}, a.country_norm AS s_country_norm, cap.country_norm AS t_country_norm FROM a JOIN cap ON a.name_block <> '' AND a.name_block = cap.name_block AND a.country_norm = cap.country_norm),
ms AS (SELECT source1_entity_id, target_entity_id, target_source, """ + ", ".join(f"({s})::DOUBLE AS {m}" for m, s in _MEASURES_SQL.items()) + f""" FROM met),
sc AS (SELECT *, 0.6 * name_similarity + 0.3 * address_similarity + 0.1 * numeric_overlap AS ranking_score FROM ms),
ng AS (SELECT sc.* FROM sc ANTI JOIN tp ON tp.source1_entity_id = sc.source1_entity_id AND tp.target_entity_id = sc.target_entity_id WHERE name_similarity >= 0.45
  QUALIFY row_number() OVER (PARTITION BY sc.source1_entity_id, sc.target_source ORDER BY {_ORDER_SQL.replace("target_entity_id", "sc.target_entity_id")}) <= 5)"""


def _negatives(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.block_negatives(*keyed(spark, d), true_pairs(spark, d).select(S1, TARGET), cap=20)


_ROUNDED = ", ".join(f"round({m}::DOUBLE, 6) AS {m}" for m in diagnostics.MEASURES)


@_add("q_block_negatives", f"WITH {_NEGATIVE_SQL} SELECT source1_entity_id, target_entity_id, target_source, {_ROUNDED}, round(ranking_score, 6) AS ranking_score FROM ng")
def q_block_negatives(spark, d):
    """Hard negatives among at most 20 targets of each block; the cap is part of this report."""
    return rounded(_negatives(spark, d).drop("rank").withColumn("country_same", F.col("country_same").cast("double")))


@_add(
    "q_true_vs_hard_negative",
    f"WITH {_NEGATIVE_SQL}, pp AS (SELECT tp.*, a.name_norm AS {_SN}, a.address_norm AS {_SA}, a.country_norm AS s_country_norm, t.name_norm AS {_TN}, t.address_norm AS {_TA}, t.country_norm AS t_country_norm FROM tp {_TEXTS_SQL}), "
    + "pm AS (SELECT source1_entity_id, target_entity_id, target_source, "
    + ", ".join(f"({s})::DOUBLE AS {m}" for m, s in _MEASURES_SQL.items())
    + f" FROM pp) SELECT source1_entity_id, target_entity_id, target_source, {_ROUNDED}, 1 AS label FROM pm UNION ALL SELECT source1_entity_id, target_entity_id, target_source, {_ROUNDED}, 0 FROM ng",
)
def q_true_vs_hard_negative(spark, d):
    a, t = keyed(spark, d)
    both = diagnostics.true_and_negative(true_pairs(spark, d), _negatives(spark, d), a, t)
    return rounded(both.withColumn("country_same", F.col("country_same").cast("double")))


def _script_sql(c: str) -> str:
    one = ", ".join([rf"CASE WHEN regexp_matches({c}, '\p{{{s}}}') THEN '{s}' END" for s in SCRIPTS] + [rf"CASE WHEN regexp_matches(regexp_replace({c}, '[{_KNOWN_SQL}]', '', 'g'), '\p{{L}}') THEN 'Other' END"])
    return f"coalesce(nullif(array_to_string(list_sort(list_filter([{one}], lambda x: x IS NOT NULL)), '+'), ''), 'None')"


_RAW_SQL = {"s1_name": "a.business_name", "s1_address": "a.business_address", "target_name": "t.business_name", "target_address": "t.business_address"}
_MATCH_SQL = {
    "country_same": FEATURES_SQL["country_same"],
    "name_raw_exact": "(trim(s1_name) = trim(target_name))::INT",
    "name_normalized_exact": f"({_SN} = {_TN})::INT",
    "name_ratio": f"round({FEATURES_SQL['name_similarity']}, 6)",
    "name_jaccard": f"round({FEATURES_SQL['name_jaccard']}, 6)",
    "address_raw_exact": "(trim(s1_address) = trim(target_address))::INT",
    "address_normalized_exact": f"({_SA} = {_TA})::INT",
    "address_ratio": f"round({FEATURES_SQL['address_similarity']}, 6)",
    "address_jaccard": f"round({FEATURES_SQL['address_jaccard']}, 6)",
    "name_length_s1": "length(s1_name)",
    "name_length_target": "length(target_name)",
    "s1_address_missing": "(trim(s1_address) = '')::INT",
    "target_address_missing": "(trim(target_address) = '')::INT",
    "address_numeric_overlap": f"round({FEATURES_SQL['numeric_overlap']}, 6)",
    "s1_name_script": _script_sql("s1_name"),
    "target_name_script": _script_sql("target_name"),
}


@_add(
    "q_match_diagnostics",
    f"WITH {RECORDS_SQL}, {TRUE_SQL}, p AS (SELECT tp.*, a.name_norm AS {_SN}, a.address_norm AS {_SA}, a.country_norm AS s_country_norm, t.name_norm AS {_TN}, t.address_norm AS {_TA}, t.country_norm AS t_country_norm, "
    + ", ".join(f"{c} AS {n}" for n, c in _RAW_SQL.items())
    + f" FROM tp {_TEXTS_SQL}) SELECT source1_entity_id, target_entity_id, target_source, "
    + ", ".join(f"{c} AS {n}" for n, c in _MATCH_SQL.items())
    + " FROM p",
)
def q_match_diagnostics(spark, d):
    return rounded(diagnostics.match_diagnostics(true_pairs(spark, d), *keyed(spark, d)))


@_add("q_shape", "SELECT position::INT AS position, c AS \"column\", t AS type, (SELECT count(*) FROM documents) AS rows, b AS blank FROM (VALUES (0, 'doc_id', 'bigint', (SELECT count(*) FROM documents WHERE doc_id IS NULL)), (1, 'text', 'string', (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '')), (2, 'lang', 'string', (SELECT count(*) FROM documents WHERE lang IS NULL OR trim(lang) = '')), (3, 'source', 'string', (SELECT count(*) FROM documents WHERE source IS NULL OR trim(source) = '')), (4, 'n_chars', 'bigint', (SELECT count(*) FROM documents WHERE n_chars IS NULL))) v(position, c, t, b)")
def q_shape(spark, d):
    """Columns, types and blank values of the documents."""
    return diagnostics.shape(_table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
