"""The catalogue of comparison queries over the driver's tables, each with the SQL that says what it has to return.

Left and right sides are SQL over the tables, the same text for both engines, so each query compares a table with a
changed version of itself, whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens import api, stored
from rowlens.operators import classified, infer, keyed, multiset
from rowlens.plans.options import Options, parse_budget
from rowlens.plans.schema import columns_of, compare, schema_rows

ORDERS = "SELECT * FROM {orders}"
ORDERS_2 = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 1.5 WHEN o_orderkey % 100 = 11 THEN o_totalprice + 0.001 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 200 <> 13
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 400 = 5"""
LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM {lineitem}"
LINES_2 = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 50 = 3 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag
  FROM {lineitem} WHERE l_suppkey % 97 <> 5"""
CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM {customer}"
TALKS = "SELECT conv_id, turn, role, text FROM {conversations}"
TALKS_2 = "SELECT conv_id, turn, CASE WHEN conv_id % 7 = 2 THEN 'system' ELSE role END AS role, text FROM {conversations} WHERE NOT (conv_id % 11 = 3 AND turn = 1)"
STATUS = ("added", "removed", "changed", "unchanged", "within_tolerance")


@dataclass
class Case:
    """A comparison: both sides, options, and for the SQL the canonical form of columns (by name, with ``{}``)."""

    left: str
    right: str
    options: Options
    canon: dict[str, str] = field(default_factory=dict)
    values: tuple[str, ...] = ()
    where: str = "TRUE"
    tolerance: dict[str, str] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()


def _spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
    return spark.sql(sql.format(**{n: f"parquet.`{sf_dir}/{n}.parquet`" for n in names}))


def _duck(sql: str) -> str:
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
    return sql.format(**{n: n for n in names})


def _sides(spark: SparkSession, sf_dir: str, case: Case) -> tuple[DataFrame, DataFrame]:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _spark_sql(spark, sf_dir, case.left), _spark_sql(spark, sf_dir, case.right)


def _joined_sql(c: Case) -> str:
    """A table j with status, k_<key>, and for each value <v>__left, <v>__right, d_<v> (beyond tolerance), a_<v>."""
    canon = lambda s, n: c.canon.get(n, "{}").format(f"{s}.{n}")
    keys, cols = c.options.key, []
    renamed = {new: old for old, new in c.options.rename.items()}
    right = lambda n: renamed.get(n, n)
    for v in c.values:
        differs = f"({canon('l', v)} IS DISTINCT FROM {c.canon.get(v, '{}').format('r.' + right(v))})"
        dist = f"abs(l.{v}::DOUBLE - r.{right(v)}::DOUBLE)" if v in c.numeric else "NULL::DOUBLE"
        inside = c.tolerance.get(v, "FALSE").format(d=dist, a=f"l.{v}", b=f"r.{right(v)}")
        cols += [f"l.{v} AS {v}__left", f"r.{right(v)} AS {v}__right", f"{differs} AS x_{v}", f"({differs} AND NOT coalesce({inside}, FALSE)) AS d_{v}", f"{dist} AS a_{v}"]
    on = " AND ".join(f"{canon('l', k)} IS NOT DISTINCT FROM {c.canon.get(k, '{}').format('r.' + right(k))}" for k in keys)
    any_of = lambda p: " OR ".join(f"{p}_{v}" for v in c.values) or "FALSE"
    key = ", ".join(f"CASE WHEN inl IS NULL THEN r.{right(k)} ELSE l.{k} END AS k_{k}" for k in keys)
    return f"""WITH l AS (SELECT *, 1 AS inl FROM ({_duck(c.left)}) WHERE {c.where}), r AS (SELECT *, 1 AS inr FROM ({_duck(c.right)}) WHERE {c.where}),
p AS (SELECT {key}, inl, inr{"".join(", " + x for x in cols)} FROM l FULL JOIN r ON {on}),
j AS (SELECT *, CASE WHEN inl IS NULL THEN 'added' WHEN inr IS NULL THEN 'removed' WHEN {any_of("d")} THEN 'changed' WHEN {any_of("x")} THEN 'within_tolerance' ELSE 'unchanged' END AS status FROM p)"""


_COUNTS = """count(*) FILTER (status <> 'added') AS left_rows, count(*) FILTER (status <> 'removed') AS right_rows, count(*) FILTER (status = 'added') AS added,
count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'within_tolerance') AS within_tolerance"""


def _counts(case: Case) -> tuple[Callable, str]:
    def run(spark, sf_dir):
        rows, _ = api.classify(*_sides(spark, sf_dir, case), case.options)
        return classified.counts(rows)

    return run, f"{_joined_sql(case)} SELECT {_COUNTS} FROM j"


def _rows(case: Case) -> tuple[Callable, str]:
    def run(spark, sf_dir):
        rows, plan = api.classify(*_sides(spark, sf_dir, case), case.options)
        return classified.named(rows, plan)

    cols = ", ".join([*(f"k_{k} AS {k}" for k in case.options.key), "status AS diff_status", *(f"{v}__{s}" for v in case.values for s in ("left", "right"))])
    return run, f"{_joined_sql(case)} SELECT {cols} FROM j WHERE status IN ('added', 'removed', 'changed')"


def _stats(case: Case) -> tuple[Callable, str]:
    def run(spark, sf_dir):
        rows, plan = api.classify(*_sides(spark, sf_dir, case), case.options)
        return classified.column_stats(rows, plan).select("column_name", "numeric", "changed", *(F.round(c, 6).alias(c) for c in ("match_rate", "max_abs_diff", "mean_abs_diff")))

    one = "SELECT '{v}' AS column_name, {n} AS numeric, count(*) FILTER (status = 'changed' AND d_{v}) AS changed, round(1 - (count(*) FILTER (status = 'changed' AND d_{v}))::DOUBLE / count(*) FILTER (status NOT IN ('added', 'removed')), 6) AS match_rate, round(max(a_{v}) FILTER (status = 'changed' AND d_{v}), 6) AS max_abs_diff, round(avg(a_{v}) FILTER (status = 'changed' AND d_{v}), 6) AS mean_abs_diff FROM j"
    per = " UNION ALL ".join(one.format(v=v, n=str(v in case.numeric).upper()) for v in case.values)
    return run, f"{_joined_sql(case)} SELECT * FROM ({per}) WHERE changed > 0"


def _summary(case: Case) -> tuple[Callable, str]:
    def run(spark, sf_dir):
        return keyed.summarize(*api.prepare(*_sides(spark, sf_dir, case), case.options))

    return run, f"{_joined_sql(case)} SELECT {_COUNTS} FROM j"


_ALL = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_NUM = ("o_custkey", "o_totalprice")
_FLOAT3 = "round_even({}::DOUBLE * 100, 0) / 100"


def _orders(right: str = ORDERS_2, left: str = ORDERS, **kw) -> Case:
    more = {k: kw.pop(k) for k in ("canon", "values", "where", "tolerance") if k in kw}
    return Case(left, right, Options(key=["o_orderkey"], **kw), values=more.pop("values", _ALL), numeric=_NUM, **more)


def _catalogue() -> dict[str, tuple[Callable, str | None]]:
    out: dict[str, tuple[Callable, str | None]] = {}
    base = _orders()
    out["diff_counts"], out["diff_rows"], out["diff_column_stats"], out["diff_summary"] = _counts(base), _rows(base), _stats(base), _summary(base)
    run, sql = _stats(base)
    out["diff_column_changes"] = lambda s, d, run=run: run(s, d).select("column_name", "changed", "match_rate"), f"SELECT column_name, changed, match_rate FROM ({sql})"
    out["diff_ignore_columns"] = _counts(_orders(ignore_columns=["o_orderstatus"], values=("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")))
    named = ORDERS_2.replace("o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 200", "o_orderdate, o_orderpriority AS priority FROM {orders} WHERE o_orderkey % 200")
    out["diff_rename"] = _rows(_orders(right=named, rename={"priority": "o_orderpriority"}))
    out["diff_multi_key"] = _rows(Case(TALKS, TALKS_2, Options(key=["conv_id", "turn"]), values=("role", "text")))
    null = "SELECT NULLIF(c_custkey, 77) AS c_custkey, c_name, c_acctbal{} FROM {{customer}}"
    out["diff_null_keys"] = _rows(Case(null.format(""), null.format(" + 1 AS c_acctbal").replace(", c_acctbal + 1", ", CASE WHEN c_custkey % 70 = 7 THEN c_acctbal + 1 ELSE c_acctbal END"), Options(key=["c_custkey"]), values=("c_name", "c_acctbal"), numeric=("c_acctbal",)))
    wide = "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM {orders} WHERE o_orderkey % 9 <> 4"
    out["diff_int_float_coercion"] = _counts(Case("SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}", wide, Options(key=["o_orderkey"]), values=("o_custkey", "o_totalprice"), numeric=_NUM))
    out["diff_float_precision"] = _counts(_orders(float_precision=2, canon={"o_totalprice": _FLOAT3}))
    folded = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM {customer}"
    out["diff_case_exact"] = _counts(Case(CUSTOMERS, folded, Options(key=["c_custkey"]), values=("c_name", "c_acctbal"), numeric=("c_acctbal",)))
    out["diff_ignore_case"] = _counts(Case(CUSTOMERS, folded, Options(key=["c_custkey"], ignore_case=True), {"c_name": "lower({})"}, ("c_name", "c_acctbal"), numeric=("c_acctbal",)))
    padded = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('  ', c_name, ' ') WHEN c_custkey % 4 = 1 THEN concat(c_name, '!') ELSE c_name END AS c_name, c_acctbal FROM {customer}"
    out["diff_trim"] = _counts(Case(CUSTOMERS, padded, Options(key=["c_custkey"], trim=True), {"c_name": "trim({})"}, ("c_name", "c_acctbal"), numeric=("c_acctbal",)))
    late = "SELECT event_id, ts + INTERVAL '300' MILLISECOND AS ts, user_id FROM {events}".replace("'300' MILLISECOND", "'0.3' SECOND")
    out["diff_timestamp_precision"] = _counts(Case("SELECT event_id, ts, user_id FROM {events}", late, Options(key=["event_id"], timestamp_precision="s"), {"ts": "floor(epoch_us({}) / 1000000.0)"}, ("ts", "user_id"), numeric=("user_id",)))
    keys = "SELECT concat(' ', upper(c_name)) AS c_name, c_acctbal FROM {customer} WHERE c_custkey % 10 <> 1"
    out["diff_normalized_keys"] = _rows(Case("SELECT c_name, c_acctbal FROM {customer}", keys, Options(key=["c_name"], trim=True, ignore_case=True), {"c_name": "lower(trim({}))"}, ("c_acctbal",), numeric=("c_acctbal",)))
    out["diff_tolerance_abs"] = _rows(_tolerant(["0.01"], {v: "{d} <= 0.01" for v in _NUM}))
    out["diff_tolerance_counts"] = _counts(_tolerant(["0.01"], {v: "{d} <= 0.01" for v in _NUM}))
    out["diff_tolerance_relative"] = _stats(_tolerant(["o_totalprice=rel=1e-5"], {"o_totalprice": "{d} <= 1e-5 * greatest(abs({a}), abs({b}))"}))
    raw = "SELECT o_orderkey, CAST(o_orderpriority AS BINARY) AS o_orderpriority, o_custkey FROM {orders}"
    out["diff_bytes"] = _counts(Case(raw, raw.replace("CAST(o_orderpriority AS BINARY)", "CASE WHEN o_orderkey % 30 = 3 THEN CAST(concat(o_orderpriority, 'x') AS BINARY) ELSE CAST(o_orderpriority AS BINARY) END"), Options(key=["o_orderkey"]), values=("o_orderpriority", "o_custkey"), numeric=_NUM))
    out |= _multisets() | _selection() | _verdicts() | _infos() | _stored()
    return out


def _tolerant(specs: list[str], sql: dict[str, str]) -> Case:
    case = _orders()
    case.options.tolerance, case.tolerance = specs, sql
    return case


_STACK = "SELECT {k}, {v}, sum(nl)::BIGINT AS nl, sum(nr)::BIGINT AS nr FROM (SELECT {k}, {v}, 1 AS nl, 0 AS nr FROM ({l}) UNION ALL SELECT {k}, {v}, 0, 1 FROM ({r})) GROUP BY ALL"


def _multisets() -> dict:
    match = Case(LINES, LINES_2, Options(key=["l_orderkey", "l_linenumber"], on_dup="match"))
    stack = _STACK.format(k="l_orderkey, l_linenumber", v="l_quantity, l_returnflag", l=_duck(LINES), r=_duck(LINES_2))
    per = f"SELECT l_orderkey, l_linenumber, sum(nl) AS nl, sum(nr) AS nr, sum(least(nl, nr)) AS same, sum(greatest(nl - nr, 0)) AS ll, sum(greatest(nr - nl, 0)) AS lr FROM ({stack}) GROUP BY ALL"

    def match_counts(spark, sf_dir):
        return multiset.counts(*api.prepare(*_sides(spark, sf_dir, match), match.options))

    match_sql = f"""SELECT sum(nl)::BIGINT AS left_rows, sum(nr)::BIGINT AS right_rows, coalesce(sum(lr) FILTER (NOT (ll = 1 AND lr = 1)), 0)::BIGINT AS added,
coalesce(sum(ll) FILTER (NOT (ll = 1 AND lr = 1)), 0)::BIGINT AS removed, count(*) FILTER (ll = 1 AND lr = 1) AS changed, sum(same)::BIGINT AS unchanged,
count(*) FILTER (nl > 1) AS dup_keys, coalesce(sum(nl) FILTER (nl > 1), 0)::BIGINT AS dup_rows FROM ({per})"""

    def match_rows(spark, sf_dir):
        rows, plan = api.classify(*_sides(spark, sf_dir, match), match.options)
        return classified.named(rows, plan)

    left = f"SELECT g.*, p.ll, p.lr FROM ({stack}) g JOIN ({per}) p USING (l_orderkey, l_linenumber)"
    rows_sql = f"""WITH g AS ({left}), a AS (SELECT * FROM g WHERE nl > nr), b AS (SELECT * FROM g WHERE nr > nl)
SELECT l_orderkey, l_linenumber, 'removed' AS diff_status, l_quantity AS l_quantity__left, NULL::DOUBLE AS l_quantity__right, l_returnflag AS l_returnflag__left, NULL AS l_returnflag__right FROM (SELECT *, unnest(range(nl - nr)) FROM a WHERE NOT (ll = 1 AND lr = 1))
UNION ALL SELECT l_orderkey, l_linenumber, 'added', NULL, l_quantity, NULL, l_returnflag FROM (SELECT *, unnest(range(nr - nl)) FROM b WHERE NOT (ll = 1 AND lr = 1))
UNION ALL SELECT a.l_orderkey, a.l_linenumber, 'changed', a.l_quantity, b.l_quantity, a.l_returnflag, b.l_returnflag FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.ll = 1 AND a.lr = 1"""
    whole = Case(LINES, LINES_2, Options(keyless=True))
    stack_all = _STACK.format(k="l_orderkey, l_linenumber", v="l_quantity, l_returnflag", l=_duck(LINES), r=_duck(LINES_2))

    def keyless(spark, sf_dir):
        return multiset.counts(*api.prepare(*_sides(spark, sf_dir, whole), whole.options))

    def keyless_rows(spark, sf_dir):
        rows, plan = api.classify(*_sides(spark, sf_dir, whole), whole.options)
        return classified.named(rows, plan)

    keyless_sql = f"SELECT sum(nl)::BIGINT AS left_rows, sum(nr)::BIGINT AS right_rows, sum(greatest(nr - nl, 0))::BIGINT AS added, sum(greatest(nl - nr, 0))::BIGINT AS removed, 0::BIGINT AS changed, sum(least(nl, nr))::BIGINT AS unchanged FROM ({stack_all})"
    cols = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    show = lambda s: ", ".join(f"{c if s == 'l' else 'NULL'} AS {c}__left, {c if s == 'r' else 'NULL'} AS {c}__right" for c in cols)
    keyless_rows_sql = f"WITH g AS ({stack_all}) SELECT 'removed' AS diff_status, {show('l')} FROM (SELECT *, unnest(range(nl - nr)) FROM g WHERE nl > nr) UNION ALL SELECT 'added', {show('r')} FROM (SELECT *, unnest(range(nr - nl)) FROM g WHERE nr > nl)"
    first = Case(LINES, LINES_2, Options(key=["l_orderkey", "l_linenumber"], on_dup="warn", order_by=["l_quantity", "l_returnflag"]))

    def warn(spark, sf_dir):
        rows, _ = api.classify(*_sides(spark, sf_dir, first), first.options)
        return keyed.count_first(rows)

    number = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_returnflag) AS n FROM ({})"
    warn_sql = f"""WITH a AS ({number.format(_duck(LINES))}), b AS ({number.format(_duck(LINES_2))}),
j AS (SELECT CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN b.n > 1 THEN NULL WHEN a.l_quantity IS DISTINCT FROM b.l_quantity OR a.l_returnflag IS DISTINCT FROM b.l_returnflag THEN 'changed' ELSE 'unchanged' END AS status
  FROM (SELECT * FROM a WHERE n = 1) a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)
SELECT {_COUNTS}, (SELECT count(*) FROM a WHERE n > 1) AS dups_left, count(*) FILTER (status IS NULL) AS dups_right FROM j"""

    def repeated(spark, sf_dir):
        a, _, plan = api.prepare(*_sides(spark, sf_dir, match), match.options)
        return keyed.duplicates(a, plan)

    dup_sql = f"SELECT l_orderkey || '|' || l_linenumber AS key, count(*) AS n FROM ({_duck(LINES)}) GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
    return {
        "diff_on_dup_match": (match_counts, match_sql), "diff_on_dup_match_rows": (match_rows, rows_sql), "diff_keyless": (keyless, keyless_sql), "diff_keyless_rows": (keyless_rows, keyless_rows_sql),
        "diff_on_dup_warn": (warn, warn_sql), "diff_dup_keys": (repeated, dup_sql),
    }


def _selection() -> dict:
    tests = {
        "numbers": (["o_totalprice >= 150000.5 and o_custkey < 900"], "o_totalprice >= 150000.5 AND o_custkey < 900"),
        "text": (["o_orderpriority = '1-URGENT'", "o_orderstatus != X"], "o_orderpriority = '1-URGENT' AND o_orderstatus <> 'X'"),
        "dates": (["o_orderdate > '1995-06-01 00:00:00'"], "o_orderdate > TIMESTAMP '1995-06-01 00:00:00'"),
        "asymmetric": (["o_totalprice < 100001"], "o_totalprice < 100001"),
    }
    out = {}
    for n, (spec, sql) in tests.items():
        case = _orders()
        case.options.where, case.where = spec, sql
        out[f"diff_where_{n}"] = _counts(case)
    special = "SELECT o_orderkey, NULLIF(o_custkey, {n}) AS o_custkey, CASE WHEN o_orderkey % 10 = {m} THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS o_totalprice FROM {{orders}}"
    for n, spec, sql in (("null", ["o_custkey is not null"], "o_custkey IS NOT NULL"), ("is_null", ["o_custkey is null"], "o_custkey IS NULL"), ("nan", ["o_totalprice > 1000"], "o_totalprice > 1000 AND NOT isnan(o_totalprice)"), ("nan_unequal", ["o_totalprice != 1000"], "(o_totalprice <> 1000 OR isnan(o_totalprice))")):
        out[f"diff_where_{n}"] = _counts(Case(special.format(n=7, m=3), special.format(n=8, m=4), Options(key=["o_orderkey"], where=spec), values=("o_custkey", "o_totalprice"), numeric=_NUM, where=sql))
    return out


def _verdicts() -> dict:
    case = _orders()
    _, counts_sql = _counts(case)

    def verdict(spark, sf_dir):
        rows, plan = api.classify(*_sides(spark, sf_dir, case), case.options)
        c = classified.counts(rows)
        differing = F.col("added") + F.col("removed") + F.col("changed")
        specs = F.explode(F.array(*(F.struct(F.lit(s).alias("budget"), F.lit(how == "percent").alias("percent"), F.lit(x).alias("x")) for s in ("100", "5%", "100000") for how, x in [parse_budget(s)]))).alias("b")
        c = c.select("*", specs).withColumn("most", F.when(F.col("b.percent"), F.floor(F.col("b.x") / 100 * F.greatest("left_rows", "right_rows"))).otherwise(F.col("b.x")).cast("long"))
        return c.select("b.budget", F.col("most").alias("allowed"), differing.alias("differing"), F.when(differing > F.col("most"), 1).otherwise(0).cast("int").alias("exit_code"))

    verdict_sql = f"""WITH c AS ({counts_sql}), b AS (SELECT * FROM (VALUES ('100', FALSE, 100.0::DOUBLE), ('5%', TRUE, 5.0), ('100000', FALSE, 100000.0)) t(budget, percent, x)),
m AS (SELECT budget, CASE WHEN percent THEN floor(x / 100 * greatest(left_rows, right_rows)) ELSE x END::BIGINT AS allowed, added + removed + changed AS differing FROM c, b)
SELECT budget, allowed, differing, (differing > allowed)::INTEGER AS exit_code FROM m"""

    def top(spark, sf_dir):
        rows, plan = api.classify(*_sides(spark, sf_dir, case), case.options)
        return classified.examples(rows, plan, 10).select("status", "key", F.size("columns").alias("n_columns"))

    n_cols = " + ".join(f"(d_{v} AND status = 'changed')::INTEGER" for v in case.values)
    part = "(SELECT status, k_o_orderkey::VARCHAR AS key, " + n_cols + " AS n_columns FROM j WHERE status = '{}' ORDER BY key LIMIT 10)"
    top_sql = f"{_joined_sql(case)} " + " UNION ALL ".join(part.format(s) for s in ("added", "removed", "changed"))

    def mask(spark, sf_dir):
        options = Options(key=["o_orderkey"], mask=["o_totalprice"])
        rows, plan = api.classify(*_sides(spark, sf_dir, case), options)
        return classified.named(rows, plan).select("o_orderkey", "diff_status", "o_totalprice__left", "o_totalprice__right")

    return {"diff_budget_verdict": (verdict, verdict_sql), "diff_examples_topk": (top, top_sql), "diff_mask": (mask, None)}


def _infos() -> dict:
    other = "SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, CAST(o_totalprice AS BIGINT) AS o_totalprice, o_orderdate, o_orderpriority AS priority FROM {orders}"

    def schemas(spark, sf_dir):
        a, b = _spark_sql(spark, sf_dir, ORDERS), _spark_sql(spark, sf_dir, other)
        return schema_rows(spark, compare(columns_of(a.schema)[0], columns_of(b.schema)[0]))

    schema_sql = "SELECT * FROM (VALUES ('priority', 'added', NULL, 'string'), ('o_orderstatus', 'removed', 'string', NULL), ('o_orderpriority', 'removed', 'string', NULL), ('o_custkey', 'incomparable', 'int64', 'string'), ('o_totalprice', 'type', 'float64', 'int64')) t(column_name, change, left_value, right_value)"

    def key(spark, sf_dir):
        a, b = _spark_sql(spark, sf_dir, "SELECT * FROM {customer}"), _spark_sql(spark, sf_dir, "SELECT * FROM {customer} WHERE c_custkey % 5 <> 1")
        found = infer.candidates(a, b, compare(columns_of(a.schema)[0], columns_of(b.schema)[0]))
        return spark.createDataFrame([(n, s, i == 0) for i, (n, s) in enumerate(found)], "column_name string, score int, chosen boolean")

    unique = lambda c: f"(SELECT count(*) - count(DISTINCT {c}) <= 0 FROM customer)"
    scores = {"c_custkey": 10, "c_name": 5, "c_nationkey": 10, "c_acctbal": 0, "c_mktsegment": 5}
    key_sql = "WITH t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {s}::INTEGER AS score, {i} AS n, {unique(c)} AS ok" for i, (c, s) in enumerate(scores.items())) + ") SELECT column_name, score, row_number() OVER (ORDER BY score DESC, n) = 1 AS chosen FROM t WHERE ok"
    return {"diff_schema": (schemas, schema_sql), "infer_key": (key, key_sql)}


def _stored() -> dict:
    """Queries that write files to the shared folder and read them back through the sources."""
    counts_sql = _counts(_orders())[1]
    run_baseline = lambda s, d: stored.baseline(s, *_sides(s, d, _orders()))
    out = {"snapshot_diff_counts": (run_baseline, counts_sql)}
    part = "SELECT * FROM ({}) WHERE o_orderkey % 200 {} 100"
    half = _orders(right=f"{part.format(ORDERS, '>=')} UNION ALL {part.format(ORDERS_2, '<')}")
    versions = lambda s, d: stored.delta_versions(s, *(_spark_sql(s, d, x) for x in (part.format(ORDERS, ">="), part.format(ORDERS, "<"), part.format(ORDERS_2, "<"))))
    out["delta_version_diff"] = versions, _counts(half)[1]
    three = [f"SELECT * FROM ({ORDERS}) WHERE o_orderkey % 3 = {i}" for i in range(3)]
    deleted = lambda s, d: stored.merge_on_read(s, [_spark_sql(s, d, x) for x in three], "o_orderkey % 50 = 3 OR o_custkey % 97 = 5")
    out["iceberg_mor"] = deleted, _counts(_orders(right=f"SELECT * FROM ({ORDERS}) WHERE NOT (o_orderkey % 50 = 3 OR o_custkey % 97 = 5)"))[1]
    for name in ("csv", "csv_gz", "ndjson", "parquet_partitioned"):
        out[f"diff_{name}_roundtrip"] = (lambda s, d, name=name: stored.round_trip(s, *_sides(s, d, _orders()), name), counts_sql)
    return out


def queries() -> dict[str, Callable]:
    return {name: run for name, (run, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}

