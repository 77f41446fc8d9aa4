"""The registered queries of the library's own operators, each with the SQL that checks it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.functions.formula import Formula
from weftwork.functions.replies import as_text, extract_json
from weftwork.operators import dedup, profile, records
from weftwork.operators.validate import looping, orphans, summary, uncovered, validate
from weftwork.plans.generate import Dataset, generate
from weftwork.plans.schema import Schema
from weftwork.sources.cassette import request_key
from weftwork.sources.io import RawData, chat_messages

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]


ROWS = 1000  # what the catalogue's schemas declare; the tables have other numbers


def checked(spark, names: tuple, **tables: tuple[DataFrame, list[dict]]) -> DataFrame:
    """The checks of these names that the engine makes of tables (rows, fields), as rows."""
    schema = Schema.from_dict({"tables": [{"name": n, "rows": ROWS, "fields": fields} for n, (_, fields) in tables.items()]})
    report = validate(Dataset(schema, {n: df.select(*(f["name"] for f in fields)) for n, (df, fields) in tables.items()}))
    return report.frame(spark).where(F.col("name").isin(*names)).select("name", "table", F.coalesce("field", F.lit("")).alias("field"), "passed", "n_bad")


def _check(name: str, table: str, field: str, bad: str, source: str) -> str:
    return f"SELECT '{name}' AS name, '{table}' AS \"table\", '{field}' AS field, ({bad}) = 0 AS passed, ({bad})::BIGINT AS n_bad FROM {source}"


_FIRST = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name", "orders": "o_orderstatus", "lineitem": "l_returnflag", "events": "event_type", "documents": "source", "embeddings": "label", "pages": "url", "benchmark": "text", "labels": "toxic", "conversations": "role"}


@query(" UNION ALL ".join(_check("row_count", n, "", f"abs(count(*) - {ROWS})", n) for n in ALL))
def v_row_count(spark, d):
    return checked(spark, ("row_count",), **{n: (t(spark, d, n).withColumn(_FIRST[n], F.col(_FIRST[n]).cast("string")), [{"name": _FIRST[n], "type": "text"}]) for n in ALL})


@query(" UNION ALL ".join([_check("uniqueness", "orders", "o_orderkey", "count(o_orderkey) - count(DISTINCT o_orderkey)", "orders"), _check("uniqueness", "orders", "o_custkey", "count(o_custkey) - count(DISTINCT o_custkey)", "orders"), _check("uniqueness", "lineitem", "key", "count(*) - count(DISTINCT l_orderkey || '-' || l_linenumber)", "lineitem")]))
def v_uniqueness(spark, d):
    items = t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return checked(spark, ("uniqueness",), orders=(t(spark, d, "orders"), [{"name": "o_orderkey", "type": "id"}, {"name": "o_custkey", "type": "int", "min": 0, "max": 10**12, "unique": True}]), lineitem=(items, [{"name": "key", "type": "text", "unique": True}]))


@query(" UNION ALL ".join([_check("not_null", "customer", "c_custkey", "0", "(SELECT 1)"), _check("not_null", "orders", "o_orderkey", "count(*) FILTER (o_orderkey % 11 = 0)", "orders"), _check("not_null", "orders", "o_custkey", "count(*) FILTER (o_orderkey % 50 = 0)", "orders")]))
def v_not_null(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    o = o.select(F.when(k % 11 != 0, k).alias("o_orderkey"), F.when(k % 50 != 0, F.col("o_custkey")).alias("o_custkey"))
    return checked(spark, ("not_null",), customer=(t(spark, d, "customer"), [{"name": "c_custkey", "type": "id"}]), orders=(o, [{"name": "o_orderkey", "type": "id"}, {"name": "o_custkey", "type": "foreign_key", "references": "customer.c_custkey"}]))


@query(" UNION ALL ".join(f"SELECT '{c}.{f}' AS fk, (SELECT count(*) FROM {c} WHERE {f} IS NOT NULL AND {f} NOT IN (SELECT {k} FROM {p})) AS orphans" for c, f, p, k in FKS) + " UNION ALL SELECT 'lineitem.l_orderkey (F only)', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))")
def v_fk_orphans(spark, d):
    parts = [(f"{c}.{f}", orphans(t(spark, d, c).select(f), f, t(spark, d, p), k)) for c, f, p, k in FKS]
    parts.append(("lineitem.l_orderkey (F only)", orphans(t(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", t(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey")))
    return union([df.agg(F.count("*").alias("orphans")).select(F.lit(n).alias("fk"), "orphans") for n, df in parts])


@query("""SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) < 2""")
def v_parent_coverage(spark, d):
    return uncovered(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", t(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", 2)


_GAP = "max(abs(coalesce(n, 0) / total - w))"


@query(f"""WITH c AS (SELECT event_type AS l, count(*) AS n FROM events GROUP BY 1), s AS (SELECT count(*) AS total FROM events),
e AS (SELECT l, n, total, CASE l WHEN 'click' THEN 0.4 ELSE 0.15 END AS w FROM c, s), r AS (SELECT 'type' AS field, {_GAP} AS gap, any_value(total) AS total FROM e
UNION ALL SELECT 'half', max(abs(n / total - 0.5)), any_value(total) FROM (SELECT value > 40 AS l, count(*) AS n FROM events GROUP BY 1), s)
SELECT 'distribution' AS name, 'events' AS "table", field, gap <= greatest(0.05, 1 / total) + 1e-12 AS passed, (gap > greatest(0.05, 1 / total) + 1e-12)::BIGINT AS n_bad FROM r""")
def v_distribution(spark, d):
    e = t(spark, d, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    fields = [{"name": "type", "type": "category", "categories": {k: 0.4 if k == "click" else 0.15 for k in kinds}}, {"name": "half", "type": "category", "categories": ["low", "high"]}]
    return checked(spark, ("distribution",), events=(e.select(F.col("event_type").alias("type"), F.when(F.col("value") > 40, "high").otherwise("low").alias("half")), fields))


@query(f"""WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS l, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY p) AS total,
CASE WHEN left(p, 1) = '1' THEN CASE l WHEN 'F' THEN 0.8 ELSE 0.1 END ELSE 1 / 3 END AS w FROM c), g AS (SELECT p, {_GAP} AS gap, any_value(total) AS total FROM s WHERE total >= 20 GROUP BY p)
SELECT 'distribution' AS name, 'orders' AS "table", 'status' AS field, bool_and(gap <= greatest(0.05, 1 / total) + 1e-12) AS passed, (NOT bool_and(gap <= greatest(0.05, 1 / total) + 1e-12))::BIGINT AS n_bad FROM g""")
def v_distribution_when(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    urgent = {p: {"categories": {"F": 0.8, "O": 0.1, "P": 0.1}} for p in (r[0] for r in o.select("priority").distinct().collect()) if p.startswith("1")}
    labels = sorted(r[0] for r in o.select("priority").distinct().collect())
    fields = [{"name": "priority", "type": "category", "categories": labels}, {"name": "status", "type": "category", "categories": ["F", "O", "P"], "when": {"field": "priority", "cases": urgent}}]
    return checked(spark, ("distribution",), orders=(o, fields)).where("field = 'status'")


@query(_check("when_bounds", "lineitem", "l_discount", "count(*) FILTER (NOT l_discount BETWEEN 0 AND CASE l_returnflag WHEN 'A' THEN 0.05 WHEN 'R' THEN 0.07 ELSE 0.09 END)", "lineitem"))
def v_when_bounds(spark, d):
    cases = {"field": "l_returnflag", "cases": {"A": {"max": 0.05}, "R": {"max": 0.07}}}
    fields = [{"name": "l_returnflag", "type": "category", "categories": ["A", "N", "R"]}, {"name": "l_discount", "type": "float", "min": 0, "max": 0.09, "when": cases}]
    return checked(spark, ("when_bounds",), lineitem=(t(spark, d, "lineitem"), fields))


_DAYS = "date_diff('day', o_orderdate::DATE, l_shipdate::DATE)"


@query(" UNION ALL ".join([_check("temporal_order", "lineitem", "l_shipdate", f"count(*) FILTER (NOT {_DAYS} BETWEEN 1 AND 90)", "lineitem JOIN orders ON l_orderkey = o_orderkey"), _check("temporal_order", "lineitem", "early", f"count(*) FILTER ({_DAYS} > 30)", "lineitem JOIN orders ON l_orderkey = o_orderkey")]))
def v_temporal(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    i = t(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("l_shipdate"), F.date_add(F.col("l_shipdate").cast("date"), -30).alias("early"))
    key = {"name": "l_orderkey", "type": "foreign_key", "references": "orders.o_orderkey"}
    fields = [key, {"name": "l_shipdate", "type": "date", "after": "l_orderkey.o_orderdate", "min_days": 1, "max_days": 90}, {"name": "early", "type": "date", "before": "l_orderkey.o_orderdate"}]
    return checked(spark, ("temporal_order",), orders=(o, [{"name": "o_orderkey", "type": "id"}, {"name": "o_orderdate", "type": "date"}]), lineitem=(i, fields))


@query(" UNION ALL ".join([_check("lookup_consistency", "lineitem", "price", "count(*) FILTER (o_orderkey % 97 = 0)", "lineitem JOIN orders ON l_orderkey = o_orderkey"), _check("lookup_consistency", "lineitem", "status", "count(*) FILTER (o_orderkey % 89 = 0 AND o_orderstatus <> 'O')", "lineitem JOIN orders ON l_orderkey = o_orderkey")]))
def v_lookup(spark, d):
    o, k = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.col("o_orderkey")
    i = t(spark, d, "lineitem").select("l_orderkey").join(o, F.col("l_orderkey") == k).select("l_orderkey", (F.col("o_totalprice") + F.when(k % 97 == 0, 1).otherwise(1e-8)).alias("price"), F.when(k % 89 == 0, "O").otherwise(F.col("o_orderstatus")).alias("status"))
    parent = [{"name": "o_orderkey", "type": "id"}, {"name": "o_totalprice", "type": "float", "max": 10**9}, {"name": "o_orderstatus", "type": "category", "categories": ["F", "O", "P"]}]
    fields = [{"name": "l_orderkey", "type": "foreign_key", "references": "orders.o_orderkey"}, {"name": "price", "type": "lookup", "via": "l_orderkey", "column": "o_totalprice"}, {"name": "status", "type": "lookup", "via": "l_orderkey", "column": "o_orderstatus"}]
    return checked(spark, ("lookup_consistency",), orders=(o, parent), lineitem=(i, fields))


@query(" UNION ALL ".join(_check("type", "lineitem", f, f"count(*) FILTER (NOT {rule})", "lineitem") for f, rule in (("l_quantity", "l_quantity BETWEEN 1 AND 45"), ("l_linenumber", "l_linenumber BETWEEN 2 AND 6"), ("l_shipdate", "l_shipdate::DATE BETWEEN '1995-01-01' AND '1997-06-30'"))))
def v_type_range(spark, d):
    i = t(spark, d, "lineitem").select("l_quantity", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_shipdate").cast("date").alias("l_shipdate"))
    fields = [{"name": "l_quantity", "type": "float", "min": 1, "max": 45}, {"name": "l_linenumber", "type": "int", "min": 2, "max": 6}, {"name": "l_shipdate", "type": "date", "start": "1995-01-01", "end": "1997-06-30"}]
    return checked(spark, ("type",), lineitem=(i, fields))


@query(" UNION ALL ".join(_check("type", "customer", f, f"count(*) FILTER (c_custkey % {m} = 0)", "customer") for f, m in (("mail", 7), ("phone", 5), ("ip", 6), ("code", 4))))
def v_type_regex(spark, d):
    k = F.col("c_custkey")
    bad = lambda m, wrong, right: F.when(k % m == 0, wrong).otherwise(right)
    h = F.md5(k.cast("string"))
    code = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    c = t(spark, d, "customer").select(
        bad(7, F.concat(F.lit("c"), k, F.lit("@shop.de")), F.concat(F.lit("c."), k, F.lit("@example.org"))).alias("mail"), bad(5, F.lit("555-0100"), F.concat(F.lit("+1-212-555-01"), F.lpad((k % 100).cast("string"), 2, "0"))).alias("phone"),
        bad(6, F.lit("10.0.0.1"), F.concat(F.lit("192.0.2."), k % 254 + 1)).alias("ip"), bad(4, F.upper(F.concat(code, F.lit("A"))), code).alias("code"),
    )
    return checked(spark, ("type",), customer=(c, [{"name": "mail", "type": "email"}, {"name": "phone", "type": "phone"}, {"name": "ip", "type": "ipv4"}, {"name": "code", "type": "uuid"}]))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 500 = 7 THEN p_partkey * 2 WHEN p_partkey > 1 THEN p_partkey // 2 END AS up FROM part),
r AS (SELECT id, up, 0 AS depth FROM p WHERE up IS NOT NULL UNION ALL SELECT r.id, p.up, depth + 1 FROM r JOIN p ON r.up = p.id WHERE p.up IS NOT NULL AND depth < 40)
SELECT DISTINCT id AS node FROM r WHERE depth = 40""")
def v_hierarchy(spark, d):
    k = F.col("p_partkey")
    up = F.when(k % 500 == 7, k * 2).when(k > 1, F.floor(k / 2))
    return looping(t(spark, d, "part").select(k.alias("id"), up.alias("up")), "id", "up")


def _summaries(spark, df: DataFrame, *fields: dict) -> list[tuple[str, dict]]:
    """What the distribution report says of each field."""
    table = Schema.from_dict({"tables": [{"name": "t", "rows": ROWS, "fields": list(fields)}]}).tables[0]
    return [(f.name, summary(df, f)) for f in table.fields]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) - count({c}) AS nulls, round(min({c}) + 0.0, 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def r_numeric(spark, d):
    found = _summaries(spark, t(spark, d, "lineitem"), *({"name": c, "type": "float"} for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    rows = [(c, s["count"], s["nulls"], *(round(s[k] + 0.0, 6) for k in ("min", "max", "mean", "std"))) for c, s in found]
    return spark.createDataFrame(rows, "field string, n long, nulls long, min double, max double, mean double, std double")


@query("SELECT o_orderstatus AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS observed FROM orders GROUP BY 1")
def r_category(spark, d):
    return profile.shares(t(spark, d, "orders"), "o_orderstatus")


@query("SELECT count(DISTINCT c_name) AS distinct_values, min(c_name) AS sample, count(*) - count(c_name) AS nulls FROM customer")
def r_other(spark, d):
    s = _summaries(spark, t(spark, d, "customer"), {"name": "c_name", "type": "text"})[0][1]
    return spark.createDataFrame([(s["distinct"], s["sample"], s["nulls"])], "distinct_values long, sample string, nulls long")


@query("""SELECT l_returnflag AS "case", count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1
UNION ALL SELECT NULL, count(*), round(avg(l_quantity), 6), round(stddev_pop(l_quantity), 6) FROM lineitem""")
def r_when(spark, d):
    flag = {"name": "l_returnflag", "type": "category", "categories": ["A", "N", "R"]}
    s = _summaries(spark, t(spark, d, "lineitem"), flag, {"name": "l_quantity", "type": "float", "when": {"field": "l_returnflag", "cases": {"A": {"max": 9}, "R": {"max": 8}}}})[1][1]
    rows = [(k, v["count"], round(v["mean"], 6), round(v["std"], 6)) for k, v in {None: s, **s["cases"]}.items()]
    return spark.createDataFrame(rows, "`case` string, n long, mean double, std double")


_TEXTS = {"key": "o_orderkey::VARCHAR", "price": "o_totalprice::VARCHAR", "day": "strftime(o_orderdate, '%Y-%m-%d')", "at": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", "is_open": "CASE o_orderstatus WHEN 'O' THEN '1' ELSE '0' END", "status": "o_orderstatus", "padded": "lpad(o_orderkey::VARCHAR, 9, '0')", "mail": "o_orderstatus || '@x.org'"}
_KIND_SQL = """CASE WHEN '{c}' LIKE 'is%' AND bool_and(x IN ('0', '1')) THEN 'bool' WHEN bool_and(regexp_matches(x, '^[+-]?(0|[1-9][0-9]*)$')) THEN 'int' WHEN bool_and(regexp_matches(x, '^[+-]?(0|[1-9][0-9]*)\\.[0-9]+(e[+-]?[0-9]+)?$')) THEN 'float'
WHEN bool_and(length(x) = 10 AND try_cast(x AS DATE) IS NOT NULL) THEN 'date' WHEN bool_and(length(x) >= 16 AND try_cast(x AS TIMESTAMPTZ) IS NOT NULL) THEN 'datetime' WHEN bool_and(contains(x, '@')) THEN 'email' ELSE 'string' END"""


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {_KIND_SQL.format(c=c)} AS kind FROM (SELECT {x} AS x FROM orders)" for c, x in _TEXTS.items()))
def i_kind_sniff(spark, d):
    k, at, status = F.col("o_orderkey").cast("string"), F.col("o_orderdate"), F.col("o_orderstatus")
    df = t(spark, d, "orders").select(
        k.alias("key"), F.col("o_totalprice").cast("string").alias("price"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.when(status == "O", "1").otherwise("0").alias("is_open"), status.alias("status"), F.lpad(k, 9, "0").alias("padded"), F.concat(status, F.lit("@x.org")).alias("mail"),
    )
    return spark.createDataFrame(list(profile.sniff(df).items()), "field string, kind string")


def _moments_sql(table: str, c: str) -> str:
    return f"SELECT '{c}' AS field, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg(pow((x - m) / s, 3)), 6) AS skew FROM (SELECT {c} AS x, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM {table})"


@query(" UNION ALL ".join(_moments_sql(*x) for x in (("lineitem", "l_quantity"), ("orders", "o_totalprice"), ("events", "value"))))
def i_moments(spark, d):
    return union([t(spark, d, n).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.round(F.skewness(c), 6).alias("skew")).select(F.lit(c).alias("field"), "mean", "std", "skew") for n, c in (("lineitem", "l_quantity"), ("orders", "o_totalprice"), ("events", "value"))])


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n < 78 THEN 'other' ELSE p_brand END AS label, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def i_category_merge(spark, d):
    return profile.merged_labels(t(spark, d, "part"), "p_brand", least=78)


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) AS k FROM c)
SELECT round(-regr_slope(ln(n), ln(k)), 6) AS exponent, count(*) AS points FROM r""")
def i_zipf(spark, d):
    return profile.zipf_exponent(t(spark, d, "orders"), "o_custkey")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def i_spearman(spark, d):
    return profile.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


_FITS = "abs(net - ({e})) <= 0.005000001 + 1e-9 * abs(net)"


@query(f"""WITH r AS (SELECT l_extendedprice AS p, round(l_extendedprice * l_discount, 2) AS rebate FROM lineitem), x AS (SELECT *, round(p - rebate, 2) AS net FROM r)
""" + " UNION ALL ".join(f"SELECT '{name}' AS formula, bool_and({_FITS.format(e=e)}) AS fits FROM x" for name, e in (("l_extendedprice - rebate", "p - rebate"), ("l_extendedprice + rebate", "p + rebate"), ("l_extendedprice * rebate", "p * rebate"), ("rebate - l_extendedprice", "rebate - p"))))
def i_formula(spark, d):
    df = t(spark, d, "lineitem").withColumn("rebate", F.round(F.col("l_extendedprice") * F.col("l_discount"), 2)).withColumn("net", F.round(F.col("l_extendedprice") - F.col("rebate"), 2))
    return profile.formula_fits(df, "net", "l_extendedprice", "rebate", 2)


_PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_custkey", "supplier", "s_suppkey")]


@query(" UNION ALL ".join(f"SELECT '{c}.{f}' AS child, '{p}.{k}' AS parent, (SELECT count(*) FROM {c} WHERE {f} NOT IN (SELECT {k} FROM {p})) AS outside" for c, f, p, k in _PAIRS))
def i_fk_candidates(spark, d):
    return union([orphans(t(spark, d, c).select(f), f, t(spark, d, p), k).agg(F.count("*").alias("outside")).select(F.lit(f"{c}.{f}").alias("child"), F.lit(f"{p}.{k}").alias("parent"), "outside") for c, f, p, k in _PAIRS])


@query("""WITH o AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS used, min(o_orderkey) AS low FROM orders), c AS (SELECT count(*) AS n, min(c_custkey) AS low FROM customer), k AS (SELECT min(n) AS least, count(*) AS used FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))
SELECT 'customer' AS "table", 'cust_id' AS field, 'id' AS type, NULL AS refers, low::VARCHAR AS low, NULL AS high, n AS rows, NULL AS least FROM c
UNION ALL SELECT 'customer', 'balance', 'float', NULL, min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR, count(*), NULL FROM customer
UNION ALL SELECT 'orders', 'order_id', 'id', NULL, low::VARCHAR, NULL, n, NULL FROM o
UNION ALL SELECT 'orders', 'cust_id', 'foreign_key', 'customer.cust_id', NULL, NULL, o.n, CASE WHEN k.used = c.n THEN least(k.least, o.n // c.n) END FROM o, c, k
UNION ALL SELECT 'orders', 'their_balance', 'lookup', 'cust_id', NULL, NULL, n, NULL FROM o
UNION ALL SELECT 'orders', 'day', 'date', NULL, min(o_orderdate)::DATE::VARCHAR, max(o_orderdate)::DATE::VARCHAR, count(*), NULL FROM orders
UNION ALL SELECT 'orders', 'status', 'category', NULL, min(o_orderstatus), max(o_orderstatus), count(*), NULL FROM orders
UNION ALL SELECT 'orders', 'twice', 'formula', 'price * 2.0', NULL, NULL, n, NULL FROM o
UNION ALL SELECT 'orders', 'price', 'float', NULL, printf('%.6g', min(o_totalprice))::DOUBLE::VARCHAR, printf('%.6g', max(o_totalprice))::DOUBLE::VARCHAR, count(*), NULL FROM orders""")
def i_schema(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_acctbal").alias("balance"))
    o = t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("cust_id")).select(
        F.col("o_orderkey").alias("order_id"), "cust_id", F.col("balance").alias("their_balance"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.round(F.col("o_totalprice") * 2, 2).alias("twice")
    )
    found = profile.infer_schema(RawData({"customer": c, "orders": o}, "tables", d)).spec
    rows = []
    for table in found["tables"]:
        for f in table["fields"]:
            formula = f.get("expr", "").removeprefix("round(").removesuffix(", 2)") or None
            low, high = f.get("start", f.get("min")), f.get("end", f.get("max"))
            if f["type"] == "category":
                low, high = min(f["categories"]), max(f["categories"])
            shown = lambda x: None if x is None else str(float(x)) if f["type"] == "float" else str(x)  # noqa: B023, E731
            rows.append((table["name"], f["name"], f["type"], f.get("references", f.get("via", formula)), shown(low), shown(high), table["rows"], f.get("min_per_parent")))
    return spark.createDataFrame(rows, "`table` string, field string, type string, refers string, low string, high string, rows long, least long")


@query("""WITH a AS (SELECT o_orderstatus AS l, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1), b AS (SELECT l_linestatus AS l, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1)
SELECT round(0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 4) AS tvd FROM a FULL JOIN b ON a.l = b.l""")
def i_tvd(spark, d):
    return profile.total_variation(t(spark, d, "orders").select(F.col("o_orderstatus").alias("label")), t(spark, d, "lineitem").select(F.col("l_linestatus").alias("label")))


@query("""WITH n AS (SELECT count(*) AS n FROM customer) SELECT 'uniform' AS field, n, 0 AS outside, true AS centred, true AS wide FROM n UNION ALL SELECT 'normal', n, 0, true, true FROM n UNION ALL SELECT 'exponential', n, 0, true, true FROM n
UNION ALL SELECT 'whole', n, 0, true, true FROM n UNION ALL SELECT 'tied', n, 0, true, true FROM n""")
def g_numeric(spark, d):
    """As many rows as customers; within bounds, with the mean and spread of the distribution (within a tenth), and as correlated as declared."""
    n = t(spark, d, "customer").count()
    base = {"type": "float", "min": 5, "max": 400}
    fields = [{"name": "uniform", **base}, {"name": "normal", **base, "distribution": "normal", "mean": 200, "std": 20}, {"name": "exponential", **base, "distribution": "exponential", "scale": 30}, {"name": "whole", **base, "type": "int", "max": 9}, {"name": "tied", **base, "correlate": {"field": "uniform", "strength": 0.9}}]
    made = generate({"seed": 3, "tables": [{"name": "t", "rows": n, "fields": fields}]}, spark)["t"]
    about = {"uniform": (202.5, 114.0), "normal": (200.0, 20.0), "exponential": (35.0, 30.0), "whole": (7.0, 1.3), "tied": (202.5, 105.0)}
    parts = []
    for f in fields:
        c, (mean, std) = F.col(f["name"]), about[f["name"]]
        close = lambda x, y: F.abs(x - y) <= 0.15 * y
        wide = F.corr("uniform", "tied") > 0.9 if f["name"] == "tied" else close(F.stddev_pop(c), F.lit(std))
        parts.append(made.agg(F.count(c).alias("n"), F.count(F.when(~c.between(f["min"], f["max"]), 1)).alias("outside"), close(F.avg(c), F.lit(mean)).alias("centred"), wide.alias("wide")).select(F.lit(f["name"]).alias("field"), "n", "outside", "centred", "wide"))
    return union(parts)


@query("""SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1""")
def g_quota(spark, d):
    """Labels drawn by the segments' counts as weights have exactly these counts."""
    counts = {r[0]: r["n"] for r in t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy("c_mktsegment").collect()}
    made = generate({"seed": 9, "tables": [{"name": "t", "rows": sum(counts.values()), "fields": [{"name": "label", "type": "category", "categories": counts}]}]}, spark)["t"]
    return made.groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), c AS (SELECT count(*) AS c FROM customer) SELECT n AS rows, n * (n + 1) // 2 AS key_sum, c AS parents, n // c >= 2 AS twice, 0 AS differ, c AS once, 0 AS early FROM n, c""")
def g_fk_lookup(spark, d):
    """Keys, foreign keys (two children at least, or one), copies and orders in time of generated tables of the sizes of customer and orders."""
    c, o = t(spark, d, "customer").count(), t(spark, d, "orders").count()
    parent = {"name": "p", "rows": c, "fields": [{"name": "k", "type": "id"}, {"name": "v", "type": "float", "max": 99}, {"name": "since", "type": "date"}]}
    child = {"name": "c", "rows": o, "fields": [{"name": "id", "type": "id"}, {"name": "fk", "type": "foreign_key", "references": "p.k", "min_per_parent": 2, "skew": "zipf"}, {"name": "copy", "type": "lookup", "via": "fk", "column": "v"}, {"name": "at", "type": "date", "after": "fk.since"}]}
    one = {"name": "o", "rows": c, "fields": [{"name": "fk", "type": "foreign_key", "references": "p.k", "unique": True}]}
    made = generate({"seed": 4, "tables": [parent, child, one]}, spark)
    both = made["c"].join(made["p"], F.col("fk") == F.col("k"))
    counts = made["c"].groupBy("fk").agg(F.count("*").alias("m")).agg(F.count("*").alias("parents"), (F.min("m") >= 2).alias("twice"))
    sums = both.agg(F.count("*").alias("rows"), F.sum("id").alias("key_sum"), F.count(F.when(F.col("copy") != F.col("v"), 1)).alias("differ"), F.count(F.when(F.col("at") < F.col("since"), 1)).alias("early"))
    once = made["o"].join(made["p"], F.col("fk") == F.col("k")).agg(F.count_distinct("fk").alias("once"))
    return sums.crossJoin(counts).crossJoin(once)


@query("""SELECT count(*) AS rows, 0 AS later, 1 <= count(*) AS rooted, 366 AS days, DATE '1996-01-01' AS first, DATE '1996-12-31' AS last, count(*) AS mails FROM part""")
def g_tree_and_dates(spark, d):
    """A generated tree as large as part, dates over a whole year, unique addresses."""
    n = t(spark, d, "part").count()
    fields = [{"name": "id", "type": "id"}, {"name": "up", "type": "foreign_key", "references": "t.id", "null_rate": 0.05}, {"name": "day", "type": "date", "start": "1996-01-01", "end": "1996-12-31"}, {"name": "who", "type": "name"}, {"name": "mail", "type": "email", "depends_on": "who", "unique": True}]
    made = generate({"seed": 5, "tables": [{"name": "t", "rows": n, "fields": fields}]}, spark)["t"]
    return made.agg(F.count("*").alias("rows"), F.count(F.when(F.col("up") >= F.col("id"), 1)).alias("later"), (F.count(F.when(F.col("up").isNull(), 1)) >= 1).alias("rooted"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"), F.count_distinct("mail").alias("mails"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, floor((l_quantity - 25) / 7)::DOUBLE AS floordiv, l_quantity - 25 - 7 * floor((l_quantity - 25) / 7) AS modulo, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_discount > 0.05 THEN l_tax ELSE l_discount + 0.0 END AS chosen FROM lineitem""")
def f_arithmetic(spark, d):
    df = t(spark, d, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "R", F.lit(1)))
    kinds = dict(df.dtypes)
    make = lambda s: Formula(s).compile(kinds).col
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", make("(l_quantity - 25) // 7").alias("floordiv"), make("(l_quantity - 25) % 7").alias("modulo"), make("(l_tax if l_discount > 0.05 else l_discount + 0.0) if flag == 1 else 0.0").alias("chosen"))


@query("""SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, (isodow(o_orderdate) - 1)::BIGINT AS w, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS days, o_totalprice > 1000 AND o_orderstatus = 'F' AS both, upper(o_orderstatus) || '-' AS tag FROM orders""")
def f_dates(spark, d):
    df = t(spark, d, "orders")
    kinds = dict(df.dtypes)
    make = lambda s: Formula(s).compile(kinds).col
    return df.select("o_orderkey", make("year(o_orderdate)").alias("y"), make("weekday(o_orderdate)").alias("w"), make("days_between(o_orderdate, '1999-01-01')").alias("days"), make("o_totalprice > 1000 and o_orderstatus == 'F'").alias("both"), make("o_orderstatus + '-'").alias("tag"))


@query("""SELECT event_id, least(value, 50.0) AS low, CASE WHEN nullif(event_type, 'click') IS NULL THEN NULL ELSE greatest(value, 10.0) END AS high, coalesce(nullif(event_type, 'click'), 'none') AS kind, floor(sqrt(value))::BIGINT AS root FROM events""")
def f_nulls(spark, d):
    df = t(spark, d, "events").withColumn("k", F.nullif("event_type", F.lit("click")))
    df = df.withColumn("v", F.when(F.col("k").isNotNull(), F.col("value")))
    kinds = dict(df.dtypes)
    make = lambda s: Formula(s).compile(kinds).col
    return df.select("event_id", make("min(value, 50.0)").alias("low"), make("max(v, 10.0)").alias("high"), make("coalesce(k, 'none')").alias("kind"), make("floor(sqrt(value))").alias("root"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(0, (180 * ceil(greatest(0, len(w) - 220) / 180.0))::BIGINT, 180)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i // 180 AS pos, len(w[i + 1:i + 220]) AS n_words, md5(array_to_string(w[i + 1:i + 220], ' ')) AS digest FROM s""")
def t_chunk(spark, d):
    df = t(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("pos", "chunk"))
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size(F.split("chunk", " ")).cast("long").alias("n_words"), F.md5("chunk").alias("digest"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY doc_id) AS k FROM documents WHERE trim(text) <> '') WHERE k = 1""")
def t_exact_dedup(spark, d):
    return dedup.exact(t(spark, d, "documents"), "text", "doc_id").select("doc_id")


_SHINGLES = "(SELECT {id} AS id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM (SELECT {id}, regexp_split_to_array(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM {table} WHERE trim(text) <> ''))"


@query(f"""WITH a AS {_SHINGLES.format(id='doc_id', table='documents')}, e AS (SELECT id, len(s) AS n, unnest(s) AS g FROM a),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(k / (na + nb - k), 9) AS similarity FROM p WHERE k / (na + nb - k) >= 0.8""")
def t_lexical_pairs(spark, d):
    return dedup.lexical_pairs(t(spark, d, "documents"), "text", "doc_id", least=0.8)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def t_cosine_pairs(spark, d):
    return dedup.cosine_pairs(t(spark, d, "embeddings"), "embedding", "vec_id", "label", least=0.3)


_TASKS = "(SELECT CASE WHEN turn % 10 = 3 THEN '' ELSE text END AS text, CASE WHEN turn > 40 THEN 'late' ELSE role END AS label FROM conversations)"


@query(f"""WITH c AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM {_TASKS}), n AS (SELECT label, count(*) AS n FROM c GROUP BY 1), r AS (
SELECT 'record_count' AS name, 0 AS n_bad, (SELECT count(*) FROM c) > 0 AS passed UNION ALL SELECT 'required_fields', (SELECT count(*) FROM c WHERE text IS NULL OR trim(text) = ''), NULL
UNION ALL SELECT 'label_set', (SELECT coalesce(sum(n), 0) FROM n WHERE label NOT IN ('user', 'assistant')), NULL
UNION ALL SELECT 'quota', (SELECT count(*) FROM (VALUES ('user', 100), ('assistant', 7)) q(l, k) WHERE coalesce((SELECT n FROM n WHERE label = l), 0) <> k), NULL
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM c) - (SELECT count(*) FROM (SELECT DISTINCT label, norm FROM c)), NULL)
SELECT name, n_bad::BIGINT AS n_bad, coalesce(passed, n_bad = 0) AS passed FROM r""")
def t_records(spark, d):
    c = t(spark, d, "conversations").select(F.when(F.col("turn") % 10 == 3, "").otherwise(F.col("text")).alias("text"), F.when(F.col("turn") > 40, "late").otherwise(F.col("role")).alias("label"))
    report = records.validate_records(c, "classification", quotas={"user": 100, "assistant": 7})
    return report.frame(spark).select("name", "n_bad", "passed")


@query("""WITH c AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT 'quota' AS name, count(*) FILTER (n <> 100)::BIGINT AS n_bad FROM c""")
def t_quota_shortfall(spark, d):
    df = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("text", F.col("quality").cast("string").alias("label"))
    return records.validate_records(df, "classification", quotas={"0": 100, "1": 100}).frame(spark).where("name = 'quota'").select("name", "n_bad")


@query("""SELECT doc_id, md5('Give the label of the text.') AS lead, CASE WHEN lang IS NULL THEN NULL ELSE md5(coalesce(text, '')) END AS asked, md5(coalesce(lang, '')) AS said FROM documents WHERE lang IS NOT NULL""")
def t_chat_reshape(spark, d):
    df = t(spark, d, "documents").where("lang is not null").select("doc_id", "text", F.col("lang").alias("label"))
    said = lambda i: F.md5(F.coalesce(F.col("messages")[i]["content"], F.lit("")))
    return chat_messages(df, keep=["doc_id"]).select("doc_id", said(0).alias("lead"), said(1).alias("asked"), said(2).alias("said"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def t_json_extract(spark, d):
    """The object within prose, in a fence, or alone, as a model would give it."""

    def run(batches):
        for batch in batches:
            got = [int(as_text(extract_json(x), ("k",))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["event_id", "k"])

    id_, props = F.col("event_id"), F.col("props")
    reply = F.when(id_ % 3 == 0, F.concat(F.lit("Sure [as asked]: "), props, F.lit(" Bye."))).when(id_ % 3 == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(props)
    return t(spark, d, "events").select("event_id", reply.alias("reply")).mapInArrow(run, "event_id long, k long")


@query("""SELECT conv_id, turn, role, sha256('{"op":"chat","payload":{"max_tokens":8,"prompt":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}}') AS key FROM conversations""")
def t_request_key(spark, d):
    def run(batches):
        for batch in batches:
            keys = [request_key("chat", {"turn": n, "prompt": r, "max_tokens": 8}) for n, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], ["conv_id", "turn", "role", "key"])

    return t(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role").mapInArrow(run, "conv_id long, turn long, role string, key string")
