"""Payload-shaped rows from the order tables, for queries over them: every order is a transaction of its customer at a merchant.

The shape is ours, made to exercise the operators; all its numbers come from keys and cents, so any engine gets the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.functions.features import MCC_RISK, part_key, quantized, vectorize
from vicinal.schema import DIM
from vicinal.sources.interim import small_methods, written

#: Merchants go round the categories, and one that has no risk of its own.
CATEGORIES = [*MCC_RISK, "0000"]
#: Orders are rare: the count of a customer's latest transactions looks back so many seconds.
LOOK_BACK = 400 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, payload columns, label) for each order that has items; label is 1 for status F."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", _cents("o_totalprice").alias("cents"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("day"))
    items = lines.groupBy("l_orderkey").agg(F.count("*").alias("items"), F.min("l_suppkey").alias("supp"))
    merchants = lines.groupBy(F.col("l_suppkey").alias("supp")).agg((F.sum(_cents("l_extendedprice")) / F.count("*") / 1000.0).alias("m_avg"))
    customers = orders.groupBy("o_custkey").agg((F.sum("cents") / F.count("*") / 6000.0).alias("c_avg"))
    o = orders.join(items, orders["o_orderkey"] == items["l_orderkey"]).join(merchants, "supp").join(customers, "o_custkey")
    o = o.withColumn("at", F.col("day") + F.col("o_orderkey") % 86400)
    by_time = Window.partitionBy("o_custkey").orderBy("at", "o_orderkey")
    recent = Window.partitionBy("o_custkey").orderBy("at").rangeBetween(-LOOK_BACK, 0)
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    o = o.withColumns({"last_at": F.lag("at").over(by_time), "recent": F.count("*").over(recent), "known": F.collect_set(F.concat(F.lit("m"), F.col("supp").cast("string"))).over(earlier)})
    iso = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mcc = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("supp") % len(CATEGORIES) + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("id"),
        F.struct((F.col("cents") / 6000.0).alias("amount"), F.col("items").alias("installments"), iso(F.col("at")).alias("requested_at")).alias("transaction"),
        F.struct(F.col("c_avg").alias("avg_amount"), F.col("recent").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.concat(F.lit("m"), F.col("supp").cast("string")).alias("id"), mcc.alias("mcc"), F.col("m_avg").alias("avg_amount")).alias("merchant"),
        F.struct((F.col("supp") % 2 == 1).alias("is_online"), (F.col("supp") % 3 != 0).alias("card_present"), (F.col("o_custkey") * 37 % 1500 * 0.7).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_at").isNotNull(), F.struct(iso(F.col("last_at")).alias("timestamp"), (F.col("o_orderkey") * 13 % 1200 * 0.9).alias("km_from_current"))).alias("last_transaction"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, label, v0..v13)."""
    return vectorize(payloads(spark, sf_dir), keep=("query_id", "label"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, label, q0..q13, part_key): all orders."""
    return quantized(vectors(spark, sf_dir)).withColumnRenamed("query_id", "ref_id").withColumn("part_key", part_key())


def queries_of(refs: DataFrame) -> DataFrame:
    """(query_id, q0..q13): the search's stated set, every reference whose id is divisible by 20."""
    return refs.filter("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"), *[f"q{i}" for i in range(DIM)])


def built(df: DataFrame, name: str) -> DataFrame:
    """``written``, for what is made of payloads."""
    with small_methods(df.sparkSession):
        return written(df, name)


def search_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, queries) of a table that is built once."""
    refs = built(references(spark, sf_dir), "references")
    return refs, queries_of(refs)


#: The same as SQL: common tables t (payload fields), v (vectors) and q (quantized).
SQL = """
items as (select l_orderkey, count(*) as items, min(l_suppkey) as supp from lineitem group by 1),
merchants as (select l_suppkey as supp, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 1000.0::DOUBLE as m_avg from lineitem group by 1),
o as (select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100)::BIGINT as cents, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 as at_ from orders),
customers as (select o_custkey, sum(cents)::DOUBLE / count(*) / 6000.0::DOUBLE as c_avg from o group by 1),
t as (select o.*, items, supp, m_avg, c_avg, lag(at_) over (partition by o_custkey order by at_, o_orderkey) as last_at,
  count(*) over (partition by o_custkey order by at_ range between {look_back} preceding and current row) as recent,
  list(supp) over (partition by o_custkey order by at_, o_orderkey rows between unbounded preceding and 1 preceding) as known,
  [{categories}][(supp % {n} + 1)::INT] as mcc
  from o join items on o_orderkey = l_orderkey join merchants using (supp) join customers using (o_custkey)),
r(mcc, risk) as (values {risks}),
v as (select o_orderkey as query_id, (o_orderstatus = 'F')::INT as label,
  least(greatest(cents / 6000.0::DOUBLE / 10000, 0), 1) as v0,
  least(items::DOUBLE / 12, 1) as v1,
  case when c_avg = 0 then case when cents > 0 then 1.0 else 0.0 end else least(cents / 6000.0::DOUBLE / c_avg / 10, 1) end::DOUBLE as v2,
  hour(make_timestamp(at_ * 1000000))::DOUBLE / 23 as v3,
  (isodow(make_timestamp(at_ * 1000000)) - 1)::DOUBLE / 6 as v4,
  case when last_at is null then -1.0 else least((at_ - last_at)::DOUBLE / 60 / 1440, 1) end::DOUBLE as v5,
  case when last_at is null then -1.0 else least((o_orderkey * 13 % 1200)::DOUBLE * 0.9::DOUBLE / 1000, 1) end::DOUBLE as v6,
  least((o_custkey * 37 % 1500)::DOUBLE * 0.7::DOUBLE / 1000, 1) as v7,
  least(recent::DOUBLE / 20, 1) as v8,
  (supp % 2 = 1)::INT::DOUBLE as v9,
  (supp % 3 != 0)::INT::DOUBLE as v10,
  case when coalesce(list_contains(known, supp), false) then 0.0 else 1.0 end::DOUBLE as v11,
  coalesce(risk, {other})::DOUBLE as v12,
  least(m_avg / 10000, 1) as v13
  from t left join r using (mcc)),
q as (select query_id, label, {quantized} from v),
k as (select *, (case when q5 >= 0 then 1 else 0 end + case when q9 > 0 then 2 else 0 end + case when q10 > 0 then 4 else 0 end + case when q11 > 0 then 8 else 0 end
  + case when q12 <= 2047 then 0 when q12 <= 4095 then 16 when q12 <= 6143 then 32 else 48 end + case when q2 > 4096 then 64 else 0 end + case when q8 > 2048 then 128 else 0 end)::INT as part_key from q)
""".format(
    look_back=LOOK_BACK, categories=", ".join(f"'{c}'" for c in CATEGORIES), n=len(CATEGORIES), risks=", ".join(f"('{m}', {r}::DOUBLE)" for m, r in MCC_RISK.items()), other=0.5,
    quantized=", ".join(f"case when v{i} <= -1 then -10000 when v{i} >= 1 then 10000 else round(v{i} * 10000) end::INT as q{i}" for i in range(14)),
)
