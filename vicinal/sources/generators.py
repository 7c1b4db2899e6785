"""Synthetic vectors, labels, points and queries, reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.schema import DIM

#: What the dimension of the merchant category takes, and the least values of the three that make a label.
RISKS = (1500, 2000, 2500, 3000, 3500, 4500, 5000, 7500, 8000, 8500)


def _uniform(seed: int, *what) -> Column:
    """Uniform in [0, 1) from a hash of id, independent of partitioning."""
    return F.pmod(F.xxhash64("id", *map(F.lit, what), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def vectors(spark: SparkSession, n: int, seed: int = 42, kind: str = "float") -> DataFrame:
    """(id, vec): uniform in [0, 1) as float, or of 8 bits from -127 on."""
    make = {"float": lambda x: x.cast("float"), "int8": lambda x: (F.floor(x * 254) - 127).cast("tinyint")}[kind]
    return spark.range(n).select("id", F.array(*[make(_uniform(seed, i)) for i in range(DIM)]).alias("vec"))


def labels(spark: SparkSession, n: int, rate: float = 0.05, seed: int = 7) -> DataFrame:
    return spark.range(n).select("id", (_uniform(seed) < rate).cast("int").alias("label"))


def points(spark: SparkSession, n: int, seed: int = 1, clustered: bool = True) -> DataFrame:
    """(ref_id, q0..q13, label): flags, few risks, a fifth without a last transaction; clustered ones are like a fraud or like the rest.

    The label goes by three dimensions, a tenth of them at random.
    """
    u = lambda *w: _uniform(seed, *w)
    fraud = u("kind") < 0.3
    q = []
    for i in range(DIM):
        x = u(i)
        wide = F.floor(x * 10001)
        if i in (9, 10, 11):
            v = F.when(x < 0.5, 10000).otherwise(0)
        elif i == 12:
            v = F.element_at(F.array(*map(F.lit, RISKS)), (F.floor(x * len(RISKS)) + 1).cast("int"))
        elif clustered and i in (0, 1, 2, 7, 8):
            v = F.when(fraud, 4000 + F.floor(x * 6001)).otherwise(F.floor(x * 2500))
        else:
            v = wide
        if i in (5, 6):
            v = F.when(u("last") < 0.2, -10000).otherwise(v)
        q.append(v.cast("smallint").alias(f"q{i}"))
    d = spark.range(n).select("id", *q, u("noise").alias("_noise"), u("coin").alias("_coin"))
    score = (F.col("q0") > 2000).cast("int") + (F.col("q8") > 3000).cast("int") + (F.col("q11") > 0).cast("int")
    label = F.when(F.col("_noise") < 0.1, (F.col("_coin") < 0.5).cast("int")).otherwise((score >= 2).cast("int"))
    return d.select(F.col("id").alias("ref_id"), *[f"q{i}" for i in range(DIM)], label.alias("label"))


def queries(refs: DataFrame, n: int, seed: int = 9) -> DataFrame:
    """(query_id, q0..q13): ref_ids are 0 to their count; a third are copies of references, a third are up to 100 off (not in dimensions 5 and 6), a third are new."""
    spark = refs.sparkSession
    many = refs.count()
    base = spark.range(n).withColumn("ref_id", F.col("id") % max(many, 1)).join(refs.select("ref_id", *[f"q{i}" for i in range(DIM)]), "ref_id").drop("ref_id")
    off = lambda i: (F.floor(_uniform(seed, "off", i) * 201) - 100).cast("int")
    near = [F.when((F.col("id") % 3 == 1) & F.lit(i not in (5, 6)), F.greatest(F.lit(-10000), F.least(F.lit(10000), F.col(f"q{i}") + off(i)))).otherwise(F.col(f"q{i}")).cast("smallint").alias(f"q{i}") for i in range(DIM)]
    old = base.filter("id % 3 < 2").select(F.col("id").alias("query_id"), *near)
    new = points(spark, n, seed).filter("ref_id % 3 = 2").select(F.col("ref_id").alias("query_id"), *[f"q{i}" for i in range(DIM)])
    return old.unionByName(new)
