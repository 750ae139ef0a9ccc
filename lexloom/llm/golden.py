"""Golden records: one surviving record a cluster, every field chosen by its own rule.

Records are unpivoted to long rows (cluster, field, part, priority and value as one struct); one generic groupBy takes
the least struct of every field, combined before the shuffle, and the fields are pivoted back. The balance depends on the
chosen segment: its rows are kept apart by segment (``part``), and after the segment is known the chosen segment's best
balance is looked up by (cluster, segment), else the best of all its segments is taken. No step gathers a cluster: a
record learns its cluster's latest time through (cluster, lane) rows, of which a cluster has as many as it has lanes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Sources by falling trust; any other source, and none, is trusted least.
TRUST = ["crm", "web", "store", "partner"]
#: A record this much older than its cluster's latest is stale.
STALE = "INTERVAL 1440 HOURS"
#: Characters that make up blank strings.
BLANK = " \t\n\x0b\f\r"
COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
_KEY = ["cluster_id", "field", "part"]


def filled(text: Column) -> Column:
    """The string as it is, null if it is empty or blank."""
    return F.when(F.btrim(text, F.lit(BLANK)) != "", text)


def tagged(records: DataFrame) -> DataFrame:
    """Records with cluster_id, blank strings as null, trust (0 is highest), age behind the cluster's latest (null without a time), stale."""
    spark = records.sparkSession
    rows = records.select(
        F.coalesce("master_id", "client_id").alias("cluster_id"), "client_id", "updated_at", *[filled(F.col(c)).alias(c) for c in ("source", "name", "email", "city", "segment")], "nation_id", "balance"
    )
    trust = reduce(lambda found, s: F.when(F.col("source") == s[1], s[0]).otherwise(found), enumerate(TRUST), F.lit(len(TRUST)))
    # As many lanes as the job has partitions: a large cluster's records spread over all of them.
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("trust", trust).withColumn("lane", F.pmod(F.xxhash64("client_id", "updated_at", "name", "email"), F.lit(lanes)))
    by_lane = rows.groupBy("cluster_id", "lane").agg(F.max("updated_at").alias("latest"))
    latest = by_lane.groupBy("cluster_id").agg(F.max("latest").alias("latest"))
    by_lane, latest = by_lane.drop("latest").alias("l"), latest.alias("t")
    known = by_lane.join(latest, F.col("l.cluster_id").eqNullSafe(F.col("t.cluster_id"))).select(F.col("l.cluster_id").alias("_cluster"), F.col("lane").alias("_lane"), "latest")
    rows = rows.join(known, F.col("cluster_id").eqNullSafe(F.col("_cluster")) & (F.col("lane") == F.col("_lane")))
    rows = rows.withColumn("age", F.col("latest") - F.col("updated_at"))
    return rows.withColumn("stale", F.col("age").isNull() | (F.col("age") > F.expr(STALE))).drop("_cluster", "_lane", "lane", "latest", "updated_at")


def _candidate(field: str, has: Column, lead: Column, trusted: bool, text: Column, number: Column, nation: Column, part: Column) -> Column:
    """A long row of one field, null where the record has nothing to offer. The struct's order is the order of preference."""
    recent = [F.col("age").isNull().alias("undated"), F.col("age").alias("age"), F.col("trust").alias("trust"), F.col("client_id").isNull().alias("unnamed"), F.col("client_id").alias("client_id")]
    fresh, first = (F.col("stale"), F.col("trust")) if trusted else (F.lit(False), F.lit(0))
    best = F.struct(lead.cast("long").alias("lead"), fresh.alias("stale"), first.alias("by_trust"), *recent, text.alias("text"), number.alias("number"), nation.alias("nation"))
    return F.when(has, F.struct(F.lit(field).alias("field"), part.alias("part"), best.alias("best")))


def long_rows(rows: DataFrame) -> DataFrame:
    """(cluster_id, field, part, best) for every value that a record of ``tagged`` can give."""
    text, number, nation = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")
    city, nation_id = F.col("city"), F.col("nation_id").cast("long")
    known = city.isNotNull().cast("int") + nation_id.isNotNull().cast("int")
    fields = [
        _candidate("segment", F.col("segment").isNotNull(), F.lit(0), False, F.col("segment"), number, nation, text),
        _candidate("email", F.col("email").isNotNull(), F.lit(0), True, F.col("email"), number, nation, text),
        _candidate("name", F.col("name").isNotNull(), -F.length("name"), True, F.col("name"), number, nation, text),
        _candidate("address", known > 0, -known, True, city, number, nation_id, text),
        _candidate("balance", F.col("balance").isNotNull(), F.lit(0), False, text, F.col("balance"), nation, F.col("segment")),
    ]
    found = rows.select("cluster_id", F.explode(F.array_compact(F.array(*fields))).alias("row"))
    return found.select("cluster_id", "row.field", "row.part", "row.best")


def survivors(records: DataFrame) -> DataFrame:
    """One golden record a cluster: cluster_id, n_records, n_stale, the chosen fields and who gave them, balance as given.

    ``records`` holds COLUMNS; other columns are ignored. cluster_id is master_id, else client_id; rows without either are
    one cluster of id null. Strings that are empty or blank count as null, others stay as they are. Without a time a record
    is stale and last of the recent ones; sources beyond TRUST come last; client_id null comes last. Repeated rows count one
    by one; rows that tie in every rule (repeated client ids) give the least value. A field that no record has is
    null, and so is its ``_from``. An empty table gives no rows.
    """
    rows = materialise(tagged(records.select(COLUMNS)), "golden_rows")
    best = materialise(long_rows(rows).groupBy(*_KEY).agg(F.min("best").alias("best")), "golden_best")
    counts = rows.groupBy("cluster_id").agg(F.count("*").alias("n_records"), F.count(F.when(F.col("stale"), 1)).alias("n_stale"))

    # Pivot back: one row a (cluster, field), but several of balance, of which the least is the best of any segment.
    fields = ("segment", "email", "name", "address", "balance")
    wide = best.groupBy("cluster_id").agg(*[F.min(F.when(F.col("field") == f, F.col("best"))).alias(f) for f in fields])
    of_segment = best.where("field = 'balance'").select(F.col("cluster_id").alias("_cluster"), F.col("part").alias("_part"), F.col("best").alias("of_segment"))
    chosen = F.col("cluster_id").eqNullSafe(F.col("_cluster")) & F.col("segment.text").eqNullSafe(F.col("_part"))
    wide = wide.join(of_segment, chosen, "left").withColumn("balance", F.coalesce("of_segment", "balance"))
    wide = wide.select(F.col("cluster_id").alias("_cluster"), *fields)
    joined = counts.join(wide, F.col("cluster_id").eqNullSafe(F.col("_cluster")), "left")
    return joined.select(
        "cluster_id",
        "n_records",
        "n_stale",
        *[F.col(f"{f}.text").alias(f) for f in ("name", "email", "segment")],
        F.col("address.text").alias("city"),
        F.col("address.nation").cast(records.schema["nation_id"].dataType).alias("nation_id"),
        F.col("balance.number").alias("balance"),
        *[F.col(f"{f}.client_id").alias(f"{f}_from") for f in ("name", "email", "segment", "balance", "address")],
    )

