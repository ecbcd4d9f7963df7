"""The supplied test tables read as the logical tables of the operators.

Every binding has two forms: a DataFrame here, and the same definition as a
common table expression (`CTES`) for the paired check query.
Joins are added only for the columns a caller asks for.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import semantics as s
from tidemark.plans.session import salted_join

# Fixed values of the bindings.
CHANNELS = ["Email", "Google Ads", "Instagram", "Mobile App", "Partner Agency", "Referral",
            "TikTok", "Walk-in", "Website", "WhatsApp", "Radio"]
TIERS = {"AUTOMOBILE": "Bronze", "BUILDING": "Diamond", "FURNITURE": "Gold",
         "HOUSEHOLD": "Platinum", "MACHINERY": "Silver"}
METHODS = ["Transfer", "Card", "Wallet", "Cash"]
PACKAGE_TYPES = ["City", "Beach", "Nature", "Culture", "Family"]
CAMPAIGN_TYPES = ["Loyalty Points", "Instagram", "Google Ads", "Influencer", "WhatsApp"]
# One opening sentence per question row, so the tagging rules have something to find.
OPENINGS = [
    "Berapa ramalan omzet untuk minggu depan?",
    "Mengapa pelanggan lama berhenti memesan dan apa strategi yang sebaiknya dipakai?",
    "Berapa jumlah pesanan tadi pagi?",
    "Siapa juara liga musim lalu?",
    "halo",
    "terima kasih",
    "Show the monthly revenue trend for january 2023 to march 2023",
    "top 7 destinasi terlaris tahun 2021 dan 2022",
    "Forecast pendapatan kanal agen untuk februari 2024",
    "3 hotel terbaik dan penerbangan yang paling ramai",
    "Which discount did we give in 2022, 12,5% or 15%?",
    "Bagaimana distribusi segmen pelanggan berisiko dari kota ini?",
    "Review sentiment and rating breakdown please",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def bookings(spark: SparkSession, sf_dir: str, customer: bool = False, destination: bool = False,
             repeat: bool = False, discount: bool = False) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = orders.select(
        key.alias("booking_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("booking_date"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total_price_idr"),
        F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Confirmed")
        .otherwise("Cancelled").alias("status"),
        F.when(key % 10 == 0, "Unpaid").when(key % 10 == 1, "Refunded").otherwise("Paid").alias("payment_status"),
        F.col("o_orderpriority").alias("channel"),
        pick(METHODS, key).alias("payment_method"),
        pick(PACKAGE_TYPES, key).alias("package_type"),
        F.when(key % 3 != 0, key % 20).alias("campaign_id"),
        (key % 50).alias("agent_id"),
        (key % 6 + 1).cast("int").alias("pax_count"),
        (key % 9 + 1).cast("int").alias("nights"),
    )
    if customer or destination:
        people = read(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"), "c_nationkey",
        )
        rows = rows.join(people, "customer_id", "left")
        if destination:
            nation = read(spark, sf_dir, "nation").select(
                F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destination_name"))
            rows = rows.join(nation, "c_nationkey", "left")
        rows = rows.drop("c_nationkey")
    if repeat:
        firsts = orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.min("o_orderdate").alias("first_date"))
        rows = salted_join(rows, firsts, ["customer_id"], "booking_id").withColumn(
            "is_repeat_customer", F.col("booking_date") > F.col("first_date")).drop("first_date")
    if discount:
        given = F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(5,2)")
        per_order = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("booking_id")).agg(
            F.round(F.sum(given), 2).cast("double").alias("discount_idr"))
        rows = rows.join(per_order, "booking_id", "left")
    return rows


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment and destination of every customer."""
    nation = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destination_name"))
    return read(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_segment"), "destination_name")


def first_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each customer's first booking."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.min("o_orderdate").alias("first_date"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and segment of every customer."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("customer_segment"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booking lines with a travel date."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left").select(
        F.col("l_orderkey").alias("booking_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("booking_date"), F.col("l_shipdate").alias("travel_date"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, rate = F.col("l_extendedprice").cast("decimal(18,2)"), "decimal(5,2)"
    amount = price * (1 - F.col("l_discount").cast(rate)) * (1 + F.col("l_tax").cast(rate))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("booking_id"),
        F.when(F.col("l_linestatus") == "F", "Success").otherwise("Failed").alias("status"),
        F.col("l_returnflag").alias("payment_method"),
        F.round(amount, 2).cast("double").alias("amount_idr"),
        F.when(F.col("l_returnflag") == "R", "Refund").otherwise("Payment").alias("type"),
        F.col("l_shipdate").alias("transaction_date"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rollup = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("join_date"), F.max("o_orderdate").alias("last_purchase_date"),
        F.count(F.lit(1)).alias("total_trips"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_spent_idr"))
    nation = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    tier = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return (
        read(spark, sf_dir, "customer").join(rollup, "c_custkey", "left").join(nation, "c_nationkey", "left")
        .select(
            key.alias("customer_id"),
            F.concat(F.lit("CUST-"), F.lpad(key.cast("string"), 6, "0")).alias("customer_code"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("c"), (key % 997).cast("string"), F.lit("@mail"), (key % 7).cast("string"),
                     F.lit(".example.com")).alias("email"),
            (key % 50 + 18).cast("int").alias("age"),
            s.age_band(key % 50 + 18).alias("age_group"),
            "city",
            tier[F.col("c_mktsegment")].alias("segment"),
            pick(CHANNELS, key).alias("acquisition_channel"),
            "join_date", "last_purchase_date", "total_trips", "total_spent_idr",
            (F.col("total_trips") > 1).alias("is_repeat_customer"),
        )
    )


def reviews(spark: SparkSession, sf_dir: str, destination: bool = False) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rating = k % 5 + 1
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("review_id"), F.col("user_id").alias("customer_id"),
        rating.alias("rating"), s.rating_sentiment(rating).alias("sentiment"), F.col("ts").alias("review_date"),
        F.struct((F.col("event_id") % 5 + 1).cast("int").alias("value_for_money")).alias("aspects"),
    )
    if destination:
        people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
        nation = read(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destination_name"))
        rows = rows.join(people, "customer_id", "left").join(nation, "c_nationkey", "left").drop("c_nationkey")
    return rows


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    code = F.get_json_object("props", "$.k").cast("int") % 20
    grouped = read(spark, sf_dir, "events").groupBy(code.alias("code")).agg(
        F.min("ts").alias("start_date"), F.count_distinct("user_id").alias("reach"),
        F.count_if(kind == "view").alias("impressions"), F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("conversions"),
        s.money_sum("value", kind == "purchase").alias("revenue_generated_idr"))
    spend = F.col("impressions") / 10.0
    return grouped.select(
        F.concat(F.lit("CMP-"), F.lpad(F.col("code").cast("string"), 3, "0")).alias("campaign_code"),
        F.concat(F.lit("Campaign "), F.col("code").cast("string")).alias("name"),
        pick(CAMPAIGN_TYPES, F.col("code")).alias("type"), "start_date", "reach", "impressions", "clicks",
        "conversions", "revenue_generated_idr", spend.alias("spend_idr"),
        F.round(F.try_divide(F.col("revenue_generated_idr") - spend, spend), 6).alias("roi"),
        F.round(F.try_divide(F.col("conversions"), F.col("clicks")), 6).alias("conversion_rate"),
    )


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").join(region, "n_regionkey", "left").select(
        F.col("n_name").alias("name"), "region", ((key * 7 % 100) / 1.0).alias("popularity_score"),
        (key % 20 / 10.0 + 3).alias("avg_rating"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("total_bookings"))
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").join(sold, "p_partkey", "left").select(
        F.concat(F.lit("PKG-"), F.lpad(key.cast("string"), 6, "0")).alias("package_code"),
        F.col("p_name").alias("name"), F.concat(F.lit("NATION_"), (key % 25).cast("string")).alias("destination_name"),
        F.col("p_type").alias("type"), F.col("p_size").cast("int").alias("nights"),
        F.col("p_retailprice").alias("price_per_pax_idr"), (key % 40 / 10.0 + 1).alias("rating"),
        F.coalesce("total_bookings", F.lit(0)).alias("total_bookings"))


def hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    nation = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("destination_name"))
    return read(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select(
        F.concat(F.lit("HTL-"), F.lpad(key.cast("string"), 6, "0")).alias("hotel_code"),
        F.col("s_name").alias("name"), "destination_name", (key % 5 + 1).cast("int").alias("star_rating"),
        (key * 7 % 50 / 10.0).alias("rating"), (key * 3).alias("total_reviews"),
        F.col("s_acctbal").alias("commission_rate"))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation routes."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    makers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    names = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    routes = (
        lines.join(makers, lines.l_suppkey == makers.s_suppkey).join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(people, orders.o_custkey == people.c_custkey)
        .groupBy("s_nationkey", "c_nationkey")
        .agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    )
    return (
        routes.join(names.toDF("s_nationkey", "origin"), "s_nationkey")
        .join(names.toDF("c_nationkey", "destination"), "c_nationkey")
        .select(
            F.concat("origin", F.lit(">"), "destination").alias("flight_code"),
            F.concat(F.lit("AIR-"), (F.col("s_nationkey") % 5).cast("string")).alias("airline"),
            "origin", "destination", F.round(F.col("q") / F.col("n") / 50, 6).alias("avg_occupancy_rate"),
            (F.col("c_nationkey") % 10 / 100.0).alias("commission_rate"))
    )


SCORED_AT = "2001-08-02"


def churn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table from recency, for the operators that read scores."""
    people = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("monetary_total"))
    at = F.lit(SCORED_AT).cast("date")
    recency = F.datediff(at, F.col("b"))
    proba = F.round(recency / (recency + 180), 4)
    return people.select(
        "customer_id", proba.alias("churn_proba"), s.risk_bucket(proba).alias("risk_bucket"),
        s.booking_track(F.col("n")).alias("track"), "monetary_total",
        F.datediff(at, F.col("a")).alias("tenure_days"), at.cast("timestamp").alias("scored_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("topic"), F.col("source").alias("source_type"))


def search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions; see `questions_of`."""
    return questions_of(read(spark, sf_dir, "conversations"))


def questions_of(conversations: DataFrame) -> DataFrame:
    """Every user turn with its whole text, opened by one of the fixed sentences.

    Greetings and thanks also come alone, five minutes later, as questions of their own (with negative ids).
    """
    key = F.col("conv_id") * 7 + F.col("turn")
    opening, number = pick(OPENINGS, key), F.col("conv_id") * 1000 + F.col("turn")
    minutes = F.col("conv_id") * 37 + F.col("turn") * 11
    at = lambda m: F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=m * 60)
    row = lambda i, text, m: F.struct(i.cast("long").alias("question_id"), text.alias("text"), at(m).alias("asked_at"))
    asked = row(number, F.concat(opening, F.lit(" "), F.col("text")), minutes)
    alone = row(-number - 1, opening, minutes + 5)
    rows = F.when((key % len(OPENINGS)).isin(4, 5), F.array(asked, alone)).otherwise(F.array(asked))
    return conversations.where("role = 'user'").select("conv_id", "turn", F.explode(rows).alias("q")).select("conv_id", "turn", "q.*")


def _case(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[({index}) % {len(values)} + 1]"


_TIER_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TIERS.items()) + " END"
_BAND = ("CASE WHEN {a} <= 25 THEN '18-25' WHEN {a} <= 35 THEN '26-35' WHEN {a} <= 45 THEN '36-45' "
         "WHEN {a} <= 55 THEN '46-55' ELSE '56+' END").format(a="(c_custkey % 50 + 18)")
BUCKET_CASE = ("CASE WHEN churn_proba >= 0.75 THEN 'Very High' WHEN churn_proba >= 0.5 THEN 'High' "
               "WHEN churn_proba >= 0.25 THEN 'Medium' ELSE 'Low' END")

# The same bindings for the check queries: name -> (tables it needs, definition).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "firsts": ((), "SELECT o_custkey AS f_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY 1"),
    "discounts": ((), """SELECT l_orderkey AS d_orderkey, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2))
        * CAST(l_discount AS DECIMAL(5,2))), 2) AS DOUBLE) AS discount_idr FROM lineitem GROUP BY 1"""),
    "bookings": (("firsts", "discounts"), f"""
        SELECT o_orderkey AS booking_id, o_custkey AS customer_id, o_orderdate AS booking_date,
          o_orderdate AS created_at, o_totalprice AS total_price_idr,
          CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Confirmed' ELSE 'Cancelled' END AS status,
          CASE o_orderkey % 10 WHEN 0 THEN 'Unpaid' WHEN 1 THEN 'Refunded' ELSE 'Paid' END AS payment_status,
          o_orderpriority AS channel, {_case(METHODS, 'o_orderkey')} AS payment_method,
          {_case(PACKAGE_TYPES, 'o_orderkey')} AS package_type,
          CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 20 END AS campaign_id, o_orderkey % 50 AS agent_id,
          CAST(o_orderkey % 6 + 1 AS INT) AS pax_count, CAST(o_orderkey % 9 + 1 AS INT) AS nights,
          c_name AS customer_name, c_mktsegment AS customer_segment, n_name AS destination_name,
          o_orderdate > first_date AS is_repeat_customer, discount_idr
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN firsts ON f_custkey = o_custkey LEFT JOIN discounts ON d_orderkey = o_orderkey"""),
    "trips": ((), """SELECT l_orderkey AS booking_id, o_orderdate AS created_at, o_orderdate AS booking_date,
        l_shipdate AS travel_date FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""),
    "transactions": ((), """SELECT l_orderkey AS booking_id,
        CASE WHEN l_linestatus = 'F' THEN 'Success' ELSE 'Failed' END AS status, l_returnflag AS payment_method,
        CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))
          * (1 + CAST(l_tax AS DECIMAL(5,2))), 2) AS DOUBLE) AS amount_idr,
        CASE WHEN l_returnflag = 'R' THEN 'Refund' ELSE 'Payment' END AS type,
        l_shipdate AS transaction_date FROM lineitem"""),
    "customers": ((), f"""
        SELECT c_custkey AS customer_id, 'CUST-' || lpad(c_custkey::VARCHAR, 6, '0') AS customer_code, c_name AS name,
          'c' || (c_custkey % 997) || '@mail' || (c_custkey % 7) || '.example.com' AS email,
          CAST(c_custkey % 50 + 18 AS INT) AS age, {_BAND} AS age_group, n_name AS city, {_TIER_CASE} AS segment,
          {_case(CHANNELS, 'c_custkey')} AS acquisition_channel, join_date, last_purchase_date, total_trips,
          total_spent_idr, total_trips > 1 AS is_repeat_customer
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (
          SELECT o_custkey, min(o_orderdate) AS join_date, max(o_orderdate) AS last_purchase_date,
            count(*) AS total_trips, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent_idr
          FROM orders GROUP BY 1) r ON o_custkey = c_custkey"""),
    "reviews": ((), """
        SELECT event_id AS review_id, user_id AS customer_id, k % 5 + 1 AS rating,
          CASE WHEN k % 5 + 1 >= 4 THEN 'Positive' WHEN k % 5 + 1 = 3 THEN 'Neutral' ELSE 'Negative' END AS sentiment,
          ts AS review_date, CAST(event_id % 5 + 1 AS INT) AS value_for_money, n_name AS destination_name
        FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) e
        LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey"""),
    "campaigns": ((), f"""
        SELECT *, round((revenue_generated_idr - spend_idr) / nullif(spend_idr, 0), 6) AS roi,
          round(conversions / nullif(clicks, 0), 6) AS conversion_rate
        FROM (SELECT 'CMP-' || lpad(code::VARCHAR, 3, '0') AS campaign_code, 'Campaign ' || code AS name,
          {_case(CAMPAIGN_TYPES, 'code')} AS type, min(ts) AS start_date, count(DISTINCT user_id) AS reach,
          count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
          count(*) FILTER (event_type = 'purchase') AS conversions,
          coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase') AS DOUBLE), 0.0)
            AS revenue_generated_idr,
          CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) / 10 AS spend_idr
          FROM (SELECT *, CAST(props->>'$.k' AS INT) % 20 AS code FROM events) e GROUP BY code)"""),
    "destinations": ((), """SELECT n_name AS name, r_name AS region, CAST(n_nationkey * 7 % 100 AS DOUBLE) AS
        popularity_score, n_nationkey % 20 / 10 + 3 AS avg_rating
        FROM nation LEFT JOIN region ON r_regionkey = n_regionkey"""),
    "packages": ((), """SELECT 'PKG-' || lpad(p_partkey::VARCHAR, 6, '0') AS package_code, p_name AS name,
        'NATION_' || (p_partkey % 25) AS destination_name, p_type AS type, CAST(p_size AS INT) AS nights,
        p_retailprice AS price_per_pax_idr, p_partkey % 40 / 10 + 1 AS rating, coalesce(n, 0) AS total_bookings
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey"""),
    "hotels": ((), """SELECT 'HTL-' || lpad(s_suppkey::VARCHAR, 6, '0') AS hotel_code, s_name AS name,
        n_name AS destination_name, CAST(s_suppkey % 5 + 1 AS INT) AS star_rating, s_suppkey * 7 % 50 / 10 AS rating,
        s_suppkey * 3 AS total_reviews, s_acctbal AS commission_rate
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey"""),
    "flights": ((), """SELECT o.n_name || '>' || d.n_name AS flight_code, 'AIR-' || (o.n_nationkey % 5) AS airline,
        o.n_name AS origin, d.n_name AS destination, round(sum(l_quantity) / count(*) / 50, 6) AS avg_occupancy_rate,
        d.n_nationkey % 10 / 100 AS commission_rate
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation o ON o.n_nationkey = s_nationkey
        JOIN nation d ON d.n_nationkey = c_nationkey GROUP BY o.n_name, d.n_name, o.n_nationkey, d.n_nationkey"""),
    "churn_scores": ((), f"""
        SELECT *, {BUCKET_CASE} AS risk_bucket FROM (
          SELECT o_custkey AS customer_id,
            round(date_diff('day', max(o_orderdate)::DATE, DATE '{SCORED_AT}')
              / (date_diff('day', max(o_orderdate)::DATE, DATE '{SCORED_AT}') + 180), 4) AS churn_proba,
            CASE WHEN count(*) = 1 THEN 'single' ELSE 'repeat' END AS track,
            CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS monetary_total,
            CAST(date_diff('day', min(o_orderdate)::DATE, DATE '{SCORED_AT}') AS INT) AS tenure_days
          FROM orders GROUP BY 1)"""),
    "chunks": ((), "SELECT doc_id AS chunk_id, text, lang AS topic, source AS source_type FROM documents"),
    "search_questions": ((), "SELECT item_id AS question_id, text FROM benchmark"),
    "questions": ((), f"""SELECT conv_id, turn, conv_id * 1000 + turn AS question_id, {_case(OPENINGS, 'conv_id * 7 + turn')} || ' ' || text AS text,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 37 + turn * 11 AS INT)) AS asked_at FROM conversations WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, -(conv_id * 1000 + turn) - 1, {_case(OPENINGS, 'conv_id * 7 + turn')},
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 37 + turn * 11 + 5 AS INT)) FROM conversations
        WHERE role = 'user' AND (conv_id * 7 + turn) % {len(OPENINGS)} IN (4, 5)"""),
}


def oracle(names: str, body: str, **extra: str) -> str:
    """`body` preceded by the named tables, their dependencies, and extra definitions."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        needs, text = CTES[name]
        for other in needs:
            add(other)
        parts.setdefault(name, text)

    for name in names.split():
        add(name)
    parts.update(extra)
    if not parts:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in parts.items()) + "\n" + body
