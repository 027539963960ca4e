"""The bundled test tables as bank data.

Order lines are transactions, customers are cards, 30 neighbouring customers are one client, suppliers
are merchants, part types decide the MCC code. Every view covers its tables whole.
`VIEW_SQL` states the same views in SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import UNKNOWN_MCC
from ..functions.identity import stable_id
from ..operators.common import move_packed
from ..operators.labeling import cache_key, with_rule_category

AS_OF = "2000-06-15"
LATE_AS_OF = "2000-06-25"
EVENTS_AS_OF = "2024-01-20"
RAW_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice"]

_BY_BRAND = {
    "Brand#7": ("5968", "Subscription Services"),
    "Brand#9": ("4784", "Tolls and Bridge Fees"),
}
_BY_TYPE = {
    "ECONOMY": ("5812", "Eating Places and Restaurants"),
    "STANDARD": ("5411", "Grocery Stores, Supermarkets"),
    "SMALL": ("7832", "Motion Picture Theaters"),
    "MEDIUM": ("5311", "Department Stores"),
    "LARGE": ("4722", "Travel Agencies"),
}


def _mapped(i: int, default: str) -> Column:
    out = None
    for column, table in (("p_brand", _BY_BRAND), ("p_type", _BY_TYPE)):
        for key, value in table.items():
            hit = F.col(column) == key
            out = F.when(hit, value[i]) if out is None else out.when(hit, value[i])
    return out.otherwise(default)


def _household(key: str) -> Column:
    return F.floor(F.col(key) / 30).cast("bigint")


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def _amount() -> Column:
    refund = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    return _money(F.when(refund, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")))


class Views:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def lines(self, place: bool = True, whole: bool = False) -> DataFrame:
        """Order lines with client and part; `place=False` leaves the merchant's city out.

        With `whole`, for readers of all columns, the small ones of a line go through the joins as one text.

        The amount and what is asked of quantity and status are found before the joins, which then move these in place of what
        they are made of. Nations are joined last: the size that Spark expects of a join is the product of its sides, so
        suppliers joined with them would not be broadcast.
        """
        lines = self.table("lineitem").withColumns({
            "amount_usd": _amount(),
            "is_named": F.col("l_quantity") != 50,
            "is_dated": F.col("l_quantity") != 49,
            "is_online": F.col("l_linestatus") == "O",
        })

        def joined(rows: DataFrame) -> DataFrame:
            orders = self.table("orders").withColumn("has_card", F.col("o_orderpriority") != "1-URGENT")
            with_orders = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            return with_orders.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

        if whole:
            flat = lines.withColumn("l_linenumber", _text("l_linenumber")).drop("l_linestatus")
            rows = move_packed(flat, joined).withColumn("l_linenumber", F.col("l_linenumber").cast(lines.schema["l_linenumber"].dataType))
        else:
            rows = joined(lines)
        if place:
            rows = rows.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
                self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
            )
        else:
            rows = rows.withColumn("n_name", F.lit(None).cast("string"))
        hours = F.make_dt_interval(F.lit(0), F.col("l_linenumber") * 3, F.lit(0), F.lit(0))
        return rows.select(
            "*",
            _household("o_custkey").alias("client_id"),
            F.when(F.col("has_card"), _text("o_custkey")).alias("card_id"),
            (F.col("l_shipdate") + hours).alias("transaction_dt"),
            F.when(F.col("is_named"), F.concat(F.lit("M"), _text(F.floor(F.col("l_suppkey") / 5)))).alias("merchant_id"),
            F.when(F.col("is_online"), "Online Transaction").otherwise("Swipe Transaction").alias("use_chip"),
            F.when(F.col("l_returnflag") == "A", "Bad PIN").alias("errors"),
        )

    def tx(self, place: bool = True, whole: bool = False) -> DataFrame:
        """Enriched transactions with unique ids."""
        return self.lines(place, whole).select(
            F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey")).alias("id"),
            "client_id", "card_id", "transaction_dt", "amount_usd", "merchant_id",
            F.col("n_name").alias("merchant_city"),
            F.when(~F.col("is_online"), "ST").alias("merchant_state"),
            _mapped(0, "9999").alias("mcc_code"),
            _mapped(1, UNKNOWN_MCC).alias("mcc_description"),
            "is_online", "use_chip", "errors", "l_returnflag",
        )

    def categorised(self, place: bool = False) -> DataFrame:
        return with_rule_category(self.tx(place))

    def raw_tx(self) -> DataFrame:
        """Raw text rows with repeated ids, bad dates, bad amounts and bad codes."""
        code = F.when((F.col("p_type") == "PROMO") & (F.col("p_size") <= 25), "n1a").otherwise(_mapped(0, "9999"))
        return self.lines(whole=True).select(
            F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("id"),
            F.when(~F.col("is_dated"), "bad").otherwise(_text("transaction_dt")).alias("date"),
            _text("client_id").alias("client_id"),
            "card_id",
            F.when(F.col("p_size") == 13, "bad")
            # The rows keep the columns of the amount, so they need not carry it too.
            .otherwise(F.concat(F.lit("$"), _text(_amount()), F.lit(" "))).alias("amount"),
            "use_chip", "merchant_id",
            F.concat(F.lit("  "), F.col("n_name"), F.lit("   x ")).alias("merchant_city"),
            F.when(~F.col("is_online"), " ny ").alias("merchant_state"),
            F.concat(_text(F.col("l_suppkey") + 10000), F.lit(".0")).alias("zip"),
            F.concat(code, F.lit(".0")).alias("mcc"),
            "errors", "l_partkey", "l_suppkey", "l_extendedprice",
        )

    def mcc(self) -> DataFrame:
        return (
            self.table("part")
            .select(_mapped(0, "9999").alias("mcc_code"), _mapped(1, UNKNOWN_MCC).alias("mcc_description"))
            .where(F.col("mcc_description") != UNKNOWN_MCC)
            .distinct()
        )

    def raw_users(self) -> DataFrame:
        lead = F.min_by("c_acctbal", "c_custkey")
        limit = F.concat(F.lit("$"), _text(_money(lead * 100)), F.lit(" "))
        return (
            self.table("customer")
            .groupBy(_household("c_custkey").alias("client"))
            .agg(
                _text(F.min("c_nationkey") + 20).alias("current_age"),
                F.concat(F.lit("$"), _text(_money(F.max("c_acctbal")))).alias("per_capita_income"),
                F.concat(F.lit("$"), _text(_money(F.max("c_acctbal") * 2))).alias("yearly_income"),
                F.concat(F.lit("$"), _text(_money(F.min("c_acctbal")))).alias("total_debt"),
                _text(F.max("c_nationkey") + 600).alias("credit_score"),
                _text(F.count("*")).alias("num_credit_cards"),
                F.when(lead > 0, limit).alias("monthly_discretionary_limits"),
            )
            .withColumn("id", _text("client"))
            .drop("client")
        )

    def raw_cards(self) -> DataFrame:
        return self.table("customer").select(
            _text("c_custkey").alias("id"),
            _text(_household("c_custkey")).alias("client_id"),
            F.col("c_mktsegment").alias("card_brand"),
            F.lit("Debit").alias("card_type"),
            F.concat(F.lit("4000"), _text("c_custkey")).alias("card_number"),
            F.lit("12/2022").alias("expires"),
            F.lit("000").alias("cvv"),
            F.when(F.col("c_acctbal") > 5000, "YES").when(F.col("c_acctbal") > 0, "NO").otherwise("maybe").alias("has_chip"),
            _text("c_nationkey").alias("num_cards_issued"),
            F.concat(F.lit("$"), _text(_money(F.col("c_acctbal")))).alias("credit_limit"),
            F.lit("09/2002").alias("acct_open_date"),
            F.lit("2014").alias("year_pin_last_changed"),
            F.lit("No").alias("card_on_dark_web"),
        )

    def limits(self) -> DataFrame:
        from ..operators.budget import user_limits

        return user_limits(self.raw_users())

    def limit_changes(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        own = _text(_money(F.abs("c_acctbal") * 50))
        return self.table("customer").select(
            _household("c_custkey").alias("client_id"),
            F.col("c_custkey").alias("seq"),
            F.when(segment == "MACHINERY", "n/a").when(segment != "BUILDING", own).alias("limit_usd"),
        )

    def etx(self) -> DataFrame:
        """Events as transactions of one month, at all times of day."""
        kind = F.col("event_type")
        return self.table("events").select(
            _text("event_id").alias("id"),
            F.col("user_id").alias("client_id"),
            F.col("ts").alias("transaction_dt"),
            _money(F.col("value") - 5).alias("amount_usd"),
            F.concat(F.lit("K"), F.get_json_object("props", "$.k")).alias("merchant_id"),
            F.when(kind == "purchase", "5311").when(kind == "click", "5812").when(kind == "view", "7832")
            .when(kind == "signup", "5411").alias("mcc_code"),
            F.when(kind == "purchase", "Department Stores").when(kind == "click", "Eating Places and Restaurants")
            .when(kind == "view", "Motion Picture Theaters").when(kind == "signup", "Grocery Stores, Supermarkets")
            .otherwise(UNKNOWN_MCC).alias("mcc_description"),
        )

    def event_limits(self) -> DataFrame:
        """A limit per event user: ten times the largest value, none for users without a purchase."""
        spent = F.max(F.when(F.col("event_type") == "purchase", F.col("value")))
        return self.table("events").groupBy(F.col("user_id").alias("client_id")).agg(
            _money(spent * 10).alias("monthly_discretionary_limit_usd")
        )

    def labels(self, tx: DataFrame | None = None) -> DataFrame:
        """Two generations of labels per transaction; the second covers returned lines. `tx` are the transactions, if stored."""
        tx = self.tx(place=False) if tx is None else tx
        code = F.col("mcc_code")
        first = tx.select(
            "id", F.lit(1).alias("seq"),
            F.when(code == "4722", "Travel").when(code == "5411", "Dining").when(code != "7832", "Healthcare").alias("category"),
            F.when(F.col("l_returnflag") != "N", "llm").alias("source"),
        )
        second = tx.where(F.col("l_returnflag") == "R").select(
            "id", F.lit(2).alias("seq"),
            F.when(code != "5812", "Shopping").alias("category"),
            F.lit("low_confidence_fallback").alias("source"),
        )
        return first.unionByName(second)

    def label_cache(self, rows: DataFrame) -> DataFrame:
        """Cached labels for travel agencies, and unusable entries for restaurants."""
        return rows.where(F.col("mcc_code").isin("4722", "5812")).select(
            cache_key(rows.columns).alias("cache_key"),
            F.when(F.col("mcc_code") == "4722", "Travel").alias("category_final"),
            F.lit("Travel").alias("category_llm"),
            F.lit(0.8).alias("confidence"),
            F.when(F.col("use_chip").isNull(), "mcc_fallback").alias("source"),
        )

    def responses(self, batches: DataFrame) -> DataFrame:
        """Answers of a stand-in labeller: one payload per called batch, a broken one for batch 2."""
        code = F.col("mcc_code")
        category = (
            F.when(code == "5411", "Snacks").when(code == "7832", "Entertainment")
            .when(code == "9999", "Education").otherwise("Dining")
        )
        confidence = F.when(code == "5311", F.lit(None)).when(F.col("use_chip").isNull(), 0.9).otherwise(0.4)
        item = F.struct("id", category.alias("category"), confidence.cast("double").alias("confidence"))
        return (
            batches.where("is_sent")
            .groupBy("batch_no")
            # No result for toll roads.
            .agg(F.sort_array(F.collect_list(F.when(code != "4784", item))).alias("results"))
            .select(
                "batch_no",
                F.when(F.col("batch_no") == 2, "no json")
                .otherwise(F.to_json(F.struct("results"), {"ignoreNullFields": "false"})).alias("payload"),
            )
        )

    def feedback(self) -> DataFrame:
        """Feedback on every item that a client's transactions could lead to."""
        rows = self.categorised().where("merchant_id is not null")
        status = F.when(F.col("l_returnflag") == "R", "dismissed").otherwise("accepted")
        client, merchant = F.col("client_id"), F.col("merchant_id")
        ids = F.array(
            stable_id(F.lit("cutback_top_category_merchant"), client, F.col("category"), merchant),
            stable_id(F.lit("recurring_subscription"), client, merchant),
        )
        return rows.select("client_id", F.explode(ids).alias("rec_id"), status.alias("status"), "transaction_dt", "id")

    def questions(self) -> DataFrame:
        """One question per order, of five kinds."""
        price = F.concat(F.lit("$"), _text(_money(F.col("o_totalprice"))))
        kind = F.col("o_orderpriority")
        return self.table("orders").select(
            _household("o_custkey").alias("client_id"),
            F.col("o_orderkey").alias("question_id"),
            F.when(kind == "1-URGENT", F.concat(F.lit("Can I afford "), price, F.lit(" today?")))
            .when(kind == "2-HIGH", price)
            .when(kind == "3-MEDIUM", "What should I do next?")
            .when(kind == "5-LOW", "Is 1500 a good number?")
            .otherwise("  ").alias("question"),
        )

    def turns(self) -> DataFrame:
        """Stored chat: every customer adds a question and an answer to the client's session."""
        said = F.array(
            F.struct(F.lit("user").alias("role"), F.lit("How is my budget?").alias("content")),
            F.struct(
                F.when(F.col("c_mktsegment") == "MACHINERY", "system").otherwise("assistant").alias("role"),
                F.when(F.col("c_mktsegment") == "BUILDING", "What is the Purchase Amount?")
                .when(F.col("c_mktsegment") != "HOUSEHOLD", "You are on track.").alias("content"),
            ),
        )
        rows = self.table("customer").select("c_custkey", F.posexplode(said).alias("pos", "t"))
        return rows.select(
            _household("c_custkey").alias("client_id"),
            (F.col("c_custkey") * 2 + F.col("pos")).alias("turn"),
            "t.role", "t.content",
        )

    def conversations(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("client_id"), "turn", "role", F.col("text").alias("content")
        )


# The same views in SQL. A query names the views it needs; `with_views` puts them in front.
VIEW_SQL = {
    "tx": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
               o_custkey // 30 AS client_id,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_custkey AS VARCHAR) END AS card_id,
               l_shipdate + to_hours(3 * l_linenumber) AS transaction_dt,
               CAST(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -l_extendedprice
                         ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount_usd,
               CASE WHEN l_quantity <> 50 THEN 'M' || (l_suppkey // 5) END AS merchant_id,
               n_name AS merchant_city,
               CASE WHEN l_linestatus <> 'O' THEN 'ST' END AS merchant_state,
               m.mcc_code, m.mcc_description,
               l_linestatus = 'O' AS is_online,
               CASE WHEN l_linestatus = 'O' THEN 'Online Transaction' ELSE 'Swipe Transaction' END AS use_chip,
               CASE WHEN l_returnflag = 'A' THEN 'Bad PIN' END AS errors,
               l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, p_size, p_type
        FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey
        JOIN partmcc m ON m.partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "partmcc": """
        SELECT p_partkey AS partkey,
               CASE WHEN p_brand = 'Brand#7' THEN '5968' WHEN p_brand = 'Brand#9' THEN '4784'
                    WHEN p_type = 'ECONOMY' THEN '5812' WHEN p_type = 'STANDARD' THEN '5411'
                    WHEN p_type = 'SMALL' THEN '7832' WHEN p_type = 'MEDIUM' THEN '5311'
                    WHEN p_type = 'LARGE' THEN '4722' ELSE '9999' END AS mcc_code,
               CASE WHEN p_brand = 'Brand#7' THEN 'Subscription Services'
                    WHEN p_brand = 'Brand#9' THEN 'Tolls and Bridge Fees'
                    WHEN p_type = 'ECONOMY' THEN 'Eating Places and Restaurants'
                    WHEN p_type = 'STANDARD' THEN 'Grocery Stores, Supermarkets'
                    WHEN p_type = 'SMALL' THEN 'Motion Picture Theaters'
                    WHEN p_type = 'MEDIUM' THEN 'Department Stores'
                    WHEN p_type = 'LARGE' THEN 'Travel Agencies' ELSE 'UNKNOWN_MCC' END AS mcc_description
        FROM part""",
    # Category by rule. The codes of the views reach every kind of rule: keyword, prefix, none.
    "ctx": """
        SELECT *, category IN ('Dining', 'Entertainment', 'Shopping', 'Travel', 'Subscriptions') AS is_discretionary,
               CASE WHEN amount_usd > 0 THEN amount_usd ELSE 0 END AS spend
        FROM (SELECT *, CASE
                WHEN regexp_matches(lower(mcc_description), 'restaurant|fast food|drinking places|eating places') THEN 'Dining'
                WHEN regexp_matches(lower(mcc_description), 'grocery|supermarkets|miscellaneous food stores') THEN 'Groceries'
                WHEN regexp_matches(lower(mcc_description), 'utilities|electric|gas|water|sanitary') THEN 'Utilities'
                WHEN regexp_matches(lower(mcc_description), 'service stations|tolls|taxicabs|limousines|parking') THEN 'Transportation'
                WHEN regexp_matches(lower(mcc_description), 'amusement|motion picture|theaters|video') THEN 'Entertainment'
                WHEN regexp_matches(lower(mcc_description), 'department stores|discount stores|book stores|home furnishing|lumber') THEN 'Shopping'
                WHEN regexp_matches(lower(mcc_description), 'transfer') THEN 'Transfers'
                WHEN regexp_matches(lower(mcc_description), 'subscription') THEN 'Subscriptions'
                WHEN regexp_matches(lower(mcc_description), 'fee|interest') THEN 'Fees & Interest'
                WHEN mcc_code LIKE '54%' THEN 'Groceries' WHEN mcc_code LIKE '58%' THEN 'Dining'
                WHEN mcc_code LIKE '49%' THEN 'Utilities'
                WHEN mcc_code LIKE '41%' OR mcc_code LIKE '47%' THEN 'Transportation'
                WHEN regexp_matches(mcc_code, '^5[3927]') THEN 'Shopping'
                ELSE 'Other/Uncategorized' END AS category FROM tx)""",
    "raw_tx": """
        SELECT l_orderkey || '-' || l_linenumber AS id,
               CASE WHEN l_quantity = 49 THEN 'bad' ELSE CAST(transaction_dt AS VARCHAR) END AS date,
               CAST(client_id AS VARCHAR) AS client_id, card_id,
               CASE WHEN p_size = 13 THEN 'bad' ELSE '$' || CAST(amount_usd AS VARCHAR) || ' ' END AS amount,
               use_chip, merchant_id, '  ' || merchant_city || '   x ' AS merchant_city,
               CASE WHEN NOT is_online THEN ' ny ' END AS merchant_state,
               (10000 + l_suppkey) || '.0' AS zip,
               CASE WHEN p_type = 'PROMO' AND p_size <= 25 THEN 'n1a.0' ELSE mcc_code || '.0' END AS mcc,
               errors, l_partkey, l_suppkey, l_extendedprice
        FROM tx""",
    "first_tx": """
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn,
                 count(*) OVER (PARTITION BY id) AS copies FROM raw_tx) WHERE rn = 1""",
    "parsed_tx": """
        SELECT id, CAST(CASE WHEN date <> 'bad' THEN date END AS TIMESTAMP) AS transaction_dt, client_id, card_id,
               CAST(CASE WHEN amount <> 'bad' THEN replace(trim(amount), '$', '') END AS DECIMAL(18,2)) AS amount_usd,
               use_chip, merchant_id,
               trim(regexp_replace(merchant_city, '\\s+', ' ', 'g')) AS merchant_city,
               upper(trim(merchant_state)) AS merchant_state,
               replace(zip, '.0', '') AS zip_norm,
               CASE WHEN mcc <> 'n1a.0' THEN replace(mcc, '.0', '') END AS mcc_code, errors,
               use_chip = 'Online Transaction' AS is_online, date, trim(amount) AS amount, zip, mcc, copies
        FROM first_tx""",
    "mcc_dim": "SELECT DISTINCT mcc_code, mcc_description FROM partmcc WHERE mcc_description <> 'UNKNOWN_MCC'",
    "households": """
        SELECT c_custkey // 30 AS client_id, min_by(c_acctbal, c_custkey) AS lead, min(c_nationkey) AS min_nation,
               max(c_nationkey) AS max_nation, max(c_acctbal) AS max_bal, min(c_acctbal) AS min_bal, count(*) AS n
        FROM customer GROUP BY 1""",
    "limits": """
        SELECT client_id, CASE WHEN lead > 0 THEN CAST(100 * lead AS DECIMAL(18,2)) END AS monthly_limit
        FROM households""",
    "etx": """
        SELECT CAST(event_id AS VARCHAR) AS id, user_id AS client_id, ts AS transaction_dt,
               CAST(value - 5 AS DECIMAL(18,2)) AS amount_usd, 'K' || (props->>'k') AS merchant_id,
               CASE event_type WHEN 'purchase' THEN '5311' WHEN 'click' THEN '5812' WHEN 'view' THEN '7832'
                    WHEN 'signup' THEN '5411' END AS mcc_code,
               CASE event_type WHEN 'purchase' THEN 'Shopping' WHEN 'click' THEN 'Dining' WHEN 'view' THEN 'Entertainment'
                    WHEN 'signup' THEN 'Groceries' ELSE 'Other/Uncategorized' END AS category,
               event_type IN ('purchase', 'click', 'view') AS is_discretionary,
               greatest(CAST(value - 5 AS DECIMAL(18,2)), 0) AS spend
        FROM events""",
    "event_limits": """
        SELECT user_id AS client_id,
               CAST(10 * max(value) FILTER (event_type = 'purchase') AS DECIMAL(18,2)) AS monthly_limit
        FROM events GROUP BY 1""",
    "labels": """
        SELECT id, 1 AS seq,
               CASE WHEN mcc_code = '4722' THEN 'Travel' WHEN mcc_code = '5411' THEN 'Dining'
                    WHEN mcc_code <> '7832' THEN 'Healthcare' END AS category,
               CASE WHEN l_returnflag <> 'N' THEN 'llm' END AS source FROM tx
        UNION ALL
        SELECT id, 2, CASE WHEN mcc_code <> '5812' THEN 'Shopping' END, 'low_confidence_fallback'
        FROM tx WHERE l_returnflag = 'R'""",
    "last_labels": """
        SELECT id, category, source FROM labels WHERE category IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1""",
    "otx": """
        SELECT * EXCLUDE (category, is_discretionary), label IN ('Dining', 'Entertainment', 'Shopping', 'Travel', 'Subscriptions') AS is_discretionary,
               label AS category FROM (
          SELECT c.*, coalesce(l.category, c.category) AS label,
                 CASE WHEN l.id IS NULL THEN 'mcc' ELSE coalesce(l.source, 'llm_artifact') END AS category_source
          FROM ctx c LEFT JOIN last_labels l ON c.id = l.id)""",
    "profiled": """
        SELECT *, 'p' || substr(sha256(profile_key), 1, 16) AS profile_id FROM (
          SELECT *, coalesce(mcc_code, '') || '|' || coalesce(mcc_description, '') || '|' || coalesce(merchant_id, '')
            || '|' || coalesce(merchant_city, '') || '|' || coalesce(merchant_state, '') || '|'
            || CASE WHEN is_online THEN 'True' WHEN NOT is_online THEN 'False' ELSE '' END AS profile_key FROM ctx)""",
    "profiles": """
        SELECT profile_id, any_value(profile_key) AS profile_key, count(*) AS txn_count,
               any_value(mcc_code) AS mcc_code, any_value(mcc_description) AS mcc_description,
               any_value(merchant_id) AS merchant_id, any_value(merchant_city) AS merchant_city,
               any_value(merchant_state) AS merchant_state, any_value(is_online) AS is_online,
               any_value(category) AS rule_category,
               round(quantile_cont(CAST(amount_usd * 100 AS DOUBLE), 0.5)) / 100 AS median_amount_usd
        FROM profiled GROUP BY 1""",
    "looked_up": """
        SELECT *, 'v1:' || sha256(fingerprint) AS cache_key, mcc_code = '4722' AS is_hit,
               ((row_number() OVER (ORDER BY profile_id)) - 1) // 40 AS batch_no FROM (
          SELECT *, CASE WHEN is_online THEN 'Online Transaction' END AS use_chip,
                 CAST(to_json({'errors': NULL, 'mcc_code': mcc_code, 'mcc_description': mcc_description,
                   'merchant_city': merchant_city, 'merchant_id': merchant_id, 'merchant_state': merchant_state,
                   'use_chip': CASE WHEN is_online THEN 'Online Transaction' END, 'v': 'v1'}) AS VARCHAR) AS fingerprint
          FROM profiles)""",
    "batches": "SELECT *, NOT is_hit AS is_sent FROM looked_up",
    "resolved": """
        SELECT *, CASE WHEN is_hit THEN 'Travel' WHEN src = 'llm' THEN given ELSE rule_category END AS category_final,
               CASE WHEN is_hit THEN CASE WHEN use_chip IS NULL THEN 'mcc_fallback' ELSE 'llm' END
                    ELSE src END AS source,
               CASE WHEN is_hit THEN CAST(0.8 AS DOUBLE) ELSE said END AS confidence,
               CASE WHEN is_hit THEN 'Travel' ELSE given END AS category_llm,
               NOT is_hit AND NOT answered AS degraded
        FROM (SELECT *, CASE WHEN given IS NULL OR given = 'Snacks' THEN 'mcc_fallback'
                             WHEN said < 0.6 THEN 'low_confidence_fallback' ELSE 'llm' END AS src
              FROM (SELECT *, CASE WHEN answered AND mcc_code <> '4784' THEN
                        CASE mcc_code WHEN '5411' THEN 'Snacks' WHEN '7832' THEN 'Entertainment'
                             WHEN '9999' THEN 'Education' ELSE 'Dining' END END AS given,
                      CASE WHEN answered AND mcc_code NOT IN ('4784', '5311')
                           THEN CAST(CASE WHEN use_chip IS NULL THEN 0.9 ELSE 0.4 END AS DOUBLE) END AS said
                    FROM (SELECT *, is_sent AND batch_no <> 2 AS answered FROM batches)))""",
    "labelled": """
        SELECT p.id, p.client_id, p.transaction_dt, p.amount_usd, p.mcc_code, p.mcc_description,
               r.category_final AS category, r.source, r.confidence, r.category_llm,
               CASE WHEN r.source = 'llm' THEN 'stand-in' END AS model, p.profile_id, p.category AS rule
        FROM profiled p LEFT JOIN resolved r ON p.profile_id = r.profile_id""",
    "daily": """
        SELECT client_id, CAST(transaction_dt AS DATE) AS day, sum(spend) AS spend
        FROM ctx WHERE is_discretionary GROUP BY 1, 2""",
    "msamples": """
        SELECT client_id, day, strftime(day, '%Y-%m') AS ym, spend,
               sum(spend) OVER m AS month_total, sum(spend) OVER (m ORDER BY day ROWS UNBOUNDED PRECEDING) AS mtd,
               CAST(sum(spend) OVER (m ORDER BY day ROWS 6 PRECEDING) AS DOUBLE)
                 / count(*) OVER (m ORDER BY day ROWS 6 PRECEDING) AS a7,
               CAST(sum(spend) OVER (m ORDER BY day ROWS 29 PRECEDING) AS DOUBLE)
                 / count(*) OVER (m ORDER BY day ROWS 29 PRECEDING) AS a30
        FROM daily WINDOW m AS (PARTITION BY client_id, strftime(day, '%Y-%m'))""",
    "samples": """
        SELECT s.client_id, day, ym, CAST(month_total AS DOUBLE) AS month_total, year(day) AS year, month(day) AS month,
               day(day) AS dom, day(last_day(day)) AS dim, day(last_day(day)) - day(day) AS rem,
               CAST(mtd AS DOUBLE) AS mtd, a7, a30, CAST(monthly_limit AS DOUBLE) AS lim,
               CAST(mtd AS DOUBLE) / CAST(monthly_limit AS DOUBLE) AS mtd_util, a7 / CAST(monthly_limit AS DOUBLE) AS a7_util
        FROM msamples s JOIN limits l ON s.client_id = l.client_id WHERE monthly_limit > 0""",
    "budget": """
        SELECT l.client_id, DATE '2000-06-15' AS as_of_date, DATE '2000-06-01' AS month_start, l.monthly_limit,
               coalesce(m.mtd, 0) AS mtd,
               CAST(coalesce(m.mtd, 0) AS DOUBLE) / nullif(CAST(l.monthly_limit AS DOUBLE), 0) AS util
        FROM limits l LEFT JOIN (
          SELECT client_id, sum(spend) AS mtd FROM ctx
          WHERE is_discretionary AND transaction_dt >= TIMESTAMP '2000-06-01' AND transaction_dt <= TIMESTAMP '2000-06-15'
          GROUP BY 1) m ON l.client_id = m.client_id""",
    "latest": """
        SELECT client_id, DATE '2000-06-15' AS as_of_date, lim, mtd, dim, predicted
        FROM numbered JOIN fitted USING (r) WHERE day <= DATE '2000-06-15'
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY day DESC) = 1""",
    "signals": """
        SELECT *, predicted / lim AS projected, predicted > lim AS risk, lim - mtd AS remaining,
               CASE WHEN lim - mtd <= 0 THEN 0
                    WHEN predicted - mtd > 0 THEN CAST(ceil((lim - mtd) / ((predicted - mtd) / greatest(dim - 15, 1))) AS BIGINT)
               END AS days
        FROM latest""",
    "inputs": """
        SELECT b.client_id, b.as_of_date, b.util, s.projected,
               coalesce(nullif(CAST(b.mtd AS DOUBLE), 0), s.mtd) AS mtd_spend,
               coalesce(CAST(b.monthly_limit AS DOUBLE), s.lim) AS limit_usd,
               s.remaining, s.days, coalesce(s.risk, FALSE) AS risk
        FROM budget b LEFT JOIN signals s ON b.client_id = s.client_id""",
    "recurring": """
        SELECT *, std_m / nullif(avg_m, 0) AS cv FROM (
          SELECT client_id, merchant_id, count(*) AS active_months, CAST(sum(m) AS DOUBLE) / count(*) AS avg_m,
                 sum(m) AS total, stddev_samp(CAST(m AS DOUBLE)) AS std_m, bool_or(sub) AS is_subscription
          FROM (SELECT client_id, merchant_id, strftime(transaction_dt, '%Y-%m') AS ym, sum(spend) AS m,
                       bool_or(category = 'Subscriptions' OR regexp_matches(lower(mcc_description),
                         'subscription|stream|netflix|spotify|hulu|prime|membership|recurring')) AS sub
                FROM ctx WHERE merchant_id IS NOT NULL AND transaction_dt >= TIMESTAMP '2000-06-15' - INTERVAL 180 DAY
                  AND transaction_dt <= TIMESTAMP '2000-06-15' GROUP BY 1, 2, 3)
          GROUP BY 1, 2)
        WHERE active_months >= 3 AND avg_m >= 10 AND coalesce(std_m / nullif(avg_m, 0), 0) <= 0.75""",
    "window90": """
        SELECT * FROM ctx WHERE is_discretionary AND transaction_dt >= TIMESTAMP '2000-06-15' - INTERVAL 90 DAY
          AND transaction_dt <= TIMESTAMP '2000-06-15'""",
    "hits": """
        SELECT c.*, m.merchant_id, m.merchant_spend, m.city, m.state
        FROM (SELECT client_id, category, sum(spend) AS category_spend,
                     row_number() OVER (PARTITION BY client_id ORDER BY sum(spend) DESC, category) AS category_rank
              FROM window90 GROUP BY 1, 2) c
        JOIN (SELECT client_id, category, merchant_id, sum(spend) AS merchant_spend,
                     arg_min(merchant_city, (transaction_dt, merchant_city)) FILTER (merchant_city IS NOT NULL) AS city,
                     arg_min(merchant_state, (transaction_dt, merchant_state)) FILTER (merchant_state IS NOT NULL) AS state
              FROM window90 WHERE merchant_id IS NOT NULL GROUP BY 1, 2, 3
              QUALIFY row_number() OVER (PARTITION BY client_id, category ORDER BY sum(spend) DESC, merchant_id) = 1) m
          ON c.client_id = m.client_id AND c.category = m.category
        WHERE category_spend > 0 AND merchant_spend > 0""",
    "items": """
        SELECT client_id, 0 AS preference, 'recurring_subscription' AS rule, NULL AS category, merchant_id, avg_m AS saving,
               substr(sha256('recurring_subscription|' || client_id || '|' || merchant_id), 1, 16) AS rec_id,
               'Pause or cancel your top subscription' AS title,
               'Cancel, pause, or downgrade merchant `' || merchant_id || '` (~$' || format('{:,.2f}', avg_m) || '/mo).' AS action
        FROM recurring WHERE is_subscription
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY avg_m DESC, merchant_id) = 1
        UNION ALL
        SELECT client_id, category_rank, 'cutback_top_category_merchant', category, merchant_id,
               0.15 * (CAST(merchant_spend AS DOUBLE) / 3.0),
               substr(sha256('cutback_top_category_merchant|' || client_id || '|' || category || '|' || merchant_id), 1, 16),
               'Cut ' || category || ' spend at your top merchant',
               'Reduce visits or ticket size at `' || concat_ws(' / ', merchant_id, city, state) || '` (~$'
                 || format('{:,.2f}', CAST(merchant_spend AS DOUBLE) / 3.0) || '/mo in ' || category || ').'
        FROM hits WHERE category_rank IN (1, 3, 5, 7, 9)""",
    "feedback": """
        SELECT client_id, substr(sha256('cutback_top_category_merchant|' || client_id || '|' || category || '|' || merchant_id), 1, 16) AS rec_id,
               CASE WHEN l_returnflag = 'R' THEN 'dismissed' ELSE 'accepted' END AS status, transaction_dt, id
        FROM ctx WHERE merchant_id IS NOT NULL
        UNION ALL
        SELECT client_id, substr(sha256('recurring_subscription|' || client_id || '|' || merchant_id), 1, 16),
               CASE WHEN l_returnflag = 'R' THEN 'dismissed' ELSE 'accepted' END, transaction_dt, id
        FROM ctx WHERE merchant_id IS NOT NULL""",
    "last_feedback": """
        SELECT client_id, rec_id, status FROM feedback
        QUALIFY row_number() OVER (PARTITION BY client_id, rec_id ORDER BY transaction_dt DESC, id DESC) = 1""",
    "open_items": """
        SELECT i.* FROM items i LEFT JOIN last_feedback f
          ON i.client_id = f.client_id AND i.rec_id = f.rec_id AND f.status = 'dismissed'
        WHERE f.rec_id IS NULL""",
    "recs": """
        SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY saving DESC, preference) AS rank FROM (
          SELECT * FROM open_items QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY preference) <= 2)""",
    "questions": """
        SELECT o_custkey // 30 AS client_id, o_orderkey AS question_id,
               CASE o_orderpriority
                 WHEN '1-URGENT' THEN 'Can I afford $' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' today?'
                 WHEN '2-HIGH' THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
                 WHEN '3-MEDIUM' THEN 'What should I do next?'
                 WHEN '5-LOW' THEN 'Is 1500 a good number?' ELSE '  ' END AS question,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)
                    WHEN o_orderpriority = '5-LOW' THEN 1500.0 END AS amount,
               o_orderpriority AS kind
        FROM orders""",
    "turns": """
        SELECT c_custkey // 30 AS client_id, 2 * c_custkey AS turn, 'user' AS role, 'How is my budget?' AS content FROM customer
        UNION ALL
        SELECT c_custkey // 30, 2 * c_custkey + 1, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'system' ELSE 'assistant' END,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'What is the Purchase Amount?'
                    WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'You are on track.' END FROM customer""",
    "last_said": """
        SELECT client_id, arg_max(content, turn) AS previous FROM turns
        WHERE role = 'assistant' AND content IS NOT NULL GROUP BY 1""",
    "context": """
        SELECT b.client_id, b.as_of_date, CAST(b.mtd AS DOUBLE) AS mtd, CAST(b.monthly_limit AS DOUBLE) AS lim,
               CAST(b.monthly_limit - b.mtd AS DOUBLE) AS remaining, b.util, s.predicted, s.projected
        FROM budget b LEFT JOIN signals s ON b.client_id = s.client_id WHERE b.monthly_limit IS NOT NULL""",
    "intents": """
        SELECT q.*, kind = '4-NOT SPECIFIED' AS is_empty, kind = '2-HIGH' AS is_amount_only,
               kind = '1-URGENT' OR (kind = '2-HIGH' AND coalesce(l.previous, '') = 'What is the Purchase Amount?') AS is_affordability
        FROM questions q LEFT JOIN last_said l ON q.client_id = l.client_id""",
    "answers": """
        SELECT i.client_id, question_id, question, amount, mtd, lim, remaining, as_of_date,
               util, predicted, projected,
               CASE WHEN is_empty THEN 'empty' WHEN c.client_id IS NULL THEN 'no_context'
                    WHEN is_affordability THEN 'affordability' ELSE 'other' END AS route,
               round(remaining - amount, 2) AS after
        FROM intents i LEFT JOIN context c ON i.client_id = c.client_id""",
}


def _late(sql: str) -> str:
    """The same view ten days later, when a runway can be short without an overspend."""
    for name in LATE_VIEWS:
        sql = sql.replace(f"FROM {name}", f"FROM {name}_late").replace(f"JOIN {name}", f"JOIN {name}_late")
    return sql.replace("2000-06-15", LATE_AS_OF).replace("dim - 15", "dim - 25")


LATE_VIEWS = ("budget", "latest", "signals", "inputs")
VIEW_SQL.update({f"{name}_late": _late(VIEW_SQL[name]) for name in LATE_VIEWS})


LAST_DAY_VIEWS = ("recurring", "window90", "hits", "items")


def _at_last_day(sql: str) -> str:
    """The same view with each client's last transaction day in place of one date for all."""
    for name in LAST_DAY_VIEWS:
        sql = sql.replace(f"FROM {name}", f"FROM {name}_last").replace(f"JOIN {name}", f"JOIN {name}_last")
    return sql.replace("FROM ctx", "FROM ctx JOIN last_day USING (client_id)").replace("TIMESTAMP '2000-06-15'", "CAST(as_of AS TIMESTAMP)")


VIEW_SQL["last_day"] = "SELECT client_id, max(CAST(transaction_dt AS DATE)) AS as_of FROM ctx GROUP BY 1"
VIEW_SQL.update({f"{name}_last": _at_last_day(VIEW_SQL[name]) for name in LAST_DAY_VIEWS})
VIEW_SQL["recs_last"] = """
    SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY saving DESC, preference) AS rank FROM (
      SELECT * FROM items_last QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY preference) <= 2)"""

#: Views that are computed once: a row number, and what the model reads again and again.
STORED_VIEWS: set[str] = set()


def with_views(sql: str) -> str:
    """Put the views that `sql` names, and those they name, in front of it."""
    import re

    needed: list[str] = []
    open_views: set[str] = set()  # a recursive view names itself

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and name not in open_views and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                open_views.add(name)
                visit(VIEW_SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    kept = "AS MATERIALIZED"
    heads = ", ".join(f"{name} {kept if name in STORED_VIEWS else 'AS'} ({VIEW_SQL[name]})" for name in needed)
    return f"WITH{' RECURSIVE' if 'gauss' in needed else ''} {heads} {sql}"
