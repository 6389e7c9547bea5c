"""Schemas of the canonical tables, the relational tables and the documents."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(spec: str, **nested: T.DataType) -> T.StructType:
    """A schema from ``name type`` pairs, without needing a session; nested fields follow."""
    pairs = [field.split() for field in spec.split(",")]
    fields = [T.StructField(name, _TYPES[kind]) for name, kind in pairs]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in nested.items()])


def _rows(spec: str) -> T.ArrayType:
    return T.ArrayType(_struct(spec))


SALES = _struct(
    "order_date date, sku string, name string, category string, country string, sales double"
)
SKU_DAY = _struct("sku string, category string, order_date date, sales double, n_lines bigint")
INVENTORY = _struct(
    "sku string, name string, category string, warehouse string, supplier string,"
    " cost_price double, msrp double, qty_on_hand int, qty_reserved int, reorder_point int,"
    " last_restock_date date, lead_time_days int"
)

METRICS = _struct(
    "search_volume_trend double, inventory_age_days bigint, demand_velocity double,"
    " stock_pressure double, stockout_days double, lead_time_days bigint, gross_margin_pct double"
)
HERO = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("metrics", METRICS),
    T.StructField("ai_signal", T.StringType()),
    T.StructField("priority_score", T.DoubleType()),
])
CAMPAIGN_ENTRY = T.StructType([
    T.StructField("peak_date", T.StringType()),
    T.StructField("projected_volume", T.LongType()),
    T.StructField("campaign_lift_multiplier", T.DoubleType()),
    T.StructField("observed_lift_multiplier", T.DoubleType()),
    T.StructField("avg_units_per_product_baseline", T.LongType()),
    T.StructField("hero_products", T.ArrayType(HERO)),
    T.StructField("strategy", T.StringType()),
    T.StructField("action_item", T.StringType()),
    T.StructField("status_color", T.StringType()),
])
DASHBOARD = T.StructType([
    T.StructField("Campaigns", T.MapType(T.StringType(), CAMPAIGN_ENTRY)),
])

LIVE_DOCUMENT = _struct(
    "liveOpsLabel string, onlineUsers bigint",
    gmv=_struct("current bigint, target bigint, projectionPct bigint"),
    velocity=_struct("currentOrdersPerMin bigint, deltaPct bigint"),
    criticalInterventions=_rows("sku string, reason string, etaOosMins bigint"),
    oosWatchlist=_rows("sku string, name string, oosMins bigint, diagnosis string, action string"),
    liveSalesHistory=_rows("name string, etaMins bigint, time timestamp"),
)

# The star-schema source tables; given to the reader, so no file is opened to infer them.
STAR = {
    "nation": _struct("n_nationkey int, n_name string, n_regionkey int"),
    "customer": _struct(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": _struct(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": _struct(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": _struct(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": _struct(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
        " props string"
    ),
    "conversations": _struct("conv_id bigint, turn bigint, role string, text string"),
}
EVENTS = STAR["events"]

# The relational tables: schema, defaults for missing values, required columns, unique key.
TABLES = {
    "sales_data": {
        "schema": _struct(
            "id bigint, sku string, category_name_1 string, category_name_2 string,"
            " category_name_3 string, date date, sales_quantity int, gmv double,"
            " created_at timestamp, updated_at timestamp"
        ),
        "defaults": {},
        "required": ["sku", "date"],
        "unique": ["sku", "date"],
    },
    "campaigns": {
        "schema": _struct(
            "id bigint, name string, start_date date, peak_date date, end_date date,"
            " projected_volume double, strategy string, action_items string, status string,"
            " created_at timestamp, updated_at timestamp"
        ),
        "defaults": {"status": "active"},
        "required": ["name", "start_date", "end_date"],
        "unique": ["name"],
    },
    "campaign_products": {
        "schema": _struct(
            "id bigint, campaign_id bigint, sku string, category string, rank int,"
            " expected_sales int, created_at timestamp"
        ),
        "defaults": {},
        "required": ["campaign_id", "sku"],
        "unique": ["id"],
    },
    "campaign_forecasts": {
        "schema": _struct(
            "id bigint, campaign_id bigint, date date, historical_gmv double,"
            " forecasted_gmv double, upper_bound double, lower_bound double, created_at timestamp"
        ),
        "defaults": {},
        "required": ["campaign_id", "date"],
        "unique": ["id"],
    },
    "inventory": {
        "schema": _struct(
            "id bigint, sku string, warehouse string, supplier string, cost_price double,"
            " msrp double, qty_on_hand int, qty_reserved int, reorder_point int,"
            " last_restock_date date, lead_time_days int, created_at timestamp,"
            " updated_at timestamp"
        ),
        "defaults": {"qty_reserved": 0, "lead_time_days": 14},
        "required": ["sku", "cost_price", "qty_on_hand"],
        "unique": ["sku"],
    },
    "simulation_results": {
        "schema": _struct(
            "id bigint, campaign_id bigint, total_revenue double, created_at timestamp",
            scenario_params=_struct("discount_pct double, demand_multiplier double"),
            stockout_days=T.MapType(T.StringType(), T.DoubleType()),
        ),
        "defaults": {},
        "required": [],
        "unique": ["id"],
    },
}
