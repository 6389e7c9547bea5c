"""Names, windows, weights, thresholds and texts the results depend on."""

# Campaign calendar.
CAMPAIGNS = [
    {
        "campaign": "New Year", "month": 1, "day": 1, "window": 7,
        "default_lift": 2.2, "baseline_units": 100,
        "keywords": ["All", "Technology", "Furniture", "Office Supplies", "Phones", "Accessories",
                     "Appliances", "Copiers", "Chairs", "Tables", "Storage", "Binders"],
    },
    {
        "campaign": "Valentine's Day", "month": 2, "day": 14, "window": 7,
        "default_lift": 2.5, "baseline_units": 110,
        "keywords": ["All", "Accessories", "Furniture", "Home Office", "Art", "Paper",
                     "Phones", "Tables", "Chairs", "Labels", "Storage"],
    },
    {
        "campaign": "Halloween", "month": 10, "day": 31, "window": 7,
        "default_lift": 2.3, "baseline_units": 105,
        "keywords": ["All", "Furniture", "Office Supplies", "Storage", "Art", "Paper",
                     "Binders", "Appliances", "Chairs", "Tables"],
    },
    {
        "campaign": "Christmas", "month": 12, "day": 25, "window": 14,
        "default_lift": 3.0, "baseline_units": 130,
        "keywords": ["All", "Technology", "Furniture", "Office Supplies", "Phones", "Accessories",
                     "Copiers", "Appliances", "Bookcases", "Chairs", "Tables", "Storage"],
    },
]
PINNED_CAMPAIGN = "New Year"
UNFILTERED_KEYWORD = "All"

# Header aliases, in order of preference.
DATE_ALIASES = ["order.date", "order_date", "order date", "date", "transaction_date"]
SALES_ALIASES = ["sales", "sale_amount", "revenue", "amount"]
SKU_ALIASES = ["product.id", "product_id", "sku"]
NAME_ALIASES = ["product.name", "product_name", "name"]
CATEGORY_ALIASES = ["category", "category_1", "category_name_1", "sub.category", "sub_category"]
DEFAULT_CATEGORY = "General"
UNKNOWN_CATEGORY = "Unknown"

# Lift.
DAYS_AFTER_HOLIDAY = 1
MIN_BASELINE_DAYS = 5
OBSERVED_LIFT_RANGE = (0.5, 5.0)
PLANNED_LIFT_RANGE = (2.0, 5.0)
PLANNED_LIFT_FACTOR = 1.35

# Campaign action.
PEAK_FACTOR = 1.3
STRATEGY = "Maximize GMV"
ACTION_HIGH = ("Increase Stock Levels", "green")
ACTION_LOW = ("Run Discount Ads", "yellow")

# SKU metrics and signals.
RECENT_DAYS = 90
BASE_DAYS = 180
DEFAULT_PRESSURE = 0.5
DEFAULT_MARGIN = 0.25
LOW_MARGIN = 0.10
SIGNAL_STOCKOUT = "Stockout Risk"
SIGNAL_MARGIN = "Margin Watch"
SIGNAL_TRENDING = "Trending"
SIGNAL_AGING = "Aging Stock"
SIGNAL_ORGANIC = "Organic Demand"
STRATEGY_BY_SIGNAL = [
    ("Stockout Risk", "Urgent Replenish", "#E53E3E"),
    ("Margin Watch", "Protect Margin", "#805AD5"),
    ("Trending", "Boost Visibility", "#D69E2E"),
    ("Aging Stock", "Clearance", "#E53E3E"),
    ("Organic Demand", "Protect Margin", "#48BB78"),
    ("High Search Vol", "Light Discount", "#4299E1"),
]

# Hero ranking.
HERO_COUNT = 10
MIN_CANDIDATES = 30
SCORE_WEIGHTS = {"sales": 0.35, "trend": 0.20, "velocity": 0.15, "health": 0.30}

# Planner, scenarios and stockout risk.
DISCOUNT_BOOST = 1.2
MAX_DISCOUNT = 30
SCENARIO_DAYS = 30
DISCOUNT_ELASTICITY = 0.5
RISK_HIGH_DAYS = 2
RISK_MEDIUM_DAYS = 7
ADVICE_LOW_STOCK = "Reduce discount to preserve stock for later days."
ADVICE_HEALTHY = "Stock levels look healthy for this campaign window."
AT_RISK_DAYS = 14
AT_RISK_PRESSURE = 0.25
RANGE_DAYS = 3

# Inventory.
TOP_SKUS = 300
WAREHOUSES = ["New York", "London", "Sydney", "Paris", "Berlin"]
SUPPLIERS = ["Global Trade Co.", "Aster Wholesale", "Vertex Imports", "Nimbus Supply"]
DEFAULT_RESERVED = 0
DEFAULT_LEAD_TIME = 14
DEFAULT_STATUS = "active"

# Live operations.
CRITICAL_MINUTES = 20
PACING_FLOOR = 0.8
TICKER_ROWS = 10
DIAGNOSIS_DEMAND = ("Demand > Supply. Margin loss risk.", "Raise Price 5%")
DIAGNOSIS_PACING = ("Pacing 20% behind target.", "Trigger Flash Push")
DIAGNOSIS_ON_TRACK = ("On track.", "Monitor")

# Message templates; {name} is the product name.
URGENT = "Urgent"
PLAYFUL = "Playful"
TEMPLATES = {
    URGENT: [
        "🔴 Flash sale on {name}! Lowest price of the year—limited time only.",
        "⚡ {name} is selling out fast. Grab yours before we run out!",
        "🚨 {name} deal ends in 2 hours. Don't miss out!",
        "⏰ Last chance: {name} at its best price. Ends soon!",
        "💥 {name} on mega discount today only. Act fast!",
    ],
    PLAYFUL: [
        "✨ Psst... {name} just got an amazing price! Your wallet will thank you.",
        "🎉 {name}? Yes, please! And at this price? Even better.",
        "💎 Treat yourself: {name} is now at an unbeatable price.",
        "🛍️ {name} called—it said you deserve it at this price.",
        "🌟 Found something you'll love: {name} is now a steal!",
    ],
}
MESSAGES_PER_PRODUCT = 3
MIN_MESSAGE_LENGTH = 10
NUMBERING = r"^\s*\d+[\s\.:-]*"
