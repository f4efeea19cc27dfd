"""Declared schemas and keys of the ten retail tables."""

from __future__ import annotations

# Table and column names and types of the source data.
_DDL = {
    "campaigns": """
        campaign_id string, campaign_name string, channel string, campaign_type string,
        objective string, start_date date, end_date date, budget int""",
    "customers": """
        customer_id string, signup_date date, gender string, age_group string, city string,
        state string, acquisition_date date, acquisition_channel string,
        acquisition_campaign_id string""",
    "products": """
        product_id string, product_name string, category string, subcategory string,
        brand string, price decimal(8,2), cost decimal(8,2)""",
    "stores": """
        store_id string, store_name string, city string, state string, store_type string,
        opening_date date""",
    "marketing_spend": """
        date date, campaign_id string, spend int, impressions int, clicks int""",
    "marketing_touchpoints": """
        touchpoint_id string, customer_id string, campaign_id string, timestamp timestamp_ntz,
        channel string, interaction_type string, device string""",
    "sessions": """
        session_id string, customer_id string, session_start timestamp_ntz, device string,
        source string, campaign_id string, landing_page string, session_duration_sec int,
        pages_viewed int""",
    "orders": """
        order_id string, customer_id string, order_date date, sales_channel string,
        store_id string, payment_method string, order_status string,
        gross_amount decimal(8,2), discount_amount decimal(8,2), shipping_amount decimal(8,2),
        net_amount decimal(8,2)""",
    "order_items": """
        order_id string, product_id string, quantity int, unit_price decimal(8,2),
        discount_amount decimal(8,2)""",
    "returns": """
        return_id string, order_id string, product_id string, return_date date,
        return_quantity int, return_reason string, refund_amount decimal(8,2)""",
}

SCHEMAS = {table: " ".join(ddl.split()) for table, ddl in _DDL.items()}

PRIMARY_KEYS = {
    "campaigns": ["campaign_id"],
    "customers": ["customer_id"],
    "products": ["product_id"],
    "stores": ["store_id"],
    "marketing_spend": ["date", "campaign_id"],
    "marketing_touchpoints": ["touchpoint_id"],
    "sessions": ["session_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "product_id"],
    "returns": ["return_id"],
}

# (child table, child columns, parent table); parent columns are its primary key.
FOREIGN_KEYS = [
    ("customers", ["acquisition_campaign_id"], "campaigns"),
    ("marketing_spend", ["campaign_id"], "campaigns"),
    ("marketing_touchpoints", ["customer_id"], "customers"),
    ("marketing_touchpoints", ["campaign_id"], "campaigns"),
    ("sessions", ["customer_id"], "customers"),
    ("sessions", ["campaign_id"], "campaigns"),
    ("orders", ["customer_id"], "customers"),
    ("orders", ["store_id"], "stores"),
    ("order_items", ["order_id"], "orders"),
    ("order_items", ["product_id"], "products"),
    ("returns", ["order_id", "product_id"], "order_items"),
]
