"""Analysis and feature engineering of tables, declared in DataFrame operations."""
