"""Driver queries: operators applied to the driver tables, and SQL that checks them."""
