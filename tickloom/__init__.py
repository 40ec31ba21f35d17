"""tickloom: market-data analytics as composable Spark DataFrame operators over long-format tables."""
