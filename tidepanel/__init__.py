"""Panel forecasting analytics expressed as Spark DataFrame operators."""
