"""Moving-average pattern analytics over time-series bars, as Spark DataFrame operators."""
