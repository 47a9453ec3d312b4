"""Analytics operators for versioned document collections, on Spark."""
