"""Analytics over evidence-backed records taken from web pages and documents, on Spark."""
