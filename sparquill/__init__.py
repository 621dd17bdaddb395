"""Analytics over semi-structured page collections, written for Spark."""
