"""Analytics over recorded trading sessions, as DataFrame-to-DataFrame operators on Spark."""
