"""Shelfwise: a Spark-native catalogue query and analytics engine."""
