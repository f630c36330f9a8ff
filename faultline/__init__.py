"""Spark-native analytics over builds that dependency upgrades broke."""
