"""Imbalance repair, synthetic rows and near-duplicate lines as Spark DataFrame operators."""
