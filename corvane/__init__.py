"""Corvane: text-corpus analytics and evaluation statistics as Spark DataFrame operators."""
