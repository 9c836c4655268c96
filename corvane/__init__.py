"""Corvane: a PySpark-native engine for annotation experiments.

Record files, growing pools of annotated items, nearest-example prompts, formula scores, run statistics, ordered
series, clusters and reports, all as DataFrame operators.
"""

__version__ = "0.1.0"
