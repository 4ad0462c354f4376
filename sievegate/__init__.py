"""A Spark-first engine that decides whether a text dataset is fit for training or evaluation."""

__version__ = "0.1.0"
