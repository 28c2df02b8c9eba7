"""Labelled multivariate time series on Spark: prepare, window, score, alarm, evaluate, rank."""
