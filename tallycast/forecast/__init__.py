"""Forecast methods, ensembles, post-processing, backtest and report over keyed series."""
