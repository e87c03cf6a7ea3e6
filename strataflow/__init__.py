"""Spark-first analytics over keyed, ordered log series and their reference curves."""

__version__ = "0.1.0"
