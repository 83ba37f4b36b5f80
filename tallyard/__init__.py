"""Spark-first analytics over software-engineering tables: pull requests, functions, vectors, reviews, text."""
