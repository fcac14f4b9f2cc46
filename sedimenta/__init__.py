"""Spark-native analytics over keyed transaction tables and document corpora."""
