"""Thicketry: Spark-native selection, retrieval and evaluation over keyed vectors, maps and texts."""
