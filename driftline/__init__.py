"""Spark-native evaluation of event detectors across a source and a target domain."""
