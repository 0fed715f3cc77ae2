"""Spark-native preparation, augmentation and evaluation of long-signal datasets."""
