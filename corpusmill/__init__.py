"""Corpus preparation on Spark: crawled pages in, training-ready text out."""
