"""sagewell: build and query knowledge bases from crawled pages and conversations with Spark."""

__version__ = "0.1.0"
