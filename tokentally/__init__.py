"""Usage, cost and billing tables over model-usage records, as Spark DataFrame operators."""
