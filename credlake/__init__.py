"""credlake: news-credibility analytics expressed as Spark DataFrame operators."""
