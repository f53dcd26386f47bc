"""Page-text analytics on Spark: DataFrame and SQL operators over page-structured text."""
