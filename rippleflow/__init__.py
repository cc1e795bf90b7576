"""Change-impact analytics on Spark: facts in, decisions out."""
