"""kordel: a Spark engine for building and auditing command corpora."""
