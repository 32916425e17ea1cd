"""stepfold: Spark-first analytics over ordered command/response event logs."""
