"""Document quality analytics on Spark: rules, issues, edits and evaluation as DataFrame operators."""
