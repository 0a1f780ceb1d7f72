"""auditlens: label-audit analytics on Spark."""
