"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator keeps to
four rules: whole inputs (no cap, prefix or sample of what it judges), no
collection that grows with the corpus, hot keys split before they meet in one
task, and intermediate tables in the cluster's shared checkpoint folder.
"""
