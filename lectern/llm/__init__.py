"""Training-data operators for very large corpora.

Nothing outside this package imports it, so a deployment can leave it out.
"""
