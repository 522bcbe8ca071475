"""quarry: retrieval-augmented QA data preparation and measurement on Spark.

Every stage is a DataFrame / SQL job: exact and approximate inner-product
search, passage gathering, a partitioned retrieval cache, keyed Gumbel
sampling, prompt / label assembly under a token budget, batching, and
measurement (recall, lengths, checks, smoothed metrics) in batch and in
Structured Streaming.
"""

from quarry.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
