"""reelscope: review analytics on Spark.

Column functions live in ``reelscope.functions``, DataFrame operators in
``reelscope.operators``, readers and writers in ``reelscope.sources``, end-to-end flows and
the checked query catalog in ``reelscope.plans``. ``reelscope.streaming`` holds no operator:
the reference has no streaming, and the column functions work unchanged on a streaming
DataFrame.
"""

__version__ = "0.1.0"
