"""Training-data operators: URL rules, decontamination, chat formatting, sharding, quality, secrets, repeated
passages, embedding near-duplicates, packing, n-gram joins, byte-level BPE, conversation tries, Merkle manifests.

Nothing outside this folder imports it; ``queries`` holds the registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# functions for executors travel by value: they need no copy of this package there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
