"""Passage dedup of texts with a period."""

import random

from test_hot_files import check


def test_periodic_texts(spark):
    rnd = random.Random(41)
    texts = {p: ("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=p - 1)) + "\n") * 5 for p in range(60, 76)}
    check(spark, texts)
