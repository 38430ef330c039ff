"""Topic modelling around a pluggable encoder (M1-M9, A28-A32, O3, O4, W6 of the survey).

The reference calls a library (encoder -> reduction -> density clustering -> class-based
TF-IDF). Here the dataflow is Spark: vectors come from a user encoder or from TF-IDF weights
(M1), clusters from ``density_topics`` or from seeded k-means (M2), and everything after the topic
ids is exact relational work: term counts per (group, topic, term) with partial
aggregation, class-based TF-IDF by joins on the term and topic keys, and top-k per topic
with ``row_number() <= k`` (planned as a partial WindowGroupLimit, so a topic holding a
third of all rows still forwards only k candidates per task).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions.numbers import dominant_sentiment, pct, round_half_even
from reelscope.functions.text import format_pct, keyword_string, tokens
from reelscope.operators.ordering import with_rank
from reelscope.operators.reshape import explode_list
from reelscope.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # functions for executors need no copy of the package there

OUTLIER = -1
SALTS = 64
PACKED_ROWS = 2000
DOMINANT_CLASSES = ["POSITIVE", "NEGATIVE", "NEUTRAL", "MIXED", "MOSTLY_POSITIVE", "MOSTLY_NEGATIVE"]


# ------------------------------------------------------------------ M1, M2: vectors and clusters

def embed(df: DataFrame, text: str, out: str = "embedding", make_encoder: Callable | None = None,
          batch_size: int = 8, num_features: int = 1 << 14) -> DataFrame:
    """M1: one vector per text. With ``make_encoder`` (called once per Python worker,
    returning ``encode(texts) -> (n, d) array``) the encoder runs over Arrow batches; the
    built-in default is HashingTF + IDF + L2 normalisation, all in Spark ML."""
    if make_encoder is not None:
        from pyspark.ml.functions import predict_batch_udf

        enc = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
        return df.withColumn(out, enc(F.coalesce(F.col(text), F.lit(""))))
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    toks = df.withColumn("_toks", tokens(F.col(text)))
    pipe = Pipeline(stages=[HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_vec")])
    model = pipe.fit(toks)
    return model.transform(toks).withColumn(out, vector_to_array("_vec", "float32")).drop("_toks", "_tf", "_idf", "_vec")


def _bags(group: np.ndarray, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(group, place of its word, count) of every distinct word of every group, in their order, and the words' texts."""
    coded = words.dictionary_encode()
    wide = max(len(coded.dictionary), 1)
    pairs, where = np.unique(group * wide + coded.indices.to_numpy().astype(np.int64), return_inverse=True)
    return pairs // wide, pairs % wide, np.bincount(where, n, len(pairs)).astype(np.int64), coded.dictionary


def _packed(rows: pa.Array, group: np.ndarray, words: pa.Array, n: np.ndarray) -> pa.Table:
    """Rows of ``_bags`` as one row a group: the ``rows`` (a key a group), the words' bytes, their lengths and their counts."""
    at = np.searchsorted(group, np.arange(len(rows) + 1))
    words = pa.concat_arrays([words])
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    binary = lambda offsets, data: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), data])
    return pa.table([rows, binary(ends[at], words.buffers()[2] if len(words) else pa.py_buffer(b"")),
                     binary(at * 4, pa.py_buffer(np.diff(ends).astype(np.int32))), binary(at * 8, pa.py_buffer(n.astype(np.int64)))],
                    ["_key", "_words", "_sizes", "_ns"])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, word, count) of every word of packed ``rows``."""
    sizes = np.frombuffer(b"".join(rows["_sizes"].to_pylist()), np.int32)
    n = np.frombuffer(b"".join(rows["_ns"].to_pylist()), np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    words = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(rows["_words"].to_pylist()))])
    return np.repeat(np.arange(rows.num_rows), pc.binary_length(rows["_sizes"]).to_numpy() // 4), words.cast(pa.string()), n


def _bags_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Packed rows, sorted by key, in parts of whole keys: the keys and their ``_bags``. The bag of a key that goes on is
    put together part by part, so it holds each of its words once."""
    def merged(rows: pa.Table) -> tuple:
        key = rows["_key"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        row, words, n = _unpacked(rows)
        return rows["_key"].combine_chunks().take(pa.array(np.flatnonzero(new))), *_bags((np.cumsum(new) - 1)[row], words, n)

    kept = None
    for batch in batches:
        for part in _split(pa.Table.from_batches([batch]), "_words"):
            keys, group, word, n, words = merged(part if kept is None else pa.concat_tables([kept, part]))
            last = int(np.searchsorted(group, len(keys) - 1))
            kept = _packed(keys[len(keys) - 1:], group[last:] - (len(keys) - 1), words.take(pa.array(word[last:])), n[last:])
            if len(keys) > 1:
                yield keys[:len(keys) - 1], group[:last], word[:last], n[:last], words
    if kept is not None:
        yield merged(kept)


def tfidf_weights(df: DataFrame, key: str, text: str, toks: Column | None = None) -> DataFrame:
    """M1, sparse: ``key, term, weight`` for every term of every text, over the true vocabulary.

    The weight is the term's count in the text times ln((1 + N) / (1 + d)), with N the number of rows and d the
    number of rows that hold the term; each row's weights are then scaled to length 1. Terms that every row holds
    weigh 0 and are left out, as are rows without terms (the zero vector). ``key`` identifies a row; null is one key.

    A text is packed into one row of its distinct terms and their counts before any shuffle, and only such rows travel: once
    to count the terms of a bucket of keys, once to meet that bucket's terms with their weights. There are as many buckets
    as shuffle partitions; a bucket asks once for each of its terms, so neither (text, term) rows nor the
    whole vocabulary are ever shuffled to a task. A task holds the distinct terms of its bucket and a part of its texts."""
    spark, kind = df.sparkSession, df.schema[key].dataType
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = df.select(F.col(key).alias("_key"), (tokens(F.col(text)) if toks is None else toks).alias("_toks"))
    binary = [T.StructField(c, T.BinaryType()) for c in ("_words", "_sizes", "_ns")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED_ROWS):
                some = batch.slice(at, PACKED_ROWS)
                lists = some.column("_toks")
                row, words = np.repeat(np.arange(some.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), pc.list_flatten(lists)
                given = words.is_valid().to_numpy(zero_copy_only=False)
                row, words = row[given], words.drop_null()
                group, word, n, names = _bags(row, words, np.ones(len(words)))
                rows = _packed(some.column("_key"), group, names.take(pa.array(word)), n)
                yield from rows.filter(pc.greater(pc.binary_length(rows["_words"]), 0)).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, word, _, words in _bags_of_keys(batches):
            held = np.bincount(word, minlength=len(words))
            one = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(one)), pa.array(held[one])], ["term", "_d"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = [], []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:  # the terms come first
                asked = batch.column("_idf").is_valid()
                terms.append(batch.filter(asked).column("_term"))
                idf.append(batch.filter(asked).column("_idf").to_numpy())
                rest = batch.filter(pc.invert(asked))
                if rest.num_rows:
                    yield rest.select(["_key", "_words", "_sizes", "_ns"])

        known = None
        for keys, group, word, n, words in _bags_of_keys(texts()):
            if known is None:
                known, weight = pa.concat_arrays(terms), np.concatenate([*idf, [0.0]])
            at = pc.fill_null(pc.index_in(words, known), len(known)).to_numpy()  # unknown terms are held by every row
            w = n * weight[at][word]
            group, word, w = (x[w > 0] for x in (group, word, w))
            w = w / np.sqrt(np.bincount(group, w * w, len(keys)))[group]
            for a in range(0, len(w), 100_000):
                some = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(group[some])), words.take(pa.array(word[some])), pa.array(w[some])],
                                                 [key, "term", "weight"])

    bags = listed.where("_toks is not null").mapInArrow(pack, T.StructType([T.StructField("_key", kind), *binary]))
    bags = bags.withColumn("_bucket", F.pmod(F.hash("_key"), F.lit(buckets))).repartitionById(buckets, "_bucket")
    held = bags.drop("_bucket").sortWithinPartitions("_key").mapInArrow(count, "term string, _d long")
    held = held.withColumn("_bucket", F.spark_partition_id()).groupBy("term").agg(
        F.sum("_d").alias("_d"), F.collect_set("_bucket").alias("_buckets"))
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    idf = held.crossJoin(F.broadcast(total)).select(  # one row
        F.col("term").alias("_term"), F.log((1 + F.col("_rows")) / (1 + F.col("_d"))).alias("_idf"), "_buckets")
    asked = idf.where("_idf > 0").select("_term", "_idf", F.explode("_buckets").alias("_bucket"))
    met = bags.unionByName(asked, allowMissingColumns=True).repartitionById(buckets, "_bucket")
    met = met.drop("_bucket").sortWithinPartitions(F.col("_idf").isNull(), "_key")
    return met.mapInArrow(weigh, T.StructType([T.StructField(key, kind), T.StructField("term", T.StringType()),
                                               T.StructField("weight", T.DoubleType())]))


def assign_topics(df: DataFrame, vec: str = "embedding", k: int = 10, seed: int = 7, min_size: int = 3,
                  outlier_quantile: float | None = 0.95, out: str = "topic", max_iter: int = 20) -> DataFrame:
    """M2: topic id per row from k-means on the vectors (seeded, so repeatable); clusters
    smaller than ``min_size`` and points farther from their centre than the cluster's
    ``outlier_quantile`` distance become -1. The exact clusters of the reference's
    library cannot be reproduced (it sets no seed)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", maxIter=max_iter).fit(v)
    centres = [list(map(float, c)) for c in model.clusterCenters()]  # k x d, bounded by k
    pred = model.transform(v)
    cen = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    mine = F.element_at(cen, F.col("_c") + 1)
    arr = F.col(vec).cast("array<double>")
    dist = F.sqrt(F.aggregate(F.zip_with(arr, mine, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    pred = pred.withColumn("_dist", dist)
    stats = pred.groupBy("_c").agg(F.count(F.lit(1)).alias("_size"),
                                   *([F.percentile_approx("_dist", outlier_quantile).alias("_cut")]
                                     if outlier_quantile is not None else []))
    pred = pred.join(F.broadcast(stats), "_c")  # one row per cluster: k rows
    far = (F.col("_dist") > F.col("_cut")) if outlier_quantile is not None else F.lit(False)
    topic = F.when((F.col("_size") < min_size) | far, F.lit(OUTLIER)).otherwise(F.col("_c"))
    return pred.withColumn(out, topic.cast("long")).drop("_v", "_c", "_dist", "_size", "_cut")


def topic_centres(df: DataFrame, topic: str = "topic", vec: str = "embedding") -> DataFrame:
    """The mean vector of every topic but -1: ``topic, centre``."""
    cells = df.filter(F.col(topic) != OUTLIER).select(F.col(topic).alias("topic"), F.posexplode(vec).alias("_i", "_x"))
    means = cells.groupBy("topic", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    rows = means.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c"))
    return rows.select("topic", F.transform("_c", lambda c: c["_m"]).alias("centre"))


def assign_to_centres(df: DataFrame, centres: DataFrame, key: str, vec: str = "embedding", out: str = "topic") -> DataFrame:
    """M2, fixed-centre variant: per ``key`` the topic of the centre with the largest cosine similarity (the
    smallest topic on ties; null without a comparable centre). The centres stay a table. Each row meets every centre of
    its length; the join is salted, so neither one length nor one topic is one task, and only the best (similarity, topic) per
    row and task goes on."""
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    c = centres.select(F.col("topic").cast("long").alias("_t"), F.col("centre").alias("_c"), norm(F.col("centre")).alias("_cn"),
                       F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = df.select(key, F.col(vec).cast("array<double>").alias("_v"))
    rows = rows.withColumns({"_vn": norm(F.col("_v")), "_salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")})
    met = rows.join(c.withColumnRenamed("_salt", "_slot"), (F.col("_salt") == F.col("_slot")) & (F.size("_v") == F.size("_c")))
    dot = F.aggregate(F.zip_with("_v", "_c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    sim = F.try_divide(dot, F.col("_vn") * F.col("_cn"))
    best = met.select(key, "_t", sim.alias("_s")).groupBy(key).agg(F.max_by("_t", F.struct("_s", -F.col("_t"))).alias(out))
    return df.select(key).join(best, key, "left")


def rank_topics(df: DataFrame, keys: Sequence[str], topic: str = "topic", out: str = "topic") -> DataFrame:
    """M3: renumber topics 0.. by size (largest first, ties by old id) within each group;
    -1 stays -1. The ranking runs on the (group, topic) counts, one row per topic."""
    keys = list(keys)
    counts = df.filter(F.col(topic) != OUTLIER).groupBy(*keys, topic).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), F.col(topic))
    ranked = counts.withColumn("_new", (F.row_number().over(w) - 1).cast("long")).drop("_n")
    j = df.join(ranked, [*keys, topic], "left")
    return j.withColumn(out, F.coalesce(F.col("_new"), F.lit(OUTLIER).cast("long"))).drop("_new")


# ------------------------------------------------------------------ M4, M5, M6: terms and keywords

COUNTED_BYTES = 16 << 20  # texts that are counted at once in a task


def _split(rows: pa.Table, words: str) -> Iterator[pa.Table]:
    """``rows`` in parts of about ``COUNTED_BYTES`` of words, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows[words]), 0).to_numpy().astype(np.int64))
    part = np.concatenate([[0], ends[:-1]]) // COUNTED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), rows.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield rows.slice(start, end - start)


def _groups(rows: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The combination of ``by`` of every row as a number from 0, and the first row of each."""
    group = np.zeros(rows.num_rows, dtype=np.int64)
    for c in by:
        one = rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
        group = np.unique(group * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return group, np.unique(group, return_index=True)[1]


def _named(rows: pa.Table, by: list[str], words: pa.Array, terms: np.ndarray, **counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``by, term`` and ``counts`` of terms given as numbers (place of its row, word + 1, second word + 1 or 0)."""
    wide = len(words) + 1
    second = terms % wide
    for some in (second == 0, second > 0):
        left = words.take(pa.array(terms[some] // wide % wide - 1))
        term = pc.binary_join_element_wise(left, words.take(pa.array(second[some] - 1)), " ") if second[some].any() else left
        held = rows.select(by).take(pa.array(terms[some] // (wide * wide))).combine_chunks().append_column("term", term)
        for name, n in counts.items():
            held = held.append_column(name, pa.array(n[some]))
        yield from held.to_batches(max_chunksize=100_000)


def _count_part(rows: pa.Table, by: list[str], stop: pa.Array) -> Iterator[pa.RecordBatch]:
    """Per combination of ``by`` the words and pairs of words of the rows' ``_words``: the numpy side of ``count_ngrams``."""
    lists = pc.split_pattern(rows["_words"].combine_chunks(), " ")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if not len(ids):
        return
    of_row = np.arange(rows.num_rows)
    group, first = _groups(rows, by)
    wide = len(words) + 1
    if len(first) * wide * wide >= 1 << 61:  # keys would not fit into 64 bits
        half = rows.num_rows // 2
        yield from _count_part(rows.slice(0, half), by, stop)
        yield from _count_part(rows.slice(half), by, stop)
        return
    place = np.flatnonzero(~pc.is_in(words, stop).to_numpy(zero_copy_only=False)[ids])
    row, ids = np.repeat(of_row, lengths)[place], ids[place]
    pair = row[1:] == row[:-1]
    key = group[row] * wide * wide + (ids + 1) * wide
    keys = np.concatenate([key * 2 + 1, ((key[:-1] + ids[1:] + 1) * 2 + (place[1:] == place[:-1] + 1))[pair]])
    keys, counts = np.unique(keys, return_counts=True)
    if not len(keys):
        return
    terms = keys >> 1
    starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    n, n_raw, terms = np.add.reduceat(counts, starts), np.add.reduceat(counts * (keys & 1), starts), terms[starts]
    yield from _named(rows.take(pa.array(first)), by, words, terms, n=n, n_raw=n_raw)


def count_ngrams(df: DataFrame, text: str, by: Sequence[str], stopwords: Sequence[str]) -> DataFrame:
    """``by, term, n, n_raw``: parts of the counts of every word and pair of words (T9: stop words removed, then pairs), to be
    summed per (by, term). ``n_raw`` counts the occurrences that also stand so in the text with its stop words: all
    of a word's, and of a pair's those without a stop word between.

    Words are numbers within a part of a task's texts (``COUNTED_BYTES``), so a pair is one number too, and sorting
    numbers combines its occurrences before any term becomes a text and meets the shuffle."""
    by = list(by)
    words = F.array_join(tokens(F.col(text)), " ")  # a token holds no space
    src = df.select(*by, F.when(words != "", words).alias("_words"))
    stop = sorted(set(stopwords))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unwanted = pa.array(stop, pa.string())
        for batch in batches:
            for part in _split(pa.Table.from_batches([batch]), "_words"):
                yield from _count_part(part, by, unwanted)

    schema = T.StructType([*[src.schema[c] for c in by], T.StructField("term", T.StringType()),
                           T.StructField("n", T.LongType()), T.StructField("n_raw", T.LongType())])
    return src.where("_words is not null").mapInArrow(count, schema)


def topic_terms(df: DataFrame, text: str, keys: Sequence[str], stopwords: Sequence[str],
                topic: str = "topic", min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """M4: n-gram counts per (group, topic, term) after stop words; terms kept when the
    number of *topics* containing them (each topic is one text in class-based TF-IDF) is
    within [min_df, max_df]. The defaults keep every term at every size; the limits never
    depend on the number of documents. The parts are dealt by (group, term), as M5's window over a term's topics wants them."""
    keys = list(keys)
    parts = count_ngrams(df, text, [*keys, topic], stopwords).drop("n_raw").repartition(*keys, "term")
    counts = parts.groupBy(*keys, topic, "term").agg(F.sum("n").alias("n"))
    if min_df <= 1 and max_df is None:
        return counts
    per_term = Window.partitionBy(*keys, "term")  # at most one row per topic
    found = F.count(F.lit(1)).over(per_term)
    kept = (found >= min_df) if max_df is None else found.between(min_df, max_df)
    return counts.withColumn("_kept", kept).filter("_kept").drop("_kept")


def topic_keywords(terms: DataFrame, keys: Sequence[str], k: int = 5, topic: str = "topic",
                   carry: Sequence[str] = (), sizes: DataFrame | None = None) -> DataFrame:
    """M5: class-based TF-IDF, ``n/z * ln(1 + a/f)`` with n the term count in the topic,
    z the topic's total count, f the term's count over all topics and a the mean z of the
    group; the top ``k`` terms per topic (score rounded to 6 digits, ties by term). ``f`` is a
    window sum over (group, term), which holds at most one row per topic; ``z`` and ``a`` are
    one row per topic. Both read the same exchange of term counts, so texts are tokenised once. Columns of ``terms`` named
    in ``carry`` stay; ``sizes`` gives ``z`` as ``_z`` where it is known."""
    keys = list(keys)
    z = terms.groupBy(*keys, topic).agg(F.sum("n").alias("_z")) if sizes is None else sizes
    z = z.withColumn("_a", F.avg("_z").over(Window.partitionBy(*keys)))
    f = F.sum("n").over(Window.partitionBy(*keys, "term"))
    s = (terms.withColumn("_f", f).join(F.broadcast(z), [*keys, topic])  # a row per topic
              .withColumn("score", F.round(F.col("n") / F.col("_z") * F.log(1 + F.col("_a") / F.col("_f"))
                                           * F.lit(1e6)) / F.lit(1e6)))
    w = Window.partitionBy(*keys, topic).orderBy(F.col("score").desc(), F.col("term"))
    top = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(*keys, topic, F.col("term").alias("keyword"), "score", F.col("rank").cast("long"), *carry)


def keyword_lists(keywords: DataFrame, keys: Sequence[str], topic: str = "topic") -> DataFrame:
    """T8 on M5: the top keywords of each topic as an array and as ``, ``-joined text.
    Each topic contributes at most k rows, so the collected list is bounded by k."""
    g = keywords.groupBy(*keys, topic).agg(F.sort_array(F.collect_list(F.struct("rank", "keyword"))).alias("_r"))
    arr = F.transform("_r", lambda x: x["keyword"])
    return g.select(*keys, topic, arr.alias("top_keywords"), keyword_string(arr).alias("keyword_string"))


def keyword_frequencies(df: DataFrame, text: str, keys: Sequence[str], stopwords: Sequence[str], k: int = 10,
                        topic: str = "topic") -> DataFrame:
    """M6: the top ``k`` keywords of each topic (M5) and how often each phrase occurs in the topic's
    raw texts (words and adjacent-word pairs, stop words *not* removed); 0 when it never
    does (a bigram of the stop-word-free text can be absent from the raw text).

    A keyword holds no stop word, so its places in the raw text are among those where it was counted (``n_raw`` of
    ``count_ngrams``): texts are read once and nothing is joined back."""
    keys = list(keys)
    parts = count_ngrams(df, text, [*keys, topic], stopwords).repartition(*keys, "term")
    terms = parts.groupBy(*keys, topic, "term").agg(F.sum("n").alias("n"), F.sum("n_raw").alias("keyword_frequency"))
    # n_raw <= n always: with the same columns both readings share one exchange
    sizes = parts.groupBy(*keys, topic).agg(F.sum(F.when(F.col("n_raw") <= F.col("n"), F.col("n"))).alias("_z"))
    return topic_keywords(terms, keys, k, topic, carry=["keyword_frequency"], sizes=sizes)


def time_bins(df: DataFrame, keys: Sequence[str], stamp: str, bins: int = 20) -> DataFrame:
    """Rows with ``time_bin``: equal-width bins between the group's first and last time stamp, the last one closed."""
    keys = list(keys)
    secs = F.unix_micros(F.col(stamp).cast("timestamp")).cast("double")
    bounds = df.groupBy(*keys).agg(F.min(secs).alias("_lo"), F.max(secs).alias("_hi"))
    j = df.join(F.broadcast(bounds), keys)  # one row per group
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(F.floor((secs - F.col("_lo")) / width))
    return j.withColumn("time_bin", F.least(b, F.lit(bins - 1)).cast("long")).drop("_lo", "_hi")


def topics_over_time(df: DataFrame, keys: Sequence[str], stamp: str, bins: int = 20,
                     topic: str = "topic") -> DataFrame:
    """M8 (frequency part): rows per (group, topic, time bin) of ``time_bins``."""
    return time_bins(df, keys, stamp, bins).groupBy(*keys, topic, "time_bin").agg(
        F.count(F.lit(1)).alias("frequency"), F.min(stamp).alias("first_stamp"))


MARK_BITS = 23  # a term of a group has one of so many places (2 ** 23 bits are 1 MB)
SEED_SHARE = 20_000  # words rarer than one in so many terms of a part are no seeds


def _coded(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple]:
    """Rows with words in parts of about ``COUNTED_BYTES``: the rows, the combination of ``by`` of each, its first row,
    how many words each row has, the distinct words, and the (row, place of its word) of every occurrence."""
    def parts() -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for part in _split(rows.filter(pc.greater(pc.binary_length(rows["_words"]), 0)), "_words"):
                more = pc.sum(pc.binary_length(part["_words"])).as_py() or 0
                if held and size + more > COUNTED_BYTES:
                    yield pa.concat_tables(held)
                    held, size = [], 0
                if part.num_rows:
                    held, size = [*held, part], size + more
        if held:
            yield pa.concat_tables(held)

    for part in parts():
        todo = [part]
        while todo:
            rows = todo.pop()
            lists = pc.split_pattern(rows["_words"].combine_chunks(), " ")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.list_flatten(lists).dictionary_encode()
            group, first = _groups(rows, by)
            if len(first) * (len(coded.dictionary) + 1) ** 2 >= 1 << 62:  # numbers of terms would not fit into 64 bits
                todo += [rows.slice(0, rows.num_rows // 2), rows.slice(rows.num_rows // 2)]
                continue
            yield (rows, group, first, lengths, coded.dictionary, np.repeat(np.arange(rows.num_rows), lengths),
                   coded.indices.to_numpy().astype(np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every (non-empty) word's bytes, the same in every task."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    sizes = np.diff(ends)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    at = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
    return _mixed(np.add.reduceat(data * powers[at], ends[:-1] - ends[0]))


def _places(group: np.ndarray, word: np.ndarray, second: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    """The places of terms from the hashes of their group and words."""
    return (_mixed(word * np.uint64(0xD6E8FEB86659FD93) + second + group) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _bin_words(batches: Iterator[pa.RecordBatch], by: list[str], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """``by, term, n, _lost``: counts of the part's words per ``by``; under the null term the count of all words and pairs.
    Words that a part holds rarely in a group (at most ``_lost`` times, once per part and group beside the null term) are left out."""
    for rows, group, first, lengths, words, row, ids in _coded(batches, by):
        wide = len(words)
        total = np.bincount(group, 2 * lengths - 1).astype(np.int64)
        one = _groups(rows, keys)[0][first]
        few = np.bincount(one, total).astype(np.int64) // SEED_SHARE
        key, n = np.unique(group[row] * wide + ids, return_counts=True)
        at, word = key // wide, key % wide
        same = np.unique(one[at] * wide + word, return_inverse=True)[1]
        often = np.bincount(same, n)[same] > few[one[at]]
        at, word, n = at[often], word[often], n[often]
        lost = np.zeros(len(first) + len(at), np.int64)
        lost[np.unique(one, return_index=True)[1]] = few
        term = pa.concat_arrays([pa.nulls(len(first), words.type), words.take(pa.array(word))])
        held = rows.select(by).take(pa.array(np.concatenate([first, first[at]]))).combine_chunks()
        yield from held.append_column("term", term).append_column("n", pa.array(np.concatenate([total, n]))) \
                       .append_column("_lost", pa.array(lost)).to_batches(max_chunksize=100_000)


def _bin_marks(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """``_at``: the places of the terms whose weight in a bin could reach that bin's ``_reach``.

    A term's share of a bin is no larger than its largest share of one of the bin's parts, and share * ln(1 + a / (share * z)) grows with
    the share, so a term that is above ``_reach`` in the bin is so in a part."""
    for rows, group, first, lengths, words, row, ids in _coded(batches, by):
        wide = len(words) + 1
        key = group[row] * wide * wide + (ids + 1) * wide
        terms, n = np.unique(np.concatenate([key, (key[:-1] + ids[1:] + 1)[row[1:] == row[:-1]]]), return_counts=True)
        at = terms // (wide * wide)
        share = n / np.bincount(group, 2 * lengths - 1)[at]
        z, a, reach = (rows[c].combine_chunks().take(pa.array(first)).to_numpy(zero_copy_only=False)[at] for c in ("_z", "_a", "_reach"))
        some = share * np.log1p(a / (share * z)) >= reach
        at, word, second = at[some], terms[some] // wide % wide - 1, terms[some] % wide
        of_word, of_group = _hashes(words), rows["_group"].combine_chunks().take(pa.array(first)).to_numpy().view(np.uint64)
        places = _places(of_group[at], of_word[word], np.concatenate([[np.uint64(0)], of_word])[second])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(places))], ["_at"])


def _bin_terms(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """``by, term, n``: the counts of every word and pair whose place is among ``_marks``, which a task's first row brings."""
    marks = np.zeros(1 << MARK_BITS, bool)

    def read() -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            if not i:
                for bits in batch.column("_marks")[0].as_py():
                    at = (bits["bucket"] - 1) * 8 * len(bits["bits"])
                    marks[at:at + 8 * len(bits["bits"])] = np.unpackbits(np.frombuffer(bits["bits"], np.uint8), bitorder="little")
            yield batch.drop_columns(["_marks"])

    for rows, group, first, _, words, row, ids in _coded(read(), by):
        wide = len(words) + 1
        of_word, of_group = _hashes(words)[ids], rows["_group"].combine_chunks().to_numpy().view(np.uint64)[row]
        pair = np.flatnonzero(row[1:] == row[:-1])
        one = np.flatnonzero(marks[_places(of_group, of_word)])
        pair = pair[marks[_places(of_group[pair], of_word[pair], of_word[pair + 1])]]
        key = lambda at: group[row[at]] * wide * wide + (ids[at] + 1) * wide
        terms, n = np.unique(np.concatenate([key(one), key(pair) + ids[pair + 1] + 1]), return_counts=True)
        yield from _named(rows.take(pa.array(first)), by, words, terms, n=n)


def topic_words_over_time(df: DataFrame, text: str, keys: Sequence[str], stamp: str, stopwords: Sequence[str],
                          bins: int = 20, k: int = 5, topic: str = "topic") -> DataFrame:
    """M8 (words): the top ``k`` words of every topic in every time bin it occurs in.

    A term's weight in a (topic, bin) is ``n/z * ln(1 + a/f)``: n and z count the term and all terms there, f the term in
    the group, a the mean topic size of the group (M5). It is drawn towards the bin before, ``s = (weight + s before) / 2``,
    as long as the topic occurs in successive bins (a gap starts afresh), and the score is the mean of ``s`` and the
    term's weight in the whole topic, to 6 digits, ties by term. A term keeps one row per topic with a cell for each
    bin that holds it (at most ``bins``), and the recurrence runs inside that row; a word may be carried into a bin
    without it.

    Texts meet as their words, dealt by bin, and that one exchange is read three times. First words are counted: the scores
    of a topic's best words are a floor that the ``k`` best of a bin reach at least. Then every word and pair of words
    whose weight could lift it to a floor is marked by its hash (other terms with that hash come along, none is missed). At last
    the marked terms are counted in full, and only those counts are shuffled."""
    keys = list(keys)
    cell, stop = [*keys, topic, "time_bin"], sorted(set(stopwords))
    plain = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    salts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32)  # a large bin is many tasks' work
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c.name}`") for c in df.schema if isinstance(c.dataType, plain)]), F.lit(salts))
    kept = F.filter(tokens(F.col(text)), lambda w: ~w.isin(stop)) if stop else tokens(F.col(text))
    texts = time_bins(df, keys, stamp, bins).select(*cell, F.array_join(kept, " ").alias("_words"), salt.alias("_salt"))
    texts = texts.repartition(*cell, "_salt").drop("_salt")  # a token holds no space
    columns = [*[texts.schema[c] for c in cell], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
    hashed = F.xxhash64(*keys)

    def cells(counts):  # a row per (topic, term) of counts per bin; at most ``bins`` cells
        terms = counts.groupBy(*keys, topic, "term").agg(
            F.map_from_entries(F.collect_list(F.struct("time_bin", "n"))).alias("_cells"), F.sum("n").alias("_n"))
        return terms.withColumn("_f", F.sum("_n").over(Window.partitionBy(*keys, "term")))  # one row per topic

    # both readings of the words see the same columns and filter, so they share one exchange
    parts = texts.mapInArrow(lambda batches: _bin_words(batches, cell, keys), T.StructType([*columns, T.StructField("_lost", T.LongType())]))
    parts = parts.where(" and ".join(f"`{c}` is not null" for c in keys) or "true").repartition(*keys, "term")
    sizes = parts.groupBy(*cell).agg(F.sum(F.when(F.col("term").isNull() & (F.col("_lost") >= 0), F.col("n"))).alias("z"), F.sum("_lost").alias("_lost"))
    sizes = sizes.groupBy(*keys, topic).agg(F.sort_array(F.collect_list(F.struct("time_bin", "z"))).alias("_bins"),
                                            F.sum("z").alias("_z"), F.sum("_lost").alias("_lost"))
    group = Window.partitionBy(*keys)
    sizes = sizes.withColumns({"_sizes": F.map_from_entries("_bins"), "_a": F.avg("_z").over(group), "_lost": F.sum("_lost").over(group)})
    empty = F.struct(F.lit(None).cast("long").alias("bin"), F.lit(0.0).alias("s"),
                     F.array().cast("array<struct<time_bin:bigint,s:double>>").alias("done"))

    def step(acc, b):
        own = F.coalesce(F.try_element_at(F.col("_cells"), b["time_bin"]), F.lit(0)) / b["z"]
        s = F.when(acc["bin"] == b["time_bin"] - 1, (own + acc["s"]) / 2).otherwise(own)
        return F.struct(b["time_bin"].alias("bin"), s.alias("s"),
                        F.concat(acc["done"], F.array(F.struct(b["time_bin"].alias("time_bin"), s.alias("s")))).alias("done"))
    walked = F.filter(F.aggregate("_bins", empty, step)["done"], lambda c: c["s"] > 0)
    score = F.round((F.col("_c.s") + F.col("_all")) / 2 * F.col("_idf") * F.lit(1e6)) / F.lit(1e6)

    def weighed(terms, sizes, f):
        return terms.join(F.broadcast(sizes), [*keys, topic]).withColumns(  # a row per topic
            {"_idf": F.log(1 + F.col("_a") / f), "_all": F.col("_n") / F.col("_z")})

    # what the best words of the whole topic reach in a bin, the k-th best word there reaches at least; a count too low only lowers it
    told = parts.groupBy(*keys, topic, "term", "time_bin").agg(F.sum(F.when(F.col("_lost") >= 0, F.col("n"))).alias("n"), F.count("term").alias("_told"))
    seeds = top_k(weighed(cells(told.where("_told > 0")), sizes, F.col("_f") + F.col("_lost")), [*keys, topic], 4 * k,
                  [(F.col("_all") * F.col("_idf")).desc(), F.col("term")])
    floors = explode_list(seeds, walked, [*keys, topic, "term", "_idf", "_all"], "_c")
    floors = floors.select(*keys, topic, F.col("_c.time_bin").alias("time_bin"), score.alias("score"))
    floors = floors.groupBy(*cell).agg(F.sort_array(F.collect_list("score"), False).alias("_best"))  # 4 k
    lowest = F.greatest(F.coalesce(F.get("_best", F.lit(k - 1)), F.lit(0.0)) - F.lit(2e-6), F.lit(0.0))  # covers the rounding
    floors = floors.groupBy(*keys, topic).agg(F.map_from_entries(F.collect_list(F.struct("time_bin", lowest))).alias("_floors"))
    sizes = sizes.join(floors, [*keys, topic], "left")
    floor = lambda b: F.coalesce(F.try_element_at("_floors", b), F.lit(0.0))

    # a term above the floor of a bin has such a weight in that bin, in one of its run before, or (by the whole topic) in any
    reach = explode_list(sizes, F.col("_bins"), [*keys, topic, "_a", "_floors"], "_b").select(
        *keys, topic, F.col("_b.time_bin").alias("time_bin"), F.col("_b.z").cast("double").alias("_z"), "_a", floor(F.col("_b.time_bin")).alias("_floor"))
    whole = Window.partitionBy(*keys, topic)
    reach = reach.withColumn("_run", F.col("time_bin") - F.row_number().over(whole.orderBy("time_bin")))
    later = Window.partitionBy(*keys, topic, "_run").orderBy(F.col("time_bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reach = reach.withColumn("_reach", F.least(F.min("_floor").over(later), F.min(F.when(F.col("_floor") > 0, F.col("_floor"))).over(whole)))
    marks = texts.join(F.broadcast(reach.drop("_run", "_floor")), cell, "left").withColumn("_group", hashed)  # a row per bin of a topic
    marks = marks.mapInArrow(lambda batches: _bin_marks(batches, cell), "_at long").distinct().withColumn("_at", F.col("_at") + 1)
    marks = marks.groupBy(F.bitmap_bucket_number("_at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bits"))
    marks = marks.agg(F.collect_list(F.struct("bucket", "bits")).alias("_marks"), F.least(F.count("bucket"), F.lit(0)).alias("_row"))  # one row

    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within its task, so its first row is 0
    marked = texts.withColumns({"_group": hashed, "_row": row}).join(F.broadcast(marks), "_row", "left").drop("_row")
    marked = marked.mapInArrow(lambda batches: _bin_terms(batches, cell), T.StructType(columns)).repartition(*keys, "term")
    terms = weighed(cells(marked.groupBy(*keys, topic, "term", "time_bin").agg(F.sum("n").alias("n"))), sizes, F.col("_f"))
    # ``s`` is at most the largest weight of the term in a bin; a millionth covers the rounding
    most = F.array_max(F.transform(F.map_entries("_cells"), lambda c: c["value"] / F.try_element_at(F.col("_sizes"), c["key"])))
    lowest = F.array_min(F.transform("_bins", lambda b: floor(b["time_bin"])))
    terms = terms.filter((most + F.col("_all")) / 2 * F.col("_idf") + F.lit(1e-6) >= lowest)
    rows = explode_list(terms, walked, [*keys, topic, "term", "_idf", "_all", "_floors"], "_c")
    rows = rows.filter(score >= floor(F.col("_c.time_bin")))
    rows = rows.select(*keys, topic, F.col("_c.time_bin").alias("time_bin"), "term", score.alias("score"))
    return top_k(rows, [*keys, topic, "time_bin"], k, [F.col("score").desc(), F.col("term")], "rank")


# ------------------------------------------------------------------ A28-A32: topics x sentiment

SENTIMENTS = ("positive", "negative", "neutral")


def topic_levels(votes: DataFrame, keys: Sequence[str], topic: str = "topic", label: str = "sentiment_label",
                 score: str = "sentiment_score", distribution: str = "sentiment_distribution") -> DataFrame:
    """One row per (group, topic), -1 included: its reviews and sentences, both per label, and its mean score.

    A28-A32 are made of these few rows only, so the sentences behind ``votes`` (A2: one row per review with its topic)
    are split, scored and counted once."""
    sents = lambda lab: F.coalesce(F.try_element_at(F.col(distribution), F.lit(lab)), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("topic_size"), F.avg(score).alias("_mean"), F.sum("sentence_count").alias("sentences")]
    for lab in SENTIMENTS:
        aggs += [F.count_if(F.col(label) == lab).alias(f"{lab}_count"), F.sum(sents(lab)).alias(f"{lab}_sentences")]
    return votes.groupBy(*keys, topic).agg(*aggs)


def topic_sentiment(levels: DataFrame, keys: Sequence[str], keyword_table: DataFrame | None = None,
                    topic: str = "topic") -> DataFrame:
    """A28 (+ N18, N16): per topic of ``topic_levels`` (no -1, at least 2 members) its size, count and % per
    label, dominant class, mean score (3 digits) and top keywords."""
    keys = list(keys)
    n = F.col("topic_size")
    cols = [x for lab in SENTIMENTS
            for x in (F.col(f"{lab}_count"), pct(f"{lab}_count", n, 2).alias(f"{lab}_percentage"))]
    g = levels.filter((F.col(topic) != OUTLIER) & (n >= 2)).select(
        *keys, topic, n, *cols, round_half_even(F.col("_mean"), 3).alias("avg_sentiment_score"))
    g = g.withColumn("dominant_sentiment",
                     dominant_sentiment("positive_percentage", "negative_percentage", "neutral_percentage"))
    if keyword_table is not None:
        g = g.join(keyword_lists(keyword_table, keys, topic), [*keys, topic], "left")
    return g


def _classes(topic: str) -> list[Column]:
    """Aggregates over ``topic_levels``: topics found (size 1 included) and topics of 2 or more per dominant class."""
    kind = dominant_sentiment(*[pct(f"{lab}_count", "topic_size", 2) for lab in SENTIMENTS])
    real = F.col(topic) != OUTLIER
    return [F.count_if(real).alias("total_topics"),
            *[F.count_if(real & (F.col("topic_size") >= 2) & (kind == c)).alias(c) for c in DOMINANT_CLASSES]]


def topic_sentiment_distribution(levels: DataFrame, keys: Sequence[str], topic: str = "topic") -> DataFrame:
    """Topics per dominant class (all six listed) and the number of topics found
    (every topic id except -1, size-1 topics included); groups of outliers only have no row."""
    return levels.groupBy(*keys).agg(*_classes(topic)).filter(F.col("total_topics") > 0)


def movie_topic_stats(levels: DataFrame, keys: Sequence[str], analysis_date: str, topic: str = "topic") -> DataFrame:
    """Per group a nested record: review-level and sentence-level label counts and %
    (a group without sentences gives 0 %, not a division error), total topics and the
    topic class distribution. One aggregate over the rows of ``topic_levels``."""
    per = levels.groupBy(*keys).agg(
        F.sum("topic_size").alias("total_reviews"), F.sum("sentences").alias("total_sentences"),
        *[F.sum(f"{lab}_{c}").alias(f"{lab}_{c}") for lab in SENTIMENTS for c in ("count", "sentences")], *_classes(topic))

    def level(counted, total):
        return F.struct(*[x for lab in SENTIMENTS
                          for x in (F.col(f"{lab}_{counted}").alias(lab),
                                    pct(f"{lab}_{counted}", total, 2).alias(f"{lab}_percentage"))])
    return per.select(*keys, "total_reviews", "total_sentences", F.lit(analysis_date).alias("analysis_date"),
                      level("count", "total_reviews").alias("review_level_sentiment"),
                      level("sentences", "total_sentences").alias("sentence_level_sentiment"), "total_topics",
                      F.struct(*DOMINANT_CLASSES).alias("topic_sentiment_distribution"))


def movie_overview(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The flat overview row of A30."""
    return stats.select(*keys, "total_reviews", "total_sentences",
                        F.col("review_level_sentiment.positive_percentage").alias("review_positive_pct"),
                        F.col("review_level_sentiment.negative_percentage").alias("review_negative_pct"),
                        F.col("sentence_level_sentiment.positive_percentage").alias("sentence_positive_pct"),
                        F.col("sentence_level_sentiment.negative_percentage").alias("sentence_negative_pct"),
                        F.col("total_topics").alias("topics_found"))


def movies_topic_overview(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group reviews, review-level %, topics found, and positive / negative
    topics (POSITIVE + MOSTLY_POSITIVE, NEGATIVE + MOSTLY_NEGATIVE)."""
    d = "topic_sentiment_distribution"
    return stats.select(*keys, "total_reviews",
                        F.col("review_level_sentiment.positive_percentage").alias("positive_pct"),
                        F.col("review_level_sentiment.negative_percentage").alias("negative_pct"),
                        F.col("review_level_sentiment.neutral_percentage").alias("neutral_pct"),
                        F.col("total_topics").alias("topics_found"),
                        (F.col(f"{d}.POSITIVE") + F.col(f"{d}.MOSTLY_POSITIVE")).alias("positive_topics"),
                        (F.col(f"{d}.NEGATIVE") + F.col(f"{d}.MOSTLY_NEGATIVE")).alias("negative_topics"))


def topic_analysis(levels: DataFrame, keys: Sequence[str], keyword_table: DataFrame, min_reviews: int = 10,
                   topic: str = "topic") -> DataFrame:
    """Per group of at least ``min_reviews`` reviews (P9) its overview (A31) and, in a row each, its topics with their
    summary and keywords (A28); a group without a topic of two or more members has one row with nulls there. Overview and
    topics come from one reading of ``topic_levels``; the windows hold one row per topic."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    total = lambda c: F.sum(c).over(w)
    shown = (F.col(topic) != OUTLIER) & (F.col("topic_size") >= 2)
    rows = levels.withColumns({
        "total_reviews": total("topic_size"), "total_sentences": total("sentences"),
        **{f"_{lab}_{c}": total(f"{lab}_{c}") for lab in ("positive", "negative") for c in ("count", "sentences")},
        "topics_found": F.count_if(F.col(topic) != OUTLIER).over(w), "_shown": F.count_if(shown).over(w),
        "_place": F.row_number().over(w.orderBy(topic))})
    rows = rows.filter((F.col("total_reviews") >= min_reviews) & (shown | ((F.col("_shown") == 0) & (F.col("_place") == 1))))
    share = {lab: pct(f"{lab}_count", "topic_size", 2) for lab in SENTIMENTS}
    cols = {topic: F.col(topic), "topic_size": F.col("topic_size")}
    for lab in SENTIMENTS:
        cols |= {f"{lab}_count": F.col(f"{lab}_count"), f"{lab}_percentage": share[lab]}
    cols |= {"avg_sentiment_score": round_half_even(F.col("_mean"), 3),
             "dominant_sentiment": dominant_sentiment(*[share[lab] for lab in SENTIMENTS])}
    out = rows.select(
        *keys, "total_reviews", "total_sentences",
        *[pct(f"_{lab}_{c}", f"total_{p}s", 2).alias(f"{p}_{lab}_pct") for p, c in (("review", "count"), ("sentence", "sentences"))
          for lab in ("positive", "negative")], "topics_found",
        *[F.when(F.col("_shown") > 0, c).alias(name) for name, c in cols.items()])
    return out.join(keyword_lists(keyword_table, keys, topic), [*keys, topic], "left")


def sort_topics(summary: DataFrame, keys: Sequence[str], topic: str = "topic", rank: str | None = None) -> DataFrame:
    """O3: topic summary ordered by group and topic id; ``rank`` names a column for the place."""
    if rank:  # the numbering names its rows several times
        summary = with_rank(cut_lineage(summary), [F.col(c) for c in (*keys, topic)], rank)
    return summary.orderBy(*keys, topic)


def topic_table(summary: DataFrame, keys: Sequence[str], topic: str = "topic") -> DataFrame:
    """The display table: sorted, percentages as ``12.3%`` text, keywords cut to 60."""
    return sort_topics(summary, keys, topic).select(
        *keys, topic, "topic_size", "dominant_sentiment",
        *[format_pct(round_half_even(F.col(f"{lab}_percentage"), 1)).alias(f"{lab}_pct")
          for lab in ("positive", "negative", "neutral")],
        F.substring(F.coalesce(F.col("keyword_string"), F.lit("")), 1, 60).alias("keywords"))


def top_k(df: DataFrame, by: Sequence[str], k: int, order: Sequence, rank: str | None = None) -> DataFrame:
    """Best ``k`` rows per group (``row_number() <= k``); ``rank`` keeps the place as a column."""
    w = Window.partitionBy(*by).orderBy(*order)
    top = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    return top.withColumnRenamed("_rk", rank) if rank else top.drop("_rk")


def topic_assignments(reviews: DataFrame, votes: DataFrame, topics: DataFrame, key: str) -> DataFrame:
    """M9: review rows with their vote (label, score) and topic, joined on the review id
    (the reference relies on list positions)."""
    return (reviews.join(votes.select(key, "sentiment_label", "sentiment_score"), key, "left")
                   .join(topics.select(key, "topic"), key, "left"))
