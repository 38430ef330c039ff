"""Text column functions (T1-T3, T7-T10 of the survey) and shared text helpers.

The sentence splitters (T4, T5) and the n-gram tokenizer (T9) are also column
expressions here; the operators that explode them into rows live in
``reelscope.operators.sentences``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code-point ranges deleted by the emoji stripper, in the reference's order.
# U+24C2..U+1F251 also covers CJK, kana and Hangul, and U+10000..U+10FFFF every astral
# character; that is the reference's behaviour and is kept.
EMOJI_CLASS = (
    "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}"
    "\\x{2500}-\\x{2BEF}\\x{2702}-\\x{27B0}\\x{2702}-\\x{27B0}\\x{24C2}-\\x{1F251}"
    "\\x{1F926}-\\x{1F937}\\x{10000}-\\x{10FFFF}\\x{2640}-\\x{2642}\\x{2600}-\\x{2B55}"
    "\\x{200D}\\x{23CF}\\x{23E9}\\x{231A}\\x{FE0F}\\x{3030}]+"
)

# Whitespace as Python's str.strip() sees it for the texts we meet (ASCII controls,
# the Unicode separators, NEL and NBSP).
_WS = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters of ``_WS``, for ``btrim``.
_WS_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
             + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Trim all leading and trailing whitespace (Spark ``trim`` only strips spaces); only the ends of the text are read."""
    return F.btrim(_col(c), F.lit(_WS_CHARS))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip_emojis(c) -> Column:
    """Delete runs of emoji / pictograph code points; null passes through."""
    return F.regexp_replace(_col(c), EMOJI_CLASS, "")


def title_plus_text(title, text) -> Column:
    """``title: text`` when both are present, the text alone when there is no title,
    else ''. (The reference writes ``title: nan`` for a title without text; here that
    row becomes '' and is dropped with the other empty texts.)"""
    t, x = _col(title), _col(text)
    has_t = t.isNotNull() & (t != "")
    has_x = x.isNotNull() & (x != "")
    return (F.when(has_t & has_x, F.concat(t, F.lit(": "), x))
             .when(has_x, x)
             .otherwise(F.lit("")))


def slug(c, drop_dots: bool = False) -> Column:
    """Lower case, space -> ``_``, ``ñ`` -> ``n``, ``!`` removed (and ``.`` if asked)."""
    s = F.translate(F.lower(_col(c)), " ñ", "_n")
    return F.regexp_replace(s, "[!.]" if drop_dots else "!", "")


def preview(c, n: int = 30) -> Column:
    """Text cut to ``n - 3`` characters plus ``...`` when longer than ``n``."""
    s = _col(c).cast("string")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def keyword_string(arr, width: int | None = None) -> Column:
    """Keywords joined by ``, `` (optionally the first ``width`` characters)."""
    s = F.array_join(_col(arr), ", ")
    return F.substring(s, 1, width) if width else s


def format_pct(c, digits: int = 1) -> Column:
    """A percentage as text, ``12.3%``."""
    return F.format_string(f"%.{digits}f%%", _col(c).cast("double"))


# ---------------------------------------------------------------- sentence splitting

def split_punct(c) -> Column:
    """T4 pieces: split on runs of ``.!?``, trimmed, empty pieces removed (array<string>)."""
    pieces = F.split(_col(c), "[.!?]+")
    return F.filter(F.transform(pieces, lambda p: strip_ws(p)), lambda p: p != "")


def split_boundary(c, min_len: int = 10) -> Column:
    """T5 pieces: split at whitespace between an end mark and an ASCII capital; when that
    gives one piece, split on runs of ``.!?``; trim; keep pieces of ``min_len`` or more
    characters; add ``.`` when a piece has no end mark."""
    def pieces(text):
        first = F.split(text, f"(?<=[.!?]){_WS}+(?=[A-Z])")
        return _once(first, lambda f: F.when(F.size(f) <= 1, F.split(text, "[.!?]+")).otherwise(f))

    def kept(text):
        return F.filter(F.transform(pieces(text), lambda p: strip_ws(p)), lambda p: F.length(p) >= min_len)

    def sentences(text):
        return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
            F.transform(kept(text), lambda p: F.when(F.substring(p, -1, 1).isin(".", "!", "?"), p).otherwise(F.concat(p, F.lit(".")))))
    return _once(strip_ws(_col(c)), sentences)


def word_count(c) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    s = strip_ws(_col(c))
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, f"{_WS}+")))


# ---------------------------------------------------------------- tokens and n-grams

TOKEN_PATTERN = "(?U)\\b\\w\\w+\\b"


def tokens(c) -> Column:
    """Lower-cased word tokens of two or more word characters (``\\w\\w+``)."""
    # a run of word characters, taken greedily, ends and begins at word boundaries
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN.replace("\\b", "")), 0)


def bigrams_of(toks) -> Column:
    """Adjacent pairs of a token array, joined by a space."""
    toks = _col(toks)
    n = F.size(toks)
    return F.zip_with(F.slice(toks, 1, F.greatest(n - 1, F.lit(0))),
                      F.slice(toks, 2, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def tokenize_ngrams(c, stopwords: list[str], n_max: int = 2) -> Column:
    """T9 as one column expression (for short stop lists): tokens, stop words removed,
    *then* 1- and 2-grams, so bigrams bridge removed words. Multi-word stop-word entries
    never match a single token, as in the reference."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))]) if stopwords else F.array().cast("array<string>")
    toks = F.filter(tokens(c), lambda t: ~F.array_contains(stop, t))
    return F.concat(toks, bigrams_of(toks)) if n_max >= 2 else toks


def with_ngrams(df: DataFrame, text: str, stopwords: list[str], out: str = "terms", n_max: int = 2,
                toks: str | None = None) -> DataFrame:
    """T9 for long stop lists: the stop-word test is Spark ML's ``StopWordsRemover``
    (a hash-set lookup in the JVM) instead of a linear scan per token. ``toks`` keeps all tokens under that name."""
    from pyspark.ml.feature import StopWordsRemover

    tmp = df.withColumn("_toks", tokens(F.col(text)))
    remover = StopWordsRemover(inputCol="_toks", outputCol="_kept", stopWords=sorted(set(stopwords)),
                               caseSensitive=True)
    kept = remover.transform(tmp)
    kept = kept.withColumnRenamed("_toks", toks) if toks else kept.drop("_toks")
    grams = F.concat(F.col("_kept"), bigrams_of("_kept")) if n_max >= 2 else F.col("_kept")
    return kept.withColumn(out, grams).drop("_kept")
