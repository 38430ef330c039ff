"""DuckDB SQL fragments for the oracles: the same rules as the Spark column functions,
written independently in SQL (RE2 regexes, DuckDB list functions)."""

from __future__ import annotations

from reelscope.functions.dates import DATE_FORMATS, MISSING_TOKENS, YEARLESS_FORMATS

WS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"
EMOJI = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
         r"\x{2500}-\x{2BEF}\x{2702}-\x{27B0}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
         r"\x{1F926}-\x{1F937}\x{10000}-\x{10FFFF}\x{2640}-\x{2642}\x{2600}-\x{2B55}"
         r"\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+")
TOKEN = r"[\p{L}\p{N}_]{2,}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def missing(e: str) -> str:
    toks = ", ".join(lit(t) for t in MISSING_TOKENS)
    return f"({strip(e)} IS NULL OR {strip(e)} IN ({toks}))"


def parse_review_date(e: str, year: int) -> str:
    s0 = f"(CASE WHEN {missing(e)} THEN NULL ELSE {strip(e)} END)"
    s1 = f"(CASE WHEN {s0} LIKE '%T%' AND {s0} LIKE '%Z%' THEN replace({s0}, 'Z', '') ELSE {s0} END)"
    arms = [f"try_strptime({s1}, {lit(f)})" for f, _ in DATE_FORMATS]
    return f"coalesce({', '.join(arms)}, {fill_year(s1, year)})"


def fill_year(e: str, year: int) -> str:
    arms = [f"try_strptime({e} || ' {year}', {lit(f + ' %Y')})" for f, _ in YEARLESS_FORMATS]
    return f"coalesce({', '.join(arms)})"


def to_double(e: str) -> str:
    x = f"TRY_CAST({strip(f'CAST({e} AS VARCHAR)')} AS DOUBLE)"
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def words(e: str) -> str:
    """Number of whitespace-separated words."""
    s = strip(e)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '{WS}+')) END)"


def split_punct(e: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({e}, '[.!?]+'), lambda p: {strip('p')}), "
            f"lambda p: p <> '')")


def split_boundary(e: str, min_len: int = 10) -> str:
    t = strip(e)
    marked = f"regexp_split_to_array(regexp_replace({t}, '([.!?]){WS}+([A-Z])', '\\1\x1e\\2', 'g'), '\x1e')"
    pieces = f"(CASE WHEN len({marked}) <= 1 THEN regexp_split_to_array({t}, '[.!?]+') ELSE {marked} END)"
    kept = f"list_filter(list_transform({pieces}, lambda p: {strip('p')}), lambda p: length(p) >= {min_len})"
    done = f"list_transform({kept}, lambda p: CASE WHEN regexp_matches(p, '[.!?]$') THEN p ELSE p || '.' END)"
    return f"(CASE WHEN {t} IS NULL OR {t} = '' THEN []::VARCHAR[] ELSE {done} END)"


def tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '{TOKEN}')"


def kept_tokens(e: str, stopwords: list[str]) -> str:
    """Tokens of ``e`` without the stop words."""
    stop = "[" + ", ".join(lit(w) for w in sorted(set(stopwords))) + "]::VARCHAR[]"
    return f"list_filter({tokens(e)}, lambda t: NOT list_contains({stop}, t))"


def ngrams_of(toks: str) -> str:
    """Unigrams then bigrams of a token-list column (give a column, not an expression:
    the list is indexed once per bigram)."""
    return (f"(list_concat({toks}, list_transform(range(1, len({toks})), "
            f"lambda i: {toks}[i] || ' ' || {toks}[i + 1])))")


def half_even(e: str, digits: int) -> str:
    scale = f"{10 ** digits}.0"
    return f"(round_even(({e}) * {scale}, 0) / {scale})"


def signed(label: str = "sentiment_label", score: str = "sentiment_score") -> str:
    return f"(CASE {label} WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -2.0 ELSE 0.0 END * {score})"
