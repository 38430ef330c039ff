r"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans (always reported), leftmost and non-overlapping per kind, as code points with exclusive end:

* ``assign``: ``(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)``,
  keyword letters in either case, value of 6 or more characters;
* ``access``: ``AKIA[A-Z0-9]+`` of 20 or more; ``hex``: ``[0-9a-f]+`` of 24 or more.

Weak candidates are reported only when complementary parts co-occur: ``key_id`` (an account or key
identifier assignment), ``secret`` (a long mixed token) and ``endpoint`` (a URL). Identifiers (weak ones
and ``access``) and secrets (weak ones, ``assign`` and ``hex``) are interval-joined within a scope of
``scope`` characters of one text; weak parts of a linked pair are reported, and endpoints within the
scope of a linked part. The join runs on (text, scope cell) with a part in every cell it covers, so work per cell
is bounded by what fits into three cells; a text full of credentials makes many cells, not one large group.

Null text is empty. Equal rows (id and text) are linked once and get the same spans. Null ids are
matched null-safely. Empty tables give empty results; all columns of ``docs`` are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import stored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY_ID = r"""(?i)\b(?:access_?key(?:_?id)?|client_?id|account_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Z+/_-]*[0-9a-z])(?=[^0-9\s]*[0-9])(?=[^a-z\s]*[a-z])(?=[^A-Z\s]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]{3,}"""
KINDS = ["assign", "access", "hex", "key_id", "secret", "endpoint"]
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def find_spans(text: Column, kind: str, pattern: str, gate: Column, least: int = 0) -> Column:
    """Array of (start, kind_no, end, kind); ``least`` is the shortest second group that counts. The
    pattern runs only where ``gate`` holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["own"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    spans = F.aggregate(sizes, zero, step, lambda acc: acc["spans"])
    if least:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        spans = F.filter(F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= least, s)), lambda s: s.isNotNull())
    number = F.lit(KINDS.index(kind))
    full = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), number.alias("kind_no"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind")))
    return F.when(gate, full.cast(SPANS)).otherwise(_none())


def strong_spans(text: Column) -> dict[str, Column]:
    return {"assign": find_spans(text, "assign", ASSIGN, F.rlike(text, F.lit(ASSIGN)), 6),
            "access": find_spans(text, "access", ACCESS, F.contains(text, F.lit("AKIA"))),
            "hex": find_spans(text, "hex", HEX, F.rlike(text, F.lit(HEX)))}


def _key(docs: DataFrame) -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__hash"), F.length(text).alias("__len")]


def linked_weak_spans(docs: DataFrame, scope: int = 300) -> DataFrame:
    """``__id, __hash, __len, weak``: the reported weak spans of the texts that have any."""
    text = F.coalesce("text", F.lit(""))
    some = docs.select(*_key(docs), text.alias("text")).where(
        F.contains(F.col("text"), F.lit("AKIA")) | F.rlike(F.col("text"), F.lit(KEY_ID)))
    some = some.dropDuplicates(["__id", "__hash", "__len"])
    t, on = F.col("text"), F.lit(True)

    def part(kind: str, pattern: str, least: int, name: str, weak: bool) -> Column:
        return F.transform(find_spans(t, kind, pattern, on, least), lambda s: F.struct(
            F.lit(name).alias("part"), F.lit(weak).alias("weak"), s["start"].alias("start"),
            s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind")))

    parts = [part("access", ACCESS, 0, "id", False), part("key_id", KEY_ID, 0, "id", True),
             part("assign", ASSIGN, 6, "secret", False), part("hex", HEX, 0, "secret", False),
             part("secret", SECRET, 0, "secret", True), part("endpoint", ENDPOINT, 0, "end", True)]
    key = ["__id", "__hash", "__len"]
    rows = stored(some.select(*key, F.explode(F.concat(*parts)).alias("p")).select(*key, "p.*"))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of one text whose gap is at most ``scope``. Left parts are filed under the cells they cover, right
        parts under those they cover with the scope on both sides; a pair is kept in its first common cell."""
        def filed(rows: DataFrame, s: str, by: int) -> DataFrame:
            first, last = F.floor((F.col("start") - by) / scope), F.floor((F.col("end") + by) / scope)
            named = rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns], first.alias(f"{s}_first"), last.alias(f"{s}_last"))
            return named.withColumn("cell", F.explode(F.sequence(f"{s}_first", f"{s}_last")))

        a, b = filed(left, "a", 0), filed(right, "b", scope)
        same = reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in key])
        gap = F.greatest("a_start", "b_start") - F.least("a_end", "b_end")
        met = a.join(b, same & (a["cell"] == b["cell"]) & (a["cell"] == F.greatest("a_first", "b_first")))
        return met.where(gap <= scope)

    def side(pairs: DataFrame, s: str) -> DataFrame:
        return pairs.select(*[F.col(f"{s}_{c}").alias(c) for c in rows.columns])

    pairs = near(rows.where("part = 'id'"), rows.where("part = 'secret'"))
    linked = stored(side(pairs, "a").unionByName(side(pairs, "b")).distinct())
    ends = side(near(rows.where("part = 'end'"), linked), "a")
    weak = linked.where("weak").unionByName(ends).distinct()
    return weak.groupBy(*key).agg(F.collect_set(F.struct("start", "kind_no", "end", "kind")).alias("weak"))


def scan_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """``docs`` with ``secret_spans`` (replaced if there): all spans by start, then kind."""
    weak = stored(linked_weak_spans(docs, scope))
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop("secret_spans")
    strong = F.concat(*strong_spans(text).values())
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), *_key(docs), strong.alias("__strong"))
    weak = weak.toDF("w_id", "w_hash", "w_len", "w_spans")
    rows = rows.join(weak, rows["__id"].eqNullSafe(weak["w_id"]) & (rows["__hash"] == weak["w_hash"])
                     & (rows["__len"] == weak["w_len"]), "left")
    spans = F.array_sort(F.concat("__strong", F.coalesce(F.col("w_spans").cast(SPANS), _none())))
    return rows.select("__doc.*", spans.alias("secret_spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_spans(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``by``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] - acc["at"]
        fresh = (gap >= 0) & ((acc["at"] == 0) | (gap > 0))
        more = F.when(fresh, F.concat(F.substr(text, acc["at"] + 1, F.greatest(gap, F.lit(0))), F.lit(by))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], more).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, masked).otherwise(text)
