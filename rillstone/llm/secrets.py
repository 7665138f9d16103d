"""Secrets in texts: base patterns in place, and multipart credentials linked by an interval join.

Built of DataFrame expressions alone. Base spans need one pass over a text and no shuffle. Weak
candidates (a bare 40-character string, an endpoint) say little by themselves; they are sought only
in texts with an access identifier, and reported only if the parts of a credential meet in a scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stage

# The base patterns, in the order of their kinds. Runs of at least n characters of a
# class are the maximal runs that long, so {n,} finds what + and a length check would.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED = 6
#: Weak parts, and how far from an access identifier a scope reaches, in code points.
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])"
ENDPOINT = r"""(?i)\b(?:https?|s3)://[^\s"'<>]+|\b[a-z0-9][a-z0-9.-]*\.(?:amazonaws|cloudfront)\.(?:com|net)\b"""
SCOPE = 300
#: Matches whose lengths are summed up in one fold, and code points of a text that are rewritten in one.
CHUNK, WINDOW = 128, 4096
KINDS = ["assign", "access", "hex", "weak_secret", "endpoint"]
SPANS = "array<struct<start:int,kind:int,end:int,value:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Spans of all matches, leftmost and not overlapping, in code points; value is the length of a group.

    The text between matches and the matches themselves alternate, so running lengths give places.
    They are summed up in chunks of CHUNK matches, then over chunks, as a fold copies what it has gathered.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    gaps = F.split(text, pattern, -1)
    each = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(group, F.length).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["own"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["own"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], span.cast(SPANS))).alias("spans"))

    def chunks(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(every, i * CHUNK + 1, CHUNK), start, step))

    def placed(local: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(local, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        moved = lambda at: lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value"))
        both = F.arrays_zip(local.alias("chunk"), starts.alias("begin"))
        return F.flatten(F.transform(both, lambda c: F.transform(c["chunk"]["spans"], moved(c["begin"])))).cast(SPANS)

    return F.when(F.size(found) > 0, _bound(_bound(each, chunks), placed)).otherwise(F.array().cast(SPANS))


def _none() -> Column:
    return F.array().cast(SPANS)


def base_spans(text: Column) -> Column:
    """Sorted spans of the base kinds of a text that is not null."""
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda s: s["value"] >= ASSIGNED)
    access = F.when(text.contains("AKIA"), _matches(text, ACCESS, 1)).otherwise(_none())
    return F.array_sort(F.concat(assign, access, _matches(text, HEX, 2)))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _key(text: Column) -> Column:
    """What spans are a function of; only texts that can hold a multipart credential have one."""
    return F.when(text.contains("AKIA"), F.sha2(text, 256))


def linked_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(text_key, linked spans) of texts in which an access identifier meets weak parts.

    Interval join: scopes reach ``scope`` code points around each access identifier and are cut into
    bins of that width; candidates fall into the bin of their start and meet scopes of their text and
    bin, then exact bounds are compared. A weak secret is reported if a scope holds it; an endpoint
    if a scope holds it together with a secret, weak or assigned.
    """
    text = F.coalesce("text", F.lit(""))
    parts = docs.where(F.col("text").contains("AKIA")).select(_key(text).alias("text_key"), text.alias("text")).dropDuplicates(["text_key"])
    parts = parts.select("text_key", base_spans(F.col("text")).alias("base"), _matches(F.col("text"), WEAK_SECRET, 3).alias("weak"), _matches(F.col("text"), ENDPOINT, 4).alias("endpoint"))
    told = lambda w: F.exists("base", lambda b: (b["start"] <= w["start"]) & (b["end"] >= w["end"]))
    parts = parts.withColumn("weak", F.filter("weak", lambda w: ~told(w)))
    parts = stage(parts, "credential-parts")
    span = lambda c: (F.col(f"s.{c}").alias(c))
    access = parts.select("text_key", F.explode(F.filter("base", lambda s: s["kind"] == 1)).alias("s"))
    access = access.select("text_key", (span("start") - scope).alias("lo"), (span("end") + scope).alias("hi"))
    scopes = access.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / scope), F.floor(F.col("hi") / scope))))
    candidates = lambda c: parts.select("text_key", F.explode(c).alias("s")).select("text_key", span("start"), span("kind"), span("end")).withColumn("bin", F.floor(F.col("start") / scope))
    inside = (F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi"))
    weak = candidates("weak").join(scopes, ["text_key", "bin"]).where(inside)
    secrets = candidates(F.concat("weak", F.filter("base", lambda s: s["kind"] == 0)))
    complete = secrets.join(scopes, ["text_key", "bin"]).where(inside).select("text_key", "lo", "hi").distinct()
    complete = complete.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / scope), F.floor(F.col("hi") / scope))))
    ends = candidates("endpoint").join(complete, ["text_key", "bin"]).where(inside)
    both = weak.select("text_key", "start", "kind", "end").union(ends.select("text_key", "start", "kind", "end"))
    one = F.struct("start", "kind", "end", F.lit(None).cast("int").alias("value"))
    return stage(both.groupBy("text_key").agg(F.collect_set(one).cast(SPANS).alias("linked")), "linked")


def _scanned(docs: DataFrame, scope: int) -> DataFrame:
    """row (all columns of ``docs`` as one struct, so that no name of theirs can clash), base and spans."""
    links = linked_spans(docs.select("text"), scope)
    text = F.coalesce("text", F.lit(""))
    other = F.concat(F.lit("row "), F.xxhash64("doc_id", F.length(text)).cast("string"))  # as a null key would meet one task
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), base_spans(text).alias("base"), F.coalesce(_key(text), other).alias("text_key"))
    rows = rows.join(sized(links), "text_key", "left")
    return rows.select("row", "base", F.array_sort(F.concat("base", F.coalesce("linked", _none()))).alias("spans"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, any others) with its columns and base, spans (sorted arrays).

    Columns of ``docs`` of these two names give way to the results. A null text counts as empty. Rows
    that repeat get equal results. An empty table gives no rows.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("base", "spans")]
    return _scanned(docs, scope).select(*own, "base", "spans")


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all its columns, with each run of overlapping spans of its text replaced by ``mark``.

    Null texts stay null. Texts are rewritten in windows of WINDOW code points, each from the spans that
    reach into it; a run is marked where it begins.
    """
    text = F.col("row")["text"]

    def window(part: Column, i: Column) -> Column:
        base = i * WINDOW
        own = F.filter("spans", lambda s: (s["end"] > base) & (s["start"] < base + WINDOW))
        start = F.struct(base.alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            new = (s["start"] >= acc["at"]) & (s["start"] >= base)
            kept = F.substring(part, acc["at"] - base + 1, s["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], F.substring(part, F.least(acc["at"] - base, F.lit(WINDOW)) + 1, F.lit(WINDOW))))

    windows = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))
    hidden = F.when(F.size("spans") > 0, F.array_join(F.transform(windows, window), "")).otherwise(text)
    return _scanned(docs, scope).select(*(hidden.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of ``docs``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs.select("doc_id", "text"), scope).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
