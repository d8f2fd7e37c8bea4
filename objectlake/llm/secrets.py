r"""Secrets in texts, with columns only: base patterns, and linking of multipart credentials.

Base spans are matches of fixed patterns.  Further, weaker parts (account
names, endpoints, bare 40-character tokens, short values of keywords) are
reported only where parts that complete them, strong or weak, lie near and
apart from them: an interval join of weak parts with the ends of parts before
them and the starts of parts after them, by document and by stretches as long
as the scope, so that each weak part meets the parts of two stretches on either
side.

Null text counts as empty; offsets are code points, ends exclusive; texts of
any length are searched whole; spans that start together are listed by kind;
repeated rows each get the same spans; an empty table gives an empty result.
Carried columns that have the name of a result are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import refuse, written

#: (kind, pattern, group that is measured, characters it has at least): base spans, in the order in which ties are listed.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: (kind, pattern, group that is measured, characters it has at most): weak parts, listed after the base kinds.
WEAK = (
    ("client", r"""(?i:client_?id|account_?id|access_?key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", 0, None),
    ("endpoint", r"""(?<![A-Za-z0-9_])[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+""", 0, None),
    ("opaque", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, None),
    ("short", BASE[0][1], 2, BASE[0][3] - 1),
)

KINDS = tuple(k for k, *_ in BASE + WEAK)

#: Code points between a weak part and what completes it, at most.
SCOPE = 300

#: Texts are searched with columns; sums run over this many matches at a time.
RUN = 64

SPAN = "struct<start:long,rank:int,end:long>"


def _sums(lengths: Column) -> Column:
    """Running sums of an array; runs of matches are summed first, so the work is far from quadratic."""
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda x, y: x + y)

    def running(a: Column) -> Column:
        return F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i + 1)))

    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / RUN).cast("int") - 1, F.lit(0))), lambda i: F.slice(lengths, i * RUN + 1, F.lit(RUN)))
    before = running(F.transform(runs, total))
    return F.flatten(F.transform(F.arrays_zip(runs.alias("r"), before.alias("b")), lambda z: F.transform(running(z["r"]), lambda x: x + z["b"] - total(z["r"]))))


def matches(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0, most: int | None = None) -> Column:
    """An array of (start, rank, end) of the leftmost non-overlapping matches whose ``group`` has ``least`` characters, and no more than ``most``.

    The gaps between matches and the matches' lengths add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    lengths = F.transform(found, lambda x: F.length(x).cast("long"))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda g, n: g + n)
    spans = F.transform(F.arrays_zip(_sums(steps).alias("e"), lengths.alias("n"), sized.alias("g")), lambda z: F.struct((z["e"] - z["n"]).alias("start"), F.lit(rank).alias("rank"), z["e"].alias("end"), F.length(z["g"]).alias("size")))
    kept = F.transform(F.filter(spans, lambda s: s["size"].between(least, (1 << 31) - 1 if most is None else most)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.concat(*[matches(text, p, i, g, n) for i, (_, p, g, n) in enumerate(BASE)])


def weak_spans(text: Column) -> Column:
    return F.concat(*[matches(text, p, i + len(BASE), g, 0, n) for i, (_, p, g, n) in enumerate(WEAK)])


def label(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def may_link(text: Column, base: Column) -> Column:
    """Whether a text has an access id and a secret, strong or weak; without both, no weak part is completed."""

    def strong(*ranks: int) -> Column:
        return F.exists(base, lambda s: s["rank"].isin(*ranks))

    client, opaque = WEAK[0][1], WEAK[2][1]
    return (strong(1) | text.rlike(client)) & (strong(0, 2) | text.rlike(BASE[0][1]) | text.rlike(opaque))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that are completed: rows (row, start, rank, end).

    ``parts`` has all parts of documents, told apart by ``row``.  A client id
    needs a secret near it, a bare token or a short value an access id, an
    endpoint both.  A part is near if it ends before the other starts, or starts
    after it ends, and the gap is at most ``scope``: no part completes itself or
    what it overlaps.  Weak parts within a strong one are reported with it already.
    """
    rank, start, end = F.col("rank"), F.col("start"), F.col("end")
    weak, endpoint = rank >= len(BASE), rank == 4
    access, secret = rank.isin(1, 3), rank.isin(0, 2, 5, 6)

    def stretch(at: Column) -> Column:
        return F.floor(at / scope).cast("long")

    # side 0: parts before a weak one, by their end; side 1: parts after it, by their start
    ends = [F.struct(F.lit(side).alias("side"), at.alias("at"), stretch(at).alias("stretch")) for side, at in enumerate((end, start))]
    gives = parts.where(~endpoint).select("row", access.alias("access"), secret.alias("secret"), F.inline(F.array(*ends)))
    gives = gives.groupBy("row", "side", "stretch", "at").agg(F.max("access").alias("access"), F.max("secret").alias("secret"))
    reach = [F.struct(F.lit(side).alias("side"), low.alias("low"), high.alias("high"), stretch(low if late == 0 else high).alias("stretch")) for side, low, high in ((0, start - scope, start), (1, end, end + scope)) for late in (0, 1)]
    asks = parts.where(weak).select("row", "start", "rank", "end", F.inline(F.array_distinct(F.array(*reach))))
    met = asks.join(gives, ["row", "side", "stretch"]).where(F.col("at").between(F.col("low"), F.col("high")))
    near = met.groupBy("row", "start", "rank", "end").agg(F.max("access").alias("_access"), F.max("secret").alias("_secret"))
    need = F.when(rank == 3, F.col("_secret")).when(endpoint, F.col("_access") & F.col("_secret")).otherwise(F.col("_access"))
    return near.where(need).select("row", "start", "rank", "end")


def apart(weak: Column, base: Column) -> Column:
    """Weak parts that no strong one holds."""
    return F.filter(weak, lambda w: ~F.exists(base, lambda b: (b["start"] <= w["start"]) & (w["end"] <= b["end"])))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", scope: int = SCOPE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Returns the key, ``base`` and ``spans``: sorted arrays of (start, rank, end); ``rank`` counts in ``KINDS``.

    Documents are searched once; what is found, mostly nothing, is written out.
    Weak parts are sought only where some could complete each other.  ``carry`` names
    columns that go along with their row.
    """
    refuse([key, *carry], ("base", "spans", "weak", "row", "_text"))
    whole = F.coalesce(F.col(text), F.lit(""))
    found = df.select(F.col(key), whole.alias("_text"), *carry).withColumn("base", F.array_sort(base_spans(F.col("_text"))))
    weak = F.when(may_link(F.col("_text"), F.col("base")), apart(weak_spans(F.col("_text")), F.col("base"))).otherwise(F.array().cast(f"array<{SPAN}>"))
    row = F.when(F.size("weak") > 0, F.xxhash64(F.col(key), F.col("_text")))
    found = written(found.withColumn("weak", weak).select(F.col(key), "base", "weak", row.alias("row"), *carry))
    none = F.col("row").isNull()
    plain = found.where(none).select(key, "base", F.col("base").alias("spans"), *carry)
    some = found.where(~none)
    once = some.select("row", "base", "weak").dropDuplicates(["row"])
    parts = once.select("row", F.inline(F.concat("base", "weak")))
    added = linked(parts, scope).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("_added"))
    joined = some.join(added, "row", "left")
    more = joined.select(key, "base", F.array_sort(F.concat("base", F.coalesce("_added", F.array().cast(f"array<{SPAN}>")))).alias("spans"), *carry)
    return plain.unionByName(more)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping or touching spans replaced by ``mark``."""
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def grow(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        wider = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, wider).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = F.aggregate(spans, empty, grow)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"]))
    ends = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: text.substr((a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(kept, mark)).otherwise(text)
