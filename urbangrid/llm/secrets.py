"""Secret scans in DataFrame functions only, with linking of multipart credentials.

Base kinds stand alone: `assign` (a named value), `access` (a key id), `hex` (a long run).  Weak kinds are common in clean text
and count only as parts of a credential: `ident` (a named user, login or client id), `opaque` (a mixed run with the look of a
generated secret, or a named value too short for `assign`) and `endpoint` (a service address).  Candidates of all kinds are
rows (text, role, start, end); an interval join inside the scope (one text, at most `reach` code points between two parts) keeps
a weak part only where a part of a complementary role lies near: identifier with secret, secret with identifier or endpoint,
endpoint with secret.  A weak part inside a base span is that span and not reported again.

Spans are code points, end exclusive.  They come from running sums of the lengths of what a pattern matches and of what lies
between, so no position function or UDF is needed.  Patterns run in time linear in the text whatever it holds: no group is
repeated (the engine would recurse once a round), a run is entered only where it begins or is given up after a few characters,
and what could be backed off through is possessive.  Plain substring tests and one pattern for long runs come first, so
texts without a candidate, most of a table, see one pattern only.

The interval join is an equi-join: a text is cut into buckets of `reach` code points.  The gap lies between an end of one part and the start of
the other, so a weak part is posted to the buckets of its start and end, the other side to those and to the one before its start and after its
end, whatever their lengths.  Few parts fit into a bucket, so a long text gives many small join groups and none grows with the text.  Equal
texts are linked once.

`redact` takes the spans that `scan` reports.  Texts are scanned once; those with few base spans and nothing to link are replaced in
place, the others in pieces of 4,096 code points, so the work stays in proportion to a text however many spans it has.

Defined results: a null or empty text has no span; repeated ids and rows keep a row each; an empty table gives an empty table;
other columns are not read by `scan`, and `redact` carries them whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

# Patterns of the kinds.  The assignment pattern's second group is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same matches as [A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# A run of OPAQUE with a digit, a small and a capital letter, asked once where a run begins.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20}"
# An address, or a whole run of host characters that ends in one of three suffixes (and perhaps a full stop).
ENDPOINT = r"(?<![a-z0-9.-])(?:(?:https?|ftp|ssh|jdbc:[a-z]++|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9.:@/_-]++|[a-z0-9.-]++(?<=[a-z0-9-]\.(?:amazonaws\.com|internal|cloud)\.?))"
RUN = r"[A-Za-z0-9+/_-]{20}"  # in every match of ACCESS, HEX and MIXED
NAMED = ("passw", "secret", "token", "apikey", "api_key")  # one of them, in small letters, is in every match of ASSIGN
IDENTS = ("username", "user_name", "userid", "user_id", "login", "clientid", "client_id", "accountid", "account_id", "accesskey", "access_key")
PLACES = ("://", ".amazonaws.com", ".internal", ".cloud")
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")  # also the order of equal starts
SPAN = "array<struct<start:long,rank:int,end:long>>"
REACH = 200
PIECE = 256  # elements of a list that are summed up at once
CHUNK, FEW = 4096, 64  # code points of a piece of text; base spans that are replaced in place


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column) -> Column:
    """Running sums of an array<long>, piece by piece, so that no list grows by copies of itself."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("sums"))

    def step(acc: Column, v: Column) -> Column:
        return F.struct((acc["at"] + v).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + v)).alias("sums"))

    def pieces(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / PIECE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(v, c * PIECE + 1, F.lit(PIECE)), zero, step))

    def joined(p: Column) -> Column:
        before = F.aggregate(p, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums")))["sums"]
        return F.flatten(F.zip_with(p, before, lambda x, b: F.transform(x["sums"], lambda s: s + b)))

    return _let(_let(values, pieces), joined)


def matches(text: Column, pattern: str, rank: int, group: int = 0, least: int = 1, most: int = 2**31 - 1, mixed: bool = False) -> Column:
    """Spans of the leftmost non-overlapping matches whose `group` has least..most characters (mixed: with digit, lower and upper case)."""

    def sizes(strings: Column) -> Column:
        return F.transform(strings, lambda s: F.length(s).cast("long"))

    def good(m: Column) -> Column:
        value = F.regexp_extract(m, pattern, group) if group else m
        ok = F.length(value).between(least, most)
        return ok & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") if mixed else ok

    def spans(found: Column) -> Column:
        ends = _running(F.zip_with(sizes(F.split(text, pattern, -1)), sizes(found), lambda gap, size: gap + F.coalesce(size, F.lit(0))))
        kept = F.filter(F.zip_with(ends, found, lambda e, m: F.struct(e.alias("end"), m.alias("m"))), lambda x: F.coalesce(good(x["m"]), F.lit(False)))
        return F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))).cast(SPAN)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def with_spans(rows: DataFrame) -> DataFrame:
    """Adds base spans by kind and `weak` spans of a column `text` without nulls; the columns __run, __named, __ident, __place are its own."""
    text, none = F.col("text"), F.array().cast(SPAN)
    small = rows.select("*", F.lower("text").alias("__small"))
    marked = small.select(
        *rows.columns, text.rlike(RUN).alias("__run"), _any(F.col("__small"), NAMED).alias("__named"), _any(F.col("__small"), IDENTS).alias("__ident"), _any(text, PLACES).alias("__place")
    )

    def found(guard: str, pattern: str, rank: int, *more, asked: str | None = None, **options) -> Column:
        return F.when(F.col(guard) & text.rlike(asked or pattern), matches(text, pattern, rank, *more, **options)).otherwise(none)

    return marked.select(
        *rows.columns,
        found("__named", ASSIGN, 0, 2, 6).alias("assign"),
        found("__run", ACCESS, 1).alias("access"),
        found("__run", HEX, 2).alias("hex"),
        F.concat(found("__ident", IDENT, 3), found("__run", OPAQUE, 4, mixed=True, asked=MIXED), found("__named", ASSIGN, 4, 2, 1, 5), found("__place", ENDPOINT, 5)).alias("weak"),
    )


def _base() -> Column:
    return F.concat(*KINDS[:3])


def _may_link() -> Column:
    """A weak part and another part: only then can there be a link."""
    return (F.size("weak") > 0) & (F.size("weak") + F.size(_base()) > 1)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text, without it: doc_id, text_key (its digest), base spans by kind, and weak spans."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_spans(kept).select("doc_id", F.sha2("text", 256).alias("text_key"), *KINDS[:3], "weak")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """text_key, start, rank, end: the weak spans that have a complementary part within reach (interval join in each text)."""
    texts = found.filter(_may_link()).select("text_key", F.concat(_base(), "weak").alias("parts")).dropDuplicates(["text_key"])  # equal texts link once
    part = texts.select("text_key", F.explode("parts").alias("s")).select("text_key", "s.*", (F.col("s.rank") < 3).alias("base"))
    # a weak part overlaps a base span if, of the base spans that start before it ends, the furthest end lies beyond its start
    order = W.partitionBy("text_key").orderBy(F.when(F.col("base"), F.col("start")).otherwise(F.col("end")), "base").rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(order) > F.col("start"), F.lit(False))
    # roles: identifier, secret, endpoint; a named or hexadecimal value is a secret, an access key id an identifier
    role = F.when(F.col("rank").isin(1, 3), 0).when(F.col("rank") == 5, 2).otherwise(1)
    part = part.withColumn("covered", covered).filter("base or not covered").select("text_key", "start", "rank", "end", role.alias("role"))
    # parts within reach have the nearer ends in the same or in neighbouring buckets; matches are made distinct below
    first, last = F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)
    left = part.filter(F.col("rank") >= 3).withColumn("bucket", F.explode(F.array_distinct(F.array(first, last))))
    spread = F.array_distinct(F.array(first - 1, first, last, last + 1))
    right = part.select("text_key", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("role").alias("role2"), F.explode(spread).alias("bucket"))
    near = F.greatest(F.col("start"), F.col("start2")) - F.least(F.col("end"), F.col("end2")) <= reach
    apart = (F.col("end") <= F.col("start2")) | (F.col("end2") <= F.col("start"))
    complementary = ((F.col("role") == 1) & (F.col("role2") != 1)) | ((F.col("role") != 1) & (F.col("role2") == 1))
    return left.join(right, ["text_key", "bucket"]).filter(near & apart & complementary).select("text_key", "start", "rank", "end").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans, n_linked, span_list, text_key for each row of docs."""
    found = written(candidates(docs, id_col, text_col), "secret-candidates")  # small rows without texts; read twice
    none = F.array().cast(SPAN)

    def named(rows: DataFrame) -> DataFrame:
        spans = F.concat(_base(), "linked")
        return rows.select(
            "doc_id",
            *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
            F.sha2(_written(_base()), 256).alias("base_sha256"),
            _written(spans).alias("spans"),
            F.size("linked").cast("long").alias("n_linked"),
            F.array_sort(spans).alias("span_list"),
            "text_key",
        )

    links = linked(found, reach).groupBy("text_key").agg(F.collect_list(F.struct("start", "rank", "end")).cast(SPAN).alias("linked"))
    # a text that cannot link (most of a table) is not shuffled
    rest = found.filter(_may_link()).join(links, "text_key", "left").withColumn("linked", F.coalesce("linked", none))
    return named(found.filter(~_may_link()).withColumn("linked", none)).unionByName(named(rest))


def _in_pieces(texts: DataFrame, spans: DataFrame, mark: str) -> DataFrame:
    """text_key, clean: texts (text_key, text) with their spans (text_key, start, rank, end) replaced, overlapping ones by one mark."""
    earlier = W.partitionBy("text_key").orderBy("start", "rank", "end").rowsBetween(W.unboundedPreceding, -1)
    cut = spans.withColumn("opens", F.col("start") >= F.coalesce(F.max("end").over(earlier), F.lit(0)))
    cut = cut.select("*", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))).alias("piece"))
    begin = F.col("piece") * CHUNK
    own = F.struct(
        F.greatest(F.col("start") - begin, F.lit(0)).cast("int").alias("lo"), (~(F.col("opens") & (F.col("start") >= begin))).alias("goes_on"), F.least(F.col("end") - begin, F.lit(CHUNK)).cast("int").alias("hi")
    )
    cuts = cut.groupBy("text_key", "piece").agg(F.sort_array(F.collect_list(own)).alias("cuts"))
    parts = texts.select("text_key", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))).alias("piece", "part")).withColumn("piece", F.col("piece").cast("long"))
    part = F.col("part")

    def step(acc: Column, c: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(part, acc["at"] + 1, c["lo"] - acc["at"]), F.when(c["goes_on"], "").otherwise(mark))
        return F.struct(F.greatest(acc["at"], c["hi"]).alias("at"), F.when(c["lo"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(part, acc["at"] + 1, F.lit(CHUNK))))
    done = parts.join(cuts, ["text_key", "piece"], "left").select("text_key", "piece", F.coalesce(clean, part).alias("part"))
    return done.groupBy("text_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "part"))), lambda x: x["part"]), "").alias("clean"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str = "n_chars", reach: int = REACH) -> DataFrame:
    """The same rows and columns with every span that `scan` reports replaced by `mark` (overlapping spans by one), and the length brought up to date.

    One pass scans the texts, replaces the spans of those that cannot link and have few, and writes the rows; only the others are shuffled.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def in_place(spans: Column) -> Column:
        return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))

    found = with_spans(rows).select("*", (_may_link() | (F.size(_base()) > FEW)).alias("apart"))
    clean = F.when(~F.col("apart") & (F.size(_base()) > 0), in_place(_base()))
    here = F.col("apart")
    staged = written(
        found.select("row", "apart", clean.alias("clean"), F.when(here, F.sha2("text", 256)).alias("text_key"), *[F.when(here, F.col(k)).alias(k) for k in (*KINDS[:3], "weak")]),
        "secret-rows",
    )
    rest = staged.filter("apart")
    spans = rest.dropDuplicates(["text_key"]).select("text_key", F.explode(_base()).alias("s")).select("text_key", "s.*").unionByName(linked(rest, reach))
    texts = rest.select("text_key", F.col(f"row.`{text_col}`").alias("text")).dropDuplicates(["text_key"])
    done = rest.select("row", "text_key").join(_in_pieces(texts, spans, mark), "text_key").select("row", "clean")

    old = F.col(f"row.`{text_col}`")
    hit = F.col("clean").isNotNull() & (F.col("clean") != F.coalesce(old, F.lit("")))
    new = {text_col: F.when(hit, F.col("clean")).otherwise(old)}
    if length_col in docs.columns:
        new[length_col] = F.when(hit, F.length("clean").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.`{length_col}`"))
    out = staged.filter("not apart").select("row", "clean").unionByName(done)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
