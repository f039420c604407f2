"""Secret scans by multipart credential linking, in DataFrame functions only.

``secret_spans`` finds three base kinds in every text (leftmost, not overlapping
within a kind; matches that fail their length test are dropped, but still
consume the text they cover):

* ``assign``  a password-like name, ``:`` or ``=``, and a value of 8+ characters;
* ``access``  an access identifier, ``AKIA`` and capitals/digits, 16+ characters;
* ``hex``     a run of 32+ lower-case hex digits;

and two weak kinds that mean nothing alone:

* ``key``       a separate run of exactly 40 base64 characters that holds a lower-case letter,
  a capital and a digit;
* ``endpoint``  an ``http(s)://`` address.

Weak candidates are reported only when complementary parts co-occur: a ``key``
needs an access identifier within ``scope`` code points (gap between the two
spans), and an ``endpoint`` is reported when such a linked pair has it within
``scope`` of the identifier.  The links come from an interval join: parts are
exploded to (text, bin) rows with bins as wide as the scope (identifiers to all bins
within the scope, the others to all bins they cover), joined on the bin and tested by
their gap.  Spans of one kind do not overlap and have a least
length, so a bin holds a bounded number of them whatever the text's length.  Positions are
running totals by doubling and texts are cut in two levels, so that a text of very many
matches takes little more than linear time.

Positions are code points, the end is exclusive.  A null text counts as empty;
an empty text or table gives no spans; repeated rows are scanned one by one;
null ids stay null; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import staged

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_START = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"                       # the runs [0-9a-f]+ of 32+, found without listing shorter runs
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"
KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]
SCOPE = 400
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def _held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda in ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join) -> Column:
    """Running totals of an int array under an associative ``join``: log2(n) passes of doubled reach, no growing array."""
    shifts = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(
        shifts, values,
        lambda acc, s: F.concat(
            F.slice(acc, F.lit(1), s),
            F.zip_with(F.slice(acc, s + 1, F.size(acc) - s), F.slice(acc, F.lit(1), F.size(acc) - s), join)))


def _positions(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of a pattern: what lies between the matches gives their starts."""
    found = F.regexp_extract_all(text, _lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.transform(found, F.length)
    # the end of match i: lengths of the pieces 0..i and of the matches 0..i
    steps = F.zip_with(lengths, F.slice(between, 1, F.size(found)), lambda n, gap: n + F.length(gap))
    ends = _held(steps, lambda st: _running(st, lambda a, b: a + b))
    walked = F.zip_with(ends, lengths, lambda end, n: F.struct(
        (end - n).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
    if keep is None:
        return walked
    ok = keep(found)
    return F.transform(F.filter(F.arrays_zip(walked.alias("s"), ok.alias("ok")), lambda z: z["ok"]), lambda z: z["s"])


def _none() -> Column:
    return F.array().cast(SPAN)


def _if(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(_none())


def scan_spans(text: Column) -> dict[str, Column]:
    """Span arrays of the base and of the weak kinds of one text column (not null)."""
    values = lambda found: F.transform(F.regexp_extract_all(text, _lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    long16 = lambda found: F.transform(found, lambda m: F.length(m) >= 16)
    mixed = lambda found: F.transform(found, lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"))
    has_id = text.contains("AKIA")
    return {
        "assign": _if(text.rlike(ASSIGN_START), _positions(text, ASSIGN, 0, values)),
        "access": _if(has_id, _positions(text, ACCESS, 1, long16)),
        "hex": _if(text.rlike(HEX), _positions(text, HEX, 2)),
        # weak parts without an identifier in the same text can never be linked
        "key": _if(has_id, _positions(text, KEY, 3, mixed)),
        "endpoint": _if(has_id & text.contains("://"), _positions(text, ENDPOINT, 4)),
    }


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Interval join within a text: pairs of spans with a gap of at most ``scope``."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    a = left.select("row", F.col("start").alias("s1"), F.col("end").alias("e1"),
                    bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("bin"))
    b = right.select("row", F.col("start").alias("s2"), F.col("end").alias("e2"), bins(F.col("start"), F.col("end")).alias("bin"))
    gap = F.greatest(F.col("s2") - F.col("e1"), F.col("s1") - F.col("e2"))
    # two spans can share several bins; the first of them gives the pair
    first = F.col("bin") == F.floor(F.greatest(F.col("s1") - scope, F.col("s2"), F.lit(0)) / scope)
    return a.join(b, ["row", "bin"]).where((gap <= scope) & first).select("row", "s1", "e1", "s2", "e2")


def linked_spans(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, spans): the weak spans of each text that complementary parts confirm.

    ``parts`` has a unique ``row`` and the arrays ``access``, ``key``, ``endpoint``.
    """
    rows = parts.where((F.size("access") > 0) & (F.size("key") > 0))
    of = lambda kind: rows.select("row", F.inline(kind))
    pairs = _near(of("access"), of("key"), scope)
    keys = pairs.select("row", F.col("s2").alias("start"), F.lit(3).alias("kind"), F.col("e2").alias("end"))
    ids = pairs.select("row", F.col("s1").alias("start"), F.col("e1").alias("end")).distinct()
    ends = _near(ids, of("endpoint"), scope).select("row", F.col("s2").alias("start"), F.lit(4).alias("kind"), F.col("e2").alias("end"))
    spans = keys.unionByName(ends).distinct()
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: id, ``base`` and ``linked`` (sorted arrays of start, kind index, end)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    found = narrow.select("id", *[c.alias(k) for k, c in scan_spans(F.col("t")).items()])
    # staged: the spans are read twice below, and a row number must not change between the reads
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    out = found.join(linked_spans(found, scope), "row", "left")
    return out.select(F.col("id").alias(id_col),
                      F.array_sort(F.concat(*BASE)).alias("base"),
                      F.array_sort(F.coalesce("linked", _none())).alias("linked"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def _cut(text: Column, kept: Column, mark: str) -> Column:
    """The pieces ``kept`` (from, to) of a text, joined by ``mark``.

    A piece is found by walking from the start of its string, so the text is first cut into about
    the root of the number of pieces, and the pieces from these parts.
    """
    width = F.ceil(F.sqrt(F.size(kept))).cast("int")

    def part(first: Column) -> Column:
        own = F.slice(kept, first, width)
        return _held(own, lambda ps: _held(
            text.substr(ps[0]["from"] + 1, F.element_at(ps, -1)["to"] - ps[0]["from"]),
            lambda t: F.array_join(F.transform(ps, lambda p: t.substr(p["from"] - ps[0]["from"] + 1, p["to"] - p["from"])), mark)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(kept), width), part), mark)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span (overlapping ones merged) replaced by ``mark``."""
    def cut(ordered: Column) -> Column:
        # reached[i]: the furthest end of the spans before i; a span that starts before it is covered or touched already
        reached = F.concat(F.array(F.lit(0)), _held(
            F.transform(ordered, lambda s: s["end"]), lambda e: _running(e, lambda a, b: F.greatest(a, b))))
        starts = F.concat(F.transform(ordered, lambda s: s["start"]), F.array(F.length(text)))
        kept = F.filter(F.zip_with(reached, starts, lambda a, b: F.struct(a.alias("from"), b.alias("to"))), lambda p: p["from"] <= p["to"])
        return _held(kept, lambda k: _cut(text, k, mark))

    return F.when(F.size(spans) == 0, text).otherwise(_held(F.array_sort(spans), cut))


def redact_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """All rows and columns, with the secrets in the text replaced; null texts stay null.

    Texts without any base pattern have no spans and pass by; the others meet
    their spans by a join on a 128-bit digest of the text (copies of one text
    share one row of spans, and the skew join splits a text with many copies).
    """
    t = F.col(text_col)
    marked = F.coalesce(t.rlike(ASSIGN_START) | t.contains("AKIA") | t.rlike(HEX), F.lit(False))
    # the whole row travels as one struct, so no column of the input can clash with the key
    hits = docs.where(marked).select(F.md5(t.cast("binary")).alias("digest"), t.alias("t"), F.struct("*").alias("doc"))
    spans = secret_spans(hits, "digest", "t", scope).dropDuplicates(["digest"])
    spans = spans.select("digest", F.concat("base", "linked").alias("spans"))
    fixed = hits.join(spans, "digest").select("doc", redacted(F.col("t"), F.col("spans")).alias("t"))
    fixed = fixed.select(*[(F.col("t") if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
    return docs.where(~marked).unionByName(fixed)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The same spans for DuckDB, whose patterns know no look-around: a key is a whole run of 40.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  SELECT r, 0 AS kind, regexp_extract_all(t, {_sql(ASSIGN)}, 0) AS f, string_split_regex(t, {_sql(ASSIGN)}) AS g,
         list_transform(regexp_extract_all(t, {_sql(ASSIGN)}, 2), lambda x: length(x) >= 8) AS ok FROM d WHERE regexp_matches(t, {_sql(ASSIGN_START)})
  UNION ALL
  SELECT r, 1, regexp_extract_all(t, '{ACCESS}'), string_split_regex(t, '{ACCESS}'),
         list_transform(regexp_extract_all(t, '{ACCESS}'), lambda x: length(x) >= 16) FROM d WHERE contains(t, 'AKIA')
  UNION ALL
  SELECT r, 2, regexp_extract_all(t, '{HEX}'), string_split_regex(t, '{HEX}'),
         list_transform(regexp_extract_all(t, '{HEX}'), lambda x: true) FROM d WHERE regexp_matches(t, '{HEX}')
  UNION ALL
  SELECT r, 3, regexp_extract_all(t, '[A-Za-z0-9+/]+'), string_split_regex(t, '[A-Za-z0-9+/]+'),
         list_transform(regexp_extract_all(t, '[A-Za-z0-9+/]+'), lambda x: length(x) = 40 AND regexp_matches(x, '[a-z]')
                        AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')) FROM d WHERE contains(t, 'AKIA')
  UNION ALL
  SELECT r, 4, regexp_extract_all(t, {_sql(ENDPOINT)}), string_split_regex(t, {_sql(ENDPOINT)}),
         list_transform(regexp_extract_all(t, {_sql(ENDPOINT)}), lambda x: true) FROM d WHERE contains(t, 'AKIA')
), each AS (
  SELECT r, kind, i, f, g, length(f[i]) AS n FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM found) WHERE ok[i]
), spans AS (
  SELECT r, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM (
    SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s FROM each)
), pairs AS (
  SELECT a.r, a.s AS s1, a.e AS e1, k.s, k.e FROM spans a JOIN spans k ON k.r = a.r AND a.kind = 1 AND k.kind = 3
  WHERE greatest(k.s - a.e, a.s - k.e) <= {SCOPE}
), linked AS (
  SELECT r, 3 AS kind, s, e FROM pairs
  UNION
  SELECT p.r, 4, x.s, x.e FROM pairs p JOIN spans x ON x.r = p.r AND x.kind = 4 WHERE greatest(x.s - p.e1, p.s1 - x.e) <= {SCOPE}
), kept AS (
  SELECT *, ['{"', '".join(KINDS)}'][kind + 1] || ':' || s || ':' || e AS said FROM (SELECT * FROM spans WHERE kind < 3 UNION ALL SELECT * FROM linked)
), summed AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
         coalesce(string_agg(said, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3), '') AS base, string_agg(said, ',' ORDER BY s, kind, e) AS spans,
         count(*) FILTER (WHERE kind > 2) AS n_linked FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN summed USING (r)
"""
