"""Operator 4: personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the matches of four fixed patterns that pass their checks (address parts, Luhn, digit counts). They seed
the bootstrap: the one or two words before an identifier on its line are a lexical pattern; loosely identifier-shaped
strings that no base span covers are candidate instances. Patterns and instances form a graph that is scored in rounds.
A pattern's weight is the score of the instances that follow it, each as often as it does, over all the pattern's
occurrences in the corpus; it is 0 unless at least ``support`` distinct instances of a score of ``confidence`` follow it.
An instance's score is the noisy-or of its patterns' weights (seeds stay 1). So seeds vouch for patterns, patterns for
candidates, and these for further patterns in the next round. Candidates that follow a pattern of at least
``confidence`` after the last round become spans too.

What a context and a candidate are, as part of the patterns: a context word has up to 30 characters and lies with the next
one within the 80 characters before an identifier on its line; a loose address has up to 64 characters on either side of
its sign; loose numbers have 7 to 19 digits. Longer ones are no contexts and no candidates. Base spans know no such limits.

All counts cover the whole corpus. The fixed patterns are possessive forms of the plain ones, equal in what they match,
so that long texts neither backtrack nor overflow the stack.

Positions are code points, ends exclusive. Null and empty texts have no spans (``redact`` leaves null texts null). Very
long texts are read whole. Repeated rows are judged alike; no id is used as a key. An empty table gives an empty result.
Extra columns are kept; base, loose, _row and those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle, spread

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = r"A-Za-z0-9._%+\-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOOSE = "|".join(
    [
        r"(?<!\S)[^\s@(\[]{1,64}(?:@|\(at\)|\[at\])[^\s@]{2,64}(?!\S)",
        r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])",
        r"(?<![\w.,+(])\(?[0-9](?:[\x20()./_\-]{0,2}[0-9]){6,18}(?![\w])",
    ]
)
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.5, 3
#: Patterns up to this count (about 60 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_PATTERNS = 100_000
_CHUNK = 256
_SPAN = "array<struct<kind:int,start:int,end:int>>"
_FOUND = "array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(sizes: Column) -> Column:
    """For each element, the sum of those before it; by chunks, so that long arrays don't take quadratic time."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + x)

    def chunked(bases: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            chunk = F.floor(i / _CHUNK).cast("int")
            return F.get(bases, chunk) + total(F.slice(sizes, chunk * _CHUNK + 1, i - chunk * _CHUNK))

        return F.transform(sizes, one)

    chunks = F.sequence(F.lit(0), F.floor(F.size(sizes) / _CHUNK).cast("int"))
    return let(F.transform(chunks, lambda c: total(F.slice(sizes, F.lit(1), c * _CHUNK))), chunked)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda n, i: n + doubled(i)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _contexts(gap: Column) -> Column:
    """The lexical patterns at a gap's end: its last two words on the line, and its last one."""
    tail = F.lower(F.right(gap, F.lit(80)))
    two = F.regexp_extract(tail, r"(?:^|\s)(\S{1,30})[ \t]+(\S{1,30})[ \t]*$", 1)
    one = F.regexp_extract(tail, r"(?:^|\s)(\S{1,30})[ \t]*$", 1)
    return F.filter(F.array(one, F.when(two != "", F.concat_ws(" ", two, one))), lambda p: p.isNotNull() & (p != ""))


def _matches(text: Column, pattern: str, kind: Callable[[Column], Column], good: Callable[[Column], Column]) -> Column:
    """All matches that are ``good``, as structs of kind, start, end, value and patterns."""

    def built(x: Column) -> Column:
        gaps, values = x["gaps"], x["values"]
        lengths = F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))

        def rows(at: Column) -> Column:
            def row(v: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(gaps, i))
                return F.when(
                    good(v),
                    F.struct(kind(v).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), _contexts(F.get(gaps, i)).alias("patterns")),
                )

            return F.array_compact(F.transform(values, row))

        return let(let(lengths, before), rows)

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) > 0, let(F.struct(v.alias("values"), F.split(text, pattern, -1).alias("gaps")), built)).otherwise(F.array().cast(_FOUND)))


def base_spans(text: Column) -> Column:
    parts = []
    for i, kind in enumerate(KINDS):
        found = _matches(text, PATTERNS[kind], lambda v, i=i: F.lit(i), lambda v, kind=kind: _passes(kind, v))
        hint = HINTS[kind]
        seen = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9][ -]?[0-9]")
        parts.append(F.when(seen, found).otherwise(F.array().cast(_FOUND)))
    return F.concat(*parts)


def candidates(text: Column, base: Column) -> Column:
    """Loosely shaped identifiers that no base span overlaps."""

    def kind(v: Column) -> Column:
        return F.when(v.rlike(r"@|\(at\)|\[at\]"), 0).when(F.contains(v, F.lit(":")), 1).when(F.length(_digits(v)) >= 13, 2).otherwise(3)

    found = F.when(text.rlike(r"[0-9@]|[(\[]at[)\]]"), _matches(text, LOOSE, kind, lambda v: F.lit(True))).otherwise(F.array().cast(_FOUND))
    return F.filter(found, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def scan(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with base and loose: arrays of matches."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("base", base_spans(body)).withColumn("loose", candidates(body, F.col("base")))


def _few(patterns: DataFrame) -> bool:
    return patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS


def _words_seen(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(pattern, seen): how often each wanted pattern occurs in the corpus as a word or as two words in a row, whatever
    follows. Words are counted before they are shuffled, only the wanted ones if these are few."""
    wanted = wanted.select("pattern").distinct()
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    pairs = F.transform(F.slice("w", F.lit(2), F.size("w")), lambda w, i: F.concat_ws(" ", F.get(F.col("w"), i), w))
    each = docs.select(words.alias("w")).select(F.explode(F.concat("w", pairs)).alias("pattern")).filter("pattern <> ''")
    few = _few(wanted)
    if few:
        each = each.join(F.broadcast(wanted), "pattern", "left_semi")
    counted = each.groupBy("pattern").agg(F.count("*").alias("seen"))
    return counted if few else counted.join(wanted, "pattern", "left_semi")


def graph_of(scanned: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(kind, pattern, value, seed, n): how often each value follows each pattern. Patterns that ``support`` distinct
    values or no candidate follow can't add anything and are left out."""

    def each(column: str, seed: int) -> DataFrame:
        one = scanned.select(F.explode(column).alias("m")).select("m.kind", F.lower("m.value").alias("value"), F.explode("m.patterns").alias("pattern"))
        return one.withColumn("seed", F.lit(seed))

    edges = each("base", 1).union(each("loose", 0)).groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    kept = edges.groupBy("kind", "pattern").agg(F.count("*").alias("values"), F.sum(1 - F.col("seed")).alias("others"))
    kept = kept.filter((F.col("values") >= support) & (F.col("others") > 0)).select("kind", "pattern")
    return edges.join(kept, ["kind", "pattern"])


def weigh(graph: DataFrame, seen: DataFrame, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> list[DataFrame]:
    """(kind, pattern, w) after each round; ``graph`` and ``seen`` are settled."""
    scores = graph.filter("seed = 1").select("kind", "value").distinct().withColumn("s", F.lit(1.0))
    out = []
    for _ in range(rounds):
        s = F.coalesce("s", F.lit(0.0))
        linked = graph.join(scores, ["kind", "value"], "left").groupBy("kind", "pattern").agg(F.sum(s * F.col("n")).alias("f"), F.count_if(s >= confidence).alias("sure"))
        weight = F.when(F.col("sure") >= support, F.least(F.lit(1.0), F.col("f") / F.col("seen"))).otherwise(0.0)
        weights = settle(linked.join(seen, "pattern").select("kind", "pattern", weight.alias("w")))
        scores = (
            graph.join(weights, ["kind", "pattern"])
            .groupBy("kind", "value")
            .agg(F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("w"), F.lit(1e-9)))))).alias("s"))
        )
        out.append(weights)
    return out


def discover(scanned: DataFrame, docs: DataFrame, text: str, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern) of the high-confidence patterns; ``scanned`` has the columns of ``scan``."""
    graph = settle(graph_of(scanned, support))
    patterns = settle(graph.select("kind", "pattern").distinct())
    if not patterns.take(1):
        return patterns
    seen = settle(_words_seen(docs, text, patterns))
    last = weigh(graph, seen, support=support, confidence=confidence, rounds=rounds)[-1]
    return last.filter(F.col("w") >= confidence).select("kind", "pattern")


def _added(scanned: DataFrame, trusted: DataFrame) -> DataFrame:
    """(_row, added_spans) of the rows that gain spans."""
    hits = scanned.filter(F.size("loose") > 0).select("_row", F.explode("loose").alias("m")).select("_row", "m.kind", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    hits = hits.join(F.broadcast(trusted) if _few(trusted) else trusted, ["kind", "pattern"], "left_semi")
    return hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added_spans"))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def find_personal_data(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """``docs`` (or its columns ``keep``) with base_spans and added_spans, arrays of struct(kind, start, end), where
    kind is a place in KINDS; sorted by kind and start. Columns of those names are replaced."""
    docs = spread(docs.drop("base", "loose", "base_spans", "added_spans", "_row"))
    names = docs.columns if keep is None else keep
    scanned = settle(scan(docs, text).select(*names, "base", "loose").withColumn("_row", F.monotonically_increasing_id()))
    trusted = discover(scanned, docs, text, **options)
    base = F.array_sort(_plain(F.col("base"))).alias("base_spans")
    if not trusted.take(1):
        return scanned.select(*names, base, F.array().cast(_SPAN).alias("added_spans"))
    return scanned.join(_added(scanned, trusted), "_row", "left").select(*names, base, F.coalesce("added_spans", F.array().cast(_SPAN)).alias("added_spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as text."""
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base_spans", "added_spans"))
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("added_spans").cast("long").alias("n_added")
    )


def redact(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, such as [email]; overlapping spans are replaced as
    one, under the first's kind."""
    docs = spread(docs.drop("base", "loose", "_row"))
    rest = [c for c in docs.columns if c != text]
    scanned = settle(scan(docs, text).withColumn("_row", F.monotonically_increasing_id()))
    trusted = discover(scanned, docs, text, **options)
    scanned = scanned.withColumn("base_spans", _plain(F.col("base")))
    if trusted.take(1):
        every = F.concat("base_spans", F.coalesce("added_spans", F.array().cast(_SPAN)))
        scanned = scanned.join(_added(scanned, trusted), "_row", "left").withColumn("base_spans", every)
    # Sorted by start; the text is cut between spans from left to right.
    ordered = F.array_sort(F.transform("base_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def cut(body: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
            fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.get(names, s["kind"]))).alias("out"))
            longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
            return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

        rest_of = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body)))
        return F.aggregate(spans, start, step, rest_of)

    return scanned.select(*rest, F.when(F.size("base_spans") > 0, let(ordered, lambda o: cut(F.col(text), o))).otherwise(F.col(text)).alias(text)).select(docs.columns)
