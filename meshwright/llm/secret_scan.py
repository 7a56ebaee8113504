"""Secret scanning through a trigram inverted index, with DataFrame functions alone.

Method: from each rule's regular expression a Boolean query over trigrams is
derived (those any match must hold, letters folded). An inverted index gives
the documents that hold a trigram; postings are intersected per document;
candidates are verified by the expression itself. A rule without mandatory
trigrams is verified on every document.

Postings are (trigram, document key) rows over the trigrams that the rules
need. They are intersected by document key, so a trigram that a third of all
documents hold is spread like any other. The candidates that come of it are
written as a table of keys and rule numbers: where it is small enough for the
session's own bound the planner broadcasts it and texts stay where they are, else
both sides are dealt by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as parser  # the standard library's own parser of expressions

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.plans.recovery import written

from .columns import Columns


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` characters drop."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base rules. Runs are maximal, so a least length inside the quantifier finds what a filter of whole
# runs finds; the first rule needs the filter, as a short value still uses up its text.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

# Key formats that vendors publish, and two common carriers of secrets. Each holds a mandatory trigram.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"(postgresql|postgres|mysql|mongodb|redis|amqps?|https?|ftp)://[A-Za-z0-9._%+-]{1,64}:[^\x00-\x20:@/\x22'<>]{3,128}@[A-Za-z0-9.-]+"),
    Rule("aws_session", r"ASIA[A-Z0-9]{16}"),
    Rule("azure_key", r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("shopify", r"shp(at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: None (any document), a trigram, or ("and" | "or", queries).
Query = None | str | tuple
_MOST = 64  # literal alternatives carried along before they are turned into trigrams


def _all(queries: list[Query]) -> Query:
    left = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not left else left[0] if len(left) == 1 else ("and", tuple(left))


def _any(queries: list[Query]) -> Query:
    left = list(dict.fromkeys(queries))
    held = {q: {q} if isinstance(q, str) else set(q[1]) if q and q[0] == "and" and all(isinstance(x, str) for x in q[1]) else None for q in left}
    # an alternative that asks for more than another one adds nothing
    left = [q for q in left if held[q] is None or not any(o is not None and o < held[q] for o in held.values())]
    return None if None in left or not left else left[0] if len(left) == 1 else ("or", tuple(left))


def _grams(strings: set[str]) -> Query:
    """Trigrams that cover each string, end to end; those between them would add little."""
    return _any([_all([s[i : i + 3] for i in (*range(0, len(s) - 3, 3), len(s) - 3)] if len(s) > 2 else []) for s in sorted(strings)])


def _literals(op, arg) -> set[str] | None:
    """The strings that a node matches, if few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out = set()
        for o, a in arg:
            if str(o) == "LITERAL":
                out.add(chr(a).lower())
            elif str(o) == "RANGE" and a[1] - a[0] < 8:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence(arg[-1])[0]
    if name == "BRANCH":
        parts = [_sequence(p)[0] for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _sequence(arg[2])[0]
        return inner and inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """What a sequence matches exactly (None if not few strings), and a query that any match meets."""
    now, found, exact = {""}, [], True
    for op, arg in nodes:
        name = str(op)
        if name == "AT":
            continue
        strings = _literals(op, arg)
        if strings is not None and len(strings) * len(now) <= _MOST:
            now = {a + b for a in now for b in strings}
            continue
        exact = False
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            inner, query = _sequence(arg[2])
            if inner is not None and len(inner) * len(now) <= _MOST:
                now = {a + b for a in now for b in inner}
            else:
                found.append(query)
        elif name == "SUBPATTERN":
            found.append(_sequence(arg[-1])[1])
        elif name == "BRANCH":
            found.append(_any([_sequence(p)[1] for p in arg[1]]))
        found.append(_grams(now))
        now = {""}
    return (now if exact else None), _all([*found, _grams(now)])


def trigram_query(regex: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match meets; None if there is none."""
    return _sequence(parser.parse(regex))[1]


def _needed(query: Query) -> list[str]:
    if query is None:
        return []
    return [query] if isinstance(query, str) else [g for q in query[1] for g in _needed(q)]


def _meets(query: Query, grams: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [_meets(q, grams) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, key) for each of ``grams`` that a text holds, letters folded, from rows (key, text)."""
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    # an outer explode: an inner one infers a filter on the array, which is then computed once more for it
    found = keyed.select("key", F.lower("text").alias("low")).select("key", F.explode_outer(held).alias("gram"))
    return found.filter("gram is not null")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, mask): for each document that meets any rule's trigram query, bit i for rule i."""
    held = index.groupBy("key").agg(F.collect_set("gram").alias("grams"))
    mask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        query = trigram_query(r.regex)
        if query is not None:
            mask = mask.bitwiseOR(F.when(_meets(query, F.col("grams")), F.lit(1 << i)).otherwise(0).cast("long"))
    return held.select("key", mask.alias("mask")).filter("mask <> 0")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _chunked(items: Column, begin: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """Folds an array chunk by chunk, each as long as there are chunks: what a step appends is then copied about sqrt(n) times, not n."""
    size = lambda z: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(z)))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), size(items)), lambda k: F.slice(items, k * size(items) + 1, size(items)))
    return F.aggregate(F.filter(cut, lambda c: F.size(c) > 0), begin, step, finish)


SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def _spans(text: Column, rule: Column) -> Column:
    """Verified spans of one rule in code points; a match's start is the length of all that was split off before it."""
    whole, value = F.regexp_extract_all(text, rule["regex"], F.lit(0)), F.regexp_extract_all(text, rule["regex"], rule["group"])
    pieces = F.arrays_zip(F.split(text, rule["regex"], -1).alias("gap"), whole.alias("hit"), value.alias("value"))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), rule["order"].alias("order"), end.alias("end"), rule["kind"].alias("kind"))
        good = x["hit"].isNotNull() & (F.length(x["value"]) >= rule["least"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def chunk(acc: Column, c: Column) -> Column:
        inner = F.aggregate(c, F.struct(acc["at"].alias("at"), F.array().cast(SPANS).alias("spans")), one)
        return _once(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["spans"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return _once(pieces, lambda z: _chunked(z, begin, chunk, lambda acc: F.flatten(acc["out"])))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` plus spans: array of (start, order, end, kind), sorted by start, then the order of rules.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; whole texts are scanned, in time that
    grows with their length and about the 3/2th power of their matches. Rows repeat as they come, with equal spans for
    equal texts; null ids are allowed. An empty table gives no rows. A column named spans is replaced, all others stay,
    whatever their names. Up to 62 rules.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules")
    queries = [trigram_query(r.regex) for r in rules]
    grams = sorted({g for q in queries for g in _needed(q)})
    given = Columns(docs, ("spans",))
    # rows of equal id and text share a key, and so their candidates
    text = F.coalesce(given["text"].cast("string"), F.lit(""))
    key = F.xxhash64(given["doc_id"], text).alias("key")
    if grams:
        found = written(candidates(postings(given.rows.select(key, text.alias("text")), grams), rules), "secret-candidates")
        rows = given.rows.withColumn("key", key).join(found, "key", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    else:
        rows = given.rows.withColumn("mask", F.lit(0))
    # the rules are one array, so that the plan doesn't grow with them; bit 0: no trigram is mandatory
    every = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(r.kind).alias("kind"), F.lit(r.regex).alias("regex"), F.lit(r.group).alias("group"), F.lit(r.least).alias("least"), F.lit(0 if q is None else 1 << i).cast("long").alias("bit")) for i, (r, q) in enumerate(zip(rules, queries))])
    spans = _once(text, lambda t: F.flatten(F.transform(F.filter(every, lambda r: ((r["bit"] == 0) | (F.col("mask").bitwiseAND(r["bit"]) != 0)) & F.rlike(t, r["regex"])), lambda r: _spans(t, r))))
    return given.named(rows.withColumn("spans", F.sort_array(spans)), "spans")


def labelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with the characters of every span replaced by one ``mark`` per run of overlapping spans; n_chars follows.

    Texts without a span, null ones among them, stay as they are, and so do all other columns, whatever their names,
    and repeated rows. An empty table gives no rows.
    """
    found = Columns(scan(docs, rules))
    text, spans = found["text"], F.col(f"c{len(found.names) - 1}")  # scan's own column comes last

    def one(base: Column, piece: Column) -> Callable[[Column, Column], Column]:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, acc["at"] - base + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

        return step

    none = F.array().cast("array<string>")

    def chunk(acc: Column, c: Column) -> Column:
        end = F.array_max(F.transform(c, lambda s: s["end"]))
        piece = F.substring(text, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0)))
        inner = _once(piece, lambda p: F.aggregate(c, F.struct(acc["at"].alias("at"), none.alias("out")), one(acc["at"], p)))
        return _once(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
    clean = _chunked(spans, begin, chunk, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    hit = F.size(spans) > 0
    out = found.rows.withColumn("clean", F.when(hit, clean).otherwise(text)).withColumn("hit", hit)
    made = []
    for i, name in enumerate(found.names[:-1]):
        own = F.col(f"c{i}")
        if found.fold(name) == "text":
            own = F.col("clean")
        elif found.fold(name) == "n_chars":
            own = F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(own)
        made.append(own.alias(name))
    return out.select(*made)
