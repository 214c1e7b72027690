r"""Secret scans by trigram postings.

Each rule's regex is parsed on the driver and turned into a Boolean query over trigrams
that every match must hold: a conjunction of the trigrams of a literal, a disjunction
over alternatives. `Index.build` writes the inverted index: for each trigram of the
queries and each block of keys (a key is a text's XXH64) the sorted posting list of the
keys whose texts hold it. `Index.candidates` evaluates the queries on it, block by block:
posting lists are intersected and united. Rows whose key is a candidate of a rule are
verified with the regex itself, which also rejects rows that merely share a candidate's
key. A rule without a mandatory trigram is run over all rows.

A block holds about BLOCK keys, so no posting list is longer. Candidates are broadcast if
they are few (MOST), else joined by a shuffle.

Spans count code points, end exclusive. Found spans of a rule are its leftmost
non-overlapping matches; matches whose `part` group has under `least` characters are
dropped afterwards. Positions are running sums over runs of RUN matches and then over the
runs, so the time is in proportion to the text for any number of matches. Null texts count
as empty; empty texts have no spans. Rows are kept as they come, repeated ones too. A text
of any length is scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import packed, pin, read


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    part: int = 0
    least: int = 0
    any_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the matches of [0-9a-f]+ that have 24 characters or more
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE + MORE
#: Exact strings that an expression is followed as before it is summed up in trigrams.
MOST_EXACT = 16
#: Keys in a block of the index, candidates that may be broadcast (16 bytes each), and matches in a run.
BLOCK, MOST, RUN = 1 << 16, 1 << 18, 256


# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).
def _all(*qs):
    parts = set()
    for q in qs:
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q} - {True}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(*qs):
    if True in qs:
        return True
    return qs[0] if len(set(qs)) == 1 else ("or", frozenset(qs))


def _grams(s: str):
    return _all(*(s[i : i + 3] for i in range(len(s) - 2)))


def _walk(nodes) -> tuple[set[str] | None, object]:
    """Of a sequence: all strings it matches, if they are few, and else None; the query for what it demands besides."""
    run: set[str] = {""}  # the strings of the literal run that is going on
    whole, query = True, True
    for op, arg in nodes:
        now, demand = _one(op, arg)
        query = _all(query, demand)
        if now is not None and len(run) * len(now) <= MOST_EXACT:
            run = {a + b for a in run for b in now}
            continue
        query = _all(query, _sum(run))
        whole, run = False, now or {""}
    return (run, query) if whole else (None, _all(query, _sum(run)))


def _one(op, arg) -> tuple[set[str] | None, object]:
    """The same of a single item."""
    if op is sre.LITERAL:
        return {chr(arg)}, True
    if op is sre.IN and all(x is sre.LITERAL for x, _ in arg) and len(arg) <= 6:
        return {chr(c) for _, c in arg}, True
    if op is sre.AT:
        return {""}, True
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(e is not None and q is True for e, q in found):
            return set().union(*(e for e, _ in found)), True
        return None, _any(*(_all(q, _sum(e)) for e, q in found))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        lo, hi, sub = arg
        inner, q = _walk(sub)
        if lo == 0:
            return (inner | {""}, True) if hi == 1 and inner is not None and q is True else (None, True)
        if inner is not None and lo == hi and lo <= 8 and len(inner) == 1:
            return {x * lo for x in inner}, q
        return None, _all(q, _sum(inner))
    return None, True


def _sum(exact: set[str] | None):
    return True if exact is None else _any(*(_grams(s) for s in exact)) if exact else True


def trigram_query(regex: str, any_case: bool = False):
    """The Boolean query that every text with a match of regex fulfils; True if there is none."""
    every, query = _walk(_parser.parse(regex.lower() if any_case else regex))
    return _all(query, _sum(every))


def _leaves(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(_leaves, q[1]))


class Index:
    """The inverted index of the trigrams that the rules ask for."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.queries = [trigram_query(r.regex, r.any_case) for r in rules]
        self.grams = sorted({(g, r.any_case) for r, q in zip(rules, self.queries, strict=True) for g in _leaves(q)})
        self.at = {g: i for i, g in enumerate(self.grams)}

    def build(self, texts: DataFrame) -> DataFrame:
        """gram, block and keys, of texts (_key, _text): posting lists, stored in the shared folder."""
        blocks = max(1, -(-texts.count() // BLOCK))
        held = (F.when(F.contains("_lower" if low else "_text", F.lit(g)), F.lit(i)) for i, (g, low) in enumerate(self.grams))
        rows = texts.withColumn("_lower", F.lower("_text")).select("_key", F.explode(F.array_compact(F.array(*held))).alias("gram"))
        lists = rows.groupBy("gram", F.pmod("_key", F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_set("_key")).alias("keys"))
        return pin(lists, "secrets-postings")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """_key and _rules, of texts that some rule's query leaves: bit k for rule k."""
        none = F.array().cast("array<long>")
        lists = postings.groupBy("block").agg(*(F.coalesce(F.first(F.when(F.col("gram") == i, F.col("keys")), ignorenulls=True), none).alias(f"g{i}") for i in range(len(self.grams))))
        found = [(k, self._holds(q, r.any_case)) for k, (q, r) in enumerate(zip(self.queries, self.rules, strict=True)) if q is not True]
        each = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("rule"), keys.alias("keys")) for k, keys in found))
        keys = lists.select(F.explode(each).alias("e")).select("e.rule", F.explode("e.keys").alias("_key"))
        return pin(keys.groupBy("_key").agg(F.bit_or("rule").alias("_rules")), "secrets-candidates")

    def _holds(self, q, low: bool) -> Column:
        """The keys in a block whose texts fulfil the query."""
        if isinstance(q, str):
            return F.col(f"g{self.at[q, low]}")
        meet = F.array_intersect if q[0] == "and" else F.array_union
        return reduce(meet, (self._holds(x, low) for x in sorted(q[1], key=str)))


def _in_runs(items: Column, start: Column, step, of: str) -> Column:
    """What step(state, run) adds to `out` of the state for runs of RUN items; the state is a struct (at, out)."""
    # A lambda's variable holds the items, so that they are made once and not for each run.
    cut = lambda all_of: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_of) - 1, F.lit(0)) / RUN).cast("int")), lambda n: F.slice(all_of, n * RUN + 1, RUN))
    runs = F.transform(F.array(items), cut)[0]
    first = F.struct(start.alias("at"), F.array().cast(f"array<array<{of}>>").alias("out"))

    def add(acc, run):
        return F.transform(F.array(step(acc["at"], run)), lambda now: F.struct(now["at"].alias("at"), F.concat(acc["out"], F.array(now["out"])).alias("out")))[0]

    return F.aggregate(runs, first, add)


def _spans(rule: Rule, k: int, text: Column) -> Column:
    """(start, kind number, end) of each kept match. The text between matches and the matches, in turns, give the positions."""
    regex = ("(?i)" if rule.any_case else "") + rule.regex
    gaps, hits = F.split(text, F.lit(regex), -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    part = (lambda h: F.length(F.regexp_extract(h, regex, rule.part))) if rule.part else F.length
    sizes = F.transform(hits, lambda h: F.struct(F.length(h).alias("size"), part(h).alias("part")))
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), sizes.alias("hit"))

    def run(at, some):
        def step(acc, x):
            a = acc["at"] + x["gap"]
            b = a + F.coalesce(x["hit"]["size"], F.lit(0))
            keep = x["hit"].isNotNull() & (x["hit"]["part"] >= rule.least)
            one = F.array(F.struct(a.alias("start"), F.lit(k).alias("kind"), b.alias("end")))
            return F.struct(b.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(some, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step)

    return F.flatten(_in_runs(steps, F.lit(0), run, SPAN)["out"])


SPAN = "struct<start:int,kind:int,end:int>"


def scan(df: DataFrame, column: str = "text", rules=RULES) -> DataFrame:
    """Adds `found`: all spans of all rules, as (start, kind number, end) in order. A column of this name is replaced."""
    return _found(df.select(packed(df, ("found",)), F.col(column).alias("_column")), rules).select("row.*", "found")


def _found(df: DataFrame, rules) -> DataFrame:
    """row, _column and found, of row and _column."""
    index = Index(rules)
    text = F.coalesce(F.col("_column").cast("string"), F.lit(""))
    rows = df.withColumns({"_text": text, "_key": F.xxhash64(text)})
    known = index.candidates(index.build(rows.select("_key", "_text")))
    rows = rows.join(F.broadcast(known) if known.count() <= MOST else known, "_key", "left")
    lists = []
    for k, (rule, q) in enumerate(zip(rules, index.queries, strict=True)):
        maybe = F.lit(True) if q is True else F.coalesce(F.col("_rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(False))
        lists.append(F.when(maybe, _spans(rule, k, F.col("_text"))).otherwise(F.array().cast(f"array<{SPAN}>")))
    return rows.select("row", "_column", F.array_sort(F.concat(*lists)).alias("found"))


def _told(spans: Column, rules) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(df: DataFrame, column: str = "text", mark: str = "[SECRET]", rules=RULES) -> DataFrame:
    """Replaces what any rule finds with mark; overlapping spans give one mark. Other texts stay as they are, nulls too."""

    def run(at, some):
        """Of a run of spans: the text that it reaches over is cut out once, and cut up from there."""
        to = F.greatest(at, F.array_max(F.transform(some, lambda s: s["end"])))

        def cut(text):
            def step(acc, s):
                fresh = s["start"] >= acc["at"]
                piece = F.array(F.substring(text, acc["at"] - at + 1, s["start"] - acc["at"]), F.lit(mark))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

            return F.aggregate(some, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step)

        return F.transform(F.array(F.substring("_column", at + 1, to - at)), cut)[0]

    done = _in_runs(F.col("found"), F.lit(0), run, "string")
    rest = lambda acc: F.concat(F.array_join(F.flatten(acc["out"]), ""), F.substring("_column", acc["at"] + 1, F.length("_column")))
    clean = F.transform(F.array(done), rest)[0]
    rows = _found(df.select(packed(df), F.col(column).alias("_column")), rules)
    return rows.select(F.col("row").withField(f"`{column}`", F.when(F.size("found") > 0, clean).otherwise(F.col("_column"))).alias("row")).select("row.*")


def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_told(base, RULES), 256).alias("base_sha256"),
        _told(F.col("found"), RULES).alias("spans"),
    )
