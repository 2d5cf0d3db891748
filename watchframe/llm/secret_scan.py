"""Secret scan with a trigram inverted index, in DataFrame operations only.

For each rule a Boolean query over trigrams is derived from its regular expression: every match must contain all trigrams of
one of the query's branches. The index lists, for every trigram of the queries, the documents whose lower-case text contains
it. Intersecting the lists of a branch, and uniting branches, gives the candidates of a rule, and only those are verified
with the expression itself. A rule whose expression forces no trigram, such as a run of hex digits, is verified on all texts.
Postings are grouped by document, never by trigram, so a frequent trigram makes no large group.

A rule's matches are leftmost and do not overlap; those whose ``measured`` group is shorter than ``least`` are then dropped.
Positions are code points with the end exclusive. Defined results: a null text is an empty one and has no secrets; a null id
or repeated ids keep one row per input row; an empty table gives an empty result; further columns may be carried along.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.llm.texts import whole_text

MOST_STRINGS = 64  # alternatives that a derived part of a match is followed through
BLOCK = 256  # matches that are placed, or masked, together


@dataclass(frozen=True)
class Rule:
    """A kind of secret. The expression must mean the same to Python, which derives the query, and to Java."""

    kind: str
    expression: str
    least: int = 0
    measured: int = 0  # the group whose length counts; 0 is the match


# The expressions and lengths of the base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)


# ---- Boolean trigram queries -------------------------------------------------------------------------------------------
# A query is a set of branches, each a set of trigrams that must all occur; no branch at all never matches, an empty branch
# always does. A part of an expression is described by the strings it can be, or None if those are too many, and a query.

def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _both(a: frozenset, b: frozenset) -> frozenset:
    return _least({x | y for x in a for y in b})


def _least(branches) -> frozenset:
    """Without the branches that ask for more than another."""
    return frozenset(x for x in branches if not any(y < x for y in branches))


ANY = frozenset([frozenset()])


def _close(strings) -> frozenset:
    return _least({trigrams(s) for s in strings})


def _sequence(parts: list) -> tuple[set[str] | None, frozenset]:
    """Follow the strings of neighbouring parts as long as they are few; an unknown part ends them."""
    query, run, whole = ANY, {""}, True
    for strings, asked in parts:
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        else:
            query, whole = _both(_both(query, _close(run)), asked), False
            run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
    if whole:
        return run, ANY
    return None, _both(query, _close(run))


def _describe(tree) -> tuple[set[str] | None, frozenset]:
    parts = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append(({chr(value).lower()}, ANY))
        elif name == "IN":
            parts.append((_members(value), ANY))
        elif name == "SUBPATTERN":
            parts.append(_describe(value[-1]))
        elif name == "BRANCH":
            each = [_describe(branch) for branch in value[1]]
            if all(strings is not None for strings, _ in each) and sum(len(s) for s, _ in each) <= MOST_STRINGS:
                parts.append((set().union(*(s for s, _ in each)), ANY))
            else:
                parts.append((None, _least(set().union(*(_close(s) if s is not None else q for s, q in each)))))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            strings, query = _describe(inner)
            if low == 0 and high == 1 and strings is not None:
                parts.append((strings | {""}, ANY))
            elif low == 0:
                parts.append((None, ANY))
            else:
                parts += [(strings, query)] * min(low, 3)
                if high != low or low > 3:
                    parts.append((None, ANY))
        elif name != "AT":  # whatever else can be any text
            parts.append((None, ANY))
    return _sequence(parts)


def _members(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            found.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def trigram_query(expression: str) -> frozenset[frozenset[str]]:
    """Branches of trigrams, in lower case; one empty branch if the expression forces none."""
    strings, query = _describe(re._parser.parse(expression))  # the standard library's own reading of the expression
    query = _close(strings) if strings is not None else query
    return ANY if frozenset() in query else query


# ---- index, candidates, verification -----------------------------------------------------------------------------------

def postings(docs: DataFrame, wanted: frozenset[str], id_column: str = "doc_id") -> DataFrame:
    """The index: one row per trigram of ``wanted`` and document that contains it, in one pass over each text."""
    heads: dict[str, list[str]] = {}
    for trigram in sorted(wanted):
        heads.setdefault(trigram[0], []).append(trigram[1:])
    # A look-ahead finds overlapping trigrams; common first characters are tried once.
    expression = "(?=(" + "|".join(f"{_quoted(c)}(?:{'|'.join(map(_quoted, rest))})" for c, rest in heads.items()) + "))"
    found = F.array_distinct(F.regexp_extract_all(F.lower(whole_text("text")), F.lit(expression), F.lit(1)))
    return docs.select(F.col(id_column), F.explode(found).alias("trigram"))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def candidates(index: DataFrame, queries: dict[str, frozenset], id_column: str = "doc_id") -> DataFrame:
    """Documents by their possible rules: one row per document with at least one, and ``rules``, the kinds in question.

    All branches are decided in one aggregation by document: a bit per trigram is gathered and compared with each branch.
    """
    order = {t: i for i, t in enumerate(sorted({t for q in queries.values() for branch in q for t in branch}))}
    words = range(-(-len(order) // 60))
    bits = [F.bit_or(reduce(lambda c, t: c.when(F.col("trigram") == t, F.lit(1 << order[t] % 60)),
                            [t for t in order if order[t] // 60 == w], F.when(F.lit(False), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}")
            for w in words]
    gathered = index.groupBy(id_column).agg(*bits)

    def holds(branch: frozenset[str]) -> Column:
        asked = [sum(1 << order[t] % 60 for t in branch if order[t] // 60 == w) for w in words]
        return reduce(Column.__and__, [F.col(f"bits{w}").bitwiseAND(F.lit(mask)) == F.lit(mask) for w, mask in enumerate(asked) if mask])

    kinds = [F.when(reduce(Column.__or__, [holds(b) for b in sorted(q, key=sorted)]), F.lit(kind)) for kind, q in queries.items()]
    rules = F.filter(F.array(*kinds), lambda k: k.isNotNull())
    return gathered.select(F.col(id_column), rules.alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def _blocks(items: Column, each: Callable[[Column], Column]) -> Column:
    """``each`` of every ``BLOCK`` neighbouring items of an array."""
    last = F.call_function("div", F.size(items) - 1, F.lit(BLOCK)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(1)), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    return F.transform(cut, each)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches in a text, in order.

    The pieces between matches come from splitting at the expression, so a match starts after all pieces and matches before.
    Matches are placed within blocks of them and then by the lengths of the blocks before, so an array that grows with each
    match holds those of one block at most, or one entry per block.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.expression), F.lit(0))
    long_enough = (lambda m: F.length(F.regexp_extract(m, rule.expression, rule.measured)) >= rule.least) if rule.measured else (lambda m: F.length(m) >= rule.least)
    sizes = F.transform(F.arrays_zip(F.split(text, rule.expression, -1).alias("piece"), matches.alias("match")),
                        lambda z: F.struct(F.length(z["piece"]).alias("gap"), F.coalesce(F.length(z["match"]), F.lit(0)).alias("size"),
                                           F.coalesce(long_enough(z["match"]), F.lit(False)).alias("kept")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, z: Column) -> Column:
        start = state["at"] + z["gap"]
        one = F.array(F.struct(start.alias("start"), (start + z["size"]).alias("end")))
        return F.struct((start + z["size"]).alias("at"), F.when(z["kept"], F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    def before(state: Column, block: Column) -> Column:
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def place(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), before, lambda s: s["starts"])
        moved = F.zip_with(blocks, starts, lambda b, at: F.transform(b["found"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"))))
        return F.flatten(moved)

    blank = F.struct(F.lit(0).alias("at"), none.alias("found"))
    placed = _let(sizes, lambda items: _let(_blocks(items, lambda block: F.aggregate(block, blank, step)), place))
    return F.when(text.rlike(rule.expression), placed).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_column: str = "doc_id", text_column: str = "text",
         carry: list[str | Column] | None = None) -> DataFrame:
    """One row per input row: its id, the columns named in ``carry``, ``text``, and ``spans``, an array of
    (start, end, kind, rule number) in order of start, then of the rules.
    """
    queries = {rule.kind: trigram_query(rule.expression) for rule in rules}
    forced = {kind: q for kind, q in queries.items() if q != ANY}
    wanted = frozenset(t for q in forced.values() for branch in q for t in branch)
    rows = docs.select(F.col(id_column), *(carry or []), whole_text(text_column).alias("__text"))
    kept = rows.columns[1:-1]
    if wanted:
        possible = candidates(postings(docs.select(F.col(id_column), F.col(text_column).alias("text")), wanted, id_column), forced, id_column)
        possible = possible.withColumnRenamed(id_column, "__id")
        rows = rows.join(possible.withColumnRenamed("rules", "__rules"), F.col(id_column).eqNullSafe(F.col("__id")), "left").drop("__id")
    else:
        rows = rows.withColumn("__rules", F.lit(None).cast("array<string>"))
    text, none = F.col("__text"), F.array().cast("array<struct<start:int,end:int,kind:string,rule:int>>")

    def of_rule(number: int, rule: Rule) -> Column:
        named = F.transform(spans(text, rule), lambda s: F.struct(s["start"], s["end"], F.lit(rule.kind).alias("kind"), F.lit(number).alias("rule")))
        if rule.kind not in forced:
            return named
        return F.when(F.array_contains("__rules", rule.kind), named).otherwise(none)

    found = F.array_sort(F.concat(*[of_rule(i, rule) for i, rule in enumerate(rules)]),
                         lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(a["rule"] - b["rule"])).cast("int"))
    return rows.select(F.col(id_column), *[F.col(f"`{c}`") for c in kept], text.alias("text"), found.alias("spans"))


def written(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mark: str = "<secret>") -> Column:
    """The text with each stretch that spans cover, overlaps united, replaced by ``mark``; a block of spans at a time."""
    no_parts = F.array().cast("array<string>")

    def of_block(state: Column, block: Column) -> Column:
        stop = F.greatest(state["at"], F.array_max(F.transform(block, lambda s: s["end"])))

        def masked(piece: Column) -> Column:
            def step(inner: Column, s: Column) -> Column:
                outside = F.array(piece.substr(inner["at"] - state["at"] + 1, s["start"] - inner["at"]), F.lit(mark))
                return F.struct(F.greatest(inner["at"], s["end"]).alias("at"),
                                F.when(s["start"] >= inner["at"], F.concat(inner["parts"], outside)).otherwise(inner["parts"]).alias("parts"))

            return F.aggregate(block, F.struct(state["at"].alias("at"), no_parts.alias("parts")), step, lambda inner: F.array_join(inner["parts"], ""))

        part = _let(text.substr(state["at"] + 1, stop - state["at"]), masked)
        return F.struct(stop.alias("at"), F.concat(state["parts"], F.array(part)).alias("parts"))

    done = F.aggregate(_blocks(found, lambda block: block), F.struct(F.lit(0).alias("at"), no_parts.alias("parts")), of_block,
                       lambda s: F.concat(F.array_join(s["parts"], ""), text.substr(s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def digests(scanned: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Per row: the id, a count per base kind, ``base_sha256`` of the base spans and all spans as text."""
    kinds = [rule.kind for rule in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    return scanned.select("doc_id", *counts, F.sha2(written(of_base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
