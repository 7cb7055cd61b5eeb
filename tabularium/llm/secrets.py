"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived: every text that the expression matches holds
all trigrams of at least one clause. The index of these trigrams is dealt by documents: each row holds its own place in
every trigram's list, so that lists are intersected without moving a posting or a text. Only documents that are
candidates of a rule are verified with its expression. A rule whose expression has no mandatory trigram scans every text.

Spans come from splitting at the matches: the lengths of gaps and matches, summed up, are code-point positions.

Defined cases: a null text is empty; a long text is scanned whole, in time that grows with its length and its matches (they
are placed in blocks of ``BLOCK``); matches of one rule don't overlap, those of several rules may, and are ordered by
start, rule and end; a null or repeated key is scanned row by row; keys may be of any type; an empty table gives no rows; columns other than key and text are ignored, whatever
they are called.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted


@dataclass(frozen=True)
class Rule:
    """``least`` characters of group ``group`` are needed; matches with fewer are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further well-known forms of credentials.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + FURTHER
#: Strings that an expression's part may spell out, and clauses of a query, before they are loosened to fewer trigrams.
MOST_STRINGS, MOST_CLAUSES = 64, 64
#: Matches of a text that are placed in one go: an array that grows match by match is copied each time.
BLOCK = 256


# --- from regular expressions to trigram queries -------------------------------------------------------------------

Query = frozenset  # of clauses; a clause is a frozenset of trigrams; one empty clause: anything may match
ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    if a == ANY or b == ANY:
        return b if a == ANY else a
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= MOST_CLAUSES else min(a, b, key=len)  # either one is implied


def _or(a: Query, b: Query) -> Query:
    both = a | b
    least = frozenset(x for x in both if not any(y < x for y in both))
    return least if len(least) <= MOST_CLAUSES else ANY


def _trigrams(strings: set[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        out = _or(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out or ANY


def _walk(items) -> tuple[set[str] | None, Query]:
    """What a sequence spells: all of its strings (None if they are too many), and a query that its matches satisfy."""
    exact: set[str] = {""}
    whole, query = True, ANY

    def flush():
        nonlocal exact, query
        query, exact = _and(query, _trigrams(exact)), {""}

    for op, arg in items:
        strings, inner = None, ANY
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            chars = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            strings = chars if chars and len(chars) <= 8 else None
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            strings, inner = set(), frozenset()
            for branch in arg[1]:
                s, q = _walk(branch)
                strings = None if s is None or strings is None else strings | s
                inner = _or(inner, q if s is None else _trigrams(s))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            s, q = _walk(body)
            if high == 1 and s is not None:
                strings = s | {""} if low == 0 else s
            elif low and s is not None and len(s) == 1 and low <= 8:
                strings, inner = ({x * low for x in s}, ANY) if low == high else (None, _trigrams({x * low for x in s}))
            elif low:
                inner = q
        elif op is sre.AT:
            continue
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            flush()
            query, whole = _and(query, inner if strings is None else _trigrams(strings)), False
    if not whole:
        flush()
        return None, query
    return exact, _trigrams(exact)


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-case trigrams, one of which every match of ``pattern`` holds in full; ``ANY`` if none is mandatory."""
    return _walk(sre_parse.parse(pattern))[1]


# --- the scan ------------------------------------------------------------------------------------------------------


def _row_spans(text: Column, number: int, rule: Rule) -> Column:
    """The matches of a rule in one text as an array of (start, kind's number, end)."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("end", T.LongType())]))
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x).cast("long"))
    sizes = F.transform(F.regexp_extract_all(text, pattern, 0), lambda x: F.char_length(x).cast("long"))
    checked = F.transform(F.regexp_extract_all(text, pattern, rule.group), lambda x: F.char_length(x)) if rule.least else F.transform(sizes, lambda x: F.lit(0))
    zero = F.lit(0).cast("long")
    start = lambda at: F.struct(at.alias("at"), F.array().cast(kind).alias("found"))

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        end = begin + m["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(number).alias("n"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["checked"] >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def in_blocks(matches):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda b: F.slice(matches, b * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.transform(F.array(blocks), placed))

    def placed(blocks):
        lengths = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, m: acc + m["gap"] + m["size"]))
        offsets = F.aggregate(lengths, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), lambda b, at: F.aggregate(b, start(at), step, lambda acc: acc["found"])))

    matches = F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(sizes), F.lit(0))).alias("gap"), sizes.alias("size"), checked.alias("checked"))
    few = F.transform(F.array(matches), lambda m: F.when(F.size(m) <= BLOCK, F.aggregate(m, start(zero), step, lambda acc: acc["found"])).otherwise(in_blocks(m)))
    return F.when(text.rlike(rule.pattern), F.get(few, F.lit(0))).otherwise(F.array().cast(kind))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, rules) of every row: the numbers of the rules whose trigram query its postings satisfy, as bits of a long.

    A row's postings tell of each trigram asked for whether its text is in that trigram's list. They are intersected where
    they are, a clause's trigrams by and, a rule's clauses by or.
    """
    queries = [sorted(map(sorted, trigram_query(r.pattern))) for r in rules]
    number = {g: i for i, g in enumerate(sorted({g for q in queries for clause in q for g in clause}))}
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(quoted(key).alias("doc_id"), whole.alias("text"), F.lower(whole).alias("lower"))
    rows = rows.select("doc_id", "text", F.array(*[F.contains("lower", F.lit(g)) for g in number], F.lit(True)).alias("held"))

    def met(query: list[list[str]]) -> Column:
        clauses = [reduce(Column.__and__, [F.get("held", F.lit(number[g])) for g in clause], F.lit(True)) for clause in query]
        return reduce(Column.__or__, clauses)

    bits = [F.when(met(q), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, q in enumerate(queries)]
    return rows.select("doc_id", "text", reduce(Column.bitwiseOR, bits).alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key, the number of spans of each base rule (``n_<kind>``), a sha256 of the base spans, and all spans."""
    rows = candidates(docs, rules, key, text)
    spans = []
    for i, r in enumerate(rules):
        asked = F.col("rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        spans.append(F.when(asked, _row_spans(F.col("text"), i, r)).otherwise(F.array().cast("array<struct<start:bigint,n:int,end:bigint>>")))
    rows = rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))

    def written(array: Column) -> Column:
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(kinds, s["n"]), s["start"], s["end"])), ",")

    def of_kind(number: int):
        return lambda s: s["n"] == number

    return rows.select(
        "doc_id",
        *[F.size(F.filter("spans", of_kind(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])],
        F.sha2(written(F.filter("spans", lambda s: s["n"] < base)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _sql_spans(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    checked = f"[length(x) for x in regexp_extract_all(text, '{pattern}', {rule.group})]" if rule.least else f"[0 for x in regexp_extract_all(text, '{pattern}')]"
    return f"""select rid, {number} as n, '{rule.kind}' as kind, s as start, s + size as "end" from (
      select rid, i, checked, size, sum(gap) over (partition by rid order by i) + coalesce(sum(size) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as s from (
        select rid, unnest(generate_series(1, len(sizes))) as i, unnest(gaps[1:len(sizes)]) as gap, unnest(sizes) as size, unnest(checked) as checked from (
          select rid, [length(x) for x in string_split_regex(text, '{pattern}')] as gaps, [length(x) for x in regexp_extract_all(text, '{pattern}')] as sizes, {checked} as checked from t where regexp_matches(text, '{pattern}'))))
    where checked >= {rule.least}"""


ORACLE_SQL = (
    "with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents), found as ("
    + "\nunion all ".join(_sql_spans(i, r) for i, r in enumerate(RULES))
    + f"""), by_row as (select rid, count(*) filter (n = 0) as n_assign, count(*) filter (n = 1) as n_access, count(*) filter (n = 2) as n_hex,
    string_agg(kind || ':' || start::bigint || ':' || "end"::bigint, ',' order by start, n, "end") filter (n < {len(BASE)}) as base, string_agg(kind || ':' || start::bigint || ':' || "end"::bigint, ',' order by start, n, "end") as spans from found group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join by_row using (rid)"""
)
