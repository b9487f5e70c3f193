"""Secret scans by a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams of lower-cased
text. Postings (trigram, row key) are made for the trigrams that some rule asks
for; intersecting them gives each row's candidate rules, and only candidates
run the regex. A rule whose regex forces no trigram runs on every row.

All of it is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_text

parser = re._parser  # the standard library's regex parser


@dataclass(frozen=True)
class Rule:
    """regex: valid in Java and Python alike. A match counts if `group` has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The contract's kinds, in its order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: A private key from its BEGIN on: through END, if no other run of five dashes comes first; else through lines of base64 (after an encrypted key's headers; \\n may be written out). Possessive, so that no text makes the match go back or recurse.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\\[rn]|[\r\n])++[ \t]*+[A-Za-z-]++:\x20[^\r\n\\]*+){0,4}+"
    r"(?:(?:(?:\\[rn]|[\r\n])++[ \t]*+[A-Za-z0-9+/=]++[ \t]*+(?![^\r\n\\\"'])|[ \t]++[A-Za-z0-9+/=]{40,}+))*+)"
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", PEM),
)
#: A run of literals stands for at most so many strings; beyond it the run is cut.
MOST_STRINGS = 64


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Clauses that any match's lower-cased text satisfies: all clauses hold; a clause holds if all trigrams of one alternative occur.

    An empty list means that the regex forces no trigram.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    def chars(items: list) -> set[str] | None:
        out: set[str] = set()
        for op, value in items:
            if op is re._constants.LITERAL:
                out.add(chr(value).lower())
            elif op is re._constants.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None

    def strings_of(nodes) -> set[str] | None:
        """All strings that the nodes can match, or None where they aren't few."""
        run = {""}
        for op, value in nodes:
            if op is re._constants.LITERAL:
                more = {chr(value).lower()}
            elif op is re._constants.IN:
                more = chars(value)
            elif op is re._constants.SUBPATTERN:
                more = strings_of(value[-1])
            elif op is re._constants.BRANCH:
                parts = [strings_of(x) for x in value[1]]
                more = None if None in parts else set().union(*parts)
            elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and value[1] == 1:
                inner = strings_of(value[2])
                more = None if inner is None else inner | ({""} if value[0] == 0 else set())
            else:
                more = None
            if more is None or len(run) * len(more) > MOST_STRINGS:
                return None
            run = {a + b for a, b in product(run, more)}
        return run

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            more = strings_of([node])
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, more)}
                continue
            close(run)
            run = {""}
            op, value = node
            if op is re._constants.SUBPATTERN:
                walk(value[-1])
            elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and value[0] >= 1:
                walk(value[2])
        close(run)

    walk(parser.parse(regex))
    return clauses


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rk, rules array<int>): the rules with trigrams whose queries a row's postings satisfy, for rows that have any.

    rk is a key of doc_id and text. Rows that share a key share their postings'
    union, which can only add candidates.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex))}
    if not queries:
        return docs.sparkSession.createDataFrame([], "rk bigint, rules array<int>")
    grams = sorted({g for q in queries.values() for clause in q for alternative in clause for g in alternative})
    lower = F.lower(doc_text())
    postings = docs.select(F.xxhash64("doc_id", "text").alias("rk"), lower.alias("low")).select(
        "rk", F.explode(F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), n) for n, g in enumerate(grams)]), lambda x: x.isNotNull())).alias("gram")
    )
    # Intersecting: the trigrams of one row as a bit per trigram, a word of 60 bits at a time.
    words = range(0, len(grams), 60)
    bits = [F.bit_or(F.when((F.col("gram") >= w) & (F.col("gram") < w + 60), F.expr(f"shiftleft(1L, gram - {w})")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in words]

    def holds(alternative: frozenset[str]) -> Column:
        masks = {w: sum(1 << (n - w) for n, g in enumerate(grams) if g in alternative and w <= n < w + 60) for w in words}
        out = F.lit(True)
        for w, mask in masks.items():
            if mask:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == mask)
        return out

    def query(q: list) -> Column:
        out = F.lit(True)
        for clause in q:
            any_of = F.lit(False)
            for alternative in clause:
                any_of = any_of | holds(alternative)
            out = out & any_of
        return out

    hit = F.filter(F.array(*[F.when(query(q), F.lit(i)) for i, q in queries.items()]), lambda x: x.isNotNull())
    return postings.groupBy("rk").agg(*bits).select("rk", hit.alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the values op of all up to it, where op is associative: n values cost n times the logarithm of n.

    A step joins each value with the one 1, 2, 4, ... places before, so that no
    array grows item by item, which would copy it with each.
    """

    def scan(xs: Column) -> Column:
        strides = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda d: d < F.size(xs))
        return F.aggregate(strides, xs, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(acc[i - d], x)).otherwise(x)))

    return _let(values, scan)


SPAN = "struct<start:int,rule:int,kind:string,end:int>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rule, kind, end>> of a rule's matches, leftmost first, in code points."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.regex, -1)
    parts = F.zip_with(F.zip_with(whole, F.slice(gaps, 1, F.size(whole)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), held, lambda p, h: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), (F.length(h) >= rule.least).alias("ok")))
    ends = lambda ps: running(F.transform(ps, lambda p: p["gap"] + p["len"]), lambda a, b: a + b)
    placed = _let(parts, lambda ps: F.zip_with(ps, ends(ps), lambda p, end: F.struct((end - p["len"]).alias("start"), F.lit(order).alias("rule"), F.lit(rule.kind).alias("kind"), end.alias("end"), p["ok"].alias("ok"))))
    spans = F.transform(F.filter(placed, lambda s: s["ok"]), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rule", "kind", "end")]))
    return F.when(F.regexp_like(text, F.lit(rule.regex if rule.least == 1 or rule.group else f"{rule.regex[:-1]}{{{rule.least},}}" if _one_class(rule.regex) else rule.regex)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _one_class(regex: str) -> bool:
    """Whether the regex is one repeated character class, whose long runs can be looked for at once."""
    return re.fullmatch(r"\[[^\]]+\]\+", regex) is not None


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """docs plus found array<struct<start, rule, kind, end>>, sorted by start, then by the rules' order.

    Null text counts as empty. Repeated rows each keep their own result. Other
    columns pass through; one called found is replaced.
    """
    found = _with_spans(docs, rules)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "found"], "found")


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, text, found): docs' rows as structs beside their text and spans."""
    forced = {i for i, r in enumerate(rules) if trigram_query(r.regex)}
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("rk"))
    joined = keyed.join(candidates(docs, rules).hint("shuffle_hash"), "rk", "left").select("row", F.col("row")["text"].alias("text"), "rules")
    text = doc_text()
    parts = []
    for i, rule in enumerate(rules):
        found = rule_spans(text, rule, i)
        if i in forced:
            found = F.when(F.coalesce(F.array_contains("rules", i), F.lit(False)), found).otherwise(F.array().cast(f"array<{SPAN}>"))
        parts.append(found)
    return joined.select("row", "text", F.array_sort(F.concat(*parts)).alias("found"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """docs with every found span of text replaced by [SECRET]; overlapping spans are replaced as one.

    Null text stays null. The other columns are untouched, whatever their names.
    """
    found = _with_spans(docs, rules)
    # The text between spans, from its code points at four bytes each, so that a piece costs its own length wherever it lies.
    cut = lambda wide, at, n: F.decode(F.substring(wide, 4 * at + 1, n), "UTF-32")
    shown = lambda wide, ends: F.filter(F.transform("found", lambda s, i: _let(F.when(i > 0, ends[F.greatest(i - 1, F.lit(0))]).otherwise(0), lambda at: F.when(s["start"] >= at, cut(wide, at, 4 * (s["start"] - at))))), lambda p: p.isNotNull())
    join = lambda wide, ends: F.concat(F.array_join(shown(wide, ends), "[SECRET]"), F.lit("[SECRET]"), cut(wide, ends[F.size(ends) - 1], F.lit(2147483647)))
    clean = _let(F.encode("text", "UTF-32"), lambda wide: _let(running(F.transform("found", lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda ends: join(wide, ends)))
    clean = F.when(F.size("found") > 0, clean).otherwise(F.col("text"))
    return found.select("row", clean.alias("text")).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    base = F.filter("found", lambda s: s["rule"] < len(BASE_RULES))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("found", lambda s: s["rule"] == n)).cast("bigint")
    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
