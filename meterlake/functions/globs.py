"""Glob rules: whole-string * and ?, first match wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vendors that are known without a rule, by the start of the model id.
BUILT_IN = (("claude-*", "anthropic"), ("gpt-*", "openai"), ("gemini-*", "google"), ("o?-*", "openai"))


def to_like(glob: str) -> str:
    """A glob as a LIKE pattern with backslash escapes."""
    return "".join("\\" + c if c in "\\%_" else {"*": "%", "?": "_"}.get(c, c) for c in glob)


def matches(value: Column, glob: str) -> Column:
    return value.like(to_like(glob))


def resolve(value: Column, rules: Sequence[tuple[str, str]], unmapped: str | None = None) -> Column:
    """The label of the first rule whose glob matches, else unmapped."""
    out = F.lit(unmapped)
    for glob, label in reversed(rules):
        out = F.when(matches(value, glob), F.lit(label)).otherwise(out)
    return out


def account_of(model: Column, prefixes: Sequence[tuple[str, str]], rules: Sequence[tuple[str, str]]) -> Column:
    """The account that a model id names: by its prefix; else, for an id ending in -k1, -k2 or -k3, the vendor of its first rule and that slot, if the rule matches what stands before the ending too."""
    bare = F.regexp_replace(model, r"-k[123]$", "")
    slot = F.regexp_extract(model, r"-(k[123])$", 1)
    named = F.lit(None).cast("string")
    for glob, vendor in reversed(rules):
        named = F.when(matches(model, glob), F.when(matches(bare, glob), F.concat(F.lit(f"{vendor}-"), slot))).otherwise(named)
    return F.coalesce(resolve(model, prefixes), F.when((slot != "") & (bare != ""), named))


def shadowed(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(rule, earlier rule) where the earlier one, a prefix glob, matches all that the later one can."""
    out = []
    for i, (later, _) in enumerate(rules):
        for earlier, _ in rules[:i]:
            fixed = earlier.removesuffix("*")
            if earlier.endswith("*") and not set("*?") & set(fixed) and later.startswith(fixed):
                out.append((later, earlier))
                break
    return out


def shadowing(rules: DataFrame) -> DataFrame:
    """rules(position, glob) to (position, by): each rule that can never fire, and the first prefix rule before it that matches all it can match.

    Joined on the prefixes of what a glob must start with, so that no two rules meet for nothing.
    """
    head = F.regexp_extract("glob", r"^[^*?]*", 0)
    prefix = rules.where(F.regexp_like("glob", F.lit(r"^[^*?]*\*$"))).groupBy(head.alias("prefix")).agg(F.min("position").alias("by"))
    starts = rules.select("position", F.explode(F.transform(F.sequence(F.lit(0), F.length(head)), lambda n: F.substring(head, F.lit(1), n))).alias("prefix"))
    return starts.join(prefix, "prefix").where("by < position").groupBy("position").agg(F.min("by").alias("by"))
