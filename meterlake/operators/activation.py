"""What is in force by a chain of activations, each of which has to name the one that it supersedes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged, whole


@whole
def activations(events: DataFrame, scope: Sequence[str]) -> DataFrame:
    """events plus active, accepted, reason and until; events(scope, event, at, model, supersedes), `event` unique.

    An activation is accepted if nothing is active in its scope and it names
    nothing, or if it names the model that is active just before it, and isn't
    that model. What is refused changes nothing, so that a chain never forks: of
    several at one instant that might be accepted, the one with the smallest
    event is. `active` is the model in force before the event, `until` when an
    accepted one is superseded. Rows without scope, event, at or model are
    refused as incomplete; they are never active.

    An accepted event's successor is the first later one that names its model, so
    every event has a pointer by itself, and the chain of a scope is what its
    first event leads to: pointers are doubled, no task walks a chain.
    """
    whole_rows = F.lit(True)
    for c in (*scope, "event", "at", "model"):
        whole_rows = whole_rows & F.col(c).isNotNull()
    rows = staged(events.withColumn("__whole", whole_rows), "activations")
    good = rows.where("__whole")
    this = F.struct("at", "event")
    names = good.where("supersedes is not null and supersedes <> model").select(*scope, F.col("supersedes").alias("link"), "at", F.lit(None).cast(rows.schema["event"].dataType).alias("event"), this.alias("claim"))
    held = good.select(*scope, F.col("model").alias("link"), "at", "event", F.lit(None).cast(names.schema["claim"].dataType).alias("claim"))
    later = Window.partitionBy(*scope, "link").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    pointers = held.union(names).withColumn("next", F.min("claim").over(later)).where("event is not null")
    pointers = staged(pointers.select("event", F.col("next.event").alias("to"), F.col("next.at").alias("until")), "pointers")
    first = good.where("supersedes is null").groupBy(*scope).agg(F.min(this).alias("f")).select(F.col("f.event").alias("event"))
    reached, jumps, count = staged(first, "reached"), pointers.where("to is not null").select("event", "to"), 0
    while (now := reached.count()) > count:
        count = now
        reached = staged(reached.union(reached.join(jumps, "event").select("to")).distinct(), "reached")
        jumps = staged(jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.event")).select("a.event", "b.to"), "jumps")
    out = rows.join(reached.join(pointers, "event").select("event", "until", F.lit(True).alias("accepted")), "event", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    before = Window.partitionBy(*scope).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("active", F.max(F.when(F.col("accepted"), F.struct("at", "model"))).over(before)["model"])
    active, named = F.col("active"), F.col("supersedes")
    reason = (
        F.when(F.col("accepted"), None)
        .when(~F.col("__whole"), "incomplete")
        .when(active.isNull() & named.isNotNull(), "nothing_to_supersede")
        .when(active.isNotNull() & named.isNull(), "must_supersede_the_active")
        .when(active != named, "another_is_active")
        .when(F.col("model") == active, "supersedes_itself")
        .otherwise("same_instant")
    )
    return out.select(*events.columns, F.when(F.col("__whole"), active).alias("active"), "accepted", reason.alias("reason"), "until")
