"""Who and what usage belongs to: accounts by markers, tasks by claims, sessions by prefixes and ancestry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAY
from ..functions.exact import share_ppm
from ..sources.staging import staged, whole
from .timeline import asof, asof_by_bins

#: The last of the five classes of account evidence (fixed values): launcher or hook, provider identity, credential mapping, inference from time, none.
NO_EVIDENCE = 5


def attribute_accounts(usage: DataFrame, markers: DataFrame) -> DataFrame:
    """usage plus account: that of the session's last marker at or before it.

    Only markers of the session's best (least) evidence rank count. Markers at
    one instant go by ordering key, null first, then by number. Before the
    first, or without any, the account is unknown.
    """
    best = markers.withColumn("best", F.min("rank").over(Window.partitionBy("session"))).where("rank = best")
    out = asof(usage, best.select("session", "ts", "account", "rank", "okey", "marker"), ["session"], "ts", ["account", "rank"], ["okey", "marker"])
    return out.withColumn("account", F.coalesce("account", F.lit("unknown-account")))


def boundaries(claims: DataFrame, by: Sequence[str] = ("session",)) -> DataFrame:
    """(by, ts, claimed array, released array): what happens at each instant of a timeline; other kinds of events are left out."""
    known = claims.where(F.col("kind").isin("claim", "release"))
    return known.groupBy(*by, "ts").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "claim", F.col("task")))).alias("claimed"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "release", F.col("task")))).alias("released"),
    )


#: What a timeline says where no claim of its own is open; only then may another one speak.
UNCOVERED = ("before_first_claim", "after_release_with_no_next_claim", "unclaimed_session")


def attribute_tasks(usage: DataFrame, claims: DataFrame, unmapped: Column | None = None, tracker: bool = True, shared: bool = False, width: int = DAY) -> DataFrame:
    """usage plus bucket: the task claimed when it happened, or why there is none.

    Releases of an instant apply before its claims. Several tasks claimed at one
    instant are contended until a later single claim; releasing doesn't end
    that. A shared timeline holds for all sessions; it is cut in bins of `width`,
    so that no task has to sort all usage.
    """
    by = [] if shared else ["session"]
    at_or_before = (lambda *a: asof_by_bins(*a, width)) if shared else asof
    marks = boundaries(claims, by)
    claimed = marks.where(F.size("claimed") > 0).select(*by, "ts", F.col("ts").alias("claim_ts"), "claimed")
    first = marks.groupBy(*by).agg(F.min("ts").alias("first_ts"))
    at = at_or_before(usage, claimed, by, "ts", ["claim_ts", "claimed"]).withColumn("task", F.when(F.size("claimed") == 1, F.element_at("claimed", 1)))
    released = claims.where(F.col("kind") == "release").select(*by, F.col("task").alias("of"), "ts", F.col("ts").alias("release_ts"))
    keyed = at.withColumn("of", F.coalesce("task", F.lit("")))
    done = at_or_before(keyed, released, [*by, "of"], "ts", ["release_ts"]).drop("of")
    joined = done.join(F.broadcast(first)) if shared else done.join(first, "session", "left")
    bucket = (
        F.when(F.lit(False) if unmapped is None else unmapped, "unmapped_session")
        .when(F.lit(not tracker) & F.col("first_ts").isNull(), "tracker_unavailable")
        .when(F.col("first_ts").isNull(), "unclaimed_session")
        .when(F.col("ts") < F.col("first_ts"), "before_first_claim")
        .when(F.col("claim_ts").isNull(), "after_release_with_no_next_claim")
        .when(F.size("claimed") >= 2, "contended")
        .when(F.col("release_ts") > F.col("claim_ts"), "after_release_with_no_next_claim")
        .otherwise(F.col("task"))
    )
    return joined.withColumn("bucket", bucket).drop("claim_ts", "claimed", "task", "release_ts", "first_ts")


def attribute_overlaid(usage: DataFrame, claims: DataFrame, width: int = DAY) -> DataFrame:
    """usage plus bucket, by two timelines: a session's own claims, and those that name no session.

    The second one speaks where the first has no claim open, and only if there
    is any; contention among a session's own claims stands. Usage without a
    session is unmapped.
    """
    own = attribute_tasks(usage, claims.where("session is not null"), F.col("session").isNull())
    names = claims.where("session is null and kind in ('claim', 'release')")
    both = attribute_tasks(own.withColumnRenamed("bucket", "own"), names, shared=True, width=width)
    exist = names.agg((F.count("*") > 0).alias("exist"))
    return both.join(F.broadcast(exist)).withColumn("bucket", F.when(F.col("own").isin(*UNCOVERED) & F.col("exist"), F.col("bucket")).otherwise(F.col("own"))).drop("own", "exist")


def straddles(windows: DataFrame, claims: DataFrame) -> DataFrame:
    """windows(session, start, end) plus ambiguous: whether an end lies beyond the next boundary after its start."""
    marks = claims.where(F.col("kind").isin("claim", "release")).select("session", F.col("ts").alias("mark")).distinct()
    both = windows.select("session", F.col("start").alias("at"), F.struct(*windows.columns).alias("w")).unionByName(marks.select("session", F.col("mark").alias("at")), allowMissingColumns=True)
    after = Window.partitionBy("session").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("w").isNull(), F.col("at"))).over(after)
    return both.withColumn("next", nxt).where("w is not null").select("w.*", F.coalesce(F.col("w.end") > F.col("next"), F.lit(False)).alias("ambiguous"))


def sessions_of_actors(actors: DataFrame, sessions: DataFrame, digits: int = 8) -> DataFrame:
    """actors(actor) plus session and state: the one session whose id starts with the actor's trailing digits, by an equi-join on that prefix."""
    prefix = sessions.select(F.lower(F.substring("native_id", 1, digits)).alias("fragment"), "native_id")
    tail = F.lower(F.regexp_extract("actor", f"([0-9a-fA-F]{{{digits}}})$", 1))
    found = prefix.groupBy("fragment").agg(F.count("*").alias("n"), F.min("native_id").alias("session"))
    joined = actors.withColumn("fragment", tail).join(found, "fragment", "left")
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return joined.select(*actors.columns, F.when(F.col("n") == 1, F.col("session")).alias("session"), state.alias("state"))


@whole
def governing_ancestor(sessions: DataFrame, marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, session, ancestor, depth): the nearest session on the way up, itself included, that has markers; null if there is none.

    by: columns beside session that name it, such as a namespace; a parent lies
    in its session's. The way up is doubled in each round, so that rounds grow
    with the logarithm of its length. No way is longer than there are sessions:
    one that still hasn't ended then goes round a cycle and finds nothing.
    """
    key = [*by, "session"]
    has = marked.select(*key).distinct().withColumn("done", F.lit(True))
    nodes = sessions.select(*key, "parent").union(marked.select(*key, F.lit(None))).groupBy(*key).agg(F.min("parent").alias("parent"))
    step = nodes.join(has, key, "left").select(*key, F.when(F.col("done"), F.col("session")).otherwise(F.col("parent")).alias("at"), F.when(F.col("done"), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("done", F.lit(False)).alias("done"))
    ways = staged(step, "ways")
    left = ways.count()
    while left and ways.where("not done and at is not null").limit(1).count():
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by] + [F.col("x.at") == F.col("y.session")]
        new = ways.alias("x").join(ways.alias("y"), on, "left")
        go = ~F.col("x.done") & F.col("x.at").isNotNull()
        ways = staged(new.select(*[f"x.{c}" for c in key], F.when(go, F.col("y.at")).otherwise(F.col("x.at")).alias("at"), (F.col("x.depth") + F.when(go, F.coalesce("y.depth", F.lit(0))).otherwise(0)).alias("depth"), (F.col("x.done") | (go & F.coalesce("y.done", F.lit(False)))).alias("done")), "ways")
        left //= 2
    return ways.join(sessions.select(*key).distinct(), key, "left_semi").select(*key, F.when(F.col("done"), F.col("at")).alias("ancestor"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def overlapping_sessions(sessions: DataFrame, width: int, bin_width: int) -> DataFrame:
    """(session, overlapping): how many other sessions (session, a, b) overlap [a, a + width] of each.

    Counted without pairs: those that start by its end, less those that end
    before its start. Running counts are taken inside bins of time and completed
    by the bins' own totals; bins are ranked in one task, their number being
    that of all time over bin_width.
    """
    none, zero = F.lit(None).cast(sessions.schema["session"].dataType), F.lit(0)
    marks = sessions.select(F.col("a").alias("at"), F.lit(1).alias("starts"), zero.alias("ends"), none.alias("session"), zero.alias("late")).union(sessions.select("b", zero, F.lit(1), none, F.lit(2)))
    asks = sessions.select((F.col("a") + width).alias("at"), zero.alias("starts"), zero.alias("ends"), "session", F.lit(1).alias("late")).union(sessions.select("a", zero, zero, "session", F.lit(-1)))
    rows = marks.union(asks).withColumn("bin", F.floor(F.col("at") / bin_width))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("bin").agg(F.sum("starts").alias("s"), F.sum("ends").alias("e")).select("bin", F.coalesce(F.sum("s").over(before), zero).alias("s"), F.coalesce(F.sum("e").over(before), zero).alias("e"))
    w = Window.partitionBy("bin").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(totals, "bin").withColumn("started", F.col("s") + F.sum("starts").over(w)).withColumn("ended", F.col("e") + F.sum("ends").over(w)).where("session is not null")
    return run.groupBy("session").agg((F.max(F.when(F.col("late") == 1, F.col("started"))) - F.max(F.when(F.col("late") == -1, F.col("ended"))) - 1).alias("overlapping"))


def attribution_quality(attributed: DataFrame, kinds: Sequence[str], evidence: str, since: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, scope, kind, class_1 ... class_5, tokens, attributed, attributed_ppm, undated): tokens of each kind by evidence class, over all history and over sessions that started at or after `since`.

    The last class (also null) is no evidence; all others are attributed. Rows
    without a start can't be placed in the recent scope: they are counted as
    undated there. All sums are taken in one aggregate, then laid out as rows.
    """
    scopes = {"all_history": F.lit(True), "recent": F.coalesce(F.col("started") >= since, F.lit(False))}
    klass = F.coalesce(F.col(evidence), F.lit(NO_EVIDENCE))
    of = lambda scope, kind, c: F.coalesce(F.sum(F.when(scopes[scope] & (klass == c), F.col(kind))), F.lit(0)).cast("bigint")
    rows = [F.struct(F.lit(s).alias("scope"), F.lit(k).alias("kind"), *[of(s, k, c).alias(f"class_{c}") for c in range(1, NO_EVIDENCE + 1)], (F.count_if(F.col("started").isNull()) if s == "recent" else F.lit(0).cast("bigint")).alias("undated")) for s in scopes for k in kinds]
    out = attributed.groupBy(*by).agg(F.array(*rows).alias("rows")).select(*by, F.inline("rows"))
    some = sum((F.col(f"class_{c}") for c in range(2, NO_EVIDENCE)), F.col("class_1"))
    out = out.withColumn("attributed", some).withColumn("tokens", F.col("attributed") + F.col(f"class_{NO_EVIDENCE}"))
    return out.withColumn("attributed_ppm", share_ppm(F.col("attributed"), F.col("tokens")))


def breaches(quality: DataFrame, floor_ppm: int) -> DataFrame:
    """Rows whose attributed part lies below the floor, by cross-multiplication; without tokens there is no part."""
    return quality.where((F.col("tokens") > 0) & (F.col("attributed").cast("decimal(38,0)") * 1_000_000 < F.lit(floor_ppm) * F.col("tokens").cast("decimal(38,0)")))


def resolve_axis(votes: DataFrame, by: Sequence[str]) -> DataFrame:
    """votes(by, value, rank, provenance): each key's value by its best rank's votes, the least provenance naming the winner; differing values at that rank are a conflict."""
    best = votes.withColumn("best", F.min("rank").over(Window.partitionBy(*by))).where("rank = best")
    return best.groupBy(*by).agg(F.min("best").alias("rank"), F.min_by("value", "provenance").alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def explicit_claim(requests: DataFrame, markers: DataFrame) -> DataFrame:
    """requests(session, ts) plus account and state: the last marker at or before it; different accounts tied on instant and ordering key conflict."""
    tied = markers.groupBy("session", "ts", "okey").agg(F.collect_set("account").alias("accounts"), F.min("account").alias("account"))
    at = asof(requests, tied, ["session"], "ts", ["accounts", "account"], ["okey"])
    state = F.when(F.col("accounts").isNull(), "none").when(F.size("accounts") > 1, "conflict").otherwise("claimed")
    return at.withColumn("state", state).withColumn("account", F.when(state == "claimed", F.col("account"))).drop("accounts")


def task_report(attributed: DataFrame) -> DataFrame:
    """(bucket, is_task, tokens, events, sessions, share_ppm): tasks and the overhead beside them; the shares are of all tokens, which both conserve."""
    out = attributed.groupBy("bucket").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("events"), F.count_distinct("session").alias("sessions"))
    total = out.agg(F.sum("tokens").cast("bigint").alias("__total"))  # one row
    return out.join(F.broadcast(total)).withColumn("is_task", F.col("bucket").startswith("task-")).withColumn("share_ppm", share_ppm(F.col("tokens"), F.col("__total"))).drop("__total")


def task_sessions(attributed: DataFrame, sessions: DataFrame) -> DataFrame:
    """(bucket, session, run, tokens, events): a task's usage by session, with the run that sessions(session, run) names."""
    out = attributed.where(F.col("bucket").startswith("task-")).groupBy("bucket", "session").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("events"))
    return out.join(sessions.select("session", "run"), "session", "left").select("bucket", "session", "run", "tokens", "events")


def overlapping_pairs(sessions: DataFrame, width: int, by: Sequence[str] = (), levels: int = 24) -> DataFrame:
    """(by, earlier, later, relation) of all pairs of sessions(by, session, a, b) that share an instant, b null while running.

    Of two the earlier starts first (of equal starts the smaller session), and
    they overlap if the later one's start lies in it: relation is contains if
    the earlier lasts at least as long, a running one for ever, else runs_into.

    Time is cut in bins of `width`; bins are joined to ever larger ones by
    twos. A session takes the two bins at its ends, where instants are compared,
    and between them few bins of all sizes, at most two of each: one that lasts
    for ever has no more rows than `levels` asks, and meets starts only that it
    holds. A start takes its bin of each size.
    """
    last = 1 << levels
    origin = sessions.agg(F.min("a")).first()[0] or 0
    a_bin = F.floor((F.col("a") - origin) / width)
    b_bin = F.coalesce(F.least(F.floor((F.col("b") - origin) / width), F.lit(last)), F.lit(last))
    key = [*by, "level", "bin"]
    spans = sessions.where("a is not null and (b is null or b >= a)").select(*by, "session", "a", "b", a_bin.alias("lo"), b_bin.alias("hi"))
    node = lambda level, at, exact: F.struct(F.lit(level).alias("level"), at.alias("bin"), F.lit(exact).alias("exact"))
    nodes = [F.when(F.col("lo") <= F.col("hi"), node(0, F.col("lo"), False)), F.when(F.col("hi") > F.col("lo"), node(0, F.col("hi"), False))]
    for k in range(levels):
        left, right = F.floor((F.col("lo") + 1 + (1 << k) - 1) / (1 << k)), F.floor(F.col("hi") / (1 << k))
        nodes += [F.when((left < right) & (left % 2 == 1), node(k, left, True)), F.when((left < right) & (right % 2 == 1), node(k, right - 1, True))]
    held = spans.select(*by, F.col("session").alias("earlier"), F.col("a").alias("ea"), F.col("b").alias("eb"), F.explode(F.filter(F.array(*nodes), lambda x: x.isNotNull())).alias("n")).select(*by, "earlier", "ea", "eb", "n.*")
    begun = spans.select(*by, F.col("session").alias("later"), F.col("a").alias("la"), F.col("b").alias("lb"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("lo") / F.pow(F.lit(2), k)).alias("bin")))).alias("n")).select(*by, "later", "la", "lb", "n.*")
    first = (F.col("ea") < F.col("la")) | ((F.col("ea") == F.col("la")) & (F.col("earlier") < F.col("later")))
    inside = F.col("exact") | F.col("eb").isNull() | (F.col("la") <= F.col("eb"))
    relation = F.when(F.col("eb").isNull() | (F.col("eb") >= F.col("lb")), "contains").otherwise("runs_into")
    return held.join(begun, key).where(first & inside).select(*by, "earlier", "later", relation.alias("relation"))


def sessions_by_prefix(prefixes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(prefix, namespace, status, matches, place, source, session, start): all sessions(source, session, start) whose ids begin with each of prefixes(prefix, namespace), whatever the case.

    A prefix is trimmed; a null namespace asks all of them. A row for each match
    in order of start, source and id; status is one, ambiguous where there are
    more, none (and one row without a match), or empty_prefix, which would match
    everything and is an error. An id is cut to the lengths that prefixes have,
    so that prefixes and ids meet by equality; lengths are as many as ids are long.
    """
    asked = prefixes.select("prefix", "namespace", F.lower(F.trim(F.coalesce("prefix", F.lit("")))).alias("p")).distinct()
    lengths = sorted(r[0] for r in asked.select(F.length("p")).distinct().collect() if r[0])
    cuts = F.array(*[F.when(F.length("session") >= n, F.lower(F.substring("session", 1, n))) for n in lengths]) if lengths else F.array().cast("array<string>")
    ids = sessions.select("source", "session", "start", F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias("p"))
    found = asked.join(ids, "p", "left").where(F.col("source").isNull() | F.col("namespace").isNull() | (F.col("namespace") == F.col("source")))
    # A prefix whose matches lie in other namespaces only has none.
    found = asked.select("prefix", "namespace", "p").join(found.where("session is not null").select(F.col("prefix").alias("fp"), F.col("namespace").alias("fn"), "source", "session", "start"), F.col("prefix").eqNullSafe(F.col("fp")) & F.col("namespace").eqNullSafe(F.col("fn")), "left")
    of = Window.partitionBy("prefix", "namespace")
    found = found.withColumn("matches", F.count("session").over(of)).withColumn("place", F.row_number().over(of.orderBy("start", "source", "session")))
    status = F.when(F.col("p") == "", "empty_prefix").when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one").otherwise("ambiguous")
    return found.select("prefix", "namespace", status.alias("status"), "matches", F.when(F.col("matches") > 0, F.col("place")).alias("place"), "source", "session", "start")
