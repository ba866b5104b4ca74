"""Observations, ranked claims and their winners, gates, drift, quotas and pairing."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Precedence of how a claim came about: fixed values.
BANDS = {
    "editorial_decision": 900,
    "curated_assertion": 800,
    "observed": 700,
    "transcribed": 680,
    "extracted": 600,
    "normalized": 500,
    "llm_extraction": 400,
    "inferred": 300,
    "heuristic": 100,
}
WEAKEST, EDITORIAL = 100, BANDS["editorial_decision"]
#: Same-band claims nearer than this in score neither win nor yield.
WINDOW = 10
#: Derivations that need evidence and never apply by themselves: fixed values.
LOW_TRUST = ("llm_extraction", "inferred", "heuristic")
#: Identity decisions that name one source for certain: fixed values.
STRONG_ATTACH = ("explicit_target", "strong_single", "repo_path_exact", "repo_path_rename_rebind")
#: Least confidence of an edit, and of a trusted harvest, that applies by itself.
SURE_EDIT, SURE_HARVEST = 0.99, 0.7
#: Origins that editors work through.
EDITORIAL_ORIGINS = ("website", "manual")


def band(derivation: Column) -> Column:
    """The band of a derivation; an unknown one is of the weakest."""
    return F.coalesce(*[F.when(derivation == name, F.lit(value)) for name, value in BANDS.items()], F.lit(WEAKEST))


def rank_score(weight: Column, confidence: Column, evidence: Column) -> Column:
    """Weight, confidence in hundredths (held within 0 to 1) and up to five pieces of evidence."""
    sure = F.when(F.isnan(confidence.cast("double")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.cast("double"), F.lit(0.0)))))
    return (weight * 100 + F.floor(sure * 100 + 0.5) + F.least(F.lit(25), 5 * F.greatest(F.lit(0), F.coalesce(evidence, F.lit(0))))).cast("int")


def _folded(claims: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, start, step, finish) -> DataFrame:
    """One row for each key: a fold over its claims in order, with a state of one claim.

    Rows of a key are sorted in one place and pass by one after the other, so a key of
    any size needs memory for its state alone.
    """

    def run(batches):
        key = state = None
        for batch in batches:
            out = []
            values = [c.to_pylist() for c in batch.select([*keys, *columns]).columns]
            for row in zip(*values, strict=True):
                own = row[: len(keys)]
                if own != key:
                    if key is not None:
                        out.append((*key, *finish(state)))
                    key, state = own, start()
                state = step(state, row[len(keys) :])
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([(*key, *finish(state))])

    kinds = to_arrow_schema(_parsed(claims, keys, schema))

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = claims.select(*dict.fromkeys([*keys, *order, *columns])).repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, _parsed(claims, keys, schema))


def _parsed(claims: DataFrame, keys: list[str], schema: str) -> StructType:
    return StructType([claims.schema[k] for k in keys] + list(StructType.fromDDL(schema)))


def _ranks(state, b: int, s: int) -> str:
    """How a claim of band b and score s stands to the winner: wins, yields or clashes."""
    _, band_held, score_held, *_ = state
    if b != band_held:
        return "wins" if b > band_held else "yields"
    return "clashes" if abs(s - score_held) <= WINDOW else "wins" if s > score_held else "yields"


def field_winners(claims: DataFrame, keys: list[str], value: str = "value", arrival: list[str] = ("ts", "event_id")) -> DataFrame:
    """(keys, winner, band, score, claims, conflicts): claims folded in order of arrival.

    A higher band wins; in one band a score higher by more than WINDOW wins, one lower
    by more than that yields, and anything between is a conflict that changes nothing.
    Equal values only confirm. The rule depends on arrival, so claims pass in order.
    """

    def step(state, claim):
        v, b, s = claim
        held, band_held, score_held, seen, conflicts = state
        if not seen:
            return v, b, s, 1, 0
        stands = "equal" if v == held else _ranks(state, b, s)
        if stands == "wins":
            held, band_held, score_held = v, b, s
        return held, band_held, score_held, seen + 1, conflicts + (stands == "clashes")

    schema = f"winner {claims.schema[value].dataType.simpleString()}, band int, score int, claims int, conflicts int"
    return _folded(claims, keys, list(arrival), [value, "band", "score"], schema, lambda: (None, 0, 0, 0, 0), step, lambda s: s)


def set_members(claims: DataFrame, keys: list[str], arrival: list[str] = ("ts", "event_id")) -> DataFrame:
    """(keys, members): set-valued claims (members, band) in order of arrival.

    An editorial claim replaces the set, so what it leaves out is gone; any other only
    adds. Only claims since the last editorial one count, so this is two aggregates
    and no fold.
    """
    at = F.struct(*arrival)
    last = claims.where(F.col("band") == EDITORIAL).groupBy(*keys).agg(F.max(at).alias("_last"))
    counted = claims.join(last, keys, "left").where(F.col("_last").isNull() | (at >= F.col("_last")))
    return counted.select(*keys, F.explode_outer("members").alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_set("m")).alias("members"))


def field_outcomes(claims: DataFrame, keys: list[str], enums: dict[str, tuple[str, ...]], field: str = "field", arrival: list[str] = ("ts", "event_id")) -> DataFrame:
    """The claims (keys, field, value, op), each with an ``outcome``, in order of arrival.

    ``op`` is set or delete (null: set). Values outside the list of a controlled field (``enums``) are
    ``invalid_enum``. A blank or null value is ``empty_overwrite`` where the field holds a value by
    then, else ``none``: there is nothing to change. All other claims are ``admitted``, and an
    admitted delete empties the field. A field holds a value if its last admitted claim sets one, so
    this is one running window over a key's rows and no fold.
    """
    text = F.trim(F.coalesce(F.col("value").cast("string"), F.lit("")))
    deletes = F.coalesce(F.col("op") == "delete", F.lit(False))
    listed = [F.when((F.col(field) == name) & ~F.col("value").isin(*values), True) for name, values in enums.items()]
    outside = F.coalesce(*listed, F.lit(False)) & (text != "") & ~deletes
    changes = F.when(deletes, False).when((text != "") & ~outside, True)
    before = Window.partitionBy(*keys, field).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(changes, ignorenulls=True).over(before), F.lit(False))
    outcome = F.when(deletes, "admitted").when(outside, "invalid_enum").when(text != "", "admitted").when(held, "empty_overwrite").otherwise("none")
    return claims.withColumn("outcome", outcome)


def appended_notes(claims: DataFrame, keys: list[str], value: str = "value", arrival: list[str] = ("ts", "event_id")) -> DataFrame:
    """(keys, note, band, score): a higher rank replaces the note, any other text is added below it.

    Text that the note already holds changes nothing, and what is added never lowers
    the rank that a later note must beat.
    """

    def step(state, claim):
        note, b, s = claim
        held, band_held, score_held, seen = state
        note = note or ""
        if not seen:
            return note, b, s, True
        if note in held:
            return state
        return (note, b, s, True) if _ranks(state, b, s) == "wins" else (f"{held}\n\n{note}", band_held, score_held, True)

    return _folded(claims, keys, list(arrival), [value, "band", "score"], "note string, band int, score int", lambda: ("", 0, 0, False), step, lambda s: s[:3])


def audit_findings(origin: Column, derivation: Column, confidence: Column, evidence: Column, identifiers_valid: Column) -> Column:
    """Reasons why an observation is refused as a whole; an empty array lets it pass."""
    sure = confidence.cast("double")
    return F.array_compact(
        F.array(
            F.when(sure.isNull() | F.isnan(sure) | ~sure.between(0, 1), "confidence_out_of_range"),
            F.when(~identifiers_valid, "malformed_identifier"),
            F.when(derivation.isin(*LOW_TRUST) & (F.coalesce(evidence, F.lit(0)) <= 0), F.concat(F.lit("evidence_required_for_derivation:"), derivation)),
            F.when((derivation == "editorial_decision") & ~F.coalesce(origin.isin(*EDITORIAL_ORIGINS), F.lit(False)), F.concat(F.lit("editorial_decision_forbidden_for_origin:"), origin)),
        )
    )


def change_gate(findings: Column, presence: Column, lifecycle: Column, action: Column, decision: Column, conflict: Column, derivation: Column, origin: Column, confidence: Column) -> Column:
    """struct(mode, reason, kind): what happens to an observation, by ordered rules."""
    attached, strong = action == "attach", F.coalesce(decision.isin(*STRONG_ATTACH), F.lit(False))
    editorial = (derivation == "editorial_decision") & F.coalesce(origin.isin(*EDITORIAL_ORIGINS), F.lit(False))
    trusted = derivation.isin(*(x for x in BANDS if x not in LOW_TRUST))
    out = lambda mode, reason, kind: F.struct(F.lit(mode).alias("mode"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"))
    return (
        F.when(F.size(findings) > 0, out("reject", F.array_join(findings, ";"), "field_update"))
        .when((presence == "missing") & attached, out("auto_apply", "drift", "drift"))
        .when(presence == "missing", out("reject", "missing_unknown", "drift"))
        .when(lifecycle & attached & editorial, out("auto_apply", "editorial_lifecycle", "lifecycle"))
        .when(lifecycle, out("propose", "lifecycle_review", "lifecycle"))
        .when(~attached, out("propose", F.concat(F.lit("new_or_unresolved:"), decision), F.when(action == "conflict", "identity_conflict").otherwise("new_source")))
        .when(conflict, out("propose", "conflict", "identity_conflict"))
        .when(derivation.isin(*LOW_TRUST), out("propose", F.concat(F.lit("low_trust:"), derivation), "enrichment"))
        .when(editorial & strong & (confidence >= SURE_EDIT), out("auto_apply", "editorial_edit", "field_update"))
        .when(strong & trusted & (confidence >= SURE_HARVEST), out("auto_apply", "strong_match_harvest", "field_update"))
        .otherwise(out("propose", F.concat(F.lit("review:"), derivation, F.lit(":"), decision), "enrichment"))
    )


def match_hash(fields: dict[str, Column], defaults: dict[str, str]) -> Column:
    """SHA-256 of the fields that are not empty, by name, as JSON; what is left out has its default."""
    filled = {k: F.coalesce(F.when(F.trim(c) != "", c), F.lit(defaults[k])) if k in defaults else F.when(F.trim(c) != "", c) for k, c in fields.items()}
    return F.sha2(F.to_json(F.struct(*[filled[k].alias(k) for k in sorted(filled)])), 256)


def projected(winners: DataFrame, key: str, fields: list[str], before: DataFrame | None = None) -> DataFrame:
    """(key, fields..., changed): winning values (key, field, winner) as one row a record.

    ``changed`` says whether any field differs from the row in ``before``; a record that
    is new has changed.
    """
    rows = winners.groupBy(key).pivot("field", fields).agg(F.first("winner"))
    if before is None:
        return rows.withColumn("changed", F.lit(True))
    old = before.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_old"))
    joined = rows.join(old, key, "left")
    return joined.withColumn("changed", ~F.col("_old").eqNullSafe(F.struct(*[F.col(f).alias(f) for f in fields]))).drop("_old")


def attached_identifiers(claims: DataFrame) -> DataFrame:
    """(ident, source_id, outcome): identifier claims (obs_id, ident, source_id) in order of obs_id.

    The first source that claims an identifier has it; a later claim of another source
    is a conflict, one of the same source changes nothing.
    """
    owner = claims.groupBy("ident").agg(F.min_by("source_id", F.struct("obs_id", "source_id")).alias("owner"), F.min(F.struct("obs_id", "source_id")).alias("first"))
    joined = claims.join(owner, "ident")
    outcome = F.when(F.col("source_id") != F.col("owner"), "conflict").when(F.struct("obs_id", "source_id") == F.col("first"), "attached").otherwise("noop")
    return joined.select("obs_id", "ident", "source_id", outcome.alias("outcome"))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each idempotency key: the first by ``order``, found by a combined minimum."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("b"), F.count("*").alias("seen"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*order, *rest)], "seen")


def record_changes(ledger: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, last_value, observations, changes) per record from an ordered ledger."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    moved = ledger.select(key, value, *order).withColumns({"_n": number, "_moved": (number > 1) & ~before.eqNullSafe(F.col(value))})
    return moved.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("last_value"), F.count("*").alias("observations"), F.count(F.when(F.col("_moved"), 1)).alias("changes"))


def daily_quota(usage: DataFrame, user: str, at: str, units: Column, limit: int) -> DataFrame:
    """(user, day, used, over): units of each user and UTC day beside a limit."""
    return usage.groupBy(user, F.to_date(at).alias("day")).agg(F.sum(units).alias("used")).withColumn("over", F.col("used") > limit)


def nearest_pairs(left: DataFrame, right: DataFrame, key: str, tolerance_ms: int) -> DataFrame:
    """(key, left_id, right_id, gap): every left row in turn takes the nearest free right row.

    Both have key, id and t (milliseconds). The latest left row comes first, as a history
    is read; of equally near right rows the latest is taken; a right row goes to one left
    row. Right rows that none took have a null left_id and gap, left rows without one a
    null right_id. Rows more than the tolerance apart cannot compete, so times are cut
    into islands wherever such a gap is, and each island is paired by itself: a key of
    any number of rows is many islands.
    """
    wide = F.lit(int(tolerance_ms))
    rows = left.select(key, "id", "t", F.lit(0).alias("side")).unionByName(right.select(key, "id", "t", F.lit(1).alias("side"))).where(F.col("t").isNotNull())
    by_time = Window.partitionBy(key).orderBy("t", "side", "id")
    opens = F.coalesce(F.col("t") - F.lag("t").over(by_time) > wide, F.lit(True))
    islands = rows.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))

    def choose(own: list[tuple]) -> list[tuple]:
        """Pairs of an island's rows (t, id, side), which are in order of time."""
        rights = [(t, i) for t, i, side in own if side == 1]
        times, ids, found = [t for t, _ in rights], [i for _, i in rights], []
        for t, left_id in sorted(((t, i) for t, i, side in own if side == 0), key=lambda x: (-x[0], x[1])):
            later = bisect_left(times, t)
            near = [(times[later] - t, 0, later)] if later < len(times) else []
            if later:
                near.append((t - times[later - 1], 1, bisect_left(times, times[later - 1])))
            gap, _, at = min(near, default=(tolerance_ms + 1, 0, 0))
            if gap <= tolerance_ms:
                found.append((left_id, ids.pop(at), gap))
                times.pop(at)
            else:
                found.append((left_id, None, None))
        return found + [(None, i, None) for i in ids]

    def run(batches):
        place, own = None, []
        for batch in batches:
            out = []
            for k, island, t, i, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, island) != place:
                    out += [(place[0], *x) for x in choose(own)] if own else []
                    place, own = (k, island), []
                own.append((t, i, side))
            yield _rows(out)
        if own:
            yield _rows([(place[0], *x) for x in choose(own)])

    schema = StructType([rows.schema[key], *StructType.fromDDL("left_id long, right_id long, gap long")])
    kinds = to_arrow_schema(schema)

    def _rows(found):
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = islands.select(key, "island", "t", "id", "side").repartition(parts, key, "island").sortWithinPartitions(key, "island", "t", "id")
    return dealt.mapInArrow(run, schema)
