"""Works and their files: who may see them, how they are listed, opened, merged and exported."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Stored, stored
from .catalogue import keyset_page

#: Sorts of a listing of works: column, whether descending. Files break ties by id.
WORK_SORTS = {
    "updated": ("submitted_at", True),
    "title": ("title", False),
    "year-desc": ("year", True),
    "year-asc": ("year", False),
    "significance": ("significance", True),
}
#: Least characters of a measured text, and least share of a language in it, that count: fixed values.
LEAST_MEASURED, LEAST_SHARE = 500, 0.01
#: States of a change request, and what may follow each.
REQUEST_STEPS = {
    "open": ("approved", "rejected", "needs_evidence"),
    "needs_evidence": ("open", "approved", "rejected"),
    "approved": ("applying", "rejected", "open"),
    "applying": ("applied", "open", "approved"),
    "applied": (),
    "rejected": (),
}


def is_public(status: Column) -> Column:
    """Works that readers see; a null status is none."""
    return F.coalesce(status == "active", F.lit(False))


def is_accepted(status: Column) -> Column:
    """Relations that readers see."""
    return F.coalesce(status == "accepted", F.lit(False))


def is_readable(is_current: Column, access_state: Column, role: str) -> Column:
    """Current revisions that a role may read: an archive admin all, others what is available."""
    return F.coalesce(is_current if role == "archive_admin" else is_current & (access_state == "available"), F.lit(False))


def may_open(access_state: Column, role: str) -> Column:
    """Row by row, whether a role may open a revision of this state."""
    states = ["available", "embargoed", "takedown"] if role == "archive_admin" else ["available"]
    return F.coalesce(access_state.isin(states), F.lit(False))


@dataclass(frozen=True)
class WorkFilters:
    """What a listing is asked for; blank and unknown values ask for nothing."""

    text: str | None = None
    category: str | None = None
    decade: int | None = None
    tag: str | None = None
    language: str | None = None
    has_text: bool | None = None
    sort: str = "updated"
    page: int = 1
    types: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, parameters: dict[str, list[str]]) -> WorkFilters:
        """From the parameters of an address: sorts are a closed list, numbers must be numbers."""
        first = lambda k: next((v.strip() for v in parameters.get(k, []) if v.strip()), None)
        number = lambda k: int(float(v)) if (v := first(k)) and re.fullmatch(r"-?\d+(\.\d+)?", v) else None
        sort, page = first("sort"), number("page")
        text = {"with": True, "without": False}.get(first("ocr") or "")
        return cls(first("q"), first("category"), number("decade"), first("tag"), first("lang"), text, sort if sort in WORK_SORTS else "updated", page if page and page > 0 else 1, tuple(v for v in parameters.get("types", []) if v))


def selected_pages(selector: str | None) -> list[int] | None:
    """``1,3-5`` as page numbers, each once, ascending; null or empty selects all (None)."""
    if not selector:
        return None
    pages: set[int] = set()
    for part in selector.split(","):
        if not (found := re.fullmatch(r"(\d+)(?:-(\d+))?", part, re.ASCII)):
            raise ValueError(f"not a selection of pages: {selector!r}")
        low, high = int(found[1]), int(found[2] or found[1])
        if high < low:
            raise ValueError(f"not a selection of pages: {selector!r}")
        pages.update(range(low, high + 1))
    return sorted(pages)


def list_works(files: DataFrame, works: DataFrame, filters: WorkFilters, links: DataFrame | None = None, tags: DataFrame | None = None, after: tuple | None = None, size: int = 50) -> DataFrame:
    """One row a work: its representative file, the work's columns and ``citation_count``.

    ``files``: file_id, work_id, role_rank, sort_order, submitted_at, has_text.
    ``works``: work_id, title, author, summary, category, type, year, significance, chars,
    shares (array of struct(lang, share)). ``tags``: work_id, tag of active links.
    ``links``: to_id of accepted citations. The file of the lowest role_rank, then
    sort_order, then id stands for its work. Pages follow the filters' sort, nulls last,
    with file_id as tie-break; ``after`` is a cursor (value, file_id).
    """
    text = (filters.text or "").lower()
    if text:
        works = works.where(reduce(or_, (F.coalesce(F.lower(F.col(c)).contains(text), F.lit(False)) for c in ("title", "author", "summary"))))
    if filters.category:
        works = works.where(F.col("category") == filters.category)
    if filters.types:
        works = works.where(F.col("type").isin(*filters.types))
    if filters.decade is not None:
        works = works.where((F.col("year") >= filters.decade) & (F.col("year") < filters.decade + 10))
    if filters.language:
        works = works.where((F.col("chars") >= LEAST_MEASURED) & F.exists("shares", lambda s: (s["lang"] == filters.language) & (s["share"] >= LEAST_SHARE)))
    if filters.tag:
        works = works.join(tags.where(F.col("tag") == filters.tag), "work_id", "left_semi")
    columns = [c for c in files.columns if c not in ("work_id", "role_rank", "sort_order", "file_id")]
    order = F.struct("role_rank", "sort_order", "file_id")
    one = files.groupBy("work_id").agg(F.min(order).alias("_o"), F.min_by(F.struct(*columns), order).alias("_f"))
    rows = works.join(one, "work_id").select(*works.columns, F.col("_o.file_id").alias("file_id"), *[F.col(f"_f.{c}").alias(c) for c in columns])
    if filters.has_text is not None:
        rows = rows.where(F.coalesce("has_text", F.lit(False)) == filters.has_text)
    column, down = WORK_SORTS[filters.sort]
    page = keyset_page(rows, [(column, down), ("file_id", False)], after, max(1, min(size, 100)))
    if links is None:
        return page
    # Citations are counted for the page's works alone.
    cited = links.select(F.col("to_id").alias("work_id")).join(page.select("work_id"), "work_id", "left_semi").groupBy("work_id").agg(F.count("*").alias("citation_count"))
    return page.join(cited, "work_id", "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))


def list_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files (work_id, file_id, sort_order, submitted_at, ...) with the first of their ``paths`` (file_id,
    path) by name, and their place in the work's listing."""
    first = paths.groupBy("file_id").agg(F.min("path").alias("path"))
    order = Window.partitionBy("work_id").orderBy("sort_order", "file_id", F.desc("submitted_at"))
    return files.join(first, "file_id", "left").withColumn("place", F.row_number().over(order))


def tag_facet(tags: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """(tag_id, works): different works with files of every tag, from active links (tag_id, work_id)."""
    held = links.join(files.select("work_id").distinct(), "work_id", "left_semi")
    return tags.join(held, "tag_id").groupBy(*tags.columns).agg(F.count_distinct("work_id").alias("works"))


def capped(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows, each with ``truncated``: whether there were more."""
    few = df.orderBy(*order).limit(most + 1)
    ranked = few.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    return ranked.withColumn("truncated", F.max("_n").over(Window.partitionBy(F.lit(1))) > most).where(F.col("_n") <= most).drop("_n")


def review_queue(requests: DataFrame, diffs: DataFrame, most: int = 100) -> DataFrame:
    """The newest requests still to be decided, with their proposal's summary if there is one."""
    waiting = requests.where(F.col("status").isin("open", "needs_evidence", "approved"))
    newest = waiting.orderBy(F.desc("created_at"), "request_id").limit(most)
    return newest.join(diffs.where("kind = 'proposal'").select("observation_id", "summary"), "observation_id", "left")


def user_kinds(users: DataFrame, roles: DataFrame, identities: DataFrame, system_ids: tuple[str, ...] = (), known_roles: tuple[str, ...] = ("archive_admin", "archive_editor", "archive_reader")) -> DataFrame:
    """Users (user_id, email) with role, login and ``kind``: system, machine (has a service token) or person."""
    value = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, F.col("value")))
    of = identities.groupBy("user_id").agg(value("github_login").alias("login"), value("service_token").alias("service_token"))
    domain = F.lower(F.substring_index("email", "@", -1))
    system = F.col("user_id").cast("string").isin(*system_ids) if system_ids else F.lit(False)
    kind = F.when(system | F.coalesce(domain.endswith(".invalid"), F.lit(False)), "system").when(F.col("service_token").isNotNull(), "machine").otherwise("person")
    role = F.when(F.col("role").isin(*known_roles), F.col("role"))
    return users.join(roles, "user_id", "left").join(of, "user_id", "left").withColumn("role", role).withColumn("kind", kind)


def page_states(counts: DataFrame, machine: DataFrame, edited: DataFrame) -> DataFrame:
    """(work_id, page, state) of every page: those a work counts, and any with text.

    ``counts``: work_id, page_count; ``machine``: work_id, page; ``edited``: work_id, page,
    approved. State is approved, edited, machine or none.
    """
    counted = counts.where("page_count > 0").select("work_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    ints = lambda df: df.withColumn("page", F.col("page").cast("int"))
    universe = counted.union(ints(machine).select("work_id", "page")).union(ints(edited).select("work_id", "page")).distinct()
    joined = universe.join(ints(machine).select("work_id", "page").distinct().withColumn("m", F.lit(True)), ["work_id", "page"], "left").join(ints(edited).groupBy("work_id", "page").agg(F.max("approved").alias("a")), ["work_id", "page"], "left")
    return joined.select("work_id", "page", F.when(F.col("a"), "approved").when(F.col("a").isNotNull(), "edited").when(F.col("m"), "machine").otherwise("none").alias("state"))


def person_works(links: DataFrame, works: DataFrame) -> DataFrame:
    """Public works of every person, each once a role: (person_id, role, work_id, year, title)."""
    return links.dropDuplicates(["person_id", "work_id", "role"]).join(works.where(is_public(F.col("status"))).select("work_id", "year", "title"), "work_id")


def request_states(events: DataFrame, stuck_after: str = "15 minutes", now: Column | None = None) -> DataFrame:
    """(request_id, status, refused): where each change request stands after its events.

    ``events``: request_id, at, event_id, status asked for. A step that may not follow
    the present state is refused and changes nothing. A request that has been applying
    for longer than ``stuck_after`` counts as approved again.
    """
    steps = F.create_map(*[x for k, v in REQUEST_STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    ordered = F.array_sort(F.collect_list(F.struct("at", "event_id", "status")))
    start = F.struct(F.lit("open").alias("status"), F.lit(None).cast(events.schema["at"].dataType).alias("since"), F.lit(0).alias("refused"))

    def step(state, event):
        fits = F.array_contains(steps[state["status"]], event["status"])
        return F.struct(F.when(fits, event["status"]).otherwise(state["status"]).alias("status"), F.when(fits, event["at"]).otherwise(state["since"]).alias("since"), (state["refused"] + (~fits).cast("int")).alias("refused"))

    # A request has as many events as people gave it, a handful.
    folded = events.groupBy("request_id").agg(ordered.alias("e")).select("request_id", F.aggregate("e", start, step).alias("s"))
    stuck = (F.col("s.status") == "applying") & (F.col("s.since") + F.expr(f"interval {stuck_after}") < (now if now is not None else F.current_timestamp()))
    return folded.select("request_id", F.when(stuck, "approved").otherwise(F.col("s.status")).alias("status"), F.col("s.refused").alias("refused"))


def lifecycle_states(sources: DataFrame, events: DataFrame) -> DataFrame:
    """(source_id, status, merged_into): the last lifecycle event of each source over its own status.

    ``events``: source_id, at, event_id, op (soft_delete, hide, restore, deprecate, merge),
    into. Nothing is ever deleted; a merge into itself is left out, and a restore ends a merge.
    """
    known = events.where(~((F.col("op") == "merge") & F.col("into").eqNullSafe(F.col("source_id"))))
    last = known.groupBy("source_id").agg(F.max_by(F.struct("op", "into"), F.struct("at", "event_id")).alias("e"))
    op = F.col("e.op")
    status = F.when(op == "soft_delete", "soft_deleted").when(op == "hide", "hidden").when(op == "restore", "active").when(op == "deprecate", "deprecated").when(op == "merge", "merged").otherwise(F.col("status"))
    return sources.join(last, "source_id", "left").select("source_id", status.alias("status"), F.when(op == "merge", F.col("e.into")).alias("merged_into"))


def enriched_hits(hits: DataFrame, files: DataFrame, folios: DataFrame) -> DataFrame:
    """Search hits (work_id, page, ...) with the work's file_id and the page's printed label."""
    one = files.groupBy("work_id").agg(F.min("file_id").alias("file_id"))
    return hits.join(one, "work_id", "left").join(folios.select("work_id", "page", "label"), ["work_id", "page"], "left")


def slug_problems(slugs: DataFrame, live: DataFrame, retired: DataFrame, stopwords: tuple[str, ...] = ("the", "and", "for", "with")) -> DataFrame:
    """(slug, problem): why a new slug may not be taken: shape, empty, taken, retired; null if it may."""
    parts = F.filter(F.split("slug", "-"), lambda p: p != "")
    named = F.when(F.element_at(parts, 1).rlike(r"^\d{4}$"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    words = F.exists(named, lambda p: p.rlike(r"^[a-z]*[a-z]{3}[a-z]*$") & ~p.isin(*stopwords))
    marked = slugs.select("slug").distinct().join(live.select("slug").distinct().withColumn("_live", F.lit(True)), "slug", "left").join(retired.select("slug").distinct().withColumn("_retired", F.lit(True)), "slug", "left")
    problem = F.when(~F.col("slug").rlike(r"^[a-z0-9][a-z0-9-]{1,59}$"), "shape").when(~words, "empty").when(F.col("_live"), "taken").when(F.col("_retired"), "retired")
    return marked.select("slug", problem.alias("problem"))


def union_by_priority(records: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Records in a total order of which each is kept unless a kept one before it shares a key.

    ``keys`` are columns; null and empty ones are no keys. Two records are neighbours if
    they share the value of a key. Each round keeps the records that come before all their
    undecided neighbours and strikes those that share a key with a kept one, until
    none is undecided; all of it is grouped minima and joins on keys, so neither a hot key nor a
    large connected group is ever in one task. A record waits as many rounds as the longest run of
    undecided neighbours, each before the next, that leads to it. Rows that agree in ``order`` are one record
    that is kept or struck as one.
    """
    store = Stored(records.sparkSession, "union")
    at = F.struct(*order)
    of = lambda k: F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.col(k).cast("string")))
    # A record without keys has no neighbours: it is kept, and its own key stands for it alone.
    pairs = records.select(at.alias("at"), F.array_compact(F.array(*[of(k) for k in keys])).alias("found")).where(F.size("found") > 0)
    open_ = store.keep(pairs.select("at", F.explode("found").alias("key")).distinct())
    struck, gone = None, Stored(records.sparkSession, "struck")
    while not open_.isEmpty():
        first = open_.groupBy("key").agg(F.min("at").alias("first"))
        ahead = open_.join(first, "key").groupBy("at").agg(F.bool_and(F.col("at") == F.col("first")).alias("kept"))
        kept = Stored(records.sparkSession, "kept")
        settled = kept.keep(ahead.where("kept").select("at"))
        taken = open_.join(settled, "at", "left_semi").select("key").distinct()
        lost = gone.keep(open_.join(taken, "key", "left_semi").select("at").distinct().join(settled, "at", "left_anti"))
        struck = lost if struck is None else struck.unionByName(lost)
        open_ = store.keep(open_.join(settled, "at", "left_anti").join(lost, "at", "left_anti"))
        store.drop()
        kept.drop(0)
    if struck is None:
        return records
    whole = stored(struck, "lost")
    gone.drop(0)
    return records.withColumn("_at", at).join(whole.withColumnRenamed("at", "_at"), "_at", "left_anti").drop("_at")
