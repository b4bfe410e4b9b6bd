"""Findings into correction actions, and actions into a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import replies as R
from lectern.functions import severity as S
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.durable import first_by
from lectern.operators.hierarchy import Unfold, beside, every_level, locate, set_fields, settable_by_level
from lectern.operators.unnest import unnest_structs
from lectern.operators.validation import RULES


def action_type(severity: ColumnLike) -> Column:
    severity = col(severity)
    return F.when(severity == "minor", "auto_fix").when(severity.isin("major", "critical"), "regenerate").otherwise("skip")


def auto_fix(rule_name: ColumnLike, field_path: ColumnLike, fix: ColumnLike) -> Column:
    """``map<field, value>`` when the issue carries a usable fix, else an empty map."""
    usable = (
        ~col(rule_name).isin(list(lex.NEVER_AUTO_FIXED))
        & (F.coalesce(col(field_path), F.lit("")) != "") & (F.coalesce(col(fix), F.lit("")) != "")
    )
    return F.when(usable, F.create_map(col(field_path), col(fix))).otherwise(F.create_map().cast("map<string,string>"))


def regenerate_text() -> Column:
    """Request text for an issue row (``entity_type, entity_id, entity_path, ...``)."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Regenerate "), F.col("entity_type"), F.lit(" "), F.col("entity_id")),
        F.concat(F.lit("Path: "), F.array_join("entity_path", " > ")),
        line("Rule: ", F.col("rule_name")),
        line("Severity: ", F.upper("severity")),
        line("Description: ", F.col("description")),
        line("Field: ", F.col("field_path")),
        line("Suggested fix: ", F.col("suggested_fix")),
        line("Source evidence: ", F.col("source_evidence")),
    )


def to_actions(found: DataFrame, auto_fix_minor: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """One action per issue row. Ids are digests of course keys, path and rule, so they are unique
    over all courses and a rerun gives the same ids."""
    fix = auto_fix("rule_name", "field_path", "suggested_fix")
    minor = (F.col("severity") == "minor") & F.lit(auto_fix_minor)
    fixable = minor & (F.size(fix) > 0)
    kind = F.when(F.col("severity") == "critical", "manual_review").when(fixable, "auto_fix").otherwise("regenerate")
    if "source_evidence" not in found.columns:
        found = found.withColumn("source_evidence", F.lit(None).cast("string"))
    rows = found.filter(F.col("severity") != "passed")
    extra = [c for c in rows.columns if c not in (
        "severity", "rule_name", "description", "field_path", "suggested_fix", "source_evidence", "entity_type", "entity_id", "entity_path",
    )]
    course = [F.col(k).cast("string") for k in keys]
    key = F.md5(F.concat_ws("\x1f", *course, F.col("entity_type"), F.array_join("entity_path", "\x1f"), F.col("rule_name")))
    return rows.select(
        *extra, F.concat(F.lit("action_"), key).alias("action_id"),
        "entity_type", "entity_id", "entity_path", "rule_name", kind.alias("action_type"),
        F.when(fixable, fix).otherwise(F.create_map().cast("map<string,string>")).alias("field_corrections"),
        F.when(~fixable, regenerate_text()).alias("regenerate_prompt"),
        S.priority("severity").alias("priority"),
        F.lit("pending").alias("status"),
    )


def _hashed(df: DataFrame, keys: Sequence[str], name: str = "_hash") -> DataFrame:
    """A hash of the keys, to stand before them: ids and paths begin alike, so sorting compares them to the end."""
    return df.withColumn(name, F.xxhash64(*keys))


def queue_actions(
    results: DataFrame, keys: Sequence[str] = ("course_id",), order: str = "result_pos",
    by_entity_id: bool = False, auto_fix_minor: bool = True,
) -> DataFrame:
    """The rows of :func:`build_queue` in no order, for joins that need none."""
    # not as a filter: pushed below the rules, it would judge every entity twice
    found = F.when(F.col("overall_status") != "passed", F.col("issues"))
    long = unnest_structs(
        results, found,
        [*keys, order, "entity_type", "entity_id", "entity_path"], "issue_pos",
    ).filter(F.col("severity") != "passed")
    entity = ["entity_id"] if by_entity_id else ["entity_type", "entity_path"]
    same = [*keys, *entity, "rule_name"]
    once = first_by(["_hash", *same], F.struct(order, "issue_pos"), _hashed(long, same)).drop("_hash")
    return to_actions(once, auto_fix_minor, keys)


def build_queue(
    results: DataFrame, keys: Sequence[str] = ("course_id",), order: str = "result_pos",
    by_entity_id: bool = False, auto_fix_minor: bool = True,
) -> DataFrame:
    """Actions of all non-passed results, one per entity and rule, most urgent first.

    Entities are told apart by path; ``by_entity_id`` uses the bare id, which lets same-named
    items of other capsules hide each other. ``order`` is the result's position.
    """
    return queue_actions(results, keys, order, by_entity_id, auto_fix_minor).orderBy(F.desc("priority"), *keys, order, "issue_pos")


def critical_item_rules(fields) -> Column:
    """All critical item rules hold: what a regenerated item must pass."""
    ok = F.lit(True)
    for rule in RULES:
        if rule.entity_type == "item" and rule.severity == "critical":
            ok = ok & rule.passes(fields)
    return ok


REPLY = "stem string, options array<string>, correct_index int, explanation string"


def apply_queue(
    items: DataFrame, actions: DataFrame, replies: DataFrame | None,
    keys: Sequence[str] = ("course_id",), fields: Sequence[str] = ("content", "explanation", "title", "learning_target", "difficulty"),
    max_attempts: int = 2, overwrite_on_failure: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Apply pending actions to item rows; returns the new items and the actions' outcome.

    ``items(keys, entity_path, content, options, correct_answer_index, explanation, ...)``,
    ``replies(action_id, attempt, reply)``. The first attempt whose result passes the critical
    item rules is taken. ``overwrite_on_failure`` keeps the last failed reply in the item.

    An entity has a handful of actions (its rules), an action at most ``max_attempts`` replies: they are
    packed on one row that meets the item once, and everything is decided there. One shuffle by action
    and one by entity, none for the decisions; each reply is read once. Replies may carry the course
    keys: where all tables are dealt by these, nothing is moved. Replies that lie with their action
    already come as its ``tries array<struct<attempt, reply>>``, with no table of replies.
    """
    on = [*keys, "entity_path"]
    pending = actions.filter(F.col("status") == "pending").select(
        *on, "action_id", "entity_type", "action_type", "priority", "field_corrections", *[c for c in actions.columns if c == "tries" and replies is None]
    )
    with_replies = replies is not None or "tries" in pending.columns
    if replies is not None:
        asked = F.col("action_type") == "regenerate"
        by = [*(keys if set(keys) <= set(replies.columns) else ()), "action_id"]
        rest = [c for c in pending.columns if c not in by]
        met = beside(
            replies.filter(F.col("attempt") <= max_attempts), pending.filter(asked), by, F.collect_list("_l").alias("tries"), F.collect_list("_r").alias("_r"),
            left_value=F.struct("attempt", "reply"), right=F.struct(*rest))
        pending = met.select(*by, "tries", F.explode("_r").alias("_r")).select(*by, "_r.*", "tries").unionByName(pending.filter(~asked), allowMissingColumns=True)
    own = [c for c in items.columns if c not in on]
    met = beside(
        items, pending, on, F.collect_list("_l").alias("_l"), F.collect_list("_r").alias("_acts"),
        left_value=F.struct(*own), right=F.struct(*[c for c in pending.columns if c not in on]))
    both = met.select(*on, F.when(F.size("_acts") > 0, F.col("_acts")).alias("_acts"), F.posexplode_outer("_l").alias("_item", "_l")).select(
        *on, "_l.*", F.col("_item").isNotNull().alias("_item"), "_acts")
    judged = _judged(both, fields, overwrite_on_failure, with_replies)
    # --- the new items
    changed = ["content", "options", "correct_answer_index", "explanation"]
    new_items = judged.filter("_item").select(*[
        (F.coalesce(F.col("_taken")[c], F.col(f"_now_{c}")) if c in changed else F.col(f"_now_{c}")).alias(c)
        if c in (*fields, *changed) else F.col(c) for c in items.columns
    ])
    # --- outcome per action
    rows = unnest_structs(judged, "_done", list(keys) + ["entity_path"])
    kind, is_item, ok = F.col("action_type"), F.col("entity_type") == "item", F.col("ok")
    no_engine = F.lit(not with_replies)
    fix_error = F.when(~ok, F.lit("entity or field not found"))
    status = F.when(kind == "manual_review", "skipped").when((kind == "regenerate") & (no_engine | ~is_item), "skipped").when(ok, "applied").otherwise("failed")
    new_error = F.when(no_engine, F.lit("no replies")).when(is_item & ~F.col("found"), F.lit("entity not found")).when(
        is_item & ~ok, F.lit(f"no valid reply in {max_attempts} attempts"))
    error = F.when(kind == "manual_review", F.lit("Manual review required")).when(kind == "regenerate", new_error).otherwise(fix_error)
    outcome = rows.filter(kind.isin("auto_fix", "regenerate", "manual_review")).select(
        *keys, "action_id", "entity_type", "entity_path", "action_type", "priority", status.alias("status"), error.alias("error"))
    return new_items, outcome


def _judged(both: DataFrame, fields: Sequence[str], overwrite_on_failure: bool, with_replies: bool) -> DataFrame:
    """Rows of items and their packed actions with ``_now_<field>`` (after field corrections), ``_taken``
    (the reply to take, null if none) and ``_done`` (the actions, each with ``found`` and ``ok``)."""
    changed = ["content", "options", "correct_answer_index", "explanation"]
    found = lambda a: F.col("_item") & (a["entity_type"] == "item")
    fits = lambda a: found(a) & F.forall(F.map_keys(a["field_corrections"]), lambda k: k.isin(list(fields)))
    fixes = F.filter("_acts", lambda a: (a["action_type"] == "auto_fix") & fits(a))
    out = both.withColumn("_fixes", F.coalesce(fixes, F.slice("_acts", 1, 0)))

    def now(field: str) -> Column:
        """Of several values the action of least priority comes last."""
        values = F.transform(
            F.filter("_fixes", lambda a: F.map_contains_key(a["field_corrections"], field)),
            lambda a: F.struct((-a["priority"]).alias("last"), a["action_id"].alias("id"), F.try_element_at(a["field_corrections"], F.lit(field)).alias("value")),
        )
        return F.coalesce(F.array_max(values)["value"], field) if field in fields else F.col(field)

    out = out.withColumns({f"_now_{f}": now(f) for f in both.columns if f in (*fields, *changed)})
    if with_replies:

        names = dict(zip(changed, ("stem", "options", "correct_index", "explanation"), strict=True))
        new = lambda r, c: F.coalesce(r[names[c]], F.col(f"_now_{c}"))

        def candidate(a: Column, t: Column, r: Column) -> Column:
            ok = r.isNotNull() & critical_item_rules(lambda c: new(r, c))
            return F.struct(
                (~ok).cast("int").alias("bad"), (-a["priority"]).alias("last"), a["action_id"].alias("action_id"), t["attempt"].alias("attempt"), r.alias("r"))

        asked = F.filter("_acts", lambda a: (a["action_type"] == "regenerate") & found(a))
        # lists of one hold the reply's text and the reply as read, so that each is worked out once
        read = lambda body: F.when(body.startswith("{") & F.try_parse_json(body).isNotNull(), F.from_json(body, REPLY))
        tries = F.flatten(F.transform(asked, lambda a: F.flatten(F.transform(
            F.coalesce(a["tries"], F.array().cast("array<struct<attempt:int,reply:string>>")),
            lambda t: F.transform(F.transform(F.array(R.strip_fences(t["reply"])), read), lambda r: candidate(a, t, r))))))
        out = out.select("*", F.explode_outer(F.array(tries)).alias("_tries"))
        usable = F.filter("_tries", lambda c: c["r"].isNotNull() & (F.lit(overwrite_on_failure) | (c["bad"] == 0)))
        out = out.withColumn("_best", F.array_min(usable)["r"])
        # what the reply lacks stays as it was
        out = out.withColumn("_taken", F.when(F.col("_best").isNotNull(), F.struct(*[new(F.col("_best"), c).alias(c) for c in changed])))
        works = lambda a: F.coalesce(F.exists("_tries", lambda c: (c["action_id"] == a["action_id"]) & (c["bad"] == 0)), F.lit(False))
    else:
        out = out.withColumn("_taken", F.struct(*[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in changed]))
        works = lambda a: F.lit(False)
    done = F.transform("_acts", lambda a: F.struct(
        a["action_id"].alias("action_id"), a["entity_type"].alias("entity_type"), a["action_type"].alias("action_type"), a["priority"].alias("priority"),
        found(a).alias("found"), F.when(a["action_type"] == "auto_fix", fits(a)).otherwise(works(a)).alias("ok")))
    return out.withColumn("_done", done)


def correct_documents(courses: DataFrame, actions: DataFrame, keys: Sequence[str] = ("course_id",), unfold: Unfold | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply pending field corrections of any level to course documents: the documents and the
    outcome per action.

    Fields are dotted paths to single values. An action with an unknown entity or field, or with a
    value that can't be read as its field's type (a missing one neither), fails and changes nothing.
    Of several values for one field, the action of least priority comes last, as in
    the queue's order, and its value stays. ``unfold`` is that of :func:`lectern.operators.hierarchy.put_back`.
    """
    documents = unfold(courses) if unfold else courses
    known = settable_by_level(documents)
    allowed = F.create_map(*[x for kind, fields in known.items() for x in (F.lit(kind), T.words_array(fields))])
    fixes = locate(every_level(documents, keys), actions.filter((F.col("status") == "pending") & (F.col("action_type") == "auto_fix")), keys)
    names = F.coalesce(F.try_element_at(allowed, F.col("entity_type")), T.words_array([]))
    kinds = F.create_map(*[F.lit(x) for level, fields in known.items() for path, kind in fields.items() for x in (f"{level}.{path}", kind.simpleString())])
    distinct = {kind.simpleString(): kind for fields in known.values() for kind in fields.values()}

    def readable(entry: Column) -> Column:
        own, out = F.try_element_at(kinds, F.concat_ws(".", "entity_type", entry["key"])), F.lit(False)
        for name, kind in distinct.items():
            out = F.when(own == name, entry["value"].try_cast(kind).isNotNull()).otherwise(out)
        return out

    judged = fixes.withColumns({
        "named": F.forall(F.map_keys("field_corrections"), lambda k: F.array_contains(names, k)),
        "readable": F.forall(F.map_entries("field_corrections"), readable),
    }).withColumn("ok", F.col("found") & F.col("named") & F.col("readable"))
    last = (
        judged.filter("ok").select(*keys, "entity_path", "priority", "action_id", F.explode("field_corrections").alias("field", "value"))
        .groupBy(*keys, "entity_path", "field").agg(F.max_by("value", F.struct(-F.col("priority"), F.col("action_id"))).alias("value"))
        .groupBy(*keys, "entity_path").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    )
    outcome = judged.select(
        *keys, "action_id", "entity_type", "entity_path", "action_type", "priority", F.when(F.col("ok"), "applied").otherwise("failed").alias("status"),
        F.when(~F.col("found"), "entity not found").when(~F.col("named"), "field not found").when(~F.col("ok"), "value not readable").alias("error"),
    )
    return set_fields(courses, last, keys, unfold), outcome


def new_versions(courses: DataFrame, statuses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Documents with the version and status of :func:`course_status`; a course without actions has passed."""
    found = statuses.select(*keys, "validation_status", "output_version").withColumnsRenamed({"validation_status": "_status", "output_version": "_version"})
    out = courses.join(found, list(keys), "left")
    return out.withColumns({
        "version": F.coalesce("_version", F.col("version") + 1), "validation_status": F.coalesce("_status", F.lit("passed")), "validated_at": F.current_timestamp(),
    }).drop("_status", "_version")


def course_status(outcome: DataFrame, source_version: int, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Applied and failed counts, status and new version per course.

    Skipped regenerations of other entities than items count as failed.
    """
    applied = F.count_if(F.col("status") == "applied")
    failed = F.count_if((F.col("status") == "failed") | ((F.col("action_type") == "regenerate") & (F.col("entity_type") != "item") & (F.col("error") != "no replies")))
    manual = F.count_if(F.col("action_type") == "manual_review")
    out = outcome.groupBy(*keys).agg(
        applied.alias("corrections_applied"), failed.alias("corrections_failed"), manual.alias("manual_reviews")
    )
    status = F.when(F.col("manual_reviews") > 0, "needs_review").when(
        (F.col("corrections_failed") == 0) & (F.col("corrections_applied") == 0), "passed"
    ).otherwise("corrected")
    return out.withColumn("validation_status", status).withColumn("output_version", F.lit(source_version + 1))


def run_summary(reports: DataFrame, statuses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Report counts and correction counts on one row per course."""
    return reports.join(statuses, list(keys), "left").fillna(0, ["corrections_applied", "corrections_failed", "manual_reviews"]).withColumn(
        "validation_status", F.coalesce("validation_status", F.lit("passed"))
    )


def queue_counts(actions: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Actions by type, pending and applied."""
    kind = lambda k: F.count_if(F.col("action_type") == k).alias(k)
    return actions.groupBy(*keys).agg(
        kind("auto_fix"), kind("regenerate"), kind("manual_review"),
        F.count_if(F.col("status") == "pending").alias("pending_count"),
        F.count_if(F.col("status") == "applied").alias("applied_count"),
    )
