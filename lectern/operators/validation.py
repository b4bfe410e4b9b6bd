"""Structural rules as Columns, and the top-down funnel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import replies as R
from lectern.functions import severity as S
from lectern.functions import text as T
from lectern.functions.text import ColumnLike, col
from lectern.operators.hierarchy import LEVELS
from lectern.operators.unnest import unnest_structs

Fields = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A user-visible rule: ``passes`` builds a boolean Column from the entity's fields."""

    name: str
    entity_type: str
    severity: str
    passes: Callable[[Fields], Column]
    description: str
    suggested_fix: str | None = None


def _has_rows(value: Column) -> Column:
    return F.coalesce(F.size(value) > 0, F.lit(False))


def _long_enough(value: Column, least: int) -> Column:
    return F.coalesce(F.length(T.strip(value)) >= least, F.lit(False))


def _weights_sum(f: Fields) -> Column:
    weights = F.filter(F.transform(f("domain_modules"), lambda m: m["domain_weight_pct"]), lambda w: w.isNotNull())
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.coalesce((F.size(weights) == 0) | total.between(95, 105), F.lit(True))


def _count_fits(f: Fields) -> Column:
    kind, n = F.lower(F.coalesce(f("item_type"), F.lit(""))), F.size(f("options"))
    single = kind.contains("multiple choice") | kind.contains("mcq")
    multi = kind.contains("multiple response") | kind.contains("multi-select")
    return F.coalesce(F.when(single, n == 4).when(multi, n.between(5, 6)), F.lit(True))


def _index_fits(f: Fields) -> Column:
    index = f("correct_answer_index")
    return F.coalesce((index >= 0) & (index < F.size(f("options"))), F.lit(True))


def _distinct_options(f: Fields) -> Column:
    options = f("options")
    plain = F.transform(options, lambda o: F.lower(T.strip(o)))
    return F.coalesce(F.size(F.array_distinct(plain)) == F.size(options), F.lit(True))


def _is_one_of(value: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(F.lower(value).isin(list(allowed)), F.lit(False))


RULES: list[Rule] = [
    Rule("skeleton_has_domains", "skeleton", "critical", lambda f: _has_rows(f("domain_modules")), "no domain modules"),
    Rule("skeleton_has_overview", "skeleton", "major", lambda f: f("overview").isNotNull(), "no overview"),
    Rule("domain_weights_sum", "skeleton", "minor", _weights_sum, "domain weights do not sum to about 100", "Adjust domain weights to sum to 100%"),
    Rule("module_not_empty", "module", "critical", lambda f: _has_rows(f("topics")), "no topics"),
    Rule("module_has_overview", "module", "minor", lambda f: _long_enough(f("overview"), 10), "overview missing or short"),
    Rule("topic_has_subtopics", "topic", "critical", lambda f: _has_rows(f("subtopics")), "no subtopics"),
    Rule("topic_has_learning_objectives", "topic", "major", lambda f: _has_rows(f("learning_objectives")), "no learning objectives"),
    Rule("subtopic_has_labs", "subtopic", "critical", lambda f: _has_rows(f("labs")), "no labs"),
    Rule("subtopic_has_description", "subtopic", "minor", lambda f: _long_enough(f("description"), 10), "description missing or short"),
    Rule("lab_has_capsules", "lab", "critical", lambda f: _has_rows(f("capsules")), "no capsules"),
    Rule("lab_has_objective", "lab", "major", lambda f: _long_enough(f("objective"), 10), "objective missing or short"),
    Rule("lab_type_valid", "lab", "minor", lambda f: _is_one_of(f("lab_type"), lex.LAB_TYPES), "unknown lab type", "Use one of: " + ", ".join(lex.LAB_TYPES)),
    Rule("capsule_has_items", "capsule", "critical", lambda f: _has_rows(f("items")), "no items"),
    Rule("capsule_has_learning_goal", "capsule", "major", lambda f: _long_enough(f("learning_goal"), 10), "learning goal missing or short"),
    Rule("capsule_type_valid", "capsule", "minor", lambda f: _is_one_of(f("capsule_type"), lex.CAPSULE_TYPES), "unknown capsule type", "Use one of: " + ", ".join(lex.CAPSULE_TYPES)),
    Rule("content_not_empty", "item", "critical", lambda f: _long_enough(f("content"), 10), "content missing or short"),
    Rule("options_present", "item", "critical", lambda f: F.coalesce(F.size(f("options")) >= 2, F.lit(False)), "fewer than two options"),
    Rule("options_count_valid", "item", "major", _count_fits, "option count does not fit the type", "Regenerate with correct option count"),
    Rule("correct_index_valid", "item", "critical", _index_fits, "answer index out of bounds"),
    Rule("explanation_present", "item", "major", lambda f: _long_enough(f("explanation"), 20), "explanation missing or short"),
    Rule("source_reference_present", "item", "major", lambda f: f("source_reference").isNotNull(), "no source reference"),
    Rule("chunk_ids_present", "item", "minor", lambda f: f("source_reference").isNull() | _has_rows(f("source_reference")["chunk_ids"]), "no chunk ids"),
    Rule("no_duplicate_options", "item", "major", _distinct_options, "duplicate options", "Regenerate with unique options"),
]


def rules_for(entity_type: str, extra: Sequence[Rule] = ()) -> list[Rule]:
    return [r for r in [*RULES, *extra] if r.entity_type == entity_type]


def field_of(rule_name: str) -> str:
    return rule_name.split("_")[0] if "_" in rule_name else ""


def issues(rules: Sequence[Rule], fields: Fields) -> Column:
    """Failed rules of one entity as ``array<struct<...>>``, in rule order."""
    rows = [
        F.when(
            ~rule.passes(fields),
            F.struct(
                F.lit(rule.severity).alias("severity"), F.lit(rule.name).alias("rule_name"),
                F.lit(rule.description).alias("description"), F.lit(field_of(rule.name)).alias("field_path"),
                F.lit(rule.suggested_fix).cast("string").alias("suggested_fix"),
            ),
        )
        for rule in rules
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def overall_status(found: Column) -> Column:
    return S.worst_of(F.transform(found, lambda i: i["severity"]))


def check_entities(entities: DataFrame, entity_type: str, extra: Sequence[Rule] = (), struct: str | None = None) -> DataFrame:
    """Add ``issues`` and ``overall_status`` to flat rows, or to the struct column ``struct``."""
    fields = (lambda n: F.col(struct)[n]) if struct else F.col
    return entities.withColumn("issues", issues(rules_for(entity_type, extra), fields)).withColumn(
        "overall_status", overall_status(F.col("issues"))
    )


RESULT = (
    "struct<entity_type:string,entity_id:string,entity_path:array<string>,overall_status:string,issues:array<struct<"
    "severity:string,rule_name:string,description:string,field_path:string,suggested_fix:string>>>"
)


def validate_documents(courses: DataFrame, keys: Sequence[str] = ("course_id",), extra: Sequence[Rule] = ()) -> DataFrame:
    """Funnel over course documents: one row per checked entity, ``result_pos`` in document order.

    Children of a critical entity are neither checked nor counted. One pass over the row, no
    shuffle and no join: a document's results are built in place and exploded at the end.
    """
    def checked(kind: str, path: Column, key: Column, fields: Fields, then: Callable[[Column], Column] | None) -> Column:
        """The entity's row, then the rows of its children, if it isn't critical. Its path, key and issues, and
        its row, stand in lists of one: each is worked out once, however often what follows refers to it."""
        made = F.array(F.struct(path.alias("path"), key.alias("key"), issues(rules_for(kind, extra), fields).alias("found")))
        rows = F.transform(made, lambda m: F.struct(
            F.lit(kind).alias("entity_type"), m["key"].alias("entity_id"), m["path"].alias("entity_path"),
            overall_status(m["found"]).alias("overall_status"), m["found"].alias("issues"),
        ).cast(RESULT))
        if then is None:
            return rows
        return F.flatten(F.transform(rows, lambda r: F.when(r["overall_status"] == "critical", F.array(r)).otherwise(
            F.concat(F.array(r), then(r["entity_path"])))))

    def below(depth: int, parent: Column | None, path: Column) -> Column:
        name, array, key = LEVELS[depth]

        def one(child: Column) -> Column:
            then = None if depth + 1 == len(LEVELS) else lambda here: below(depth + 1, child, here)
            own = key(child)
            return F.flatten(F.transform(F.array(own), lambda k: checked(name, F.array_append(path, k), k, lambda n: child[n], then)))

        source = F.col(array) if parent is None else parent[array]
        return F.flatten(F.transform(source, one))

    everything = checked("skeleton", T.words_array([]), F.lit("skeleton"), F.col, lambda path: below(0, None, path))
    return unnest_structs(courses, everything, list(keys), "result_pos")


def funnel(levels: Sequence[tuple[str, DataFrame]], path_keys: Sequence[str], parts: dict[str, int] | None = None) -> DataFrame:
    """Funnel over flat level tables, top first.

    Each table carries the first n of ``path_keys`` and ``overall_status``. A row is visited
    when its parent was visited and is not critical: one semi join per level, on the parent's
    key. Returns ``entity_type``, the path keys (null below the level) and ``overall_status``.
    ``parts``: to how many partitions the rows of a level are dealt for that join, where the session's number
    is too small for a task to sort its share in memory.
    """
    out, open_parents = None, None
    for depth, (kind, table) in enumerate(levels, start=1):
        own, parent = list(path_keys[:depth]), list(path_keys[: depth - 1])
        if open_parents is not None and kind in (parts or {}):
            table = table.repartition(parts[kind], *parent)
        visited = table if open_parents is None else table.join(open_parents, parent, "left_semi")
        rows = visited.select(
            F.lit(kind).alias("entity_type"),
            *[F.col(k) if k in own else F.lit(None).cast("string").alias(k) for k in path_keys],
            "overall_status",
        )
        rows = rows.select("entity_type", *[F.col(k).cast("string").alias(k) for k in path_keys], "overall_status")
        out = rows if out is None else out.unionByName(rows)
        open_parents = visited.filter(F.col("overall_status") != "critical").select(*own)
    return out


def report(results: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Counts by status per course."""
    status = lambda s: F.count_if(F.col("overall_status") == s).alias(f"{s}_count")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_entities"), *[status(s) for s in lex.SEVERITIES]
    )


def by_severity(results: DataFrame, severity: str) -> DataFrame:
    return results.filter(F.col("overall_status") == severity)


def at_least(results: DataFrame, severity: str) -> DataFrame:
    """Results at or above a severity, by its order."""
    return results.filter(S.ordinal("overall_status") >= lex.SEVERITIES.index(severity))


def for_review(results: DataFrame) -> DataFrame:
    """Items that go on to review: everything not critical."""
    return results.filter((F.col("entity_type") == "item") & (F.col("overall_status") != "critical"))


ISSUE = "array<struct<severity:string,rule_name:string,description:string,suggested_fix:string>>"


def _issue(severity: ColumnLike, rule: ColumnLike, description: ColumnLike, field: str, fix: ColumnLike | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        text(severity).alias("severity"), text(rule).alias("rule_name"), text(description).alias("description"),
        F.lit(field).alias("field_path"), (F.lit(None) if fix is None else text(fix)).cast("string").alias("suggested_fix"),
    )


def grounding_issues(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Issues from grounding replies ``(item_id, reply)``; only for items with source, content
    and options. Not grounded is major, an unreadable reply minor."""
    ready = items.filter(
        (F.size("chunk_ids") > 0) & (F.coalesce("content", F.lit("")) != "") & (F.size("options") > 0)
    )
    joined = ready.select("item_id").join(replies, "item_id").withColumn(
        "r", R.read_as("reply", "is_grounded boolean, issues string, evidence string")
    )
    ok = R.is_object("reply")
    issue = F.when(~ok, _issue("minor", "grounding_check_error", "Grounding check failed", "content")).when(
        ~F.coalesce("r.is_grounded", F.lit(True)),
        _issue(
            "major", "answer_grounded", F.coalesce("r.issues", F.lit("Answer not found in source material")),
            "correct_answer_index", "Regenerate question with better source alignment",
        ),
    )
    return joined.withColumn("i", issue).filter(F.col("i").isNotNull()).select(
        "item_id", "i.*", F.col("r.evidence").alias("source_evidence")
    )


def review_issues(replies: DataFrame) -> DataFrame:
    """Issues listed by quality-review replies; unknown severities are minor."""
    rows = replies.withColumn("r", R.read_as("reply", f"issues {ISSUE}")).withColumn("ok", R.is_object("reply"))
    listed = F.transform(
        F.coalesce("r.issues", F.expr(f"cast(array() as {ISSUE})")),
        lambda i: _issue(
            R.one_of(F.lower(i["severity"]), lex.SEVERITIES, "minor"), R.default_text(i["rule_name"], "quality_review"),
            R.default_text(i["description"], "Quality issue found"), "content", i["suggested_fix"],
        ),
    )
    failed = F.array(_issue("minor", "quality_check_error", "Quality check failed", "content"))
    return unnest_structs(rows, F.when(F.col("ok"), listed).otherwise(failed), ["item_id"])


def merge_review(results: DataFrame, found: DataFrame) -> DataFrame:
    """Item results with the reviewers' issues added and the status worked out again.

    ``found(item_id, severity, rule_name, description, field_path, suggested_fix)``; a reply
    lists a handful of issues per item. Items are told apart by course and path where ``found``
    carries them, too (``course_id``, ``entity_path``), else by their id alone.
    """
    where = [c for c in ("course_id", "entity_path") if c in found.columns and c in results.columns]
    fields = ["severity", "rule_name", "description", "field_path", "suggested_fix"]
    extra = found.groupBy(F.col("item_id").alias("entity_id"), *where).agg(F.collect_list(F.struct(*fields)).alias("more"))
    joined = results.join(extra, ["entity_id", *where], "left")
    return joined.withColumn(
        "issues", F.when(F.col("more").isNull(), F.col("issues")).otherwise(F.concat("issues", "more"))
    ).withColumn("overall_status", overall_status(F.col("issues"))).drop("more")



