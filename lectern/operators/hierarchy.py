"""The course hierarchy: flatten, rebuild, roll up, and the views built from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lectern.functions import text as T
from lectern.functions.naming import entity_key
from lectern.functions.text import ColumnLike, col
from lectern.operators.durable import durable, numbered

# level, array that holds it in its parent, key of one entry
LEVELS = (
    ("module", "domain_modules", lambda m: entity_key(m["domain_name"])),
    ("topic", "topics", lambda t: entity_key(t["name"])),
    ("subtopic", "subtopics", lambda s: entity_key(s["name"])),
    ("lab", "labs", lambda lab: lab["lab_id"]),
    ("capsule", "capsules", lambda c: c["capsule_id"]),
    ("item", "items", lambda i: i["item_id"]),
)
LEVEL_NAMES = tuple(name for name, _, _ in LEVELS)


def flatten(courses: DataFrame, level: str, keys: Sequence[str] = ("course_id",), outer: bool = False) -> DataFrame:
    """One row per entity of ``level`` with its parents' structs, positions and path.

    ``courses`` holds course documents (nested rows). Exploding stays on the course's row: no
    shuffle. ``outer`` keeps parents without children.
    """
    out = courses.select(*keys, T.words_array([]).alias("entity_path"), F.col("domain_modules").alias("_children"))
    carried: list[str] = []
    depth = LEVEL_NAMES.index(level)
    for n, (name, _, key) in enumerate(LEVELS[: depth + 1]):
        out = out.select(*keys, "entity_path", *carried, F.posexplode_outer("_children").alias(f"{name}_pos", name))
        if not outer:
            # see unnest: a plain explode would evaluate the documents' arrays again for a filter
            out = out.filter(F.col(f"{name}_pos").isNotNull())
        carried += [f"{name}_pos", name]
        if n < depth:
            # children leave their parent before they are exploded: no row carries its siblings
            below = LEVELS[n + 1][1]
            out = out.select(
                *keys, F.array_append("entity_path", key(F.col(name))).alias("entity_path"), *carried[:-1],
                F.col(name).dropFields(below).alias(name), F.col(name)[below].alias("_children"),
            )
        else:
            out = out.withColumn("entity_path", F.array_append("entity_path", key(F.col(name))))
    return out.withColumn("entity_type", F.lit(level))


def items_to_fill(courses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Item rows that have no content yet, with all parent keys."""
    return flatten(courses, "item", keys).filter(F.coalesce("item.content", F.lit("")) == "")


def nest(children: DataFrame, parent_key: Sequence[str], position: str, name: str, part_rows: int | None = None) -> DataFrame:
    """Children packed under their parent in position order.

    With ``part_rows`` a parent's children are packed in numbered parts of at most that many
    rows (``part`` column), so a huge parent is many bounded rows.
    """
    rest = [c for c in children.columns if c not in parent_key and c != position]
    entry = F.struct(F.col(position), F.struct(*rest).alias("value"))
    group = list(parent_key)
    if part_rows:
        children = children.withColumn("part", F.floor(F.col(position) / part_rows))
        group.append("part")
    return children.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias(name)).withColumn(
        name, F.transform(name, lambda x: x["value"])
    )


Unfold = Callable[[DataFrame], DataFrame]


def put_back(courses: DataFrame, results: DataFrame, keys: Sequence[str] = ("course_id",), unfold: Unfold | None = None) -> DataFrame:
    """Course documents with the items of capsules replaced by generated ones.

    ``results(course keys, entity_path, items, success)``, the path ending at the capsule. A
    failed or absent result leaves its capsule as it was. The documents were single rows to
    begin with, so one map of results per document is bounded by the document. Of several results
    with one path, the first by its JSON text counts, for all capsules of that path.

    With ``unfold``, ``courses`` are narrow rows that it makes documents of, other columns kept: rows meet
    their results first, so no unfolded document is moved or sorted. Results that are dealt by the
    course keys already aren't moved either: all is told apart inside a course.
    """
    own = results.filter(F.col("success")).select(
        *keys, F.struct(F.array_join("entity_path", "\x1f").alias("path"), F.to_json(F.struct("items")).alias("text"), "items").alias("r"))
    listed = own.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("r"))
    first = F.filter("r", lambda x, i: (i == 0) | (x["path"] != F.get("r", i - 1)["path"]))
    good = listed.select(*keys, F.map_from_entries(F.transform(first, lambda x: F.struct(x["path"], x["items"]))).alias("_new"))
    fill = lambda c, path: c.withField(
        "items", F.coalesce(F.try_element_at("_new", path), c["items"])
    )

    def rebuilt(parent: Column, depth: int, path: Column | None) -> Column:
        _, array, key = LEVELS[depth]

        def one(child: Column) -> Column:
            here = key(child) if path is None else F.concat_ws("\x1f", path, key(child))
            if LEVEL_NAMES[depth] == "capsule":
                return fill(child, here)
            return child.withField(LEVELS[depth + 1][1], rebuilt(child, depth + 1, here))

        return F.transform(parent[array] if path is not None else F.col(array), one)

    joined = (unfold or _as_is)(courses.join(good, list(keys), "left"))
    return joined.withColumn(
        "domain_modules",
        F.when(F.col("_new").isNull(), F.col("domain_modules")).otherwise(rebuilt(None, 0, None)),
    ).drop("_new")


def settable(kind: Ty.DataType, leave: str | None = None, prefix: str = "") -> dict[str, Ty.DataType]:
    """Dotted paths of the single values in a struct, ``leave`` (its children) left out."""
    out: dict[str, Ty.DataType] = {}
    for f in kind.fields:
        if isinstance(f.dataType, Ty.StructType):
            out.update(settable(f.dataType, None, f"{prefix}{f.name}."))
        elif f.name != leave and not isinstance(f.dataType, (Ty.ArrayType, Ty.MapType)):
            out[prefix + f.name] = f.dataType
    return out


def settable_by_level(courses: DataFrame) -> dict[str, dict[str, Ty.DataType]]:
    """The fields that a correction may set, per entity type."""
    kind, out = courses.schema, {}
    for depth, name in enumerate(("skeleton", *LEVEL_NAMES)):
        child = LEVELS[depth][1] if depth < len(LEVELS) else None
        out[name] = settable(kind, child)
        if child:
            kind = kind[child].dataType.elementType
    return out


def _as_is(df: DataFrame) -> DataFrame:
    return df


def set_fields(courses: DataFrame, values: DataFrame, keys: Sequence[str] = ("course_id",), unfold: Unfold | None = None) -> DataFrame:
    """Course documents with single values of any level replaced.

    ``values(course keys, entity_path, fields map<dotted path, value>)``, one row per entity, the
    path empty for the course itself. Unknown fields and values that can't be read as their type
    change nothing. One map per document, bounded by the document, is looked up once per entity.
    ``unfold`` is that of :func:`put_back`.
    """
    unfold = unfold or _as_is
    documents = unfold(courses)  # for its columns only
    known = settable_by_level(documents)
    own = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.array_join("entity_path", "\x1f"), "fields"))).alias("_set"))

    def changed(entity: Column, level: str, found: Column) -> Column:
        out = entity
        for path, kind in known[level].items():
            old = entity
            for part in path.split("."):
                old = old[part]
            out = out.withField(path, F.coalesce(F.try_element_at(found, F.lit(path)).try_cast(kind), old))
        return F.when(found.isNull(), entity).otherwise(out)

    def level(parent: Column, depth: int, path: Column | None) -> Column:
        name, array, key = LEVELS[depth]

        def one(child: Column) -> Column:
            here = key(child) if path is None else F.concat_ws("\x1f", path, key(child))
            below = child if depth + 1 == len(LEVELS) else child.withField(LEVELS[depth + 1][1], level(child, depth + 1, here))
            pair = F.array(F.struct(below.alias("entity"), F.try_element_at("_set", here).alias("found")))
            return F.get(F.transform(pair, lambda p: changed(p["entity"], name, p["found"])), F.lit(0))

        return F.transform(F.col(array) if parent is None else parent[array], one)

    joined = unfold(courses.join(own, list(keys), "left"))
    out = joined.withColumn("domain_modules", F.when(F.col("_set").isNull(), F.col("domain_modules")).otherwise(level(None, 0, None)))
    top = F.try_element_at("_set", F.lit(""))
    tops = {p.split(".")[0] for p in known["skeleton"]} - set(keys)
    for column in [c for c in documents.columns if c in tops]:
        kind = documents.schema[column].dataType
        if isinstance(kind, Ty.StructType):
            new = F.col(column)
            for path, inner in settable(kind).items():
                old = F.col(column)
                for part in path.split("."):
                    old = old[part]
                new = new.withField(path, F.coalesce(F.try_element_at(top, F.lit(f"{column}.{path}")).try_cast(inner), old))
            new = F.when(F.col(column).isNotNull(), new)
        else:
            new = F.coalesce(F.try_element_at(top, F.lit(column)).try_cast(kind), F.col(column))
        out = out.withColumn(column, F.when(top.isNull(), F.col(column)).otherwise(new))
    return out.drop("_set")


def every_level(courses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """One row per entity of every level, the course itself (``skeleton``) included, as from :func:`flatten`
    (``entity_type``, ``entity_path``, positions and structs of the parents and its own) in one pass over the documents.

    A row of the deepest level stands for those of its parents whose first descendant it is. Below an entity's
    level positions and structs are those of its first descendants.
    """
    flat = flatten(courses, LEVEL_NAMES[-1], keys, outer=True).withColumnRenamed("entity_path", "_path").drop("entity_type")
    kinds = []
    for depth, kind in enumerate(("skeleton", *LEVEL_NAMES)):
        shown = F.lit(True) if not depth else F.col(f"{LEVEL_NAMES[depth - 1]}_pos").isNotNull()
        for below in LEVEL_NAMES[depth:]:
            shown = shown & (F.coalesce(f"{below}_pos", F.lit(0)) == 0)
        kinds.append(F.when(shown, F.struct(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"))))
    rows = flat.withColumn("_kind", F.explode(F.array(*kinds))).filter(F.col("_kind").isNotNull())
    return rows.withColumns({
        "entity_type": F.col("_kind.kind"), "entity_path": F.slice("_path", F.lit(1), F.col("_kind.depth")),
    }).drop("_path", "_kind")


def entities(courses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """(course keys, entity_type, entity_path) of every entity of every level."""
    return every_level(courses, keys).select(*keys, "entity_type", "entity_path").distinct()


def failed_results(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success"))


def course_summary(courses: DataFrame) -> DataFrame:
    """Counts per course document, in place."""
    def children(parents: Column, array: str) -> Column:
        return F.flatten(F.filter(F.transform(parents, lambda p: p[array]), lambda x: x.isNotNull()))

    chain: dict[str, Column] = {}
    for name, array, _ in LEVELS:
        chain[name] = children(chain[last], array) if chain else F.col(array)
        last = name
    count = lambda name: F.coalesce(F.size(chain[name]), F.lit(0))
    filled = F.size(F.filter(chain["item"], lambda i: F.coalesce(i["content"], F.lit("")) != ""))
    return courses.select(
        *[c for c in ("course_id", "certification_name", "version") if c in courses.columns],
        *[count(name).alias(f"{name}s") for name in LEVEL_NAMES],
        F.coalesce(filled, F.lit(0)).alias("items_with_content"),
    )


def course_list(courses: DataFrame, modified: str = "modified_at") -> DataFrame:
    """Module and lab counts per course, newest first."""
    return (
        course_summary(courses.select("course_id", "certification_name", "domain_modules"))
        .select("course_id", "certification_name", F.col("modules").alias("module_count"), F.col("labs").alias("lab_count"))
        .join(courses.select("course_id", modified), "course_id")
        .orderBy(F.desc(modified), "course_id")
    )


def rollup_counts(items: DataFrame, levels: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Counts at every level of the path in one pass over the flat table."""
    return items.rollup(*levels).agg(
        *[measure.alias(name) for name, measure in measures.items()],
        F.grouping_id().alias("level_mask"),
    )


def locate(entities: DataFrame, actions: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Actions with the entity they name; ``found`` tells whether it exists. Entities may be listed more than once."""
    on = [*keys, "entity_type", "entity_path"]
    rest = [c for c in actions.columns if c not in on]
    met = beside(entities.select(*on), actions, on, F.max("_l").alias("found"), F.collect_list("_r").alias("_r"), right=F.struct(*rest))
    rows = met.select(*on, F.coalesce("found", F.lit(False)).alias("found"), F.explode("_r").alias("_r"))
    return rows.select(*[c if c in on else F.col(f"_r.`{c}`") for c in actions.columns], "found")


def beside(left: DataFrame, right_rows: DataFrame, on: Sequence[str], *sums: Column, left_value: Column | None = None, right: Column) -> DataFrame:
    """Rows of both sides by ``on``, summed up from ``_l`` (``left_value``, or true) and ``_r``: a full join whose
    sides are gathered instead. Unlike a join, it moves nothing where both sides are dealt by some of ``on`` already.
    As in a join, rows with a null in ``on`` meet none of the other side."""
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    # a hash to stand before the keys: ids and paths begin alike, so sorting compares them to the end
    rows = lambda df, side, *values: df.select(F.xxhash64(*on).alias("_hash"), *on, F.when(missing, F.lit(side)).alias("_alone"), *values)
    both = rows(left, 0, (F.lit(True) if left_value is None else left_value).alias("_l")).unionByName(rows(right_rows, 1, right.alias("_r")), allowMissingColumns=True)
    return both.groupBy("_hash", *on, "_alone").agg(*sums).drop("_hash", "_alone")


# --- views ----------------------------------------------------------------------------------


def relevant_question_types(objectives: ColumnLike, question_types: ColumnLike) -> Column:
    """Types named by any objective; all of them when none is named or none matches."""
    named = F.array_distinct(F.flatten(F.transform(
        col(objectives), lambda o: F.coalesce(o["relevant_question_types"], T.words_array([]))
    )))
    kept = F.filter(col(question_types), lambda t: F.array_contains(named, t))
    return F.when((F.size(named) == 0) | (F.size(kept) == 0), col(question_types)).otherwise(kept)


def difficulty_of_lab(lab_type: ColumnLike) -> Column:
    return F.when(col(lab_type) == "challenge", "advanced").when(col(lab_type) == "guided", "beginner").otherwise("intermediate")


def present_questions(courses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """One row per item as shown to learners; accepts both item spellings."""
    flat = flatten(courses, "item", keys)
    place = lambda *parts: F.concat_ws("_", *[F.lit(p) if p.isalpha() else F.col(p).cast("string") for p in parts])
    from_list = F.transform(
        F.coalesce("item.options", T.words_array([])),
        lambda o, i: F.struct(
            F.concat_ws("_", place("opt", "capsule_pos", "item_pos"), i.cast("string")).alias("id"), o.alias("text"),
            F.coalesce(i == F.col("item.correct_answer_index"), F.lit(False)).alias("is_correct"),
            F.lit(None).cast("string").alias("explanation"),
        ),
    )
    from_rows = F.transform(
        "item.answer_options",
        lambda o, i: F.struct(
            F.coalesce(o["option_id"], F.concat_ws("_", place("opt", "capsule_pos", "item_pos"), i.cast("string"))).alias("id"),
            o["option_text"].alias("text"), F.coalesce(o["is_correct"], F.lit(False)).alias("is_correct"),
            o["explanation"].alias("explanation"),
        ),
    )
    answers = F.col("item.correct_answer")
    several = (F.col("item.question_type") == "MR") | (F.size(answers) > 1)
    return flat.select(
        *keys,
        F.coalesce("lab.lab_id", place("lab", "lab_pos")).alias("lab_id"),
        F.coalesce("capsule.capsule_id", place("capsule", "lab_pos", "capsule_pos")).alias("capsule_id"),
        F.coalesce("item.item_id", place("item", "capsule_pos", "item_pos")).alias("question_id"),
        F.coalesce("item.question_stem", "item.stem", "item.content", F.lit("")).alias("text"),
        difficulty_of_lab("lab.lab_type").alias("lab_difficulty"),
        F.col("item.difficulty").alias("difficulty"),
        F.coalesce(F.upper("item.question_type"), F.lit("MCQ")).alias("item_type"),
        F.coalesce(several, F.lit(False)).alias("multiple_correct"),
        F.coalesce(F.size(answers), F.lit(1)).alias("correct_count"),
        F.when(F.size("item.answer_options") > 0, from_rows).otherwise(from_list).alias("options"),
    )


def question_pool(courses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Every question with a stem, over all courses."""
    flat = flatten(courses, "item", keys)
    stem = F.coalesce("item.question_stem", "item.content")
    question_id = F.concat_ws(
        "_", F.coalesce("lab.lab_id", F.lit("lab")), F.coalesce("capsule.capsule_id", F.lit("cap")), F.col("item_pos").cast("string")
    )
    return flat.filter(F.coalesce(stem, F.lit("")) != "").select(
        *keys, question_id.alias("question_id"), stem.alias("text"),
        F.coalesce("lab.title", F.lit("Lab")).alias("lab_title"),
        F.coalesce("capsule.title", F.lit("Capsule")).alias("capsule_title"),
    )


def session_sample(pool: DataFrame, n: int, seed: str, key: Sequence[str] = ("question_id",)) -> DataFrame:
    """A repeatable random sample of ``n`` rows (all of them if fewer)."""
    place = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(seed)))
    return pool.withColumn("sample_key", place).orderBy("sample_key", *key).limit(n)


def shuffled_options(options: ColumnLike, correct_index: ColumnLike, item_id: ColumnLike, seed: str) -> Column:
    """``struct<options, correct_index>``: options in seeded order, the answer followed by place."""
    given = F.struct(col(options).alias("options"), F.concat_ws(":", F.lit(seed), col(item_id).cast("string")).alias("seed"))
    place = lambda g, i: F.md5(F.concat_ws(":", g["seed"], i.cast("string")))
    marked = lambda g: F.struct(F.sort_array(F.transform(  # noqa: E731 - drawn and sorted once for both results
        g["options"], lambda o, i: F.struct(place(g, i).alias("k"), i.alias("i"), o.alias("o")),
    )).alias("all"))

    def told(m: Column) -> Column:
        places = F.transform(m["all"], lambda x: x["i"])
        return F.struct(
            F.transform(m["all"], lambda x: x["o"]).alias("options"),
            F.greatest(F.array_position(places, col(correct_index)).cast("int") - 1, F.lit(0)).alias("correct_index"),
        )

    return F.get(F.transform(F.transform(F.array(given), marked), told), F.lit(0))


def learning_path(courses: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """One node per subtopic: its section, labs and minutes; modules without nodes drop out."""
    flat = flatten(courses.select(*keys, "domain_modules"), "subtopic", keys)
    labs = F.coalesce("subtopic.labs", F.expr("cast(array() as " + _labs_type(courses) + ")"))
    minutes = F.aggregate(
        labs, F.lit(0.0), lambda s, x: s + F.coalesce(x["estimated_duration_minutes"], F.lit(0.0))
    )
    node = F.concat_ws("_", F.lit("node"), *[F.col(f"{n}_pos").cast("string") for n in ("module", "topic", "subtopic")])
    return flat.select(
        *keys, "module_pos", "topic_pos", "subtopic_pos",
        F.concat(F.lit("section_"), F.col("module_pos").cast("string")).alias("section_id"),
        F.col("module.domain_name").alias("section_title"), node.alias("node_id"),
        F.col("subtopic.name").alias("title"),
        F.size(labs).alias("labs"), minutes.alias("estimated_minutes"),
    )


def _labs_type(courses: DataFrame) -> str:
    topic = courses.schema["domain_modules"].dataType.elementType["topics"].dataType
    return topic.elementType["subtopics"].dataType.elementType["labs"].dataType.simpleString()


def number_nodes(path: DataFrame, keys: Sequence[str] = ("course_id",)) -> DataFrame:
    """Running node number over a course's sections.

    A course was a single row to begin with, so its nodes are bounded by its document: one shuffle
    numbers them, and the documents are read once.
    """
    order = Window.partitionBy(*keys).orderBy("module_pos", "topic_pos", "subtopic_pos")
    return path.withColumn("node_number", F.row_number().over(order).cast("long"))


def covered_before(names: DataFrame, scope: Sequence[str], position: str, name: str) -> DataFrame:
    """Names already used by earlier entries of the same scope (context for the next request).

    A scope is one course's modules and topics, so its names form one bounded list.
    """
    before = Window.partitionBy(*scope).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return names.withColumn("already_covered", F.collect_list(name).over(before))


def covered_ranges(names: DataFrame, scope: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Each row of ``names`` with ``covered_end``: the rows of its scope at places 0 to ``covered_end`` - 1 come
    before it, its own place is ``covered_end``.

    One row per name however long the scope is, where :func:`covered_before` repeats every prefix; a scope with a
    third of all names is many tasks. Rows of equal position have places in either order.
    """
    return numbered(durable(names), scope, position, "covered_end")  # ranges are drawn from the names in a pass of their own


def names_before(asked: DataFrame, ranges: DataFrame, scope: Sequence[str], name: str) -> DataFrame:
    """The names that ``asked(scope, covered_end)`` come after, one row each: only for requests about to be written."""
    listed = ranges.select(*scope, F.col("covered_end").alias("place"), name)
    return asked.select(*scope, "covered_end").join(listed, list(scope)).filter("place < covered_end")


def ordered_distinct(rows: DataFrame, key: Sequence[str], value: str, position: str) -> DataFrame:
    """Distinct values per key with their first position."""
    return rows.groupBy(*key, value).agg(F.min(position).alias("first_pos"))
