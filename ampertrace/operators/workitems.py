"""Analysis of defects and findings: repeated cases, departments, projects, people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampertrace.functions.names import case_key, collapse, keywords, norm_summary, work_item_class
from ampertrace.functions.text import strip, text_or_blank

CREATED_AFTER = "2025-01-01"


def filter_workitems(df: DataFrame, after: str = CREATED_AFTER) -> DataFrame:
    """Defects and findings created after a date, one row per id, newest first."""
    text = F.lower(text_or_blank("type"))
    kept = df.filter((F.col("created") > F.lit(after).cast("timestamp_ntz")) & (text.contains("defect") | text.contains("finding")))
    rest = [c for c in df.columns if c != "work_item_id"]
    one = kept.groupBy("work_item_id").agg(F.max(F.struct("created", *[c for c in rest if c != "created"])).alias("_r"))
    return one.select("work_item_id", "_r.*").select(*df.columns).orderBy(F.col("created").desc(), "work_item_id")


def merge_roles(owner_items: DataFrame, creator_items: DataFrame) -> DataFrame:
    """Owner rows with the creator of the same item; creator rows without an owner row are added.

    Both inputs are ``person_view`` results. Of several creator rows the greatest wins; all owner rows stay.
    """
    fields = ("project", "type", "work_item", "work_item_url")
    blank = F.lit("")

    def cleaned(df: DataFrame) -> DataFrame:
        return df.withColumn("work_item_id", strip(text_or_blank("work_item_id"))).filter(F.col("work_item_id") != "")

    creators = cleaned(creator_items).groupBy("work_item_id").agg(
        F.max(F.struct(*fields, "owner", "department", "person_hash")).alias("_c")
    )
    joined = cleaned(owner_items).join(creators, "work_item_id", "full_outer")
    own = lambda c: F.nullif(text_or_blank(c), blank)
    return joined.select(
        "work_item_id",
        *[F.coalesce(own(c), own(f"_c.{c}"), blank).alias(c) for c in fields],
        text_or_blank("owner").alias("owner"),
        text_or_blank("department").alias("owner_department"),
        text_or_blank("person_hash").alias("owner_hash"),
        text_or_blank("_c.owner").alias("creator"),
        text_or_blank("_c.department").alias("creator_department"),
        text_or_blank("_c.person_hash").alias("creator_hash"),
    )


def prepared(items: DataFrame, scrubbed: str = "work_item", safe: str = "work_item") -> DataFrame:
    """Item class, case key of the scrubbed summary and title of the masked summary."""
    summary = norm_summary(scrubbed)
    wi = F.concat(F.lit("wi-"), F.col("work_item_id").cast("string"))
    title = F.coalesce(F.nullif(strip(text_or_blank(safe)), F.lit("")), F.concat(F.lit("WI "), F.col("work_item_id").cast("string")))
    return items.withColumns(
        {
            "item_class": work_item_class("type"),
            "normalized_summary": F.coalesce(F.nullif(summary, F.lit("")), wi),
            "title": title,
            **{c: strip(text_or_blank(c)) for c in ("project", "owner_department", "creator_department", "owner_hash", "creator_hash")},
        }
    )


def top_values(df: DataFrame, keys: Sequence[str], value: str, n: int, name: str) -> DataFrame:
    """Most frequent non-blank values per group as an array of (value, n); ties by value.

    Rows are counted per (group, value) first; the limit is the feature, and Spark prunes groups to
    their first rows before the shuffle.
    """
    counts = df.filter(F.col(value) != "").groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    place = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("value").asc())
    best = counts.withColumn("_p", F.row_number().over(place)).filter(F.col("_p") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_p", "value", "n")))
    return best.groupBy(*keys).agg(
        F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(name)
    )


CLASSES = ("Defect", "Finding", "Other")


def case_values(items: DataFrame, fields: dict[str, int]) -> DataFrame:
    """Counted values ``normalized_summary field value n place`` of each case: all classes, the title and the top values of the fields.

    Each item gives one row per field, so one count and one ranking serve them all, and no case or value is gathered in a task.
    """
    rows = items.select("normalized_summary", F.explode(F.array(
        F.struct(F.lit("item_class").alias("field"), F.col("item_class").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.nullif(c, F.lit("")).alias("value")) for f, c in (("title", "title"), *((f, f) for f in fields))],
    )).alias("v")).select("normalized_summary", "v.field", "v.value").filter("field = 'item_class' or value is not null")
    counts = rows.groupBy("normalized_summary", "field", "value").agg(F.count("*").alias("n"))
    place = Window.partitionBy("normalized_summary", "field").orderBy(F.col("n").desc(), F.col("value").asc())
    most = {"item_class": len(CLASSES) + 1, "title": 1, **fields}
    # a limit by literals lets Spark prune before the shuffle
    ranked = counts.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= max(most.values()))
    return ranked.filter(F.col("place") <= F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("field")))


def case_headers(items: DataFrame, tops: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Repeated cases (more than one item) with counts by class, dominant class and title, and top values by name (field, number)."""
    tops = tops or {}
    is_class = F.col("field") == "item_class"
    listed = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("place", "value", "n"))))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    cases = case_values(items, {field: n for field, n in tops.values()}).groupBy("normalized_summary").agg(
        F.sum(F.when(is_class, F.col("n"))).alias("n"),
        *[F.coalesce(F.sum(F.when(is_class & (F.col("value") == c), F.col("n"))), F.lit(0)).alias(f"{c.lower()}_count") for c in CLASSES],
        F.max(F.when(F.col("field") == "title", F.col("value"))).alias("title"),
        *[listed(field).alias(name) for name, (field, _) in tops.items()],
    ).filter(F.col("n") > 1)
    defect, finding = F.col("defect_count") > 0, F.col("finding_count") > 0
    kind = F.when(defect & ~finding, F.lit("Defect")).when(finding & ~defect, F.lit("Finding")).otherwise(F.lit("Mixed"))
    return cases.select(
        "normalized_summary", "n", *[f"{c.lower()}_count" for c in CLASSES], kind.alias("case_type"), "title",
        *[F.when(F.size(name) > 0, bare(name)).alias(name) for name in tops],
    )


def repeated_keys(items: DataFrame) -> DataFrame:
    """The keys of the cases of more than one item, with their number."""
    return items.groupBy("normalized_summary").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def case_items(items: DataFrame, limit: int = 12) -> DataFrame:
    """At most ``limit`` example items of every repeated case."""
    repeated = repeated_keys(items).select("normalized_summary")
    place = Window.partitionBy("normalized_summary").orderBy("work_item_id", "project", "title")
    return (
        items.join(repeated, "normalized_summary", "left_semi")
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= limit)
        .select("normalized_summary", "place", "work_item_id", "project", "item_class", "title", "work_item_url")
    )


def repeated_cases(items: DataFrame) -> DataFrame:
    """Case headers with their top projects, departments and people."""
    tops = {
        "projects": ("project", 8), "owner_departments": ("owner_department", 5), "creator_departments": ("creator_department", 5),
        "owner_people": ("owner_hash", 5), "creator_people": ("creator_hash", 5),
    }
    return case_headers(items, tops).orderBy(F.col("n").desc(), F.lower("title"), "normalized_summary")


def workitem_summary(items: DataFrame) -> DataFrame:
    cases = repeated_keys(items).agg(
        F.count("*").alias("repeated_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_items")
    )
    named = lambda c: F.count_distinct(F.nullif(c, F.lit("")))
    counts = items.agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("item_class") == "Defect").alias("defects"),
        F.count_if(F.col("item_class") == "Finding").alias("findings"),
        F.count_if(F.col("item_class") == "Other").alias("other"),
        named("owner_department").alias("owner_departments"),
        named("creator_department").alias("creator_departments"),
        named("project").alias("projects"),
    )
    return counts.crossJoin(cases)


def _class_counts(*classes: str) -> list[Column]:
    names = {"Defect": "defects", "Finding": "findings", "Other": "other"}
    return [F.count_if(F.col("item_class") == c).alias(names[c]) for c in classes]


def department_details(items: DataFrame, role: str, limit: int = 10) -> DataFrame:
    department = f"{role}_department"
    rows = items.filter(F.col(department) != "")
    totals = rows.groupBy(F.col(department).alias("department")).agg(
        F.count("*").alias("total"), *_class_counts("Defect", "Finding", "Other")
    )
    people = top_values(rows.withColumn("department", F.col(department)), ["department"], f"{role}_hash", 3, "top_people")
    return totals.orderBy(F.col("total").desc(), "department").limit(limit).join(people, "department", "left")


def department_split(items: DataFrame, limit: int = 12) -> DataFrame:
    """Items per department as owner and as creator."""
    roles = F.explode(
        F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_department").alias("department")) for r in ("owner", "creator")])
    )
    rows = items.select("item_class", roles.alias("_r")).select("item_class", "_r.*").filter(F.col("department") != "")
    is_role = lambda r: F.col("role") == r
    split = rows.groupBy("department").agg(
        *[F.count_if(is_role(r)).alias(f"{r}_count") for r in ("owner", "creator")],
        *[
            F.count_if(is_role(r) & (F.col("item_class") == c)).alias(f"{r}_{c.lower()}s")
            for r in ("owner", "creator")
            for c in ("Defect", "Finding")
        ],
    )
    return split.orderBy((F.col("owner_count") + F.col("creator_count")).desc(), "department").limit(limit)


def project_details(items: DataFrame, limit: int = 12) -> DataFrame:
    """Counts per project, how many of its items belong to repeated cases, and top departments."""
    rows = items.filter(F.col("project") != "")
    totals = rows.groupBy("project").agg(F.count("*").alias("total"), *_class_counts("Defect", "Finding"))
    repeated = (
        rows.join(repeated_keys(items).select("normalized_summary"), "normalized_summary", "left_semi")
        .groupBy("project")
        .agg(F.count("*").alias("repeated"))
    )
    out = totals.orderBy(F.col("total").desc(), "project").limit(limit).join(repeated, "project", "left")
    for role in ("owner", "creator"):
        out = out.join(top_values(rows, ["project"], f"{role}_department", 3, f"{role}_departments"), "project", "left")
    return out.fillna(0, ["repeated"])


def people_counts(items: DataFrame, role: str, limit: int = 20) -> DataFrame:
    digest = f"{role}_hash"
    counts = items.filter(F.col(digest) != "").groupBy(F.col(digest).alias("person_hash")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "person_hash").limit(limit)


def keyword_counts(items: DataFrame) -> DataFrame:
    words = items.select(F.explode(keywords(F.col("normalized_summary"))).alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword")


def case_groups(entries: DataFrame) -> DataFrame:
    """Distinct entries of each case by lower-cased (url, id, summary), with counts per project."""
    clean = entries.withColumns(
        {
            "project": collapse("project"),
            "work_item_id": collapse("work_item_id"),
            "summary": collapse("summary"),
            "work_item_url": strip(text_or_blank("work_item_url")),
        }
    )
    keys = [F.lower(c).alias(f"_{c}") for c in ("work_item_url", "work_item_id", "summary")]
    one = clean.groupBy("case_key", *keys).agg(F.min("project").alias("project"))
    return (
        one.withColumn("project", F.coalesce(F.nullif("project", F.lit("")), F.lit("-")))
        .groupBy("case_key", "project")
        .agg(F.count("*").alias("n"))
    )


def ll_candidates(groups: DataFrame, cases: DataFrame) -> DataFrame:
    """Candidate rows of cases: key, title, responsible person and number of distinct entries.

    ``cases``: case_key, title, normalized_summary, responsible_name, responsible_department.
    """
    entries = groups.groupBy("case_key").agg(F.sum("n").alias("entry_count"))
    title = F.coalesce(F.nullif(collapse("title"), F.lit("")), F.nullif(collapse("normalized_summary"), F.lit("")), F.lit("-"))
    return cases.join(entries, "case_key", "left").select(
        case_key("normalized_summary", "title", F.struct("entry_count")).alias("case_key"),
        title.alias("title"),
        title.alias("description"),
        collapse("responsible_name").alias("input_creator_name"),
        collapse("responsible_department").alias("input_creator_department"),
        F.coalesce("entry_count", F.lit(0)).alias("entry_count"),
    )
