"""People directory: repair, lookup in three tiers, name masking and label matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.functions.names import (
    collapse, default_login, login_part, manager_of, norm_person, person_hash, tokens_key,
)
from ampertrace.functions.text import strip, text_or_blank
from ampertrace.operators.matching import subset_pairs, substring_pairs
from ampertrace.session import cut_lineage

RECORD = ("name", "department", "person_hash", "normalized_name")


def directory(people: DataFrame) -> DataFrame:
    """Canonical columns of people rows; rows without name or department are left out."""
    clean = people.withColumns({"name": collapse("name"), "department": F.upper(strip(text_or_blank("department")))})
    clean = clean.withColumn("normalized_name", norm_person("name"))
    login = F.coalesce(F.nullif(login_part("jazz_login"), F.lit("")), default_login("name"))
    return clean.withColumns(
        {
            "tokens_key": tokens_key(F.col("normalized_name")),
            "person_hash": person_hash(F.col("normalized_name")),
            "jazz_login": login,
        }
    ).filter((F.col("normalized_name") != "") & (F.col("department") != ""))


def repair_people(people: DataFrame) -> DataFrame:
    """One row per (canonical name, department): the consistent row if there is one, else the lowest id."""
    canonical = directory(people.withColumnsRenamed({"normalized_name": "_old_name", "person_hash": "_old_hash"}))
    consistent = (F.col("_old_name") == F.col("normalized_name")) & (F.col("_old_hash") == F.col("person_hash"))
    columns = ("id", "name", "normalized_name", "department", "person_hash", "jazz_login")
    place = F.struct((~F.coalesce(consistent, F.lit(False))).alias("a"), F.col("id").alias("b"))
    best = canonical.groupBy("normalized_name", "department").agg(F.min_by(F.struct(*columns), place).alias("_row"))
    return best.select("_row.*")


def resolve_people(names: DataFrame, people: DataFrame, column: str = "name") -> DataFrame:
    """Distinct names with the record found: exact name, same tokens in any order, largest token subset.

    ``people`` is a ``directory``. Unknown names are absent from the result. The distinct names with their first two tiers are
    written once, so that the third does not read the names again.
    """
    wanted = (
        names.select(F.col(column).alias("given")).distinct().withColumn("_norm", norm_person("given")).filter(F.col("_norm") != "")
    )
    record = F.struct(*RECORD)
    exact = people.groupBy(F.col("normalized_name").alias("_norm")).agg(F.min_by(record, F.struct("name", "department")).alias("_exact"))
    tokens = people.groupBy(F.col("tokens_key").alias("_tokens")).agg(F.min_by(record, F.struct("name", "department")).alias("_same"))
    staged = cut_lineage(
        wanted.join(exact, "_norm", "left")
        .withColumn("_tokens", tokens_key(F.col("_norm")))
        .join(tokens, "_tokens", "left")
        .withColumn("_found", F.coalesce("_exact", "_same"))
    )
    known = staged.filter(F.col("_found").isNotNull()).select("given", "_found")
    open_names = staged.filter(F.col("_found").isNull()).select("given", F.split("_tokens", " ").alias("_name_tokens"))
    records = people.groupBy("tokens_key").agg(
        F.min_by(record, F.struct((-F.length("name")).alias("l"), F.col("name").alias("n"))).alias("_loose")
    ).select("_loose", F.split("tokens_key", " ").alias("_record_tokens"))
    pairs = subset_pairs(open_names, "_name_tokens", records, "_record_tokens")
    rank = F.struct(
        F.size(F.array_distinct("_record_tokens")).alias("t"), F.length("_loose.name").alias("l"), F.col("_loose.name").alias("n")
    )
    loose = pairs.groupBy("given").agg(F.max_by("_loose", rank).alias("_found"))
    return known.unionByName(loose).select("given", "_found.*")


def attach_people(items: DataFrame, people: DataFrame) -> DataFrame:
    """Keep items whose owner or creator is known; attach name, department and hash of both."""
    return resolve_roles(items, people).filter(F.col("owner_known") | F.col("creator_known")).drop(
        "owner_known", "creator_known"
    )


def resolve_roles(items: DataFrame, people: DataFrame) -> DataFrame:
    """Name, department and hash of owner and creator. The names found are written once, as both roles read them."""
    found = cut_lineage(resolve_people(items.select(F.explode(F.array("owner", "creator")).alias("name")), people))
    out = items
    for role in ("owner", "creator"):
        side = found.select(
            F.col("given").alias(role),
            F.col("name").alias(f"_{role}"),
            F.col("department").alias(f"{role}_department"),
            F.col("person_hash").alias(f"{role}_hash"),
        )
        out = out.join(side, role, "left").withColumn(f"{role}_known", F.col(f"_{role}").isNotNull())
        out = out.withColumns(
            {
                role: F.coalesce(f"_{role}", F.lit("")),
                **{f"{role}_{c}": F.coalesce(f"{role}_{c}", F.lit("")) for c in ("department", "hash")},
            }
        ).drop(f"_{role}")
    return out


def match_stats(items: DataFrame, people: DataFrame, samples: int = 5) -> DataFrame:
    """Match counts and the first few unknown names (in text order) per role."""
    given = {"_owner_given": strip("owner"), "_creator_given": strip("creator")}
    rows = resolve_roles(items.select("owner", "creator").withColumns(given), people)
    # read three times
    rows = cut_lineage(rows.select("owner_known", "creator_known", *given))
    owner, creator = F.col("owner_known"), F.col("creator_known")
    counts = rows.agg(
        F.count("*").alias("parsed"),
        F.count_if(owner).alias("owner_matched"),
        F.count_if(creator).alias("creator_matched"),
        F.count_if(owner | creator).alias("either_matched"),
        F.count_if(owner & creator).alias("both_matched"),
        F.count_if(~owner & ~creator).alias("dropped"),
    )

    def unknown(role: str) -> DataFrame:
        names = rows.filter(~F.col(f"{role}_known") & (F.col(f"_{role}_given") != "")).select(f"_{role}_given").distinct()
        first = names.orderBy(f"_{role}_given").limit(samples)
        return first.agg(F.array_join(F.array_sort(F.collect_list(f"_{role}_given")), ",").alias(f"unknown_{role}_samples"))

    return counts.crossJoin(unknown("owner")).crossJoin(unknown("creator"))


def person_view(items: DataFrame, role: str) -> DataFrame:
    """Items as seen by the owner or by the creator."""
    if role not in ("owner", "creator"):
        raise ValueError("role must be owner or creator")
    name, digest = strip(text_or_blank(role)), strip(text_or_blank(f"{role}_hash"))
    return items.filter((name != "") | (digest != "")).select(
        "project", "type", name.alias("owner"), F.col(f"{role}_department").alias("department"), digest.alias("person_hash"),
        "work_item_id", "work_item", "work_item_url",
    )


def mask_names(df: DataFrame, column: str, people: DataFrame, mode: str = "hash") -> DataFrame:
    """Replace known names by the person hash, or strip them (mode ``strip``). Case is ignored, longer names go first.

    NULL becomes an empty text.
    """
    return masked_copies(df, column, people, {column: mode})


def masked_copies(df: DataFrame, column: str, people: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Columns with the names in ``column`` masked, by name and mode (see ``mask_names``).

    The distinct texts are joined to the names they contain once, whatever the number of copies and the size of the directory, and
    each text is edited with just its own names.
    """
    record = F.struct("name", F.col("person_hash").alias("digest"))
    # read four times; what is written has a known size, so no join of names is taken for small by the size of their table
    terms = cut_lineage(
        people.filter(F.col("name") != "").groupBy(F.lower("name").alias("_term")).agg(F.min(record).alias("_n")).select("_term", "_n.*")
    )
    given = df.withColumn("_given", F.coalesce(F.col(column).cast("string"), F.lit("")))
    texts = given.select("_given").distinct().withColumn("_text", F.lower("_given"))
    order = F.struct((-F.length("name")).alias("l"), "name", "digest")
    per_text = substring_pairs(texts, "_text", terms, "_term").groupBy("_given").agg(F.array_sort(F.collect_set(order)).alias("_names"))

    def edited(mode: str) -> Column:
        mark = (lambda n: n["digest"]) if mode == "hash" else (lambda n: F.lit(" "))
        text = F.aggregate("_names", F.col("_given"), lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?iu)"), _quoted(n["name"])), mark(n)))
        text = F.coalesce(text, F.col("_given"))
        return collapse(text) if mode == "strip" else text

    return given.join(per_text, "_given", "left").withColumns({c: edited(m) for c, m in modes.items()}).drop("_names", "_given")


def _quoted(name: Column) -> Column:
    return F.regexp_replace(name, r"([^\p{L}\p{N} ])", r"\\$1")


def match_label(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Best entry per wanted label: exact, reversed, contained or token-subset match, then by label.

    ``wanted``: column ``wanted``; ``entries``: columns ``label`` and ``uri``.
    """
    forward = norm_person_like("wanted")
    backward = norm_person_like(F.array_join(F.reverse(F.split(collapse("wanted"), " ")), " "))
    asked = wanted.select("wanted").distinct().withColumns({"_fwd": forward, "_bwd": backward}).filter(F.col("_fwd") != "")
    offered = entries.select("label", "uri").distinct().withColumns(
        {"_l": norm_person_like("label"), "_u": norm_person_like("uri")}
    )
    both = F.explode(F.array_distinct(F.array("_fwd", "_bwd")))
    keys = asked.select("*", both.alias("_term"))
    texts = offered.withColumn("_value", F.explode(F.array_distinct(F.array("_l", "_u"))))
    by_text = substring_pairs(texts, "_value", keys, "_term").drop("_term", "_value")
    token_sets = texts.withColumn("_value_tokens", F.split("_value", " "))
    token_terms = keys.withColumn("_term_tokens", F.split("_term", " "))
    by_token = subset_pairs(token_sets, "_value_tokens", token_terms, "_term_tokens").drop(
        "_term", "_value", "_value_tokens", "_term_tokens"
    )
    pairs = by_text.unionByName(by_token).distinct()
    is_any = lambda key: (F.col("_l") == F.col(key)) | (F.col("_u") == F.col(key))
    holds = lambda key: F.contains("_l", F.col(key)) | F.contains("_u", F.col(key))
    miss = lambda c: (~c).cast("int")
    score = F.struct(
        miss(is_any("_fwd")).alias("exact"),
        miss((F.col("_bwd") != "") & is_any("_bwd")).alias("reversed"),
        miss(holds("_fwd") | ((F.col("_bwd") != "") & holds("_bwd"))).alias("contains"),
        F.coalesce(F.nullif("label", F.lit("")), "uri").alias("label"),
    )
    return pairs.groupBy("wanted").agg(F.min_by(F.struct("label", "uri"), score).alias("_e")).select("wanted", "_e.*")


def norm_person_like(c: Column | str) -> Column:
    """Lower-case ASCII words of a label."""
    from ampertrace.functions.names import fold_ascii

    return strip(F.regexp_replace(F.lower(fold_ascii(collapse(c))), "[^a-z0-9]+", " "))


def resolve_responsible(cases: DataFrame, people: DataFrame, strict: bool = True) -> DataFrame:
    """Responsible person per case by normalised name, else by display name.

    With ``strict`` a case without a match is an error, otherwise its columns stay NULL.
    """
    record = F.struct("name", "department", "normalized_name", "jazz_login")
    by_key = people.groupBy(F.col("normalized_name").alias("_key")).agg(F.min(record).alias("_by_key"))
    # one row per name, read by the check and by the result
    by_name = cut_lineage(resolve_people(cases, people, "responsible_name").join(
        people.groupBy("normalized_name").agg(F.min(record).alias("_by_name")), "normalized_name"
    ).select(F.col("given").alias("responsible_name"), "_by_name"))
    out = (
        cases.withColumn("_key", collapse("responsible_normalized"))
        .join(by_key, "_key", "left")
        .join(by_name, "responsible_name", "left")
        .withColumn("_r", F.coalesce("_by_key", "_by_name"))
    )
    if strict and not out.filter(F.col("_r").isNull()).limit(1).isEmpty():
        raise ValueError("a case has no responsible person in the directory")
    return out.withColumns(
        {
            "responsible_name": F.coalesce("_r.name", F.col("responsible_name")),
            "responsible_department": F.col("_r.department"),
            "responsible_login": F.col("_r.jazz_login"),
        }
    ).drop("_key", "_by_key", "_by_name", "_r")


def decode_people(df: DataFrame, people: DataFrame) -> DataFrame:
    """Attach the name, and the department where blank, of a person hash."""
    known = people.groupBy("person_hash").agg(F.min(F.struct("name", "department")).alias("_p"))
    own = F.col("department") if "department" in df.columns else F.lit(None).cast("string")
    return df.join(known, "person_hash", "left").withColumns(
        {
            "name": F.coalesce("_p.name", F.lit("")),
            "department": F.coalesce(F.nullif(own, F.lit("")), "_p.department", F.lit("")),
        }
    ).drop("_p")


def with_managers(df: DataFrame) -> DataFrame:
    own = F.col("manager") if "manager" in df.columns else F.lit(None).cast("string")
    return df.withColumn("manager", F.coalesce(F.nullif(own, F.lit("")), manager_of("department")))


