"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger, a folder on the shared store, holds which
rule versions have seen which blob, and the spans they found. A scan takes the pairs of blob and rule version that the
ledger lacks, reads each such blob once, however many paths and versions carry it, and joins the findings back to all
paths. A new version of one rule scans the old blobs for that rule alone. Findings are kept by blob and rule version, and only those of
the versions asked for are read. A ledger opened again, in another session too, goes on from the finished runs in its folder.

Spans count code points, end exclusive. A rule's matches are leftmost and do not overlap; those that fail its test are
dropped after matching. Places come from the lengths of the matches and of the pieces between them.

Defined results: a null text is an empty one and has no spans. Repeated rows and equal texts share a blob. Spans of
different rules may overlap. A table without rows gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column, let, running, spare, whole
from ampertrace.session import cut_lineage, shared_folder


@dataclass(frozen=True)
class Rule:
    """``group`` is the group whose length must reach ``least``."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: a line break, also as it is escaped in a string
_BREAK = r"(?:[\x20\t]*+(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*+)"
_ENDS = r"[A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
#: From the BEGIN line to the END line with nothing but lines of fields and base64 between; without an END line to the last
#: base64 line. Loops over lines are possessive, which Java runs without recursion, so a key may have any number of lines.
PRIVATE_KEY = (
    rf"-----BEGIN {_ENDS}(?:{_BREAK}++[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+"
    rf"(?:[A-Za-z0-9+/=\s\\]*+-----END {_ENDS}"
    rf"|(?:[\x20\t]*+[A-Za-z0-9+/=]{{40,}}+)?+(?:{_BREAK}++[A-Za-z0-9+/=]{{16,}}+(?![^\s\\\"',;<-]|[\x20\t]++[^\s\\]))*+"
    rf"(?:(?<=[A-Za-z0-9+/=]{{16}})(?:{_BREAK}(?:[A-Za-z0-9+/]{{4}}){{0,3}}[A-Za-z0-9+/]{{2}}(?:==|[A-Za-z0-9+/][A-Za-z0-9+/=])(?=[\x20\t]*+(?:[\r\n\\\"']|\z)))?+(?:{_BREAK}=[A-Za-z0-9+/]{{4}})?+)?+)"
)
#: formats that issuers of credentials publish
MORE = (
    Rule("private_key", PRIVATE_KEY, 27, version=2),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 20, group=1),
)
RULES = BASE + MORE
SPANS = "array<struct<start: bigint, end: bigint, rule: string, kind: string>>"


def scan(text: Column, rule: Rule) -> Column:
    """Spans of one rule; null matches none. The text is cut at the matches only where it has some; linear in the matches."""
    # runs of one character class cannot start inside a longer run, so short ones need not be listed
    pattern = rule.pattern.replace("]+", "]{%d,}" % rule.least) if rule.kind == "hex" else rule.pattern
    whole_match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        tested = m if not rule.group else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))

        def placed(gaps: Column) -> Column:
            size = lambda c: F.length(c).cast("bigint")
            before = running(F.transform(m, lambda hit, i: size(gaps[i]) + size(hit)), F.lit(0).cast("bigint"), lambda a, b: a + b)

            def span(hit: Column, start: Column) -> Column:
                return F.struct(start.alias("start"), (start + size(hit)).alias("end"), F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"))

            made = let(before, lambda b: let(tested, lambda t: F.transform(m, lambda hit, i: F.when(F.length(t[i]) >= rule.least, span(hit, b[i] + size(gaps[i]))))))
            return F.filter(made, lambda x: x.isNotNull())

        return let(F.split(text, pattern, -1), placed)

    return let(whole_match, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(F.array().cast(SPANS)))


def address(text: Column) -> Column:
    return F.sha2(text, 256)


class Ledger:
    """Folders ``seen`` (blob, rules) and ``found`` (blob, spans with their rule versions), one pair of folders per run.

    A run writes ``found`` before ``seen``: a run that broke off leaves findings that nothing refers to, and its pairs
    are scanned again. Finished runs are those whose ``seen`` is complete.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        self.runs: list[str] = self._finished() if path else []

    def _finished(self) -> list[str]:
        jvm, context = self.spark._jvm, self.spark.sparkContext
        ends = jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/seen/_SUCCESS")
        found = ends.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(ends)
        return sorted(f.getPath().getParent().getParent().getName() for f in found or [])

    def seen(self) -> DataFrame:
        kind = "blob string, rules array<string>"
        return self._read("seen", kind).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("rules"))

    def found(self) -> DataFrame:
        return self._read("found", f"blob string, spans {SPANS}")

    def _read(self, part: str, kind: str) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{run}/{part}" for run in self.runs])

    def scan(self, versions: DataFrame, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> None:
        """Scan what the ledger lacks; of the paths that carry a blob, the smallest is read."""
        run = uuid.uuid4().hex
        keys = F.array(*[F.lit(r.key) for r in rules])
        t = whole(column(versions, text))
        blobs = versions.select(F.coalesce(column(versions, path).cast("string"), F.lit("")).alias("_path"), address(t).alias("blob"), t.alias("_t"))
        first = blobs.groupBy("blob").agg(F.min("_path").alias("_path"))
        if self.runs:
            first = first.join(self.seen(), "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("rules", F.array().cast("array<string>"))))
        else:
            first = first.withColumn("todo", keys)
        todo = cut_lineage(first.filter(F.size("todo") > 0).select("blob", "_path", "todo"))
        # the pair of path and blob is even whatever the copies; the small side is hashed
        texts = blobs.join(todo.hint("shuffle_hash"), ["_path", "blob"])
        none = F.array().cast(SPANS)
        lists = [F.when(F.array_contains("todo", r.key), scan(F.col("_t"), r)).otherwise(none) for r in rules]
        hits = texts.select("blob", F.sort_array(F.concat(*lists)).alias("spans")).filter(F.size("spans") > 0)
        # a row that is there twice has been read twice
        hits.dropDuplicates(["blob"]).write.parquet(f"{self.path}/{run}/found")
        todo.select("blob", F.col("todo").alias("rules")).write.parquet(f"{self.path}/{run}/seen")
        self.runs.append(run)


def spans_of(ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All spans of a blob by these rule versions in the order of start and rule: ``blob spans``. Blobs without any are not listed."""
    keys = [r.key for r in rules]
    kept = ledger.found().withColumn("spans", F.filter("spans", lambda s: s["rule"].isin(keys)))
    if len(ledger.runs) > 1:
        kept = kept.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in keys]), s["rule"])
    by_place = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return kept.withColumn("spans", F.sort_array(by_place)).filter(F.size("spans") > 0)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_: str = "doc_id", text: str = "text", ledger: Ledger | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts and spans of each document, those without secrets too."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, id_, text, rules)
    paths = docs.select(column(docs, id_).alias("doc_id"), address(whole(column(docs, text))).alias("blob"))
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digests = spans_of(ledger, rules).select(
        "blob", *[count(k) for k in base], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
    back = paths.join(digests, "blob", "left")
    return back.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced (``spans`` by start); linear in the text and the spans."""

    def cut(chars: Column, ends: Column) -> Column:
        """What stands before each run of spans, and behind the last."""
        gaps = F.transform(spans, lambda s, i: F.when(s["start"] >= ends[i], F.struct(ends[i].alias("at"), s["start"].alias("to"))))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        pieces = F.array_append(F.filter(gaps, lambda g: g.isNotNull()), F.struct(last.alias("at"), F.size(chars).cast("bigint").alias("to")))
        piece = lambda g: F.array_join(F.slice(chars, (g["at"] + 1).cast("int"), (g["to"] - g["at"]).cast("int")), "")
        return F.array_join(F.transform(pieces, piece), mask)

    before = running(F.transform(spans, lambda s: s["end"]), F.lit(0).cast("bigint"), F.greatest)
    return let(F.split(text, ""), lambda chars: let(before, lambda ends: cut(chars, ends)))


def mask_secrets(docs: DataFrame, id_: str = "doc_id", text: str = "text", ledger: Ledger | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with their secrets replaced; all rows and columns stay, a text without secrets is unchanged."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, id_, text, rules)
    blob, spans = spare(docs, "_blob", "_spans")
    found = spans_of(ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    marked = docs.withColumn(blob, address(whole(column(docs, text)))).join(found, blob, "left")
    new = F.when(F.col(spans).isNotNull(), masked(F.col(f"`{text}`"), F.col(spans))).otherwise(F.col(f"`{text}`"))
    return marked.withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns])
